"""Relational operators that are more than a method of a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fk_join(child: DataFrame, parent: DataFrame, foreign_key: str, key: str, how: str = "inner") -> DataFrame:
    """Star join of a child to its parent: inner; outer (left, every child row stays); semi and anti (children with, and
    without, a parent; a missing key has none). Catalyst broadcasts a parent below its threshold by measured size."""
    kinds = {"inner": "inner", "outer": "left", "left": "left", "semi": "left_semi", "anti": "left_anti"}
    if how not in kinds:
        raise ValueError(f"no join {how}")
    return child.join(parent, F.col(f"`{foreign_key}`") == F.col(f"`{key}`"), kinds[how])


def child_counts(child: DataFrame, foreign_key: str) -> DataFrame:
    """Children per parent key: foreign_key, n."""
    return child.where(F.col(f"`{foreign_key}`").isNotNull()).groupBy(foreign_key).agg(F.count(F.lit(1)).alias("n"))


def top_n(df: DataFrame, column: str, n: int | None = None) -> DataFrame:
    """Values of a column by rows, most first: topn_<column>, topn_count, topn_percent; a list counts in each of its values.

    With n, the rows of all other values stand under ``OTHER:``; the last row is ``TOTAL:``. Missing values don't count. Ties
    are in order of the value. Only counts are sorted, and only the n first are kept."""
    c = F.col(f"`{column}`")
    listed = isinstance(df.schema[column].dataType, T.ArrayType)
    counts = df.select((F.explode(c) if listed else c).alias("v")).where("v is not null").groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all")).scalar()
    ranked = counts.orderBy(F.desc("n"), F.asc("v"))
    kept = (ranked.limit(n) if n is not None else ranked).select(F.col("v").cast("string").alias("v"), "n", F.lit(0).alias("place"))
    had = kept.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("had")).select(F.col("had"), total.alias("all"))
    rows = [F.struct(F.lit("TOTAL:").alias("v"), F.col("all").alias("n"), F.lit(2).alias("place"))]
    if n is not None:
        rows.append(F.struct(F.lit("OTHER:").alias("v"), (F.col("all") - F.col("had")).alias("n"), F.lit(1).alias("place")))
    tail = had.select(F.explode(F.array(*rows)).alias("r")).select("r.*").where("place = 2 or n > 0")
    both = kept.unionByName(tail).withColumn("all", total)
    percent = F.when(F.col("all") > 0, F.col("n") * 100.0 / F.col("all")).otherwise(0.0)
    return both.orderBy("place", F.desc("n"), "v").select(F.col("v").alias(f"topn_{column}"), F.col("n").alias("topn_count"), percent.alias("topn_percent"))


def stratified_sample(df: DataFrame, stratum: Column, percent: float, seed: int = 42) -> DataFrame:
    """``percent`` of the rows of every stratum at random,; rows without a stratum form one too. Rows are drawn one by
    one with the share as chance, so no shuffle is needed."""
    if not 0 <= percent <= 100:
        raise ValueError("a share is from 0 to 100 percent")
    # strata draw from their own sequences, so the share holds in each
    draw = F.pmod(F.xxhash64(stratum.cast("string"), F.rand(seed)), F.lit(1_000_000))
    return df.where(draw < percent * 10_000)


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Old rows without those whose key comes again, and the new rows; of equal new keys the last row stays."""
    order = new.withColumn("_o", F.monotonically_increasing_id())
    rest = [c for c in new.columns if c not in keys]
    last = order.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_o").alias("_v")).select(*keys, "_v.*").select(*old.columns)
    on = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
    return old.alias("o").join(last.select(*keys).alias("n"), on, "left_anti").unionByName(last)


def explode_children(df: DataFrame, key: str, path: str, position: str = "pos") -> DataFrame:
    """Child rows of a nested list, with their parent's key and place in the list."""
    return df.select(F.col(f"`{key}`"), F.posexplode(F.col(path)).alias(position, "_c")).select(key, position, "_c.*")


def at_path(c: Column, path: str) -> Column:
    """The value at /a/b/0/c in nested maps, lists and structs held as JSON text."""
    steps = [p for p in path.strip("/").split("/") if p]
    return F.get_json_object(c, "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in steps))


def bitmap_algebra(union: list[Column], intersect: list[Column], difference: list[Column]) -> Column:
    """Rows in any of the union (all rows, if there is none), in all of the intersections and in none of the differences."""
    out = F.lit(True)
    if union:
        out = F.lit(False)
        for c in union:
            out |= F.coalesce(c, F.lit(False))
    for c in intersect:
        out &= F.coalesce(c, F.lit(False))
    for c in difference:
        out &= ~F.coalesce(c, F.lit(False))
    return out
