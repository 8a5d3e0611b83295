"""Quality profiles of columns, load by load, from the character-class masks of their values.

Values are counted per load and column once, map-side first, and generalised to masks; everything else is worked out on the
counts of masks. Over all loads the dominant masks of a column are mined, which together cover most of its rows; the others
are rare, and their rows violations of the column's pattern. What a rule calls malformed is decided once for every mask.
Loads are compared by how their masks are distributed.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.columnar import MARKS, NO_VALUE, WHITE_SPACE
from tallyforge.session import checkpointed


def mask(value: Column) -> Column:
    """Capitals A, other letters a, digits 9; everything else stays. Marks on letters belong to them."""
    m = F.regexp_replace(value, r"\p{Lu}\p{M}*", "A")
    m = F.regexp_replace(m, r"[\p{L}&&[^A]]\p{M}*", "a")
    return F.regexp_replace(m, "[0-9]", "9")


def shape(masked: Column) -> Column:
    """A mask with runs of a class written once: coarser, as lengths are lost."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(masked, "A+", "A"), "a+", "a"), "9+", "9")


def is_missing(value: Column) -> Column:
    """value has no outer blanks. Null, blank, or a word or mark saying only that there is no value."""
    return value.isNull() | (value == "") | F.lower(value).isin(*NO_VALUE) | value.rlike(rf"\A{MARKS}+\z")


@dataclass(frozen=True)
class Rule:
    """What is well-formed in a column: masks that match every one of ``fits`` and none of ``breaks``; if low and high are
    given also numbers from low to high, whose mean is taken."""

    column: str
    fits: tuple[str, ...]
    breaks: tuple[str, ...] = ()
    low: float | None = None
    high: float | None = None

    def fitting(self, masked: Column) -> Column:
        ok = F.lit(True)
        for p in self.fits:
            ok &= masked.rlike(p)
        for p in self.breaks:
            ok &= ~masked.rlike(p)
        return ok

    def within(self, value: Column) -> Column:
        return F.lit(True) if self.low is None else F.coalesce(value.try_cast("double").between(self.low, self.high), F.lit(False))

    def well_formed(self, value: Column, masked: Column) -> Column:
        return self.fitting(masked) & self.within(value)


LAST_NAME = Rule("last_name", (r"\A[Aa]",), (r"[^Aa '’\-]", r"[ '’\-]{2}", r"[ '’\-]\z"))
ZIP = Rule("zip", (r"\A99999(-9999)?\z",))
AGE = Rule("age", (r"\A-?9+\z",), low=0, high=120)
HEIGHT = Rule("height", (r"\A-?9+(\.99?)?\z",), low=20, high=100)
CUSTOMER_RULES = (LAST_NAME, HEIGHT, AGE, ZIP)


def value_counts(df: DataFrame, columns: list[str], load: str) -> DataFrame:
    """load, column_name, value without outer blanks, n. One shuffle, of the counts made map-side."""
    cells = F.array(*(F.struct(F.lit(c).alias("column_name"), F.btrim(F.col(f"`{c}`").cast("string"), F.lit(WHITE_SPACE)).alias("value")) for c in columns))
    return df.select(F.col(f"`{load}`").cast("string").alias("load"), F.explode(cells).alias("c")).groupBy("load", "c.column_name", "c.value").agg(F.count(F.lit(1)).alias("n"))


def placed(df: DataFrame, columns: list[str], numbers: tuple[str, ...] = ()) -> Column:
    """Of value_counts: the value behind what puts it in its column's own order, so that least and greatest are those of the
    column's type and come out whole, as text. Text columns named in ``numbers`` have the order of their numbers; other
    values of theirs have no place, null."""
    ordered = (T.NumericType, T.BooleanType, T.DateType, T.TimestampType, T.TimestampNTZType)
    kinds: dict[str, list[str]] = {}
    for f in df.schema:
        if f.name in columns and isinstance(f.dataType, ordered):
            kinds.setdefault(f.dataType.simpleString(), []).append(f.name)
    name, value = F.col("column_name"), F.col("value")
    keys = [F.when(name.isin(of), value.try_cast(kind)).alias(f"k{i}") for i, (kind, of) in enumerate(kinds.items())]
    texts = [c for c in numbers if c in columns and not any(c in of for of in kinds.values())]
    if not texts:
        return F.struct(*keys, value.alias("value"))
    is_number = value.rlike(r"\A-?[0-9]+(\.[0-9]+)?\z")
    keys.append(F.when(name.isin(texts) & is_number, value.try_cast("double")).alias("number"))
    return F.when(~name.isin(texts) | is_number, F.struct(*keys, value.alias("value")))


def mask_counts(df: DataFrame, columns: list[str], load: str, rules: tuple[Rule, ...] = ()) -> DataFrame:
    """load, column_name, mask (null for missing values), and of the values of each: rows, distinct_values, top_value_rows, least and
    greatest; of those in their rule's range within_rows, and if it has one their number of rows and total. Kept in the
    checkpoint folder, since all that follows goes over it more than once."""
    value, name = F.col("value"), F.col("column_name")
    counts = value_counts(df, columns, load)
    within, number = F.lit(True), F.lit(None).cast("double")
    for r in rules:
        within = F.when(name == r.column, r.within(value)).otherwise(within)
        if r.low is not None:
            number = F.when(name == r.column, value.try_cast("double")).otherwise(number)
    place = placed(df, columns, tuple(r.column for r in rules if r.low is not None))
    made = counts.select("load", "column_name", F.when(~is_missing(value), mask(value)).alias("mask"), "n", within.alias("ok"), number.alias("x"), place.alias("place"))
    here, ok = F.col("mask").isNotNull(), F.col("ok")
    out = made.groupBy("load", "column_name", "mask").agg(
        F.sum("n").alias("rows"),
        F.count("mask").alias("distinct_values"),
        F.max(F.when(here, F.col("n"))).alias("top_value_rows"),
        F.coalesce(F.sum(F.when(ok, F.col("n"))), F.lit(0)).alias("within_rows"),
        F.sum(F.when(ok & F.col("x").isNotNull(), F.col("n"))).alias("numbers"),
        F.sum(F.when(ok, F.col("n") * F.col("x"))).alias("total"),
        F.min(F.when(here, F.col("place"))).alias("least"),
        F.max(F.when(here, F.col("place"))).alias("greatest"),
    )
    return checkpointed(out)


def mined_masks(masks: DataFrame, *, cover: float = 0.98) -> DataFrame:
    """Over all loads, of each column's masks: column_name, mask, rows, share (of the rows that hold a value), dominant.

    Dominant are the most frequent masks that together cover at least ``cover`` of the column's rows that hold a value, and
    those as frequent as the last of them. How far down that goes is read from how many masks have how many rows, a table that
    is small however many masks there are.
    """
    own = masks.where("mask is not null").groupBy("column_name", "mask").agg(F.sum("rows").alias("rows"))
    tally = own.groupBy("column_name", "rows").agg((F.sum("rows")).alias("held"))
    down = Window.partitionBy("column_name").orderBy(F.desc("rows"))
    whole = F.sum("held").over(Window.partitionBy("column_name"))
    above = F.sum("held").over(down) - F.col("held")
    least = tally.select("column_name", "rows", whole.alias("whole"), above.alias("above")).where(F.col("above") < cover * F.col("whole"))
    least = least.groupBy("column_name").agg(F.min("rows").alias("least"), F.max("whole").alias("whole"))
    return own.join(least, "column_name").select("column_name", "mask", "rows", (F.col("rows") / F.col("whole")).alias("share"), (F.col("rows") >= F.col("least")).alias("dominant"))


def load_profile(df: DataFrame, rules: tuple[Rule, ...], *, columns: list[str] | None = None, load: str = "load_id", cover: float = 0.98) -> DataFrame:
    """One row per load and column, of the judged ones if none are named: rows, missing, malformed, rare (whose mask is none of the
    dominant ones that mined_masks finds), distinct_values (exact), top_value_rows, the shares of these (missing of all rows,
    the others of the rest), mean, of well-formed numbers, and least and greatest, the range of the values that aren't missing.

    A range has the order of the column's type and is given as text; of a text column judged by numbers it is that of all
    its numbers, well-formed or not. Shares of the rest, the mean and the range are null where there is no rest, malformed
    and its share where no rule judges the column. Rows without a load are a load of their own, null.
    """
    judges = [r.column for r in rules]
    columns = judges if columns is None else columns
    masks = mask_counts(df, columns, load, rules)
    mined = mined_masks(masks, cover=cover)
    fits = F.lit(None).cast("boolean")
    for r in rules:
        fits = F.when(F.col("column_name") == r.column, r.fitting(F.col("mask"))).otherwise(fits)
    verdicts = mined.select("column_name", "mask", "dominant", fits.alias("fits"))
    judged = masks.join(verdicts, ["column_name", "mask"], "left")
    here, n = F.col("mask").isNotNull(), F.col("rows")
    sums = judged.groupBy("load", "column_name").agg(
        F.sum("rows").alias("rows"),
        F.coalesce(F.sum(F.when(~here, n)), F.lit(0)).alias("missing"),
        F.when(F.col("column_name").isin(judges), F.coalesce(F.sum(F.when(here, n - F.when(F.col("fits"), F.col("within_rows")).otherwise(0))), F.lit(0))).alias("malformed"),
        F.coalesce(F.sum(F.when(~F.col("dominant"), n)), F.lit(0)).alias("rare"),
        F.sum("distinct_values").alias("distinct_values"),
        F.coalesce(F.max("top_value_rows"), F.lit(0)).alias("top_value_rows"),
        F.sum(F.when(F.col("fits"), F.col("total"))).alias("total"),
        F.sum(F.when(F.col("fits"), F.col("numbers"))).alias("numbers"),
        F.min("least")["value"].alias("least"),
        F.max("greatest")["value"].alias("greatest"),
    )
    rest = F.col("rows") - F.col("missing")
    return sums.select(
        F.col("load").alias(load), "column_name", "rows", "missing", "malformed", "rare", "distinct_values", "top_value_rows",
        (F.col("missing") / F.col("rows")).alias("missing_share"),
        F.when(rest > 0, F.col("malformed") / rest).alias("malformed_share"),
        F.when(rest > 0, F.col("rare") / rest).alias("rare_share"),
        F.when(rest > 0, F.col("top_value_rows") / rest).alias("top_share"),
        F.when(F.col("numbers") > 0, F.col("total") / F.col("numbers")).alias("mean"),
        "least", "greatest",
    )


def departing_loads(profile: DataFrame, *, load: str = "load_id", share: float = 0.15, mean: float = 10.0) -> DataFrame:
    """Loads whose column departs: a share more than ``share``, or the mean more than ``mean``, from the median of all loads.

    Medians are exact; a load without a figure neither departs by it nor counts for its median.
    """
    figures = {"missing_share": share, "malformed_share": share, "top_share": share, "mean": mean}
    medians = profile.groupBy("column_name").agg(*(F.percentile(c, F.lit(0.5)).alias(f"mid_{c}") for c in figures))
    far = F.lit(False)
    for c, most in figures.items():
        far |= F.coalesce(F.abs(F.col(c) - F.col(f"mid_{c}")) > most, F.lit(False))
    return profile.join(medians, "column_name").where(far).select(load, "column_name")


def mask_profile(df: DataFrame, columns: list[str], *, load: str = "load_id") -> DataFrame:
    """Of every column and load, each mask of values: load, column_name, mask (null for missing), pattern (the mask's shape),
    rows, distinct_values (exact), least and greatest value in the order of the column's type, whole and as text, and share
    of the load's rows.

    Values are counted first, so each distinct one is masked once. Masks are as long as their values.
    """
    out = mask_counts(df, columns, load)
    total = df.groupBy(F.col(f"`{load}`").cast("string").alias("_l")).agg(F.count(F.lit(1)).alias("_all"))
    joined = out.join(total, F.col("load").eqNullSafe(F.col("_l")))
    return joined.select(F.col("load").alias(load), "column_name", "mask", shape(F.col("mask")).alias("pattern"), "rows", "distinct_values", F.col("least.value").alias("least"), F.col("greatest.value").alias("greatest"), (F.col("rows") / F.col("_all")).alias("share"))


def rare_patterns(masks: DataFrame, *, cover: float = 0.98) -> DataFrame:
    """The masks that are none of the dominant ones of mined_masks: column_name, mask, pattern, rows, share."""
    return mined_masks(masks, cover=cover).where("not dominant").select("column_name", "mask", shape(F.col("mask")).alias("pattern"), "rows", "share")


def _divergence(pairs: DataFrame, keys: list[str], name: str) -> DataFrame:
    """Jensen-Shannon divergence of p from q, shares of masks in rows that hold all masks of p, q being null where it has none."""
    p, q = F.col("p"), F.coalesce(F.col("q"), F.lit(0.0))
    m = (p + q) / 2
    # masks that only q has add q/2 each: one less the q that is here
    parts = pairs.groupBy(*keys).agg(F.sum(p * F.log2(p / m) + F.when(q > 0, q * F.log2(q / m)).otherwise(0.0)).alias("_own"), F.sum(q).alias("_had"))
    return parts.select(*keys, F.greatest(F.lit(0.0), (F.col("_own") + 1 - F.col("_had")) / 2).alias(name))


def mask_divergence(masks: DataFrame, *, load: str = "load_id") -> DataFrame:
    """How each load's masks of a column differ: load, column_name, divergence (from those of all loads) and from_previous (from
    those of the load before, in the order of their names; null for the first). Both are Jensen-Shannon divergences in bits, from 0
    (the same) to 1. Missing values are a mask of their own."""
    p = masks.select(F.col(load).alias("load"), "column_name", F.coalesce("mask", F.lit("")).alias("mask"), "rows", F.col("share").alias("p"))
    whole = p.groupBy("column_name", "mask").agg(F.sum("rows").alias("_n"))
    q = whole.join(whole.groupBy("column_name").agg(F.sum("_n").alias("_all")), "column_name").select("column_name", "mask", (F.col("_n") / F.col("_all")).alias("q"))
    from_all = _divergence(p.join(q, ["column_name", "mask"]), ["load", "column_name"], "divergence")
    names = p.select("load").distinct()
    before = names.withColumn("previous", F.lag("load").over(Window.orderBy("load")))  # a row per load
    previous = p.select(F.col("load").alias("previous"), "column_name", "mask", F.col("p").alias("q"))
    pairs = p.join(before, "load").join(previous, ["previous", "column_name", "mask"], "left").where("previous is not null")
    from_previous = _divergence(pairs, ["load", "column_name"], "from_previous")
    return from_all.alias("a").join(from_previous.alias("b"), F.expr("a.load <=> b.load and a.column_name = b.column_name"), "left").select(F.col("a.load").alias(load), "a.column_name", "divergence", "from_previous")
