import pytest
from pyspark.sql import functions as F

from tallyforge.engine import Engine
from tallyforge.operators import relational as R


def test_top_n(spark):
    df = spark.createDataFrame([(v, ["x", v or "n"]) for v in ["b", "a", "a", "b", "c", None]], "v string, many array<string>")
    top = [tuple(r) for r in R.top_n(df, "v", 2).collect()]
    assert top == [("a", 2, 40.0), ("b", 2, 40.0), ("OTHER:", 1, 20.0), ("TOTAL:", 5, 100.0)]
    assert [r[0] for r in R.top_n(df, "v").collect()] == ["a", "b", "c", "TOTAL:"]
    assert [tuple(r)[:2] for r in R.top_n(df, "many", 1).collect()] == [("x", 6), ("OTHER:", 6), ("TOTAL:", 12)]
    assert [tuple(r) for r in R.top_n(df.limit(0), "v", 3).collect()] == [("TOTAL:", 0, 0.0)]


def test_joins(spark):
    child = spark.createDataFrame([(1, "a"), (2, "b"), (3, None), (4, "z")], "id int, p string")
    parent = spark.createDataFrame([("a", 10), ("b", 20), ("c", 30)], "k string, n int")
    ids = lambda how: sorted(r.id for r in R.fk_join(child, parent, "p", "k", how).collect())
    assert (ids("inner"), ids("outer"), ids("semi"), ids("anti")) == ([1, 2], [1, 2, 3, 4], [1, 2], [3, 4])
    assert sorted(map(tuple, R.child_counts(child.union(child), "p").collect())) == [("a", 2), ("b", 2), ("z", 2)]
    with pytest.raises(ValueError):
        R.fk_join(child, parent, "p", "k", "cross")


def test_upsert_and_children(spark):
    old = spark.createDataFrame([(1, "a"), (None, "n")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "d"), (None, "m")], "k int, v string").coalesce(1)
    assert sorted(map(tuple, R.upsert(old, new, ["k"]).collect()), key=str) == sorted([(1, "b"), (2, "d"), (None, "m")], key=str)
    nested = spark.createDataFrame([(1, [("x", 1), ("y", 2)]), (2, []), (3, None)], "id int, items array<struct<name:string,n:int>>")
    assert sorted(map(tuple, R.explode_children(nested, "id", "items").collect())) == [(1, 0, "x", 1), (1, 1, "y", 2)]
    deep = spark.createDataFrame([('{"a":{"b":[5,{"c":"x"}]}}',), (None,), ("no json",)], "j string")
    assert [r[0] for r in deep.select(R.at_path(F.col("j"), "/a/b/1/c")).collect()] == ["x", None, None]


def test_sample_keeps_shares(spark):
    df = spark.range(40000).select("id", F.when(F.col("id") % 4 == 0, "a").when(F.col("id") % 4 == 1, "b").alias("s"))
    got = {r.s: r.n for r in R.stratified_sample(df, F.col("s"), 10).groupBy("s").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(abs(got[s] / n - 0.1) < 0.02 for s, n in (("a", 10000), ("b", 10000), (None, 20000)))
    assert R.stratified_sample(df, F.col("s"), 0).count() == 0 and R.stratified_sample(df, F.col("s"), 100).count() == 40000


def test_algebra(spark):
    df = spark.range(12)
    c = F.col("id")
    assert [r.id for r in df.where(R.bitmap_algebra([c < 3, c > 9], [c != 1], [c == 11, F.lit(None).cast("boolean")])).collect()] == [0, 2, 10]
    assert df.where(R.bitmap_algebra([], [], [])).count() == 12


def test_compat_average_is_cut_exactly(spark):
    """No value of two decimals is cut one too low."""
    e = Engine(spark, compat=True)
    df = spark.range(1, 2000).selectExpr("id", "cast(id / 100 as decimal(18,2)) as v", "explode(array(1, 2, 3)) as copy")
    e.register("t", df)
    assert e.sql("select id, avg(v) as a from t group by id").where("cast(a * 100 as decimal(18,4)) <> id").count() == 0
    e.register("u", spark.sql("select cast(v as decimal(18,2)) as v, k from values (0.01, 1), (0.02, 1), (-0.01, 2), (-0.02, 2), (null, 3) as x(v, k)"))
    assert sorted(map(tuple, e.sql("select k, avg(v) as a from u group by k").collect())) == [(1, 0.01), (2, -0.01), (3, 0.0)]
    e.register("w", spark.range(1).selectExpr("cast(0.123456789012345678 as decimal(18,18)) as v"))
    assert e.sql("select avg(v) as a from w").first().a == 0.123456789012345678
