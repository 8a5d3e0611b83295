import math

from tallyforge.operators import profiling as P

SCHEMA = "load_id string, last_name string, height string, age bigint, zip string, column_name string, load string, n int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "c", "l", 1) for r in rows], SCHEMA)


def test_well_formed_and_missing(spark):
    names = {"Ann": 1, "van Dyk": 1, "O'Neil": 1, "A-B": 1, "Å̊ß": 1, "a  b": 0, "-a": 0, "a-": 0, "x1": 0, "<Ann>": 0, "A" * 200000: 1, "a-" * 100000: 0}
    zips = {"12345": 1, "12345-6789": 1, "1234": 0, "123456": 0, "12345-678": 0, "１２３４５": 0, "12345.0": 0}
    heights = {"20": 1, "100.00": 1, "19.99": 0, "-64": 0, "70.": 0, "NaN": 0, "70.123": 0}
    for column, cases in (("last_name", names), ("zip", zips), ("height", heights)):
        rule = next(r for r in P.CUSTOMER_RULES if r.column == column)
        df = spark.createDataFrame([(k,) for k in cases], "v string")
        got = {r.v: int(r.ok) for r in df.select("v", rule.well_formed(df.v, P.mask(df.v)).alias("ok")).collect()}
        assert got == cases
    blank = ["", None, "n/a", "N/A", "None", "UNKNOWN", "not given", "-", "?", "--"]
    df = spark.createDataFrame([(k,) for k in [*blank, "x", "0", "Nan"]], "v string")
    assert [r.v for r in df.where(P.is_missing(df.v)).collect()] == blank


def test_profile_and_departures(spark):
    rows = []
    for load in "abcd":
        for i in range(20):
            rows.append((load, f"Name{'x' * i}", "70", 30, f"{10000 + i}"))
    rows += [("e", None if i < 8 else f"N{'y' * i}", "tall" if i % 2 else "70.5", 60, "11111") for i in range(20)]
    rows += [(None, None, None, None, None)]
    prof = P.load_profile(frame(spark, rows), P.CUSTOMER_RULES)
    by = {(r.load_id, r.column_name): r for r in prof.collect()}
    assert by["e", "last_name"].missing == 8 and math.isclose(by["e", "last_name"].missing_share, 0.4)
    assert by["e", "height"].malformed == 10 and by["e", "height"].mean == 70.5
    assert by[None, "zip"].missing == 1 and by[None, "zip"].malformed_share is None and by[None, "zip"].mean is None
    got = {(r.load_id, r.column_name) for r in P.departing_loads(prof).collect()}
    assert got == {("e", "last_name"), ("e", "height"), ("e", "age"), ("e", "zip")} | {(None, c) for c in ("last_name", "height", "age", "zip")}


def test_empty_and_masks(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert P.load_profile(empty, P.CUSTOMER_RULES).collect() == []
    assert P.departing_loads(P.load_profile(empty, P.CUSTOMER_RULES)).collect() == []
    assert P.mask_divergence(P.mask_profile(empty, ["zip"])).collect() == []
    df = frame(spark, [("a", "x", "1", 1, "11111")] * 3 + [("b", "x", "1", 1, "abc")] * 3)
    masks = P.mask_profile(df, ["zip"])
    assert {(r.load_id, r.pattern, r.rows, r.share) for r in masks.collect()} == {("a", "9", 3, 1.0), ("b", "a", 3, 1.0)}
    # two loads without a pattern in common: each half of the whole
    want = 0.5 * math.log2(1 / 0.75) + 0.5 * (0.5 * math.log2(0.5 / 0.75) + 0.5)
    assert all(math.isclose(r.divergence, want) for r in P.mask_divergence(masks).collect())
    assert all(r.from_previous == (1.0 if r.load_id == "b" else None) for r in P.mask_divergence(masks).collect())
    assert P.rare_patterns(masks, cover=0.4).count() == 0  # as frequent as the last dominant one


def test_masks_keep_lengths(spark):
    zips = ["12345"] * 196 + ["1234", "123456789"] + ["12345-6789"] * 101 + ["12345-67"]
    heights = ["70.12"] * 298 + ["70.123", "70.12345"]
    rows = [("a", "x", h, 1, z) for z, h in zip(zips, heights, strict=True)] + [("b", "x", "70.12", 1, "1234")] * 300
    masks = P.mask_profile(frame(spark, rows), ["zip", "height"])
    one = {(r.column_name, r.mask): (r.pattern, r.rows) for r in masks.where("load_id = 'a'").collect()}
    assert one["zip", "99999"] == ("9", 196) and one["zip", "9999"] == ("9", 1) and one["zip", "99999-99"] == ("9-9", 1) and one["height", "99.99999"] == ("9.9", 1)
    rare = {(r.column_name, r.mask, r.rows) for r in P.rare_patterns(masks.where("mask not like '99999-9999'")).collect()}
    assert rare == {("zip", "999999999", 1), ("zip", "99999-99", 1), ("height", "99.999", 1), ("height", "99.99999", 1)}
    far = {(r.load_id, r.column_name): r.divergence for r in P.mask_divergence(masks).collect()}
    assert far["b", "zip"] > 0.3 and far["b", "height"] < 0.01
    # masks that differ only past the 200th character
    long = P.mask_profile(frame(spark, [("a", "x-" * 200 + end, "1", 1, "1") for end in ("a", "b", "1")]), ["last_name"])
    assert sorted(r.rows for r in long.collect()) == [1, 2]


def test_every_column_with_exact_range(spark, smallest):
    long = "a" * 150
    rows = [("a", long + "b", "9.5", 999, "1"), ("a", long + "c", "-12345", 12345, "n/a"), ("a", long + "c", "tall", -5, None)]
    rows += [("b", None, None, None, str(i)) for i in range(3000)]
    df = frame(spark, rows)
    prof = P.load_profile(df, P.CUSTOMER_RULES, columns=df.columns)
    by = {(r.load_id, r.column_name): r for r in prof.collect()}
    assert len(by) == 2 * len(df.columns)
    ranges = {c: (by["a", c].distinct_values, by["a", c].least, by["a", c].greatest) for c in ("last_name", "height", "age", "zip", "n", "load_id")}
    assert ranges == {"last_name": (2, long + "b", long + "c"), "height": (3, "-12345", "9.5"), "age": (3, "-5", "12345"), "zip": (1, "1", "1"), "n": (1, "1", "1"), "load_id": (1, "a", "a")}
    assert by["b", "age"].least is None and by["b", "zip"].distinct_values == 3000 and by["a", "n"].malformed is None and by["a", "age"].malformed == 3
    masks = {(r.load_id, r.column_name, r.mask): r for r in P.mask_profile(df, ["last_name", "age", "zip"]).collect()}
    assert masks["a", "last_name", "a" * 151].greatest == long + "c" and masks["b", "zip", "9999"].distinct_values == 2000 and masks["b", "age", None].distinct_values == 0
    below = {(r.load_id, r.column_name, r.mask): r for r in P.mask_profile(frame(spark, [("a", "x", "1", v, "1") for v in (-10, -99)]), ["age"]).collect()}
    assert (below["a", "age", "-99"].least, below["a", "age", "-99"].greatest) == ("-99", "-10")


def test_registered_profile_against_plain_aggregates(spark, smallest):
    from pyspark.sql import functions as F

    from tallyforge.queries import problems
    from tallyforge.session import table

    customers = table(spark, smallest, "customers_qa")
    got = {(r.load_id, r.column_name): r for r in problems.p5_profile(spark, smallest).collect()}
    assert {c for _, c in got} == set(customers.columns)
    for c in ("row_id", "age", "numFamilyMembers", "rownum", "feed_id", "isActive", "loaded_at"):
        for r in customers.groupBy("load_id").agg(F.count_distinct(c).alias("d"), F.min(c).cast("string").alias("lo"), F.max(c).cast("string").alias("hi")).collect():
            assert (got[r.load_id, c].distinct_values, got[r.load_id, c].least, got[r.load_id, c].greatest) == (r.d, r.lo, r.hi)
