import random
from datetime import datetime, timedelta

import numpy as np
import pytest

from tallyforge.operators import orphans

T0 = datetime(2024, 1, 1)
REFS = "row_id bigint, cust_id string, t timestamp, kind string"
PARENTS = "cust_id string, loaded_at timestamp, row_id bigint, kind string"
GONE = "cust_id string, deleted_at timestamp, t timestamp"


def find(spark, refs, parents, gone):
    return orphans.orphan_references(
        spark.createDataFrame(refs, REFS), spark.createDataFrame(parents, PARENTS), None if gone is None else spark.createDataFrame(gone, GONE),
        ref_id="row_id", ref_key="cust_id", ref_time="t", parent_key="cust_id", parent_time="loaded_at", deletion_key="cust_id", deletion_time="deleted_at",
    )


def brute(refs, parents, gone):
    out = []
    norm = lambda k: (k or "").strip().lower()
    for i, key, t, _ in refs:
        if not norm(key):
            continue
        loads = [p[1] for p in parents if norm(p[0]) == norm(key)]
        had = [x for x in loads if x is not None and t is not None and x <= t]
        dels = [g[1] for g in gone if norm(g[0]) == norm(key) and g[1] is not None and t is not None and g[1] <= t]
        if not loads:
            out.append((i, "missing"))
        elif not had:
            out.append((i, "late"))
        elif dels and max(dels) > max(had):
            out.append((i, "deleted"))
    return sorted(out)


def at(m):
    return T0 + timedelta(minutes=m)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("ranges", [1, 7, 40])
def test_against_brute_force_with_hot_keys(spark, seed, ranges):
    r = random.Random(seed)
    keys = ["HOT"] * 20 + [f"K{i}" for i in range(15)] + [None, " ", "　", "x" * 300, "x" * 299 + "y", "a\x00", "a", "", "é"]
    spell = lambda k: k and r.choice([k, k.lower(), f" {k}\t"])
    time = lambda p=0.03: None if r.random() < p else at(r.randrange(60))
    parents = [(spell(r.choice(keys[:28] + ["x" * 300, None])), time(), 1, "z") for _ in range(120)]
    gone = [(spell(r.choice(keys)), time(), None) for _ in range(60)]
    refs = [(i, spell(r.choice(keys)), time(), "q") for i in range(400)]
    refs += [(900 + i, "hot", at(30), None) for i in range(150)]  # one key and time far beyond a range
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", str(ranges))
        got = find(spark, refs, parents, gone).select("row_id", "kind").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert sorted(map(tuple, got)) == brute(refs, parents, gone)


def test_ties_repeats_and_no_deletions(spark):
    refs = [(1, "a", at(5), ""), (1, "a", at(5), ""), (2, "A ", at(4), ""), (3, "b", None, "")]
    parents = [("a", at(5), 0, ""), ("b", None, 0, "")]
    assert brute(refs, parents, []) == [(2, "late"), (3, "late")]
    assert sorted((r.row_id, r.kind) for r in find(spark, refs, parents, None).collect()) == [(2, "late"), (3, "late")]
    gone = [("a", at(5), None)]  # no later than the arrival
    assert sorted((r.row_id, r.kind) for r in find(spark, refs, parents, gone).collect()) == [(2, "late"), (3, "late")]


def test_empty_tables(spark):
    assert find(spark, [], [("a", at(1), 0, "")], []).collect() == []
    assert find(spark, [], [], []).collect() == []
    assert [(r.row_id, r.kind) for r in find(spark, [(1, "a", at(1), "")], [], []).collect()] == [(1, "missing")]


def test_counts_by_month(spark):
    found = find(spark, [(1, "a", at(0), ""), (2, "b", at(60 * 24 * 40), ""), (3, "c", None, "")], [], [])
    rows = {tuple(r) for r in orphans.orphan_counts(found, table="orders", time="t").collect()}
    assert rows == {("orders", "2024-01", "missing", 1), ("orders", "2024-02", "missing", 1), ("orders", None, "missing", 1)}


def test_bounds_place_in_order():
    k = np.array([b"a", b"b", b"b", b"b", b"c"])
    b = orphans.Bounds(k, np.array([1, 5, 5, 7, 0]))
    keys, times = np.array([b"a", b"a", b"b", b"b", b"b", b"b", b"bb", b"c", b"z"]), np.array([0, 1, 4, 5, 6, 7, 9, 0, 0])
    assert b.place(keys, times, None).tolist() == [0, 1, 1, 2, 3, 4, 4, 5, 5]
    assert b.place(keys, times, np.ones(9, np.int64)).tolist() == [0, 1, 1, 3, 3, 4, 4, 5, 5]
