"""References to records that do not exist, at the time they refer to them.

Keys and times of parents and references are range-partitioned together, on (key, time), so that no key, however hot,
has to fit one task. Each range holds its parents as sorted arrays; batches of references are probed against them by
binary search. What a range needs to know of earlier ranges of the same key is a few numbers per range boundary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyforge.columnar import WHITE_SPACE, fixed_bytes
from tallyforge.session import arrow_map, checkpointed, shuffle_width

KEY_BYTES = 64
#: Rows sampled per range to place the boundaries. They decide how even the ranges are, never the result.
SAMPLED_PER_RANGE = 30
MAX_RANGES = 32768
#: There are more ranges than the session's shuffle partitions where a range would else get more rows than this.
ROWS_PER_RANGE = 2_000_000
NEVER = np.iinfo(np.int64).min
LOAD, DELETE, REFERENCE = 0, 1, 2


def normal_key(key: Column) -> Column:
    """Without outer blanks and case; null if nothing is left."""
    k = F.lower(F.btrim(key.cast("string"), F.lit(WHITE_SPACE)))
    return F.when(k != "", k)


def bounded_key(key: Column) -> Column:
    """The normalised key in at most KEY_BYTES bytes: long keys keep their beginning and a SHA-256 of the whole."""
    k = normal_key(key)
    long = (F.octet_length(k) > KEY_BYTES - 1) | k.contains("\x00")
    return F.when(long, F.concat(F.regexp_replace(F.substring(k, 1, 1), "\x00", ""), F.lit("\x7f"), F.substring(F.sha2(k, 256), 1, 56))).otherwise(k)


def _micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


class Bounds:
    """Boundaries of the ranges over (key, time). Range r holds what lies from boundary r-1 up to boundary r.

    A boundary may stand several times, where one (key, time) makes up more than a range: references equal to it are
    then spread over those ranges, parents equal to it go to the first.
    """

    def __init__(self, keys: np.ndarray, times: np.ndarray):
        order = np.lexsort((times, keys))
        self.keys, self.times = keys[order], times[order]
        self.names, self.at = np.unique(self.keys, return_inverse=True)
        self.clock = np.unique(self.times)
        self.code = self._code(self.at, self.times)

    @property
    def ranges(self) -> int:
        return len(self.keys) + 1

    def _code(self, at: np.ndarray, times: np.ndarray) -> np.ndarray:
        # between two boundary times lies an odd rank, on one an even rank
        left, right = np.searchsorted(self.clock, times, "left"), np.searchsorted(self.clock, times, "right")
        return at.astype(np.int64) * (2 * len(self.clock) + 2) + left + right

    def place(self, keys: np.ndarray, times: np.ndarray, tie: np.ndarray | None) -> np.ndarray:
        if not len(self.names):
            return np.zeros(len(keys), np.int32)
        at = np.searchsorted(self.names, keys, "left")
        known = self.names[np.minimum(at, len(self.names) - 1)] == keys
        code = np.where(known, self._code(at, times), at.astype(np.int64) * (2 * len(self.clock) + 2) - 1)
        low, high = np.searchsorted(self.code, code, "left"), np.searchsorted(self.code, code, "right")
        same = high - low
        if tie is None:
            return np.where(same > 0, low + 1, low).astype(np.int32)
        return np.where(same > 0, low + 1 + tie % np.maximum(same, 1), low).astype(np.int32)


def _estimated_rows(df: DataFrame) -> int:
    """A guess from the optimizer's statistics, at about 16 bytes a row."""
    return max(1, int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) // 16)


def _ranges(spark: SparkSession, rows: int) -> int:
    return min(MAX_RANGES, max(shuffle_width(spark), -(-rows // ROWS_PER_RANGE)))


def _sampled(rows: DataFrame, total: int | None = None) -> tuple[pa.Table, int, float]:
    """A sample of (k, t), the number of all rows, and the share that was drawn: in one reading, unless the guess at the number of
    rows, which decides on the share, was far off."""
    spark, guess = rows.sparkSession, total or _estimated_rows(rows)
    want = _ranges(spark, guess) * SAMPLED_PER_RANGE
    share, most = min(1.0, 1.2 * want / guess), 3 * want
    seen = Observation()
    t = rows.observe(seen, F.count(F.lit(1)).alias("n")).sample(fraction=share, seed=11).limit(most + 1).toArrow()
    if total is not None or (len(t) <= most and (share == 1.0 or len(t) >= want // 3)):
        return t.slice(0, most), total if total is not None else seen.get["n"], share
    return _sampled(rows, max(1, rows.count()))


def _sample_bounds(parts: list[tuple[pa.Table, int, float]], ranges: int) -> Bounds:
    """Boundaries from samples of several tables, each thinned to the share of the sparsest."""
    least, rng = min(share for _, _, share in parts), np.random.default_rng(11)
    t = pa.concat_tables([x if share <= least else x.take(pa.array(np.flatnonzero(rng.random(len(x)) < least / share))) for x, _, share in parts])
    keys, times = fixed_bytes(t["k"], KEY_BYTES), t["t"].to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((times, keys))
    picks = order[np.unique((np.arange(1, ranges) * len(order)) // ranges)] if len(order) else order
    return Bounds(keys[picks], times[picks])


def _placer(bounds: Bounds):
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tag = b["tag"].to_numpy(zero_copy_only=False)
            times = b["t"].to_numpy(zero_copy_only=False)
            keys = fixed_bytes(b["k"], KEY_BYTES)
            tie = b["id"].fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64) % np.uint64(1 << 31)
            spreads = bounds.place(keys, times, tie.astype(np.int64))
            pid = np.where(tag == REFERENCE, spreads, bounds.place(keys, times, None))
            yield pa.RecordBatch.from_arrays([pa.array(pid, pa.int32()), *b.columns], names=["pid", *b.schema.names])

    return place


def _edge_states(parents: DataFrame, bounds: Bounds) -> dict[str, np.ndarray]:
    """Per range, of the key at its lower boundary: last load and last deletion before the range; whether any load exists.

    Only rows of boundary keys count, and of these one row per key and range reaches the driver: twice the ranges at most.
    """
    n = bounds.ranges
    load, gone, exists = np.full(n, NEVER), np.full(n, NEVER), np.zeros(n, bool)
    if n == 1:
        return {"load": load, "gone": gone, "exists": exists}
    names = {k.decode("utf-8", "surrogateescape"): i for i, k in enumerate(bounds.names)}
    known = parents.sparkSession.createDataFrame(pa.table({"k": list(names)}))
    got = (
        parents.join(F.broadcast(known), "k", "left_semi")  # at most MAX_RANGES keys
        .groupBy("k", "pid")
        .agg(F.max(F.when(F.col("tag") == LOAD, F.col("t"))).alias("load"), F.max(F.when(F.col("tag") == DELETE, F.col("t"))).alias("gone"), F.max((F.col("tag") == LOAD).cast("int")).alias("any"))
        .toArrow()
        .to_pylist()
    )
    by: dict[int, list[tuple[int, dict]]] = {}
    for r in got:
        by.setdefault(names[r["k"]], []).append((r["pid"], r))
    # ranges of one key follow on each other, so the last events are carried along
    key, rows, i, any_load, last = -1, [], 0, False, {"load": NEVER, "gone": NEVER}
    for r in range(1, n):
        if bounds.at[r - 1] != key:
            key, i, last = bounds.at[r - 1], 0, {"load": NEVER, "gone": NEVER}
            rows = sorted(by.get(int(key), []), key=lambda x: x[0])
            any_load = any(x["any"] for _, x in rows)
        while i < len(rows) and rows[i][0] < r:
            for kind in last:
                if rows[i][1][kind] is not None:
                    last[kind] = max(last[kind], rows[i][1][kind])
            i += 1
        load[r], gone[r], exists[r] = last["load"], last["gone"], any_load
    return {"load": load, "gone": gone, "exists": exists}


class _Range:
    """The parents of one range as sorted arrays, and the probe."""

    def __init__(self, pid: int, keys: list[np.ndarray], times: list[np.ndarray], tags: list[np.ndarray], bounds: Bounds, edge: dict, upper: dict):
        self.edge = {k: v[pid] for k, v in edge.items()}
        self.edge_key = bounds.keys[pid - 1] if pid else None
        self.upper_key = bounds.keys[pid] if pid < len(bounds.keys) else None
        self.upper_exists = bool(upper["exists"][pid + 1]) if self.upper_key is not None else False
        k = np.concatenate(keys) if keys else np.zeros(0, f"S{KEY_BYTES}")
        t = np.concatenate(times) if times else np.zeros(0, np.int64)
        tag = np.concatenate(tags) if tags else np.zeros(0, np.int8)
        self.names, at = np.unique(k, return_inverse=True)
        self.clock = np.unique(t)
        code = at.astype(np.int64) * (len(self.clock) + 1) + np.searchsorted(self.clock, t)
        self.events = {}
        for kind in (LOAD, DELETE):
            own = code[tag == kind]
            order = np.argsort(own, kind="stable")
            self.events[kind] = own[order], t[tag == kind][order]
        self.loaded = np.zeros(len(self.names), bool)
        self.loaded[at[tag == LOAD]] = True

    def _last(self, kind: int, at: np.ndarray, known: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Time of the last event of the key up to the rank, else NEVER."""
        codes, times = self.events[kind]
        if not len(codes):
            return np.full(len(at), NEVER)
        base = at.astype(np.int64) * (len(self.clock) + 1)
        i = np.searchsorted(codes, base + rank, "left") - 1
        ok = known & (i >= 0)
        ok &= codes[np.maximum(i, 0)] >= base
        return np.where(ok, times[np.maximum(i, 0)], NEVER)

    def probe(self, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.names, keys, "left")
        known = np.zeros(len(keys), bool)
        if len(self.names):
            known = self.names[np.minimum(at, len(self.names) - 1)] == keys
        at = np.where(known, at, 0)
        rank = np.searchsorted(self.clock, times, "right")
        load, gone = self._last(LOAD, at, known, rank), self._last(DELETE, at, known, rank)
        exists = known & self.loaded[at] if len(self.names) else known
        if self.edge_key is not None:
            edge = keys == self.edge_key
            load = np.where(edge, np.maximum(load, self.edge["load"]), load)
            gone = np.where(edge, np.maximum(gone, self.edge["gone"]), gone)
            exists = exists | (edge & bool(self.edge["exists"]))
        if self.upper_key is not None:
            exists = exists | ((keys == self.upper_key) & self.upper_exists)
        return np.where(~exists, 1, np.where(load == NEVER, 2, np.where(gone > load, 3, 0)))


KINDS = np.array([None, "missing", "late", "deleted"], object)


def _prober(bounds: Bounds, edge: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid, held, ready = None, ([], [], []), None
        for b in batches:
            pids = b["pid"].to_numpy(zero_copy_only=False)
            tags = b["tag"].to_numpy(zero_copy_only=False)
            times = b["t"].to_numpy(zero_copy_only=False)
            keys = fixed_bytes(b["k"], KEY_BYTES)
            cuts = np.flatnonzero((np.diff(pids) != 0) | (np.diff(tags == REFERENCE) != 0)) + 1
            for lo, hi in zip([0, *cuts], [*cuts, len(pids)]):
                if lo == hi:
                    continue
                if pids[lo] != pid:
                    pid, held, ready = int(pids[lo]), ([], [], []), None
                if tags[lo] != REFERENCE:
                    for store, x in zip(held, (keys, times, tags)):
                        store.append(x[lo:hi].copy())
                    continue
                ready = ready or _Range(pid, *held, bounds, edge, edge)
                kind = ready.probe(keys[lo:hi], times[lo:hi])
                miss = np.flatnonzero(kind)
                if len(miss):
                    yield pa.RecordBatch.from_arrays(
                        [b["id"].slice(lo, hi - lo).take(pa.array(miss)), pa.array(KINDS[kind[miss]], pa.string()), pa.array(times[lo:hi][miss], pa.int64())], names=["id", "kind", "t"]
                    )

    return run


def orphan_references(
    refs: DataFrame, parents: DataFrame, deletions: DataFrame | None, *, ref_id: str, ref_key: str, ref_time: str, parent_key: str, parent_time: str, deletion_key: str | None = None, deletion_time: str | None = None
) -> DataFrame:
    """References whose key names no parent at their time: columns ref_id (bigint), kind, ref_time (timestamp).

    kind is ``missing`` if no parent row has the key at all; else ``late`` if none had come by the reference's time; else
    ``deleted`` if the last deletion by then is later than the last arrival by then. Keys are compared without outer blanks
    and case. References with a null or blank key are no cases. A reference without a time is ``missing`` or ``late``:
    nothing had come by an unknown time. Parents without a key, and deletions without key or time, say nothing; a parent
    without a time exists but had come by no time. Repeated rows are judged one by one; ties of a deletion and an arrival
    count for the arrival. Empty tables are allowed. Other columns are not read, so their names can't clash.

    One shuffle of (key, time, id); parents are reduced to their distinct (key, time) before it, and kept so in the checkpoint
    folder. Parents are read once, references twice: for a sample, which also counts them, and to be judged.
    """
    spark = refs.sparkSession

    def side(df: DataFrame, key: str, time: str, tag: int, ident: Column) -> DataFrame:
        return df.select(F.lit(tag).cast("tinyint").alias("tag"), bounded_key(F.col(f"`{key}`")).alias("k"), F.coalesce(_micros(F.col(f"`{time}`")), F.lit(int(NEVER + 1) if tag == REFERENCE else int(np.iinfo(np.int64).max))).alias("t"), ident.alias("id")).where("k is not null")

    owners = side(parents, parent_key, parent_time, LOAD, F.lit(None).cast("bigint"))
    if deletions is not None:
        gone = deletions.where(F.col(f"`{deletion_time}`").isNotNull())
        owners = owners.unionByName(side(gone, deletion_key, deletion_time, DELETE, F.lit(None).cast("bigint")))
    owners = checkpointed(owners.groupBy("tag", "k", "t").agg(F.lit(None).cast("bigint").alias("id")))
    children = side(refs, ref_key, ref_time, REFERENCE, F.col(f"`{ref_id}`").cast("bigint"))

    parts = [_sampled(owners.select("k", "t"), owners.count()), _sampled(children.select("k", "t"))]
    bounds = _sample_bounds(parts, _ranges(spark, sum(n for _, n, _ in parts)))
    shared = spark.sparkContext.broadcast(bounds)  # at most MAX_RANGES boundaries
    schema = "pid int, tag tinyint, k string, t bigint, id bigint"

    def placed(df: DataFrame) -> DataFrame:
        return arrow_map(df, lambda it: _placer(shared.value)(it), schema)

    edge = _edge_states(placed(owners), bounds)
    rows = (
        placed(owners)
        .unionByName(placed(children))
        .repartitionById(bounds.ranges, F.col("pid"))
        .sortWithinPartitions("pid", "tag")
    )
    out = arrow_map(rows, lambda it: _prober(shared.value, edge)(it), "id bigint, kind string, t bigint")
    return out.select(F.col("id").alias(ref_id), "kind", F.when(F.col("t") != int(NEVER + 1), F.timestamp_micros("t")).alias(ref_time))


def orphan_counts(orphans: DataFrame, *, table: str, time: str) -> DataFrame:
    """Orphans per referring table and month of their time: child_table, month (yyyy-MM, null without a time), kind, n."""
    return orphans.groupBy(F.date_format(F.col(f"`{time}`"), "yyyy-MM").alias("month"), "kind").agg(F.count(F.lit(1)).alias("n")).select(F.lit(table).alias("child_table"), "month", "kind", "n")
