"""Filling containers of fixed capacity with items by a grouping genetic algorithm, distributed as islands.

Items fall at random into neighbourhoods of a bounded size. Every neighbourhood is bred by several islands: populations of
its packings that evolve apart, in different tasks, and between epochs hand their elite to the next island of the ring.
A child is made by injecting whole well-filled containers of one parent into the other, dropping the containers that now
hold an item twice, and best-fitting the displaced items. Of each neighbourhood the best packing counts. The containers
that are still not full are then dissolved, and their items bred again in fewer neighbourhoods, until one is left.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.session import arrow_map, checkpointed, release, shuffle_width


@dataclass(frozen=True)
class Breeding:
    """neighbourhood: items that are packed together; slack: room, as a share of the capacity, with which a container still
    counts as full and isn't dissolved; levels: most rounds of dissolving."""

    neighbourhood: int = 1500
    islands: int = 3
    population: int = 6
    epochs: int = 3
    children: int = 40
    slack: float = 0.0003
    levels: int = 6


_SHIFT = 21


class Packing:
    """Items of one neighbourhood and the operations on packings of them. A packing is an array: container of each item."""

    def __init__(self, sizes: np.ndarray, capacity: int, seed: int):
        self.sizes, self.capacity = sizes.astype(np.int64), capacity
        self.rng = np.random.default_rng(seed)
        self.bound = -(-int(self.sizes.sum()) // capacity)
        self._size_list = self.sizes.tolist()

    def fills(self, a: np.ndarray) -> np.ndarray:
        return np.bincount(a, weights=self.sizes).astype(np.int64)

    def cost(self, a: np.ndarray) -> float:
        """Containers, less the mean square of their fill: of two packings of as many containers, the one that leaves its room
        in fewer of them is better."""
        f = self.fills(a) / self.capacity
        return len(f) - float((f * f).mean()) if len(f) else 0.0

    def fit(self, a: np.ndarray, fills: list[int], items: list[int]) -> None:
        """Put items, in their order, each into the fullest container with room for it, or a new one."""
        c, s = self.capacity, self._size_list
        room = sorted(((c - f) << _SHIFT) | i for i, f in enumerate(fills) if f < c)
        for i in items:
            k = bisect_left(room, s[i] << _SHIFT)
            if k == len(room):
                bin_, free = len(fills), c
                fills.append(0)
            else:
                code = room.pop(k)
                bin_, free = code & ((1 << _SHIFT) - 1), code >> _SHIFT
            a[i] = bin_
            fills[bin_] += s[i]
            if free > s[i]:
                insort(room, ((free - s[i]) << _SHIFT) | bin_)

    def fresh(self, noise: float) -> np.ndarray:
        """Best fit of the items by size, largest first; noise shuffles their order a little."""
        key = self.sizes * (1 + noise * self.rng.standard_normal(len(self.sizes)))
        a = np.zeros(len(self.sizes), np.int64)
        self.fit(a, [], np.argsort(-key, kind="stable").tolist())
        return a

    def _compact(self, a: np.ndarray, drop: np.ndarray) -> tuple[np.ndarray, list[int], list[int]]:
        """Renumber the containers without those dropped: packing, fills, displaced items (largest first)."""
        gone = drop[a]
        keep = np.flatnonzero(~drop)
        number = np.full(len(drop), -1)
        number[keep] = np.arange(len(keep))
        b = np.where(gone, -1, number[a])
        fills = np.bincount(b[~gone], weights=self.sizes[~gone], minlength=len(keep)).astype(np.int64)
        out = np.flatnonzero(gone)
        return b, fills.tolist(), out[np.argsort(-self.sizes[out], kind="stable")].tolist()

    def cross(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """A child of a with well-filled containers of b."""
        fb = self.fills(b)
        n = len(fb)
        order = np.argsort(-fb, kind="stable")
        width = max(1, int(n * self.rng.uniform(0.05, 0.35)))
        pick = np.zeros(n, bool)
        pick[order[self.rng.integers(0, max(1, n // 2)) :][:width]] = True
        injected = pick[b]
        twice = np.zeros(int(a.max()) + 1, bool)
        twice[a[injected]] = True
        child, fills, displaced = self._compact(a, twice)
        number = np.full(n, -1)
        own = np.flatnonzero(pick)
        number[own] = len(fills) + np.arange(len(own))
        child[injected] = number[b[injected]]
        fills += fb[own].tolist()
        inside = set(np.flatnonzero(injected).tolist())
        self.fit(child, fills, [i for i in displaced if i not in inside])
        return child

    def mutate(self, a: np.ndarray) -> np.ndarray:
        """Dissolve the emptiest containers and a few others, and fit their items anew."""
        f = self.fills(a)
        n = len(f)
        drop = np.zeros(n, bool)
        drop[np.argsort(f, kind="stable")[: max(1, n // 50)]] = True
        drop[self.rng.integers(0, n, max(1, n // 25))] = True
        b, fills, displaced = self._compact(a, drop)
        order = self.rng.random(len(displaced)) * 0.3 + np.linspace(0, 1, len(displaced))
        self.fit(b, fills, [displaced[i] for i in np.argsort(order, kind="stable")])
        return b

    def evolve(self, population: list[np.ndarray], children: int) -> list[np.ndarray]:
        """Breed children, each taking the place of the worst; ends early when a packing needs no more than must be."""
        if not len(self.sizes):
            return population
        scored = sorted(((self.cost(a), i, a) for i, a in enumerate(population)), key=lambda x: x[:2])
        for k in range(children):
            if len(self.fills(scored[0][2])) <= self.bound and k >= len(scored):
                break
            i, j = self.rng.integers(0, len(scored), 2)
            p, q = scored[min(i, j)][2], scored[self.rng.integers(0, len(scored))][2]
            child = self.cross(p, q)
            if self.rng.random() < 0.3:
                child = self.mutate(child)
            c = self.cost(child)
            if c < scored[-1][0] and all(abs(c - x[0]) > 1e-12 for x in scored):
                scored[-1] = (c, len(population) + k, child)
                scored.sort(key=lambda x: x[:2])
        return [a for _, _, a in scored]


_STATE = "nb bigint, island int, ids array<bigint>, pieces array<int>, sizes array<int>, pop array<array<int>>, cost double"


def _epoch(capacity: int, b: Breeding, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("nb", pa.int64()), ("island", pa.int32()), ("ids", pa.list_(pa.int64())), ("pieces", pa.list_(pa.int32())), ("sizes", pa.list_(pa.int32())), ("pop", pa.list_(pa.list_(pa.int32()))), ("cost", pa.float64())])
        for batch in batches:
            for k in range(batch.num_rows):
                nb, island = batch["nb"][k].as_py(), batch["island"][k].as_py()
                ids, pieces, sizes = batch["ids"][k].values, *(np.asarray(batch[c][k].values) for c in ("pieces", "sizes"))
                if epoch == 0:  # tasks may hand the items over in any order
                    order = np.lexsort((pieces, np.asarray(ids.fill_null(0)), -sizes))
                    ids, pieces, sizes = ids.take(pa.array(order)), pieces[order], sizes[order]
                p = Packing(sizes, capacity, seed=(nb * 1009 + island) * 31 + epoch)
                if epoch == 0:
                    pop = [p.fresh(0.0 if i == 0 and island == 0 else 0.02 * (i + 1)) for i in range(b.population)]
                else:
                    pop = [np.asarray(x, np.int64) for x in batch["pop"][k].as_py()]
                pop = p.evolve(pop, b.children)
                row = {"nb": nb, "island": island, "ids": ids.to_pylist(), "pieces": pieces, "sizes": sizes, "pop": [x.astype(np.int32) for x in pop], "cost": p.cost(pop[0])}
                yield pa.RecordBatch.from_pylist([row], schema=schema)

    return run


def _breed(items: DataFrame, count: int, capacity: int, b: Breeding, salt: int) -> DataFrame:
    """nb, id, piece, size, bin, fill: the best packing of each neighbourhood of the items (id, piece, size)."""
    spark = items.sparkSession
    spread = -(-count // b.neighbourhood) or 1
    at = F.pmod(F.xxhash64("id", "piece", "size", "at", F.lit(salt)), F.lit(spread))
    state = items.groupBy(at.alias("nb")).agg(F.collect_list(F.struct("id", "piece", "size")).alias("x"))
    state = state.select("nb", F.explode(F.sequence(F.lit(0), F.lit(b.islands - 1))).alias("island"), F.col("x.id").alias("ids"), F.col("x.piece").alias("pieces"), F.col("x.size").alias("sizes"), F.lit(None).cast("array<array<int>>").alias("pop"), F.lit(None).cast("double").alias("cost"))
    width = max(1, min(shuffle_width(spark), spread * b.islands))
    for e in range(b.epochs):
        state = arrow_map(state.repartition(width, "nb", "island"), _epoch(capacity, b, e), _STATE)
        if e + 1 < b.epochs:  # one row per neighbourhood with its few islands; each gets the elite of the one before
            ring = state.groupBy("nb").agg(F.array_sort(F.collect_list(F.struct("island", "ids", "pieces", "sizes", "pop"))).alias("s"))
            state = ring.select("nb", "s", F.posexplode("s").alias("k", "own"))
            before = F.col("s")[F.pmod(F.col("k") - 1, F.size("s"))]["pop"][0]
            keep = F.slice(F.col("own.pop"), 1, b.population - 1)
            state = state.select("nb", F.col("k").alias("island"), "own.ids", "own.pieces", "own.sizes", F.concat(keep, F.array(before)).alias("pop"), F.lit(None).cast("double").alias("cost"))
    best = state.groupBy("nb").agg(F.min_by(F.struct("ids", "pieces", "sizes", F.col("pop")[0].alias("bins")), F.struct("cost", "island")).alias("x"))
    flat = best.select("nb", F.explode(F.arrays_zip("x.ids", "x.pieces", "x.sizes", "x.bins")).alias("r"))
    flat = flat.select("nb", F.col("r.ids").alias("id"), F.col("r.pieces").alias("piece"), F.col("r.sizes").alias("size"), F.col("r.bins").alias("bin"))
    fills = flat.groupBy("nb", "bin").agg(F.sum("size").alias("fill"), F.collect_list(F.struct("id", "piece", "size")).alias("held"))
    return fills.select("nb", "bin", "fill", F.explode("held").alias("h")).select("nb", "bin", "fill", "h.*")


def pack(df: DataFrame, *, item_id: str, size, capacity: int, breeding: Breeding = Breeding()) -> DataFrame:
    """Every item's containers: item_id, piece (from 0), size, container, fill (of the container).

    size is a Column of whole numbers; null counts as 0. An item of up to the capacity stays whole in one container. A larger
    one is divided: pieces of the whole capacity get a container each, what remains is packed like an item. Items of size 0
    take room in no container but still get one. Repeated rows are items of their own; ids may be null. No items give no
    rows. Only ids and sizes are shuffled; neighbourhoods, and so tasks, are bounded whatever the input.
    """
    c = int(capacity)
    measured = df.select(F.col(f"`{item_id}`").cast("bigint").alias("id"), F.coalesce(size.cast("bigint"), F.lit(0)).alias("n"), F.monotonically_increasing_id().alias("at"))
    whole = F.when(F.col("n") > c, F.floor(F.col("n") / c)).otherwise(0).cast("int")
    measured = measured.withColumn("full", whole)
    rest = measured.withColumn("size", (F.col("n") - F.col("full") * c).cast("int")).where("size > 0 or full = 0")
    rest = rest.select("id", F.col("full").alias("piece"), "size", "at")
    solid = measured.where("full > 0").select("id", F.explode(F.sequence(F.lit(0), F.col("full") - 1)).alias("piece"), "at")
    solid = solid.select("id", "piece", F.lit(c).alias("size"), F.concat_ws("-", F.lit("whole"), "at", "piece").alias("container"), F.lit(c).cast("bigint").alias("fill"))

    rest = first = checkpointed(rest)
    count, done = rest.count(), []
    for level in range(breeding.levels):
        packed = checkpointed(_breed(rest, count, c, breeding, level))
        if level == 0:
            release(first)
        last = level + 1 == breeding.levels or count <= breeding.neighbourhood
        named = packed.withColumn("container", F.concat_ws("-", F.lit(level), "nb", "bin"))
        done.append((named if last else named.where(F.col("fill") >= c * (1 - breeding.slack))).select("id", "piece", "size", "container", "fill"))
        if last:
            break
        rest = packed.where(F.col("fill") < c * (1 - breeding.slack)).select("id", "piece", "size", F.xxhash64("nb", "bin", "id", "piece").alias("at"))
        count = rest.count()
    out = solid
    for part in done:
        out = out.unionByName(part.withColumn("fill", F.col("fill").cast("bigint")))
    return out.withColumnRenamed("id", item_id)


def packing_summary(packed: DataFrame, capacity: int) -> DataFrame:
    """containers, the fewest there could be, and the share of room left."""
    bins = packed.groupBy("container").agg(F.sum("size").alias("fill"))
    s = bins.agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"))
    return s.select("containers", F.ceil(F.col("tokens") / capacity).alias("fewest"), F.when(F.col("containers") > 0, 1 - F.col("tokens") / (F.col("containers") * capacity)).otherwise(0.0).alias("room_left"))
