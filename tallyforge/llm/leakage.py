"""Evaluation texts that stand, whole or in part, in a corpus.

The n-grams of the evaluation items form a hash set that every task holds. Corpus texts are normalised into one run of
bytes a batch; the hashes of all their windows of n words come from a single prefix sum, are looked up in the set, and hits
are verified byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyforge.columnar import one_chunk, spread, string_buffers
from tallyforge.session import arrow_map

#: n-grams broadcast at once, at about 120 bytes each; a larger evaluation set is taken in blocks of as many.
MOST_NGRAMS = 2_000_000
#: Items are cut into segments of as many n-grams, so that no item, however long, outgrows a block.
SEGMENT_NGRAMS = 4096
#: Bytes of normalised text hashed at once.
_SPAN = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1


def normalise(texts: pa.Array) -> pa.Array:
    """Words - runs of letters and digits - in lower case, one blank between; null becomes empty."""
    t = pc.fill_null(one_chunk(texts).cast(pa.large_string()), "")
    return pc.utf8_lower(pc.utf8_trim(pc.replace_substring_regex(t, r"[^\pL\pN]+", " "), " "))


def word_places(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of texts without nulls: the words that normalise finds, all of them in order, by the characters where they begin and end;
    and how many words come before each text's."""
    t = pc.replace_substring_regex(one_chunk(texts).cast(pa.large_string()), "[\x01\x02]", " ")
    raw, offsets, _ = string_buffers(pc.replace_substring_regex(t, r"([\pL\pN]+)", "\x01\\1\x02"))
    opens, closes = raw == 1, raw == 2
    chars = np.concatenate(([0], np.cumsum(((raw & 0xC0) != 0x80) & ~opens & ~closes)))
    first, end = np.flatnonzero(opens), np.flatnonzero(closes)
    begin = chars[offsets[np.searchsorted(offsets, first, "right") - 1]]
    return chars[first] - begin, chars[end] - begin, np.searchsorted(first, offsets)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    out = []
    for x in (_BASE, pow(_BASE, -1, 1 << 64)):
        p = np.full(n, x, np.uint64)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


class Windows:
    """Windows of n words over a batch of normalised texts, in spans of bounded size."""

    def __init__(self, n: int):
        self.n = n
        self.power, self.inverse = _powers(64)

    def _grow(self, size: int) -> None:
        if size > len(self.power):
            self.power, self.inverse = _powers(max(size, 2 * len(self.power)))

    def of(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(text of each window, place of its first word in the text, first byte, end byte, hash), and the bytes are self.raw."""
        raw, offsets, _ = string_buffers(texts)
        self.raw = raw
        if not len(raw):
            return
        blank = raw == 32
        edge = np.zeros(len(raw) + 1, bool)
        edge[offsets] = True
        begins = ~blank & (np.concatenate(([True], blank[:-1])) | edge[:-1])
        ends = ~blank & (np.concatenate((blank[1:], [True])) | edge[1:])
        first, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        owner = np.searchsorted(offsets, first, "right") - 1
        words = np.bincount(owner, minlength=len(offsets) - 1)
        place = np.arange(len(first)) - np.concatenate(([0], np.cumsum(words)))[owner]
        at = np.flatnonzero(place + self.n <= words[owner])
        heads, lo = first[at], 0
        while lo < len(at):
            base = heads[lo]
            hi = max(lo + 1, int(np.searchsorted(heads, base + _SPAN, "left")))
            own = at[lo:hi]
            s, e = first[own] - base, end[own + self.n - 1] - base
            size = int(e[-1])
            self._grow(size + 1)
            total = np.zeros(size + 1, np.uint64)
            np.cumsum((raw[base : base + size].astype(np.uint64) + np.uint64(1)) * self.power[:size], out=total[1:])
            h = (total[e] - total[s]) * self.inverse[s]
            yield owner[own], place[own], s + base, e + base, h ^ (h >> np.uint64(29))
            lo = hi


class Ngrams:
    """The hash set: hashes in order, for each the bytes it stands for and the items that hold it."""

    def __init__(self, ids: list[int], texts: pa.Array, n: int):
        self.n = n
        w = Windows(n)
        normal = normalise(texts)
        parts = list(w.of(normal))
        raw = w.raw
        owner, _, s, e, h = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(5))
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner = h[order].astype(np.uint64), np.array(ids, np.int64)[owner[order].astype(np.int64)] if len(order) else np.zeros(0, np.int64)
        self.raw, self.start, self.end = raw, s[order].astype(np.int64), e[order].astype(np.int64)
        self.low = np.uint64((1 << max(16, (8 * len(self.hashes)).bit_length())) - 1)
        self.filter = np.zeros(int(self.low) + 1, bool)
        self.filter[(self.hashes & self.low).astype(np.int64)] = True

    def hits(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, place of the window's first word, item) of every verified hit."""
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        w = Windows(self.n)
        for owner, place, s, e, h in w.of(normalise(texts)):
            maybe = np.flatnonzero(self.filter[(h & self.low).astype(np.int64)])
            lo, hi = np.searchsorted(self.hashes, h[maybe], "left"), np.searchsorted(self.hashes, h[maybe], "right")
            group, step = spread(hi - lo)
            win, gram = maybe[group], (lo[group] + step).astype(np.int64)
            same = (e[win] - s[win]) == (self.end[gram] - self.start[gram])
            win, gram = win[same], gram[same]
            if len(win):
                size = e[win] - s[win]
                g, k = spread(size)
                differ = np.bincount(g, weights=w.raw[s[win][g] + k] != self.raw[self.start[gram][g] + k], minlength=len(win))
                win, gram = win[differ == 0], gram[differ == 0]
                out.append((owner[win], place[win], self.owner[gram]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate([x[i] for x in out]) for i in range(3))


def _segments(items: DataFrame, item_id: str, text: str, n: int) -> DataFrame:
    """item_id, text, grams: the items' normalised words in segments that hold each n-gram once; repeated items come once."""
    kept = items.select(F.col(f"`{item_id}`").cast("bigint").alias("item_id"), F.col(f"`{text}`").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    step = SEGMENT_NGRAMS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            normal = normalise(b["text"])
            first, end, upto = word_places(normal)
            ids, parts, grams = [], [], []
            for k, (i, t) in enumerate(zip(b["item_id"].to_pylist(), normal.to_pylist())):
                words = slice(upto[k], upto[k + 1])
                a, e = first[words], end[words]
                for lo in range(0, len(a) - n + 1, step):
                    hi = min(lo + step, len(a) - n + 1)
                    ids.append(i)
                    parts.append(t[a[lo] : e[hi + n - 2]])
                    grams.append(hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(parts, pa.string()), pa.array(grams, pa.int64())], names=["item_id", "text", "grams"])

    return arrow_map(kept, run, "item_id bigint, text string, grams bigint")


def _blocks(items: DataFrame, item_id: str, text: str, n: int) -> list[DataFrame]:
    """The items' segments in blocks whose n-grams fit a broadcast. A block is filled to a half by expectation, so that the chance
    of its being over-full is none to speak of."""
    segments = _segments(items, item_id, text, n)
    total = segments.agg(F.sum("grams")).first()[0] or 0
    if total <= MOST_NGRAMS:
        return [segments]
    k = int(2 * total // MOST_NGRAMS) + 1
    return [segments.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(k)) == i) for i in range(k)]


def _digest(text: Column) -> Column:
    """What rows of equal texts have in common, and so their leaks."""
    return F.sha2(text, 256)


def _scan(src: DataFrame, blocks: list[DataFrame], n: int, emit, schema: str) -> DataFrame:
    """One pass over src (key, text) for each block: emit(rows, text of each hit, place of its first word, item)."""
    out = None
    for block in blocks:
        got = block.toArrow()
        grams = src.sparkSession.sparkContext.broadcast(Ngrams(got["item_id"].to_pylist(), one_chunk(got["text"]), n))

        def run(batches: Iterator[pa.RecordBatch], grams=grams) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lo = 0
                while lo < b.num_rows:  # pieces of a batch with bounded text
                    sizes = np.cumsum(pc.fill_null(pc.binary_length(b["text"].slice(lo)), 0).to_numpy(zero_copy_only=False))
                    k = max(1, int(np.searchsorted(sizes, 4 * _SPAN, "right")))
                    s = b.slice(lo, k)
                    yield emit(s, *grams.value.hits(s["text"]))
                    lo += k

        found = arrow_map(src, run, schema)
        out = found if out is None else out.unionByName(found)
    return out


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("bigint").alias("key"), F.col(f"`{text}`").cast("string").alias("text"))


def _digested(docs: DataFrame, text: str) -> DataFrame:
    t = F.col(f"`{text}`").cast("string")
    return docs.select(_digest(t).alias("key"), t.alias("text")).where("text is not null")


def find_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 12) -> DataFrame:
    """doc_id, item_id: texts that hold at least n consecutive words of the item's, in order, no other word between.

    Words are unbroken runs of letters and digits, compared without case; all else is ignored. Items of fewer words, null or
    empty texts leak nothing. Each pair comes once per row of docs, so repeated rows come out repeated, also those without an id;
    repeated items count once; other columns aren't read. No shuffle, one pass over the corpus, while the items' n-grams are
    MOST_NGRAMS at most. A larger set takes a pass for each block of it, and what the passes find for a text meets at the text's
    digest; the pairs are the same.
    """
    blocks = _blocks(items, item_id, item_text, n)
    kind = "bigint" if len(blocks) == 1 else "string"

    def emit(b: pa.RecordBatch, owner: np.ndarray, place: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
        pairs = np.unique(np.stack([owner, item], 1), axis=0) if len(owner) else np.zeros((0, 2), np.int64)
        return pa.RecordBatch.from_arrays([b["key"].take(pa.array(pairs[:, 0], pa.int64())), pa.array(pairs[:, 1], pa.int64())], names=["key", "item_id"])

    if len(blocks) == 1:
        return _scan(_keyed(docs, doc_id, text), blocks, n, emit, f"key {kind}, item_id bigint").withColumnRenamed("key", "doc_id")
    found = _scan(_digested(docs, text), blocks, n, emit, f"key {kind}, item_id bigint").distinct()
    return _keyed(docs, doc_id, text).select(F.col("key").alias("doc_id"), _digest(F.col("text")).alias("key")).join(found, "key").select("doc_id", "item_id")


def _passages(b: pa.RecordBatch, owner: np.ndarray, place: np.ndarray, group: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, group, first and end character) of hits, windows of a row and group that share words joined."""
    if not len(owner):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    hits = np.unique(np.stack([owner, group, place], 1).astype(np.int64), axis=0)
    owner, group, place = hits.T
    same = (owner[1:] == owner[:-1]) & (group[1:] == group[:-1]) & (place[1:] < place[:-1] + n)
    begins, ends = np.concatenate(([True], ~same)), np.concatenate((~same, [True]))
    texts, at = np.unique(owner, return_inverse=True)
    first, end, upto = word_places(b["text"].take(pa.array(texts)))
    word = upto[at] + place
    return owner[begins], group[begins], first[word[begins]], end[word[ends] + n - 1]


def _joined(spans: DataFrame, *keys: str) -> DataFrame:
    """Spans of the keys, those that overlap joined."""
    before = Window.partitionBy(*keys).orderBy("first_char", "end_char").rowsBetween(Window.unboundedPreceding, -1)
    upto = before.rowsBetween(Window.unboundedPreceding, 0)
    fresh = F.coalesce(F.col("first_char") > F.max("end_char").over(before), F.lit(True)).cast("int")
    return spans.distinct().withColumn("_fresh", fresh).withColumn("_no", F.sum("_fresh").over(upto)).groupBy(*keys, "_no").agg(F.min("first_char").alias("first_char"), F.max("end_char").alias("end_char")).drop("_no")


def leaked_spans(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 12) -> DataFrame:
    """doc_id, item_id, first_char, end_char of each leaked passage, characters from 0; passages of an item don't overlap. What
    is said of rows, nulls and passes in find_leaks holds here too."""
    blocks = _blocks(items, item_id, item_text, n)

    def emit(b: pa.RecordBatch, owner: np.ndarray, place: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
        row, own, first, end = _passages(b, owner, place, item, n)
        return pa.RecordBatch.from_arrays([b["key"].take(pa.array(row)), pa.array(own), pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["key", "item_id", "first_char", "end_char"])

    schema = "item_id bigint, first_char int, end_char int"
    if len(blocks) == 1:
        return _scan(_keyed(docs, doc_id, text), blocks, n, emit, f"key bigint, {schema}").withColumnRenamed("key", "doc_id")
    found = _joined(_scan(_digested(docs, text), blocks, n, emit, f"key string, {schema}"), "key", "item_id")
    own = _keyed(docs, doc_id, text).select(F.col("key").alias("doc_id"), _digest(F.col("text")).alias("key"))
    return own.join(found, "key").select("doc_id", "item_id", "first_char", "end_char")


def _cut(text: str, spans: list[tuple[int, int]]) -> tuple[str, int]:
    """The text without these spans, given in order, and the number of characters taken out."""
    kept, last, removed = [], 0, 0
    for a, b in spans:
        a = max(a, last)
        if b > a:
            kept.append(text[last:a])
            removed += b - a
            last = b
    return "".join([*kept, text[last:]]), removed


def without_leaks(docs: DataFrame, items: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", n: int = 12, drop_documents: bool = False) -> DataFrame:
    """doc_id, text, removed_chars: every row's text without its leaked passages, or, with drop_documents, only the texts without
    any. Null texts stay null; repeated rows, also those without an id, are cut each for itself.

    No shuffle while the items' n-grams are MOST_NGRAMS at most; else the passages found in several passes meet at the digest of
    the text, a row's at that row, where they are fewer than its words.
    """
    blocks = _blocks(items, item_id, item_text, n)

    def emit(b: pa.RecordBatch, owner: np.ndarray, place: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
        texts, removed = b["text"], np.zeros(b.num_rows, np.int32)
        if len(owner):
            row, _, first, end = _passages(b, owner, place, np.zeros(len(owner), np.int64), n)
            texts = texts.to_pylist()
            for lo, hi in zip(*(np.searchsorted(row, np.unique(row), side) for side in ("left", "right"))):
                at = row[lo]
                texts[at], removed[at] = _cut(texts[at], list(zip(first[lo:hi].tolist(), end[lo:hi].tolist())))
            texts = pa.array(texts, pa.string())
        out = pa.RecordBatch.from_arrays([b["key"], texts, pa.array(removed)], names=["doc_id", "text", "removed_chars"])
        return out.filter(pa.array(removed == 0)) if drop_documents else out

    if len(blocks) == 1:
        return _scan(_keyed(docs, doc_id, text), blocks, n, emit, "doc_id bigint, text string, removed_chars int")

    def places(b: pa.RecordBatch, owner: np.ndarray, place: np.ndarray, item: np.ndarray) -> pa.RecordBatch:
        row, _, first, end = _passages(b, owner, place, np.zeros(len(owner), np.int64), n)
        return pa.RecordBatch.from_arrays([b["key"].take(pa.array(row)), pa.array(first, pa.int32()), pa.array(end, pa.int32())], names=["key", "first_char", "end_char"])

    found = _joined(_scan(_digested(docs, text), blocks, n, places, "key string, first_char int, end_char int"), "key")
    spans = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("first_char", "end_char"))).alias("s"))
    src = _keyed(docs, doc_id, text).withColumnRenamed("key", "doc_id").withColumn("key", _digest(F.col("text"))).join(spans, "key", "left").drop("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cut = [(t, 0) if s is None else _cut(t, [(x["first_char"], x["end_char"]) for x in s]) for t, s in zip(b["text"].to_pylist(), b["s"].to_pylist())]
            out = pa.RecordBatch.from_arrays([b["doc_id"], pa.array([t for t, _ in cut], pa.string()), pa.array([k for _, k in cut], pa.int32())], names=["doc_id", "text", "removed_chars"])
            yield out.filter(pc.equal(out["removed_chars"], 0)) if drop_documents else out

    return arrow_map(src, run, "doc_id bigint, text string, removed_chars int")
