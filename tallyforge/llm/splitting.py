"""Cutting oversized texts into pieces under a limit, at natural boundaries where there are any, with an overlap.

Texts are handled as ranges of bytes, be they rows of a table or files of any size. Workers detect the boundaries in each
range, with a halo of the bytes behind it, so that one that straddles an edge is seen whole; the boundary tables of the ranges
are stitched together, and pieces are emitted by their offsets.

Of a file no task ever holds more than a range. Where a range's first piece begins hangs on all ranges before it; so each range
works out, for every place its first piece can begin at, where the first piece of the next range then begins and how many
pieces lie between. These tables are put together by a prefix scan - blocks of ranges, blocks of blocks - and the sums of
their lengths give every range the place and number of its first piece, all ranges at once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.columnar import from_buffers, one_chunk, spread, string_buffers
from tallyforge.session import arrow_map, checkpointed, release, shuffle_width

#: Bytes in which boundaries are looked for at once.
RANGE_BYTES = 1 << 20
#: Bytes of a file that a task takes at once.
FILE_RANGE_BYTES = 8 << 20
#: Bytes behind a range that are seen with it: no sign of a boundary is longer.
HALO = 64
#: Ranges, or blocks of them, in a block of the prefix scan.
BLOCK = 64
#: Bytes of texts cut at once.
_BATCH_BYTES = 4 << 20

#: Kinds of boundaries, the strongest last. Each is the place where a new part begins.
LINE, PARAGRAPH, HUNK, FILE = 1, 2, 3, 4
#: What a line begins with that opens a file's diff.
_FILE_SIGNS = (b"diff --git ", b"diff --cc ", b"Index: ")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 11, 12, 13, 32]] = True
_HEX, _DIGIT = (np.isin(np.arange(256), np.frombuffer(x, np.uint8)) for x in (b"0123456789abcdef", b"0123456789"))


def _begins(raw: np.ndarray, at: np.ndarray, sign: bytes) -> np.ndarray:
    """Which of these places the sign stands at."""
    ok = at + len(sign) <= len(raw)
    for k, byte in enumerate(sign):
        ok[ok] = raw[at[ok] + k] == byte
    return ok


def boundaries(raw: np.ndarray, edges: np.ndarray, open_line: Callable[[], bool] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places in the bytes where a line begins, and their kinds.

    edges: where texts begin in raw. A first line that began before raw, as edges[0] < 0 says, counts as blank so far, and as
    coming after a line's end, if open_line says so.
    """
    breaks = np.flatnonzero(raw == 10)
    at = breaks + 1
    kinds = np.full(len(at), LINE, np.int8)
    if len(at):
        # a paragraph begins behind a line without anything but blanks
        before = np.concatenate(([-1], breaks[:-1]))
        solid = np.concatenate(([0], np.cumsum(~_BLANK[raw], dtype=np.int64)))
        blank = solid[breaks] == solid[before + 1]
        own = edges[np.maximum(np.searchsorted(edges, breaks, "right") - 1, 0)]
        blank &= before >= np.maximum(own, 0)
        if own[0] < 0 and open_line is not None and solid[breaks[0]] == 0:
            blank[0] = open_line()
        kinds[blank] = PARAGRAPH
        hunk = np.flatnonzero(_begins(raw, at, b"@@ -") & (at + 4 < len(raw)))
        kinds[hunk[_DIGIT[raw[at[hunk] + 4]]]] = HUNK
        for sign in _FILE_SIGNS:
            kinds[_begins(raw, at, sign)] = FILE
        mail = np.flatnonzero(_begins(raw, at, b"From ") & (at + 46 <= len(raw)))
        if len(mail):
            hashed = _HEX[raw[at[mail][:, None] + np.arange(5, 45)]].all(axis=1) & (raw[at[mail] + 45] == 32)
            kinds[mail[hashed]] = FILE
    inside = at < len(raw)
    return at[inside], kinds[inside]


def _open_line(backwards: Iterator[np.ndarray]) -> bool:
    """Whether the bytes before a place, handed over chunk by chunk from it back, are blank as far as a line's end."""
    for chunk in backwards:
        found = np.flatnonzero(~_BLANK[chunk])
        if len(found):
            return bool(chunk[found[-1]] == 10)
    return False


def ranged_boundaries(raw: np.ndarray, edges: np.ndarray, range_bytes: int) -> tuple[np.ndarray, np.ndarray]:
    """The boundary tables of the ranges of a run of texts, stitched together."""
    tables = []
    for lo in range(0, len(raw), range_bytes):
        hi = min(lo + range_bytes, len(raw))
        first = max(lo - 1, 0)  # a line that begins with the range ends before it
        i = np.searchsorted(edges, first, "right") - 1

        def back(first=first, begin=int(edges[i])):
            for end in range(first, begin, -4096):
                yield raw[max(begin, end - 4096) : end]

        places, kinds = boundaries(raw[first : hi + HALO], edges[i : np.searchsorted(edges, hi + HALO)] - first, lambda back=back: _open_line(back()))
        own = (places + first >= lo) & (places + first < hi)
        tables.append((places[own] + first, kinds[own]))
    return tuple(np.concatenate(x) for x in zip(*tables)) if tables else (np.zeros(0, np.int64), np.zeros(0, np.int8))


class Cuts:
    """Decides on cuts from a boundary table. Places are counted in the bytes raw."""

    def __init__(self, raw: np.ndarray, places: np.ndarray, kinds: np.ndarray, limit: int, overlap: int):
        self.raw, self.limit, self.overlap = raw, limit, overlap
        self.by_strength = [np.concatenate(([-1], places[kinds >= k])) for k in (FILE, HUNK, PARAGRAPH, LINE)]

    def _within(self, at: np.ndarray) -> np.ndarray:
        """Whether a place lies within a character."""
        inside = at < len(self.raw)
        inside[inside] = (self.raw[at[inside]] & 0xC0) == 0x80
        return inside

    def after(self, begin: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pieces that begin at these places, in texts that end at total: their ends, and where the next ones begin; that
        is the text's end behind a last piece.

        A piece ends at the last of the strongest boundaries in its second half; else in what the overlap leaves of the first;
        else at the last character that fits.
        """
        top, cut = begin + self.limit, np.full(len(begin), -1)
        for low in (begin + max(self.limit // 2, self.overlap), begin + self.overlap):
            for places in self.by_strength:
                p = places[np.searchsorted(places, top, "right") - 1]
                cut = np.where((cut < 0) & (p > low), p, cut)
        hard = np.flatnonzero((cut < 0) & (total - begin > self.limit))
        if len(hard):
            end = top[hard].copy()
            for _ in range(4):
                end -= self._within(end) & (end > top[hard] - 4)
            cut[hard] = np.where(self._within(end), top[hard], end)
        last = total - begin <= self.limit
        cut = np.where(last, total, cut)
        nxt = np.where(last, total, cut - self.overlap)
        while (more := (nxt < cut) & self._within(nxt)).any():
            nxt += more
        return cut, nxt

    def pieces(self, begin: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """All pieces of texts: text, number, begin, end; texts side by side, one piece of each at a time."""
        rows, out, number = np.arange(len(begin)), [], 0
        while len(rows):
            cut, nxt = self.after(begin, total)
            out.append((rows, np.full(len(rows), number), begin, cut))
            go = cut < total
            rows, begin, total, number = rows[go], nxt[go], total[go], number + 1
        row, number, begin, end = (np.concatenate(x) for x in zip(*out)) if out else [np.zeros(0, np.int64)] * 4
        order = np.lexsort((number, row))
        return row[order], number[order], begin[order], end[order]


def _check(limit: int, overlap: int) -> None:
    if not 0 <= overlap < limit - 4 or limit < 8:
        raise ValueError("the limit is 8 at least, and leaves room for more than a character besides the overlap")


def _slices(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """Batches of about _BATCH_BYTES of text, or of one text that has more."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + _BATCH_BYTES, "right")))
            yield b.slice(lo, hi - lo)
            lo = hi


def _texts(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> pa.Array:
    group, place = spread(end - begin)
    return from_buffers(raw[begin[group] + place], np.concatenate(([0], np.cumsum(end - begin))))


def _cut_rows(df: DataFrame, item_id: str, text: str, limit: int, overlap: int, range_bytes: int, name: str, emit: bool) -> DataFrame:
    _check(limit, overlap)
    src = df.where(F.octet_length(F.col(f"`{text}`")) > limit).select(F.col(f"`{item_id}`").cast("string").alias("_key"), F.col(f"`{text}`").cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, "_text"):
            raw, offsets, _ = string_buffers(b["_text"])
            cuts = Cuts(raw, *ranged_boundaries(raw, offsets[:-1], range_bytes), limit, overlap)
            row, number, begin, end = cuts.pieces(offsets[:-1].copy(), offsets[1:].copy())
            keys, own = one_chunk(b["_key"]), offsets[row]
            step = max(1, _BATCH_BYTES // limit)  # a giant text goes out in batches, too
            for lo in range(0, len(row), step):
                at = slice(lo, lo + step)
                columns = [keys.take(pa.array(row[at])), pa.array(number[at], pa.int32()), pa.array(begin[at] - own[at], pa.int64()), pa.array(end[at] - own[at], pa.int64())]
                names = [name, "piece", "begin", "end"]
                if emit:
                    columns.append(_texts(raw, begin[at], end[at]).cast(pa.string()))
                    names.append("text")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    return arrow_map(src, run, f"`{name}` string, piece int, begin bigint, end bigint" + (", text string" if emit else ""))


def split_plan(df: DataFrame, *, item_id: str, text: str, limit: int = 4096, overlap: int = 256, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Where oversized texts are cut: key (item_id as text), piece from 0, begin and end in bytes.

    Sizes are in tokens of a tokenizer with one token per UTF-8 byte. Texts up to the limit and null ones aren't cut and give no
    rows. Each piece but the last ends at the last boundary of the strongest kind in its second half - a file's diff, a hunk, a
    paragraph, a line - else at one before, else at a character's end, and the next begins with the last ``overlap`` tokens of
    it, fewer where a character would be cut. Every row is cut for itself: ids may be null or shared by several texts, and
    repeated rows come out repeated. Empty tables give no rows; other columns aren't read. No shuffle: a row's text is where its
    row is. The ranges only bound what is looked at together, never the cuts.
    """
    return _cut_rows(df, item_id, text, limit, overlap, range_bytes, "key", False)


def split_texts(df: DataFrame, *, item_id: str, text: str, limit: int = 4096, overlap: int = 256, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The pieces of oversized texts: item_id (as text), piece, begin, end, text. See split_plan."""
    return _cut_rows(df, item_id, text, limit, overlap, range_bytes, item_id, True)


# Files


class _FileRange:
    """A range of a file, from start up to stop, and what of it pieces need that begin there."""

    def __init__(self, path: str, total: int, start: int, range_bytes: int, limit: int, overlap: int):
        self.path, self.total, self.start, self.stop = path, total, start, min(start + range_bytes, total)
        self.first = max(start - 1, 0)
        with _opened(path) as f:
            f.seek(self.first)
            raw = np.frombuffer(f.read(min(self.stop + limit + HALO, total) - self.first), np.uint8)

            def back() -> Iterator[np.ndarray]:
                for end in range(self.first, 0, -(1 << 16)):
                    f.seek(max(0, end - (1 << 16)))
                    yield np.frombuffer(f.read(end - max(0, end - (1 << 16))), np.uint8)

            places, kinds = boundaries(raw, np.array([-self.first]), lambda: _open_line(back()))
        self.raw, self.cuts = raw, Cuts(raw, places, kinds, limit, overlap)

    def exits(self, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """For a first piece that begins 0, 1, ... limit-1 bytes behind the range's begin: how many bytes behind its end the next
        range's first piece begins, and the number of pieces that begin in the range."""
        end, total = self.stop - self.first, self.total - self.first
        begin = self.start - self.first + np.arange(limit)
        count, path = np.zeros(limit, np.int64), np.arange(limit)  # paths soon meet and go on as one
        at, taken, inverse = begin, count.copy(), path
        while (on := at < end).any():
            _, nxt = self.cuts.after(at[on], np.full(int(on.sum()), total))
            at, taken = at.copy(), taken + on
            at[on] = nxt
            if len(at) > 1:
                met, keep, back = np.unique(at, return_index=True, return_inverse=True)
                if len(met) < len(at):
                    count += taken[inverse]
                    inverse, at, taken = back[inverse], at[keep], np.zeros(len(met), np.int64)
        return (at[inverse] - end).astype(np.int32), (count + taken[inverse]).astype(np.int64)

    def pieces(self, entry: int) -> tuple[np.ndarray, np.ndarray]:
        """Begins and ends, in the file, of the pieces that begin in the range, the first of them entry bytes behind its begin."""
        at, begins, ends = self.start - self.first + entry, [], []
        total = np.array([self.total - self.first])
        while at < self.stop - self.first or (self.total == 0 and not begins):
            cut, nxt = self.cuts.after(np.array([at]), total)
            begins.append(at)
            ends.append(int(cut[0]))
            at = int(nxt[0])
        return np.array(begins, np.int64) + self.first, np.array(ends, np.int64) + self.first


def _opened(path: str):
    """A file of any file system that Arrow knows; a path without a scheme is a local one."""
    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


def _sizes(paths: list[str]) -> list[tuple[str, int]]:
    out = []
    for p in paths:
        with _opened(p) as f:
            out.append((p, f.size()))
    return out


_TABLE = "path string, seq bigint, exits binary, counts binary"
_TABLE_SCHEMA = pa.schema([("path", pa.string()), ("seq", pa.int64()), ("exits", pa.binary()), ("counts", pa.binary())])


def _in_blocks(df: DataFrame) -> DataFrame:
    return df.withColumn("block", F.floor(F.col("seq") / BLOCK)).repartition(shuffle_width(df.sparkSession), "path", "block").sortWithinPartitions("path", "block", "seq")


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        yield from b.to_pylist()


def _composed(tables: DataFrame) -> DataFrame:
    """The tables of blocks from those of the blocks' members."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(key, exits, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([{"path": key[0], "seq": key[1], "exits": exits.astype(np.int32).tobytes(), "counts": counts.tobytes()}], schema=_TABLE_SCHEMA)

        key, exits, counts = None, None, None
        for r in _rows(batches):
            own, more = np.frombuffer(r["exits"], np.int32), np.frombuffer(r["counts"], np.int64)
            if (r["path"], r["block"]) != key:
                if key is not None:
                    yield made(key, exits, counts)
                key, exits, counts = (r["path"], r["block"]), own, more
            else:
                exits, counts = own[exits], counts + more[exits]
        if key is not None:
            yield made(key, exits, counts)

    return arrow_map(_in_blocks(tables), run, _TABLE)


def _entries(tables: DataFrame, blocks: DataFrame) -> DataFrame:
    """path, seq, entry, number of the members of blocks, from those of the blocks."""
    known = blocks.select("path", F.col("seq").alias("block"), "entry", "number")
    members = tables.withColumn("block", F.floor(F.col("seq") / BLOCK)).join(known, ["path", "block"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, entry, number = None, 0, 0
        for b in batches:
            out = []
            for r in b.to_pylist():
                if (r["path"], r["block"]) != key:
                    key, entry, number = (r["path"], r["block"]), r["entry"], r["number"]
                out.append((entry, number))
                entry, number = int(np.frombuffer(r["exits"], np.int32)[entry]), number + int(np.frombuffer(r["counts"], np.int64)[entry])
            yield pa.RecordBatch.from_arrays([b["path"], b["seq"], pa.array([e for e, _ in out], pa.int32()), pa.array([n for _, n in out], pa.int64())], names=["path", "seq", "entry", "number"])

    return arrow_map(_in_blocks(members), run, "path string, seq bigint, entry int, number bigint")


def split_files(spark: SparkSession, paths: list[str], *, limit: int = 4096, overlap: int = 256, range_bytes: int = FILE_RANGE_BYTES) -> DataFrame:
    """The pieces of files that all workers can read, local or of a file system Arrow knows: path, piece, begin, end, text.

    Files up to the limit, empty ones too, give one piece of all they hold; a path named twice counts once. Bytes that are no UTF-8 come out as U+FFFD. The cuts
    are those of split_plan. A file is read twice, in ranges, by as many tasks as it has ranges; what is shuffled are the tables
    of its ranges, limit entries each. A line of blanks, however long, is followed back to its begin.
    """
    _check(limit, overlap)
    if range_bytes < 8:
        raise ValueError("a range has 8 bytes at least")
    sizes = _sizes(list(dict.fromkeys(paths)))
    files = spark.createDataFrame(sizes or [("", 0)], "path string, total bigint").where("path <> ''")
    last = F.greatest(F.floor((F.col("total") - 1) / range_bytes), F.lit(0))
    ranges = files.select("path", "total", F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("seq"))

    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            exits, counts = _FileRange(r["path"], r["total"], r["seq"] * range_bytes, range_bytes, limit, overlap).exits(limit)
            yield pa.RecordBatch.from_pylist([{"path": r["path"], "seq": r["seq"], "exits": exits.tobytes(), "counts": counts.tobytes()}], schema=_TABLE_SCHEMA)

    most = max((max(n - 1, 0) // range_bytes + 1 for _, n in sizes), default=1)
    width = max(1, min(shuffle_width(spark) * 8, sum(max(n - 1, 0) // range_bytes + 1 for _, n in sizes)))
    several = ranges.where(F.col("total") > range_bytes).repartition(width, "path", "seq")
    levels = []
    while most > 1:
        levels.append(checkpointed(_composed(levels[-1]) if levels else arrow_map(several, detect, _TABLE)))
        most = -(-most // BLOCK)
    state = files.select("path", F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("number"))
    for tables in reversed(levels):
        state = _entries(tables, state)
    if levels:
        state = checkpointed(state.unionByName(files.where(F.col("total") <= range_bytes).select("path", F.lit(0).cast("bigint").alias("seq"), F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("number"))))
        release(*levels)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            own = _FileRange(r["path"], r["total"], r["seq"] * range_bytes, range_bytes, limit, overlap)
            begin, end = own.pieces(r["entry"])
            texts = [own.raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(begin - own.first, end - own.first)]
            number = r["number"] + np.arange(len(begin))
            yield pa.RecordBatch.from_arrays([pa.array([r["path"]] * len(begin), pa.string()), pa.array(number, pa.int64()), pa.array(begin), pa.array(end), pa.array(texts, pa.string())], names=["path", "piece", "begin", "end", "text"])

    placed = state.join(files, "path").select("path", "total", "seq", "entry", "number").repartition(width, "path", "seq")
    return arrow_map(placed, emit, "path string, piece bigint, begin bigint, end bigint, text string")
