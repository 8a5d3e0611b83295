"""Several values packed into one text field, split into one row per value with its place.

A batch is handled as one run of bytes. Quote parity tells which bytes stand inside quotes, a table of byte classes which
are delimiters; delimiters outside quotes cut the cells. The resulting child offsets build list arrays, which are
flattened with their parents' ordinals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.columnar import MARKS, NO_VALUE, WHITE_SPACE, from_buffers, one_chunk, spread, string_buffers
from tallyforge.session import arrow_map

#: Bytes that separate values. Letters, digits, blanks, &, - and ' never do.
SEPARATORS = ",;|/\t\n\r\x0b\x0c"
_QUOTE, _BACKSLASH = ord('"'), ord("\\")
_AROUND = {ord("["): ord("]"), ord("{"): ord("}"), ord("("): ord(")")}


def _trimmed(col: pa.Array) -> pa.Array:
    return pc.utf8_trim(col, characters=WHITE_SPACE)


def _table(chars: str) -> np.ndarray:
    t = np.zeros(256, bool)
    t[np.frombuffer(chars.encode(), np.uint8)] = True
    return t


def _runs_before(flag: np.ndarray) -> np.ndarray:
    """At each place, how many flagged places stand directly before it, without a gap."""
    n = np.arange(len(flag))
    last = np.maximum.accumulate(np.where(~flag, n, -1)) if len(flag) else n
    own = n - last
    return np.concatenate(([0], own[:-1])) if len(flag) else own


class Splitter:
    """Splits a batch of cells. Returns list offsets per cell and the flat values."""

    def __init__(self, separators: str = SEPARATORS, no_value: tuple[str, ...] = NO_VALUE):
        if any(c.isalnum() or c in " &-'\"\\" or ord(c) > 127 for c in separators):
            raise ValueError("separators are ASCII characters that are no letters, digits, blanks, quotes, &, - or '")
        self.separator = _table(separators)
        self.no_value = pa.array(no_value)

    def _cells(self, col: pa.Array) -> pa.Array:
        """Without outer blanks and the brackets or braces around the whole cell; empty where it holds no value."""
        cells = _trimmed(pc.fill_null(one_chunk(col).cast(pa.large_string()), ""))
        raw, offsets, _ = string_buffers(cells)
        size = np.diff(offsets)
        wide = size >= 2
        first = np.where(wide, raw[np.minimum(offsets[:-1], max(len(raw) - 1, 0))], 0) if len(raw) else np.zeros(len(size), np.uint8)
        last = np.where(wide, raw[np.maximum(offsets[1:] - 1, 0)], 0) if len(raw) else first
        around = np.zeros(len(size), bool)
        for a, b in _AROUND.items():
            around |= (first == a) & (last == b)
        if around.any():
            keep = np.ones(len(raw), bool)
            keep[offsets[:-1][around]] = False
            keep[offsets[1:][around] - 1] = False
            cells = _trimmed(from_buffers(raw[keep], np.concatenate(([0], np.cumsum(size - 2 * around)))))
        nothing = pc.is_in(pc.utf8_lower(cells), value_set=self.no_value.cast(cells.type))
        marks = pc.match_substring_regex(cells, rf"\A{MARKS}+\z")
        return pc.if_else(pc.or_(nothing, marks), pa.scalar("", cells.type), cells)

    def __call__(self, col: pa.Array) -> pa.LargeListArray:
        cells = self._cells(col)
        raw, offsets, _ = string_buffers(cells)
        n = len(cells)
        owner, _ = spread(np.diff(offsets))
        # parity of quotes that aren't escaped by an odd run of backslashes
        slash = raw == _BACKSLASH
        starts = np.zeros(len(raw), bool)
        starts[offsets[:-1][np.diff(offsets) > 0]] = True
        runs = _runs_before(slash)
        quote = (raw == _QUOTE) & ((runs % 2 == 0) | starts)
        count = np.cumsum(quote)
        before = np.concatenate(([0], count))[offsets[:-1]]
        inside = (count - before[owner]) % 2 == 1
        cut = self.separator[raw] & ~inside
        # a cell whose quotes never close has no quoted values: its quotes are ordinary
        odd = np.concatenate(([0], count))[offsets[1:]] - before
        open_ended = (odd % 2 == 1)[owner] if len(raw) else np.zeros(0, bool)
        cut |= self.separator[raw] & open_ended

        at = np.flatnonzero(cut)
        pieces = np.bincount(owner[at], minlength=n) + 1 if len(raw) else np.ones(n, np.int64)
        parent, _ = spread(pieces)
        begin = np.concatenate((offsets[:-1], at + 1))
        end = np.concatenate((at, offsets[1:]))
        begin, end = np.sort(begin, kind="stable"), np.sort(end, kind="stable")
        # a cell's pieces are contiguous, so the sorted ends and begins pair up
        pick, step = spread(end - begin)
        flat = from_buffers(raw[begin[pick] + step], np.concatenate(([0], np.cumsum(end - begin))))
        items = self._values(_trimmed(flat))
        full = np.flatnonzero(np.asarray(pc.not_equal(pc.binary_length(items), 0)))
        sizes = np.bincount(parent[full], minlength=n)
        return pa.LargeListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int64()), items.take(pa.array(full)))

    @staticmethod
    def _values(items: pa.Array) -> pa.Array:
        """Enclosing quotes taken off, what is doubled or escaped inside them undone."""
        raw, offsets, _ = string_buffers(items)
        size = np.diff(offsets)
        if not len(raw):
            return items
        quoted = (size >= 2) & (raw[np.minimum(offsets[:-1], len(raw) - 1)] == _QUOTE) & (raw[np.maximum(offsets[1:] - 1, 0)] == _QUOTE)
        at = pa.array(np.flatnonzero(quoted))
        if not len(at):
            return items
        inner = pc.utf8_slice_codeunits(items.take(at), 1, -1)
        inner = pc.replace_substring(pc.replace_substring_regex(inner, r'\\(["\\/])', r"\1"), '""', '"')
        return pc.replace_with_mask(items, pa.array(quoted), _trimmed(inner))


def split_values(df: DataFrame, columns: list[str], *, row_id: str = "row_id", source: str = "", least: int = 1, separators: str = SEPARATORS) -> DataFrame:
    """One row per value: source_table, row_id, column_name, item_pos from 0, item; only of cells with at least ``least`` values.

    Separators may differ within a cell. A value in double quotes is one value whatever it holds; inside, a quote is doubled
    or escaped. Outer blanks, enclosing quotes, brackets or braces around the whole cell and empty values don't count. A
    cell that is null, blank, a mark, or a word for no value holds none. A quote that never closes is an ordinary character.
    Equal values stay; repeated rows come out repeated; other columns aren't read. No shuffle.
    """
    src = df.select(F.col(f"`{row_id}`").cast("bigint").alias("_id"), *(F.col(f"`{c}`").cast("string").alias(f"_v{i}") for i, c in enumerate(columns)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(separators)
        for b in batches:
            for i, name in enumerate(columns):
                lists = split(b[f"_v{i}"])
                sizes = np.diff(lists.offsets.to_numpy())
                parent, place = spread(sizes)
                keep = np.flatnonzero(sizes[parent] >= least)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([source] * len(keep), pa.string()), b["_id"].take(pa.array(parent[keep])), pa.array([name] * len(keep), pa.string()), pa.array(place[keep], pa.int32()), lists.values.take(pa.array(keep)).cast(pa.string())],
                    names=["source_table", "row_id", "column_name", "item_pos", "item"],
                )

    return arrow_map(src, run, "source_table string, row_id bigint, column_name string, item_pos int, item string")
