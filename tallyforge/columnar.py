"""Vectorised access to the buffers of Arrow string columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

#: The characters Unicode calls white space, which "outer blanks" and "blank" mean throughout.
WHITE_SPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

#: Texts that only say there is no value, compared without case and outer blanks.
NO_VALUE = ("n/a", "na", "n.a.", "null", "nil", "none", "unknown", "not given", "not set", "not available", "not applicable", "not provided", "not known", "unspecified", "undefined", "missing", "empty", "blank", "tbd", "tba", "no value", "no data")
#: Marks that alone say the same, as a class of patterns.
MARKS = r"[-–—?._*#~/]"


def one_chunk(col: pa.Array | pa.ChunkedArray) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        return col.combine_chunks() if col.num_chunks != 1 else col.chunk(0)
    return col


def string_buffers(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, offsets, valid) of a string column. Row i is bytes[offsets[i]:offsets[i+1]]; null rows have length 0."""
    arr = one_chunk(col).cast(pa.large_string())
    n = len(arr)
    _, offs, data = arr.buffers()
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64), np.zeros(n, bool)
    offsets = np.frombuffer(offs, np.int64, count=arr.offset + n + 1)[arr.offset :]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    valid = np.ones(n, bool) if arr.null_count == 0 else np.asarray(arr.is_valid())
    lo, hi = int(offsets[0]), int(offsets[-1])
    return raw[lo:hi], offsets - lo, valid


def from_buffers(raw: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """The string array of these bytes and offsets, without nulls."""
    return pa.LargeStringArray.from_buffers(
        len(offsets) - 1, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), pa.py_buffer(np.ascontiguousarray(raw))
    )


def padded(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray, width: int) -> np.ndarray:
    """Rows of the given slices as a matrix of bytes, filled with zeros to width; longer slices are cut."""
    at = starts[:, None] + np.arange(width)[None, :]
    inside = np.arange(width)[None, :] < lengths[:, None]
    if not len(raw):
        return np.zeros((len(starts), width), np.uint8)
    return np.where(inside, raw[np.minimum(at, len(raw) - 1)], 0).astype(np.uint8)


def fixed_bytes(col: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A string column as numpy's fixed-width bytes, which compare and search in byte order. Null becomes empty."""
    raw, offsets, _ = string_buffers(col)
    m = np.ascontiguousarray(padded(raw, offsets[:-1], np.diff(offsets), width))
    return m.view(f"S{width}").ravel() if len(m) else np.zeros(0, f"S{width}")


def spread(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these lengths laid end to end: the group of each place, and its position in the group."""
    group = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    return group, np.arange(len(group)) - first[group]
