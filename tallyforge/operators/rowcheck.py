"""Rows that fail to parse, kept with the reason and the first broken field, while the valid ones are loaded.

For every schema an anchored pattern of a whole valid record is generated. Records it does not match go through patterns of
growing prefixes - one field, two fields, and so on - whose first failure names the broken field. All patterns are run by
a linear-time matcher over Arrow buffers, so no record, however long or odd, can stall or overflow it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.columnar import WHITE_SPACE, from_buffers, spread, string_buffers
from tallyforge.session import arrow_map

#: White space as a class of the matcher (RE2) and of Java.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
#: What a good value of each judged kind is, if it isn't null or blank.
HEIGHT = r"-?[0-9]+(?:\.[0-9]{1,2})?"
ITEM_COUNT = r"[0-9]{1,18}"

_BARE = r'[^",\r\n]*'
_QUOTED = r'"(?:[^"]|"")*"'
_ANY = f"(?:{_BARE}|{_QUOTED})"
#: A field as far as its quotes go: a line break may stand outside them.
_LOOSE = f'(?:[^",]*|{_QUOTED})'
_END = r"(?:\r\n|\n|\r)?\z"
_JAVA_BLANK = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in WHITE_SPACE) + "]"
_SEPARATOR = r"\x00"


@dataclass(frozen=True)
class RowSchema:
    """Names of a record's fields, in order; kinds: the pattern of good values of the judged ones."""

    name: str
    fields: tuple[str, ...]
    kinds: tuple[tuple[str, str], ...] = ()

    def value(self, field: str) -> str:
        good = dict(self.kinds).get(field)
        if good is None:
            return _ANY
        # nothing in these patterns can hold a quote, so a quoted good value is the value in quotes
        blank = r"[ \t\x0b\x0c\x1c-\x1f\x{85}\p{Z}]*"
        return f'(?:{blank}|{good}|"(?:{_BLANK}*|{good})")'

    @property
    def whole(self) -> str:
        return rf"\A{','.join(self.value(f) for f in self.fields)}{_END}"

    @property
    def well_quoted(self) -> str:
        return rf"\A{_LOOSE}(?:,{_LOOSE})*{_END}"

    @property
    def unbroken(self) -> str:
        """No line break stands outside quotes, but for one at the end."""
        return rf"\A{_ANY}(?:,{_ANY})*{_END}"

    def prefix(self, k: int, how: str) -> str:
        """The first k fields, each complete: a comma or the record's end follows. how: what is asked of a field, its
        ``quotes``, its line ``breaks`` too, or a good ``value`` besides."""
        parts = [{"quotes": _LOOSE, "breaks": _ANY}.get(how) or self.value(f) for f in self.fields[:k]]
        return rf"\A{','.join(parts)}(?:,|{_END})"

    @property
    def counted(self) -> str:
        n = len(self.fields)
        return rf"\A{_LOOSE}(?:,{_LOOSE}){{{n - 1}}}{_END}" if n > 1 else rf"\A{_LOOSE}{_END}"

    # landed rows: the judged columns, joined by a character that no good value holds

    @property
    def judged(self) -> list[str]:
        return [f for f, _ in self.kinds]

    def landed(self, k: int | None = None) -> str:
        """The pattern of a whole landed row, or of its first k judged columns. Null counts as blank."""
        parts = [f"(?:{_JAVA_BLANK}*|{good})" for _, good in self.kinds[:k]]
        return rf"\A{_SEPARATOR.join(parts)}" + (r"\z" if k is None else rf"(?:{_SEPARATOR}|\z)")


CUSTOMER_ROW = RowSchema(
    "customers_qa",
    ("cust_id", "first_name", "last_name", "address", "city", "state", "zip", "createdAtTimestamp", "timestamp_micro", "timestamp_millis", "hashedCustId", "phone", "phoneType", "isActive", "birthdate", "isLegalAge", "age", "height", "numFamilyMembers", "rownum"),
    (("height", HEIGHT),),
)
USER_ROW = RowSchema("users", ("user_id", "email", "interests", "reg_date", "referral_count", "json_data", "item_count"), (("item_count", ITEM_COUNT),))


def _match(lines: pa.Array, pattern: str) -> np.ndarray:
    return pc.match_substring_regex(lines, pattern).to_numpy(zero_copy_only=False).astype(bool)


def judge(lines: pa.Array, schema: RowSchema) -> tuple[np.ndarray, np.ndarray]:
    """(reason, position of the first broken field from 1): None and 0 for valid records.

    A missing field counts as broken at the place where it should be, a surplus one behind the last.
    """
    n = len(lines)
    reason, broken = np.full(n, None, object), np.zeros(n, np.int32)
    text = pc.fill_null(lines, "")
    bad = np.flatnonzero(~_match(text, schema.whole))
    if not len(bad):
        return reason, broken
    left = text.take(pa.array(bad))
    quoted, counted, unbroken = (_match(left, p) for p in (schema.well_quoted, schema.counted, schema.unbroken))
    reason[bad] = np.where(~quoted, "quoting", np.where(~counted, "column_count", np.where(~unbroken, "quoting", "value")))
    asked = np.where(~quoted | ~counted, "quotes", np.where(~unbroken, "breaks", "value"))
    # shortest prefix that fails; only records still whole so far are tried with the next field
    place, alive = np.full(len(bad), len(schema.fields) + 1, np.int32), np.arange(len(bad))
    for k in range(1, len(schema.fields) + 1):
        if not len(alive):
            break
        ok = np.zeros(len(alive), bool)
        for how in ("quotes", "breaks", "value"):
            pick = np.flatnonzero(asked[alive] == how)
            if len(pick):
                ok[pick] = _match(left.take(pa.array(alive[pick])), schema.prefix(k, how))
        place[alive[~ok]] = k
        alive = alive[ok]
    broken[bad] = place
    return reason, broken


def failing_lines(df: DataFrame, schemas: list[RowSchema], *, row_id: str = "row_id", target: str = "target_table", line: str = "line") -> DataFrame:
    """Records that fail: row_id, target, reason, field (name of the first broken field, null behind the last), field_no, line.

    A line is one record of RFC 4180. reason is ``quoting`` if its quotes break that standard, else ``column_count``, else
    ``quoting`` again if a line break stands outside quotes, but for one at the very end, else ``value`` for a judged field
    that is neither blank nor good. A null or empty line has one empty column. Lines for a target that no schema names can't be judged and
    are left out. Repeated rows come out repeated, empty tables give none, other columns aren't read. No shuffle.
    """
    by = {s.name: s for s in schemas}
    src = df.where(F.col(f"`{target}`").isin(list(by))).select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.col(f"`{target}`").alias("target"), F.col(f"`{line}`").cast("string").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, schema in by.items():
                own = b.filter(pc.equal(b["target"], name))
                reason, broken = judge(own["line"], schema)
                at = np.flatnonzero(broken)
                names = np.array([None, *schema.fields, None], object)
                part = own.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part["row_id"], part["target"], pa.array(reason[at], pa.string()), pa.array(names[broken[at]], pa.string()), pa.array(broken[at], pa.int32()), part["line"]], names=["row_id", "target", "reason", "field", "field_no", "line"])

    return arrow_map(src, run, "row_id bigint, target string, reason string, field string, field_no int, line string")


def valid_lines(df: DataFrame, schema: RowSchema, *, row_id: str = "row_id", target: str = "target_table", line: str = "line") -> DataFrame:
    """The valid records for one target, loaded: row_id and a text column per field; an empty field without quotes is null."""
    src = df.where(F.col(f"`{target}`") == schema.name).select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), F.col(f"`{line}`").cast("string").alias("line"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, broken = judge(b["line"], schema)
            own = b.take(pa.array(np.flatnonzero(broken == 0)))
            yield pa.RecordBatch.from_arrays([own["row_id"], *fields_of(own["line"], len(schema.fields))], names=["row_id", *schema.fields])

    return arrow_map(src, run, "row_id bigint, " + ", ".join(f"`{f}` string" for f in schema.fields))


def fields_of(lines: pa.Array, n: int) -> list[pa.Array]:
    """The n fields of records that are valid, from the parity of quotes over their bytes; empty ones are null."""
    text = pc.replace_substring_regex(pc.fill_null(lines, "").cast(pa.large_string()), r"(?:\r\n|\n|\r)\z", "")
    raw, offsets, _ = string_buffers(text)
    # a valid record has an even number of quotes, so parity needs no restart at its begin
    outside = np.cumsum(raw == ord('"')) % 2 == 0
    commas = np.flatnonzero((raw == ord(",")) & outside).reshape(len(text), n - 1)
    begins = np.concatenate((offsets[:-1, None], commas + 1), axis=1)
    ends = np.concatenate((commas, offsets[1:, None]), axis=1)
    out = []
    for k in range(n):
        group, place = spread(ends[:, k] - begins[:, k])
        own = from_buffers(raw[begins[group, k] + place], np.concatenate(([0], np.cumsum(ends[:, k] - begins[:, k]))))
        quoted = pc.starts_with(own, '"')
        inner = pc.replace_substring(pc.replace_substring_regex(own, r'\A"|"\z', ""), '""', '"')
        value = pc.if_else(quoted, inner, own)
        out.append(pc.if_else(pc.equal(value, ""), pa.scalar(None, pa.large_string()), value).cast(pa.string()))
    return out


def failing_values(df: DataFrame, schema: RowSchema, *, row_id: str = "row_id") -> DataFrame:
    """Rows of a landed table that fail: row_id, field (the first broken one), value.

    A landed row is held against the anchored pattern of its judged columns; those that fail go through the patterns of
    growing prefixes, the first of which that fails names the field. Null and blank values are good. Repeated rows come out
    repeated, empty tables give none, other columns aren't read. Runs inside the JVM, no shuffle.
    """
    values = [F.col(f"`{f}`").cast("string") for f in schema.judged]
    row = F.concat_ws("\x00", *(F.translate(F.coalesce(v, F.lit("")), "\x00", "\ufffd") for v in values))
    first = [F.when(~F.col("_row").rlike(schema.landed(k)), F.struct(F.lit(f).alias("field"), v.alias("value"))) for k, (f, v) in enumerate(zip(schema.judged, values), 1)]
    bad = df.select(F.col(f"`{row_id}`").cast("bigint").alias("row_id"), *(F.col(f"`{f}`") for f in schema.judged), row.alias("_row")).where(~F.col("_row").rlike(schema.landed()))
    return bad.select("row_id", F.coalesce(*first).alias("_f")).select("row_id", "_f.field", "_f.value")
