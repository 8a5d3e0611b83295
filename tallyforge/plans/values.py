"""Typed column expressions and the coercions between them. What can't be coerced is null; nothing raises at run time."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = object()


@dataclass(frozen=True)
class Val:
    """A column with its type; for literals also the value, else MISSING."""

    col: Column
    type: T.DataType
    value: object = MISSING

    @property
    def is_literal(self) -> bool:
        return self.value is not MISSING

    @property
    def is_null(self) -> bool:
        return isinstance(self.type, T.NullType)

    @property
    def is_text(self) -> bool:
        return isinstance(self.type, (T.StringType, T.BinaryType))

    @property
    def is_number(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def is_whole(self) -> bool:
        return isinstance(self.type, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))

    @property
    def is_bool(self) -> bool:
        return isinstance(self.type, T.BooleanType)

    @property
    def is_time(self) -> bool:
        return isinstance(self.type, (T.TimestampType, T.TimestampNTZType, T.DateType))

    @property
    def is_list(self) -> bool:
        return isinstance(self.type, T.ArrayType)

    @property
    def is_map(self) -> bool:
        return isinstance(self.type, T.MapType)

    @property
    def is_struct(self) -> bool:
        return isinstance(self.type, T.StructType)



def null() -> Val:
    return Val(F.lit(None), T.NullType(), None)


def literal(value) -> Val:
    if value is None:
        return null()
    if isinstance(value, bool):
        return Val(F.lit(value), T.BooleanType(), value)
    if isinstance(value, int):
        return Val(F.lit(value).cast("bigint"), T.LongType(), value)
    if isinstance(value, float):
        return Val(F.lit(value), T.DoubleType(), value)
    return Val(F.lit(str(value)), T.StringType(), str(value))


def text(c: Column) -> Val:
    return Val(c, T.StringType())


def number(c: Column) -> Val:
    return Val(c, T.DoubleType())


def whole(c: Column) -> Val:
    return Val(c.cast("bigint"), T.LongType())


def boolean(c: Column) -> Val:
    return Val(c, T.BooleanType())


def time(c: Column) -> Val:
    return Val(c, T.TimestampType())


def first(v: Val) -> Val:
    """The first element of a list, else the value itself."""
    return Val(F.get(v.col, F.lit(0)), v.type.elementType) if v.is_list else v


def as_text(v: Val) -> Column:
    v = first(v)
    if v.is_map or v.is_struct or v.is_list:
        return F.lit(None).cast("string")
    if isinstance(v.type, T.DoubleType):  # whole doubles without their .0
        return F.when(v.col == F.floor(v.col), F.format_string("%.0f", v.col)).otherwise(v.col.cast("string"))
    return v.col.cast("string")


#: What stands around numbers and is ignored.
_MONEY = "[$€£, ]"


def as_number(v: Val) -> Column:
    v = first(v)
    if v.is_number:
        return v.col.cast("double")
    if v.is_text:
        s = F.regexp_replace(v.col.cast("string"), _MONEY, "")
        # Java would also read a trailing d or f, and words
        plain = s.rlike(r"^[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?$")
        hexed = F.when(s.rlike("^0[xX][0-9a-fA-F]{1,15}$"), F.conv(F.substring(s, 3, 15), 16, 10).cast("double"))
        return F.when(plain, s.try_cast("double")).otherwise(hexed)
    if v.is_time:
        return F.unix_millis(v.col.cast("timestamp")).cast("double")
    return F.lit(None).cast("double")


def as_whole(v: Val) -> Column:
    v = first(v)
    if v.is_whole:
        return v.col.cast("bigint")
    if v.is_time:
        return F.unix_millis(v.col.cast("timestamp"))
    if v.is_bool:
        return v.col.cast("bigint")
    n = as_number(v)
    return F.when(F.abs(n) < 9.3e18, n).try_cast("bigint")


def as_bool(v: Val) -> Column:
    v = first(v)
    if v.is_bool:
        return v.col
    if v.is_text:
        s = v.col.cast("string")
        return F.when(s.isin("1", "t", "T", "true", "TRUE", "True"), True).when(s.isin("0", "f", "F", "false", "FALSE", "False"), False)
    if v.is_number:
        return v.col != 0
    return F.lit(None).cast("boolean")


def truthy(v: Val) -> Column:
    """Neither missing, empty, false nor a number up to zero. Never null."""
    if v.is_null:
        return F.lit(False)
    if v.is_bool:
        return F.coalesce(v.col, F.lit(False))
    if v.is_number:
        return F.coalesce(v.col > 0, F.lit(False))
    if v.is_text:
        return F.coalesce(v.col != "", F.lit(False))
    if v.is_list or v.is_map:
        return F.coalesce(F.size(v.col) > 0, F.lit(False))
    return v.col.isNotNull()


# Times

_DATE_MATH = re.compile(r"now(?:\s*([+-])\s*(\d+)\s*([a-zA-Z]+))?")
#: Units of date arithmetic.
_UNITS = {"s": "SECOND", "m": "MINUTE", "h": "HOUR", "d": "DAY", "w": "WEEK", "M": "MONTH", "y": "YEAR", "Y": "YEAR"}


class BadDateMath(ValueError):
    pass


def date_math(value: str, now: Column) -> Column | None:
    """now, now-3d and the like; None if the text is no such thing."""
    m = _DATE_MATH.fullmatch(value.strip())
    if m is None:
        if value.strip().startswith("now") and re.match(r"now\s*[+-]", value.strip()):
            raise BadDateMath(value)
        return None
    if m[1] is None:
        return now
    if m[3] not in _UNITS:
        raise BadDateMath(value)
    step = F.expr(f"INTERVAL {int(m[2])} {_UNITS[m[3]]}")
    return now + step if m[1] == "+" else now - step


def let(c: Column, body) -> Column:
    """body of the column's value, which is worked out once however often body uses it."""
    return F.get(F.transform(F.array(c), lambda x: body(x)), F.lit(0))


#: Rewritings that bring dates to year-month-day: month first with slashes or points, two-digit years, slashes,
#: names of months before or behind the day.
_REWRITES = [
    (r"^[A-Z][a-z]{2,8}, (?=\d)", ""),
    (r"^(\d{1,2})[/.](\d{1,2})[/.](\d{4})(?!\d)", "$3-$1-$2"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{2})(?!\d)", "20$3-$1-$2"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})", "$1-$2-$3"),
    (r"^([A-Z][a-z]{2})[a-z]* (\d{1,2}),? (\d{4})", "$3-$1-$2"),
    (r"^(\d{1,2}) ([A-Z][a-z]{2})[a-z]*,? (\d{4})", "$3-$2-$1"),
    (r" (?=(Z|UTC|[-+]\d{2}:?\d{2})$)", ""),
    (r"(:\d{2}(?:\.\d+)?)([-+]\d{2})(\d{2})$", "$1$2:$3"),
]
_MONTHS = "JanFebMarAprMayJunJulAugSepOctNovDec"
_FORM = r"^\d{4}-\d{1,2}-\d{1,2}([T ]\d{1,2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|UTC|[-+]\d{2}:\d{2}| [A-Z][A-Za-z]+(/[A-Za-z_]+)?)?)?$"
_HALF = r" (\d{1,2})(:\d{2}(?::\d{2})?) ?([AP])M$"


def _month(t: Column) -> Column:
    name = F.regexp_extract(t, r"^\d{4}-([A-Z][a-z]{2})-", 1)
    number = F.concat(F.lit("-"), ((F.instr(F.lit(_MONTHS), name) + 2) / 3).cast("int").cast("string"), F.lit("-"))
    return F.when(name == "", t).otherwise(F.regexp_replace(t, r"-[A-Z][a-z]{2}-", number))


def _clock(t: Column) -> Column:
    hour = F.regexp_extract(t, _HALF, 1).try_cast("int") % 12 + F.when(F.regexp_extract(t, _HALF, 3) == "P", 12).otherwise(0)
    return F.when(t.rlike(_HALF), F.regexp_replace(t, _HALF, F.concat(F.lit(" "), hour.cast("string"), F.lit("$2")))).otherwise(t)


def _instant(t: Column) -> Column:
    out = F.when(t.rlike(_FORM), t.try_cast("timestamp"))
    for digits, read in ((10, F.timestamp_seconds), (13, F.timestamp_millis), (16, F.timestamp_micros)):
        out = out.when(t.rlike(rf"^\d{{{digits}}}$"), read(t.try_cast("bigint")))
    return out.when(t.rlike(r"^\d{8}$"), F.try_to_timestamp(t, F.lit("yyyyMMdd")))


def parse_time(s: Column) -> Column:
    """A timestamp from text in any of the usual forms, or a bare count of seconds, milli- or microseconds; else null."""
    t = F.trim(s)
    for pattern, to in _REWRITES:
        t = F.regexp_replace(t, pattern, to)
    return let(let(let(t, _month), _clock), _instant)


def literal_time(text: str) -> Column:
    """A literal's timestamp, worked out as far as a plain cast, so that it folds to a constant and filters on it are pushed down."""
    t = text.strip()
    for pattern, to in _REWRITES:
        t = re.sub(pattern, re.sub(r"\$(\d)", r"\\\1", to), t)
    if (m := re.match(r"^(\d{4})-([A-Z][a-z]{2})-", t)) and m[2] in _MONTHS:
        t = f"{m[1]}-{_MONTHS.index(m[2]) // 3 + 1}-{t[m.end() :]}"
    if m := re.search(_HALF, t):
        t = f"{t[: m.start()]} {int(m[1]) % 12 + (12 if m[3] == 'P' else 0)}{m[2]}"
    for digits, read in ((10, F.timestamp_seconds), (13, F.timestamp_millis), (16, F.timestamp_micros)):
        if re.fullmatch(rf"\d{{{digits}}}", t):
            return read(F.lit(int(t)))
    if re.fullmatch(r"\d{8}", t):
        t = f"{t[:4]}-{t[4:6]}-{t[6:]}"
    return F.lit(t).try_cast("timestamp") if re.match(_FORM, t) else F.lit(None).cast("timestamp")


def as_time(v: Val, now: Column) -> Column:
    v = first(v)
    if v.is_time:
        return v.col.cast("timestamp")
    if v.is_text:
        if v.is_literal:
            moved = date_math(v.value, now)
            return literal_time(v.value) if moved is None else moved
        return parse_time(v.col.cast("string"))
    if v.is_whole:
        return parse_time(v.col.cast("string"))
    return F.lit(None).cast("timestamp")


def as_list(v: Val) -> Column:
    """A list of texts: of a list its elements, of another value itself."""
    if v.is_list:
        e = v.type.elementType
        return F.transform(v.col, lambda x: as_text(Val(x, e)))
    return F.when(v.col.isNotNull(), F.array(as_text(v)))


def common(left: Val, right: Val, now: Column) -> tuple[Column, Column]:
    """Both sides in a type they can be compared in."""
    if left.is_time or right.is_time:
        for a, b in ((left, right), (right, left)):
            if isinstance(a.type, T.TimestampNTZType) and not b.is_time:  # the column stays as it is stored
                x, y = a.col, as_time(b, now).cast("timestamp_ntz")
                return (x, y) if a is left else (y, x)
        return as_time(left, now), as_time(right, now)
    if left.is_bool or right.is_bool:
        return as_bool(left), as_bool(right)
    if left.is_number and right.is_number:
        return left.col, right.col
    if left.is_number or right.is_number:
        return as_number(left), as_number(right)
    if right.is_text and right.is_literal and isinstance(right.value, str) and date_math_or_none(right.value, now) is not None:
        return as_time(left, now), as_time(right, now)
    if left.is_text and left.is_literal and isinstance(left.value, str) and date_math_or_none(left.value, now) is not None:
        return as_time(left, now), as_time(right, now)
    return as_text(left), as_text(right)


def date_math_or_none(value: str, now: Column) -> Column | None:
    try:
        return date_math(value, now)
    except BadDateMath:
        return None


def glob(pattern: str) -> str:
    """A regular expression for a pattern with % or * for anything and ? for one character; the whole text must match."""
    return "(?s)^" + "".join(".*" if ch in "%*" else "." if ch == "?" else re.escape(ch) for ch in pattern) + "$"
