"""Functions on dates and times."""

from __future__ import annotations

import re

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.registry import WrongArguments, function
from tallyforge.plans import values as V
from tallyforge.plans.values import Val

#: Elements of reference-time layouts, longest first, with Java's letters.
_LAYOUT = [("January", "MMMM"), ("Monday", "EEEE"), ("2006", "yyyy"), ("-07:00", "XXX"), ("Z07:00", "XXX"), ("-0700", "xx"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"), ("PM", "a"), (".000000", ".SSSSSS"), (".000", ".SSS"), ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s")]
#: strftime's letters and Java's.
_STRFTIME = {"Y": "yyyy", "y": "yy", "m": "MM", "d": "dd", "e": "d", "H": "HH", "I": "hh", "M": "mm", "S": "ss", "L": "SSS", "f": "SSSSSS", "B": "MMMM", "b": "MMM", "h": "MMM", "A": "EEEE", "a": "EEE", "p": "a", "j": "DDD", "Z": "z", "z": "xx", "F": "yyyy-MM-dd", "T": "HH:mm:ss", "D": "MM/dd/yy", "R": "HH:mm"}


def _quote(s: str) -> str:
    return re.sub(r"[A-Za-z']+", lambda m: "'" + m[0].replace("'", "''") + "'", s)


def layout_pattern(layout: str) -> str:
    out, i = "", 0
    while i < len(layout):
        hit = next(((a, b) for a, b in _LAYOUT if layout.startswith(a, i)), None)
        out, i = (out + hit[1], i + len(hit[0])) if hit else (out + _quote(layout[i]), i + 1)
    return out


def strftime_pattern(fmt: str) -> str:
    return re.sub(r"%(.)|([^%]+)", lambda m: _quote(m[2]) if m[2] else _STRFTIME.get(m[1], _quote(m[1])), fmt)


def _at(ctx, args):
    return V.as_time(args[0], ctx.now) if args else ctx.now


@function("now", args=(0, 0))
def now(ctx):
    return V.time(ctx.now)


@function("todate", args=(1, 2))
def todate(ctx, a, b=None):
    """Of one argument in any form; of two the first is a layout of the reference time 2006-01-02 15:04:05."""
    if b is None:
        return V.time(V.as_time(a, ctx.now))
    if not a.is_literal:
        raise WrongArguments("the layout is a literal")
    return V.time(F.try_to_timestamp(V.as_text(b), F.lit(layout_pattern(str(a.value)))))


@function("todatein", args=(2, 2))
def todatein(ctx, a, zone):
    """A local time of the zone."""
    if not zone.is_literal or V.as_text(zone) is None:
        raise WrongArguments("the zone is a literal")
    from zoneinfo import ZoneInfo

    try:
        ZoneInfo(str(zone.value))
    except (ValueError, OSError, KeyError) as e:
        raise WrongArguments(f"there is no zone {zone.value}") from e
    if a.is_literal and isinstance(a.value, str):
        try:
            moved = V.date_math(a.value, ctx.now)
        except V.BadDateMath as e:
            raise WrongArguments(f"no date arithmetic: {e}") from e
        if moved is not None:
            return V.time(moved)
    return V.time(F.to_utc_timestamp(V.as_time(a, ctx.now), str(zone.value)))


@function("totimestamp", args=(1, 1))
def totimestamp(ctx, a):
    return V.whole(F.unix_seconds(V.as_time(a, ctx.now)))


@function("yy", args=(0, 1))
def yy(ctx, *a):
    return V.whole(F.year(_at(ctx, a)) % 100)


@function("yymm", args=(0, 1))
def yymm(ctx, *a):
    return V.text(F.date_format(_at(ctx, a), "yyMM"))


@function("mm", "monthofyear", args=(0, 1))
def mm(ctx, *a):
    return V.whole(F.month(_at(ctx, a)))


@function("dayofweek", args=(0, 1))
def dayofweek(ctx, *a):
    """0 is Sunday."""
    return V.whole(F.dayofweek(_at(ctx, a)) - 1)


@function("hourofday", args=(0, 1))
def hourofday(ctx, *a):
    return V.whole(F.hour(_at(ctx, a)))


@function("hourofweek", args=(0, 1))
def hourofweek(ctx, *a):
    return V.whole((F.dayofweek(_at(ctx, a)) - 1) * 24 + F.hour(_at(ctx, a)))


@function("seconds", args=(1, 1))
def seconds(ctx, a):
    """Of minutes:seconds, with or without an M before them; of a bare number itself; of a date since 1970."""
    if a.is_number:
        return V.number(a.col.cast("double"))
    if a.is_time:
        return V.number(F.unix_seconds(a.col.cast("timestamp")).cast("double"))
    s = F.regexp_replace(V.as_text(a), "^M", "")
    clock = r"^(\d+(?:\.\d+)?):(\d+(?:\.\d+)?)$"
    part = lambda i: F.regexp_extract(s, clock, i).try_cast("double")
    long = s.rlike(r"^\d{9,}$")
    return V.number(
        F.when(s.rlike(clock), part(1) * 60 + part(2))
        .when(s.rlike(r"^[-+]?\d+(\.\d+)?$") & ~long, s.try_cast("double"))
        .otherwise(F.unix_seconds(V.as_time(a, ctx.now)).cast("double"))
    )


@function("strftime", "extract", args=(2, 2))
def strftime(ctx, a, fmt):
    if not fmt.is_literal:
        raise WrongArguments("the format is a literal")
    return V.text(F.date_format(V.as_time(a, ctx.now), strftime_pattern(str(fmt.value))))


@function("unixtrunc", args=(1, 2))
def unixtrunc(ctx, a, unit=None):
    """Seconds since 1970 as text; with "seconds" also the milliseconds behind a point, not padded; with "milliseconds" or "ms"
    milliseconds."""
    t = V.as_time(a, ctx.now)
    s, ms = F.unix_seconds(t).cast("string"), F.unix_millis(t)
    if unit is None:
        return V.text(s)
    name = str(unit.value) if unit.is_literal else ""
    if name in ("s", "seconds"):
        return V.text(F.concat(s, F.lit("."), F.pmod(ms, F.lit(1000)).cast("string")))
    if name in ("ms", "milliseconds"):
        return V.text(ms.cast("string"))
    return V.text(F.lit(None).cast("string"))


@function("timediff", args=(2, 3))
def timediff(ctx, a, b, unit=None):
    """a less b: in the unit if one is given, from nanoseconds to hours, else as an interval."""
    d = F.unix_micros(V.as_time(a, ctx.now)) - F.unix_micros(V.as_time(b, ctx.now))
    if unit is None:
        return Val((V.as_time(a, ctx.now) - V.as_time(b, ctx.now)), T.DayTimeIntervalType())
    per = {"nanoseconds": 0.001, "microseconds": 1.0, "milliseconds": 1e3, "seconds": 1e6, "minutes": 6e7, "hours": 3.6e9}
    name = str(unit.value).lower() if unit.is_literal else ""
    if name not in per:
        raise WrongArguments(f"no unit of time: {name}")
    if name in ("nanoseconds", "microseconds", "milliseconds"):
        return V.whole(d * 1000 if name == "nanoseconds" else F.floor(d / per[name]))
    return V.number(d / per[name])
