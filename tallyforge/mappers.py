"""Mapping strategies: builders of columns from source values, applied when rows come in."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.plans import values as V
from tallyforge.plans.values import Val
from tallyforge.types import Attribute

#: Strategy or, for Custom ones, its own name, to a builder (value, attribute) -> Column.
MAPPERS: dict[str, Callable[[Val, Attribute], Column]] = {}


def mapper(*names: str):
    def put(f):
        for n in names:
            MAPPERS[n] = f
        return f

    return put


def register_mapper(name: str, build: Callable[[Val, Attribute], Column]) -> None:
    """A strategy of one's own, named by an attribute's configuration ``name``."""
    MAPPERS[name] = build


def map_column(v: Val, a: Attribute) -> Column:
    """The value as the attribute's column."""
    name = a.mapper
    if name in ("Custom", "CustomBSI"):
        name = str(dict(a.options).get("name", ""))
    if name not in MAPPERS:
        raise ValueError(f"{a.name}: no mapper for {name or a.mapper}")
    return MAPPERS[name](v, a).cast(a.spark_type)


def rejected(v: Val, a: Attribute) -> Column:
    """A message where the value cannot be taken, else null."""
    c = map_column(v, a)
    given = v.col.isNotNull() & (V.as_text(v) != "") if not (v.is_list or v.is_map or v.is_null) else F.lit(False)
    out = F.lit(None).cast("string")
    if a.mapper == "FloatScaleBSI":
        n = V.as_number(v)
        out = F.when(given & (F.abs(n - c.cast("double")) > 1e-9), f"this would result in rounding error for field '{a.name}', value should have {a.scale} decimal places").otherwise(out)
    if a.mapper in ("IntDirect", "StringToIntDirect"):
        out = F.when(given & F.coalesce(c <= 0, F.lit(True)), f"{a.name}: a number above zero is needed").otherwise(out)
    elif a.type in ("Integer", "Float", "Date", "DateTime", "Boolean"):
        out = F.when(given & c.isNull() & ~F.upper(V.as_text(v)).isin("NULL"), f"{a.name}: cannot read the value").otherwise(out)
    if a.low is not None:
        out = F.when(c < a.low, f"{a.name}: below the least value").otherwise(out)
    if a.high is not None:
        out = F.when(c > a.high, f"{a.name}: above the greatest value").otherwise(out)
    return out


@mapper("BoolDirect")
def _bool(v, a):
    if v.is_text:
        s = v.col
        return F.when(s == "", False).when(V.as_bool(v).isNotNull(), V.as_bool(v)).when(s.rlike("[nN]"), False).when(s.rlike("[yY]"), True)
    return V.as_bool(v)


@mapper("IntToBoolDirect")
def _int_bool(v, a):
    return v.col == "true" if v.is_text else V.as_number(v) != 0


@mapper("IntDirect", "StringToIntDirect")
def _int(v, a):
    return V.as_whole(v)


@mapper("IntBSI")
def _int_bsi(v, a):
    return F.when(v.col == "", 0).otherwise(V.as_whole(v)) if v.is_text else V.as_whole(v)


@mapper("FloatScaleBSI")
def _float(v, a):
    return V.as_number(v).try_cast(T.DecimalType(18, a.scale))


@mapper("StringEnum", "StringHashBSI", "StringBSI")
def _string(v, a):
    if isinstance(a.spark_type, T.ArrayType):
        if v.is_list:
            return F.array_distinct(V.as_list(v))
        s = F.nullif(V.as_text(v), F.lit(""))
        parts = F.split(s, "\\Q" + a.delimiter + "\\E") if a.delimiter else F.when(s.isNotNull(), F.array(s))
        return F.array_distinct(F.filter(F.transform(parts, F.trim), lambda x: x != ""))
    return V.as_text(v)


@mapper("BoolRegex")
def _regex(v, a):
    return V.as_text(v).rlike(str(dict(a.options).get("regex", "")))


def _instant(v, unit):
    if v.is_struct:  # {seconds, nanos}
        t = F.timestamp_micros(v.col["seconds"].cast("bigint") * 1_000_000 + F.floor(v.col["nanos"] / 1000).cast("bigint"))
    else:
        t = V.as_time(v, F.current_timestamp())
    return F.date_trunc(unit, t)


for _name, _unit in (("SysMillisBSI", "MILLISECOND"), ("SysMicroBSI", "MICROSECOND"), ("SysSecBSI", "SECOND"), ("TimestampBSI", "MICROSECOND")):

    def _build(v, a, unit=_unit):
        t = _instant(v, unit)
        return F.unix_seconds(t) if a.type == "Integer" else t

    MAPPERS[_name] = _build


@mapper("UUIDBSI")
def _uuid(v, a):
    """A UUID as text; of two halves, upper and lower, the text of both."""
    if v.is_struct:
        h = F.concat(F.lpad(F.hex(v.col["upper"].cast("bigint")), 16, "0"), F.lpad(F.hex(v.col["lower"].cast("bigint")), 16, "0"))
        return F.lower(F.regexp_replace(h, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"))
    return F.lower(V.as_text(v))


@mapper("ParentRelation")
def _parent(v, a):
    return V.as_whole(v) if a.type == "Integer" else V.as_text(v)


@mapper("ChildRelation")
def _child(v, a):
    return v.col


@mapper("IntLinear", "FloatLinear", "IntBuckets", "FloatBuckets")
def _buckets(v, a):
    """The number of the bucket, from 0: by width from the least value, or by the bounds listed in the configuration."""
    o = dict(a.options)
    n = V.as_number(v)
    if o.get("buckets"):
        bounds = [float(x) for x in (o["buckets"] if isinstance(o["buckets"], list) else str(o["buckets"]).split(","))]
        return F.when(n.isNotNull(), sum(((n >= b).cast("int") for b in bounds), F.lit(0)))
    return F.floor((n - float(a.low or 0)) / float(o.get("width", 1)))


_PARTS = {
    "YearToDay": lambda t: F.date_format(t, "yyyyMMdd").cast("bigint"), "YearToMonth": lambda t: F.date_format(t, "yyyyMM").cast("bigint"), "Year": F.year, "DayOfYear": F.dayofyear, "DayOfMonth": F.dayofmonth,
    "DayOfWeek": lambda t: F.dayofweek(t) - 1, "TimeOfDay": lambda t: F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t), "HourOfDay": F.hour,
}
for _name, _f in _PARTS.items():
    MAPPERS[_name] = lambda v, a, f=_f: f(V.as_time(v, F.current_timestamp()))


@mapper("Contains")
def _contains(v, a):
    return V.as_text(v).contains(str(dict(a.options).get("value", "")))
