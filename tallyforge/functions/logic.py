"""Logic, casts and arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.registry import Context, WrongArguments, function
from tallyforge.plans import values as V
from tallyforge.plans.values import Val

_FALSE = lambda c: F.coalesce(c, F.lit(False))


def _equal(ctx: Context, a: Val, b: Val):
    if a.is_null or b.is_null:
        return F.lit(None).cast("boolean")
    x, y = V.common(a, b, ctx.now)
    return x == y


@function("eq", args=(2, 2))
def eq(ctx, a, b):
    """A missing side is not equal."""
    return V.boolean(_FALSE(_equal(ctx, a, b)))


@function("ne", args=(2, 2))
def ne(ctx, a, b):
    """Unequal too if just one side is missing."""
    return V.boolean(F.coalesce(~_equal(ctx, a, b), a.col.isNull() != b.col.isNull()))


for _name, _op in (("gt", "__gt__"), ("ge", "__ge__"), ("lt", "__lt__"), ("le", "__le__")):
    function(_name, args=(2, 2))(lambda ctx, a, b, op=_op: V.boolean(getattr(V.as_number(a), op)(V.as_number(b))))


@function("not", args=(1, 1))
def not_(ctx, a):
    return V.boolean(~V.as_bool(a))


@function("exists", args=(1, 1))
def exists(ctx, a):
    if a.is_null:
        return V.boolean(F.lit(False))
    there = a.col.isNotNull()
    if a.is_text:
        there &= a.col != ""
    if a.is_list or a.is_map:
        there &= F.size(a.col) > 0
    return V.boolean(_FALSE(there))


@function("any", args=(1, None))
def any_(ctx, *xs):
    return V.boolean(reduce(lambda a, b: a | b, map(V.truthy, xs)))


@function("all", args=(1, None))
def all_(ctx, *xs):
    return V.boolean(reduce(lambda a, b: a & b, map(V.truthy, xs)))


@function("oneof", args=(1, None))
def oneof(ctx, *xs):
    """The first value that is neither missing nor empty."""
    known = [x for x in xs if not x.is_null]
    if not known:
        return V.null()
    if all(x.is_text for x in known):
        return V.text(F.coalesce(*(F.when(x.col != "", x.col) for x in known)))
    if all(type(x.type) is type(known[0].type) for x in known):
        return Val(F.coalesce(*(x.col for x in known)), known[0].type)
    if all(x.is_number for x in known):
        return V.number(F.coalesce(*(V.as_number(x) for x in known)))
    return V.text(F.coalesce(*(F.when(V.as_text(x) != "", V.as_text(x)) for x in known)))


# Casts


@function("tostring", args=(1, 1))
def tostring(ctx, a):
    return V.text(V.as_text(a))


@function("tobool", args=(1, 1))
def tobool(ctx, a):
    return V.boolean(V.as_bool(a))


@function("toint", args=(1, 1))
def toint(ctx, a):
    return V.whole(V.as_whole(a))


@function("tonumber", args=(1, 1))
def tonumber(ctx, a):
    return V.number(V.as_number(a))


@function("cast", args=(2, 2))
def cast(ctx, a, kind):
    name = str(kind.value).lower() if kind.is_literal else ""
    if name in ("char", "string", "varchar", "text"):
        return V.text(V.as_text(a))
    if name in ("int", "integer", "bigint", "signed"):
        return V.whole(V.as_whole(a))
    if name in ("float", "number", "double", "decimal"):
        return V.number(V.as_number(a))
    if name in ("bool", "boolean"):
        return V.boolean(V.as_bool(a))
    if name in ("time", "timestamp", "datetime"):
        return V.time(V.as_time(a, ctx.now))
    if name == "date":
        return Val(V.as_time(a, ctx.now).cast("date"), T.DateType())
    raise WrongArguments(f"cannot cast to {name or 'that'}")


# Arithmetic


@function("sqrt", args=(1, 1))
def sqrt(ctx, a):
    n = V.as_number(a)
    return V.number(F.when(n >= 0, F.sqrt(n)))


@function("pow", args=(2, 2))
def pow_(ctx, a, b):
    return V.number(F.pow(V.as_number(a), V.as_number(b)))


def _each_number(x: Val):
    return F.transform(x.col, lambda y: V.as_number(Val(y, x.type.elementType)))


def _numbers(xs: tuple[Val, ...]):
    """All numbers among the arguments and in their lists, null if one of them isn't."""
    parts = []
    for x in xs:
        if x.is_list:
            parts.append(_each_number(x))
        elif x.is_bool:
            parts.append(F.array(F.lit(None).cast("double")))
        else:
            parts.append(F.array(V.as_number(x)))
    every = F.concat(*parts)
    return F.when(~F.exists(every, lambda y: y.isNull()), every)


@function("sum", args=(1, None))
def sum_(ctx, *xs):
    """A sum of nothing but zeroes counts as none."""
    s = F.aggregate(_numbers(xs), F.lit(0.0), lambda a, b: a + b)
    return V.number(F.nullif(s, F.lit(0.0)))


@function("avg", args=(1, None))
def avg(ctx, *xs):
    n = _numbers(xs)
    return V.number(F.try_divide(F.aggregate(n, F.lit(0.0), lambda a, b: a + b), F.size(n)))


@function("count", args=(1, 1))
def count(ctx, x):
    return V.whole(F.when(x.col.isNotNull(), F.lit(1)))


@function("add", args=(1, None))
def add(ctx, *xs):
    if all(x.is_whole for x in xs):
        return V.whole(reduce(F.try_add, (x.col for x in xs)))
    return V.number(reduce(lambda a, b: a + b, map(V.as_number, xs)))


@function("version", args=(0, 0))
def version(ctx):
    return V.literal("8.0.12")


@function("database", args=(0, 0))
def database(ctx):
    return V.literal(ctx.database)
