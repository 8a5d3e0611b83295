"""Functions on lists and maps."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.registry import WrongArguments, function
from tallyforge.plans import values as V
from tallyforge.plans.values import Val

_STRINGS = T.ArrayType(T.StringType())


@function("len", "char_length", args=(1, 1))
def length(ctx, a):
    """Bytes of a text, elements of a list or map, 0 of anything else."""
    if a.is_list or a.is_map:
        return V.whole(F.when(a.col.isNotNull(), F.size(a.col)))
    if a.is_text:
        return V.whole(F.octet_length(a.col))
    if a.is_struct:
        return V.whole(F.lit(None))
    return V.whole(F.when(a.col.isNotNull(), F.lit(0)))


@function("array.index", args=(2, 2))
def index(ctx, a, i):
    """From 0, or from the end if negative; null outside the list."""
    if not a.is_list:
        return V.null()
    k = V.as_whole(i).cast("int")
    return Val(F.when(k < 0, F.try_element_at(a.col, k)).otherwise(F.get(a.col, k)), a.type.elementType)


@function("array.slice", args=(2, 3))
def slice_(ctx, a, m, n=None):
    """From m up to n; negative places count from the end; null if either lies outside."""
    if not a.is_list:
        return V.null()
    size = F.size(a.col)

    def place(v):
        k = V.as_whole(v).cast("int")
        return F.when(k < 0, size + k).otherwise(k)

    lo = place(m)
    hi = size if n is None else place(n)
    ok = (lo >= 0) & (lo <= size) & (hi >= lo) & (hi <= size)
    return Val(F.when(ok, F.slice(a.col, F.when(ok, lo + 1).otherwise(1), F.when(ok, hi - lo).otherwise(0))), a.type)


@function("map", args=(2, 2))
def map_(ctx, k, v):
    ok = (V.as_text(k) != "") & v.col.isNotNull()
    if v.is_text:
        ok &= v.col != ""
    return Val(F.when(ok, F.create_map(V.as_text(k), v.col)), T.MapType(T.StringType(), v.type))


@function("maptime", args=(1, 2))
def maptime(ctx, k, t=None):
    at = ctx.now if t is None else V.as_time(t, ctx.now)
    return Val(F.when((V.as_text(k) != "") & at.isNotNull(), F.create_map(V.as_text(k), at)), T.MapType(T.StringType(), T.TimestampType()))


@function("match", args=(1, None))
def match(ctx, *prefixes):
    """Columns whose names begin with a prefix, as a map without it. Found when the plan is made."""
    hits = []
    for p in prefixes:
        if not p.is_literal:
            raise WrongArguments("match takes literal prefixes")
        hits += [(n[len(str(p.value)) :], v) for n, v in ctx.columns.items() if n.startswith(str(p.value)) and not (v.is_map or v.is_struct)]
    if not hits:
        return Val(F.lit(None).cast("map<string,string>"), T.MapType(T.StringType(), T.StringType()))
    entries = F.array(*(F.struct(F.lit(n).alias("key"), V.as_text(v).alias("value")) for n, v in dict(hits).items()))
    there = F.filter(entries, lambda e: e["value"].isNotNull())
    return Val(F.when(F.size(there) > 0, F.map_from_entries(there)), T.MapType(T.StringType(), T.StringType()))


@function("mapkeys", args=(1, 1))
def mapkeys(ctx, m):
    return Val(F.map_keys(m.col), T.ArrayType(m.type.keyType)) if m.is_map else V.null()


@function("mapvalues", args=(1, 1))
def mapvalues(ctx, m):
    return Val(F.map_values(m.col), T.ArrayType(m.type.valueType)) if m.is_map else V.null()


@function("mapinvert", args=(1, 1))
def mapinvert(ctx, m):
    """Values become keys; of equal values the last stays."""
    if not m.is_map:
        return V.null()
    kept = F.map_values(m.col)
    pairs = F.filter(F.map_entries(m.col), lambda e, i: ~F.array_contains(F.slice(kept, i + 2, F.size(kept)), e["value"]))
    out = F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["value"].cast("string").alias("key"), e["key"].cast("string").alias("value"))))
    return Val(F.when(m.col.isNotNull(), out), T.MapType(T.StringType(), T.StringType()))


def _patterns(*args: Val) -> str:
    """A regular expression for any of the globs; one without wildcards is a prefix."""
    out = []
    for a in args:
        if not a.is_literal:
            raise WrongArguments("patterns are literals")
        for p in a.value if isinstance(a.value, (list, tuple)) else [a.value]:
            p = str(p)
            out.append(V.glob(p if any(ch in p for ch in "*%") else p + "*").removeprefix("(?s)"))
    return "(?s)(" + "|".join(out) + ")"


def _sieve(a: Val, args: tuple[Val, ...], keep: bool) -> Val:
    pattern = _patterns(*args)
    hit = lambda x: x.rlike(pattern) if keep else ~x.rlike(pattern)
    if a.is_map:
        m = F.map_filter(a.col, lambda k, v: hit(k))
        return Val(F.when(F.size(m) > 0, m), a.type)
    if a.is_list:
        out = F.filter(V.as_list(a), hit)
        return Val(F.when(F.size(out) > 0, out), _STRINGS)
    s = V.as_text(a)
    return V.text(F.when((s != "") & hit(s), s))


@function("filter", args=(2, None))
def filter_(ctx, a, *patterns):
    """Without the keys or values that match."""
    return _sieve(a, patterns, keep=False)


@function("filtermatch", args=(2, None))
def filtermatch(ctx, a, *patterns):
    return _sieve(a, patterns, keep=True)
