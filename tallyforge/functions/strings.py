"""Functions on text."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.registry import function
from tallyforge.plans import values as V
from tallyforge.plans.values import Val

_STRINGS = T.ArrayType(T.StringType())


def _full(c):
    """The text unless it is empty."""
    return F.when(c != "", c)


@function("contains", args=(2, 2))
def contains(ctx, a, b):
    part = _full(V.as_text(b))
    if a.is_list:
        return V.boolean(F.exists(V.as_list(a), lambda x: F.contains(x, part)))
    return V.boolean(F.when(part.isNotNull(), F.coalesce(F.contains(V.as_text(a), part), F.lit(False))))


@function("tolower", "string.lowercase", args=(1, 1))
def lower(ctx, a):
    return V.text(F.lower(V.as_text(a)))


@function("string.uppercase", args=(1, 1))
def upper(ctx, a):
    return V.text(F.upper(V.as_text(a)))


@function("string.titlecase", args=(1, 1))
def title(ctx, a):
    """The first letter of every word large, the others as they are."""
    words = F.split(V.as_text(a), "(?<=[^\\p{L}\\p{N}_'])")
    return V.text(F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), ""))


@function("split", args=(2, 2))
def split(ctx, a, sep):
    """By the separator as it stands; nothing of an empty text or separator."""
    s = V.as_text(sep)
    quoted = F.concat(F.lit("\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return Val(F.when((V.as_text(a) != "") & (s != ""), F.split(V.as_text(a), quoted)), _STRINGS)


@function("strip", args=(1, 1))
def strip(ctx, a):
    if a.is_list:
        return Val(F.transform(V.as_list(a), lambda x: F.btrim(x, F.lit(" \t\r\n\x0b\x0c"))), _STRINGS)
    return V.text(F.btrim(V.as_text(a), F.lit(" \t\r\n\x0b\x0c")))


@function("replace", args=(2, 3))
def replace(ctx, a, old, new=None):
    return V.text(F.replace(V.as_text(a), V.as_text(old), V.as_text(new) if new is not None else F.lit("")))


@function("join", args=(2, None))
def join(ctx, *xs):
    """All values and elements but empty ones, with the last argument between."""
    *parts, sep = xs
    every = F.concat(*(F.coalesce(V.as_list(p), F.array().cast("array<string>")) for p in parts))
    kept = F.filter(every, lambda x: x.isNotNull() & (x != ""))
    return V.text(F.when(F.size(kept) > 0, F.array_join(kept, ", ") if not sep.is_literal else F.array_join(kept, str(sep.value))))


@function("hasprefix", args=(2, 2))
def hasprefix(ctx, a, b):
    part = _full(V.as_text(b))
    return V.boolean(F.when(part.isNotNull(), F.coalesce(F.startswith(V.as_text(a), part), F.lit(False))))


@function("hassuffix", args=(2, 2))
def hassuffix(ctx, a, b):
    part = _full(V.as_text(b))
    return V.boolean(F.when(part.isNotNull(), F.coalesce(F.endswith(V.as_text(a), part), F.lit(False))))
