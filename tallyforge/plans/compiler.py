"""Expressions compiled to typed columns, under one of three logics of missing values.

``standard`` is SQL's three-valued logic. In ``compat`` every predicate is true or false and negations hold for missing values.
``filter`` is that of the filter language: compat, names that don't exist are missing, BETWEEN leaves out its ends, and
patterns are globs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.functions.registry import Context, lookup
from tallyforge.plans import values as V
from tallyforge.plans.syntax import Among, AmongRows, Between, Binary, Call, Everything, Include, Listed, Literal, Name, Star, Unary, walk
from tallyforge.plans.values import Val

AGGREGATES = {"count", "sum", "avg", "min", "max", "topn", "cardinality"}
#: This engine's own choice of words that say nothing in a text search.
STOP_WORDS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


class UnknownColumn(ValueError):
    pass


class NotAllowed(ValueError):
    """The statement breaks a rule of the engine."""


@dataclass
class Scope:
    """The columns in reach: per table label, by name."""

    tables: dict[str, dict[str, Val]] = field(default_factory=dict)

    def find(self, parts: tuple[str, ...]) -> Val | None:
        for cut in range(len(parts), 0, -1):
            v = self._column(parts[:cut])
            if v is not None:
                return _inside(v, parts[cut:])
        if len(parts) == 1 and "." in parts[0]:
            return self.find(tuple(parts[0].split(".")))
        return None

    def _column(self, parts: tuple[str, ...]) -> Val | None:
        if len(parts) >= 2:
            t = ".".join(parts[:-1])
            hit = next((cols for label, cols in self.tables.items() if label.lower() == t.lower()), None)
            return _by_name(hit, parts[-1]) if hit is not None else None
        for cols in self.tables.values():
            if (v := _by_name(cols, parts[0])) is not None:
                return v
        return None

    def every(self) -> dict[str, Val]:
        return {n: v for cols in reversed(self.tables.values()) for n, v in cols.items()}


def _by_name(cols: dict[str, Val], name: str) -> Val | None:
    if name in cols:
        return cols[name]
    return next((v for n, v in cols.items() if n.lower() == name.lower()), None)


def _inside(v: Val, path: tuple[str, ...]) -> Val | None:
    for p in path:
        if v.is_struct:
            f = next((x for x in v.type.fields if x.name.lower() == p.lower()), None)
            if f is None:
                return None
            v = Val(v.col[f.name], f.dataType)
        elif v.is_map:
            v = Val(F.try_element_at(v.col, F.lit(p)), v.type.valueType)
        elif v.is_list and p.lstrip("-").isdigit():
            v = Val(F.get(v.col, F.lit(int(p))), v.type.elementType)
        else:
            return None
    return v


def scope_of(df: DataFrame, label: str = "") -> Scope:
    return Scope({label: {f.name: Val(F.col(f"`{f.name}`"), f.dataType) for f in df.schema.fields}})


@dataclass
class Compiler:
    scope: Scope
    logic: str = "standard"
    includes: Callable[[str], object] | None = None
    now: Column | None = None
    database: str = "default"
    searchable: frozenset[str] = frozenset()
    aliases: dict[str, object] = field(default_factory=dict)
    rows: Callable | None = None  # compiles arg IN (SELECT)
    aggregate: Callable[[Call], Val] | None = None
    scales: dict[str, int] = field(default_factory=dict)
    _open: tuple[str, ...] = ()

    def __post_init__(self):
        self.now = F.current_timestamp() if self.now is None else self.now

    @property
    def lenient(self) -> bool:
        return self.logic != "standard"

    def context(self) -> Context:
        return Context(self.now, self.scope.every(), self.database)

    # values

    def value(self, e) -> Val:
        if isinstance(e, Literal):
            return V.literal(e.value)
        if isinstance(e, Name):
            return self.name(e)
        if isinstance(e, Call):
            if e.name in AGGREGATES and self.aggregate is not None:
                return self.aggregate(e)
            return lookup(e.name)(self.context(), [self.value(a) for a in e.args])
        if isinstance(e, Listed):
            items = [self.value(x) for x in e.items]
            plain = [x.value for x in items] if all(x.is_literal for x in items) else V.MISSING
            kinds = {type(x.type) for x in items}
            if len(kinds) == 1 and not items[0].is_null:
                return Val(F.array(*(x.col for x in items)), T.ArrayType(items[0].type), plain)
            return Val(F.array(*(V.as_text(x) for x in items)), T.ArrayType(T.StringType()), plain)
        if isinstance(e, Unary) and e.op == "-":
            v = self.value(e.arg)
            return V.whole(-v.col) if v.is_whole else V.number(-V.as_number(v))
        if isinstance(e, Binary) and e.op in ("+", "-", "*", "/", "%"):
            return self.arithmetic(e)
        if isinstance(e, (Binary, Unary, Between, Among, AmongRows, Include, Everything)):
            return V.boolean(self.predicate(e))
        raise NotAllowed(f"no value: {e}")

    def name(self, e: Name) -> Val:
        v = self.scope.find(e.parts)
        if v is None and len(e.parts) == 1 and e.parts[0] in self.aliases and e.parts[0] not in self._open:
            self._open += (e.parts[0],)
            try:
                return self.value(self.aliases[e.parts[0]])
            finally:
                self._open = self._open[:-1]
        if v is None:
            if self.logic == "filter":
                return V.null()
            raise UnknownColumn(f"unknown column {e}")
        return v

    def arithmetic(self, e: Binary) -> Val:
        """Whole by whole is whole; by zero is missing."""
        a, b = self.value(e.left), self.value(e.right)
        if a.is_time or b.is_time:
            raise NotAllowed("no arithmetic on times")
        if a.is_whole and b.is_whole:
            x, y = a.col.cast("bigint"), b.col.cast("bigint")
            # div raises on zero, so the divisor is never one
            div = F.when(y != 0, F.call_function("div", x, F.when(y != 0, y).otherwise(1)))
            return V.whole({"+": F.try_add(x, y), "-": F.try_subtract(x, y), "*": F.try_multiply(x, y), "/": div, "%": F.try_mod(x, y)}[e.op])
        x, y = V.as_number(a), V.as_number(b)
        return V.number({"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y), "%": F.try_mod(x, y)}[e.op])

    # predicates

    def predicate(self, e, sieve: bool = False) -> Column:
        """A column of truth; in lenient logics never null. As a sieve, which drops null like false, it may be: such leaves
        stay bare, and are pushed down to the scan."""
        if isinstance(e, Binary) and e.op in ("AND", "OR"):
            a, b = self.predicate(e.left, sieve), self.predicate(e.right, sieve)
            return a & b if e.op == "AND" else a | b
        if isinstance(e, Unary) and e.op == "NOT":
            return ~self.predicate(e.arg)
        if isinstance(e, Everything):
            return F.lit(True)
        if isinstance(e, Include):
            if self.includes is None:
                raise NotAllowed("no filters to include")
            return self.includes(e.filter)
        p = self.leaf(e)
        return F.coalesce(p, F.lit(False)) if self.lenient and not sieve else p

    def leaf(self, e) -> Column:
        if isinstance(e, Unary) and e.op == "EXISTS":
            return self.value(e.arg).col.isNotNull()
        if isinstance(e, Between):
            return self.between(e)
        if isinstance(e, Among):
            return self.among(e)
        if isinstance(e, AmongRows):
            if self.rows is None:
                raise NotAllowed("a query can't stand here")
            return self.rows(e)
        if isinstance(e, Binary):
            if e.op in ("=", "!=", "<", "<=", ">", ">="):
                return self.compare(e)
            if e.op == "LIKE":
                return self.like(e)
            if e.op == "CONTAINS":
                a, part = self.value(e.left), V.as_text(self.value(e.right))
                return F.exists(V.as_list(a), lambda x: F.contains(x, part)) if a.is_list else F.contains(V.as_text(a), part)
            if e.op in ("INTERSECTS", "IN"):
                a, b = self.value(e.left), self.value(e.right)
                if a.is_text and b.is_map or a.is_text and b.is_list:
                    a, b = b, a
                return F.arrays_overlap(self.members(a), self.members(b))
        return V.as_bool(self.value(e))

    @staticmethod
    def members(v: Val) -> Column:
        return F.map_keys(v.col).cast("array<string>") if v.is_map else V.as_list(v)

    def compare(self, e: Binary) -> Column:
        if isinstance(e.right, Literal) and e.right.value is None and e.op in ("=", "!="):
            v = self.value(e.left)
            return v.col.isNotNull() if e.op == "!=" else v.col.isNull()
        if isinstance(e.left, Literal) and e.left.value is None and e.op in ("=", "!="):
            return self.compare(Binary(e.op, e.right, e.left))
        a, b = self.value(e.left), self.value(e.right)
        self.fits_scale(e, a, b)
        if a.is_list != b.is_list and e.op in ("=", "!="):
            many, one = (a, b) if a.is_list else (b, a)
            has = F.exists(many.col, lambda x: V.common(Val(x, many.type.elementType), one, self.now)[0] == V.common(Val(x, many.type.elementType), one, self.now)[1])
            return has if e.op == "=" else self.negated(has, many, one)
        if a.is_list and not b.is_list:
            return F.exists(a.col, lambda x: self.ordered(e.op, Val(x, a.type.elementType), b))
        if a.is_map or b.is_map or a.is_struct or b.is_struct:
            return F.lit(None).cast("boolean")
        x, y = V.common(a, b, self.now)
        if e.op == "=":
            return x == y
        if e.op == "!=":
            return self.negated(x == y, a, b)
        return self.ordered(e.op, a, b)

    def negated(self, equal: Column, a: Val, b: Val) -> Column:
        """In lenient logics a missing value differs from any other."""
        if not self.lenient:
            return ~equal
        if b.is_literal and not a.is_list:
            return ~equal | a.col.isNull()
        return ~F.coalesce(equal, F.lit(False))

    def ordered(self, op: str, a: Val, b: Val) -> Column:
        if self.logic == "compat" and ((a.is_text and b.is_literal) or (b.is_text and a.is_literal)) and not (a.is_time or b.is_time or a.is_number or b.is_number or a.is_literal and b.is_literal):
            raise NotAllowed(f"{op} is not supported for strings")
        x, y = V.common(a, b, self.now)
        return {"<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    def fits_scale(self, e, *sides: Val) -> None:
        """A literal with more decimals than the column it is compared with can hold is an error in compat logic."""
        if self.logic != "compat":
            return
        column = next((s for s in sides if isinstance(s.type, T.DecimalType)), None)
        if column is None:
            return
        for s in sides:
            if s.is_literal and isinstance(s.value, float) and round(s.value, column.type.scale) != s.value:
                who = next((str(x) for x in walk(e) if isinstance(x, Name)), "it")
                raise NotAllowed(f"this would result in rounding error for field '{who}', value should have {column.type.scale} decimal places")

    def between(self, e: Between) -> Column:
        """With both ends in SQL, without them in the filter language."""
        v, low, high = self.value(e.arg), self.value(e.low), self.value(e.high)
        if self.logic == "compat" and v.is_text:
            raise NotAllowed("BETWEEN is not supported for strings")
        self.fits_scale(e, v, low, high)
        (a, x), (b, y) = V.common(v, low, self.now), V.common(v, high, self.now)
        return (a > x) & (b < y) if self.logic == "filter" else (a >= x) & (b <= y)

    def among(self, e: Among) -> Column:
        v = self.value(e.arg)
        items = [self.value(i) for i in e.items]
        if v.is_map or v.is_list:
            return F.arrays_overlap(self.members(v), F.array(*(V.as_text(i) for i in items)))
        if v.is_text and all(i.is_text and i.is_literal for i in items):
            return v.col.isin(*(i.value for i in items))
        if v.is_whole and all(i.is_whole and i.is_literal for i in items):
            return v.col.isin(*(i.value for i in items))
        if not items:
            return F.lit(False)
        tests = []
        for i in items:
            a, b = V.common(v, i, self.now)
            tests.append(F.coalesce(a == b, F.lit(False)))
        return F.when(v.col.isNotNull(), reduce(lambda a, b: a | b, tests))

    def like(self, e: Binary) -> Column:
        a, b = self.value(e.left), self.value(e.right)
        if not b.is_literal:
            return F.contains(V.as_text(a), V.as_text(b))
        if self.logic == "compat" and isinstance(e.left, Name) and e.left.parts[-1] in self.searchable:
            return token_search(V.as_text(a), str(b.value))
        pattern = V.glob(str(b.value))
        return F.exists(V.as_list(a), lambda x: x.rlike(pattern)) if a.is_list else V.as_text(a).rlike(pattern)


#: What words are made of, as a search sees them.
_WORD = r"\p{L}\p{N}\p{Mc}\p{Mn}\-_'"


def token_search(c: Column, phrase: str) -> Column:
    """Whether the text has all the phrase's words that say something. A text is looked through for a word as it stands first, and
    only where that is found for the word on its own."""
    terms = [w for w in re.split(r"[^\w\-']+", phrase.lower()) if w and w not in STOP_WORDS]
    if not terms:
        return F.lit(False)
    low, found = F.lower(c), F.lit(True)
    for t in dict.fromkeys(terms):
        found &= F.contains(low, F.lit(t)) & low.rlike(rf"(?<![{_WORD}]){re.escape(t)}(?![{_WORD}])")
    return found


def has_aggregate(e) -> bool:
    """Whether an aggregate stands in the expression; the scalar forms of count, sum and avg take several values or literals."""
    return any(isinstance(x, Call) and x.name in AGGREGATES for x in walk(e))


def output_name(e) -> str:
    """What an expression without an alias is called."""
    if isinstance(e, Name):
        return e.parts[-1].split(".")[-1]
    if isinstance(e, Literal):
        return str(e.value)
    if isinstance(e, Call):
        return f"{e.name}({', '.join(map(output_name, e.args))})"
    if isinstance(e, Star):
        return "*"
    if isinstance(e, Binary):
        return f"{output_name(e.left)} {e.op.lower()} {output_name(e.right)}"
    if isinstance(e, Unary):
        return f"{e.op.lower()} {output_name(e.arg)}"
    return type(e).__name__.lower()
