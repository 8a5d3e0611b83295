"""SELECT statements turned into DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.operators import relational
from tallyforge.functions.registry import AGGREGATE_REGISTRY
from tallyforge.plans import values as V
from tallyforge.plans.compiler import AGGREGATES, Compiler, NotAllowed, Scope, UnknownColumn, has_aggregate, output_name
from tallyforge.plans.syntax import AmongRows, Between, Binary, Call, Item, Join, Literal, Name, Select, Star, Table, Unary, replace_nodes, walk
from tallyforge.plans.values import Val

HIDDEN = ("_part", "_rownum")


@dataclass
class Source:
    """A table as the planner sees it: rows, the columns to search by words, and what bounds of its time field say about
    partitions."""

    df: DataFrame
    searchable: frozenset[str] = frozenset()
    quantum: str = ""
    prune: Callable[[Column | None, Column | None], Column] | None = None
    relations: dict[str, str] = field(default_factory=dict)  # foreign key column: parent table


@dataclass
class Planner:
    spark: SparkSession
    source: Callable[[str], Source]
    compat: bool = False
    database: str = "default"
    includes: Callable | None = None
    order_as_text: bool = False

    @property
    def logic(self) -> str:
        return "compat" if self.compat else "standard"

    def select(self, q: Select) -> DataFrame:
        return _Plan(self, q).run()


def conjuncts(e) -> list:
    return [*conjuncts(e.left), *conjuncts(e.right)] if isinstance(e, Binary) and e.op == "AND" else [e]


class _Plan:
    def __init__(self, planner: Planner, q: Select):
        self.p, self.q = planner, q
        self.scope, self.sources = Scope(), {}
        self.df: DataFrame = planner.spark.range(1).select(F.lit(0).alias("_one"))
        self.flags = 0

    def compiler(self, **more) -> Compiler:
        searchable = frozenset(c for s in self.sources.values() for c in s.searchable)
        return Compiler(self.scope, self.p.logic, includes=self.p.includes, database=self.p.database, searchable=searchable, rows=self.exists_flag, **more)

    # FROM

    def table(self, t: Table) -> DataFrame:
        s = Source(self.p.select(t.query)) if t.query is not None else self.p.source(t.name)
        if t.label in self.sources:
            raise NotAllowed(f"table {t.label} is named twice")
        self.sources[t.label] = s
        self.scope.tables[t.label] = {f.name: Val(F.col(f"`{t.label}.{f.name}`"), f.dataType) for f in s.df.schema.fields}
        cols = self.scope.tables[t.label]
        if "_rownum" in cols:
            cols["@rownum"] = cols["_rownum"]
        return s.df.select(*(F.col(f"`{c}`").alias(f"{t.label}.{c}") for c in s.df.columns))

    def join(self, j: Join) -> None:
        right = self.table(j.table)
        on = self.compiler().predicate(j.on) if not self.p.compat else Compiler(self.scope, "standard").predicate(j.on)
        if isinstance(j.on, Binary) and j.on.op == "!=" and isinstance(j.on.left, Name) and isinstance(j.on.right, Name):
            # rows of the left without a partner
            equal = Compiler(self.scope, "standard").predicate(Binary("=", j.on.left, j.on.right))
            self.df = self.df.join(right, equal, "left_anti")
            for c, v in self.scope.tables[j.table.label].items():
                self.scope.tables[j.table.label][c] = Val(F.lit(None).cast(v.type), v.type)
            return
        if j.kind == "right" and self.p.compat:
            raise NotAllowed("the right table of a right outer join can't be the one that is kept")
        self.df = self.df.join(right, on, {"inner": "inner", "left": "left", "right": "right"}[j.kind])

    # WHERE

    def one_column(self, q: Select) -> DataFrame:
        if len(q.items) != 1 or isinstance(q.items[0].expr, Star):
            raise NotAllowed("a query in IN selects exactly one column")
        sub = self.p.select(q)
        return sub.select(F.col(f"`{sub.columns[0]}`").alias("_in"))

    def member(self, e: AmongRows, negated: bool) -> None:
        """IN and NOT IN a query as semi and anti join; missing values don't count as members. In compat mode IN is an inner
        join: a row comes once for every row of the query that equals it."""
        v, sub = self.compiler(aliases=self.aliases()).value(e.arg), self.one_column(e.query)
        a, b = V.common(v, Val(F.col("_in"), sub.schema[0].dataType), F.current_timestamp())
        self.df = self.df.join(sub, a == b, "left_anti" if negated else "inner" if self.p.compat else "left_semi")

    def exists_flag(self, e: AmongRows) -> Column:
        """IN a query somewhere inside a predicate: a left join with its distinct rows."""
        v, sub = self.compiler(aliases=self.aliases()).value(e.arg), self.one_column(e.query)
        self.flags += 1
        flag, key = f"_flag{self.flags}", f"_in{self.flags}"
        sub = sub.distinct().select(F.col("_in").alias(key), F.lit(True).alias(flag))
        a, b = V.common(v, Val(F.col(key), sub.schema[0].dataType), F.current_timestamp())
        self.df = self.df.join(sub, a == b, "left")
        return F.coalesce(F.col(flag), F.lit(False))

    def aliases(self) -> dict[str, object]:
        """What aliases stand for in WHERE: their expression, of an aggregate its argument."""
        out = {}
        for i in self.q.items:
            if i.alias:
                agg = isinstance(i.expr, Call) and i.expr.name in AGGREGATES and i.expr.args
                out[i.alias] = i.expr.args[0] if agg else i.expr
        return {k: v for k, v in out.items() if not has_aggregate(v) and not isinstance(v, Star)}

    def where(self) -> None:
        if self.q.where is None:
            return
        for c in conjuncts(self.q.where):
            inner = c.arg if isinstance(c, Unary) and c.op == "NOT" else c
            if isinstance(inner, AmongRows):
                self.member(inner, inner is not c)
            elif isinstance(c, Call) and c.name == "sample_stratified":
                self.df = relational.stratified_sample(self.df, self.compiler().value(Name((str(c.args[0].value),))).col, float(c.args[1].value))
            elif isinstance(c, Between) and isinstance(c.arg, Name) and c.arg.parts[-1] == "@timestamp":
                self.hint(c)
            else:
                ok = self.compiler(aliases=self.aliases()).predicate(c, sieve=True)  # may join to self.df
                self.df = self.df.where(ok)
                self.prune(c)

    def hint(self, c: Between) -> None:
        """@timestamp BETWEEN bounds the partitions, not the rows."""
        k = self.compiler()
        low, high = (V.as_time(k.value(x), k.now) for x in (c.low, c.high))
        for label, s in self.sources.items():
            if s.prune is not None:
                self.restrict(label, s.prune(low, high))

    def restrict(self, label: str, ok: Column) -> None:
        if f"{label}._part" in self.df.columns:
            named = self.df.withColumn("_part", F.col(f"`{label}._part`"))
            self.df = named.where(ok).drop("_part")

    def prune(self, c) -> None:
        """A bound of the time field bounds the partitions too."""
        for label, s in self.sources.items():
            if s.prune is None:
                continue
            low = high = None
            k = self.compiler()
            own = lambda e: isinstance(e, Name) and e.parts[-1] == s.quantum and (len(e.parts) == 1 or e.parts[0] == label)  # noqa: E731, B023
            if isinstance(c, Between) and own(c.arg) and isinstance(c.low, Literal) and isinstance(c.high, Literal):
                low, high = c.low, c.high
            elif isinstance(c, Binary) and own(c.left) and isinstance(c.right, Literal) and c.right.value is not None:
                if c.op in (">", ">=", "="):
                    low = c.right
                if c.op in ("<", "<=", "="):
                    high = c.right
            if low is not None or high is not None:
                at = [V.as_time(k.value(x), k.now) if x is not None else None for x in (low, high)]
                self.restrict(label, s.prune(*at))

    # SELECT

    def expanded(self) -> list[Item]:
        out: list[Item] = []
        for i in self.q.items:
            if not isinstance(i.expr, Star):
                out.append(i)
                continue
            labels = [i.expr.table] if i.expr.table else list(self.scope.tables)
            for label in labels:
                cols = next((c for t, c in self.scope.tables.items() if t.lower() == label.lower()), None)
                if cols is None:
                    raise UnknownColumn(f"unknown table {label}")
                taken = {output_name(x.expr) if x.alias is None else x.alias for x in out}
                out += [Item(Name((label, c)), f"{label}.{c}" if c in taken else c) for c in cols if c not in HIDDEN and not c.startswith("@")]
        return out

    def run(self) -> DataFrame:
        q = self.q
        if q.source is not None:
            self.df = self.table(q.source)
            for j in q.joins:
                self.join(j)
        self.where()
        items = self.expanded()
        named = []
        for i in items:
            n = i.alias or output_name(i.expr)
            if i.alias is None and isinstance(i.expr, Name) and len(i.expr.parts) > 1 and n in {x for _, x in named}:
                n = str(i.expr)  # a column of another table keeps its table's name
            named.append((i, n))
        if len({n for _, n in named}) < len(named):
            raise NotAllowed("columns of the same name need aliases")
        if len(items) == 1 and isinstance(items[0].expr, Call) and items[0].expr.name == "topn":
            return self.top(items[0].expr)
        grouped = bool(q.group) or any(has_aggregate(i.expr) for i in items) or (q.having is not None and has_aggregate(q.having))
        if grouped:
            return self.finish(*self.aggregated(named))
        compile_ = self.compiler(aliases=self.aliases())
        cols = [(n, self.item(compile_, i)) for i, n in named]
        return self.finish(cols, compile_, named)

    def item(self, c: Compiler, i: Item) -> Column:
        v = c.value(i.expr)
        return F.when(c.predicate(i.guard), v.col) if i.guard is not None else v.col

    def top(self, call: Call) -> DataFrame:
        v = self.compiler().value(call.args[0])
        n = int(call.args[1].value) if len(call.args) > 1 else None
        name = output_name(call.args[0])
        return relational.top_n(self.df.select(v.col.alias(name)), name, n)

    def aggregated(self, named: list) -> tuple:
        q, compile_ = self.q, self.compiler(aliases=self.aliases())
        alias = {n: i.expr for i, n in named}
        keys = [alias.get(g.parts[0], g) if isinstance(g, Name) and len(g.parts) == 1 and self.scope.find(g.parts) is None else g for g in q.group]
        keys = [named[g.value - 1][0].expr if isinstance(g, Literal) and isinstance(g.value, int) and 0 < g.value <= len(named) else g for g in keys]
        df, key_names = self.df, []
        for k, e in enumerate(keys):
            v = compile_.value(e)
            name = f"_k{k}"
            if v.is_list and self.p.compat:  # a row counts in each of its values
                df = df.withColumn(name, F.explode(v.col))
            else:
                df = df.withColumn(name, v.col if not v.is_null else F.lit(None).cast("string"))
            if self.p.compat:
                df = df.where(F.col(name).isNotNull())
            key_names.append(name)
        calls, aggs, types = [], [], {}
        every = [i.expr for i, _ in named] + ([q.having] if q.having is not None else []) + [o for o, _ in q.order]
        every = [self.unaliased(e, alias) for e in every]
        for e in every:
            for x in walk(e):
                if isinstance(x, Call) and x.name in AGGREGATES and x not in calls:
                    calls.append(x)
        for k, x in enumerate(calls):
            col, types[f"_a{k}"] = self.aggregate(compile_, x)
            aggs.append(col.alias(f"_a{k}"))
        loose: list = []  # columns neither grouped nor aggregated pass one of their values

        def rewrite(e):
            def change(x):
                if x in calls:
                    return Name((f"_a{calls.index(x)}",))
                if x in keys:
                    return Name((f"_k{keys.index(x)}",))
                if isinstance(x, Name) and self.scope.find(x.parts) is not None:
                    if x not in loose:
                        loose.append(x)
                    return Name((f"_l{loose.index(x)}",))
                return None

            return replace_nodes(e, change)

        made = [(Item(rewrite(self.unaliased(i.expr, {})), None, rewrite(i.guard) if i.guard is not None else None), n) for i, n in named]
        having = rewrite(self.unaliased(q.having, alias)) if q.having is not None else None
        order = [(rewrite(self.unaliased(e, alias)), desc) for e, desc in q.order]
        aggs += [F.first(compile_.value(x).col, ignorenulls=True).alias(f"_l{k}") for k, x in enumerate(loose)]
        out = df.groupBy(*key_names).agg(*aggs) if key_names and aggs else df.select(*key_names).distinct() if key_names else df.agg(*aggs)
        after = Compiler(Scope({"": {f.name: Val(F.col(f.name), f.dataType) for f in out.schema.fields}}), self.p.logic, database=self.p.database)
        if having is not None:
            out = out.where(after.predicate(having))
        self.df = out
        self.q = Select(q.items, order=tuple(order), limit=q.limit, offset=q.offset, distinct=q.distinct, into=q.into, options=q.options)
        return [(n, self.item(after, i)) for i, n in made], after, made

    def unaliased(self, e, alias: dict):
        def change(x):
            if isinstance(x, Name) and len(x.parts) == 1 and x.parts[0] in alias and alias[x.parts[0]] != x and self.scope.find(x.parts) is None:
                return alias[x.parts[0]]
            return None

        return replace_nodes(e, change)

    def aggregate(self, c: Compiler, x: Call) -> tuple[Column, T.DataType]:
        if x.name == "count":
            if x.args and not isinstance(x.args[0], Star):
                v = c.value(x.args[0])
                if x.distinct:
                    return F.count_distinct(v.col), T.LongType()
                if not self.p.compat:
                    return F.count(v.col), T.LongType()
            return F.count(F.lit(1)), T.LongType()
        if x.name == "topn":
            raise NotAllowed("topn stands alone")
        if len(x.args) != 1:
            raise NotAllowed(f"{x.name} takes one column here")
        v = c.value(x.args[0])
        if x.name in AGGREGATE_REGISTRY:
            made = AGGREGATE_REGISTRY[x.name](v)
            return made.col, made.type
        if x.name == "cardinality":
            return F.approx_count_distinct(v.col), T.LongType()
        if self.p.compat and (v.is_text or v.is_list) and x.name in ("sum", "avg", "min", "max"):
            raise NotAllowed(f"can't {x.name} a non-numeric column")
        if x.name in ("min", "max"):
            return (F.min if x.name == "min" else F.max)(v.col), v.type
        n = v.col if v.is_number else V.as_number(v)
        if x.name == "sum":
            return (F.sum_distinct(n) if x.distinct else F.sum(n)), v.type
        if not self.p.compat:
            return F.avg(n), T.DoubleType()
        # cut off at the column's scale; nothing gives 0
        if v.is_whole or isinstance(v.type, T.DecimalType):
            # in whole units of the scale, so that nothing is lost to binary fractions
            scale = v.type.scale if isinstance(v.type, T.DecimalType) else 0
            units = (n.cast(T.DecimalType(max(v.type.precision, scale), scale)) * F.lit(10**scale).cast(T.DecimalType(scale + 1, 0))).cast(T.DecimalType(v.type.precision, 0)) if scale else n.cast(T.DecimalType(20, 0))
            whole = F.coalesce(F.call_function("div", F.sum(units), F.nullif(F.count(units), F.lit(0))), F.lit(0))
            return (whole / F.lit(float(10**scale)) if scale else whole), T.DoubleType()
        scale = 6
        cut = F.coalesce(F.avg(n.cast("double")), F.lit(0.0)) * 10**scale
        cut = F.when(cut < 0, F.ceil(cut)).otherwise(F.floor(cut)) / 10**scale
        return cut, T.DoubleType()

    def finish(self, cols: list[tuple[str, Column]], c: Compiler, named: list) -> DataFrame:
        q = self.q
        outputs = {n for n, _ in cols}
        sorts, hidden = [], []
        for k, (e, desc) in enumerate(q.order):
            if isinstance(e, Literal) and isinstance(e.value, int) and 0 < e.value <= len(cols):
                name = cols[e.value - 1][0]
            elif isinstance(e, Name) and len(e.parts) == 1 and e.parts[0] in outputs:
                name = e.parts[0]
            elif any(i.expr == e for i, _ in named):
                name = next(n for i, n in named if i.expr == e)
            else:
                name = f"_s{k}"
                hidden.append(c.value(e).col.alias(name))
            col = F.col(f"`{name}`")
            if self.p.order_as_text:  # missing values first, 10 before 9
                col = F.coalesce(col.cast("string"), F.lit(""))
            sorts.append(col.desc() if desc else col.asc())
        out = self.df.select(*(col.alias(n) for n, col in cols), *hidden)
        if q.distinct:
            out = out.distinct()
        if sorts:
            out = out.orderBy(*sorts)
        if q.offset:
            out = out.offset(q.offset)
        if q.limit is not None:
            out = out.limit(q.limit)
        return out.drop(*(f"_s{k}" for k in range(len(q.order)))) if hidden else out


