"""The engine: statements in, DataFrames or counts out."""

from __future__ import annotations

import re
import threading
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.functions.registry import REGISTRY, lookup
from tallyforge.plans import values as V
from tallyforge.plans.compiler import Compiler, NotAllowed, Scope, scope_of
from tallyforge.plans.parser import Parser, parse, parse_filters
from tallyforge.plans.planner import HIDDEN, Planner, Source
from tallyforge.plans.syntax import Command, Delete, Filter, Insert, Literal, Select, Update
from tallyforge.rbac import Roles
from tallyforge.sinks import write_into
from tallyforge.sources import readers
from tallyforge.store import ROWNUM, TableStore
from tallyforge.types import Attribute, TableSpec

_COLUMN_TYPES = {"INT": "Integer", "INTEGER": "Integer", "BIGINT": "Integer", "FLOAT": "Float", "DOUBLE": "Float", "DECIMAL": "Float", "BOOL": "Boolean", "BOOLEAN": "Boolean", "DATE": "Date", "DATETIME": "DateTime", "TIMESTAMP": "DateTime", "JSON": "JSON"}
_DEPTH = 20


@dataclass
class Engine:
    """A session on a table store and views.

    compat: predicates are true or false and negations hold for missing values, groups leave missing keys out, averages are cut
    at the column's scale, count(column) counts rows; else standard SQL. default_limit: rows of a SELECT without a LIMIT.
    order_as_text: sort by the text of the keys.
    """

    spark: SparkSession
    store: TableStore | None = None
    compat: bool = True
    database: str = "default"
    user: str = ""
    roles: Roles = field(default_factory=Roles)
    default_limit: int | None = None
    order_as_text: bool = False
    views: dict[str, DataFrame] = field(default_factory=dict)
    filters: dict[str, object] = field(default_factory=dict)
    variables: dict[str, object] = field(default_factory=dict)
    prepared: dict[str, str] = field(default_factory=dict)
    streams: dict[str, object] = field(default_factory=dict)
    lazy: dict[str, Callable[[], DataFrame]] = field(default_factory=dict)

    # sources

    def register(self, name: str, df: DataFrame) -> None:
        self.views[name] = df

    def source(self, name: str) -> Source:
        short = name.split(".")[-1]
        for n in (name, short):
            if n in self.lazy:
                return Source(self.lazy[n]())
            hit = next((v for v in self.views if v.lower() == n.lower()), None)
            if hit is not None:
                return Source(self.views[hit])
        if "." in name and (meta := self.information(short.lower())) is not None and name.lower().startswith(("schema.", "information_schema.")):
            return Source(meta)
        if self.store is not None and any(t.lower() == short.lower() for t in self.store.tables()):
            spec = self.store.spec(short)
            df = self.store.read(spec.name, internal=True)
            prune = (lambda low, high: self.store.partition_filter(spec.name, low, high)) if spec.quantum else None
            relations = {a.name: a.foreign_key.split(".")[0] for a in spec.attributes if a.foreign_key}
            return Source(df, frozenset(a.name for a in spec.attributes if a.searchable), spec.quantum_field, prune, relations)
        if self.spark.catalog.tableExists(name):
            return Source(self.spark.table(name))
        raise NotAllowed(f'Could not find a DataSource for that table "{name}"')

    def planner(self) -> Planner:
        return Planner(self.spark, self.source, self.compat, self.database, order_as_text=self.order_as_text)

    # statements

    def sql(self, text: str, params: list | None = None):
        """Run a statement. SELECT, SHOW and DESCRIBE give a DataFrame, changes the number of rows."""
        whole = text.strip().rstrip(";")
        if m := re.match(r"prepare\s+(\S+)\s+from\s+(.+)", whole, re.I | re.S):
            self.prepared[m[1]] = m[2].strip().strip("'\"")
            return 0
        if m := re.match(r"execute\s+(\S+)(?:\s+using\s+(.+))?", whole, re.I | re.S):
            values = [self.variables.get(v.strip(), v.strip()) for v in m[2].split(",")] if m[2] else params
            return self.sql(self.prepared[m[1]], values)
        return self.run(parse(text, params))

    def run(self, s):
        if isinstance(s, Select):
            self.permit("ExportData" if s.into else "ViewDatabase")
            # what is written goes out whole
            df = self.planner().select(s if s.limit is not None or self.default_limit is None or s.into else _limited(s, self.default_limit))
            return self.export(df, s.into, s.options) if s.into else df
        if isinstance(s, Filter):
            self.permit("ViewDatabase")
            return self.filtered(s)
        if isinstance(s, Insert):
            self.permit("WriteDatabase")
            return self.insert(s)
        if isinstance(s, Update):
            self.permit("WriteDatabase")
            return self.update(s)
        if isinstance(s, Delete):
            self.permit("WriteDatabase")
            self.stored(s.table)
            return self.store.delete(s.table, self.predicate(s.where))
        return self.command(s)

    def export(self, df: DataFrame, target: str, options: dict) -> int:
        """Write a result; returns its rows. With timeout=seconds the job is cancelled after that time; threads=n writes n files at once."""
        more = options | ({"partitions": options["threads"]} if "threads" in options else {})
        if "timeout" not in options:
            return write_into(df, target, more)
        sc, group = self.spark.sparkContext, f"export-{uuid.uuid4()}"
        sc.setJobGroup(group, f"export to {target}", interruptOnCancel=True)
        timer = threading.Timer(float(options["timeout"]), sc.cancelJobGroup, [group])
        timer.start()
        try:
            return write_into(df, target, more)
        finally:
            timer.cancel()
            sc.setLocalProperty("spark.jobGroup.id", None)

    def permit(self, permission: str) -> None:
        self.roles.check(self.user, permission, self.database)

    def stored(self, table: str) -> TableSpec:
        if self.store is None:
            raise NotAllowed(f'Could not find a DataSource for that table "{table}"')
        return self.store.spec(table)

    def predicate(self, where):
        if where is None:
            return None
        return lambda df: self.compiler(df).predicate(where)

    def compiler(self, df: DataFrame) -> Compiler:
        scope = scope_of(df)
        if ROWNUM in df.columns:
            scope.tables[""]["@rownum"] = scope.tables[""][ROWNUM]
        return Compiler(scope, "compat" if self.compat else "standard", database=self.database)

    def insert(self, s: Insert) -> int:
        spec = self.stored(s.table)
        columns = list(s.columns) or [a.name for a in spec.attributes]
        for c in columns:
            if spec.attribute(c) is None:
                raise NotAllowed(f"unknown column {c}")
        if s.query is not None:
            rows = self.planner().select(s.query)
            if len(rows.columns) != len(columns):
                raise NotAllowed(f"{len(columns)} columns, but {len(rows.columns)} values")
            return self.store.insert(s.table, rows.toDF(*columns))
        flat = Compiler(Scope(), "filter")
        rows = []
        for row in s.rows:
            if len(row) != len(columns):
                raise NotAllowed(f"{len(columns)} columns, but {len(row)} values")
            rows.append([x.value if isinstance(x, Literal) else flat.value(x) for x in row])
        if any(isinstance(x, V.Val) for r in rows for x in r):
            parts = [self.spark.range(1).select(*((x.col if isinstance(x, V.Val) else V.literal(x).col).cast("string").alias(c) for c, x in zip(columns, r))) for r in rows]
            df = parts[0]
            for p in parts[1:]:
                df = df.unionByName(p)
            return self.store.insert(s.table, df)
        text = [[None if v is None else str(v).lower() if isinstance(v, bool) else str(v) for v in r] for r in rows]
        df = self.spark.createDataFrame(text, ", ".join(f"`{c}` string" for c in columns))
        return self.store.insert(s.table, df.coalesce(1))

    def update(self, s: Update) -> int:
        self.stored(s.table)
        if s.where is None:
            raise NotAllowed("must provide a predicate")
        flat = Compiler(Scope(), "filter")
        return self.store.update(s.table, {c: flat.value(e) for c, e in s.values}, self.predicate(s.where))

    # the filter language

    def save_filters(self, text: str) -> list[str]:
        """Keep the filters that have an alias, to be included by others."""
        out = []
        for f in parse_filters(text):
            if f.alias:
                self.filters[f.alias] = f
                out.append(f.alias)
        return out

    def condition(self, df: DataFrame, where, now: Column | None = None) -> Column:
        """The filter's column of truth, with filters it includes put in their places."""
        scope = scope_of(df)

        def include(name: str, seen: tuple[str, ...]) -> Column:
            if name not in self.filters:
                raise NotAllowed(f"no filter {name}")
            if name in seen or len(seen) > _DEPTH:
                raise NotAllowed(f"filter {name} includes itself")
            return build((*seen, name)).predicate(self.filters[name].where)

        def build(seen: tuple[str, ...]) -> Compiler:
            return Compiler(scope, "filter", includes=lambda n: include(n, seen), now=now, database=self.database)

        return build(()).predicate(where, sieve=True)

    def filter(self, text: str, df: DataFrame | None = None, now: Column | None = None) -> DataFrame:
        """Rows of df, or of the filter's own FROM, that match."""
        return self.filtered(parse_filters(text)[0], df, now)

    def filtered(self, f: Filter, df: DataFrame | None = None, now: Column | None = None) -> DataFrame:
        if df is None:
            if f.source is None:
                raise NotAllowed("the filter names no table")
            df = self.source(f.source).df
        if f.alias:
            self.filters[f.alias] = f
        out = df.where(self.condition(df, f.where, now))
        if f.limit is not None:
            out = out.limit(f.limit)
        out = out.drop(*HIDDEN)
        if f.items:
            self.views["_filtered"] = out
            try:
                return Planner(self.spark, lambda n: Source(out), False, self.database).select(Select(f.items, source=_table("_filtered")))
            finally:
                del self.views["_filtered"]
        return out

    def routes(self, df: DataFrame, selectors: dict[str, str]) -> dict[str, DataFrame]:
        """Records by the first table whose selector holds; without a selector a table takes none."""
        scope, left, out = scope_of(df), F.lit(True), {}
        for table, selector in selectors.items():
            if not selector:
                continue
            p = Parser(selector)
            hit = Compiler(scope, "filter").predicate(p.expression())
            out[table] = df.where(left & hit)
            left = left & ~hit
        return out

    # commands

    def command(self, s: Command):
        if s.verb in ("COMMIT", "BEGIN", "ROLLBACK"):
            return 0
        if s.verb == "SET":
            for k, v in s.options.items():
                self.variables[k] = v.value if isinstance(v, Literal) else str(v)
            return 0
        if s.verb == "USE":
            self.database = s.name
            return 0
        if s.verb == "SHOW":
            return self.show(s)
        if s.verb == "DESCRIBE":
            return self.columns_of(s.name)
        if s.verb == "EXPLAIN":
            df = self.planner().select(s.body) if s.body is not None else self.source(s.name).df
            plan = df._jdf.queryExecution().explainString(self.spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
            return self.spark.createDataFrame([(x,) for x in plan.splitlines()], "plan string")
        if s.verb == "CREATE":
            self.permit("CreateOrAlterView" if "VIEW" in s.kind else "CreateOrAlterTable")
            return self.create(s)
        if s.verb == "DROP":
            self.permit("CreateOrAlterView" if "VIEW" in s.kind else "CreateOrAlterTable")
            if s.name in self.views:
                del self.views[s.name]
            elif self.store is not None and s.kind == "TABLE":
                self.store.drop(s.name)
            elif not any(s.name == x.split(".")[0] for x in self.views):
                raise NotAllowed(f"there is no {s.kind.lower()} {s.name}")
            self.views = {k: v for k, v in self.views.items() if not k.startswith(s.name + ".")}
            return 0
        self.permit("CreateOrAlterTable")
        self.store.add_column(s.name, Attribute(s.options["column"], _COLUMN_TYPES.get(s.options["type"].upper(), "String")))
        return 0

    def create(self, s: Command) -> int:
        if s.kind in ("SOURCE", "SCHEMA", "DATABASE"):
            if "type" in s.options or "path" in s.options:
                for name, df in readers.open_source(self.spark, s.options).items():
                    self.views[f"{s.name}.{name}"] = df
                    self.views.setdefault(name, df)
            return 0
        if s.kind in ("VIEW", "CONTINUOUSVIEW"):
            if not isinstance(s.body, Select):
                raise NotAllowed("a view needs AS SELECT")
            df = self.planner().select(s.body)
            if s.kind == "CONTINUOUSVIEW" and df.isStreaming:
                return self.keep(s.name, df, s.options)
            self.views[s.name] = df
            return 0
        if isinstance(s.body, Select):
            df = self.planner().select(s.body)
            kinds = {"bigint": "Integer", "int": "Integer", "double": "Float", "boolean": "Boolean", "date": "Date", "timestamp": "DateTime"}
            spec = TableSpec(s.name, tuple(Attribute(f.name, kinds.get(f.dataType.simpleString(), "String")) for f in df.schema.fields), (df.columns[0],))
            self.store.create(spec)
            return self.store.insert(s.name, df)
        columns = s.body or ()
        keys = tuple(n for n, _, key, _ in columns if key) or tuple(n for n, *_ in columns[:1])
        self.store.create(TableSpec(s.name, tuple(Attribute(n, _COLUMN_TYPES.get(t.upper(), "String"), required=nn) for n, t, _, nn in columns), keys))
        return 0

    def keep(self, name: str, df: DataFrame, options: dict) -> int:
        """A continuous view: a streaming query whose result is kept in files, and read from them. Options: path, mode (append;
        complete for aggregates), interval; without an interval it takes in what is there and ends."""
        from tallyforge.streaming.ingest import continuous_view

        path = str(options.get("path") or f"{self.store.root}/_views/{name}")
        self.streams[name] = continuous_view(df, f"{path}/data", f"{path}/checkpoint", str(options.get("mode", "append")), options.get("interval"))
        schema = df.schema
        self.lazy[name] = lambda: self.spark.read.schema(schema).parquet(f"{path}/data")
        return 0

    # metadata

    def tables(self) -> list[str]:
        return sorted({*self.views, *(self.store.tables() if self.store is not None else [])} - {"_filtered"})

    def columns_of(self, name: str) -> DataFrame:
        df = self.source(name).df.drop(*HIDDEN)
        key = self.store.spec(name).key if self.store is not None and name in self.store.tables() else ()
        rows = [(f.name, f.dataType.simpleString(), "NO" if f.name in key else "YES", "PRI" if f.name in key else "", None, "") for f in df.schema.fields]
        return self.spark.createDataFrame(rows, "Field string, Type string, `Null` string, `Key` string, `Default` string, Extra string")

    def information(self, what: str) -> DataFrame | None:
        if what == "tables":
            return self.spark.createDataFrame([(self.database, t, "BASE TABLE") for t in self.tables()] or [], "Database string, Table string, Table_type string")
        if what in ("databases", "schemata"):
            return self.spark.createDataFrame([(d,) for d in sorted({self.database, *(v.split(".")[0] for v in self.views if "." in v)})], "Database string")
        if what == "columns":
            rows = [(t, f.name, f.dataType.simpleString()) for t in self.tables() for f in self.source(t).df.drop(*HIDDEN).schema.fields]
            return self.spark.createDataFrame(rows, "Table string, Field string, Type string")
        if what == "variables":
            known = {"version": "8.0.12", "max_allowed_packet": "4194304", "autocommit": "1", "tx_isolation": "READ-COMMITTED", "time_zone": self.spark.conf.get("spark.sql.session.timeZone")}
            return self.spark.createDataFrame([(k, str(v)) for k, v in {**known, **self.variables}.items()], "Variable_name string, Value string")
        if what == "status":
            return self.spark.createDataFrame([("Uptime", "0"), ("Threads_running", str(self.spark.sparkContext.defaultParallelism))], "Variable_name string, Value string")
        if what == "engines":
            return self.spark.createDataFrame([("spark", "DEFAULT", "Parquet tables")], "Engine string, Support string, Comment string")
        if what in ("procedure", "procedures", "function", "functions"):
            lookup("now")
            return self.spark.createDataFrame([(self.database, n, "FUNCTION") for n in sorted(REGISTRY)], "Db string, Name string, Type string")
        if what in ("indexes", "index", "keys"):
            rows = []
            for t in self.store.tables() if self.store is not None else []:
                spec = self.store.spec(t)
                rows += [(t, 0, "PRIMARY", i + 1, k) for i, k in enumerate(spec.key)]
                rows += [(t, 0, "+".join(s), i + 1, k) for s in spec.secondary_keys for i, k in enumerate(s)]
            return self.spark.createDataFrame(rows, "Table string, Non_unique int, Key_name string, Seq_in_index int, Column_name string")
        return None

    def show(self, s: Command) -> DataFrame:
        kind = s.kind.lower()
        if kind == "create table":
            cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.source(s.name).df.drop(*HIDDEN).schema.fields)
            return self.spark.createDataFrame([(s.name, f"CREATE TABLE `{s.name}` ({cols})")], "Table string, `Create Table` string")
        if kind in ("columns", "fields"):
            out = self.columns_of(s.name)
        else:
            out = self.information(kind)
            if out is None:
                raise NotAllowed(f"cannot show {kind}")
            if kind in ("indexes", "index", "keys") and s.name:
                out = out.where(F.col("Table") == s.name)
            if kind == "tables":
                out = out.select("Table", "Table_type") if s.options["full"] else out.select("Table")
        if s.options.get("like"):
            out = out.where(F.col(f"`{out.columns[0]}`").rlike(V.glob(s.options["like"])))
        return out.where(Compiler(scope_of(out), "standard").predicate(s.body)) if s.body is not None else out


def _limited(s: Select, n: int) -> Select:
    from dataclasses import replace

    return replace(s, limit=n)


def _table(name: str):
    from tallyforge.plans.syntax import Table

    return Table(name)


