"""Tables kept as partitioned Parquet: inserts that update by key, updates and deletes by predicate, partitions, evolution.

A table is a folder of partitions: by day or hour of its time field, else by a hash of its primary key into buckets that grow
in number with the table. A change reads and rewrites only the partitions it touches, in one job; partitions that it empties
get a mark in that job, which readers skip, and are cleared away afterwards. A partition is written by as many tasks as its
size asks for.
"""

from __future__ import annotations

import json
from dataclasses import asdict, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.mappers import map_column, rejected
from tallyforge.plans import values as V
from tallyforge.plans.compiler import Compiler, NotAllowed, Scope, UnknownColumn, scope_of
from tallyforge.plans.parser import parse_expression
from tallyforge.plans.values import Val
from tallyforge.session import checkpoint_bytes, checkpointed, release
from tallyforge.types import Attribute, BadSchema, TableSpec

PART, ROWNUM = "_part", "_rownum"
#: A bucket is to hold about as many bytes; with more than four times as many in the mean, their number grows.
BUCKET_BYTES = 1 << 30
MOST_BUCKETS = 1 << 16
#: Touched partitions are named in a filter up to so many, beyond that joined.
MOST_NAMED = 1000


class Rejected(ValueError):
    """Rows could not be taken."""


class TableStore:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark._jvm
        self._specs: dict[str, TableSpec] = {}

    # files, on whatever file system the root is

    def _path(self, *parts: str):
        return self._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _exists(self, *parts: str) -> bool:
        p = self._path(*parts)
        return self._fs(p).exists(p)

    def _remove(self, *parts: str) -> None:
        p = self._path(*parts)
        self._fs(p).delete(p, True)

    def _children(self, *parts: str) -> list[str]:
        p = self._path(*parts)
        return sorted(s.getPath().getName() for s in self._fs(p).listStatus(p)) if self._fs(p).exists(p) else []

    def _write_text(self, text: str, *parts: str) -> None:
        p = self._path(*parts)
        out = self._fs(p).create(p, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()

    def _read_text(self, *parts: str) -> str:
        p = self._path(*parts)
        stream = self._fs(p).open(p)
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    # specifications

    def tables(self) -> list[str]:
        return [t for t in self._children() if self._exists(t, "spec.json")]

    def spec(self, name: str) -> TableSpec:
        hit = next((t for t in (*self._specs, *self.tables()) if t.lower() == name.lower()), None)
        if hit is None:
            raise NotAllowed(f'Could not find a DataSource for that table "{name}"')
        if hit not in self._specs:
            d = json.loads(self._read_text(hit, "spec.json"))
            attributes = tuple(Attribute(**(a | {"options": tuple((k, v) for k, v in a["options"])})) for a in d.pop("attributes"))
            d |= {"primary_key": tuple(d["primary_key"]), "secondary_keys": tuple(map(tuple, d["secondary_keys"]))}
            self._specs[hit] = TableSpec(attributes=attributes, **d)
        return self._specs[hit]

    def _save(self, spec: TableSpec) -> None:
        self._write_text(json.dumps(asdict(spec)), spec.name, "spec.json")
        self._specs[spec.name] = spec

    def create(self, spec: TableSpec, confirm: bool = True) -> list[str]:
        """Create a table, or change an existing one as far as that is allowed. Returns what changed."""
        spec.validate()
        for a in spec.attributes:
            parent = a.foreign_key.split(".")[0]
            if parent and parent != spec.name and not self._exists(parent, "spec.json"):
                raise BadSchema(f"{spec.name}.{a.name}: there is no parent table {parent}")
        changes = []
        if self._exists(spec.name, "spec.json"):
            changes = self.spec(spec.name).compare(spec)
            if changes and not confirm:
                raise BadSchema(f"{spec.name}: confirm these changes: {', '.join(changes)}")
        self._save(spec)
        return changes

    def add_column(self, table: str, a: Attribute) -> None:
        self._save(self.spec(table).with_column(a))

    def drop(self, table: str) -> None:
        spec = self.spec(table)
        for t in self.tables():
            if t != spec.name and any(a.foreign_key.split(".")[0] == spec.name for a in self.spec(t).attributes):
                raise BadSchema(f"{spec.name}: {t} refers to it")
        self._remove(spec.name)
        self._specs.pop(spec.name, None)

    def truncate(self, table: str) -> None:
        spec = self.spec(table)
        self._remove(spec.name, spec.folder)

    # reading

    def _stored(self, spec: TableSpec) -> T.StructType:
        return T.StructType([*spec.schema.fields, T.StructField(ROWNUM, T.LongType()), T.StructField(PART, T.StringType())])

    def _raw(self, spec: TableSpec) -> DataFrame:
        schema = self._stored(spec)
        if not self._exists(spec.name, spec.folder):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(self._data(spec)).where(F.col(ROWNUM).isNotNull())

    def _data(self, spec: TableSpec) -> str:
        return f"{self.root}/{spec.name}/{spec.folder}"

    def read(self, table: str, start: object = None, end: object = None, internal: bool = False) -> DataFrame:
        """The table's rows; of a partitioned one only those of the partitions from start to end."""
        spec = self.spec(table)
        if spec.view_of:
            return self.read(spec.view_of, start, end, internal)
        df = self._raw(spec)
        if spec.quantum:
            for bound, ok in ((start, F.col(PART) >= self._part_of(spec, F.lit(start).cast("timestamp"))), (end, F.col(PART) <= self._part_of(spec, F.lit(end).cast("timestamp")))):
                if bound is not None:
                    df = df.where(ok)
        return df if internal else df.drop(PART, ROWNUM)

    @staticmethod
    def _part_of(spec: TableSpec, t: Column) -> Column:
        return F.date_format(t, "yyyy-MM-dd" if spec.quantum == "YMD" else "yyyy-MM-dd'T'HH")

    def _part(self, spec: TableSpec) -> Column:
        if spec.quantum:
            return F.coalesce(self._part_of(spec, F.col(f"`{spec.quantum_field}`").cast("timestamp")), F.lit("none"))
        return self._bucket(spec, *(F.col(f"`{k}`") for k in spec.key))

    @staticmethod
    def _bucket(spec: TableSpec, *key: Column) -> Column:
        return F.lpad(F.pmod(F.xxhash64(*(k.cast("string") for k in key)), F.lit(spec.buckets)).cast("string"), 5, "0")

    def rebucket(self, table: str, buckets: int) -> None:
        """Spread a table's rows over another number of buckets. They are written beside the old ones; the specification, which
        names the folder, is what changes over."""
        spec = self.spec(table)
        if spec.quantum or buckets == spec.buckets:
            return
        new = replace(spec, buckets=buckets, folder=f"data-{buckets}")
        self._remove(new.name, new.folder)
        if self._exists(spec.name, spec.folder):
            self._write(new, self._raw(spec).withColumn(PART, self._part(new)))
        self._save(new)
        self._remove(spec.name, spec.folder)

    def _grown(self, spec: TableSpec, size: int) -> int:
        """The number of buckets for so many bytes."""
        if spec.quantum or size <= 4 * BUCKET_BYTES * spec.buckets:
            return spec.buckets
        return min(MOST_BUCKETS, max(spec.buckets, 1 << (size // BUCKET_BYTES).bit_length()))

    def _size(self, spec: TableSpec) -> int:
        p = self._path(spec.name, spec.folder)
        return self._fs(p).getContentSummary(p).getLength() if self._fs(p).exists(p) else 0

    def partition_filter(self, table: str, low: Column | None, high: Column | None) -> Column:
        """A predicate on partitions that follows from bounds of the time field."""
        spec, out = self.spec(table), F.lit(True)
        if spec.quantum and low is not None:
            out &= F.col(PART) >= self._part_of(spec, low)
        if spec.quantum and high is not None:
            out &= F.col(PART) <= self._part_of(spec, high)
        return out

    def partitions(self, table: str) -> DataFrame:
        """Partition, rows, least and greatest row number."""
        return self._raw(self.spec(table)).groupBy(PART).agg(F.count(F.lit(1)).alias("n_rows"), F.min(ROWNUM).alias("first_row"), F.max(ROWNUM).alias("last_row")).withColumnRenamed(PART, "partition")

    def purge(self, table: str, before: str) -> list[str]:
        """Drop partitions that lie wholly before a day or hour. Returns their names."""
        spec = self.spec(table)
        if not spec.quantum:
            raise NotAllowed(f"{table} has no partitions by time")
        gone = [p for p in self._part_names(spec) if p != "none" and p < before[: len(p)]]
        for p in gone:
            self._remove(spec.name, spec.folder, f"{PART}={p}")
        return gone

    def _part_names(self, spec: TableSpec) -> list[str]:
        from urllib.parse import unquote

        return [unquote(x.split("=", 1)[1]) for x in self._children(spec.name, spec.folder) if x.startswith(f"{PART}=")]

    # writing

    def mapped(self, spec: TableSpec, rows: DataFrame, given: set[str], strict: bool = True) -> DataFrame:
        """Source rows as the table's columns: mapped, defaulted, checked. Bad rows raise, or are left out if not strict."""
        scope = scope_of(rows)
        compiler = Compiler(scope, "filter")
        columns, problems, own = [], [], {}
        for a in spec.attributes:
            path = [p for p in (a.source or a.name).strip("/").split("/") if p]
            v = scope.find(tuple(path)) or scope.find((a.name,)) or V.null()
            c = map_column(v, a) if not v.is_null else F.lit(None).cast(a.spark_type)
            if not v.is_null:
                problems.append(rejected(v, a))
            own[a.name] = (v, c)
        for a in spec.attributes:
            v, c = own[a.name]
            if a.default is not None:
                d = self._default(a, compiler, own)
                c = F.coalesce(c, d)
            if a.required or a.name in spec.primary_key:
                problems.append(F.when(c.isNull(), f"{a.name}: a value is required"))
            columns.append(c.alias(a.name))
        problem = F.coalesce(*problems) if problems else F.lit(None).cast("string")
        checked = rows.select(*columns, problem.alias("_problem"))
        if strict:
            bad = checked.where("_problem is not null").select("_problem").take(1)
            if bad:
                raise Rejected(bad[0][0])
        return checked.where("_problem is null").drop("_problem")

    @staticmethod
    def _default(a: Attribute, compiler: Compiler, own: dict) -> Column:
        if isinstance(a.default, str):
            tree = parse_expression(a.default)
            known = {n: Val(c, v.type if not v.is_null else T.StringType()) for n, (v, c) in own.items()}
            inner = Compiler(Scope({"": {**known, **compiler.scope.every()}}), "filter", now=compiler.now)
            return map_column(inner.value(tree), a)
        return map_column(V.literal(a.default), a)

    def _first_row(self, spec: TableSpec) -> int:
        """The next free row number, from the file it is kept in; tables without one are looked through once."""
        if self._exists(spec.name, "next_row"):
            return int(self._read_text(spec.name, "next_row"))
        return int(self._raw(spec).agg(F.max(ROWNUM)).first()[0] or 0) + 1

    def _with_parents(self, spec: TableSpec, rows: DataFrame, strict: bool) -> DataFrame:
        """Rows whose foreign keys are missing or name a parent; others raise if strict, else are left out."""
        for a in spec.attributes:
            parent, _, column = a.foreign_key.partition(".")
            if not parent:
                continue
            owner = self.spec(parent)
            column = column or owner.primary_key[0]
            known = self._raw(owner) if not owner.view_of else self.read(parent)
            if owner.key == (column,) and not owner.quantum and not owner.view_of:  # only buckets that the keys fall into
                named = [r[0] for r in rows.where(F.col(f"`{a.name}`").isNotNull()).select(self._bucket(owner, F.col(f"`{a.name}`"))).distinct().collect()]
                known = self._among(known, named)
            keys = known.select(F.col(f"`{column}`").cast("string").alias("_key"))
            there = F.col(f"`{a.name}`").cast("string") == F.col("_key")
            if strict:
                lost = rows.where(F.col(f"`{a.name}`").isNotNull()).join(keys, there, "left_anti").select(a.name).take(1)
                if lost:
                    raise Rejected(f"{a.name}: there is no {parent} {lost[0][0]}")
            else:
                rows = rows.where(F.col(f"`{a.name}`").isNull()).unionByName(rows.join(keys, there, "left_semi"))
        return rows

    def insert(self, table: str, rows: DataFrame, strict: bool = True) -> int:
        """Insert rows, or update those whose primary key is there: columns that the source has take its values, others stay;
        columns that keep several values gain them. Of equal keys in one call the last counts. Foreign keys must name a row of
        their parent. Returns the rows written."""
        spec = self.spec(table)
        given = {c.lower() for c in rows.columns}
        has = [a for a in spec.attributes if a.name.lower() in given or (a.source.strip("/").split("/")[0].lower() in given if a.source else False)]
        numbered = rows.withColumn("_order", F.monotonically_increasing_id())
        fresh = self.mapped(_with_order(spec), numbered, given, strict)
        keys = list(spec.key)
        last = fresh.groupBy(*keys).agg(F.max_by(F.struct(*(c for c in fresh.columns if c not in keys)), "_order").alias("_v"))
        names = [a.name for a in spec.attributes]
        incoming = last.select(*(F.col(f"`{n}`") if n in keys else F.col(f"_v.`{n}`").alias(n) for n in names), F.col("_v._order").alias("_order"))
        kept = checkpointed(incoming)
        incoming = self._with_parents(spec, kept, strict)
        self.rebucket(spec.name, self._grown(spec, self._size(spec) + checkpoint_bytes(kept)))
        spec = self.spec(table)
        incoming = incoming.withColumn(PART, self._part(spec))
        seen = incoming.groupBy(PART).agg(F.count(F.lit(1)).alias("n"), F.max("_order").alias("last")).collect()  # at most the table's partitions
        touched = [r[0] for r in seen]
        if not touched:
            release(kept)
            return 0
        old = self._among(self._raw(spec), touched)
        base = self._first_row(spec)
        self._write_text(str(base + max(r["last"] for r in seen) + 1), spec.name, "next_row")
        o, n = old.alias("o"), incoming.alias("n")
        on = [F.col(f"o.`{k}`").eqNullSafe(F.col(f"n.`{k}`")) for k in keys]
        both = n.join(o, [F.col(f"o.{PART}") == F.col(f"n.{PART}"), *on], "full")
        taken = F.col("n._order").isNotNull()
        known = F.col(f"o.{ROWNUM}").isNotNull()
        cols = []
        for a in spec.attributes:
            mine, theirs = F.col(f"n.`{a.name}`"), F.col(f"o.`{a.name}`")
            if a in has or a.name in keys:
                new = F.when(mine.isNull(), theirs).when(theirs.isNull(), mine).otherwise(F.array_union(theirs, mine)) if a.multi else mine
            else:
                new = theirs
            cols.append(F.when(taken & known, new).when(taken, mine).otherwise(theirs).alias(a.name))
        merged = both.select(*cols, F.col(f"o.{ROWNUM}").alias(ROWNUM), F.coalesce(F.col(f"n.{PART}"), F.col(f"o.{PART}")).alias(PART), F.col("n._order").alias("_order"))
        merged = merged.withColumn(ROWNUM, F.coalesce(F.col(ROWNUM), F.lit(base) + F.col("_order"))).drop("_order")
        self._replace(spec, merged, touched)
        release(kept)
        return sum(r["n"] for r in seen)

    def _among(self, df: DataFrame, parts: list[str]) -> DataFrame:
        """Rows of these partitions."""
        if len(parts) <= MOST_NAMED:
            return df.where(F.col(PART).isin(parts))
        return df.join(self.spark.createDataFrame([(p,) for p in parts], f"{PART} string"), PART, "left_semi")

    def _replace(self, spec: TableSpec, rows: DataFrame, touched: list[str]) -> None:
        """Put rows in the place of the touched partitions."""
        kept = checkpointed(rows)
        left = {r[0] for r in kept.select(PART).distinct().collect()}
        emptied = [(p,) for p in touched if p not in left]
        marks = self.spark.createDataFrame(emptied, f"{PART} string")
        self._write(spec, kept.unionByName(marks, allowMissingColumns=True) if emptied else kept)
        release(kept)
        for (p,) in emptied:
            self._remove(spec.name, spec.folder, f"{PART}={p}")

    def _write(self, spec: TableSpec, rows: DataFrame) -> None:
        """One job. Large partitions are split among tasks, small ones share one (adaptive execution)."""
        rows.hint("rebalance", PART).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(self._data(spec))

    def _matching(self, spec: TableSpec, df: DataFrame, predicate: Column) -> list[str]:
        return [r[0] for r in df.where(predicate).select(PART).distinct().collect()]

    def update(self, table: str, values: dict[str, Val], predicate) -> int:
        """Set columns to the values (of literals) in rows that match; returns their number. Columns that keep several values
        gain the new one; null clears them. Keys can't be set."""
        spec = self.spec(table)
        if predicate is None:
            raise NotAllowed("must provide a predicate")
        for name in values:
            if spec.attribute(name) is None:
                raise UnknownColumn(f"unknown column {name}")
            if spec.attribute(name).name in spec.key:
                raise NotAllowed(f"cannot update the primary key column {name}")
        df = self._raw(spec)
        hit = F.coalesce(predicate(df), F.lit(False))
        touched = self._matching(spec, df, hit)
        if not touched:
            return 0
        old = self._among(df, touched).withColumn("_hit", hit)
        cols = []
        by = {k.lower(): v for k, v in values.items()}
        for a in spec.attributes:
            c = F.col(f"`{a.name}`")
            if a.name.lower() in by:
                v = by[a.name.lower()]
                new = map_column(v, a) if not v.is_null else F.lit(None).cast(a.spark_type)
                if not v.is_null and (message := self.spark.range(1).select(rejected(v, a)).first()[0]):
                    raise Rejected(message)
                if a.multi and not v.is_null:
                    new = F.array_union(F.coalesce(c, F.array().cast(a.spark_type)), new)
                c = F.when(F.col("_hit"), new).otherwise(c)
            cols.append(c.alias(a.name))
        n = old.where("_hit").count()
        self._replace(spec, old.select(*cols, ROWNUM, PART), touched)
        return n

    def delete(self, table: str, predicate) -> int:
        """Delete rows that match; returns their number. A predicate must be given."""
        spec = self.spec(table)
        if predicate is None:
            raise NotAllowed("must provide a predicate")
        df = self._raw(spec)
        hit = F.coalesce(predicate(df), F.lit(False))
        touched = self._matching(spec, df, hit)
        if not touched:
            return 0
        old = self._among(df, touched)
        n = old.where(hit).count()
        self._replace(spec, old.where(~hit), touched)
        return n

    # keys

    def find(self, table: str, key: dict[str, object]) -> DataFrame:
        """Rows by a primary or secondary key."""
        spec = self.spec(table)
        if tuple(key) not in (spec.primary_key, spec.key, *spec.secondary_keys):
            raise NotAllowed(f"{', '.join(key)} is no key of {table}")
        df = self._raw(spec)
        for k, v in key.items():
            df = df.where(F.col(f"`{k}`") == F.lit(v))
        if set(key) == set(spec.key) and not spec.quantum:  # the key tells the bucket
            row = self.spark.range(1).select(*(F.lit(v).cast(spec.attribute(k).spark_type).alias(k) for k, v in key.items())).select(self._part(spec)).first()
            df = df.where(F.col(PART) == row[0])
        return df.drop(PART)

    def verify(self, table: str) -> dict[str, int]:
        """Rows, keys that are there twice, rows in a partition that isn't theirs, and per foreign key rows without a parent."""
        spec = self.spec(table)
        df = self._raw(spec)
        out = {"rows": df.count(), "repeated_keys": df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").count(), "misplaced": df.where(F.col(PART) != self._part(spec)).count()}
        return out | {f"orphans of {k}": v.count() for k, v in self.orphans(table).items()}

    def repair(self, table: str) -> int:
        """Put rows that verify finds misplaced where they belong, and of rows with one key keep the one numbered last. Returns the
        rows that were misplaced or too many."""
        spec = self.spec(table)
        df = self._raw(spec).withColumn("_own", self._part(spec))
        many = df.groupBy(*spec.key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
        same = [F.col(f"d.`{k}`").eqNullSafe(F.col(f"m.`{k}`")) for k in spec.key]
        repeated = df.alias("d").join(many.alias("m"), same, "left_semi")
        bad = repeated.unionByName(df.where(F.col(PART) != F.col("_own"))).select(F.explode(F.array(PART, "_own")).alias("p"))
        touched = [r[0] for r in bad.distinct().collect()]  # at most the table's partitions
        if not touched:
            return 0
        here = self._among(df, touched)
        rest = [c for c in df.columns if c not in (*spec.key, PART, "_own")]
        last = here.groupBy(*spec.key).agg(F.max_by(F.struct(*rest, "_own"), ROWNUM).alias("_v"), F.count(F.lit(1)).alias("_n"), F.sum((F.col(PART) != F.col("_own")).cast("bigint")).alias("_off"))
        last = checkpointed(last)
        wrong = last.agg(F.sum(F.greatest(F.col("_n") - 1, F.col("_off")))).first()[0]
        fixed = last.select(*spec.key, "_v.*").withColumnRenamed("_own", PART)
        self._replace(spec, fixed.select(*(a.name for a in spec.attributes), ROWNUM, PART), touched)
        release(last)
        return int(wrong or 0)

    def status(self) -> DataFrame:
        """Of every table: its partitions and bytes, and the specification that holds, as JSON."""
        rows = [(t, len(self._part_names(s)), self._size(s), json.dumps(asdict(s))) for t in self.tables() for s in [self.spec(t)]]
        return self.spark.createDataFrame(rows, "table string, partitions int, bytes bigint, specification string")

    def refresh(self) -> None:
        """Forget what is known of specifications and files, after others changed them."""
        self._specs.clear()
        for t in self.tables():
            self.spark.catalog.refreshByPath(self._data(self.spec(t)))

    def orphans(self, table: str) -> dict[str, DataFrame]:
        """By foreign key column, the rows whose parent is missing."""
        spec, out = self.spec(table), {}
        for a in spec.attributes:
            if a.foreign_key:
                parent, _, column = a.foreign_key.partition(".")
                keys = self.read(parent).select(F.col(f"`{column or self.spec(parent).primary_key[0]}`").alias("_k"))
                out[a.name] = self.read(table).where(F.col(f"`{a.name}`").isNotNull()).join(keys, F.col(f"`{a.name}`") == F.col("_k"), "left_anti")
        return out


def _with_order(spec: TableSpec) -> TableSpec:
    """The specification with the order of arrival as one more column."""
    return TableSpec(spec.name, (*spec.attributes, Attribute("_order", "Integer", "ParentRelation")), spec.primary_key, spec.secondary_keys, spec.quantum_field, spec.quantum)
