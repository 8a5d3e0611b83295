"""SQLite files as a Spark data source: read by the workers in ranges of row ids, with columns and simple filters pushed down."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual

from tallyforge.session import ship

_KINDS = (("INT", T.LongType()), ("CHAR", T.StringType()), ("TEXT", T.StringType()), ("CLOB", T.StringType()), ("REAL", T.DoubleType()), ("FLOA", T.DoubleType()), ("DOUB", T.DoubleType()), ("BLOB", T.BinaryType()))
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class SqliteReader(DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType):
        self.path, self.table, self.schema = options["path"], options["table"], schema
        self.parts = max(1, int(options.get("partitions", 8)))
        self.where: list[str] = []
        self.values: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Comparisons of a column with a literal, and null tests, are left to SQLite; the rest is given back."""
        for f in filters:
            attribute = getattr(f, "attribute", ())
            if len(attribute) == 1 and type(f) in _COMPARE and isinstance(f.value, (int, float, str)) and not isinstance(f.value, bool):
                self.where.append(f"{_quoted(attribute[0])} {_COMPARE[type(f)]} ?")
                self.values.append(f.value)
            elif len(attribute) == 1 and isinstance(f, (IsNull, IsNotNull)):
                self.where.append(f"{_quoted(attribute[0])} IS {'NOT ' if isinstance(f, IsNotNull) else ''}NULL")
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        with _connect(self.path) as c:
            low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
        if low is None:
            return [RowRange(0, 0)]
        step = -(-(high - low + 1) // self.parts)
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: RowRange) -> Iterator[tuple]:
        columns = ", ".join(_quoted(f.name) for f in self.schema.fields)
        where = " AND ".join(["rowid >= ? AND rowid < ?", *self.where])
        casts = [{T.LongType: int, T.DoubleType: float, T.StringType: str, T.BinaryType: bytes}[type(f.dataType)] for f in self.schema.fields]
        with _connect(self.path) as c:
            for row in c.execute(f"SELECT {columns} FROM {_quoted(self.table)} WHERE {where}", (partition.low, partition.high, *self.values)):
                yield tuple(None if v is None else f(v) for f, v in zip(casts, row))


class SqliteSource(DataSource):
    """Options: path of a file that all workers can read, table, partitions."""

    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        with _connect(self.options["path"]) as c:
            found = c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        if not found:
            raise ValueError(f"there is no table {self.options['table']}")
        return T.StructType([T.StructField(r[1], next((t for k, t in _KINDS if k in (r[2] or "").upper()), T.StringType())) for r in found])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(dict(self.options), schema)


def sqlite(spark: SparkSession, path: str, table: str, partitions: int = 8) -> DataFrame:
    """A table of an SQLite file. Values that don't fit their column's declared type end the query."""
    ship(spark)
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("sqlite").options(path=path, table=table, partitions=str(partitions)).load()
