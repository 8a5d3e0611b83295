"""Sources: CSV, JSON lines, Parquet and rows in memory; files in order or in partitions; other databases by JDBC."""

from __future__ import annotations

import os
import zlib
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyforge.sources.sqlite import sqlite

READERS: dict[str, Callable[[SparkSession, dict], dict[str, DataFrame]]] = {}


def register_source(kind: str, open_: Callable[[SparkSession, dict], dict[str, DataFrame]]) -> None:
    """A source of one's own: options in, tables by name out."""
    READERS[kind.lower()] = open_


def open_source(spark: SparkSession, options: dict) -> dict[str, DataFrame]:
    kind = str(options.get("type", options.get("format", ""))).lower() or _kind(str(options.get("path", "")))
    if kind not in READERS:
        raise ValueError(f"no source {kind}")
    return READERS[kind](spark, options)


def _kind(path: str) -> str:
    return os.path.splitext(path)[1].lstrip(".").lower()


def _name(options: dict) -> str:
    return str(options.get("table") or os.path.splitext(os.path.basename(str(options["path"]).rstrip("/")))[0].replace("*", "all"))


def csv(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None, delimiter: str = ",", infer: bool = False) -> DataFrame:
    """The first row names the columns; values are text unless a schema is given or inferred."""
    reader = spark.read.option("header", True).option("sep", delimiter).option("multiLine", True).option("escape", '"')
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", infer).csv(path)


def json_lines(spark: SparkSession, path: str | list[str], schema: T.StructType | str | None = None) -> DataFrame:
    return spark.read.schema(schema).json(path) if schema is not None else spark.read.json(path)


def rows(spark: SparkSession, data: list[tuple], columns: list[str]) -> DataFrame:
    """A table in memory; values are text where a column's kinds differ."""
    kinds = [{type(r[i]) for r in data if r[i] is not None} for i in range(len(columns))]
    names = {int: "bigint", float: "double", bool: "boolean", str: "string"}
    types = [names.get(next(iter(k)), "string") if len(k) == 1 else "double" if k == {int, float} else "string" for k in kinds]
    fix = {"string": str, "double": float}
    made = [tuple(None if v is None else fix.get(t, lambda x: x)(v) for v, t in zip(r, types)) for r in data]
    return spark.createDataFrame(made, ", ".join(f"`{c}` {t}" for c, t in zip(columns, types)))


def partition_of(name: str, n: int) -> int:
    """The partition of n that a file falls into, by its name."""
    return zlib.crc32(name.encode()) % n


def files(spark: SparkSession, folder: str, suffix: str = "", partition: int | None = None, of: int = 1) -> list[str]:
    """Files below a folder of any file system Spark knows, in order; with a partition only its share."""
    root = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    base, found, every = fs.makeQualified(root).toString().rstrip("/") + "/", [], fs.listFiles(root, True)
    while every.hasNext():
        path = every.next().getPath()
        if path.getName().endswith(suffix) and not path.getName().startswith(("_", ".")):
            found.append(path.toString())
    return [f for f in sorted(found) if partition is None or partition_of(f.removeprefix(base), of) == partition]


def pages(spark: SparkSession, paths: list[str], read: Callable[[SparkSession, str], DataFrame] | None = None) -> Iterator[DataFrame]:
    """One file after another."""
    for p in paths:
        yield read(spark, p) if read is not None else open_source(spark, {"path": p}).popitem()[1]


def fitting_schema(df: DataFrame) -> T.StructType:
    """Types that all text rows fit: whole, number, boolean, timestamp, else text; a column without values is text."""
    fits = {"bigint": r"^[-+]?\d{1,18}$", "double": r"^[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?$", "boolean": r"^(?i:true|false)$", "timestamp": r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?Z?)?$"}
    wanted = [F.coalesce(F.bool_and(F.col(f"`{c}`").cast("string").rlike(p)), F.lit(False)).alias(f"{i}_{t}") for i, c in enumerate(df.columns) for t, p in fits.items()]
    got = df.agg(*wanted).first() if df.columns else {}
    kinds = [next((t for t in fits if got[f"{i}_{t}"]), "string") for i in range(len(df.columns))]
    return T.StructType([T.StructField(c, T._parse_datatype_string(k)) for c, k in zip(df.columns, kinds)])


def jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A table of another database; its filters and columns are pushed down. The driver's jar must be on the class path."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def csv_to_parquet(spark: SparkSession, source: str, target: str, infer: bool = True, delimiter: str = ",") -> None:
    csv(spark, source, None, delimiter, infer).write.mode("overwrite").option("compression", "snappy").parquet(target)


register_source("csv", lambda s, o: {_name(o): csv(s, o["path"], delimiter=o.get("delimiter", ","))})
register_source("json", lambda s, o: {_name(o): json_lines(s, o["path"])})
register_source("parquet", lambda s, o: {_name(o): s.read.parquet(o["path"])})
register_source("orc", lambda s, o: {_name(o): s.read.orc(o["path"])})
register_source("sqlite", lambda s, o: {str(o["table"]): sqlite(s, o["path"], str(o["table"]))})
register_source("jdbc", lambda s, o: {str(o["table"]): jdbc(s, o["url"], str(o["table"]))})
