"""Where results go: files in CSV or Parquet, tables, and sinks of one's own, by the scheme of the target."""

from __future__ import annotations

from collections.abc import Callable
from urllib.parse import urlparse

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SINKS: dict[str, Callable[[DataFrame, str, dict], None]] = {}


def sink(*schemes: str):
    def put(f):
        for s in schemes:
            SINKS[s] = f
        return f

    return put


def register_sink(scheme: str, write: Callable[[DataFrame, str, dict], None]) -> None:
    SINKS[scheme.lower()] = write


def _flat(df: DataFrame) -> DataFrame:
    """Every column as text; lists with semicolons between."""
    return df.select(*((F.array_join(F.col(f"`{f.name}`").cast("array<string>"), ";") if isinstance(f.dataType, T.ArrayType) else F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (T.MapType, T.StructType)) else F.col(f"`{f.name}`").cast("string")).alias(f.name) for f in df.schema.fields))


@sink("", "file", "s3", "s3a", "hdfs", "gs")
def to_files(df: DataFrame, target: str, options: dict) -> None:
    """CSV with a header, tabs between and values trimmed, or Parquet of text columns. Options: format, delimiter, partitions."""
    url = "s3a" + target[2:] if target.startswith("s3://") else target
    flat = _flat(df)
    if "partitions" in options:
        flat = flat.repartition(int(options["partitions"]))
    kind = str(options.get("format", "csv")).lower()
    if kind == "parquet":
        flat.write.mode("overwrite").option("compression", "snappy").parquet(url)
    elif kind == "csv":
        trimmed = flat.select(*(F.trim(F.col(f"`{c}`")).alias(c) for c in flat.columns))
        trimmed.write.mode("overwrite").option("header", True).option("sep", str(options.get("delimiter", "\t"))).csv(url)
    else:
        raise ValueError(f"no format {kind}")


@sink("table")
def to_table(df: DataFrame, target: str, options: dict) -> None:
    df.write.mode(options.get("mode", "overwrite")).saveAsTable(urlparse(target).netloc or target.split("://")[-1])


def write_into(df: DataFrame, target: str, options: dict) -> int:
    """Write to the sink of the target's scheme; a bare name is a table. Returns the rows."""
    scheme = urlparse(target).scheme.lower()
    if not scheme and "/" not in target:
        scheme = "table"
    if scheme not in SINKS:
        raise ValueError(f"no sink for {scheme}://")
    from pyspark.sql import Observation

    seen = Observation()
    SINKS[scheme](df.observe(seen, F.count(F.lit(1)).alias("n")), target, options)
    return seen.get["n"]
