"""Streaming ingest: records are decoded, routed to tables by their selectors, and merged by key, batch by batch."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from tallyforge.engine import Engine
from tallyforge.store import TableStore


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, kind: str = "json", files_per_batch: int = 100) -> DataFrame:
    """New files of a folder as a stream; files hold JSON lines, CSV or Parquet. With kind ``text`` the lines are not decoded."""
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch)
    if kind == "text":
        return reader.text(path)
    return reader.schema(schema).format(kind).load(path)


def decode_json(lines: DataFrame, schema: T.StructType | str, column: str = "value") -> DataFrame:
    """Lines as records, with a column ``_corrupt`` that holds those which can't be read."""
    shape = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*shape.fields, T.StructField("_corrupt", T.StringType())])
    parsed = lines.select(F.from_json(F.col(column), full, {"columnNameOfCorruptRecord": "_corrupt", "mode": "PERMISSIVE"}).alias("r"))
    return parsed.select("r.*")


def decode_avro(lines: DataFrame, schema: str, column: str = "value") -> DataFrame:
    """Avro records by their schema. Needs the spark-avro package on the class path."""
    from pyspark.sql.avro.functions import from_avro

    return lines.select(from_avro(F.col(column), schema).alias("r")).select("r.*")


def decode_protobuf(lines: DataFrame, message: str, descriptor: str, column: str = "value") -> DataFrame:
    """Protobuf messages by a descriptor file. Needs the spark-protobuf package on the class path."""
    from pyspark.sql.protobuf.functions import from_protobuf

    return lines.select(from_protobuf(F.col(column), message, descFilePath=descriptor).alias("r")).select("r.*")


@dataclass
class Metrics:
    batches: int = 0
    records: int = 0
    errors: int = 0
    written: dict[str, int] = field(default_factory=dict)
    seconds: float = 0.0

    @property
    def rate(self) -> float:
        return self.records / self.seconds if self.seconds else 0.0


@dataclass
class Ingest:
    """Feeds a stream of records into the tables of a store.

    A record goes to the first table whose selector holds, or, if no table has one, to ``table``. Records of a key are merged
    in one task; a replayed batch changes nothing, since rows are merged by primary key. Records that can't be decoded or
    mapped are counted and left out. Late records land in the partition of their own time.
    """

    store: TableStore
    table: str = ""
    metrics: Metrics = field(default_factory=Metrics)

    def batch(self, df: DataFrame, _id: int = 0) -> None:
        began, engine = time.time(), Engine(df.sparkSession, self.store)
        df = df.persist()
        try:
            good = df
            if "_corrupt" in df.columns:
                self.metrics.errors += df.where("_corrupt is not null").count()
                good = df.where("_corrupt is null").drop("_corrupt")
            selectors = {t: self.store.spec(t).selector for t in self.store.tables()}
            parts = engine.routes(good, selectors) if any(selectors.values()) else {self.table: good}
            for table, rows in parts.items():
                n = self.store.insert(table, rows, strict=False)
                self.metrics.written[table] = self.metrics.written.get(table, 0) + n
            self.metrics.records += df.count()
        finally:
            df.unpersist()
        self.metrics.batches += 1
        self.metrics.seconds += time.time() - began

    def start(self, stream: DataFrame, checkpoint: str, interval: str | None = None) -> StreamingQuery:
        """Run until stopped, or, without an interval, until all that is there is taken in."""
        writer = stream.writeStream.foreachBatch(self.batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def windowed(stream: DataFrame, time_column: str, size: str, keys: list[str], aggregates: dict[str, str], slide: str | None = None, lateness: str = "10 minutes") -> DataFrame:
    """Aggregates per window of event time and key: window_start, window_end, keys, and ``name: expression`` aggregates. Rows later
    than the lateness no longer count. Works on streams and tables alike."""
    at = F.col(time_column)
    df = stream.withColumn(time_column, at.cast("timestamp"))
    if stream.isStreaming:
        df = df.withWatermark(time_column, lateness)
    win = F.window(at, size, slide) if slide else F.window(at, size)
    out = df.groupBy(win.alias("w"), *keys).agg(*(F.expr(e).alias(n) for n, e in aggregates.items()))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, *aggregates)


def sessions(stream: DataFrame, time_column: str, gap: str, keys: list[str], aggregates: dict[str, str], lateness: str = "10 minutes") -> DataFrame:
    """The same per session: a key's rows with no more than the gap between them."""
    df = stream.withColumn(time_column, F.col(time_column).cast("timestamp"))
    if stream.isStreaming:
        df = df.withWatermark(time_column, lateness)
    out = df.groupBy(F.session_window(F.col(time_column), gap).alias("w"), *keys).agg(*(F.expr(e).alias(n) for n, e in aggregates.items()))
    return out.select(F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), *keys, *aggregates)


def first_of_key(stream: DataFrame, keys: list[str], time_column: str, lateness: str = "1 hour") -> DataFrame:
    """The stream without repeats of a key that come within the lateness."""
    return stream.withWatermark(time_column, lateness).dropDuplicatesWithinWatermark(keys) if stream.isStreaming else stream.dropDuplicates(keys)


def continuous_view(stream: DataFrame, target: str, checkpoint: str, mode: str = "append", interval: str | None = None, on_batch: Callable | None = None) -> StreamingQuery:
    """Keep the result of a streaming query in Parquet files; with mode ``complete`` or ``update`` each batch's result replaces the last."""
    if mode == "append" and on_batch is None:
        writer = stream.writeStream.format("parquet").option("path", target)
    else:
        writer = stream.writeStream.foreachBatch(on_batch or (lambda df, _: df.write.mode("overwrite").parquet(target)))
    writer = writer.outputMode(mode).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def publish(df: DataFrame, target: str, kind: str = "json", partitions: int | None = None) -> None:
    """Rows of a table as records for a stream: JSON lines (or Parquet) in a folder that file_stream watches."""
    out = df.repartition(partitions) if partitions else df
    out.write.mode("append").format(kind).save(target)
