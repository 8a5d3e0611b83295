"""Queries of the problems on text, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyforge.llm import leakage, packing, splitting
from tallyforge.session import table

CAPACITY, PIECE, OVERLAP, NGRAM = 8192, 4096, 256, 12


def p7_assignment(spark: SparkSession, d: str) -> DataFrame:
    """A token is a byte of the UTF-8 text."""
    return packing.pack(table(spark, d, "documents"), item_id="doc_id", size=F.octet_length("text"), capacity=CAPACITY)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that the assignment divides: those with a second piece."""
    return p7_assignment(spark, d).where("piece = 1").select("doc_id")


def p7_summary(spark: SparkSession, d: str) -> DataFrame:
    return packing.packing_summary(p7_assignment(spark, d), CAPACITY)


def p7_whole(spark: SparkSession, d: str) -> DataFrame:
    """Of every document: the pieces and tokens that containers hold of it, and whether none of these holds too much."""
    packed = p7_assignment(spark, d)
    fills = packed.groupBy("container").agg(F.sum("size").alias("held"))
    own = packed.join(fills, "container").groupBy("doc_id")
    return own.agg(F.count(F.lit(1)).alias("pieces"), F.sum("size").cast("bigint").alias("tokens"), (F.max("held") <= CAPACITY).alias("fits"), F.bool_and(F.col("held") == F.col("fill")).alias("fill_told"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.find_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), n=NGRAM)


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaked_spans(table(spark, d, "documents"), table(spark, d, "eval_items"), n=NGRAM)


def p8_cleaned(spark: SparkSession, d: str) -> DataFrame:
    return leakage.without_leaks(table(spark, d, "documents"), table(spark, d, "eval_items"), n=NGRAM)


def p9_pieces(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.split_texts(table(spark, d, "documents"), item_id="doc_id", text="text", limit=PIECE, overlap=OVERLAP)
    return pieces.withColumn("doc_id", F.col("doc_id").cast("bigint"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """The documents that are cut: those with a second piece."""
    return p9_pieces(spark, d).where("piece = 1").select("doc_id")


def p9_rebuilt(spark: SparkSession, d: str) -> DataFrame:
    """Of every document that is cut: the text put together again from its pieces, and whether these keep to limit and overlap."""
    size = F.col("end") - F.col("begin")
    before = Window.partitionBy("doc_id").orderBy("piece")
    last = F.lag("end").over(before)
    overlap = F.coalesce(last - F.col("begin"), F.lit(OVERLAP))
    pieces = p9_pieces(spark, d).withColumns({"last": F.coalesce(last, F.lit(0)), "shared": overlap})
    fresh = F.expr("decode(substring(cast(text AS binary), cast(last - begin + 1 AS int)), 'utf-8')")
    kept = pieces.select("doc_id", "piece", F.when(F.col("piece") == 0, F.col("text")).otherwise(fresh).alias("t"), ((size <= PIECE) & F.col("shared").between(OVERLAP - 3, OVERLAP) & (F.octet_length("text") == size)).alias("ok"))
    whole = kept.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "t"))), lambda x: x["t"]), "").alias("text"), F.bool_and("ok").alias("ok"))
    return whole.select("doc_id", F.md5(F.col("text")).alias("digest"), "ok")


QUERIES = {"p7_found": p7_found, "p7_assignment": p7_assignment, "p7_summary": p7_summary, "p7_whole": p7_whole, "p8_found": p8_found, "p8_spans": p8_spans, "p8_cleaned": p8_cleaned, "p9_found": p9_found, "p9_pieces": p9_pieces, "p9_rebuilt": p9_rebuilt}

SQL = {
    "p7_found": f"SELECT doc_id FROM documents WHERE strlen(text) > {CAPACITY}",
    "p7_whole": f"SELECT doc_id, greatest(1, ceil(coalesce(strlen(text), 0) / {CAPACITY}))::BIGINT AS pieces, coalesce(strlen(text), 0) AS tokens, true AS fits, true AS fill_told FROM documents",
    "p9_rebuilt": f"SELECT doc_id, md5(text) AS digest, true AS ok FROM documents WHERE strlen(text) > {PIECE}",
    "p8_found": rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM documents),
e AS (SELECT item_id, regexp_extract_all(lower(text), '[\pL\pN]+') AS w FROM eval_items),
de AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i : i + {NGRAM - 1}], ' '))) AS g FROM d),
ee AS (SELECT item_id, unnest(list_transform(range(1, len(w) - {NGRAM - 2}), lambda i: array_to_string(w[i : i + {NGRAM - 1}], ' '))) AS g FROM e)
SELECT DISTINCT doc_id, item_id FROM de JOIN ee USING (g)""",
    "p9_found": f"SELECT doc_id FROM documents WHERE strlen(text) > {PIECE}",
}
