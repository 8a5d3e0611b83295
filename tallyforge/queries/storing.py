"""Queries that write: tables of a store, files, streams. Each puts whole tables into a folder of its own and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.engine import Engine
from tallyforge.functions.registry import register_aggregate
from tallyforge.operators import relational
from tallyforge.plans.values import Val
from tallyforge.queries.reference import engine, make
from tallyforge.session import scratch, table
from tallyforge.sinks import register_sink
from tallyforge.sources import readers
from tallyforge.store import TableStore
from tallyforge.streaming import ingest
from tallyforge.types import TableSpec

_KINDS = {"bigint": "Integer", "int": "Integer", "boolean": "Boolean", "timestamp": "DateTime", "timestamp_ntz": "DateTime", "double": "Float"}


def stored(spark: SparkSession, d: str, name: str, key: str, columns: list[str], more: dict | None = None, attributes: dict | None = None, compat: bool = False) -> Engine:
    """An engine on a new store that holds the table, with these columns."""
    df = table(spark, d, name).select(*columns)
    made = [{"fieldName": f.name, "type": _KINDS.get(f.dataType.simpleString(), "String")} | (attributes or {}).get(f.name, {}) for f in df.schema.fields]
    made += [{"fieldName": n} | a for n, a in (attributes or {}).items() if n not in columns]
    e = engine(spark, d, compat)
    e.store = TableStore(spark, scratch(spark, "store"))
    e.store.create(TableSpec.from_dict({"tableName": f"my_{name}", "primaryKey": key, "attributes": made} | (more or {})))
    e.store.insert(f"my_{name}", df)
    return e


# Changes to tables

_CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_mktsegment"]


@make("s03_rownum", "SELECT count(*) AS rows, count(*) AS numbers, 1 AS first, 1 AS one FROM customer")
def _(spark, d):
    e = stored(spark, d, "customer", "c_custkey", _CUSTOMER)
    every = e.sql("SELECT count(*) AS rows, count(DISTINCT @rownum) AS numbers, min(@rownum) AS first FROM my_customer WHERE @rownum > 0")
    return every.crossJoin(e.sql("SELECT count(*) AS one FROM my_customer WHERE @rownum = 1"))  # one row each


@make("k06_insert_values", "SELECT * FROM (VALUES (1, 'one', 1.25, true), (2, 'two', NULL, false), (3, 'it''s', -3.5, NULL)) AS t(id, word, size, yes)")
def _(spark, d):
    e = engine(spark, d)
    e.store = TableStore(spark, scratch(spark, "store"))
    kinds = {"id": "Integer", "word": "String", "size": "Float", "yes": "Boolean"}
    e.store.create(TableSpec.from_dict({"tableName": "t", "primaryKey": "id", "attributes": [{"fieldName": n, "type": k} for n, k in kinds.items()]}))
    e.sql("INSERT INTO t (id, word, size, yes) VALUES (1, 'old', 9, true), (2, 'two', NULL, false)")
    e.sql("INSERT INTO t (id, word, size, yes) VALUES (3, 'it''s', -3.5, NULL), (1, 'one', 1.25, true)")
    return e.sql("SELECT id, word, size, yes FROM t")


@make("k07_upsert", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 2 * o_totalprice ELSE o_totalprice END AS o_totalprice FROM orders UNION ALL SELECT -1 - o_orderkey, 2 * o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def _(spark, d):
    old = table(spark, d, "orders").select("o_orderkey", "o_totalprice")
    dearer = table(spark, d, "orders").where("o_orderstatus = 'F'").selectExpr("o_orderkey", "2 * o_totalprice as o_totalprice")
    return relational.upsert(old, dearer.unionByName(dearer.withColumn("o_orderkey", -1 - F.col("o_orderkey"))), ["o_orderkey"])


@make("k08_insert_select", "SELECT c_custkey AS id, upper(c_name) AS name FROM customer WHERE c_acctbal > 1000")
def _(spark, d):
    e = engine(spark, d)
    e.store = TableStore(spark, scratch(spark, "store"))
    e.store.create(TableSpec.from_dict({"tableName": "rich", "primaryKey": "id", "attributes": [{"fieldName": "id", "type": "Integer"}, {"fieldName": "name"}]}))
    e.sql("INSERT INTO rich (id, name) SELECT c_custkey, string.uppercase(c_name) AS name FROM customer WHERE c_acctbal > 1000")
    return e.sql("SELECT id, name FROM rich")


@make("k09_update", "SELECT c_custkey, CASE WHEN c_nationkey < 5 AND c_mktsegment = 'BUILDING' THEN 'HUTS' ELSE c_mktsegment END AS c_mktsegment, CASE WHEN c_nationkey < 5 AND c_mktsegment = 'BUILDING' THEN NULL ELSE c_name END AS c_name FROM customer")
def _(spark, d):
    e = stored(spark, d, "customer", "c_custkey", _CUSTOMER)
    e.sql("UPDATE my_customer SET c_mktsegment = 'HUTS', c_name = NULL WHERE c_nationkey < 5 AND c_mktsegment = 'BUILDING'")
    return e.sql("SELECT c_custkey, c_mktsegment, c_name FROM my_customer")


@make("k10_upsert", "SELECT c_custkey, CASE WHEN c_nationkey = 7 THEN 'moved' WHEN c_custkey = 3 THEN 'Third' ELSE c_name END AS c_name, CASE WHEN c_nationkey = 7 THEN 8 ELSE c_nationkey END AS c_nationkey FROM customer UNION ALL SELECT -1, 'Nobody', NULL")
def _(spark, d):
    e = stored(spark, d, "customer", "c_custkey", _CUSTOMER)
    e.sql("UPSERT INTO my_customer (c_custkey, c_name) VALUES (-1, 'Nobody'), (3, 'Third')")
    e.sql("REPLACE INTO my_customer (c_custkey, c_name, c_nationkey) SELECT c_custkey, 'moved' AS n, 8 AS k FROM customer WHERE c_nationkey = 7")
    return e.sql("SELECT c_custkey, c_name, c_nationkey FROM my_customer")


@make("k11_delete", "SELECT row_id FROM customers_qa WHERE NOT coalesce(city = 'Port Halstone' OR age > 90, false)")
def _(spark, d):
    e = stored(spark, d, "customers_qa", "row_id", ["row_id", "city", "age"], compat=True)
    e.sql("DELETE FROM my_customers_qa WHERE city = 'Port Halstone' OR age > 90")
    return e.sql("SELECT row_id FROM my_customers_qa")


@make("k12_defaults", "SELECT row_id, coalesce(age, 0) AS age, coalesce(numFamilyMembers, 4) AS numFamilyMembers, coalesce(city, 'nowhere') AS city, CASE WHEN cust_id <> '' THEN sha256(cust_id) END AS hashed FROM customers_qa")
def _(spark, d):
    rules = {"age": {"defaultValue": 0}, "numFamilyMembers": {"defaultValue": 4}, "city": {"defaultValue": "'nowhere'"}, "hashed": {"defaultValue": "hash.sha256(cust_id)"}}
    e = stored(spark, d, "customers_qa", "row_id", ["row_id", "cust_id", "city", "age", "numFamilyMembers"], attributes=rules)
    return e.sql("SELECT row_id, age, numFamilyMembers, city, hashed FROM my_customers_qa")


@make("k13_secondary_keys", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 5 AND c_mktsegment = 'BUILDING'")
def _(spark, d):
    e = stored(spark, d, "customer", "c_custkey", _CUSTOMER, {"secondaryKeys": "c_nationkey+c_mktsegment,c_name"})
    return e.store.find("my_customer", {"c_nationkey": 5, "c_mktsegment": "BUILDING"}).select("c_custkey", "c_name")


@make("k15_merged_batches", "SELECT event_id, max(value) AS value FROM (SELECT event_id, value FROM events UNION ALL SELECT event_id, value + 1 FROM events WHERE event_type = 'click') GROUP BY event_id")
def _(spark, d):
    """Batches come again and with changes; a key holds what came last."""
    e = stored(spark, d, "events", "event_id", ["event_id", "value"], attributes={"value": {"type": "Float"}})
    job = ingest.Ingest(e.store, "my_events")
    whole = table(spark, d, "events").select("event_id", "value", "event_type")
    for part in (whole, whole.where("event_type = 'click'").withColumn("value", F.col("value") + 1), whole.where("event_type = 'click'").withColumn("value", F.col("value") + 1)):
        job.batch(part.select("event_id", "value"))
    return e.store.read("my_events").select("event_id", F.col("value").cast("double").alias("value"))


# Partitions by time


def _by_day(spark: SparkSession, d: str) -> Engine:
    return stored(spark, d, "events", "event_id", ["event_id", "ts", "event_type"], {"timeQuantumField": "ts", "timeQuantumType": "YMD"})


@make("s04_timestamp_between", "SELECT event_id FROM events WHERE ts::DATE BETWEEN DATE '2024-01-05' AND DATE '2024-01-10'")
def _(spark, d):
    return _by_day(spark, d).sql("SELECT event_id FROM my_events WHERE @timestamp BETWEEN '2024-01-05' AND '2024-01-10'")


@make("d09_partitions", "SELECT strftime(ts, '%Y-%m-%d') AS partition, count(*) AS n_rows FROM events GROUP BY ALL")
def _(spark, d):
    return _by_day(spark, d).store.partitions("my_events").select("partition", "n_rows")


@make("d09_purge", "SELECT strftime(ts, '%Y-%m-%d') AS partition, count(*) AS n_rows FROM events WHERE ts >= TIMESTAMP '2024-01-12' GROUP BY ALL")
def _(spark, d):
    e = _by_day(spark, d)
    e.store.purge("my_events", "2024-01-12")
    return e.store.partitions("my_events").select("partition", "n_rows")


@make("d08_verify", "SELECT count(*) AS rows, 0 AS repeated_keys, 0 AS misplaced FROM events")
def _(spark, d):
    return spark.createDataFrame([_by_day(spark, d).store.verify("my_events")], "rows bigint, repeated_keys bigint, misplaced bigint")


@make("d08_repair", "SELECT c_custkey, CASE WHEN c_nationkey = 4 THEN 'later' ELSE c_name END AS c_name FROM customer")
def _(spark, d):
    """Rows of a nation come once more, in a partition that isn't theirs."""
    e = stored(spark, d, "customer", "c_custkey", _CUSTOMER)
    stray = e.store.read("my_customer", internal=True).where("c_nationkey = 4").withColumns({"_part": F.lit("00000"), "c_name": F.lit("later"), "_rownum": F.col("_rownum") + 10**15})
    stray.write.mode("append").partitionBy("_part").parquet(f"{e.store.root}/my_customer/data")
    e.store.repair("my_customer")
    return e.sql("SELECT c_custkey, c_name FROM my_customer")


@make("d08_status", "SELECT 'my_events' AS \"table\", count(DISTINCT ts::DATE)::INT AS partitions, true AS filled FROM events")
def _(spark, d):
    return _by_day(spark, d).store.status().selectExpr("table", "partitions", "bytes > 0 as filled")


@make("a17_own_aggregate", "SELECT o_custkey, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_custkey")
def _(spark, d):
    register_aggregate("spread", lambda v: Val(F.max(v.col) - F.min(v.col), v.type))
    return engine(spark, d).sql("SELECT o_custkey, spread(o_totalprice) AS spread FROM orders GROUP BY o_custkey")


# Files


def _through(spark: SparkSession, d: str, statement: str, options: str) -> str:
    where = scratch(spark, "files")
    engine(spark, d).sql(f"{statement} INTO '{where}' WITH {options}")
    return where


_PARTS = "SELECT p_partkey, p_name, p_brand, p_size FROM part"
_PARTS_SQL = "SELECT p_partkey::VARCHAR AS p_partkey, p_name, p_brand, p_size::VARCHAR AS p_size FROM part"


@make("k01_into_csv", _PARTS_SQL)
def _(spark, d):
    return readers.csv(spark, _through(spark, d, _PARTS, "format=csv, delimiter='|'"), delimiter="|")


@make("k02_into_parquet", _PARTS_SQL)
def _(spark, d):
    return spark.read.parquet(_through(spark, d, _PARTS, "format=parquet, threads=3"))


@make("k04_own_sink", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def _(spark, d):
    where = scratch(spark, "sink")
    register_sink("kept", lambda df, target, options: df.write.mode("overwrite").orc(where))
    engine(spark, d).sql("SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand INTO 'kept://x'")
    return spark.read.orc(where)


@make("s05_csv", "SELECT row_id, city, address FROM customers_qa WHERE city <> ''")
def _(spark, d):
    where = scratch(spark, "csv")
    table(spark, d, "customers_qa").select("row_id", "city", "address").where("city <> ''").write.option("header", True).option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(where)
    return readers.csv(spark, where, "row_id bigint, city string, address string")


@make("s06_json", "SELECT event_id, event_type, value, props->>'$.k' AS k FROM events")
def _(spark, d):
    where = scratch(spark, "json")
    ingest.publish(table(spark, d, "events").select("event_id", "event_type", "value", F.from_json("props", "k bigint").alias("props")), where)
    e = engine(spark, d)
    e.sql(f"CREATE SOURCE files WITH type=json, path='{where}', table=happened")
    return e.sql("SELECT event_id, event_type, value, props.k AS k FROM files.happened")


@make("s09_pages", "SELECT o_orderkey, o_orderpriority FROM orders")
def _(spark, d):
    """A file after another, of three shares of the files."""
    where = scratch(spark, "pages")
    table(spark, d, "orders").select("o_orderkey", "o_orderpriority").repartition(5).write.parquet(where)
    out = None
    for share in range(3):
        for page in readers.pages(spark, readers.files(spark, where, ".parquet", share, 3)):
            out = page if out is None else out.unionByName(page)
    return out


@make("s15_introspection", "SELECT * FROM (VALUES ('l_orderkey', 'bigint'), ('l_quantity', 'double'), ('l_returnflag', 'string'), ('l_shipdate', 'timestamp'), ('late_word', 'string')) AS t(name, kind)")
def _(spark, d):
    """Types from all rows: late_word is a number in all but the last order."""
    lines = table(spark, d, "lineitem")
    last = lines.agg(F.max("l_orderkey")).scalar()
    text = lines.select(F.col("l_orderkey").cast("string"), F.col("l_quantity").cast("string"), "l_returnflag", F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("l_shipdate"), F.when(F.col("l_orderkey") == last, "x").otherwise("7").alias("late_word"))
    return spark.createDataFrame([(f.name, f.dataType.simpleString()) for f in readers.fitting_schema(text).fields], "name string, kind string")


@make("s21_csv_to_parquet", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def _(spark, d):
    first, second = scratch(spark, "csv"), scratch(spark, "parquet")
    table(spark, d, "part").select("p_partkey", "p_name", "p_size", "p_retailprice").write.option("header", True).csv(first)
    readers.csv_to_parquet(spark, first, second)
    return spark.read.parquet(second)


# Statements on metadata


@make("d03_show_tables", "SELECT * FROM (VALUES ('my_customer'), ('people')) AS t(\"Table\")")
def _(spark, d):
    e = stored(spark, d, "customer", "c_custkey", _CUSTOMER)
    e.register("people", table(spark, d, "users"))
    return e.sql("SHOW TABLES")


@make("d03_show_columns", "SELECT column_name AS \"Field\", CASE WHEN column_name = 'c_custkey' THEN 'PRI' ELSE '' END AS \"Key\" FROM information_schema.columns WHERE table_name = 'customer' AND column_name IN ('c_custkey', 'c_name', 'c_nationkey', 'c_mktsegment')")
def _(spark, d):
    return stored(spark, d, "customer", "c_custkey", _CUSTOMER).sql("SHOW COLUMNS FROM my_customer").select("Field", "Key")


@make("d03_show_variables", "SELECT 'autocommit' AS \"Variable_name\", '1' AS \"Value\"")
def _(spark, d):
    return engine(spark, d).sql("SHOW VARIABLES LIKE 'autocommit'")


@make("d04_set", "SELECT c_custkey FROM customer WHERE c_nationkey = 5")
def _(spark, d):
    e = engine(spark, d)
    e.sql("SET @nation = 5")
    e.sql("PREPARE own FROM 'SELECT c_custkey FROM customer WHERE c_nationkey = ?'")
    return e.sql("EXECUTE own USING @nation")


@make("d06_views", "SELECT c_mktsegment, count(*) AS n FROM customer WHERE c_acctbal > 0 GROUP BY c_mktsegment")
def _(spark, d):
    e = engine(spark, d)
    e.sql("CREATE VIEW solvent AS SELECT c_mktsegment, c_custkey FROM customer WHERE c_acctbal > 0")
    return e.sql("SELECT c_mktsegment, count(*) AS n FROM solvent GROUP BY c_mktsegment")


@make("d06_create_table_as", "SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10")
def _(spark, d):
    e = engine(spark, d)
    e.store = TableStore(spark, scratch(spark, "store"))
    e.sql("CREATE TABLE near AS SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey < 10")
    return e.sql("SELECT s_suppkey, s_name FROM near")


@make("d07_alter_drop", "SELECT c_custkey, CASE WHEN c_nationkey = 3 THEN 'new' END AS note FROM customer")
def _(spark, d):
    e = stored(spark, d, "customer", "c_custkey", _CUSTOMER)
    e.sql("ALTER TABLE my_customer ADD COLUMN note varchar")
    e.sql("UPDATE my_customer SET note = 'new' WHERE c_nationkey = 3")
    e.sql("CREATE TABLE passing (id int)")
    e.sql("DROP TABLE passing")
    assert e.store.tables() == ["my_customer"]
    return e.sql("SELECT c_custkey, note FROM my_customer")


@make("d12_view_of", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 9")
def _(spark, d):
    e = stored(spark, d, "customer", "c_custkey", _CUSTOMER)
    e.store.create(TableSpec.from_dict({"tableName": "others", "isViewOf": "my_customer", "attributes": [{"fieldName": "c_custkey", "type": "Integer"}, {"fieldName": "c_name"}]}))
    return e.sql("SELECT c_custkey, c_name FROM others WHERE c_nationkey = 9")


@make("o03_default_limit", "SELECT least(10, count(*)) AS n FROM customer")
def _(spark, d):
    e = engine(spark, d)
    e.default_limit = 10
    e.register("cut", e.sql("SELECT c_custkey FROM customer"))
    return e.sql("SELECT count(*) AS n FROM cut")


# Streams


def _stream(spark: SparkSession, d: str, columns: list[str]) -> DataFrame:
    where = scratch(spark, "stream")
    df = table(spark, d, "events").selectExpr(*columns)
    # in order of time, a file a batch, so that the watermark moves on
    ingest.publish(df.repartitionByRange(4, "ts").sortWithinPartitions("ts"), where, "parquet")
    return ingest.file_stream(spark, where, df.schema, "parquet", files_per_batch=1)


_EVENT = ["event_id", "cast(ts as timestamp) as ts", "event_type", "cast(value as decimal(18,4)) as value"]


@make("r10_stream_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n, sum(value::DECIMAL(18,4))::DOUBLE AS total FROM events GROUP BY ALL")
def _(spark, d):
    stream = ingest.windowed(_stream(spark, d, _EVENT), "ts", "1 hour", ["event_type"], {"n": "count(1)", "total": "sum(value)"}, lateness="100 days")
    view = scratch(spark, "view")
    ingest.continuous_view(stream, f"{view}/data", f"{view}/checkpoint", "complete").awaitTermination()
    return spark.read.parquet(f"{view}/data").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.col("total").cast("double").alias("total"))


@make("r10_late_rows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(spark, d):
    """Every event comes once more, sixty days late, when its window is long closed. Rows between and behind move the watermark
    on: it holds for late rows a batch after it closes windows."""
    where = scratch(spark, "stream")
    df = table(spark, d, "events").selectExpr(*_EVENT)
    mark = lambda days: df.agg(F.max("ts").alias("ts")).selectExpr("-1L as event_id", f"ts + interval {days} days as ts", "'mark' as event_type", "cast(0 as decimal(18,4)) as value")
    for part in (df, mark(1), df.withColumn("ts", F.expr("ts - interval 60 days")), mark(10)):  # a batch each
        ingest.publish(part, where, "parquet", 1)
    stream = ingest.file_stream(spark, where, df.schema, "parquet", files_per_batch=1)
    view = scratch(spark, "view")
    ingest.continuous_view(ingest.windowed(stream, "ts", "1 hour", ["event_type"], {"n": "count(1)"}, lateness="2 hours"), f"{view}/data", f"{view}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{view}/data").where("event_type <> 'mark'").select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@make("r06_first_of_key", "SELECT event_id, event_type FROM events")
def _(spark, d):
    """Every event comes twice; the second is dropped."""
    stream = _stream(spark, d, _EVENT)
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2))))
    view = scratch(spark, "view")
    ingest.continuous_view(ingest.first_of_key(twice, ["event_id"], "ts", "40 days"), f"{view}/data", f"{view}/checkpoint").awaitTermination()
    return spark.read.parquet(f"{view}/data").select("event_id", "event_type")


@make("r11_continuous_view", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, d):
    e = engine(spark, d)
    e.store = TableStore(spark, scratch(spark, "store"))
    e.register("incoming", _stream(spark, d, _EVENT))
    e.sql("CREATE CONTINUOUSVIEW totals AS SELECT event_type, count(*) AS n FROM incoming GROUP BY event_type WITH mode=complete")
    e.streams["totals"].awaitTermination()
    return e.sql("SELECT event_type, n FROM totals")


@make("r09_event_time_partitions", "SELECT strftime(ts, '%Y-%m-%d') AS partition, count(*) AS n_rows FROM events WHERE event_type = 'purchase' GROUP BY ALL")
def _(spark, d):
    """A stream routed by selector into a table with partitions by day; each row lands in that of its own time."""
    store = TableStore(spark, scratch(spark, "store"))
    attributes = [{"fieldName": "event_id", "type": "Integer"}, {"fieldName": "ts", "type": "DateTime"}, {"fieldName": "event_type"}]
    store.create(TableSpec.from_dict({"tableName": "bought", "primaryKey": "event_id", "timeQuantumField": "ts", "timeQuantumType": "YMD", "selector": 'event_type = "purchase"', "attributes": attributes}))
    ingest.Ingest(store).start(_stream(spark, d, _EVENT[:3]), scratch(spark, "progress")).awaitTermination()
    return store.partitions("bought").select("partition", "n_rows")
