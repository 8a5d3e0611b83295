"""One query for every operator of the engine, with the SQL that gives the same.

Queries run statements of the dialect, or an operator, over whole tables.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tallyforge.engine import Engine
from tallyforge.operators import relational
from tallyforge.plans.compiler import Compiler, scope_of
from tallyforge.plans.parser import parse_expression
from tallyforge.plans.planner import Source
from tallyforge.session import table
from tallyforge.streaming import ingest

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "customers_qa", "orders_qa", "users", "viewport_event")

QUERIES: dict = {}
SQL: dict[str, str] = {}


class FolderEngine(Engine):
    """An engine that sees the tables of a folder."""

    folder: str = ""

    def source(self, name: str) -> Source:
        if name in TABLES and name not in self.views:
            self.register(name, table(self.spark, self.folder, name))
        return super().source(name)


def engine(spark: SparkSession, d: str, compat: bool = False) -> Engine:
    e = FolderEngine(spark, compat=compat)
    e.folder = d
    return e


def add(name: str, statement: str, sql: str | None = None, compat: bool = False) -> None:
    """A statement of the dialect; sql if SQL says it otherwise."""
    QUERIES[name] = lambda spark, d: engine(spark, d, compat).sql(statement)
    if sql != "":
        SQL[name] = sql or statement


def make(name: str, sql: str | None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


# Scans and sources

add("s01_scan", "SELECT * FROM nation")
add("s02_default_scan", "SELECT c_custkey, c_name FROM customer")
add("s16_literal", "SELECT 1 AS one, 'hello' AS word")


@make("s10_memory_table", "SELECT * FROM (VALUES (1, 'a', 1.5), (2, 'b', NULL), (3, NULL, 2.5)) AS t(id, name, score)")
def _(spark, d):
    from tallyforge.sources.readers import rows

    return rows(spark, [(1, "a", 1.5), (2, "b", None), (3, None, 2.5)], ["id", "name", "score"]).select(F.col("id").cast("int").alias("id"), "name", F.col("score").cast("decimal(2,1)").alias("score"))


@make("s14_information_schema", "SELECT column_name AS \"Field\" FROM information_schema.columns WHERE table_name = 'nation'")
def _(spark, d):
    return engine(spark, d).sql("DESCRIBE nation").select("Field")


@make("s22_nested_path", "SELECT row_id, json_extract_string(payload, '$.impressionEventValueValue.value.v1EventValueValue.value.containerViewValueValue.value.deviceId') AS device FROM viewport_event WHERE json_valid(payload) AND json_extract_string(payload, '$.impressionEventValueValue.value.v1EventValueValue.value.containerViewValueValue.value.deviceId') IS NOT NULL")
def _(spark, d):
    path = "/impressionEventValueValue/value/v1EventValueValue/value/containerViewValueValue/value/deviceId"
    whole = F.try_parse_json("payload").isNotNull()
    return table(spark, d, "viewport_event").where(whole).select("row_id", relational.at_path(F.col("payload"), path).alias("device")).where("device is not null")


# Projection, filters, predicates

add("p01_projection", "SELECT n.n_name AS nation, n.n_regionkey AS region FROM nation AS n")
add("p02_computed", "SELECT n_nationkey, tolower(n_name) AS low, hash.md5(n_name) AS digest FROM nation", "SELECT n_nationkey, lower(n_name) AS low, md5(n_name) AS digest FROM nation")
add("p03_arithmetic", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS q, l_linenumber / 2 AS half, l_linenumber % 3 AS rest, -l_linenumber AS minus FROM lineitem", "SELECT l_orderkey, l_linenumber, l_quantity * 2 + 1 AS q, l_linenumber // 2 AS half, l_linenumber % 3 AS rest, -l_linenumber AS minus FROM lineitem")
add("p04_guarded_column", "SELECT o_orderkey, o_orderpriority IF o_totalprice > 100000 FROM orders", "SELECT o_orderkey, CASE WHEN o_totalprice > 100000 THEN o_orderpriority END AS o_orderpriority FROM orders")
add("p05_distinct", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
add("p06_equal", "SELECT c_custkey FROM customer WHERE c_mktsegment == 'BUILDING'", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'")
add("p07_not_equal", "SELECT row_id FROM customers_qa WHERE city != 'Port Halstone'", "SELECT row_id FROM customers_qa WHERE city IS DISTINCT FROM 'Port Halstone'", compat=True)
add("p08_order", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000.5 AND o_orderdate < '1996-01-01' AND o_custkey > 500 AND o_totalprice <= 300000", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= 150000.5 AND o_orderdate < TIMESTAMP '1996-01-01' AND o_custkey > 500 AND o_totalprice <= 300000")
add("p09_between", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity BETWEEN 10 AND 12")
add("p09_not_between", "SELECT row_id FROM customers_qa WHERE age NOT BETWEEN 20 AND 60", "SELECT row_id FROM customers_qa WHERE NOT coalesce(age BETWEEN 20 AND 60, false)", compat=True)
add("p11_in", "SELECT n_nationkey FROM nation WHERE n_regionkey IN (1, 3)")
add("p11_not_in", "SELECT row_id FROM customers_qa WHERE state NOT IN ('AK', 'NH')", "SELECT row_id FROM customers_qa WHERE NOT coalesce(state IN ('AK', 'NH'), false)", compat=True)
add("p14_like", "SELECT p_partkey FROM part WHERE p_name LIKE '%widget%'")
add("p18_boolean_tree", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' AND o_totalprice > 50000) OR NOT (o_orderstatus = 'O' OR o_totalprice < 300000)")
add("p20_is_null", "SELECT row_id FROM customers_qa WHERE city IS NULL AND last_name IS NOT NULL")
add("p20_equals_null", "SELECT row_id FROM customers_qa WHERE city = NULL AND last_name != NULL", "SELECT row_id FROM customers_qa WHERE city IS NULL AND last_name IS NOT NULL")
add("p21_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey = l_quantity AND l_orderkey > l_partkey")
add("p22_alias_in_where", "SELECT c_acctbal AS money, c_name AS who FROM customer WHERE money > 5000", "SELECT c_acctbal AS money, c_name AS who FROM customer WHERE c_acctbal > 5000")
add("p23_function_in_where", "SELECT c_custkey FROM customer WHERE tolower(c_mktsegment) = 'machinery'", "SELECT c_custkey FROM customer WHERE lower(c_mktsegment) = 'machinery'")
add("p26_division", "SELECT l_orderkey, l_linenumber, (l_orderkey + 1) / (l_linenumber - 1) AS whole, l_extendedprice / l_quantity AS unit FROM lineitem", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 1 THEN (l_orderkey + 1) // (l_linenumber - 1) END AS whole, l_extendedprice / nullif(l_quantity, 0) AS unit FROM lineitem")


def _filter(name: str, source: str, columns: list[str], text: str, sql: str, before: str = "") -> None:
    def run(spark, d):
        e = engine(spark, d)
        if before:
            e.save_filters(before)
        return e.filter(text, e.source(source).df).select(*columns)

    QUERIES[name], SQL[name] = run, sql


_filter("p10_filter_between", "lineitem", ["l_orderkey", "l_linenumber"], "FILTER l_quantity BETWEEN 10 AND 12", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 10 AND l_quantity < 12")
_filter("p14_filter_glob", "part", ["p_partkey"], 'FILTER p_name LIKE "*widget*"', "SELECT p_partkey FROM part WHERE p_name LIKE '%widget%'")
_filter("p15_contains", "documents", ["doc_id"], 'FILTER text CONTAINS "token"', "SELECT doc_id FROM documents WHERE contains(text, 'token')")
_filter("p17_exists", "documents", ["doc_id"], "FILTER EXISTS author", "SELECT doc_id FROM documents WHERE author IS NOT NULL")
_filter("p19_n_ary", "customers_qa", ["row_id"], 'FILTER AND ( EXISTS city, OR ( state == "AK" age > 60 ), NOT ( isActive == false ) )', "SELECT row_id FROM customers_qa WHERE city IS NOT NULL AND (coalesce(state = 'AK', false) OR coalesce(age > 60, false)) AND NOT coalesce(isActive = false, false)")
_filter("p28_includes", "customers_qa", ["row_id"], "FILTER AND ( INCLUDE elders, NOT INCLUDE northern )", "SELECT row_id FROM customers_qa WHERE coalesce(age > 60, false) AND NOT coalesce(state IN ('AK', 'ME'), false)", 'FILTER age > 60 ALIAS elders; FILTER state IN ("AK", "ME") ALIAS northern;')
_filter("p29_missing_operands", "customers_qa", ["row_id"], 'FILTER OR ( nowhere == "x", city != "Port Halstone", nothing > 3 )', "SELECT row_id FROM customers_qa WHERE city IS DISTINCT FROM 'Port Halstone'")


@make("p13_token_search", "SELECT doc_id FROM documents WHERE list_has_all(regexp_split_to_array(lower(text), '[^\\pL\\pN\\p{Mc}\\p{Mn}\\-_'']+'), ['token', 'race'])")
def _(spark, d):
    df = table(spark, d, "documents")
    c = Compiler(scope_of(df), "compat", searchable=frozenset({"text"}))
    return df.where(c.predicate(parse_expression("text LIKE 'the token race'"))).select("doc_id")


@make("p16_intersects", "SELECT row_id FROM customers_qa WHERE list_has_any(string_split(phoneType, ';'), ['fax', 'pager'])")
def _(spark, d):
    df = table(spark, d, "customers_qa").withColumn("kinds", F.split("phoneType", ";"))
    return engine(spark, d).filter('FILTER kinds INTERSECTS ("fax", "pager")', df).select("row_id")


@make("p25_date_math", "SELECT event_id FROM events WHERE ts < TIMESTAMP '2024-01-16 12:00:00' - INTERVAL 36 HOUR AND ts > TIMESTAMP '2024-01-16 12:00:00' - INTERVAL 1 WEEK")
def _(spark, d):
    now = F.lit("2024-01-16 12:00:00").cast("timestamp")
    return engine(spark, d).filter('FILTER AND ( ts < "now-36h", ts > "now-1w" )', table(spark, d, "events"), now).select("event_id")


@make("p27_stratified_sample", None)
def _(spark, d):
    return engine(spark, d).sql("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE sample_stratified('l_returnflag', 10) GROUP BY l_returnflag")


# Joins

add("j01_inner_star", "SELECT o.o_orderkey, c.c_name, n.n_name FROM orders AS o INNER JOIN customer AS c ON o.o_custkey = c.c_custkey INNER JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE n.n_regionkey = 2")
add("j02_outer", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c OUTER JOIN orders AS o ON o.o_custkey == c.c_custkey", "SELECT c.c_custkey, o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON o.o_custkey = c.c_custkey")
add("j03_right_outer", "SELECT n.n_name, r.r_name FROM nation AS n RIGHT JOIN region AS r ON n.n_regionkey = r.r_regionkey")
add("j04_in_query", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
add("j04_in_query_rows", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "SELECT c_custkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 200000", compat=True)
add("j05_not_in_query", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
add("j05_anti_join", "SELECT c.row_id FROM customers_qa AS c INNER JOIN orders_qa AS o ON c.cust_id != o.cust_id", "SELECT row_id FROM customers_qa AS c WHERE NOT EXISTS (SELECT 1 FROM orders_qa AS o WHERE o.cust_id = c.cust_id)")
add("j06_join_count", "SELECT count(*) AS n FROM orders AS o INNER JOIN lineitem AS l ON l.l_orderkey = o.o_orderkey WHERE o.o_orderstatus = 'F'")
add("j07_two_keys", "SELECT a.row_id, b.row_id AS other FROM orders_qa AS a INNER JOIN orders_qa AS b ON a.order_id = b.order_id AND a.ship_via = b.ship_via")
add("j09_sub_select", "SELECT o.o_orderkey, c.c_name FROM orders AS o INNER JOIN (SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 9000) AS c ON o.o_custkey = c.c_custkey")


@make("j05_anti_operator", "SELECT s_suppkey FROM supplier WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey = s_suppkey AND l_quantity >= 50 AND l_discount >= 0.1)")
def _(spark, d):
    lines = table(spark, d, "lineitem").where("l_quantity >= 50 and l_discount >= 0.1").select("l_suppkey")
    return relational.fk_join(table(spark, d, "supplier"), lines, "s_suppkey", "l_suppkey", "anti").select("s_suppkey")


# Aggregation

add("a01_count", "SELECT count(*) AS n FROM lineitem")
add("a02_count_column", "SELECT count(city) AS n FROM customers_qa")
add("a02_count_column_rows", "SELECT count(city) AS n FROM customers_qa", "SELECT count(*) AS n FROM customers_qa", compat=True)
add("a03_sum", "SELECT sum(l_linenumber) AS s FROM lineitem")
add("a04_avg", "SELECT avg(age) AS a FROM customers_qa WHERE age BETWEEN 0 AND 120")
add("a04_avg_cut", "SELECT avg(age) AS a FROM customers_qa WHERE age BETWEEN 0 AND 120", "SELECT floor(avg(age))::BIGINT AS a FROM customers_qa WHERE age BETWEEN 0 AND 120", compat=True)


@make("a04_avg_cut_decimal", "SELECT l_orderkey, ((sum(CAST(l_discount AS DECIMAL(18,2))) * 100)::HUGEINT // count(*))::DOUBLE / 100 AS a, (sum(l_linenumber) // count(*))::BIGINT AS b, ((sum(CAST(-l_extendedprice AS DECIMAL(18,2))) * 100)::HUGEINT // count(*))::DOUBLE / 100 AS c FROM lineitem GROUP BY l_orderkey")
def _(spark, d):
    e = engine(spark, d, compat=True)
    e.register("lines", table(spark, d, "lineitem").selectExpr("l_orderkey", "l_linenumber", "cast(l_discount as decimal(18,2)) as discount", "cast(-l_extendedprice as decimal(18,2)) as debt"))
    return e.sql("SELECT l_orderkey, avg(discount) AS a, avg(l_linenumber) AS b, avg(debt) AS c FROM lines GROUP BY l_orderkey")


add("a05_min_max", "SELECT min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders")
add("a06_multi_aggregate", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, avg(l_quantity) AS avg_qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_shipdate <= '1998-09-02' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, avg(l_quantity) AS avg_qty, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
add("a07_group_drops_missing", "SELECT state, count(*) AS n FROM customers_qa GROUP BY state", "SELECT state, count(*) AS n FROM customers_qa WHERE state IS NOT NULL GROUP BY state", compat=True)
add("a08_group_by_expression", "SELECT tolower(c_mktsegment) AS seg, count(*) AS n FROM customer GROUP BY tolower(c_mktsegment)", "SELECT lower(c_mktsegment) AS seg, count(*) AS n FROM customer GROUP BY ALL")
add("a09_partial_final", "SELECT l_suppkey, sum(l_quantity) AS qty, count(*) AS n FROM lineitem GROUP BY l_suppkey")
add("a10_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING n > 12", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
add("a13_count_distinct", "SELECT count(DISTINCT l_partkey) AS n FROM lineitem")
add("a14_constant_group", "SELECT count(*) AS n, max(l_quantity) AS top FROM lineitem GROUP BY '-'", "SELECT count(*) AS n, max(l_quantity) AS top FROM lineitem")
add("q6_aggregate_alias", "SELECT max(age) AS oldest FROM customers_qa WHERE oldest = 44", "SELECT max(age) AS oldest FROM customers_qa WHERE age = 44", compat=True)
add("a12_cardinality", "SELECT cardinality(l_returnflag) AS n FROM lineitem", "SELECT count(DISTINCT l_returnflag) AS n FROM lineitem")
_TOP = """
WITH c AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k FROM c), t AS (SELECT sum(n) AS a FROM c)
SELECT v AS topn_o_orderpriority, n::BIGINT AS topn_count, n * 100.0::DOUBLE / a AS topn_percent FROM r, t {first}
UNION ALL SELECT 'TOTAL:', a::BIGINT, 100.0::DOUBLE FROM t"""
add("a11_topn_all", "SELECT topn(o_orderpriority) FROM orders", _TOP.format(first=""))
add("a11_topn", "SELECT topn(o_orderpriority, 2) FROM orders", _TOP.format(first="WHERE k <= 2") + " UNION ALL SELECT 'OTHER:', sum(n)::BIGINT, sum(n) * 100.0::DOUBLE / any_value(a) FROM r, t WHERE k > 2")


@make("a07_multi_valued_group", "SELECT kind, count(*) AS n FROM (SELECT unnest(string_split(phoneType, ';')) AS kind FROM customers_qa) WHERE kind IS NOT NULL GROUP BY kind")
def _(spark, d):
    e = engine(spark, d, compat=True)
    e.register("people", table(spark, d, "customers_qa").withColumn("kinds", F.split("phoneType", ";")))
    return e.sql("SELECT kinds AS kind, count(*) AS n FROM people GROUP BY kinds")


@make("a16_child_counts", "SELECT o_custkey, count(*) AS n FROM orders WHERE o_custkey IS NOT NULL GROUP BY o_custkey")
def _(spark, d):
    return relational.child_counts(table(spark, d, "orders"), "o_custkey")


# Order and limits

add("o01_order_by", "SELECT n_name, n_regionkey FROM nation ORDER BY n_regionkey DESC, n_name")
add("o02_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
add("o02_limit_offset", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10, 15", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 10")
add("o04_order_by_hidden", "SELECT o_orderkey FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 7 OFFSET 3")


@make("o08_set_algebra", "SELECT c_custkey FROM customer WHERE (c_mktsegment = 'BUILDING' OR c_acctbal > 9000) AND c_nationkey < 12 AND NOT (c_acctbal < 0)")
def _(spark, d):
    c = F.col
    df = table(spark, d, "customer")
    return df.where(relational.bitmap_algebra([c("c_mktsegment") == "BUILDING", c("c_acctbal") > 9000], [c("c_nationkey") < 12], [c("c_acctbal") < 0])).select("c_custkey")


# Statements and merging

add("d01_prepared", "SELECT 1", "SELECT c_custkey FROM customer WHERE c_nationkey = 5 AND c_acctbal > 100.5")
QUERIES["d01_prepared"] = lambda spark, d: engine(spark, d).sql("SELECT c_custkey FROM customer WHERE c_nationkey = ? AND c_acctbal > ?", [5, 100.5])


# Streaming, over the table that a stream would bring

@make("r10_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY ALL")
def _(spark, d):
    out = ingest.windowed(table(spark, d, "events"), "ts", "1 hour", ["event_type"], {"n": "count(1)", "total": "sum(value)"})
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")})


@make("r10_sessions", """
WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events),
g AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM s)
SELECT min(ts) AS session_start, max(ts) + INTERVAL 30 MINUTE AS session_end, user_id, count(*) AS n FROM g GROUP BY user_id, k""")
def _(spark, d):
    out = ingest.sessions(table(spark, d, "events"), "ts", "30 minutes", ["user_id"], {"n": "count(1)"})
    return out.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("session_start", "session_end")})


@make("r03_routing", "SELECT CASE WHEN event_type = 'purchase' THEN 'purchases' WHEN value > 100 THEN 'large' END AS target, count(*) AS n FROM events WHERE event_type = 'purchase' OR value > 100 GROUP BY ALL")
def _(spark, d):
    e = engine(spark, d)
    parts = e.routes(table(spark, d, "events"), {"purchases": 'event_type = "purchase"', "large": "value > 100", "none": ""})
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("target"))
        out = one if out is None else out.unionByName(one)
    return out.groupBy("target").agg(F.count(F.lit(1)).alias("n"))


@make("k16_exploded_children", "SELECT vec_id, generate_subscripts(embedding, 1)::INT - 1 AS pos, unnest(embedding) AS x FROM embeddings")
def _(spark, d):
    df = table(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.struct(x.alias("x"))).alias("e"))
    return relational.explode_children(df, "vec_id", "e")


# Scalar functions

def function(name: str, source: str, key: str, expressions: dict[str, tuple[str, str]]) -> None:
    """Function calls of the dialect, and what SQL says for each."""
    add(name, f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, (e, _) in expressions.items())} FROM {source}", f"SELECT {key}, {', '.join(f'{s} AS {n}' for n, (_, s) in expressions.items())} FROM {source}")


function("f01_math", "lineitem", "l_orderkey, l_linenumber", {"root": ("sqrt(l_quantity)", "sqrt(l_quantity)"), "power": ("pow(l_linenumber, 2)", "pow(l_linenumber, 2)"), "total": ("add(l_orderkey, l_linenumber, 1)", "l_orderkey + l_linenumber + 1")})
function("f02_logic", "customers_qa", "row_id", {"a": ("eq(city, 'Port Halstone')", "coalesce(city = 'Port Halstone', false)"), "b": ("ne(state, 'AK')", "state IS DISTINCT FROM 'AK'"), "c": ("gt(age, 30)", "age > 30"), "e": ("le(age, '30')", "age <= 30"), "f": ("not(isActive)", "NOT isActive"), "g": ("exists(city)", "city IS NOT NULL AND city <> ''"), "h": ("any(age, isActive)", "coalesce(age > 0, false) OR coalesce(isActive, false)"), "i": ("all(age, isActive)", "coalesce(age > 0, false) AND coalesce(isActive, false)"), "j": ("oneof(first_name, last_name, 'nobody')", "coalesce(nullif(first_name, ''), nullif(last_name, ''), 'nobody')")})
function("f03_strings", "part", "p_partkey", {"a": ("tolower(p_name)", "lower(p_name)"), "b": ("string.uppercase(p_name)", "upper(p_name)"), "c": ("contains(p_name, 'blue')", "contains(p_name, 'blue')"), "e": ("replace(p_type, ' ', '_')", "replace(p_type, ' ', '_')"), "f": ("hasprefix(p_brand, 'Brand#1')", "starts_with(p_brand, 'Brand#1')"), "g": ("hassuffix(p_type, 'MY')", "ends_with(p_type, 'MY')"), "h": ("len(p_name)", "strlen(p_name)"), "i": ("join(p_brand, p_type, '-')", "p_brand || '-' || p_type"), "j": ("strip(p_name)", "trim(p_name)"), "k": ("array.index(split(p_type, ' '), -1)", "string_split(p_type, ' ')[-1]"), "l": ("len(split(p_type, ' '))", "len(string_split(p_type, ' '))")})
function("f04_dates", "events", "event_id", {"a": ("yy(ts)", "year(ts) % 100"), "b": ("mm(ts)", "month(ts)"), "c": ("dayofweek(ts)", "dayofweek(ts)"), "e": ("hourofday(ts)", "hour(ts)"), "f": ("hourofweek(ts)", "dayofweek(ts) * 24 + hour(ts)"), "g": ("yymm(ts)", "strftime(ts, '%y%m')"), "h": ("totimestamp(ts)", "floor(epoch(ts))::BIGINT"), "i": ("strftime(ts, '%Y-%m-%d %H')", "strftime(ts, '%Y-%m-%d %H')"), "j": ("unixtrunc(ts, 'ms')", "(epoch_us(ts) // 1000)::VARCHAR"), "k": ("timediff(ts, todate('2024-01-01'), 'milliseconds')", "epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-01')")})
function("f05_hashes", "customer", "c_custkey", {"a": ("hash.md5(c_name)", "md5(c_name)"), "b": ("hash.sha1(c_name)", "sha1(c_name)"), "c": ("hash.sha256(c_name)", "sha256(c_name)"), "e": ("encoding.b64encode(c_name)", "base64(encode(c_name))"), "f": ("encoding.b64decode(encoding.b64encode(c_name))", "c_name")})
function("f06_casts", "customers_qa", "row_id", {"a": ("toint(height)", "CASE WHEN regexp_full_match(replace(replace(height, ',', ''), ' ', ''), '[-+]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][-+]?[0-9]+)?') THEN trunc(try_cast(replace(replace(height, ',', ''), ' ', '') AS DOUBLE))::BIGINT END"), "b": ("tostring(age)", "age::VARCHAR"), "c": ("cast(age AS float)", "age::DOUBLE"), "e": ("tobool(isActive)", "isActive")})
function("f07_email", "users", "row_id", {"a": ("emaildomain(email)", "CASE WHEN regexp_full_match(email, '\\s*[^<>@\\s,;]+@[^<>@\\s,;]+\\s*') THEN lower(regexp_extract(email, '@([^<>@\\s,;]+)', 1)) END"), "b": ("email(email)", "CASE WHEN regexp_full_match(email, '\\s*[^<>@\\s,;]+@[^<>@\\s,;]+\\s*') THEN lower(trim(email, E' \\t\\n\\r')) END")})
@make("f09_urls", "SELECT doc_id, 'www.x' || doc_id || '.example.com' AS host, 'example.com' AS domain, '/p/' || doc_id AS path, 'A' AS q2, 'a' AS q1, 'www.X' || doc_id || '.Example.com/p/' || doc_id AS main, 'http://www.X' || doc_id || '.Example.com/p/' || doc_id || '?r=2' AS less FROM documents")
def _(spark, d):
    e = engine(spark, d)
    e.register("links", table(spark, d, "documents").select("doc_id", F.concat(F.lit("http://www.X"), "doc_id", F.lit(".Example.com/p/"), "doc_id", F.lit("?q=A&r=2")).alias("u")))
    return e.sql("SELECT doc_id, host(u) AS host, domain(u) AS domain, path(u) AS path, qs2(u, 'q') AS q2, qs(u, 'q') AS q1, urlmain(u) AS main, urlminusqs(u, 'q') AS less FROM links")


@make("f10_maps", "SELECT n_nationkey, n_name AS k, len(n_name) AS n FROM nation")
def _(spark, d):
    return engine(spark, d).sql("SELECT n_nationkey, array.index(mapkeys(map(n_name, n_regionkey)), 0) AS k, len(n_name) AS n FROM nation")


@make("f11_embedding_slices", "SELECT vec_id, len(embedding) AS n, embedding[1] AS first, embedding[-1] AS last, len(embedding[3:6]) AS four FROM embeddings")
def _(spark, d):
    return engine(spark, d).sql("SELECT vec_id, len(embedding) AS n, array.index(embedding, 0) AS first, array.index(embedding, -1) AS last, len(array.slice(embedding, 2, 6)) AS four FROM embeddings")
