"""Queries that call the scalar functions which the dialect's own statements leave out, and the SQL of each."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyforge.plans.compiler import Compiler, scope_of
from tallyforge.plans.parser import parse_expression
from tallyforge.queries.reference import make
from tallyforge.session import table

_NOW = "2024-06-01 12:00:00"


def scalars(name: str, source: str, key: str, calls: dict[str, tuple[str, str]], made: dict[str, tuple[str, str]] | None = None) -> None:
    """Calls in the expression language over a table; made: columns to be added before, as Spark and the other SQL say them."""
    made = made or {}
    extra = "".join(f", {sql} AS {n}" for n, (_, sql) in made.items())

    @make(name, f"SELECT {key}, {', '.join(f'{sql} AS {n}' for n, (_, sql) in calls.items())} FROM (SELECT *{extra} FROM {source}) AS x")
    def _(spark, d):
        df = table(spark, d, source).withColumns({n: F.expr(e) for n, (e, _) in made.items()})
        c = Compiler(scope_of(df), "filter", now=F.lit(_NOW).cast("timestamp"))
        return df.select(key, *(c.value(parse_expression(e)).col.alias(n) for n, (e, _) in calls.items()))


scalars("f12_numbers", "customers_qa", "row_id", {
    "a": ("ge(age, 30)", "age >= 30"), "b": ("lt(age, 30)", "age < 30"), "c": ("sum(age, numFamilyMembers)", "nullif((age + numFamilyMembers)::DOUBLE, 0)"), "e": ("avg(age, numFamilyMembers)", "(age + numFamilyMembers) / 2.0::DOUBLE"), "f": ("count(city)", "CASE WHEN city IS NOT NULL THEN 1 END"),
    "g": ("tonumber(rownum)", "rownum::DOUBLE"), "h": ("tonumber(concatenated)", "(age::VARCHAR || '.5')::DOUBLE"), "i": ("oneof(city, state)", "coalesce(nullif(city, ''), nullif(state, ''))"), "j": ("ge(absent, 1)", "NULL::BOOLEAN"),
}, {"concatenated": ("concat(age, '.5')", "age::VARCHAR || '.5'")})

scalars("f13_text", "part", "p_partkey", {
    "a": ("string.lowercase(p_type)", "lower(p_type)"), "b": ("string.titlecase(p_name)", "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || w[2:]), ' ')"), "c": ("char_length(p_name)", "strlen(p_name)"), "e": ('join(filter(split(p_name, " "), "re*", "blue"), "-")', "nullif(array_to_string(list_filter(string_split(p_name, ' '), lambda w: NOT (starts_with(w, 're') OR starts_with(w, 'blue'))), '-'), '')"),
    "f": ('join(filtermatch(split(p_name, " "), "*i*"), "-")', "nullif(array_to_string(list_filter(string_split(p_name, ' '), lambda w: contains(w, 'i')), '-'), '')"), "g": ("version()", "'8.0.12'"), "h": ("database()", "'default'"), "i": ("len(uuid())", "36"), "j": ('urldecode(coded)', "p_name || '+%' || p_brand"),
}, {"coded": ("concat(replace(p_name, ' ', '+'), '%2B%25', replace(p_brand, '#', '%23'))", "''")})

scalars("f14_maps", "nation", "n_nationkey", {
    "a": ("array.index(mapvalues(map(n_name, n_regionkey)), 0)", "n_regionkey"), "b": ("array.index(mapkeys(mapinvert(map(n_name, n_regionkey))), 0)", "n_regionkey::VARCHAR"), "c": ("array.index(mapvalues(mapinvert(map(n_name, n_regionkey))), 0)", "n_name"), "e": ('array.index(mapkeys(maptime("k", "2024-02-03")), 0)', "'k'"), "f": ('totimestamp(array.index(mapvalues(maptime("k", "2024-02-03 04:05:06")), 0))', "epoch(TIMESTAMP '2024-02-03 04:05:06')::BIGINT"),
    "g": ('totimestamp(array.index(mapvalues(maptime("k")), 0))', f"epoch(TIMESTAMP '{_NOW}')::BIGINT"), "h": ('join(mapkeys(match("n_na")), "-")', "'tionkey-me'"), "i": ('array.index(mapvalues(match("n_name")), 0)', "n_name"), "j": ("len(map(n_name, n_regionkey))", "1"),
})

scalars("f15_times", "events", "event_id", {
    "a": ("totimestamp(todatein(local, \"America/Denver\"))", "epoch(timezone('America/Denver', date_trunc('second', ts)))::BIGINT"), "b": ("monthofyear(ts)", "month(ts)"), "c": ("seconds(ts)", "floor(epoch(ts))::DOUBLE"), "e": ("seconds(clock)", "(minute(ts) * 60 + second(ts))::DOUBLE"), "f": ('extract(ts, "%B %d")', "strftime(ts, '%B %d')"), "g": ("timediff(now(), ts, \"hours\")", f"epoch_us(TIMESTAMP '{_NOW}' - ts) / 3.6e9"),
    "h": ("hourofday()", "12"), "i": ('totimestamp(todate("2006.01.02 15:04:05", dotted))', "floor(epoch(ts))::BIGINT"), "j": ("yymm()", "'2406'"),
}, {"local": ("date_format(ts, 'yyyy-MM-dd HH:mm:ss')", "''"), "clock": ("date_format(ts, \"'M'mm:ss\")", "''"), "dotted": ("date_format(ts, 'yyyy.MM.dd HH:mm:ss')", "''")})

# Addresses in several shapes, from each event's own values
_U = {
    "u": (
        "concat(array('http://', 'https://', '', 'ftp://', 'HTTP://me:pw@')[cast(event_id % 5 as int)], 'Shop', user_id, '.Example.', array('com', 'org', 'co.uk')[cast(event_id % 3 as int)], if(event_id % 4 = 0, ':8080', ''), '/Path/', event_type, if(event_id % 7 = 0, '', concat('?Q=', user_id, 'A&mc_b=', event_id, '&z=a%20B+c&mc_a=1')), if(event_id % 11 = 0, '#end', ''))",
        "['http://', 'https://', '', 'ftp://', 'HTTP://me:pw@'][event_id % 5 + 1] || 'Shop' || user_id || '.Example.' || ['com', 'org', 'co.uk'][event_id % 3 + 1] || CASE WHEN event_id % 4 = 0 THEN ':8080' ELSE '' END || '/Path/' || event_type || CASE WHEN event_id % 7 = 0 THEN '' ELSE '?Q=' || user_id || 'A&mc_b=' || event_id || '&z=a%20B+c&mc_a=1' END || CASE WHEN event_id % 11 = 0 THEN '#end' ELSE '' END",
    )
}
_HOST = "'shop' || user_id || '.example.' || ['com', 'org', 'co.uk'][event_id % 3 + 1]"
_DOMAIN = "['example.com', 'example.org', 'co.uk'][event_id % 3 + 1]"
_AUTHORITY = "CASE WHEN event_id % 5 = 4 THEN 'me:pw@' ELSE '' END || 'Shop' || user_id || '.Example.' || ['com', 'org', 'co.uk'][event_id % 3 + 1] || CASE WHEN event_id % 4 = 0 THEN ':8080' ELSE '' END || '/Path/' || event_type"
scalars("f16_urls", "events", "event_id", {
    "a": ("host(u)", _HOST), "b": ("domain(u)", _DOMAIN), "c": ('join(hosts(u, "www.Other.net/x"), " ")', _HOST + " || ' ' || 'www.other.net'"), "e": ('join(domains(u, "www.Other.net/x"), " ")', _DOMAIN + " || ' ' || 'other.net'"),
    "f": ('qsl(u, "q")', "CASE WHEN event_id % 7 <> 0 THEN user_id || 'a' END"), "g": ('qs2(u, "z")', "CASE WHEN event_id % 7 <> 0 THEN 'a B c' END"), "i": ('url.matchqs(u, "mc_*")', _AUTHORITY + " || CASE WHEN event_id % 7 <> 0 THEN '?mc_a=1&mc_b=' || event_id ELSE '' END"),
    "h": ('url.matchqs(u)', _AUTHORITY),
}, _U)

_AGENTS = [
    ("Mozilla/5.0 (Windows NT 10.0; Win64; x64) AppleWebKit/537.36 (KHTML, like Gecko) Chrome/120.0.0.0 Safari/537.36", "Chrome", "120.0.0.0", "Windows NT 10.0", "false", "false", "537.36"),
    ("Mozilla/5.0 (iPhone; CPU iPhone OS 17_0 like Mac OS X) AppleWebKit/605.1.15 (KHTML, like Gecko) Version/17.0 Mobile/15E148 Safari/604.1", "Safari", "604.1", "CPU iPhone OS 17_0 like Mac OS X", "true", "false", "605.1.15"),
    ("Mozilla/5.0 (X11; Linux x86_64; rv:121.0) Gecko/20100101 Firefox/121.0", "Firefox", "121.0", "Linux x86_64", "false", "false", "20100101"),
    ("SomeBot/2.1 (+http://bots.example)", "", "", "", "false", "true", ""),
]
_pick = lambda i: "[" + ", ".join("'" + a[i] + "'" for a in _AGENTS) + "][event_id % 4 + 1]"
scalars("f17_agents", "events", "event_id", {
    "a": ('useragent(ua, "browser")', _pick(1)), "b": ('useragent(ua, "browser_version")', _pick(2)), "c": ('useragent(ua, "os")', _pick(3)), "e": ('useragent(ua, "mobile")', _pick(4)), "f": ('useragent(ua, "bot")', _pick(5)), "g": ('useragent(ua, "nothing")', "NULL::VARCHAR"), "h": ('len(useragent.map(ua))', "9"), "i": ('useragent(ua, "engine_version")', _pick(6)),
}, {"ua": ("array(" + ", ".join(f"'{a[0]}'" for a in _AGENTS) + ")[cast(event_id % 4 as int)]", "''")})

_GOOD = r"regexp_full_match(email, '[^<>@\s,;]+@[^<>@\s,;]+')"
scalars("f18_mail", "users", "row_id", {
    "a": ("emailname(named)", f"CASE WHEN {_GOOD} THEN 'The ' || user_id END"), "b": ("email(named)", f"CASE WHEN {_GOOD} THEN lower(email) END"), "c": ("emaildomain(named)", f"CASE WHEN {_GOOD} THEN lower(regexp_extract(email, '@(.*)$', 1)) END"),
}, {"named": (r"concat('\"The ', user_id, '\" <', email, '>')", "''")})

scalars("f08_json", "events", "event_id", {
    "a": ('json.jmespath(props, "k")', "props->>'$.k'"), "b": ('json.jmespath(props, "[k, k]")', "'[' || (props->>'$.k') || ',' || (props->>'$.k') || ']'"), "c": ('json.jmespath(nested, "a[?n > `50`].n | [0]")', "CASE WHEN (props->>'$.k')::INT > 50 THEN props->>'$.k' END"), "e": ('json.jmespath(nested, "a[1].b.c")', "event_type"), "f": ('json.jmespath(event_type, "a | [0]")', "NULL::VARCHAR"),
}, {"nested": ("concat('{\"a\": [{\"n\": ', get_json_object(props, '$.k'), '}, {\"b\": {\"c\": \"', event_type, '\"}}]}')", "''")})

# MurmurHash64A in whole numbers of 128 bits, over names of 18 bytes
_T, _M = "18446744073709551616::UHUGEINT", "14313749767032793493::UHUGEINT"
_word = lambda a, n: "(" + " + ".join(f"ascii(substr(c_name, {a + i + 1}, 1))::UHUGEINT * {256**i}::UHUGEINT" for i in range(n)) + ")"
_mul = lambda x: f"(({x}) * {_M} % {_T})"
_fold = lambda x: f"xor({x}, {x} // 140737488355328::UHUGEINT)"
_HASH = f"""
WITH a AS (SELECT c_custkey, {_mul(_word(0, 8))} AS k, {_mul(_word(8, 8))} AS l, {_word(16, 2)} AS tail, xor(1::UHUGEINT, 18::UHUGEINT * {_M} % {_T}) AS h FROM customer WHERE strlen(c_name) = 18),
b AS (SELECT *, {_mul(_fold('k'))} AS k2, {_mul(_fold('l'))} AS l2 FROM a),
c AS (SELECT *, {_mul('xor(h, k2)')} AS h1 FROM b), e AS (SELECT *, {_mul('xor(h1, l2)')} AS h2 FROM c), f AS (SELECT *, {_mul('xor(h2, tail)')} AS h3 FROM e), g AS (SELECT *, {_mul(_fold('h3'))} AS h4 FROM f), i AS (SELECT *, {_fold('h4')} AS h5 FROM g)
SELECT c_custkey, (CASE WHEN h5 >= 9223372036854775808::UHUGEINT THEN h5::HUGEINT - 18446744073709551616::HUGEINT ELSE h5::HUGEINT END)::BIGINT AS hashed FROM i"""


@make("f19_hash", _HASH)
def _(spark, d):
    df = table(spark, d, "customer")
    return df.select("c_custkey", Compiler(scope_of(df), "filter").value(parse_expression("hash(c_name)")).col.alias("hashed"))


@make("f20_hashes_rows", None)
def _(spark, d):
    """No SQL here has these; the tests hold them against plain versions."""
    df = table(spark, d, "customer")
    c = Compiler(scope_of(df), "filter")
    return df.select("c_custkey", c.value(parse_expression("hash.sip(c_name)")).col.alias("sip"), c.value(parse_expression("hash.sha512(c_name)")).col.alias("sha512"))


@make("p27_whole_sample", "SELECT l_returnflag, count(*) AS n, true AS about_a_tenth FROM lineitem GROUP BY l_returnflag")
def _(spark, d):
    from tallyforge.queries.reference import engine

    e = engine(spark, d)
    every = e.sql("SELECT l_returnflag, count(*) AS n FROM lineitem WHERE sample_stratified('l_returnflag', 100) GROUP BY l_returnflag")
    tenth = e.sql("SELECT l_returnflag, count(*) AS few FROM lineitem WHERE sample_stratified('l_returnflag', 10) GROUP BY l_returnflag")
    return every.join(tenth, "l_returnflag").select("l_returnflag", "n", F.expr("few between 0.06 * n and 0.14 * n").alias("about_a_tenth"))
