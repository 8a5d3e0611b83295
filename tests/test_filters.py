"""The filter language and the functions, over one record of a measuring station."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from tallyforge.engine import Engine
from tallyforge.functions import jmespath
from tallyforge.functions.registry import WrongArguments, register
from tallyforge.plans import values as V
from tallyforge.plans.compiler import Compiler, NotAllowed, scope_of
from tallyforge.plans.parser import parse_expression
from tallyforge.plans.search_json import query_document
from tallyforge.plans.syntax import SyntaxProblem

NOW = datetime(2031, 5, 17, 9)


@pytest.fixture(scope="module")
def station(spark):
    return spark.createDataFrame(
        [("Brocken", ["wind", "snow", "sun"], ("Harz", 38879), {"gusts": 12, "calm": 0}, datetime(2031, 5, 10, 6), datetime(2031, 5, 17, 8, 30), False, 1141.5, '{"probes":[{"id":"p1","ok":true},{"id":"p2"}],"owner":{"name":"met"}}', "")],
        "site string, sensors array<string>, place struct<range:string,zip:int>, counts map<string,bigint>, built timestamp, seen timestamp, manned boolean, height double, notes string, blank string",
    )


# Each kind of predicate: cases that hold, and cases that don't
HOLD = {
    "comparison": ['site == "Brocken"', 'site != "Zugspitze"', "height > 1141", "height >= 1141.5", "height < 1e4", "NOT height <= 3", '"Harz" == place.range', "place.zip == 38879", "counts.gusts == 12", "manned == false", "`site` == 'Brocken'"],
    "missing fields": ['altitude != "x"', "NOT altitude > 3", 'NOT altitude == "x"', "NOT EXISTS altitude", "EXISTS blank", "NOT counts.storms > 1"],
    "existence": ["EXISTS site", "EXISTS sensors", "EXISTS counts", "*"],
    "patterns": ['site LIKE "Bro*"', 'site LIKE "*ock*"', 'site NOT LIKE "*spitze"', 'site CONTAINS "cke"', 'site NOT CONTAINS "z"'],
    "lists and maps": ['sensors INTERSECTS ("snow", "rain")', 'sensors NOT INTERSECTS ("rain", "hail")', '"wind" IN sensors', 'site IN ("Wendelstein", "Brocken")', 'counts IN ("calm")', 'counts NOT IN ("storms")'],
    "ranges": ["height BETWEEN 1141 AND 1142", 'built BETWEEN "2031-05-01" AND "2031-06-01"', "NOT height BETWEEN 1141.5 AND 2000"],
    "dates": ['built < "now-3d"', 'seen > "now-1h"', 'NOT seen > "now-10m"', 'built > "now-2w"'],
    "trees": ['AND ( EXISTS site, height > 1000, OR ( manned == true place.zip > 1 ) )', 'OR ( site == "?", NOT AND ( manned == true height > 0 ) )', "INCLUDE high", "NOT INCLUDE low", "AND ( INCLUDE high NOT INCLUDE low )"],
    "functions": ['toupper_is(site, "BROCKEN")', "len(sensors) == 3", 'hasprefix(site, "Bro")'],
}
FAIL = ['site == "brocken"', "height > 1141.5", 'altitude == "x"', "EXISTS altitude", 'site LIKE "ock"', 'sensors INTERSECTS ("rain")', "height BETWEEN 1141.5 AND 2000", 'seen < "now-1h"', "INCLUDE low", 'counts IN ("storms")']


@pytest.mark.parametrize(("text", "hit"), [(t, 1) for kind in HOLD.values() for t in kind] + [(t, 0) for t in FAIL])
def test_filters(spark, station, text, hit):
    register("toupper_is", lambda ctx, x, y: V.boolean(F.upper(V.as_text(x)) == V.as_text(y)), 2, 2)
    e = Engine(spark)
    e.save_filters("FILTER height >= 1000 ALIAS high; FILTER NOT INCLUDE high ALIAS low")
    assert e.filter(f"FILTER {text}", station, F.lit(NOW)).count() == hit


def test_filters_that_include_themselves(spark, station):
    e = Engine(spark)
    e.save_filters("FILTER INCLUDE second ALIAS first; FILTER INCLUDE first ALIAS second")
    with pytest.raises(NotAllowed, match="itself"):
        e.filter("FILTER INCLUDE first", station)
    with pytest.raises(NotAllowed, match="no filter"):
        e.filter("FILTER INCLUDE third", station)
    e.register("stations", station)
    assert e.sql("SELECT site, height FROM stations FILTER height > 1 LIMIT 3").columns == ["site", "height"]
    assert e.sql("FILTER height > 1 FROM stations").count() == 1


VALUES = {
    # logic: missing, empty and zero
    "eq(height, 1141.5)": True, "eq(altitude, altitude)": False, "ne(altitude, 1)": True, "ge(height, 5 / 0)": None, "exists(blank)": False, "any(blank, counts.calm)": False, "all(height, manned)": False, 'oneof(blank, altitude, "spare")': "spare",
    # casts
    'tobool("false")': False, 'toint("$ 12,300.75")': 12300, 'tonumber("1,234.5")': 1234.5, "tostring(manned)": "false", 'cast("2030-02-03" AS date)': date(2030, 2, 3),
    # text
    'split("a;b;;c", ";")': ["a", "b", "", "c"], 'join(sensors, blank, "end", "+")': "wind+snow+sun+end", 'strip("\t pad ")': "pad", 'replace("x-y-z", "-")': "xyz", 'contains(sensors, "no")': True, 'hasprefix(site, "")': None, 'hassuffix(site, "ken")': True, 'len("süß")': 5, 'string.titlecase("high peak, low vale")': "High Peak, Low Vale",
    # lists and maps
    "array.index(sensors, -2)": "snow", "array.index(sensors, 3)": None, "array.slice(sensors, 1, 3)": ["snow", "sun"], "array.slice(sensors, 2, 9)": None, 'map("k", 2)': {"k": 2}, "len(mapkeys(counts))": 2, 'filter(sensors, "s*")': ["wind"], 'filtermatch(counts, "g")': {"gusts": 12}, 'match("hei")': {"ght": "1141.5"},
    # addresses
    'email("Ada L <Ada@Host.org>")': "ada@host.org", 'emailname("Ada L <ada@host.org>")': "Ada L", 'email("no address")': None, 'domain("https://data.Station.example/x")': "station.example", 'path("data.station.example")': None, 'qs("http://h.example/?Unit=MM", "unit")': "mm", 'qs2("http://h.example/?Unit=MM", "unit")': None, 'urldecode("a%2Fb+c")': "a/b c",
    'urlminusqs("http://h.example/p?a=1&b=2&a=3", "a")': "http://h.example/p?b=2", 'url.matchqs("http://h.example/p?x_b=2&y=1&x_a=3", "x_*")': "h.example/p?x_a=3&x_b=2",
    # dates
    'yy("2029-03-04")': 29, 'mm("2029-03-04")': 3, 'yymm("2029-03-04")': "2903", 'dayofweek("2029-03-04")': 0, 'hourofweek("2029-03-05 07:00:00")': 31, 'totimestamp("2001-09-09 01:46:40")': 1000000000, 'seconds("M2:05")': 125.0, 'strftime("2029-03-04", "%d.%m.%Y")': "04.03.2029", 'todate("02.01.2006", "25.12.2030")': datetime(2030, 12, 25),
    'todatein("2030-07-01 12:00:00", "Asia/Tokyo")': datetime(2030, 7, 1, 3), 'timediff("2030-01-03", "2030-01-01", "minutes")': 2880.0, 'unixtrunc("2001-09-09 01:46:40", "ms")': "1000000000000",
    # numbers
    "sum(height, [1, 2.5])": 1145.0, "avg(2, 4, 9)": 5.0, 'sum("x", 1)': None, "sqrt(-4)": None, "9 / 2": 4, "9.0 / 2": 4.5, "9 % 0": None, "add(2, 0.5)": 2.5,
    # hashes and JSON
    'hash.md5(blank)': None, 'encoding.b64decode("not base64")': None, 'encoding.b64decode(encoding.b64encode("süß"))': "süß", 'json.jmespath(notes, "owner.name")': "met", 'json.jmespath(notes, "probes[?ok].id | [0]")': "p1", 'json.jmespath(notes, "probes[*].id")': '["p1","p2"]', 'json.jmespath(site, "owner")': None,
}

#: Results that must be these, whatever the implementation.
FIXED = {'hash.sip("http://go.gl")': 4903078846009498015, "version()": "8.0.12"}


def test_values(station):
    c = Compiler(scope_of(station), "filter", now=F.lit(NOW))
    every = VALUES | FIXED
    cols = [c.value(parse_expression(e)).col.alias(f"c{i}") for i, e in enumerate(every)]
    got = station.select(*cols).first()
    assert {e: got[i] for i, e in enumerate(every)} == every


@pytest.mark.parametrize("text", ["not(site, site)", "eq(height)", "exists()", "all()", "tonumber(1, 2)", "now(site)", "mm(1, 2)", 'todatein("now+5parsecs", "Europe/Rome")', 'todatein("now", "Middle/Earth")', "array.index(sensors)", "unheard_of(1)", "cast(1 AS colour)"])
def test_wrong_arguments(station, text):
    with pytest.raises((WrongArguments, SyntaxProblem)):
        Compiler(scope_of(station), "filter").value(parse_expression(text))


def test_functions_of_ones_own(spark, station):
    register("half", lambda ctx, x: V.number(V.as_number(x) / 2), 1, 1)
    assert Engine(spark).filter("FILTER half(counts.gusts) == 6", station).count() == 1


def test_jmespath():
    doc = {"runs": [{"id": 3, "tags": ["dry"]}, {"id": 4, "tags": []}, {"id": 5}], "site": {"code": "b"}}
    for q, want in {"runs[*].id": [3, 4, 5], "runs[?id > `3`].id | [-1]": 5, "runs[].tags[]": ["dry"], "site.*": ["b"], "runs[1].id": 4, "runs[0:2].id": [3, 4], "[site.code, runs[2].id]": ["b", 5], "{c: site.code}": {"c": "b"}, "gone || site.code": "b", "!gone": True, "gone.code": None}.items():
        assert jmespath.search(jmespath.parse(q), doc) == want, q


def test_query_documents():
    doc = query_document(parse_expression('kind == "rain" AND NOT site LIKE "B*" AND (depth > 3 OR EXISTS probe)'))
    assert doc == {"bool": {"filter": [{"term": {"kind": "rain"}}, {"bool": {"must_not": [{"wildcard": {"site": "B*"}}]}}, {"bool": {"should": [{"range": {"depth": {"gt": 3}}}, {"exists": {"field": "probe"}}], "minimum_should_match": 1}}]}}


def test_text_search_sees_whole_words(spark):
    texts = {"The race of tokens": False, "a token; race": True, "TOKEN-race": False, "race's token": False, "token\nRACE!": True, "tokén race": False, "tokeń race": False, "race token race": True, "": False}
    df = spark.createDataFrame([*((t,) for t in texts), (None,)], "t string")
    c = Compiler(scope_of(df), "compat", searchable=frozenset({"t"}))
    assert {r.t for r in df.where(c.predicate(parse_expression("t LIKE 'the token race'"))).collect()} == {t for t, hit in texts.items() if hit}
