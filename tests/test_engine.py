"""Statements over a small store: what they count, change and refuse."""

import pytest

from tallyforge.engine import Engine
from tallyforge.plans.compiler import NotAllowed, UnknownColumn
from tallyforge.plans.syntax import SyntaxProblem
from tallyforge.rbac import Denied
from tallyforge.store import Rejected, TableStore
from tallyforge.types import BadSchema, TableSpec

PEOPLE = """
tableName: people
primaryKey: pid
secondaryKeys: name
attributes:
- {fieldName: pid, type: String, mappingStrategy: StringHashBSI}
- {fieldName: name, type: String}
- {fieldName: town, type: String, mappingStrategy: StringEnum}
- {fieldName: bio, type: String, searchable: true}
- {fieldName: seen, type: DateTime, mappingStrategy: SysMicroBSI, defaultValue: now()}
- {fieldName: millis, type: DateTime, mappingStrategy: SysMillisBSI}
- {fieldName: digest, type: String, defaultValue: hash.sha256(pid)}
- {fieldName: tags, type: String, mappingStrategy: StringEnum, nonExclusive: true, configuration: {delim: ";"}}
- {fieldName: active, type: Boolean, mappingStrategy: BoolDirect, defaultValue: 1}
- {fieldName: years, type: Integer, mappingStrategy: IntBSI}
- {fieldName: size, type: Float, scale: 2}
"""
ORDERS = """
tableName: buys
primaryKey: bid
attributes:
- {fieldName: bid, type: String}
- {fieldName: pid, type: String, mappingStrategy: ParentRelation, foreignKey: people.pid}
- {fieldName: via, type: String}
"""


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    store = TableStore(spark, str(tmp_path_factory.mktemp("store")))
    store.create(TableSpec.from_yaml(PEOPLE))
    store.create(TableSpec.from_yaml(ORDERS))
    e = Engine(spark, store)
    assert e.sql("insert into people (pid, name, town, tags, years, size, bio, millis) values ('1','Ann','Ulm','a;b',40,1.25,'The quick fox','2020-01-02 03:04:05.678901'),('2','Bob','Bonn','b',50,2.5,'lazy dog','2021-05-06'),('3','Cy','Ulm','c;a',42,72.55,'quick dog jumps',null)") == 3
    assert e.sql("insert into people (pid, name) values ('4','Dee'),('5','Eve')") == 2
    assert e.sql("insert into people (pid, active) values ('6', false)") == 1
    assert e.sql("insert into buys (bid, pid, via) values ('x','1','ship'),('y','1','rail'),('z','6','rail')") == 3
    return e


def count(e, text, params=None):
    rows = e.sql(text, params).collect()
    return rows[0][0] if text.startswith("select count(*)") else len(rows)


@pytest.mark.parametrize(
    ("text", "n"),
    [
        ("select * from people", 6), ("select distinct town from people", 3), ("select pid from people where name != 'Bob'", 5), ("select pid from people where town not in ('Ulm') and town != null", 1),
        ("select pid from people where town is null", 3), ("select pid from people where digest = NULL", 0), ("select pid from people where seen > todate('now-1d')", 6), ("select pid from people where seen < 'now-1d'", 0),
        ("select pid from people where tags = 'a'", 2), ("select pid from people where tags != 'a'", 4), ("select pid from people where years not between 41 and 43", 5), ("select pid from people where years not between 41 and 43 and years != null", 2),
        ("select pid from people where size = 72.55000", 1), ("select pid from people where millis between '2020-01-01' and '2020-12-31'", 1), ("select count(*) from people where active = 1", 5), ("select count(*) from people where active != true", 1),
        ("select name as n, town as t from people where n = 'Ann' and t = 'Ulm'", 1), ("select max(years) as m from people where m = 42", 1), ("select pid from people where bio like 'the quick'", 2), ("select pid from people limit 2", 2), ("select pid from people where name = 'Ann' or years = 50", 2),
        ("select o.via, c.name from people as c inner join buys as o on c.pid = o.pid", 3), ("select c.pid, o.pid from people as c outer join buys as o on o.pid == c.pid", 7), ("select * from people as c inner join buys as o on c.pid = o.pid where c.town != 'Ulm'", 1),
        ("select pid from people where pid not in (select pid from buys)", 4), ("select count(*) from people where pid in (select pid from buys)", 3), ("select pid from people where name = 'Bob' or pid in (select pid from buys where via = 'ship')", 2),
        ("select tags, count(*) as n from people group by tags", 3), ("select town, avg(years) as a from people group by town having a > 40", 2), ("select topn(town) from people", 3), ("select pid from people where @rownum = 1", 1),
        ("select pid from people where years = ? and town = ?", 1),
    ],
)
def test_counts(engine, text, n):
    assert count(engine, text, [40, "Ulm"] if "?" in text else None) == n


@pytest.mark.parametrize(
    ("text", "error", "words"),
    [
        ("select nothing from people", UnknownColumn, "nothing"), ("select pid from nowhere", NotAllowed, "Could not find a DataSource"), ("delete from people", NotAllowed, "must provide a predicate"), ("update people set name = 'x'", NotAllowed, "must provide a predicate"),
        ("update people set pid = '9' where name = 'Ann'", NotAllowed, "primary key"), ("update people set nope = 1 where name = 'Ann'", UnknownColumn, "nope"), ("select pid from people where size = 1.255", NotAllowed, "2 decimal places"),
        ("insert into people (pid, size) values ('9', 1.255)", Rejected, "2 decimal places"), ("insert into people (name) values ('x')", Rejected, "required"), ("select pid from people where name between 'a' and 'b'", NotAllowed, "strings"),
        ("select sum(name) from people", NotAllowed, "non-numeric"), ("select years, years from people", NotAllowed, "aliases"), ("selec 1", SyntaxProblem, "statement"), ("select a from b cross join c on a = b", SyntaxProblem, "CROSS"),
        ("insert into buys (bid, pid) values ('n', 'nobody')", Rejected, "no people nobody"), ("select pid from people where pid in (select pid, name from people)", NotAllowed, "exactly one"), ("select c.name from buys as o right join people as c on c.pid = o.pid", NotAllowed, "right"),
    ],
)
def test_refusals(engine, text, error, words):
    with pytest.raises(error, match=words):
        engine.sql(text)


def test_values_in_and_out(engine):
    r = engine.sql("select digest, millis, tags, size, active from people where pid = '1'").first()
    assert len(r.digest) == 64 and r.millis.microsecond == 678000 and r.tags == ["a", "b"] and str(r["size"]) == "1.25" and r.active is True
    top = engine.sql("select topn(town, 1) from people").collect()
    assert [(t[0], t[1]) for t in top] == [("Ulm", 2), ("OTHER:", 1), ("TOTAL:", 3)]
    assert engine.sql("select avg(years) as a from people").first().a == 44
    out = engine.sql("select name, years if years > 45 from people order by name desc limit 5, 3").collect()
    assert [tuple(x) for x in out] == [(None, None)]


def test_changes(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    store.create(TableSpec.from_yaml(PEOPLE))
    e = Engine(spark, store)
    e.sql("insert into people (pid, name, tags, years) values ('1','Ann','a',1),('2','Bob','b',2),('2','Bo','c',3)")
    assert sorted((r.pid, r.name, r.tags) for r in store.read("people").collect()) == [("1", "Ann", ["a"]), ("2", "Bo", ["c"])]
    e.sql("insert into people (pid, tags) values ('1','z')")
    assert [tuple(r) for r in e.sql("select name, tags from people where pid = '1'").collect()] == [("Ann", ["a", "z"])]
    assert e.sql("update people set tags = 'q' where pid = '1'") == 1
    assert e.sql("select tags from people where pid = '1'").first().tags == ["a", "z", "q"]
    assert e.sql("update people set tags = null, years = null where pid = '1'") == 1
    assert e.sql("select count(*) from people where tags is null and years is null").first()[0] == 1
    assert e.sql("update people set years = 9 where years > 100") == 0
    e.register("older", spark.createDataFrame([("7", "Old", 70)], "p string, n string, y bigint"))
    assert e.sql("insert into people (pid, name, years) select p, n, y from older") == 1
    assert e.sql("delete from people where pid is null") == 0
    assert e.sql("delete from people where years > 60") == 1
    assert e.sql("delete from people where pid != null") == 2
    assert store.read("people").collect() == [] and e.sql("commit") == 0
    rows = store.partitions("people").collect()
    assert rows == []


def test_partitions_and_schema_rules(spark, tmp_path):
    store = TableStore(spark, str(tmp_path))
    spec = TableSpec.from_dict({"tableName": "log", "primaryKey": "name", "timeQuantumField": "at", "timeQuantumType": "YMD", "attributes": [{"fieldName": "at", "type": "DateTime"}, {"fieldName": "name"}, {"fieldName": "n", "type": "Integer"}]})
    assert spec.key == ("at", "name")
    store.create(spec)
    e = Engine(spark, store)
    e.sql("insert into log (at, name, n) values ('2024-01-01 05:00:00','a',1),('2024-01-02 06:00:00','b',2),('2024-02-01','c',3)")
    assert sorted(r.partition for r in store.partitions("log").collect()) == ["2024-01-01", "2024-01-02", "2024-02-01"]
    df = e.sql("select name from log where at >= '2024-01-02' and at < '2024-01-03'")
    assert [r.name for r in df.collect()] == ["b"]
    assert "PartitionFilters: [isnotnull(_part" in df._jdf.queryExecution().toString()
    assert e.sql("select name from log where @timestamp between '2024-01-01' and '2024-01-02 00:00:00'").count() == 2
    assert store.purge("log", "2024-02") == ["2024-01-01", "2024-01-02"] and store.read("log").count() == 1
    with pytest.raises(BadSchema, match="cannot be dropped"):
        spec.compare(TableSpec.from_dict({"tableName": "log", "primaryKey": "name", "timeQuantumField": "at", "timeQuantumType": "YMD", "attributes": [{"fieldName": "at", "type": "DateTime"}, {"fieldName": "name"}]}))
    with pytest.raises(BadSchema, match="parent"):
        store.create(TableSpec.from_yaml(ORDERS))
    with pytest.raises(BadSchema, match="quantum"):
        TableSpec.from_dict({"tableName": "x", "primaryKey": "a", "timeQuantumField": "a", "timeQuantumType": "YMD", "attributes": [{"fieldName": "a"}]})
    e.sql("alter table log add column extra int")
    assert e.sql("select extra from log").first().extra is None
    assert e.sql("describe log").count() == 4 and e.sql("show tables").first()[0] == "log"
    assert e.sql("show keys from log").count() == 2 and "CREATE TABLE" in e.sql("show create table log").first()[1]
    assert e.sql("show variables like 'version%'").first().Value == "8.0.12"
    e.sql("create table made (id int primary key, word varchar(20) not null)")
    e.sql("insert into made (id, word) values (5, 'five')")
    assert e.sql("select word from made where id = 5").first().word == "five"
    e.sql("create view v as select name from log")
    assert e.sql("select count(*) as c from v").first().c == 1
    e.sql("drop table made")
    with pytest.raises(NotAllowed):
        e.sql("select * from made")


def test_into_files(engine, spark, tmp_path):
    n = engine.sql(f"select pid, name, tags from people where name != null into '{tmp_path}/out' with delimiter=',', format=csv")
    back = spark.read.option("header", True).csv(f"{tmp_path}/out")
    assert n == 5 and back.count() == 5 and back.columns == ["pid", "name", "tags"]
    engine.sql(f"select pid, years from people into '{tmp_path}/p' with format=parquet")
    assert dict(spark.read.parquet(f"{tmp_path}/p").dtypes) == {"pid": "string", "years": "string"}
    got = []
    from tallyforge.sinks import register_sink

    register_sink("memo", lambda df, target, options: got.append((target, df.count())))
    engine.sql("select pid from people into 'memo://x'")
    assert got == [("memo://x", 6)]


def test_roles(engine):
    e = Engine(engine.spark, engine.store, user="u")
    e.roles.grant("root", "SystemAdmin")
    with pytest.raises(Denied):
        e.sql("select * from people")
    e.roles.grant("chief", "DomainAdmin", "default", by="root")
    e.roles.grant("u", "DomainUser", "default", by="chief")
    assert e.sql("select * from people").count() == 6
    for text in ("insert into people (pid) values ('q')", "create view x as select 1", "delete from people where pid = 'q'", "select pid from people into 'memo://y'"):
        with pytest.raises(Denied):
            e.sql(text)
    for user, role, by in (("u", "DomainAdmin", "u"), ("u", "SystemAdmin", "chief"), ("x", "DomainAdmin", "u")):
        with pytest.raises(Denied):
            e.roles.grant(user, role, "default", by=by)
    e.roles.revoke("u", "default", by="chief")
    assert not e.roles.permits("u", "ViewDatabase", "default") and e.roles.permits("root", "CreateOrAlterView", "other")


def test_standard_logic(engine):
    e = Engine(engine.spark, engine.store, compat=False)
    assert e.sql("select pid from people where name != 'Bob'").count() == 4
    assert e.sql("select town, count(*) as n from people group by town").count() == 3
    assert e.sql("select pid from people where pid in (select pid from buys)").count() == 2
    assert e.sql("select count(years) as n from people").first().n == 3
    assert "HashAggregate" in "".join(r.plan for r in e.sql("explain select town, count(*) as n from people group by town").collect())


def test_shell_and_metadata(engine, tmp_path):
    from tallyforge.__main__ import shown, statements

    assert statements("select ';' as a; -- gone\n select 2 as b;") == ["select ';' as a", "-- gone\n select 2 as b"]
    assert shown(engine.sql("select pid, name, tags from people where pid = '4' or pid = '1' order by pid")).split() == ["pid", "name", "tags", "1", "Ann", "a;b", "4", "Dee", "NULL"]
    assert engine.sql("select count(*) as n from information_schema.tables where `Table` = 'people'").first().n == 1
    assert engine.sql("show columns from people like 'na%'").first().Field == "name"
    assert engine.sql("show functions where Name = 'hash.md5'").count() == 1 and engine.sql("show engines").count() == 1
    engine.sql("set @limit_of = 3, names_in = utf8")
    assert engine.variables["@limit_of"] == 3
    assert engine.sql("prepare one from 'select pid from people where name = ?'") == 0
    assert engine.sql("execute one", ["Bob"]).first().pid == "2"
    text = Engine(engine.spark, order_as_text=True, compat=False)
    text.register("n", engine.spark.createDataFrame([(10,), (9,), (None,)], "v int"))
    assert [r.v for r in text.sql("select v from n order by v").collect()] == [None, 10, 9]
    assert engine.sql(f"select pid from people into '{tmp_path}/t' with timeout=60, threads=2") == 6
    short = Engine(engine.spark, engine.store, default_limit=2)
    assert short.sql("select pid from people").count() == 2


def test_store_helpers(engine):
    store = engine.store
    assert [r.name for r in store.find("people", {"pid": "1"}).collect()] == ["Ann"] and store.find("people", {"name": "Bob"}).count() == 1
    with pytest.raises(NotAllowed, match="no key"):
        store.find("people", {"town": "Ulm"})
    assert store.verify("buys") == {"rows": 3, "repeated_keys": 0, "misplaced": 0, "orphans of pid": 0}
    store.refresh()
    assert store.tables() == ["buys", "people"]
    with pytest.raises(BadSchema, match="refers"):
        store.drop("people")
