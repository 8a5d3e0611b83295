import json
import sqlite3

import pytest

from tallyforge.engine import Engine
from tallyforge.sources import readers
from tallyforge.store import TableStore
from tallyforge.streaming import ingest
from tallyforge.types import TableSpec


def test_files_and_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,word,when\n1,"x, y",2020-01-01\n2,,2020-01-02\n')
    (tmp_path / "b.json").write_text('{"id": 1, "deep": {"k": [1, 2]}}\n{"id": 2}\n')
    df = readers.csv(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in df.collect()] == [("1", "x, y", "2020-01-01"), ("2", None, "2020-01-02")]
    assert [f.dataType.simpleString() for f in readers.fitting_schema(df).fields] == ["bigint", "string", "timestamp"]
    e = Engine(spark, compat=False)
    e.sql(f"create source files with type=json, path='{tmp_path}/b.json'")
    assert e.sql("select id from files.b where deep.k = 2").count() == 1
    readers.csv_to_parquet(spark, str(tmp_path / "a.csv"), str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 2
    with sqlite3.connect(tmp_path / "s.db") as c:
        c.execute("create table t (a int, b text)")
        c.executemany("insert into t values (?, ?)", [(i, f"w{i}" if i % 3 else None) for i in range(100)])
    lite = readers.sqlite(spark, str(tmp_path / "s.db"), "t", partitions=4)
    assert lite.dtypes == [("a", "bigint"), ("b", "string")] and lite.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, lite.collect())) == [(i, f"w{i}" if i % 3 else None) for i in range(100)]
    assert lite.where("a >= 10 and a < 20 and b is not null").count() == 7 and lite.where("b = 'w7'").first().a == 7
    e.sql(f"create source lite with type=sqlite, table=t, path='{tmp_path}/s.db'")
    assert e.sql("select count(*) as n from t where b = null").first().n == 34
    names = readers.files(spark, str(tmp_path), ".csv") + readers.files(spark, str(tmp_path), ".json")
    parts = [readers.files(spark, str(tmp_path), "", p, 3) for p in range(3)]
    assert sum(map(len, parts)) == len(readers.files(spark, str(tmp_path))) and len(names) == 2
    assert [d.count() for d in readers.pages(spark, names)] == [2, 2]
    with pytest.raises(ValueError, match="no source"):
        readers.open_source(spark, {"type": "nothing"})


def spec(name, selector):
    return TableSpec.from_dict({"tableName": name, "primaryKey": "id", "selector": selector, "attributes": [{"fieldName": "id", "sourceName": "/data/id"}, {"fieldName": "n", "type": "Integer", "sourceName": "/data/n"}, {"fieldName": "at", "type": "DateTime", "sourceName": "/data/at"}]})


def test_ingest_routes_and_is_idempotent(spark, tmp_path):
    store = TableStore(spark, str(tmp_path / "store"))
    store.create(spec("small", 'type = "small"'))
    store.create(spec("large", 'type = "large"'))
    box = tmp_path / "box"
    box.mkdir()
    lines = [json.dumps({"type": t, "data": {"id": i, "n": n, "at": "2024-01-01T00:00:00Z"}}) for t, i, n in (("small", "a", 1), ("large", "b", 2), ("small", "a", 5), ("other", "c", 3))]
    (box / "1.json").write_text("\n".join([*lines, "no json", '{"type": "small", "data": {"id": null}}']))
    schema = "type string, data struct<id:string,n:bigint,at:string>"
    job = ingest.Ingest(store)

    def run(checkpoint):
        stream = ingest.decode_json(ingest.file_stream(spark, str(box), "", "text"), schema)
        job.start(stream, str(tmp_path / checkpoint)).awaitTermination()

    run("c1")
    want = [("a", 5)]
    assert [(r.id, r.n) for r in store.read("small").collect()] == want and [(r.id, r.n) for r in store.read("large").collect()] == [("b", 2)]
    assert job.metrics.errors == 1 and job.metrics.records == 6
    run("c2")  # the same records once more
    assert [(r.id, r.n) for r in store.read("small").collect()] == want
    (box / "2.json").write_text(json.dumps({"type": "small", "data": {"id": "z", "n": 9, "at": None}}))
    run("c2")
    assert store.read("small").count() == 2


def test_windows_on_a_stream_match_the_table(spark, tmp_path, smallest):
    src = tmp_path / "events"
    df = spark.read.parquet(f"{smallest}/events.parquet").selectExpr("event_id", "cast(ts as timestamp) ts", "event_type", "value")
    ingest.publish(df, str(src), "parquet", 3)
    aggregates = {"n": "count(1)", "total": "sum(cast(value as decimal(18,4)))"}
    batch = ingest.windowed(df, "ts", "1 hour", ["event_type"], aggregates)
    stream = ingest.file_stream(spark, str(src), df.schema, "parquet")
    query = ingest.continuous_view(ingest.windowed(stream, "ts", "1 hour", ["event_type"], aggregates), str(tmp_path / "view"), str(tmp_path / "c"), "complete")
    query.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "view"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, batch.collect()))
    assert ingest.first_of_key(df.union(df), ["event_id"], "ts").count() == df.count()


def test_continuous_view_of_a_statement(spark, tmp_path, smallest):
    df = spark.read.parquet(f"{smallest}/events.parquet").selectExpr("event_id", "event_type", "value")
    ingest.publish(df, str(tmp_path / "in"), "parquet")
    e = Engine(spark, TableStore(spark, str(tmp_path / "store")), compat=False)
    e.register("incoming", ingest.file_stream(spark, str(tmp_path / "in"), df.schema, "parquet"))
    e.sql("create continuousview totals as select event_type, count(*) as n from incoming group by event_type with mode=complete")
    e.streams["totals"].awaitTermination()
    assert sorted(map(tuple, e.sql("select event_type, n from totals").collect())) == sorted(map(tuple, df.groupBy("event_type").count().collect()))
    e.sql("create continuousview large as select event_id, value from incoming where value > 100")
    e.streams["large"].awaitTermination()
    assert e.sql("select count(*) as n from large").first().n == df.where("value > 100").count()
