import pytest
from pyspark.sql import functions as F

from tallyforge import store as S
from tallyforge.engine import Engine
from tallyforge.functions.registry import WrongArguments, register_aggregate
from tallyforge.plans import values as V
from tallyforge.types import TableSpec

SPEC = {"tableName": "t", "primaryKey": "id", "attributes": [{"fieldName": "id", "type": "Integer"}, {"fieldName": "word"}, {"fieldName": "owner", "foreignKey": "t.id"}]}


def test_buckets_grow_and_rows_stay(spark, tmp_path, monkeypatch):
    store = S.TableStore(spark, str(tmp_path))
    store.create(TableSpec.from_dict(SPEC))
    assert store.insert("t", spark.range(500).selectExpr("id", "concat('w', id) as word", "cast(null as string) as owner")) == 500
    assert store.spec("t").buckets == 8 and store.spec("t").folder == "data"
    monkeypatch.setattr(S, "BUCKET_BYTES", 100)
    monkeypatch.setattr(S, "MOST_NAMED", 1)  # partitions joined, not named
    assert store.insert("t", spark.range(400, 700).selectExpr("id", "'new' as word", "cast(0 as string) as owner")) == 300
    grown = store.spec("t")
    assert grown.buckets > 8 and grown.folder == f"data-{grown.buckets}" and not (tmp_path / "t" / "data").exists()
    assert S.TableStore(spark, str(tmp_path)).spec("t") == grown
    assert sorted(map(tuple, store.read("t").select("id", "word").collect())) == [(i, f"w{i}" if i < 400 else "new") for i in range(700)]
    assert store.verify("t") == {"rows": 700, "repeated_keys": 0, "misplaced": 0, "orphans of owner": 0}
    assert store.find("t", {"id": 7}).first().word == "w7"
    store.truncate("t")
    assert store.read("t").count() == 0


def test_row_numbers_go_on(spark, tmp_path):
    store = S.TableStore(spark, str(tmp_path))
    store.create(TableSpec.from_dict(SPEC))
    for lo in (0, 50, 20):
        store.insert("t", spark.range(lo, lo + 50).selectExpr("id", "'x' as word"))
    rows = store.read("t", internal=True)
    assert rows.count() == 100 == rows.select(S.ROWNUM).distinct().count()
    low = rows.where("id < 50").agg(F.max(S.ROWNUM)).first()[0]
    assert rows.where("id >= 50").agg(F.min(S.ROWNUM)).first()[0] > low  # updated rows keep theirs


def test_emptied_partitions_go_in_the_same_job(spark, tmp_path, monkeypatch):
    store = S.TableStore(spark, str(tmp_path))
    store.create(TableSpec.from_dict(SPEC))
    store.insert("t", spark.range(40).selectExpr("id", "'x' as word"))
    monkeypatch.setattr(store, "_remove", lambda *parts: None)  # a failure before the clearing away
    assert Engine(spark, store).sql("delete from t where id >= 0") == 40
    assert store.read("t").count() == 0 and store.partitions("t").count() == 0
    store.insert("t", spark.range(3).selectExpr("id", "'y' as word"))
    assert sorted(r.id for r in store.read("t").collect()) == [0, 1, 2]


def test_repair_and_status(spark, tmp_path):
    store = S.TableStore(spark, str(tmp_path))
    store.create(TableSpec.from_dict(SPEC))
    store.insert("t", spark.range(60).selectExpr("id", "concat('w', id) as word"))
    assert store.repair("t") == 0
    # rows of other partitions, and a later copy of a key, written past the store
    raw = store.read("t", internal=True)
    stray = raw.where("id in (3, 4)").withColumn(S.PART, F.lit("00000")).withColumn("word", F.lit("later")).withColumn(S.ROWNUM, F.col(S.ROWNUM) + 10**12)
    stray.write.mode("append").partitionBy(S.PART).parquet(str(tmp_path / "t" / "data"))
    before = store.verify("t")
    assert before["rows"] == 62 and before["repeated_keys"] == 2 and before["misplaced"] >= 1
    assert store.repair("t") >= 2
    after = store.verify("t")
    assert (after["rows"], after["repeated_keys"], after["misplaced"]) == (60, 0, 0)
    assert sorted(map(tuple, store.read("t").select("id", "word").collect())) == [(i, "later" if i in (3, 4) else f"w{i}") for i in range(60)]
    row = store.status().first()
    assert row.table == "t" and row.partitions == 8 and row.bytes > 0 and '"buckets": 8' in row.specification


def test_aggregates_of_ones_own(spark):
    register_aggregate("spread", lambda v: V.number((F.max(v.col) - F.min(v.col)).cast("double")))
    e = Engine(spark, compat=False)
    e.register("t", spark.createDataFrame([("a", 1), ("a", 5), ("b", 2), ("b", None)], "k string, n int"))
    got = e.sql("select k, spread(n) as s from t group by k having spread(n) >= 0 order by k").collect()
    assert [tuple(r) for r in got] == [("a", 4.0), ("b", 0.0)]
    with pytest.raises(WrongArguments):
        register_aggregate("sum", lambda v: v)
