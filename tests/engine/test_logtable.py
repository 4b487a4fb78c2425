import json
import time

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators.logtable import IDENTITY, LogTable, ProtocolError
from tarnlake.operators.storage import ConflictError
from tarnlake.plans.expr import call, col, lit

SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("region", T.StringType()), T.StructField("v", T.DoubleType())])


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture
def table(spark, tmp_path):
    t = LogTable.create(spark, str(tmp_path / "t"), SCHEMA, ["region"], {"delta.enableChangeDataFeed": "false"})
    data = [(i, r, float(i)) for k, r in enumerate(["us", "eu", None]) for i in range(3 * k, 3 * k + 3)]
    t.write(spark.createDataFrame(data, SCHEMA).coalesce(1))
    t.write(spark.createDataFrame([(100 + i, "a b/c=%", None) for i in range(4)], SCHEMA).coalesce(1))
    return t


def test_read_prune_and_partitions(table):
    assert table.read().count() == 13
    assert [a["partitionValues"] for a in table.plan(col("region").eq("eu"))] == [{"region": "eu"}]
    assert rows(table.read(["id"], col("region").eq("a b/c=%"))) == [(100,), (101,), (102,), (103,)]
    assert rows(table.read(["id"], col("region").is_null())) == [(6,), (7,), (8,)]
    assert len(table.plan(col("id").gt(50))) == 1 and len(table.plan(col("v").is_not_null())) == 3
    kinds = {r["decision"] for r in table.decisions(col("id").ge(100)).collect()}
    assert kinds == {"always false", "always true"}


def test_delete_update_compact_checkpoint(spark, table, tmp_path):
    assert table.delete(col("id").isin(1, 101)) == (2, 3)
    assert table.delete(col("v").gt(1e9)) == (0, 3)
    assert table.delete(col("id").eq(2)) == (1, 4)  # the same file again
    assert table.update(col("id").eq(0), {"v": call("add", col("v"), lit(0.5)), "region": lit("eu")}) == (1, 5)
    want = [(0, "eu", 0.5), *((i, "eu", float(i)) for i in (3, 4, 5)), *((i, None, float(i)) for i in (6, 7, 8)), *((i, "a b/c=%", None) for i in (100, 102, 103))]
    assert rows(table.read()) == sorted(want, key=repr)
    assert table.read(version=2).count() == 13 and table.read(version=3).count() == 11
    assert table.compact() == 6
    assert rows(table.read()) == sorted(want, key=repr)
    assert not any(a.get("deletionVector") for a in table.current.files.values() if a["partitionValues"]["region"] == "eu")
    for _ in range(2):
        table.checkpoint(v2=True)
        assert rows(LogTable.open(spark, str(tmp_path / "t")).read()) == sorted(want, key=repr)
        table.delete(col("id").eq(999))
    table.compact_log(0, 4)
    table.store.delete("_delta_log/_last_checkpoint")
    again = LogTable.open(spark, str(tmp_path / "t"))
    assert rows(again.read()) == sorted(want, key=repr) and again.current.schema == SCHEMA
    stale = again.vacuum(0, dry_run=True)
    time.sleep(0.01)
    assert stale and again.vacuum(-1000) and rows(again.read()) == sorted(want, key=repr)


def test_time_travel_by_time_and_conflicts(spark, table, tmp_path):
    other = LogTable.open(spark, str(tmp_path / "t"))
    stamp = table.current.timestamp
    time.sleep(0.005)
    table.write(spark.createDataFrame([(1, "x", 1.0)], SCHEMA), "overwrite")
    assert table.read(timestamp=stamp).count() == 13 and table.read().count() == 1
    with pytest.raises(ConflictError):
        other.delete(col("id").ge(0))
    other = LogTable.open(spark, str(tmp_path / "t"))
    table.write(spark.createDataFrame([(2, "x", 1.0)], SCHEMA))
    other.write(spark.createDataFrame([(3, "x", 1.0)], SCHEMA))  # blind appends go in
    assert rows(table.__class__.open(spark, str(tmp_path / "t")).read(["id"])) == [(1,), (2,), (3,)]
    v = other.write(spark.createDataFrame([(4, "x", 1.0)], SCHEMA), txn=("app", 7))
    assert other.write(spark.createDataFrame([(4, "x", 1.0)], SCHEMA), txn=("app", 7)) == v


@pytest.mark.parametrize("cdc", ["true", "false"])
def test_change_feed(spark, tmp_path, cdc):
    t = LogTable.create(spark, str(tmp_path / "c"), SCHEMA, [], {"delta.enableChangeDataFeed": cdc})
    t.write(spark.createDataFrame([(i, "x", 0.0) for i in range(4)], SCHEMA).coalesce(1))
    t.delete(col("id").eq(1))
    t.update(col("id").eq(2), {"v": lit(9.0)})
    got = [(r["_commit_version"], r["_change_type"], r["id"], r["v"]) for r in t.changes(1, 3).collect()]
    assert sorted(g for g in got if g[0] == 1) == [(1, "insert", i, 0.0) for i in range(4)]
    assert [g for g in got if g[0] == 2] == [(2, "delete", 1, 0.0)]
    third = sorted(g for g in got if g[0] == 3)
    if cdc == "true":
        assert third == [(3, "update_postimage", 2, 9.0), (3, "update_preimage", 2, 0.0)]
    else:  # inferred from whole files, without the row deleted earlier
        assert third == [(3, "delete", i, 0.0) for i in (0, 2, 3)] + [(3, "insert", 0, 0.0), (3, "insert", 2, 9.0), (3, "insert", 3, 0.0)]


def test_schema_features(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("f", T.FloatType())])
    t = LogTable.create(spark, str(tmp_path / "m"), schema, ["id"], mapping="name")
    t.write(spark.createDataFrame([(1, 1.5)], schema))
    t.rename("f", "g")
    t.widen("g", T.DoubleType())
    t.add_column("n", T.StringType())
    t.write(spark.createDataFrame([(2, 2.25, "x")], "id int, g double, n string"))
    assert rows(t.read()) == [(1, 1.5, None), (2, 2.25, "x")]
    assert rows(t.read(["g"], col("g").lt(2.0))) == [(1.5,)]
    with pytest.raises(ValueError):
        t.widen("g", T.FloatType())
    ids = {f.name: f.metadata["delta.columnMapping.id"] for f in t.current.schema.fields}
    assert ids == {"id": 1, "g": 2, "n": 3}
    assert rows(LogTable.open(spark, str(tmp_path / "m")).read(["id"])) == [(1,), (2,)]


def test_identity_row_ids_domains_gates(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType(), True, {IDENTITY + "start": 10, IDENTITY + "step": 5, IDENTITY + "allowExplicitInsert": False}), T.StructField("s", T.StringType())])
    t = LogTable.create(spark, str(tmp_path / "i"), schema)
    for n in (7, 5):
        t.write(spark.range(n).select(F.col("id").cast("string").alias("s")).repartition(3))
    assert sorted(r["k"] for r in t.read(["k"]).collect()) == [10 + 5 * i for i in range(12)]
    with pytest.raises(ValueError):
        t.write(spark.createDataFrame([(1, "x")], "k long, s string"))
    assert sorted(r["_row_id"] for r in t.read_with_row_ids().collect()) == list(range(12))
    t.set_domain("app", "{}")
    assert LogTable.open(spark, str(tmp_path / "i")).domains()["app"] == "{}"
    t.remove_domain("app")
    with pytest.raises(ValueError):
        t.set_domain("delta.x", "")
    v = t.latest_version() + 1
    t.store.create(f"_delta_log/{v:020d}.json", json.dumps({"protocol": {"minReaderVersion": 9}}))
    with pytest.raises(ProtocolError):
        LogTable.open(spark, str(tmp_path / "i"))
    with pytest.raises(ProtocolError):
        LogTable.create(spark, str(tmp_path / "j"), schema, config={"delta.enableIcebergCompatV1": "true"})
