import pytest

from tarnlake.operators.fragtable import FragmentTable
from tarnlake.operators.zones import ZonedDataset
from tarnlake.plans.expr import call, col, lit


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_versions_and_mutation(spark, tmp_path):
    p = str(tmp_path / "f")
    df = spark.range(100).selectExpr("cast(id as int) id", "concat('item-', id) name")
    t = FragmentTable.create(spark, p, df, fragments=3)
    assert t.count() == 100 and t.delete(col("id").isin(5, 17, 42)) == 3 and t.delete(col("id").eq(5)) == 0
    assert t.manifest.version == 2 and t.count() == 97
    assert t.update(col("id").lt(3), {"id": call("add", col("id"), lit(1000)), "name": call("upper", col("name"))}) == (3, 3)
    assert ids(t.read(["id"], col("id").ge(1000))) == [1000, 1001, 1002] and t.count() == 97
    assert t.read(["name"], col("id").eq(1001)).first()[0] == "ITEM-1"
    k = max(t.manifest.fragments, key=lambda f: f.id)
    assert t.delete_rows({k.id: [0, 0]}) == 1 and t.delete_rows({k.id: [0]}) == 0 and t.count() == 96
    with pytest.raises(IndexError):
        t.delete_rows({k.id: [99]})
    with pytest.raises(ValueError):
        t.append(spark.range(3))
    before = ids(t.read(["id"]))
    t.compact()
    assert ids(t.read(["id"])) == before and not any(f.deleted for f in t.manifest.fragments) and t.compact() is None
    v = t.overwrite(spark.range(2).selectExpr("id x"))
    assert ids(t.read()) == [0, 1]
    old = FragmentTable.open(spark, p, version=1)
    assert ids(old.read(["id"])) == list(range(100)) and old.versions() == list(range(1, v + 1))
    assert ids(FragmentTable.open(spark, p, as_of=old._load(2).timestamp).read(["id"])) == sorted(set(range(100)) - {5, 17, 42})
    assert t.vacuum(dry_run=True) and t.vacuum(1) and t.versions() == [v] and ids(FragmentTable.open(spark, p).read()) == [0, 1]


def test_indices(spark, tmp_path):
    t = FragmentTable.create(spark, str(tmp_path / "i"), spark.createDataFrame([(i,) for i in (1, 2, 3)], "x int"))
    t.append(spark.createDataFrame([(i,) for i in (1, 2, 1)], "x int"))
    t.append(spark.createDataFrame([(i,) for i in (3, 100, None)], "x int"))
    t.create_index("b", "x")
    assert sorted(map(tuple, t.lookup("b", 3, None).collect())) == [(0, 2), (2, 0), (2, 1)]
    plan = lambda e: [f.id for f in t.plan(e)]
    assert plan(col("x").eq(100)) == [2] and plan(col("x").lt(2)) == [0, 1] and plan(col("x").isin(2, 100)) == [0, 1, 2]
    assert plan(col("x").eq(3) & col("x").is_null()) == [0, 2] and plan(~col("x").eq(3)) == [0, 1, 2] and plan(col("x").eq("a")) == []
    t.append(spark.createDataFrame([(7,)], "x int"))
    assert plan(col("x").eq(100)) == [2, 3] and ids(t.read(None, col("x").ge(7))) == [7, 100]
    t.create_index("m", "x", "bitmap")
    assert sorted(r[0] for r in t.lookup("m", 3).collect()) == [0, 2] and set(t.indices()) == {"b", "m"}


def test_zones(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "if(id % 10 = 0, null, cast(id as double)) v", "concat('k', id div 100) s")
    z = ZonedDataset.write(df.repartition(7), str(tmp_path / "z"), "id", zone_rows=100)
    assert z.zones(col("id").ge(250) & col("id").lt(310)) == [2, 3] and z.zones(col("s").eq("k7")) == [7]
    assert ids(z.read(["id"], col("id").ge(250) & col("id").lt(310))) == list(range(250, 310))
    assert ids(z.read([0], offset=995, count=50)) == list(range(995, 1000))
    assert ids(z.read(["id"], col("v").is_null(), offset=95, count=20)) == [100, 110]
    assert ids(z.read(["id"], zones=[0, 9])) == [*range(100), *range(900, 1000)]
    r = {x["_zone"]: x for x in z.column_stats("v").collect()}[3]
    assert (r["rows"], r["min"], r["max"], r["nulls"], r["sum"], r["sorted"]) == (100, 301.0, 399.0, 10, sum(i for i in range(300, 400) if i % 10), None)
    assert {(x["constant"], x["sorted"], x["strict"]) for x in z.column_stats("s").collect()} == {(True, True, False)}
