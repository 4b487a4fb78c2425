"""What a task gets doesn't grow with the table: more rows make more files, and joins and statistics sort no whole rows."""

import pytest

from tarnlake.operators import fragtable, rows
from tarnlake.operators import stats as st
from tarnlake.operators.fragtable import FragmentTable
from tarnlake.operators.storage import Store
from tarnlake.plans import catalog, catalog_tables
from tarnlake.plans.expr import call, col, lit
from tarnlake.sources import avro

SF = "/root/testdata/sf0.001"


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_fragments_grow_in_number(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fragtable, "FRAGMENT_ROWS", 10)
    t = FragmentTable.create(spark, str(tmp_path / "f"), spark.range(100).repartition(3), 4)
    assert len(t.manifest.fragments) == 10 and t.count() == 100
    t.append(spark.range(100, 125))
    assert len(t.manifest.fragments) == 13
    t.delete(call("modulo", col("id"), 4).eq(0))
    t.update(col("id").lt(8), {"id": call("add", col("id"), lit(1000))})
    t.compact()
    assert len(t.manifest.fragments) > 9 and ids(t.read()) == [i for i in range(8, 125) if i % 4] + [1000 + i for i in range(8) if i % 4]


def test_large_partitions_are_cut_not_dealt(spark, tmp_path, monkeypatch):
    """Dealing sorts all rows of a task, which grow with the table; cutting them keeps their order and none in memory."""
    monkeypatch.setattr(fragtable, "FRAGMENT_ROWS", 10)
    t = FragmentTable.create(spark, str(tmp_path / "f"), spark.range(200).coalesce(1), 2)
    t.append(spark.range(200, 295).coalesce(1), 19)
    spans = [ids(spark.read.parquet(t.store.uri(f.files[0]))) for f in t.manifest.fragments]
    assert sorted(map(len, spans)) == [5] * 19 + [10] * 20 and all(s == list(range(s[0], s[-1] + 1)) for s in spans)
    t.delete(call("modulo", col("id"), 5).eq(0))
    before = len(t.manifest.fragments)
    n, _ = t.update(col("id").lt(250), {"id": call("add", col("id"), lit(1000))})
    new = t.manifest.fragments[before:]
    assert n == 200 == sum(f.rows for f in new) and max(f.rows for f in new) == 10
    t.compact()
    assert max(f.rows for f in t.manifest.fragments) <= 10
    assert ids(t.read()) == [i for i in range(250, 295) if i % 5] + [1000 + i for i in range(250) if i % 5]


@pytest.mark.parametrize(("most", "join"), [(0, "ShuffledHashJoin"), (1000, "BroadcastHashJoin")])
def test_deleted_rows_join_as_words(spark, tmp_path, monkeypatch, most, join):
    monkeypatch.setattr(rows, "BROADCAST", most)
    t = FragmentTable.create(spark, str(tmp_path / "f"), spark.range(400), 2)
    t.delete(col("id").isin(0, 63, 64, 127, 128, 399))
    t.delete(call("modulo", col("id"), 3).eq(1))
    t.delete(col("id").ge(390))
    k = t.manifest.fragments[0]
    assert t.delete_rows({k.id: list(range(k.rows))}) == k.rows - k.deleted
    left = ids(t.read())
    assert t.count() == len(left) == len(set(left)) and set(left) <= {i for i in range(390) if i % 3 != 1} - {0, 63, 128}
    plan = t.read()._jdf.queryExecution().executedPlan().toString()
    assert join in plan and "__word" in plan and "SortMergeJoin" not in plan


def answers(spark, name):
    """Rows of a query and of its SQL over the smallest tables."""
    import duckdb

    con = duckdb.connect()
    for t in ("customer", "orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    out, df = con.execute(catalog.ORACLE_SQL[name]), catalog.QUERIES[name](spark, SF)
    names = [d[0] for d in out.description]
    return sorted(map(repr, (tuple(r[c] for c in names) for r in df.collect()))), sorted(map(repr, out.fetchall()))


@pytest.fixture
def small_files(monkeypatch):
    monkeypatch.setattr(catalog, "_built", {})
    for module in (catalog, catalog_tables):
        monkeypatch.setattr(module, "FILE_ROWS", 300, raising=False)


@pytest.mark.parametrize("name", ["parquet_footers", "parquet_row_groups", "row_groups_by_bloom"])
def test_row_groups_of_several_files(spark, small_files, name):
    got, want = answers(spark, name)
    assert got == want
    assert len(list(catalog_tables.grouped_orders(spark, SF))) == 5 and catalog_tables.parquet_files(next(iter(catalog._built.values())))


def test_indices_open_ranged_fragments(spark, monkeypatch):
    monkeypatch.setattr(fragtable, "FRAGMENT_ROWS", 400)
    monkeypatch.setattr(catalog, "_built", {})
    t = catalog.indexed_lineitem(spark, SF)
    assert len(t.manifest.fragments) > 12 and len(t.plan(col("l_orderkey").eq(7))) == 1
    names = [n for n in t.store.names(t.manifest.indices["by_order"]["path"]) if n.endswith(".parquet")]
    assert len(names) > 12
    got, want = answers(spark, "index_lookup_btree")
    assert got == want


def test_bitmap_over_many_fragments(spark, monkeypatch):
    monkeypatch.setattr(fragtable, "FRAGMENT_ROWS", 400)
    monkeypatch.setattr(catalog, "_built", {})
    got, want = answers(spark, "index_lookup_bitmap")
    t = catalog.indexed_lineitem(spark, SF)
    assert got == want and len(t.manifest.fragments) > 12
    assert {r[0] for r in t.lookup("by_line", 6).collect()} <= {f.id for f in t.manifest.fragments}


def test_log_table_grows_in_files(spark, small_files):
    got, want = answers(spark, "prune_file_ranges")
    assert got == want and len(catalog.log_lineitem(spark, SF).plan()) > 16


def test_statistics_sort_no_rows(spark):
    df = spark.range(100).selectExpr("id % 5 as k", "cast(id as string) as s", "id as v")
    found = df.groupBy("k").agg(*st.aggregates(df.drop("k").schema))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" in plan and "SortAggregate" not in plan
    assert {(r["rows"], r["s"]["min"] <= r["s"]["max"], r["v"]["max"] - r["v"]["min"]) for r in found.collect()} == {(20, True, 95)}


def test_walk_of_local_files_asks_no_jvm(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/a b")
    for name in ("data/g=1/x.parquet", "data/g=a%3Ab/y ü.parquet", "data/.x.crc", "data/_SUCCESS", "top"):
        p = tmp_path / "a b" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(name)
    for rel in ("", "data", "data/g=1", "top"):
        store.local = False
        want = store.walk(rel)
        store.local = True
        fs, store.fs = store.fs, NoListing(store.fs)
        assert store.walk(rel) == want and want
        store.fs = fs


class NoListing:
    def __init__(self, fs):
        self._fs = fs

    def __getattr__(self, name):
        if name.startswith("list"):
            raise AssertionError(name)
        return getattr(self._fs, name)


def test_avro_files_grow_in_number(spark, small_files, monkeypatch):
    monkeypatch.setattr(catalog_tables, "FILE_ROWS", 1000)
    monkeypatch.setattr(catalog_tables, "RANGES", 7, raising=False)
    got, want = answers(spark, "avro_splits_lz4")
    assert got == want
    found = avro.sized(next(iter(catalog._built.values())))
    assert len(found) > 4
