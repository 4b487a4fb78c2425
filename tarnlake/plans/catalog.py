"""The registered queries of the engine itself, with the SQL that checks them.

Queries that need a table of some kind build it from the whole input table first, in the shared scratch folder, and keep
it for the session, so that a second query over the same input finds it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.operators import snaptable as sn
from tarnlake.operators import transforms as tr
from tarnlake.operators.fragtable import FragmentTable
from tarnlake.operators.logtable import IDENTITY, LogTable
from tarnlake.operators.storage import pieces, scratch
from tarnlake.operators.zones import ZonedDataset
from tarnlake.plans import compile as comp
from tarnlake.plans.expr import Expr, all_of, any_of, call, col, lit
from tarnlake.sources import avro, files
from tarnlake.streaming.sink import write_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
_built: dict[tuple, str] = {}
#: Rows to a file of the tables that queries build: larger inputs make more files, not larger ones.
FILE_ROWS = 1_000_000


def query(sql: str | None = None):
    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def built(spark: SparkSession, sf_dir: str, name: str, build: Callable[[str], object]) -> str:
    """Path of a derived table, built once per session and input."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _built:
        path = scratch(spark, name)
        build(path)
        _built[key] = path
    return _built[key]


def tested(df: DataFrame, **predicates: Expr) -> list:
    return [comp.predicate(p, df.schema).alias(name) for name, p in predicates.items()]


# -- scans and predicates ----------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def scan_projection_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_parquet(spark, f"{sf_dir}/orders.parquet", columns=["o_orderkey", "o_orderstatus"])


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag FROM lineitem WHERE l_quantity >= 10 AND l_quantity < 20 AND NOT l_returnflag = 'R' OR l_quantity > 49 AND l_discount <> 0.05")
def pred_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = all_of(col("l_quantity").ge(10), col("l_quantity").lt(20), ~col("l_returnflag").eq("R")) | (col("l_quantity").gt(49) & col("l_discount").ne(0.05))
    return files.scan_parquet(spark, f"{sf_dir}/lineitem.parquet", columns=["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag"], filter_=p)


@query("SELECT o_orderkey, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL AS is_null, nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM 'O' AS is_o FROM orders")
def pred_null_safe_equal(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("F")))
    return df.select("o_orderkey", *tested(df, is_null=col("s").eq_null_safe(None), is_o=col("s").eq_null_safe("O")))


@query("SELECT o_orderkey, s IN ('O', 'X') AS a, s IN ('O', NULL) AS b, s NOT IN ('O', 'X') AS c, s NOT IN ('O', NULL) AS d FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders)")
def pred_in_notin_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("F")))
    s = col("s")
    return df.select("o_orderkey", *tested(df, a=s.isin("O", "X"), b=s.isin("O", None), c=s.not_in("O", "X"), d=s.not_in("O", None)))


@query("SELECT p_partkey, starts_with(p_type, 'PROMO') AS promo, NOT starts_with(nullif(p_brand, 'Brand#1'), 'Brand#2') AS other FROM part")
def pred_starts_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").withColumn("b", F.nullif("p_brand", F.lit("Brand#1")))
    return df.select("p_partkey", *tested(df, promo=col("p_type").starts_with("PROMO"), other=col("b").not_starts_with("Brand#2")))


@query("SELECT l_orderkey, l_linenumber, v IS NOT NULL AND isnan(v) AS nan, CASE WHEN v IS NOT NULL THEN NOT isnan(v) END AS not_nan FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity < 10 THEN 'nan'::DOUBLE WHEN l_quantity < 20 THEN NULL ELSE l_quantity END AS v FROM lineitem)")
def pred_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_quantity") < 10, F.lit(float("nan"))).when(F.col("l_quantity") >= 20, F.col("l_quantity").cast("double"))
    df = table(spark, sf_dir, "lineitem").withColumn("v", v)
    return df.select("l_orderkey", "l_linenumber", *tested(df, nan=col("v").is_nan(), not_nan=col("v").is_not_nan()))


@query("SELECT o_orderkey, a AND b AS a_and_b, a OR b AS a_or_b, NOT a AS not_a, NOT (a AND NOT b) AS mixed FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS a, CASE (o_orderkey // 3) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS b FROM orders)")
def pred_3vl_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    def three(c):
        return F.when(c == 0, True).when(c == 1, False)

    df = table(spark, sf_dir, "orders").withColumns({"a": three(F.col("o_orderkey") % 3), "b": three(F.floor(F.col("o_orderkey") / 3) % 3)})
    a, b = col("a"), col("b")
    return df.select("o_orderkey", *tested(df, a_and_b=a & b, a_or_b=a | b, not_a=~a, mixed=~(a & ~b)))


@query("SELECT c_custkey, NULL::BOOLEAN AS mismatch, false AS same FROM customer")
def pred_type_mismatch_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return df.select("c_custkey", *tested(df, mismatch=col("c_name").gt(5), same=col("c_name").eq_null_safe(5)))


@query("SELECT c.c_custkey, upper(c_mktsegment) AS seg, CASE WHEN c_acctbal < 0 THEN 'debt' ELSE 'fine' END AS state, substring(c_name, 1, 4) AS head, length(c_name)::INTEGER AS n FROM customer c WHERE lower(c_mktsegment) LIKE 'b%' OR c_acctbal + 1 > 5000")
def function_call_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    rows = comp.apply(df, call("like", call("lower", col("c_mktsegment")), "b%") | call("add", col("c_acctbal"), 1).gt(5000))
    shown = {"seg": call("upper", col("c_mktsegment")), "state": call("if", col("c_acctbal").lt(0), "debt", "fine"), "head": call("substring", col("c_name"), 1, 4), "n": call("length", col("c_name"))}
    return rows.select("c_custkey", *[comp.expression(e, df.schema).alias(k) for k, e in shown.items()])


@query("SELECT o_orderkey, year(o_orderdate)::INTEGER AS y, month(o_orderdate)::INTEGER AS m, day(o_orderdate)::INTEGER AS d FROM orders WHERE year(o_orderdate) >= 1995")
def function_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    when = col("o_orderdate")
    rows = comp.apply(df, call("year", when).ge(1995))
    return rows.select("o_orderkey", *[comp.expression(call(f, when), df.schema).alias(k) for k, f in (("y", "year"), ("m", "month"), ("d", "day"))])


# -- data skipping -----------------------------------------------------------------------------------------------


def log_lineitem(spark: SparkSession, sf_dir: str) -> LogTable:
    """lineitem as a log table of sixteen files, or more, by ranges of l_orderkey."""

    def build(path: str) -> None:
        df = table(spark, sf_dir, "lineitem")
        LogTable.create(spark, path, df.schema).write(df.repartitionByRange(pieces(df, 16, FILE_ROWS), "l_orderkey"))

    return LogTable.open(spark, built(spark, sf_dir, "log-lineitem", build))


RANGE = all_of(col("l_orderkey").ge(1000), col("l_orderkey").lt(2000), col("l_quantity").gt(25))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey >= 1000 AND l_orderkey < 2000 AND l_quantity > 25")
def prune_file_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_lineitem(spark, sf_dir).read(["l_orderkey", "l_linenumber", "l_quantity"], RANGE)


@query("SELECT count(*) FILTER (l_orderkey < 1000) AS matching, count(*) FILTER (l_orderkey < 1000) AS in_files_kept, max(l_orderkey) > 1100 AS skips FROM lineitem")
def prune_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching rows in all, and in the files that aren't skipped; whether files are."""
    t = log_lineitem(spark, sf_dir)
    said = {r["path"]: r["decision"] for r in t.decisions(col("l_orderkey").lt(1000) & col("l_quantity").ge(1)).collect()}
    kept = [a for a in t.current.files.values() if said[a["path"]] != "always false"]
    counts = t._live(t.current, kept).filter("l_orderkey < 1000").agg(F.count("*").alias("in_files_kept"))
    return table(spark, sf_dir, "lineitem").filter("l_orderkey < 1000").agg(F.count("*").alias("matching")).crossJoin(counts).withColumn("skips", F.lit(len(kept) < len(said)))


@query("SELECT o_orderkey, o_orderpriority FROM orders WHERE o_orderpriority IN ('1-URGENT', '5-LOW')")
def prune_partition_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(path: str) -> None:
        df = table(spark, sf_dir, "orders")
        LogTable.create(spark, path, df.schema, ["o_orderpriority"]).write(df.repartition("o_orderpriority"))

    t = LogTable.open(spark, built(spark, sf_dir, "log-orders", build))
    return t.read(["o_orderkey", "o_orderpriority"], col("o_orderpriority").isin("1-URGENT", "5-LOW"))


def zoned_events(spark: SparkSession, sf_dir: str) -> ZonedDataset:
    return ZonedDataset(spark, built(spark, sf_dir, "zones-events", lambda path: ZonedDataset.write(table(spark, sf_dir, "events"), path, "event_id", 1000)))


@query("SELECT z AS zone, count(*) AS n, min(user_id) AS low, max(user_id) AS high, count(*) - count(user_id) AS nulls FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS z FROM events) GROUP BY z")
def zone_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = zoned_events(spark, sf_dir).column_stats("user_id")
    return s.select(F.col("_zone").alias("zone"), F.col("rows").alias("n"), F.col("min").alias("low"), F.col("max").alias("high"), "nulls")


@query("SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) WHERE rn >= 150 AND rn < 3150 AND event_type <> 'view'")
def row_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zoned_events(spark, sf_dir).read(["event_id", "event_type"], col("event_type").ne("view"), offset=150, count=3000)


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS rn FROM events) WHERE event_id BETWEEN 500 AND 4200 AND user_id < 300 AND rn // 1000 IN (0, 2, 3)")
def zone_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zoned_events(spark, sf_dir).read(["event_id", "user_id"], col("event_id").ge(500) & col("event_id").le(4200) & col("user_id").lt(300), zones=[0, 2, 3])


# -- mutation ----------------------------------------------------------------------------------------------------


def fresh_log(spark: SparkSession, df: DataFrame, files_: int = 4, key: str | None = None, **options) -> LogTable:
    t, files_ = LogTable.create(spark, scratch(spark, "log"), df.schema, **options), pieces(df, files_, FILE_ROWS)
    t.write(df.repartitionByRange(files_, key) if key else df.repartition(files_))
    return t


ORDERS = ["o_orderkey", "o_orderstatus", "o_totalprice"]


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE NOT coalesce(o_totalprice > 200000 AND o_orderstatus = 'F', false) AND o_orderkey % 10 <> 3")
def delete_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fresh_log(spark, table(spark, sf_dir, "orders").select(*ORDERS), key="o_orderkey")
    t.delete(col("o_totalprice").gt(200000) & col("o_orderstatus").eq("F"))
    t.delete(call("modulo", col("o_orderkey"), 10).eq(3))
    return t.read()


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'O' THEN o_totalprice * 2 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 7 <> 0")
def update_then_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fresh_log(spark, table(spark, sf_dir, "orders").select(*ORDERS), key="o_orderkey")
    t.delete(call("modulo", col("o_orderkey"), 7).eq(0))
    t.update(col("o_orderstatus").eq("O"), {"o_orderstatus": lit("X"), "o_totalprice": call("multiply", col("o_totalprice"), 2)})
    return t.read()


@query("SELECT o_orderkey, CASE WHEN o_orderkey < 1000 THEN 'L' ELSE o_orderstatus END AS o_orderstatus, o_totalprice FROM orders WHERE o_totalprice >= 50000")
def fragment_delete_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = FragmentTable.create(spark, scratch(spark, "fragments"), table(spark, sf_dir, "orders").select(*ORDERS), 4)
    t.delete(col("o_totalprice").lt(50000))
    t.update(col("o_orderkey").lt(1000), {"o_orderstatus": lit("L")})
    t.compact()
    return t.read()


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, 'log' AS kind FROM orders UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice, 'fragments' FROM orders")
def overwrite_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").select(*ORDERS)
    t = fresh_log(spark, df)
    t.write(df.filter("o_orderkey < 100"), "overwrite")
    f = FragmentTable.create(spark, scratch(spark, "fragments"), df, 2)
    f.overwrite(df.filter("o_orderkey < 100"))
    old = FragmentTable.open(spark, f.store.root, version=1)
    return t.read(version=1).withColumn("kind", F.lit("log")).union(old.read().withColumn("kind", F.lit("fragments")))


@query("""SELECT c_custkey, c_acctbal, 'insert' AS _change_type, 1::BIGINT AS _commit_version FROM customer UNION ALL SELECT c_custkey, c_acctbal, 'delete', 2 FROM customer WHERE c_acctbal < 0
UNION ALL SELECT c_custkey, c_acctbal, 'update_preimage', 3 FROM customer WHERE c_acctbal >= 5000 UNION ALL SELECT c_custkey, c_acctbal + 1, 'update_postimage', 3 FROM customer WHERE c_acctbal >= 5000""")
def change_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fresh_log(spark, table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal"), config={"delta.enableChangeDataFeed": "true"})
    t.delete(col("c_acctbal").lt(0))
    t.update(col("c_acctbal").ge(5000), {"c_acctbal": call("add", col("c_acctbal"), 1)})
    return t.changes(1, 3).drop("_commit_timestamp")


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey % 5 <> 2")
def compact_preserves_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fresh_log(spark, table(spark, sf_dir, "orders").select(*ORDERS), 8, partition_by=["o_orderstatus"])
    t.delete(call("modulo", col("o_orderkey"), 5).eq(2))
    t.compact()
    t.checkpoint(v2=True)
    return LogTable.open(spark, t.store.root).read()


@query("SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_acctbal < 9000")
def log_compaction_and_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fresh_log(spark, table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal"))
    t.delete(col("c_acctbal").ge(9500))
    t.update(col("c_acctbal").ge(9000), {"c_acctbal": lit(1e6)})
    t.delete(col("c_acctbal").eq(1e6))
    t.compact_log(0, t.latest_version() - 1)
    t.vacuum(-1000)
    return LogTable.open(spark, t.store.root).read()


@query("SELECT 100 + 3 * (row_number() OVER (ORDER BY s_suppkey) - 1) AS k, count(*) OVER () AS n FROM supplier")
def identity_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select("s_suppkey")
    meta = {IDENTITY + "start": 100, IDENTITY + "step": 3, IDENTITY + "allowExplicitInsert": False}
    t = LogTable.create(spark, scratch(spark, "log"), T.StructType([T.StructField("k", T.LongType(), True, meta), *df.schema.fields]))
    t.write(df.filter("s_suppkey % 2 = 0").repartition(3))
    t.write(df.filter("s_suppkey % 2 = 1").repartition(3))
    return t.read(["k"]).crossJoin(t.read().agg(F.count("*").alias("n")))


@query("SELECT p_partkey::BIGINT AS p_partkey, p_size::BIGINT AS p_size FROM part UNION ALL SELECT p_partkey, p_size::BIGINT + 5000000000 FROM part")
def type_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    t = fresh_log(spark, df)
    t.widen("p_size", T.LongType())
    t.write(df.withColumn("p_size", F.col("p_size").cast("long") + 5_000_000_000))
    return t.read()


@query("SELECT n_nationkey, n_name AS label FROM nation WHERE n_regionkey = 2")
def column_mapping_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = fresh_log(spark, table(spark, sf_dir, "nation"), mapping="name", partition_by=["n_regionkey"])
    t.rename("n_name", "label")
    return t.read(["n_nationkey", "label"], col("n_regionkey").eq(2))


@query("SELECT row_number() OVER (ORDER BY r_regionkey) - 1 AS _row_id, 1::BIGINT AS _row_commit_version, true AS kept FROM region UNION ALL SELECT 5 + row_number() OVER (ORDER BY n_nationkey) - 1, 2, true FROM nation")
def row_tracking(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = LogTable.create(spark, scratch(spark, "log"), T.StructType([T.StructField("k", T.IntegerType())]))
    t.write(table(spark, sf_dir, "region").selectExpr("r_regionkey + 100 as k").repartition(2))
    before = {r["k"]: r["_row_id"] for r in t.read_with_row_ids().collect()}  # five rows
    t.write(table(spark, sf_dir, "nation").selectExpr("n_nationkey as k").repartition(2))
    old = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    return t.read_with_row_ids().select("_row_id", "_row_commit_version", F.coalesce(F.try_element_at(old, F.col("k")) == F.col("_row_id"), F.lit(True)).alias("kept"))


@query("SELECT event_id, user_id FROM events")
def stream_exactly_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    t = LogTable.create(spark, scratch(spark, "log"), df.select("event_id", "user_id").schema)
    for checkpoint in ("one", "two"):  # the second run replays what the first has committed
        stream = spark.readStream.schema(df.schema).option("pathGlobFilter", "events.parquet*").option("recursiveFileLookup", "true").parquet(sf_dir).select("event_id", "user_id")
        write_stream(stream, t, "copy", scratch(spark, checkpoint)).awaitTermination()
    return t.read()


# -- snapshot tables ---------------------------------------------------------------------------------------------


def fresh_snapshots(spark: SparkSession, schema: T.StructType, **options) -> sn.SnapshotTable:
    catalog = sn.Catalog(spark, scratch(spark, "warehouse"))
    catalog.create_namespace("db")
    return catalog.create_table("db.t", schema, **options)


@query("SELECT c_custkey AS k, c_name AS label, c_nationkey::BIGINT AS c_nationkey, NULL::DOUBLE AS score FROM customer UNION ALL SELECT c_custkey + 1000000, c_name, c_nationkey::BIGINT, c_acctbal FROM customer")
def schema_evolution_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    t = fresh_snapshots(spark, df.schema)
    t.append(df)
    t.commit(sn.SchemaUpdate(t.metadata).rename_column("c_name", "label").rename_column("c_custkey", "k").update_type("c_nationkey", T.LongType()).drop_column("c_mktsegment").add_column("score", T.DoubleType()).apply())
    t.append(table(spark, sf_dir, "customer").selectExpr("c_custkey + 1000000 as k", "c_name as label", "cast(c_nationkey as long) as c_nationkey", "c_acctbal as score"))
    return t.read()


@query("SELECT o_orderkey, (year(o_orderdate) - 1970)::INTEGER AS y, ((year(o_orderdate) - 1970) * 12 + month(o_orderdate) - 1)::INTEGER AS m, date_diff('day', DATE '1970-01-01', o_orderdate::DATE)::INTEGER AS d, o_orderkey - o_orderkey % 100 AS t, substring(o_orderpriority, 1, 3) AS p FROM orders")
def partition_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    shown = {"y": ("o_orderdate", "year"), "m": ("o_orderdate", "month"), "d": ("o_orderdate", "day"), "t": ("o_orderkey", "truncate[100]"), "p": ("o_orderpriority", "truncate[3]")}
    return df.select("o_orderkey", *[tr.apply(x, F.col(c), kinds[c]).alias(k) for k, (c, x) in shown.items()])


@query("SELECT count(*) AS n, count(DISTINCT o_orderkey) AS keys FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'")
def partitioned_snapshot_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    def build(path: str) -> None:
        catalog = sn.Catalog(spark, path)
        catalog.create_namespace("db")
        catalog.create_table("db.t", table(spark, sf_dir, "orders").schema, [("o_orderdate", "year"), ("o_orderkey", "bucket[4]")], [("o_orderkey", "asc")]).append(table(spark, sf_dir, "orders"))

    t = sn.Catalog(spark, built(spark, sf_dir, "snapshots-orders", build)).load_table("db.t")
    since = comp.dt.datetime(1995, 1, 1)
    return t.read(["o_orderkey"], col("o_orderdate").ge(since)).agg(F.count("*").alias("n"), F.count_distinct("o_orderkey").alias("keys"))


@query("SELECT p_partkey, p_brand, p_size FROM part WHERE NOT (p_size = 10 AND p_brand = (SELECT min(p_brand) FROM part)) AND p_partkey % 50 <> 7 UNION ALL SELECT p_partkey, p_brand, p_size FROM part WHERE p_size = 10")
def position_and_equality_deletes(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    t = fresh_snapshots(spark, df.schema)
    t.append(df.repartition(3))
    t.delete_where(call("modulo", col("p_partkey"), 50).eq(7))
    t.append_equality_deletes(df.agg(F.min("p_brand").alias("p_brand")).withColumn("p_size", F.lit(10)))
    t.append(df.filter("p_size = 10"))  # younger than the deletes
    return t.read()


@query("SELECT s_suppkey, 'main' AS ref FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'audit' FROM supplier WHERE s_suppkey % 3 <> 2 UNION ALL SELECT s_suppkey, 'picked' FROM supplier WHERE s_suppkey % 3 <> 1")
def branches_and_cherry_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select("s_suppkey")
    t = fresh_snapshots(spark, df.schema)
    t.append(df.filter("s_suppkey % 3 = 0"))
    one = t.metadata.current
    t.commit(sn.set_ref(t.metadata, "audit", one))
    t.append(df.filter("s_suppkey % 3 = 1"), branch="audit")
    main = t.read(["s_suppkey"]).withColumn("ref", F.lit("main"))
    audit = t.read(["s_suppkey"], snapshot=sn.resolve_ref(t.metadata, "audit")).withColumn("ref", F.lit("audit"))
    t.append(df.filter("s_suppkey % 3 = 2"))
    two = t.metadata.current
    t.commit(sn.rollback(t.metadata, one))
    t.cherry_pick(two)
    return main.union(audit).union(t.read(["s_suppkey"]).withColumn("ref", F.lit("picked")))


# -- indices, Avro, ORC, nested ----------------------------------------------------------------------------------


def indexed_lineitem(spark: SparkSession, sf_dir: str) -> FragmentTable:
    def build(path: str) -> None:
        df = table(spark, sf_dir, "lineitem")
        t = FragmentTable.create(spark, path, df, 8, "l_orderkey")
        t.create_index("by_order", "l_orderkey")
        t.create_index("by_line", "l_linenumber", "bitmap")

    return FragmentTable.open(spark, built(spark, sf_dir, "fragments-lineitem", build))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_orderkey = 7 OR l_orderkey > 100 AND l_orderkey <= 120")
def index_lookup_btree(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("l_orderkey")
    return indexed_lineitem(spark, sf_dir).read(["l_orderkey", "l_linenumber", "l_partkey"], any_of(k.eq(7), k.gt(100) & k.le(120)))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE l_linenumber IN (6, 7) AND l_quantity < 5")
def index_lookup_bitmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indexed_lineitem(spark, sf_dir).read(["l_orderkey", "l_linenumber", "l_partkey"], col("l_linenumber").isin(6, 7) & col("l_quantity").lt(5))


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders")
def avro_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = built(spark, sf_dir, "avro-orders", lambda p: avro.write(table(spark, sf_dir, "orders"), p, "zstandard"))
    return avro.read(spark, path)


@query("SELECT s_suppkey::DOUBLE AS key, s_name, 'none' AS note FROM supplier")
def avro_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = built(spark, sf_dir, "avro-supplier", lambda p: avro.write(table(spark, sf_dir, "supplier"), p, "snappy"))
    reader = {"type": "record", "name": "s", "fields": [{"name": "key", "aliases": ["s_suppkey"], "type": ["null", "double"]}, {"name": "s_name", "type": ["null", "string"]}, {"name": "note", "type": "string", "default": "none"}]}
    return avro.read(spark, path, reader_schema=reader)


@query("SELECT n_nationkey, n_name FROM nation")
def avro_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    schema = avro.avro_schema(df.schema, "nation")
    framed = df.select(avro.encode(F.struct("n_nationkey", "n_name"), schema).alias("m"))
    return framed.select(avro.decode(F.col("m"), schema).alias("v")).select("v.*")


@query("SELECT p_partkey, p_type, p_size FROM part WHERE p_size > 25")
def orc_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = built(spark, sf_dir, "orc-part", lambda p: files.write_orc(table(spark, sf_dir, "part"), p, files.WriteOptions(bloom=["p_partkey"], sort_by=["p_size"])))
    return files.scan_orc(spark, path, columns=["p_partkey", "p_type", "p_size"], filter_=col("p_size").gt(25))


@query("SELECT c_custkey, c_name FROM customer WHERE c_name IN ('Customer#000000001', 'Customer#000000042') OR starts_with(c_name, 'Customer#00000009')")
def bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = built(spark, sf_dir, "bloom-customer", lambda p: files.write_parquet(table(spark, sf_dir, "customer"), p, files.WriteOptions(bloom=["c_name"], files=4, version2=True)))
    return files.scan_parquet(spark, path, columns=["c_custkey", "c_name"], filter_=col("c_name").isin("Customer#000000001", "Customer#000000042") | col("c_name").starts_with("Customer#00000009"))


@query("SELECT vec_id, len(embedding)::INTEGER AS dim, embedding[1]::DOUBLE AS head FROM embeddings")
def embedding_list_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.scan_parquet(spark, f"{sf_dir}/embeddings.parquet", columns=["vec_id", "embedding"]).select("vec_id", F.size("embedding").alias("dim"), F.col("embedding")[0].cast("double").alias("head"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fragment table of lineitem after a delete and an update, read at both versions through a filter."""
    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_returnflag")
    t = FragmentTable.create(spark, scratch(spark, "fragments"), df, 2)
    t.delete(col("l_returnflag").eq("R"))
    t.update(col("l_quantity").gt(45), {"l_returnflag": lit("X")})
    now = t.read(None, col("l_quantity").ge(10)).withColumn("version", F.lit(3))
    then = FragmentTable.open(spark, t.store.root, version=1).read(None, col("l_quantity").ge(10)).withColumn("version", F.lit(1))
    return now.union(then)


@query("SELECT l_orderkey, l_linenumber, l_quantity, CASE WHEN l_quantity > 45 THEN 'X' ELSE l_returnflag END AS l_returnflag, 3 AS version FROM lineitem WHERE l_returnflag <> 'R' AND l_quantity >= 10 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, 1 FROM lineitem WHERE l_quantity >= 10")
def fragment_time_travel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return flagship(spark, sf_dir)
