"""More registered queries: what pruning skips, and the maintenance, history and metadata of each kind of table.

Where a query is about skipping, its result is how many files and rows each predicate skips, and the SQL reckons the same
from the minima, maxima and counts of the units.
"""

from __future__ import annotations

import time

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.functions.registry import Registry
from tarnlake.operators import snaptable as sn
from tarnlake.operators import transforms as tr
from tarnlake.operators.fragtable import FragmentTable
from tarnlake.operators.logtable import LogTable, ProtocolError
from tarnlake.operators.storage import ConflictError, pieces, scratch
from tarnlake.plans import compile as comp
from tarnlake.plans.binding import bind
from tarnlake.plans.catalog import FILE_ROWS, ORDERS, built, fresh_log, fresh_snapshots, query, table, tested, zoned_events
from tarnlake.plans.expr import FALSE, TRUE, Expr, Lit, all_of, any_of, call, col, columns, lit, negate
from tarnlake.sources import avro, avro_codec, files

#: Ranges, about, into which a large table's Avro files are cut.
RANGES = 1000

# -- predicates --------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, true AS t, false AS f, o_totalprice > 100000 AS folded, true AS none_of_all, false AS none_of_any, o_totalprice <= 100000 AS negated FROM orders")
def pred_constants(spark: SparkSession, sf_dir: str) -> DataFrame:
    df, p = table(spark, sf_dir, "orders"), col("o_totalprice").gt(100000)
    return df.select("o_orderkey", *tested(df, t=TRUE, f=FALSE, folded=all_of(TRUE, any_of(FALSE, p)), none_of_all=all_of(), none_of_any=any_of(), negated=negate(negate(negate(p)))))


@query("SELECT o_orderkey, s IS NULL AS absent, s IS NOT NULL AS present, NOT (s IS NULL) AS not_absent FROM (SELECT o_orderkey, nullif(o_orderstatus, 'F') AS s FROM orders)")
def pred_is_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").withColumn("s", F.nullif("o_orderstatus", F.lit("F")))
    return df.select("o_orderkey", *tested(df, absent=col("s").is_null(), present=col("s").is_not_null(), not_absent=~col("s").is_null()))


@query("SELECT l_orderkey, l_linenumber, 'l_discount,l_quantity' AS reads, 5 + 2 AS ids FROM lineitem WHERE l_quantity < 10 AND l_discount > 0.04")
def pred_bound_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A predicate bound to field ids (places in the schema), the columns that it reads, and its result."""
    df = table(spark, sf_dir, "lineitem")
    bound = bind(col("l_quantity").lt(10) & col("l_discount").gt(0.04), df.schema)
    ids = sum(p.left.field_id for p in bound.parts)
    return comp.apply(df, bound).select("l_orderkey", "l_linenumber", F.lit(",".join(sorted(columns(bound)))).alias("reads"), F.lit(ids - 5).alias("ids"))


@query("SELECT c_custkey, c_acctbal * 2 + 1 AS twice, upper(substring(c_name, 1, 3)) AS head FROM customer WHERE c_acctbal * 2 + 1 > 1000")
def user_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pandas UDF and a builder of Columns, registered under names that expressions call."""

    @F.pandas_udf("double")
    def twice(v: pd.Series) -> pd.Series:
        return v * 2 + 1

    own = Registry()
    own.register("twice", twice)
    own.register("head", lambda c, n: F.upper(F.substr(c, F.lit(1), n)))
    df = table(spark, sf_dir, "customer")
    rows = comp.apply(df, call("twice", col("c_acctbal")).gt(1000.0), None, own)
    return rows.select("c_custkey", comp.expression(call("twice", col("c_acctbal")), df.schema, own).alias("twice"), comp.expression(call("head", col("c_name"), 3), df.schema, own).alias("head"))


# -- what pruning skips ------------------------------------------------------------------------------------------

#: Units of customers: of a hundred keys each, some all null, some all NaN, some mixed.
UNITS = """SELECT c_custkey // 100 AS g, c_custkey AS k, CASE WHEN c_custkey // 100 % 3 = 0 OR c_custkey // 100 % 3 = 1 AND c_custkey % 2 = 0 THEN NULL ELSE c_acctbal END AS b,
CASE WHEN c_custkey // 100 % 4 = 0 OR c_custkey // 100 % 4 = 1 AND c_custkey % 5 = 0 THEN 'nan'::DOUBLE ELSE c_acctbal END AS r, chr((65 + c_custkey // 100 % 4)::INTEGER) || c_name AS s FROM customer"""
BOUNDS = f"""WITH u AS ({UNITS}), z AS (SELECT g, count(*) AS n, min(k) AS kl, max(k) AS kh, min(b) AS bl, max(b) AS bh, count(*) - count(b) AS bn, min(CASE WHEN NOT isnan(r) THEN r END) AS rl,
max(CASE WHEN NOT isnan(r) THEN r END) AS rh, count(CASE WHEN isnan(r) THEN 1 END) AS rn, min(s) AS sl, max(s) AS sh FROM u GROUP BY g)"""


def decided(**cases: tuple[str, str]) -> str:
    """SQL of decisions: per predicate when a unit holds no match, and when it holds nothing else."""
    parts = [f"SELECT '{name}' AS predicate, CASE WHEN {never} THEN 'always false' WHEN {always} THEN 'always true' ELSE 'unknown' END AS decision, n FROM z" for name, (never, always) in cases.items()]
    return f"{BOUNDS} SELECT predicate, decision, count(*) AS files, sum(n)::BIGINT AS n_rows FROM ({' UNION ALL '.join(parts)}) GROUP BY 1, 2"


def units(spark: SparkSession, sf_dir: str) -> LogTable:
    def build(path: str) -> None:
        df, g, k, v = table(spark, sf_dir, "customer"), F.floor(F.col("c_custkey") / 100).cast("long"), F.col("c_custkey"), F.col("c_acctbal")
        b = F.when((g % 3 == 0) | (g % 3 == 1) & (k % 2 == 0), None).otherwise(v)
        r = F.when((g % 4 == 0) | (g % 4 == 1) & (k % 5 == 0), float("nan")).otherwise(v)
        df = df.select(g.alias("g"), k.alias("k"), b.alias("b"), r.alias("r"), F.concat(F.chr(65 + g % 4), "c_name").alias("s"))
        LogTable.create(spark, path, df.schema, ["g"]).write(df.repartition("g"))

    return LogTable.open(spark, built(spark, sf_dir, "log-units", build))


def decisions(spark: SparkSession, sf_dir: str, **cases: Expr) -> DataFrame:
    t, out = units(spark, sf_dir), None
    for name, p in cases.items():
        one = t.decisions(p).groupBy("decision").agg(F.count("*").alias("files"), F.sum("rows").alias("n_rows")).withColumn("predicate", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


@query(decided(lt=("kl >= 250", "kh < 250"), le=("kl > 250", "kh <= 250"), gt=("kh <= 250", "kl > 250"), ge=("kh < 250", "kl >= 250"), eq=("kl > 250 OR kh < 250", "kl = 250 AND kh = 250"), ne=("kl = 250 AND kh = 250", "kl > 250 OR kh < 250"), safe=("kl > 250 OR kh < 250", "kl = 250 AND kh = 250")))
def skipped_by_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = col("k")
    return decisions(spark, sf_dir, lt=k.lt(250), le=k.le(250), gt=k.gt(250), ge=k.ge(250), eq=k.eq(250), ne=k.ne(250), safe=k.eq_null_safe(250))


@query(decided(left=("kl >= 250", "kh < 250"), fold_true=("false", "true"), fold_false=("true", "false"), null_lit=("true", "false"), safe_null=("bn = 0", "bn = n"), all_null=("bn = n OR bh <= 5000", "bn = 0 AND bl > 5000")))
def skipped_by_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A literal on the left, two literals, null literals, and units that are all null."""
    left = lit(250)._compare(">", col("k"))
    return decisions(spark, sf_dir, left=left, fold_true=lit(1).lt(2), fold_false=lit(1).gt(2), null_lit=col("k").gt(Lit(None)), safe_null=col("b").eq_null_safe(None), all_null=col("b").gt(5000))


@query(decided(starts=("sl[1:2] > 'BC' OR sh[1:2] < 'BC'", "sl[1:2] = 'BC' AND sh[1:2] = 'BC'"), not_starts=("sl[1:2] = 'BC' AND sh[1:2] = 'BC'", "sl[1:2] > 'BC' OR sh[1:2] < 'BC'")))
def skipped_by_prefixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir, starts=col("s").starts_with("BC"), not_starts=col("s").not_starts_with("BC"))


@query(decided(absent=("bn = 0", "bn = n"), present=("bn = n", "bn = 0"), nan=("rn = 0", "rn = n"), not_nan=("rn = n", "rn = 0")))
def skipped_by_null_and_nan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir, absent=col("b").is_null(), present=col("b").is_not_null(), nan=col("r").is_nan(), not_nan=col("r").is_not_nan())


@query(decided(isin=("(kl > 120 OR kh < 120) AND (kl > 777 OR kh < 777)", "false"), not_in=("false", "(kl > 120 OR kh < 120) AND (kl > 777 OR kh < 777)"), both=("kl >= 250 OR bn = n OR bh <= 0", "kh < 250 AND bn = 0 AND bl > 0"), either=("kl >= 250 AND (bn = n OR bh <= 0)", "kh < 250 OR bn = 0 AND bl > 0"), call=("false", "false")))
def skipped_by_sets_and_connectives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """IN and NOT IN, AND and OR, and a call, about which statistics say nothing."""
    k, b = col("k"), col("b")
    return decisions(spark, sf_dir, isin=k.isin(120, 777), not_in=k.not_in(120, 777), both=k.lt(250) & b.gt(0), either=k.lt(250) | b.gt(0), call=call("modulo", k, 2).eq(0))


@query("SELECT (SELECT count(DISTINCT c_custkey // 100) FROM customer) AS files, (SELECT count(DISTINCT c_custkey // 100) FROM customer WHERE c_custkey // 100 NOT IN (1, 2)) AS skipped, count(*) AS found FROM customer WHERE c_custkey // 100 IN (1, 2)")
def skipped_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, p = units(spark, sf_dir), col("g").isin(1, 2)
    counts = t.read(["k"], p).agg(F.count("*").alias("found"))
    return counts.select(F.lit(len(t.plan())).alias("files"), F.lit(len(t.plan()) - len(t.plan(p))).alias("skipped"), "found")


@query("SELECT count(*) FILTER (lo > 4200 OR hi < 500) AS zones_skipped, count(*) FILTER (NOT (lo > 4200 OR hi < 500)) AS zones_read FROM (SELECT min(event_id) AS lo, max(event_id) AS hi FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS z FROM events) GROUP BY z)")
def skipped_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zoned_events(spark, sf_dir)
    read = z.zones(col("event_id").ge(500) & col("event_id").le(4200))
    return z.stats().agg((F.count("*") - len(read)).alias("zones_skipped"), F.lit(len(read)).cast("long").alias("zones_read"))


@query("SELECT g AS fragment_group, count(*) AS n, true AS indexed FROM (SELECT o_orderkey % 4 AS g FROM orders) GROUP BY 1 HAVING g IN (1, 3)")
def skipped_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four fragments, each with one value of the indexed column; two are read, as the index says."""

    def build(path: str) -> None:
        df = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 4).alias("g"))
        t = FragmentTable.create(spark, path, df.filter("g = 0"))
        for g in (1, 2, 3):
            t.append(df.filter(f"g = {g}"))
        t.create_index("by_g", "g", "bitmap")

    t = FragmentTable.open(spark, built(spark, sf_dir, "fragments-groups", build))
    found = t.plan(col("g").isin(1, 3))
    assert len(found) == 2 and len(t.manifest.fragments) == 4
    return t._rows(found).groupBy(F.col("g").alias("fragment_group")).agg(F.count("*").alias("n")).withColumn("indexed", F.lit("by_g" in t.indices()))


# -- history and maintenance -------------------------------------------------------------------------------------


@query("SELECT c_custkey, 'first' AS at FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'last' FROM customer")
def time_travel_by_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").select("c_custkey")
    t = fresh_log(spark, df.filter("c_custkey % 2 = 0"))
    then = t.current.timestamp
    time.sleep(0.01)
    t.write(df.filter("c_custkey % 2 = 1"))
    return t.read(timestamp=then).withColumn("at", F.lit("first")).union(t.read(timestamp=t.current.timestamp).withColumn("at", F.lit("last")))


@query("SELECT v AS version, true AS later FROM range(1, 4) r(v) WHERE (SELECT count(*) FROM region) > 0")
def commit_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commits of one millisecond still get timestamps that rise."""
    df = table(spark, sf_dir, "region").select("r_regionkey")
    t = fresh_log(spark, df, 1)
    t.write(df)
    t.write(df)
    stamps = [t.snapshot(v).timestamp for v in t.versions()]
    return spark.createDataFrame([(v, stamps[v] > stamps[v - 1]) for v in range(1, len(stamps))], "version long, later boolean")


@query("SELECT 'rows' AS domain, count(*)::VARCHAR AS configuration FROM nation UNION ALL SELECT 'regions', count(DISTINCT n_regionkey)::VARCHAR FROM nation")
def domain_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "nation")
    t = fresh_log(spark, df, 1)
    t.set_domain("gone", "x")
    t.set_domain("rows", str(t.read().count()))
    t.set_domain("regions", str(t.read().select("n_regionkey").distinct().count()))
    t.remove_domain("gone")
    t.checkpoint()
    found = LogTable.open(spark, t.store.root).domains()
    return spark.createDataFrame([(k, v) for k, v in found.items() if not k.startswith("delta.")], "domain string, configuration string")


@query("SELECT n_nationkey, true AS refused_read, true AS refused_write, true AS refused_delete FROM nation")
def protocol_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables that ask for an unknown feature aren't read or written, append-only ones not deleted from."""
    df = table(spark, sf_dir, "nation").select("n_nationkey")
    refused = {}
    for kind in ("reader", "writer"):
        t = fresh_log(spark, df, 1)
        t._commit(t.current, "UPGRADE", [{"protocol": {**t.current.protocol, f"{kind}Features": ["somethingNew"]}}])
        try:
            LogTable.open(spark, t.store.root).write(df)
        except ProtocolError:
            refused[kind] = True
    t = fresh_log(spark, df, 1, config={"delta.appendOnly": "true"})
    try:
        t.delete(col("n_nationkey").ge(0))
    except ProtocolError:
        refused["delete"] = True
    return t.read().select("n_nationkey", *[F.lit(refused.get(k, False)).alias(f"refused_{n}") for k, n in (("reader", "read"), ("writer", "write"), ("delete", "delete"))])


@query("SELECT c_custkey, c_name, 0 AS vectors FROM customer WHERE c_custkey % 3 <> 1")
def compat_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a compatibility mode, which excludes deletion vectors, a delete rewrites its files."""
    t = fresh_log(spark, table(spark, sf_dir, "customer").select("c_custkey", "c_name"), config={"delta.enableIcebergCompatV2": "true"}, mapping="name")
    t.delete(call("modulo", col("c_custkey"), 3).eq(1))
    return t.read().withColumn("vectors", F.lit(sum(bool(a.get("deletionVector")) for a in t.current.files.values())))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal, c_name, kind FROM customer, (SELECT 'log' AS kind UNION ALL SELECT 'fragments') WHERE c_custkey % 3 <> 0")
def batch_delegates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes and updates by functions over record batches."""
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", "c_name")

    def third(b: pa.RecordBatch) -> pa.Array:
        return pa.array(b.column("c_custkey").to_numpy() % 3 == 0)

    def rich(b: pa.RecordBatch) -> pa.Array:
        return pc.greater(b.column("c_acctbal"), 5000)

    def negated(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pc.negate(b.column("c_acctbal"))], names=["c_acctbal"])

    out = None
    for kind, t in (("log", fresh_log(spark, df)), ("fragments", FragmentTable.create(spark, scratch(spark, "fragments"), df, 2))):
        t.delete(third)
        t.update(rich, negated)
        part = t.read().withColumn("kind", F.lit(kind))
        out = part if out is None else out.union(part)
    return out


@query("SELECT n_nationkey, true AS conflict FROM nation UNION ALL SELECT r_regionkey + 100, true FROM region")
def optimistic_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two writers: an append moves behind the other's commit, an overwrite from a stale state is refused."""
    df, more = table(spark, sf_dir, "nation").select("n_nationkey"), table(spark, sf_dir, "region").selectExpr("r_regionkey + 100 as n_nationkey")
    one = fresh_log(spark, df.filter("n_nationkey < 10"), 1)
    two, three = LogTable.open(spark, one.store.root), LogTable.open(spark, one.store.root)
    one.write(df.filter("n_nationkey >= 10"))
    two.write(more)  # not at the version it expects
    try:
        three.write(df.limit(0), "overwrite")
        conflict = False
    except ConflictError:
        conflict = True
    return LogTable.open(spark, one.store.root).read().withColumn("conflict", F.lit(conflict))


@query("SELECT count(*) - 4 AS live, 4::BIGINT AS deleted, sum(CASE WHEN rn IN (0, 5, 17, 42) THEN 0 ELSE s_suppkey END)::BIGINT AS keys FROM (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) - 1 AS rn FROM (SELECT s_suppkey FROM supplier UNION ALL SELECT s_suppkey + 100000 FROM supplier UNION ALL SELECT s_suppkey + 200000 FROM supplier UNION ALL SELECT s_suppkey + 300000 FROM supplier UNION ALL SELECT s_suppkey + 400000 FROM supplier))")
def fragment_delete_by_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("i")).select((F.col("s_suppkey") + 100_000 * F.col("i")).alias("s_suppkey"))
    t = FragmentTable.create(spark, scratch(spark, "fragments"), df.repartitionByRange(1, "s_suppkey").sortWithinPartitions("s_suppkey"))
    deleted = t.delete_rows({0: [0, 5, 17]}) + t.delete_rows({0: [17, 42]})
    return t.read().agg(F.lit(t.count()).cast("long").alias("live"), F.lit(deleted).cast("long").alias("deleted"), F.sum("s_suppkey").alias("keys"))


@query("SELECT o_orderkey, o_orderstatus, o_totalprice, true AS old_files_gone FROM orders WHERE o_totalprice >= 100000")
def fragment_vacuum(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = FragmentTable.create(spark, scratch(spark, "fragments"), table(spark, sf_dir, "orders").select(*ORDERS), 3)
    t.delete(col("o_totalprice").lt(100000))
    t.compact()
    t.vacuum(keep=1)
    return FragmentTable.open(spark, t.store.root).read().withColumn("old_files_gone", F.lit(len(t.versions()) == 1 and len([e for e in t.store.walk("data") if e.path.endswith(".parquet")]) == sum(len(f.files) for f in t.manifest.fragments)))


@query("SELECT s_suppkey, 1 AS snapshots_left, true AS files_gone FROM supplier WHERE s_suppkey % 3 = 2")
def snapshot_expiry(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "supplier").select("s_suppkey")
    t = fresh_snapshots(spark, df.schema)
    t.append(df.filter("s_suppkey % 3 = 0"))
    t.append(df.filter("s_suppkey % 3 = 1"))
    t.overwrite_files([f.path for f in t.files("data")], df.filter("s_suppkey % 3 = 2"))
    removed = t.expire(older_than=sn.history(t.metadata)[-1].timestamp)
    left = {e.path for e in t.store.walk("data") if e.path.endswith(".parquet")}
    return t.read().withColumn("snapshots_left", F.lit(len(t.metadata.snapshots))).withColumn("files_gone", F.lit(bool(removed) and left == {f.path for f in t.files("data")}))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 2 END AS spec FROM orders WHERE o_orderdate >= TIMESTAMP '1994-01-01'")
def partition_spec_evolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files written under three partition specs, read as one table."""
    df = table(spark, sf_dir, "orders")
    t = fresh_snapshots(spark, df.schema, spec=[("o_orderdate", "year")])
    t.append(df.filter("o_orderkey % 3 = 0"))
    t.commit(sn.SpecUpdate(t.metadata).add_field("o_orderpriority", "identity").apply())
    t.append(df.filter("o_orderkey % 3 = 1"))
    t.commit(sn.SpecUpdate(t.metadata).remove_field("o_orderdate_year").apply())
    t.append(df.filter("o_orderkey % 3 = 2"))
    assert {f.spec_id for f in t.files("data")} == {0, 1, 2}
    since = comp.dt.datetime(1994, 1, 1)
    return t.read(["o_orderkey"], col("o_orderdate").ge(since)).withColumn("spec", (F.col("o_orderkey") % 3).cast("int"))


@query("SELECT event_id, date_diff('hour', TIMESTAMP '1970-01-01', ts)::INTEGER AS h, event_type AS same, NULL::VARCHAR AS nothing, true AS in_range FROM events")
def partition_transforms_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    bucket = tr.apply("bucket[16]", F.col("user_id"), kinds["user_id"])
    return df.select("event_id", tr.apply("hour", F.col("ts"), kinds["ts"]).alias("h"), tr.apply("identity", F.col("event_type"), kinds["event_type"]).alias("same"), tr.apply("void", F.col("event_type"), kinds["event_type"]).alias("nothing"), bucket.between(0, 15).alias("in_range"))


@query("SELECT 1 AS buckets_read, 4 AS buckets, count(*) AS n FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)")
def skipped_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An equality on a bucketed column reads the files of one bucket, though bounds would keep all."""
    df = table(spark, sf_dir, "orders").select("o_orderkey")
    t = fresh_snapshots(spark, df.schema, spec=[("o_orderkey", "bucket[4]")])
    t.append(df)
    low = df.agg(F.min("o_orderkey")).first()[0]
    wide = [f.path for f in t.files("data")]
    kept, _, _ = t.scan(col("o_orderkey").isin(low))
    buckets = lambda fs: len({f.partition["o_orderkey_bucket"] for f in fs})
    return t.read(None, col("o_orderkey").eq(low)).agg(F.lit(buckets(kept)).alias("buckets_read"), F.lit(buckets(t.files("data")) if wide else 0).alias("buckets"), F.count("*").alias("n"))


@query("SELECT s_suppkey, 'tag' AS ref FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT s_suppkey, 'main' FROM supplier UNION ALL SELECT s_suppkey, 'as of' FROM supplier WHERE s_suppkey % 2 = 0")
def tags_and_publish(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tag stays, a branch is published to main, and a time finds the snapshot of then."""
    df = table(spark, sf_dir, "supplier").select("s_suppkey")
    t = fresh_snapshots(spark, df.schema)
    t.append(df.filter("s_suppkey % 2 = 0"))
    first = t.metadata.snapshot()
    t.commit(sn.set_ref(t.metadata, "v1", first.id, "tag"))
    t.commit(sn.set_ref(t.metadata, "audit", first.id))
    t.append(df.filter("s_suppkey % 2 = 1"), branch="audit")
    t.commit(sn.publish(t.metadata, "audit"))
    then = sn.as_of(t.metadata, first.timestamp).current
    of = lambda ref, name: t.read(["s_suppkey"], snapshot=ref).withColumn("ref", F.lit(name))
    return of(sn.resolve_ref(t.metadata, "v1"), "tag").union(t.read(["s_suppkey"]).withColumn("ref", F.lit("main"))).union(of(then, "as of"))


@query("SELECT n_nationkey, n_name, 'a.t,a.u' AS tables, true AS refused FROM nation")
def in_memory_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Namespaces and tables in a catalog of this process; a writer that has raced is refused."""
    df = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    catalog = sn.Catalog.in_memory(spark, scratch(spark, "warehouse"))
    catalog.create_namespace("a")
    catalog.create_table("a.x", df.schema).append(df.filter("n_nationkey < 10"))
    catalog.rename_table("a.x", "a.t")
    catalog.create_table("a.u", df.schema)
    one, two = catalog.load_table("a.t"), catalog.load_table("a.t")
    one.append(df.filter("n_nationkey >= 10"))
    try:
        two.append(df)
        refused = False
    except ConflictError:
        refused = True
    return catalog.load_table("a.t").read().select("n_nationkey", "n_name", F.lit(",".join(catalog.list_tables("a"))).alias("tables"), F.lit(refused).alias("refused"))


@query("SELECT (year(o_orderdate) - 1970)::INTEGER AS y, count(*) AS n FROM orders GROUP BY 1")
def list_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by partition, out of the file list alone."""
    df = table(spark, sf_dir, "orders")
    t = fresh_snapshots(spark, df.schema, spec=[("o_orderdate", "year")])
    t.append(df)
    listed = spark.createDataFrame([(f.partition["o_orderdate_year"], f.rows) for f in t.files("data")], "y int, n long")
    return listed.groupBy("y").agg(F.sum("n").alias("n"))


@query("SELECT 'log' AS kind, count(*) AS n FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'fragments', count(*) FROM orders WHERE o_orderkey % 4 <> 0 UNION ALL SELECT 'zones', count(*) FROM events UNION ALL SELECT 'footer', count(*) FROM lineitem")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by metadata alone: statistics less deletion vectors, manifests, the zone header, a footer."""
    df = table(spark, sf_dir, "orders").select(*ORDERS)
    t = fresh_log(spark, df)
    t.delete(call("modulo", col("o_orderkey"), 4).eq(0))
    f = FragmentTable.create(spark, scratch(spark, "fragments"), df, 2)
    f.delete(call("modulo", col("o_orderkey"), 4).eq(0))
    footer = files.parquet_metadata(f"{sf_dir}/lineitem.parquet")["rows"]
    return spark.createDataFrame([("log", t.count()), ("fragments", f.count()), ("zones", zoned_events(spark, sf_dir).info["rows"]), ("footer", footer)], "kind string, n long")


# -- statistics and files ----------------------------------------------------------------------------------------


@query("SELECT z AS zone, min(event_id) = max(event_id) AS constant, true AS sorted, true AS strict, sum(event_id)::BIGINT AS total FROM (SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS z FROM events) GROUP BY z")
def zone_order_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = zoned_events(spark, sf_dir).column_stats("event_id")
    return s.select(F.col("_zone").alias("zone"), "constant", "sorted", "strict", F.col("sum").alias("total"))


@query("SELECT z AS zone, sum(octet_length(encode(event_type)))::BIGINT AS type_bytes, 8 * count(event_id) AS id_bytes FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS z FROM events) GROUP BY z")
def zone_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zoned_events(spark, sf_dir)
    return z.column_stats("event_type").select(F.col("_zone").alias("zone"), F.col("bytes").alias("type_bytes")).join(z.column_stats("event_id").select(F.col("_zone").alias("zone"), F.col("bytes").alias("id_bytes")), "zone")


@query("SELECT z AS zone, bool_and(u >= coalesce(p, u)) AS sorted, bool_and(p IS NULL OR u > p) AS strict FROM (SELECT user_id AS u, z, lag(user_id) OVER (PARTITION BY z ORDER BY event_id) AS p FROM (SELECT *, (row_number() OVER (ORDER BY event_id) - 1) // 1000 AS z FROM events)) GROUP BY z")
def zone_unsorted_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return zoned_events(spark, sf_dir).column_stats("user_id").select(F.col("_zone").alias("zone"), "sorted", "strict")


@query("SELECT event_id, event_type FROM events WHERE event_id % 2 = 0")
def projection_by_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = zoned_events(spark, sf_dir)
    names = z.schema.fieldNames()
    return z.read([names.index("event_id"), names.index("event_type")], call("modulo", col("event_id"), 2).eq(0))


@query(f"{BOUNDS} SELECT g, n, rl AS low, rh AS high, rn AS nans, bn AS nulls FROM z")
def file_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per file: bounds without NaN, and counts of NaN and null."""
    t = units(spark, sf_dir)
    return t.files_frame(t.current).select(F.col("g.min").alias("g"), F.col("rows").alias("n"), F.col("r.min").alias("low"), F.col("r.max").alias("high"), F.col("r.nans").alias("nans"), F.col("b.nulls").alias("nulls"))


def grouped_orders(spark: SparkSession, sf_dir: str) -> list[str]:
    """orders in files of some row groups each, by ranges of their keys; a small table is one file."""

    def build(path: str) -> None:
        df = table(spark, sf_dir, "orders")
        n = df.count()
        many = max(1, -(-n // FILE_ROWS))
        files.write_parquet(df.repartitionByRange(many, "o_orderkey"), path, files.WriteOptions(compression="gzip", level=6, group_bytes=max(4096, 3 * n // many), dictionary={"o_orderkey": False, "o_custkey": False}, sort_by=["o_orderkey"], bloom=["o_custkey"]))

    return parquet_files(built(spark, sf_dir, "grouped-orders", build))


def parquet_files(path: str) -> list[str]:
    from pathlib import Path
    from urllib.parse import urlparse

    return sorted(map(str, Path(urlparse(path).path).glob("*.parquet")))


@query("SELECT count(*) AS n, min(o_orderkey) AS low, max(o_orderkey) AS high, true AS many, 'GZIP' AS codec FROM orders")
def parquet_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the row groups of files add up to, by their footers."""
    groups = [g for p in grouped_orders(spark, sf_dir) for g in files.parquet_metadata(p)["row_groups"]]
    rows = [(g["rows"], g["columns"]["o_orderkey"]["min"], g["columns"]["o_orderkey"]["max"], g["columns"]["o_orderkey"]["codec"]) for g in groups]
    df = spark.createDataFrame(rows, "n long, low long, high long, codec string")
    return df.agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.count("*") > 1).alias("many"), F.min("codec").alias("codec"))


@query("SELECT o_orderkey, o_custkey FROM orders")
def parquet_row_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files read group by group: the first of each, the last, and all between by their own scans of rows."""
    paths = grouped_orders(spark, sf_dir)
    many, out = max(len(files.parquet_metadata(p)["row_groups"]) for p in paths), None
    for k in range(many):
        part = files.row_group(spark, paths, k, ["o_orderkey", "o_custkey"])
        out = part if out is None else out.union(part)
    return out


@query("SELECT true AS bounds_cut, true AS bloom_cuts, true AS sound, count(*) AS n FROM orders WHERE o_custkey = (SELECT o_custkey FROM orders GROUP BY 1 ORDER BY count(*), 1 LIMIT 1)")
def row_groups_by_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Row groups for a value of an unsorted column: its bounds keep nearly all, Bloom filters fewer, or just those that hold it."""
    paths = grouped_orders(spark, sf_dir)
    df = spark.read.parquet(*paths)
    value = df.groupBy("o_custkey").count().orderBy("count", "o_custkey").first()["o_custkey"]  # the rarest
    least = df.agg(F.min("o_orderkey")).first()[0]
    by_bounds, first, groups = 0, [], []
    for p in paths:
        kept, end = set(files.bloom_groups(spark, p, "o_custkey", value)), 0
        by_bounds += len(files.candidate_groups(p, "o_custkey", value))
        first += [(p, k) for k in files.candidate_groups(p, "o_orderkey", least)]
        for k, g in enumerate(files.parquet_metadata(p)["row_groups"]):
            groups.append((p.rpartition("/")[2], k, end, end := end + g["rows"], k in kept))
    by_bloom = sum(g[-1] for g in groups)
    spans = F.broadcast(spark.createDataFrame(groups, "name string, k int, lo long, hi long, kept boolean"))
    hits = df.select("o_custkey", F.col("_metadata.file_name").alias("name"), F.col("_metadata.row_index").alias("row")).filter(F.col("o_custkey") == value)
    hits = hits.join(spans, "name").filter("row >= lo and row < hi")
    return hits.agg(F.lit([k for _, k in first] == [0]).alias("bounds_cut"), (F.lit(by_bloom < by_bounds) | (F.count_distinct("name", "k") == by_bloom)).alias("bloom_cuts"), F.bool_and("kept").alias("sound"), F.count("*").alias("n"))


@query("SELECT p_partkey, p_size, true AS verified FROM part WHERE p_size > 10")
def scan_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Small batches and page checksums; the session's own settings stay."""
    before = spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")
    df = files.scan_parquet(spark, f"{sf_dir}/part.parquet", columns=["p_partkey", "p_size"], filter_=col("p_size").gt(10), batch_rows=64, verify_checksums=True)
    return df.withColumn("verified", F.lit(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize") == before))


@query("SELECT p_partkey, p_name, p_size FROM part")
def buffered_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of at most 50 rows; every one is as small as was asked."""
    path = scratch(spark, "buffered")
    files.write_parquet(table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size"), path, files.WriteOptions(max_rows_per_file=50, compression="snappy"))
    df = spark.read.parquet(path)
    most = df.groupBy(F.col("_metadata.file_name").alias("f")).count().agg(F.max("count")).first()[0]
    return df.filter(F.lit(most <= 50))


@query("SELECT count(*) AS n, 'ZLIB' AS codec, 1000 AS stride FROM part")
def orc_footers(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "orc")
    files.write_orc(table(spark, sf_dir, "part"), path, files.WriteOptions(compression="zlib", files=2), stride=1000)
    from pathlib import Path
    from urllib.parse import urlparse

    found = [files.orc_metadata(str(p)) for p in Path(urlparse(path).path).glob("*.orc")]
    df = spark.createDataFrame([(m["rows"], sum(m["stripe_rows"]), m["compression"].upper(), m["row_index_stride"]) for m in found], "n long, by_stripe long, codec string, stride int")
    return df.filter("n = by_stripe").agg(F.sum("n").alias("n"), F.min("codec").alias("codec"), F.min("stride").alias("stride"))


@query("SELECT c_custkey, c_acctbal FROM customer")
def avro_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two of five fields, one by name and one by leaving the rest out."""
    path = built(spark, sf_dir, "avro-customer", lambda p: avro.write(table(spark, sf_dir, "customer"), p, "deflate"))
    by_name = avro.read(spark, path, columns=["c_custkey"]).withColumn("k", F.col("c_custkey"))
    rest = avro.read(spark, path, skip=["c_name", "c_nationkey", "c_mktsegment"])
    return rest.join(by_name.select("k"), rest["c_custkey"] == F.col("k"), "left_semi")


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_returnflag, l_shipdate FROM lineitem")
def avro_splits_lz4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem in files of many blocks, read by ranges of the files. A table of up to FILE_ROWS rows is one file; past RANGES ranges they grow, not their number."""
    names = ["l_orderkey", "l_linenumber", "l_quantity", "l_returnflag", "l_shipdate"]

    def build(path: str) -> None:
        df = table(spark, sf_dir, "lineitem").select(*names)
        many = pieces(df, 1, FILE_ROWS)
        avro.write(df.coalesce(1) if many == 1 else df.repartition(many), path, "lz4")

    path = built(spark, sf_dir, "avro-lineitem", build)
    avro.register(spark)
    return spark.read.format("avro_ocf").option("split", max(100_000, sum(size for _, size in avro.sized(path)) // RANGES)).load(path)


@query("SELECT r_regionkey, r_name, true AS known FROM region")
def avro_schema_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages that carry a fingerprint are read by the schema that the store holds for it."""
    df = table(spark, sf_dir, "region")
    schema, store = avro.avro_schema(df.schema, "region"), avro_codec.SchemaStore()
    key = store.register(schema)
    framed = df.select(avro.encode(F.struct(*df.columns), schema).alias("m"))
    return framed.select(avro.decode(F.col("m"), schema, store=store).alias("v")).select("v.*").withColumn("known", F.lit(store.lookup(key) is not None and store.lookup(bytes(8)) is None))
