"""Connected components of an edge list by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import drop_path, scratch_path


#: Parts over which the edges of one node are dealt.
SALTS = 16


def _toward_min(pairs: DataFrame) -> DataFrame:
    """(u, v) rows with the smallest v of each u beside them. The minimum is combined map-side, so a hub costs one row per task; in
    the join back its edges are dealt over SALTS keys."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("s")
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), salts)
    salted = pairs.withColumn("s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    return salted.join(least.hint("merge"), ["u", "s"]).select("u", "v", "m")


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _toward_min(both).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    near = _toward_min(edges)
    return near.select("u", F.col("m").alias("v")).union(near.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v"))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """edges: long columns u, v in any direction, loops and repeats allowed. Returns (node, root) for every node
    with an edge to another node, root being the smallest node of its component.

    Each round is written to the shared folder, so no round is recomputed when an executor is lost.
    Raises RuntimeError if max_rounds rounds don't reach a fixed point (depth is logarithmic in practice).
    """
    spark = edges.sparkSession

    def settle(df: DataFrame) -> tuple[DataFrame, str, tuple]:
        path = scratch_path(spark, "components")
        df.distinct().write.parquet(path)
        out = spark.read.schema("u long, v long").parquet(path)
        mark = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return out, path, tuple(mark)

    state, path, mark = settle(edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    for _ in range(max_rounds):
        if not mark[0]:
            break
        new, new_path, new_mark = settle(_small_star(_large_star(state)))
        drop_path(spark, path)
        done = new_mark == mark
        state, path, mark = new, new_path, new_mark
        if done:
            break
    else:
        raise RuntimeError("components: no fixed point")
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
