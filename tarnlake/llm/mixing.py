"""Mixing sources to target weights by hash-threshold histograms. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import drop_path, materialize, stored

#: Bits of the hash that one histogram level resolves, and how many levels there are.
LEVEL_BITS, LEVELS = 10, 5
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """One row per source: source, source_size, target.

    Sources in code point order, null last, weigh weights[0], weights[1], ..., repeating. Their targets share the
    size of everything by weight, but none is above max_repeats times its source's size; what that leaves over is
    shared again by weight among the rest. The level at which this settles is found in one ordered pass: sources fill
    up in the order of their limit per weight.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    weighed = totals.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(by_name) - 1) % len(weights) + 1).cast("double"))
    weighed = weighed.withColumn("most", (F.col("source_size") * max_repeats).cast("double")).withColumn("ratio", F.col("most") / F.col("w"))
    everything = Window.partitionBy()
    upto = Window.orderBy("ratio", F.col("source").isNull(), F.col("source").cast("binary")).rowsBetween(Window.unboundedPreceding, -1)
    weighed = weighed.withColumn("level", (F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(upto), F.lit(0.0))) / (F.sum("w").over(everything) - F.coalesce(F.sum("w").over(upto), F.lit(0.0))))
    # the first source whose limit the level doesn't reach fixes the level for it and all after it
    weighed = weighed.withColumn("fixed", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"])
    return weighed.select("source", "source_size", F.least("most", F.coalesce(F.col("fixed") * F.col("w"), F.col("most"))).alias("target"))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "doc_id", "source", F.xxhash64("text"))


def _plan(base: DataFrame, weights: Sequence[int], max_repeats: int) -> DataFrame:
    """base: source, size, h. A row per source: key, source_size, target, whole (repeats that all its documents get),
    cut (those with a hash prefix below it get one more; null: none do) and left (the words still wanted of those at the cut)."""
    targets = source_targets(base, weights, max_repeats)
    targets = targets.withColumn("whole", F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(max_repeats))).otherwise(0).cast("long"))
    first = targets.withColumn("need", F.greatest(F.col("target") - F.col("whole") * F.col("source_size"), F.lit(0.0))).withColumn("prefix", F.lit(0).cast("long"))
    first = edge = materialize(first.withColumn("key", F.struct("source")), "mixing-targets")
    for level in range(1, LEVELS + 1):
        binned = base.select(F.struct("source").alias("key"), "size", F.shiftrightunsigned("h", 64 - LEVEL_BITS * level).alias("b"))
        if level == 1:
            binned = binned.withColumn("prefix", F.lit(0).cast("long"))
        else:  # only the bucket where the sum crosses what is needed
            binned = binned.withColumn("prefix", F.shiftrightunsigned("b", LEVEL_BITS)).join(edge.select("key", "prefix"), ["key", "prefix"], "left_semi")
        run = Window.partitionBy("key").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        bins = binned.groupBy("key", "prefix", "b").agg(F.sum("size").alias("n")).join(edge.select("key", "prefix", "need"), ["key", "prefix"]).withColumn("before", F.coalesce(F.sum("n").over(run), F.lit(0)))
        crossing = bins.filter((F.col("before") <= F.col("need")) & (F.col("before") + F.col("n") > F.col("need")))
        edge = materialize(crossing.select("key", F.col("b").alias("prefix"), (F.col("need") - F.col("before")).alias("need"), "n"), "mixing-edge")
    # buckets below the crossing one are taken; what is wanted of that one itself, _at_cut() deals out
    return materialize(first.join(edge.select("key", F.col("prefix").alias("cut"), F.col("need").alias("left")), "key", "left").select("key", "source_size", "target", "whole", "cut", "left"), "mixing-plan")


def _prefix() -> Column:
    return F.shiftrightunsigned("h", 64 - LEVEL_BITS * LEVELS)


def _at_cut(rows: DataFrame) -> DataFrame:
    """rows: those whose hash is at their source's cut, with key, part, size, left. Adds more: 1 for as many of them, one after the other, as come nearest
    to what is left. Rows that agree in everything share a hash, so there can be many: they are numbered part by part, and
    only the parts' sums are put in order for a whole source."""
    parts = rows.groupBy("key", "part").agg(F.sum("size").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select("key", "part", before.alias("before"))
    inside = Window.partitionBy("key", "part").orderBy("h", "size").rowsBetween(Window.unboundedPreceding, -1)
    numbered = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(parts, ["key", "part"])
    return numbered.withColumn("more", (F.col("before") + F.col("inside") + F.col("size") / 2 <= F.col("left")).cast("int")).drop("before", "inside")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """rows: joined with the plan. Those whose hash tells what they get, with more; and those at the cut."""
    at = F.coalesce(_prefix() == F.col("cut"), F.lit(False))
    return rows.filter(~at).withColumn("more", F.coalesce(_prefix() < F.col("cut"), F.lit(False)).cast("int")), rows.filter(at)


def _repeats(max_repeats: int) -> Column:
    return F.least(F.col("whole") + F.col("more"), F.lit(max_repeats)).cast("long")


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: int = 42) -> DataFrame:
    """Take whole documents, some of them several times, until each source holds about its target of words.

    docs: doc_id, text, source; other columns are ignored. Returns doc_id, size, source_size, target, taken
    (size times the repeats that the mix takes) and repeats.

    Every document of a source is taken floor(target / source_size) times, and once more if its hash is below the
    source's threshold. Thresholds come from histograms of words by source and hash prefix: the bucket in which the
    sum crosses the rest of the target is the only one that the next level looks into, so documents are never sorted.
    After the last level the documents of the crossing bucket are taken one by one as long as that ends nearer the target.

    Null texts have size 0; null is a source of its own, last in order. Rows that agree in doc_id, source and text
    share a hash; where the threshold falls on them, some are taken once more and some aren't. Sources without words have target 0. An empty
    table gives no rows.
    """
    base = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash(seed).alias("h"), F.spark_partition_id().alias("part")), "mixing")
    told, at_cut = _split(base.withColumn("key", F.struct("source")).join(_plan(base, weights, max_repeats), "key"))
    taken = told.unionByName(_at_cut(at_cut)).withColumn("repeats", _repeats(max_repeats))
    return taken.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repeats")).alias("taken"), "repeats")


def mixed(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_repeats: int = 3, seed: int = 42) -> DataFrame:
    """The mix itself: the rows of docs, all columns, each as often as mix() takes it. Rows without words, which
    weigh nothing, stay as they are."""
    base, base_at = stored(docs.select("source", word_count(F.col("text")).alias("size"), _hash(seed).alias("h")), "mixing")
    plan = _plan(base, weights, max_repeats).select("key", "cut", "left", "whole")
    drop_path(docs.sparkSession, base_at)
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.struct("source").alias("key"), _hash(seed).alias("h"), word_count(F.col("text")).alias("size"))
    told, at_cut = _split(packed.join(plan, "key"))
    at_cut = materialize(at_cut.withColumn("part", F.spark_partition_id()), "mixing-cut")
    times = F.when(F.col("size") > 0, _repeats(max_repeats)).otherwise(1).cast("int")
    return told.unionByName(_at_cut(at_cut).drop("part")).select("row", F.explode(F.array_repeat(F.lit(0), times))).select("row.*")
