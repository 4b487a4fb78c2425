"""Approximate nearest neighbours by inner product: a forest of random-projection trees, one priority queue of leaves per
query that all trees share, then exact reranking of what the opened leaves hold.

The trees are grown on a bounded sample; every vector is filed into a leaf of each. To turn inner products into
distances while they grow, vectors get one more coordinate that makes their lengths equal. A query's queue holds the leaves of
all trees, the one whose centre has the largest inner product with it first, and opens them until they hold the wanted number of entries.
How many that is, is learnt: the effort at which the nearest ones of a sample are found with the target recall.

Queries and vectors meet by leaf. Neighbouring leaves of a tree go to a task as one tile, leaves too large for a tile are dealt over several, and
a query goes to the tiles where it opened a leaf. There it is compared with the vectors of those leaves and with no others.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnlake.llm.common import materialize
from tarnlake.llm.vectors import matrix, row_dots, usable

#: Trees, vectors that they are fitted on at most, of which a leaf has about so many, and the recall that the effort is set for.
TREES, SAMPLE, LEAF_ROWS, RECALL = 8, 20_000, 20, 0.95
#: Vectors apart from the sample on which the effort is learnt, and probes.
HELD, PROBES = 4096, 512
#: Sample rows that bound a query's results from below.
FLOOR = 8192
#: Vectors of a tile, and queries that one task takes to it.
TILE, QUERY_BLOCK = 8192, 65_536


@dataclass
class Forest:
    """Complete trees, level by level. normals: trees x inner nodes x coordinates (the last one is the added one); centres: trees x leaves x coordinates."""

    normals: np.ndarray
    cuts: np.ndarray
    longest: float
    centres: np.ndarray

    @property
    def inner(self) -> int:
        return self.normals.shape[1]

    def lifted(self, v: np.ndarray) -> np.ndarray:
        return np.concatenate([v, np.sqrt(np.maximum(self.longest**2 - row_dots(v, v), 0))[:, None]], axis=1)

    def leaves(self, v: np.ndarray) -> np.ndarray:
        """Rows x trees."""
        x = self.lifted(v)
        out = np.zeros((len(v), len(self.normals)), np.int64)
        for t, (normal, cut) in enumerate(zip(self.normals, self.cuts, strict=True)):
            node = out[:, t]
            while self.inner and node.min(initial=self.inner) < self.inner:
                node = 2 * node + 1 + (np.einsum("ij,ij->i", x, normal[node]) > cut[node])
            out[:, t] = node - self.inner
        return out

    def queue(self, q: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each query the leaves (tree x leaf, numbered through) in the order in which its queue gives them, and how many entries those before each hold."""
        near = q @ self.centres.reshape(-1, q.shape[1]).T
        order = np.argsort(-near, axis=1, kind="stable")
        many = sizes.ravel()[order]
        return order, np.cumsum(many, axis=1) - many


def grow(sample: np.ndarray, longest: float, depth: int, trees: int = TREES, seed: int = 5) -> Forest:
    """Each split halves its rows at the median along the line through two of them."""
    inner, dim = 2**depth - 1, sample.shape[1]
    forest = Forest(np.zeros((trees, inner, dim + 1)), np.zeros((trees, inner)), longest, np.zeros((trees, inner + 1, dim)))
    x = forest.lifted(sample)
    for t in range(trees):
        rng, rows = np.random.default_rng((seed, t)), {0: (np.arange(len(x)), sample.mean(axis=0))}
        for k in range(inner):
            own, centre = rows.pop(k)
            normal = x[own[rng.integers(len(own))]] - x[own[rng.integers(len(own))]] if len(own) > 1 else np.zeros(dim + 1)
            if not normal.any():
                normal = rng.normal(size=dim + 1)
            normal /= np.linalg.norm(normal)
            along = x[own] @ normal
            cut = np.median(along) if len(own) else 0.0
            forest.normals[t, k], forest.cuts[t, k] = normal, cut
            for child, half in ((2 * k + 1, own[along <= cut]), (2 * k + 2, own[along > cut])):
                rows[child] = half, sample[half].mean(axis=0) if len(half) else centre  # an empty half lies about where its parent does
        for k, (_, centre) in rows.items():
            forest.centres[t, k - inner] = centre
    return forest


def effort(forest: Forest, v: np.ndarray, k: int, recall: float) -> float:
    """Entries, as a multiple of the vectors, that a queue must open to find the k nearest of v's rows among the others with that recall."""
    if len(v) < 2:
        return 1.0
    leaves, trees = forest.leaves(v), len(forest.normals)
    numbered = leaves + np.arange(trees) * (forest.inner + 1)
    sizes = np.bincount(numbered.ravel(), minlength=trees * (forest.inner + 1))
    some = np.random.default_rng(9).permutation(len(v))[:PROBES]
    near = v[some] @ v.T
    near[np.arange(len(some)), some] = -np.inf
    k = min(k, len(v) - 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    cost = []
    for at in range(0, len(some), 64):
        order, before = forest.queue(v[some[at : at + 64]], sizes)
        when = np.empty_like(before)
        np.put_along_axis(when, order, before, axis=1)
        cost.append(np.take_along_axis(when, numbered[best[at : at + 64]].reshape(len(order), -1), axis=1).reshape(len(order), k, trees).min(axis=2))
    return float(np.quantile(np.concatenate(cost), recall, method="higher") + 1) / len(v)


def tiles(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first tile of each leaf, and over how many it is dealt; sizes: trees x leaves. A tile holds leaves of one tree."""
    first, parts, at = np.zeros(sizes.shape, np.int64), np.ones(sizes.shape, np.int64), -1
    for t, row in enumerate(sizes.tolist()):
        room = -1
        for leaf, n in enumerate(row):
            if n > TILE:
                first[t, leaf], parts[t, leaf], room = at + 1, -(-n // TILE), -1
                at += int(parts[t, leaf])
                continue
            if room < n:
                at, room = at + 1, TILE
            first[t, leaf], room = at, room - n
    return first, parts


def leaf_batches(forest, dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = forest.value.leaves(matrix(batch.column(2), dim)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(leaves) + 1, dtype=np.int32) * leaves.shape[1]), pa.array(leaves.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["key", "vec_id", "vec", "copies", "leaves"])

    return run


def ask_batches(forest, layout, dim: int, wanted: float, k: int):
    """A row per query and tile in which it opened a leaf: the leaves, and what its k best must reach at least."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = forest.value
        sizes, first, parts, floor, floor_leaves = layout.value
        flat_first, flat_parts = first.ravel(), parts.ravel()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                q = matrix(part.column(2), dim)
                order, before = own.queue(q, sizes)
                open_ = np.zeros(order.shape, bool)
                np.put_along_axis(open_, order, before < wanted, axis=1)
                # the k best reach what the k best of the sample's rows do that lie in opened leaves; its own row may be one of them
                seen = q @ floor.T
                reached = np.zeros(seen.shape, bool)
                for column in floor_leaves.T:
                    reached |= open_[:, column]
                seen[~reached] = -np.inf
                bar = np.partition(seen, -k - 1, axis=1)[:, -k - 1] if seen.shape[1] > k else np.full(len(q), -np.inf)
                bar -= 1e-9 * np.abs(np.where(np.isfinite(bar), bar, 0))
                rows, asked, lists = [], [], []
                for i, line in enumerate(open_):
                    leaves = np.flatnonzero(line & (sizes.ravel() > 0))
                    whole = leaves[flat_parts[leaves] == 1]
                    cuts = np.flatnonzero(np.diff(flat_first[whole], prepend=-1))
                    for own_leaves in np.split(whole, cuts[1:]) if len(whole) else []:
                        rows.append(i), asked.append(flat_first[own_leaves[0]]), lists.append(own_leaves)
                    for leaf in leaves[flat_parts[leaves] > 1].tolist():
                        for tile in range(flat_first[leaf], flat_first[leaf] + flat_parts[leaf]):
                            rows.append(i), asked.append(tile), lists.append(np.array([leaf]))
                if rows:
                    ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                    leaves = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(lists).astype(np.int32)))
                    taken = part.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([pa.array(np.array(asked, np.int64)), *taken.columns[:3], pa.array(bar[rows]), leaves], names=["tile", "key", "vec_id", "vec", "bar", "leaves"])

    return run


class Tile:
    """Vectors of a tile, by leaf."""

    def __init__(self, parts: list[pa.RecordBatch], dim: int) -> None:
        t = pa.Table.from_batches(parts).combine_chunks()
        leaf = t["leaf"].to_numpy()
        by = np.argsort(leaf, kind="stable")
        self.key, self.id, self.copies = (t[c].to_numpy()[by] for c in ("key", "vec_id", "copies"))
        self.v = matrix(t["vec"].combine_chunks(), dim)[by]
        self.leaf, self.start = np.unique(leaf[by], return_index=True)
        self.end = np.append(self.start[1:], len(by))

    def rerank(self, key: np.ndarray, ids: np.ndarray, q: np.ndarray, bar: np.ndarray, opened: pa.ListArray, k: int) -> pa.RecordBatch:
        """The k best for each query out of the leaves that it opened, by exact scores. Ties go to the smaller id."""
        leaf, asks = opened.values.to_numpy(), np.repeat(np.arange(len(q)), np.diff(opened.offsets.to_numpy()))
        leaf = leaf[opened.offsets[0].as_py() : opened.offsets[-1].as_py()]
        by = np.argsort(leaf, kind="stable")
        leaf, asks = leaf[by], asks[by]
        places, starts = np.unique(leaf, return_index=True)
        found_q, found_v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for n, a, b in zip(places, starts, np.append(starts[1:], len(leaf)), strict=True):
            at = int(np.searchsorted(self.leaf, n))
            if at == len(self.leaf) or self.leaf[at] != n:
                continue
            who, lo, hi = asks[a:b], int(self.start[at]), int(self.end[at])
            i, j = np.nonzero(q[who] @ self.v[lo:hi].T >= bar[who][:, None])
            found_q.append(who[i])
            found_v.append(lo + j)
        i, j = np.concatenate(found_q), np.concatenate(found_v)
        other = (key[i] != self.key[j]) | (self.copies[j] > 1)
        i, j = i[other], j[other]
        score = np.concatenate([row_dots(q[i[a : a + 16_384]], self.v[j[a : a + 16_384]]) for a in range(0, max(1, len(i)), 16_384)])
        order = np.lexsort((self.key[j], self.id[j], -score, i))
        i, j, score = i[order], j[order], score[order]
        best = np.arange(len(i)) - np.searchsorted(i, i, side="left") < k
        i, j = i[best], j[best]
        copies = self.copies[j] - (key[i] == self.key[j])
        return pa.RecordBatch.from_arrays([pa.array(x) for x in (key[i], ids[i], self.key[j], self.id[j], copies, score[best])], names=["query_key", "query_id", "key", "vec_id", "copies", "score"])


def rerank_batches(dim: int, k: int):
    """Rows come sorted by tile, block of queries and whether they ask: first the vectors of a tile, then its queries, which pass through."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, tile = None, [], None
        for batch in batches:
            place = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)], axis=1)
            new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(axis=1)])) if len(place) else []
            for lo, hi in zip(new, [*new[1:], len(place)], strict=True):
                t, block, asks = place[lo].tolist()
                if at != (t, block):
                    at, held, tile = (t, block), [], None
                part = batch.slice(int(lo), int(hi - lo))
                if not asks:
                    held.append(part.select(["key", "vec_id", "vec", "copies", "leaf"]))
                elif held:
                    tile = tile or Tile(held, dim)
                    for a in range(0, part.num_rows, 512):
                        some = part.slice(a, 512)
                        yield tile.rerank(some["key"].to_numpy(), some["vec_id"].to_numpy(), matrix(some["vec"], dim), some["bar"].to_numpy(), some["leaves"], k)

    return run


def search(vectors: DataFrame, every: int = 20, k: int = 20, vector: str = "embedding", recall: float = RECALL) -> DataFrame:
    """For each vector with an id divisible by `every`, its k nearest of all the others by inner product in double precision:
    query_id, rank (from 1), vec_id, score, and query_key, which tells queries apart that share an id. Ties go to the smaller vec_id; fewer than k if there are no more.

    vectors: vec_id (long), the vector (array of float or double), and any others. Vectors that are null, empty, zero or hold null
    or non-finite components take no part, nor do those without an id or of another length than most have. Rows that repeat id and vector
    ask once, and are found as often as they occur; vectors that share an id ask and are found each. An empty table gives no rows.

    recall is the share of the nearest that the effort is set for, on the sample; at least k entries of each tree are opened.
    """
    spark = vectors.sparkSession
    kind = "array<double>" if vectors.schema[vector].dataType.simpleString() == "array<double>" else "array<float>"
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, query_key long")
    base = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast(kind).alias("vec")).filter(usable(F.col("vec")) & F.col("vec_id").isNotNull())
    length = F.aggregate("vec", F.lit(0.0).cast("double"), lambda a, x: a + x.cast("double") * x.cast("double"))
    kinds = base.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n"), F.max(length).alias("m")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    if not kinds:
        return empty
    dim, n, longest = kinds[0]["dim"], kinds[0]["n"], float(np.sqrt(kinds[0]["m"])) * (1 + 1e-9)
    key = F.xxhash64("vec_id", "vec")
    base = base.filter(F.size("vec") == dim).groupBy("vec_id", "vec").agg(F.count("*").alias("copies")).select(key.alias("key"), "vec_id", "vec", "copies")
    # by hash: about a sample's worth, of which the least are taken
    share = min(1.0, 1.3 * (SAMPLE + HELD) / n)
    by_hash = F.xxhash64(F.lit(77), "key")
    drawn = base.filter(F.shiftrightunsigned(by_hash, 33) < int(share * 2**31)).orderBy(by_hash).limit(SAMPLE + HELD).select("vec").toArrow()
    drawn = matrix(drawn.column(0).combine_chunks(), dim)
    apart = len(drawn) > SAMPLE
    sample, probes = (drawn[:SAMPLE], drawn[SAMPLE:]) if apart else (drawn, drawn)
    depth = max(0, round(np.log2(max(1, len(sample) / LEAF_ROWS))))
    grown = grow(sample, longest, depth)
    needed = effort(grown, probes, max(1, round(k * len(probes) / n)), recall)
    forest = spark.sparkContext.broadcast(grown)
    index = materialize(base.mapInArrow(leaf_batches(forest, dim), f"key long, vec_id long, vec {kind}, copies long, leaves array<int>"), "vector-leaves")
    sizes = np.zeros((TREES, 2**depth), np.int64)
    for t, leaf, many in index.select(F.posexplode("leaves").alias("t", "leaf")).groupBy("t", "leaf").count().collect():  # at most trees times leaves rows
        sizes[t, leaf] = many
    first, parts = tiles(sizes)
    floor = sample[:FLOOR]
    layout = spark.sparkContext.broadcast((sizes, first, parts, floor, grown.leaves(floor) + np.arange(TREES) * 2**depth))
    wanted = max(needed * n, float(TREES * (k + 1)))
    queries = index.filter(F.col("vec_id") % every == 0).select("key", "vec_id", "vec")
    asks = queries.mapInArrow(ask_batches(forest, layout, dim, wanted, k), f"tile long, key long, vec_id long, vec {kind}, bar double, leaves array<int>")
    blocks = -(-n // (every * QUERY_BLOCK))
    place = spark.createDataFrame([(t, leaf, int(first[t, leaf]), int(parts[t, leaf])) for t in range(TREES) for leaf in range(2**depth)], "t int, leaf int, first long, parts long")
    filed = index.select("key", "vec_id", "vec", "copies", F.posexplode("leaves").alias("t", "leaf")).join(F.broadcast(place), ["t", "leaf"])  # trees times leaves rows
    tile = F.col("first") + F.pmod(F.xxhash64(F.lit(3), "key"), F.col("parts"))
    none = T.ArrayType(T.IntegerType())
    lhs = filed.select(tile.alias("tile"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(False).alias("asks"), "key", "vec_id", "vec", "copies", (F.col("t") * 2**depth + F.col("leaf")).alias("leaf"), F.lit(None).cast("double").alias("bar"), F.lit(None).cast(none).alias("leaves"))
    rhs = asks.select("tile", F.pmod(F.xxhash64(F.lit(4), "key"), F.lit(blocks)).cast("int").alias("block"), F.lit(True).alias("asks"), "key", "vec_id", "vec", F.lit(None).cast("long").alias("copies"), F.lit(None).cast("int").alias("leaf"), "bar", "leaves")
    dealt = lhs.unionByName(rhs).repartition("tile", "block").sortWithinPartitions("tile", "block", "asks")
    found = dealt.mapInArrow(rerank_batches(dim, k), "query_key long, query_id long, key long, vec_id long, copies long, score double")
    order = [F.desc("score"), F.col("vec_id"), F.col("key")]
    # what several trees found ties with itself
    best = found.withColumn("r", F.dense_rank().over(Window.partitionBy("query_key").orderBy(*order))).filter(F.col("r") <= k)
    best = best.groupBy("query_key", "key").agg(*[F.first(c).alias(c) for c in ("query_id", "vec_id", "copies", "score")])
    each = best.withColumn("i", F.explode(F.sequence(F.lit(1), F.least("copies", F.lit(k)))))
    ranked = each.withColumn("rank", F.row_number().over(Window.partitionBy("query_key").orderBy(*order)))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "query_key")
