"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors of cosine c lie at squared distance 2 - 2c. A random rotation spreads that distance over all coordinates; cut into
blocks, at least one block must keep within its proportional part of it. So each block is range-joined by itself: vectors go into strips twice as
wide as the block's radius, and what lies within a radius of a border is compared with what does beyond it, label by label. Every candidate is verified by its
exact cosine, and belongs to the first block that admits it, so that no pair counts twice and none is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnlake.llm.common import drop_path, materialize, stored
from tarnlake.llm.graph import components
from tarnlake.llm.vectors import matrix, row_dots, usable

BLOCKS, TILE = 4, 4096
#: Keys over which the entries of one strip are dealt when they are given their tiles.
SALTS = 16
ENTRY = "node long, size long, label string, dim int, block int, cell long, low boolean, high boolean, vec array<float>"


@cache
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def rotated(v: np.ndarray) -> np.ndarray:
    """Unit vectors in rotated coordinates, summed coordinate by coordinate so that a row comes out alike in any company."""
    u, by = v / np.sqrt(row_dots(v, v))[:, None], rotation(v.shape[1])
    out = np.zeros_like(u)
    for d in range(v.shape[1]):
        out += u[:, d : d + 1] * by[d]
    return out


def blocks(dim: int, least: float) -> list[tuple[slice, float]]:
    """Coordinates of each block, and the squared distance that it may use up."""
    edges = np.linspace(0, dim, min(BLOCKS, dim) + 1).round().astype(int)
    return [(slice(a, b), max(0.0, 2 - 2 * least) * (b - a) / dim * (1 + 1e-9) + 1e-12) for a, b in zip(edges, edges[1:], strict=False)]


def strip_batches(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(3).to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = rotated(matrix(part.column(4), dim))
                for k, (where, budget) in enumerate(blocks(dim, least)):
                    # in radii, with some room for rounding; a strip is two of them wide
                    at, room = x[:, where.start] / np.sqrt(budget), 1 + 1e-9
                    cell = np.floor(at / 2)
                    low, high = at - 2 * cell <= room, 2 * cell + 2 - at <= room
                    yield pa.RecordBatch.from_arrays([*part.columns[:4], pa.array(np.full(len(x), k, np.int32)), pa.array(cell.astype(np.int64)), pa.array(low), pa.array(high), part.column(4)], names=["node", "size", "label", "dim", "block", "cell", "low", "high", "vec"])

    return run


def linked_pairs(v: np.ndarray, w: np.ndarray, block: int, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (of v, of w) with cosine >= least for which `block` is the first block within its budget."""
    x, y = rotated(v), rotated(w)
    parts = blocks(v.shape[1], least)
    where, budget = parts[block]
    xb, yb = x[:, where], y[:, where]
    nv, nw = np.sqrt(row_dots(v, v)), np.sqrt(row_dots(w, w))
    # half the squared distance as one product, in single precision with room for its rounding; what passes is compared exactly
    ones = lambda z: np.ones((len(z), 1))
    half = lambda z: -row_dots(z, z)[:, None] / 2
    left, right = (np.concatenate(c, axis=1).astype(np.float32) for c in ((xb, half(xb), ones(xb)), (yb, ones(yb), half(yb))))
    for at in range(0, len(x), 256):
        i, j = np.nonzero(left[at : at + 256] @ right.T >= np.float32(-budget / 2 - 1e-5))
        for lo in range(0, len(i), 20_000):
            a, b = i[lo : lo + 20_000] + at, j[lo : lo + 20_000]
            ok = row_dots(v[a], w[b]) / (nv[a] * nw[b]) >= least
            a, b = a[ok], b[ok]
            d = (x[a] - y[b]) ** 2
            ok = d[:, where].sum(axis=1) <= budget
            for before, less in parts[:block]:
                ok &= d[:, before].sum(axis=1) > less
            yield a[ok], b[ok]


def compare(nodes: np.ndarray, sizes: np.ndarray, guest: np.ndarray, tile: np.ndarray, v: np.ndarray, block: int, same: bool, least: float, first: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links inside a group: how many documents each member is linked to, and the least node that it is tied to."""
    left = np.flatnonzero(guest if not same else tile == first)
    right = np.flatnonzero(~guest if not same else (tile != first)) if not same or (tile != first).any() else left
    links, root = np.zeros(len(nodes), np.int64), nodes.copy()
    found = []
    for a, b in linked_pairs(v[left], v[right], block, least):
        a, b = left[a], right[b]
        if right is left:
            a, b = a[a < b], b[a < b]
        np.add.at(links, a, sizes[b])
        np.add.at(links, b, sizes[a])
        found.append((a, b))
    a, b = (np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.int64) for k in (0, 1))
    while len(a):
        least_root = np.minimum(root[a], root[b])
        if (root[a] == least_root).all() and (root[b] == least_root).all():
            break
        np.minimum.at(root, a, least_root)
        np.minimum.at(root, b, least_root)
    some = links > 0
    return nodes[some], links[some], root[some]


def compare_batches(least: float):
    """Rows come sorted by group; a group is one tile, two tiles of a strip, or tiles of neighbouring strips."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def done() -> pa.RecordBatch:
            part = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            c = dict(zip(part.schema.names, part.columns, strict=True))
            found = compare(c["node"].to_numpy(), c["size"].to_numpy(), c["guest"].to_numpy(zero_copy_only=False), c["tile"].to_numpy(), matrix(c["vec"], key[1]), key[2], key[4] == 0, least, key[5])
            return pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["node", "links", "root"])

        for batch in batches:
            keys = list(zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True))
            starts = [i for i in range(len(keys)) if i == 0 or keys[i] != keys[i - 1]]
            for i, end in zip(starts, [*starts[1:], len(keys)], strict=True):
                if keys[i] != key:
                    if held:
                        yield done()
                    key, held = keys[i], []
                held.append(batch.slice(i, end - i))
        if held:
            yield done()

    return run


def dedup(vectors: DataFrame, vector: str = "embedding", least: float = 0.93, label: str = "label") -> DataFrame:
    """Link vectors of equal, non-null label whose cosine is at least `least`.

    vectors: vec_id (long), the vector (array of float), the label, and any others. Returns a row per input row: vec_id, n_links (other rows
    linked directly), component_id (smallest vec_id that links lead to, its own included), kept (vec_id is component_id).

    Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do those with null
    labels or of different lengths. Equal vectors are compared once and counted as often as they occur, repeated rows too. Null ids are linked like
    others but don't name a component unless it has no other id.
    """
    v, lab = F.col(vector).cast("array<float>"), F.col(label).cast("string")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vec"), lab.alias("label"))
    node = F.when(usable(F.col("vec")) & F.col("label").isNotNull(), F.xxhash64("label", "vec"))
    rows = rows.withColumn("node", node)
    classes = rows.filter("node is not null").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("size"), F.first("label").alias("label"), F.first("vec").alias("vec"))
    classes = materialize(classes, "vector-classes")
    entries = classes.select("node", "size", "label", F.size("vec").alias("dim"), "vec").mapInArrow(strip_batches(least), ENTRY)
    entries, entries_at = stored(entries, "vector-strips")
    place = ["label", "dim", "block"]
    strips = entries.groupBy(*place, "cell").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    before = strips.select(*place, (F.col("cell") + 1).alias("cell"), F.col("tiles").alias("before"))
    after = strips.select(*place, (F.col("cell") - 1).alias("cell"), F.col("tiles").alias("after"))
    strips = strips.join(before, [*place, "cell"], "left").join(after, [*place, "cell"], "left").fillna(0, ["before", "after"])
    salted = strips.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    tiled = entries.withColumn("salt", F.pmod(F.xxhash64(F.lit(5), "node"), F.lit(SALTS)).cast("int")).join(salted.hint("merge"), [*place, "cell", "salt"]).withColumn("tile", F.pmod(F.xxhash64("node", "block"), F.col("tiles")).cast("int"))
    upto = lambda n: F.transform(F.sequence(F.lit(0), F.greatest(F.col(n), F.lit(1)) - 1), lambda i: i)
    own = F.transform(upto("tiles"), lambda i: F.struct(F.col("cell").alias("cell"), F.lit(0).alias("kind"), F.least(i, "tile").alias("i"), F.greatest(i, "tile").alias("j"), F.lit(False).alias("guest")))
    host = F.transform(upto("before"), lambda i: F.struct(F.col("cell").alias("cell"), F.lit(1).alias("kind"), i.alias("i"), F.col("tile").alias("j"), F.lit(False).alias("guest")))
    guest = F.transform(upto("after"), lambda i: F.struct((F.col("cell") + 1).alias("cell"), F.lit(1).alias("kind"), F.col("tile").alias("i"), i.alias("j"), F.lit(True).alias("guest")))
    none = F.slice(host, 1, 0)
    groups = F.concat(own, F.when((F.col("before") > 0) & F.col("low"), host).otherwise(none), F.when((F.col("after") > 0) & F.col("high"), guest).otherwise(none))
    key = [*place, "cell", "kind", "i", "j"]
    dealt = tiled.select("node", "size", "vec", "tile", *place, F.explode(groups).alias("g")).select(*place, "g.cell", "g.kind", "g.i", "g.j", "g.guest", "node", "size", "tile", "vec")
    dealt = dealt.repartition(*key).sortWithinPartitions(*key)
    links = materialize(dealt.mapInArrow(compare_batches(least), "node long, links long, root long"), "vector-links")
    drop_path(vectors.sparkSession, entries_at)
    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    placed = classes.select("node", "least", "size").join(roots, "node", "left").join(links.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("least").alias("head"))
    placed = placed.join(heads, "root").select("node", "head", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "node").join(placed, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("head"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
