"""Self-join on the Jaccard similarity of word n-gram sets: a MinHash LSH forest finds candidates, exact sets verify them.

Documents with equal n-gram sets are one class, and only classes are joined. Each class has a signature of min-hashes per tree. A tree is the
sorted list of its signatures, which is a prefix trie laid out flat: classes that share a prefix are neighbours. The lists of all trees are
sorted at once, by ranges, so that no prefix, however common, is bound to one task. A pair matches by the prefix that
both have in common, and how long it must be is settled for each document: from the whole signature it is shortened until the
least similar partner that a set of its size can have is found with the target recall (`depths`).

Candidates whose sketches and sizes allow the threshold group into connected clumps, and every clump is
verified exactly, in tiles of bounded size, so that a clump of any size is spread over tasks and no pair is ever a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tarnlake.llm.common import drop_path, materialize, slices, stored
from tarnlake.llm.graph import components
from tarnlake.llm.substring import rollers

TREES, DEPTH = 48, 10
RECALL = 0.9999
#: Single bytes of min-hashes that estimate a similarity, and by how much (over five standard errors at 0.8) an estimate may fall short.
SKETCH, SLACK = 128, 0.2
#: Members up to which all pairs of a root are looked at; in larger ones each is tied to the first of about its size.
FEW = 32
#: Members of one root that are held at once.
HELD = 1 << 16
TILE = 512
LAST_ID = (1 << 63) - 1
FEATURES = "doc_id long, dkey long, th long, node long, n long, heads array<long>, tails array<long>, sketch binary"


def prefix_length(similarity: float, trees: int = TREES, depth: int = DEPTH, recall: float = RECALL) -> int:
    """The longest prefix, up to depth, with which a pair of that similarity agrees in some tree with probability `recall`."""
    while depth > 1 and 1 - (1 - similarity**depth) ** trees < recall:
        depth -= 1
    return depth


@cache
def depths(threshold: float, sizes: int = 256) -> np.ndarray:
    """How long a prefix finds the partners of a set of 0, 1, 2, ... members; beyond the last entry it is that of the threshold.

    A set of n members and one of m that share k have the similarity k / (n + m - k). The least of those that reach the
    threshold is what the prefix must find."""
    out = [DEPTH]
    for n in range(1, sizes):
        found = (k / (n + m - k) for m in range(1, int(n / threshold) + 2) for k in range(1, min(n, m) + 1) if k >= threshold * (n + m - k) - 1e-9)
        out.append(prefix_length(min(found, default=1.0)))
    return np.array([*out, prefix_length(threshold)])


def word_hashes(text: str) -> np.ndarray:
    """A 64-bit hash of each word of a text that has any, computed for all at once from prefix sums over its bytes."""
    data = np.frombuffer(" ".join(text.lower().split()).encode("utf-8", "surrogatepass"), np.uint8)
    roll = rollers()[0]
    prefix = roll.prefix(data)
    gaps = np.flatnonzero(data == 32)
    return roll.spans(prefix, np.concatenate([[0], gaps + 1]), np.append(gaps, len(data)))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@cache
def multipliers(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted hashes of the distinct runs of `size` lower-cased words; a shorter text is one run; none without words."""
    if not text or text.isspace():
        return np.zeros(0, np.uint64)
    h = word_hashes(text)
    k, by = min(size, len(h)), multipliers(size)
    total = np.full(len(h) - k + 1, k, np.uint64)
    for i in range(k):
        total += mixed(h[i : len(h) - k + 1 + i] ^ by[i]) * by[i]
    return np.unique(mixed(total))


def min_hashes(s: np.ndarray, n: int) -> np.ndarray:
    x, by = (s >> np.uint64(32)).astype(np.uint32), (multipliers(n) >> np.uint64(31)).astype(np.uint32) | np.uint32(1)
    out = np.full(n, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 256):
        np.minimum(out, (x[at : at + 256, None] * by).min(axis=0), out=out)
    return out.astype(np.uint64)


def signature(m: np.ndarray, root: int, need: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Per tree the first `root` min-hashes as one hash, and the others cut to equal shares of 63 bits, in order; 0 if a prefix of
    the root's length is all that is needed, as no others are compared then."""
    m = mixed(m.reshape(TREES, DEPTH) + np.uint64(1))
    heads = mixed((mixed(m[:, :root]) * multipliers(root)).sum(axis=1, dtype=np.uint64) + np.arange(TREES, dtype=np.uint64))
    tails, bits = np.zeros(TREES, np.uint64), np.uint64(63 // max(1, DEPTH - root))
    for k in range(root, DEPTH if need > root else root):
        tails = (tails << bits) | (m[:, k] & ((np.uint64(1) << bits) - np.uint64(1)))
    return heads.view(np.int64), tails.view(np.int64)


def feature_batches(size: int, threshold: float, root: int):
    need = depths(threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 3)):
            node, n, heads, tails, sketch = [], [], [], [], []
            for text in batch.column(3).to_pylist():
                s = shingles(text, size)
                n.append(len(s))
                if not len(s):
                    for out in (node, heads, tails, sketch):
                        out.append(None)
                    continue
                m = min_hashes(s, TREES * DEPTH)
                node.append(int(np.bitwise_xor.reduce(mixed(s * np.uint64(5))).view(np.int64)) ^ len(s))
                for out, x in zip((heads, tails), signature(m, root, int(need[min(len(s), len(need) - 1)])), strict=True):
                    out.append(x)
                sketch.append((mixed(m[:SKETCH]) & np.uint64(255)).astype(np.uint8).tobytes())
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(node, pa.int64()), pa.array(n, pa.int64()), pa.array(heads, longs), pa.array(tails, longs), pa.array(sketch, pa.binary())], names=["doc_id", "dkey", "th", "node", "n", "heads", "tails", "sketch"])

    return run


def trie_pairs(head: np.ndarray, tail: np.ndarray, node: np.ndarray, n: np.ndarray, threshold: float, root: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of neighbours under the roots of at most FEW members (which is all that head holds), whose common prefix is long enough for one of them."""
    need, own = depths(threshold), 0
    need = need[np.minimum(n, len(need) - 1)]
    bits = 63 // max(1, DEPTH - root)
    for k in range(1, min(FEW, len(head))):
        i = np.flatnonzero(head[k:] == head[:-k])
        if not len(i):
            return
        apart, own = tail[i] ^ tail[i + k], np.full(len(i), root)
        for d in range(1, DEPTH - root + 1):
            own += apart >> (bits * (DEPTH - root - d)) == 0
        near = (own >= np.minimum(need[i], need[i + k])) & (np.minimum(n[i], n[i + k]) >= threshold * np.maximum(n[i], n[i + k]) - 1e-6)
        yield node[i[near]], node[i[near] + k]


def walk_batches(threshold: float, root: int):
    """Rows come sorted by head and tail. Yields candidates (kind 0), ties that need no test (kind 1), and (kind 2) the head and
    first member of the roots that a task may hold only a part of."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        first, open_head, open_node = True, None, 0

        def out(kind: int, u: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(u), kind, np.int32)), pa.array(u), pa.array(v)], names=["kind", "u", "v"])

        def part(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            """A part of a root: its members are tied to the first that was seen."""
            nonlocal open_head, open_node
            if open_head != rows[0][0]:
                open_head, open_node = rows[0][0], rows[2][0]
                yield out(2, rows[0][:1], rows[2][:1])
            yield out(1, rows[2], np.full(len(rows[2]), open_node))

        def whole(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            head, tail, node, n = rows
            starts = np.flatnonzero(np.concatenate([[True], head[1:] != head[:-1]])) if len(head) else np.zeros(0, np.int64)
            many = np.repeat(np.diff(np.append(starts, len(head))), np.diff(np.append(starts, len(head))))
            few = (many > 1) & (many <= FEW)
            for u, v in trie_pairs(head[few], tail[few], node[few], n[few], threshold, root):
                yield out(0, u, v)
            head, node, n = (x[many > FEW] for x in (head, node, n))
            if len(head):  # by size: who is linked has only sizes in between that are near, too
                by = np.lexsort((node, n, head))
                head, node, n = head[by], node[by], n[by]
                new = np.concatenate([[True], (head[1:] != head[:-1]) | (n[:-1] < threshold * n[1:] - 1e-6)])
                yield out(1, node, node[np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))])

        for batch in batches:
            held = [np.concatenate([h, batch.column(i).to_numpy()]) for i, h in enumerate(held)]
            if not len(held[0]):
                continue
            last = int(np.searchsorted(held[0], held[0][-1]))
            if first and last:
                end = int(np.searchsorted(held[0], held[0][0], side="right"))
                yield from part([x[:end] for x in held])
                held, last, first = [x[end:] for x in held], last - end, False
            if open_head is not None and last and held[0][0] == open_head:
                end = int(np.searchsorted(held[0], held[0][0], side="right"))
                yield from part([x[:end] for x in held])
                held, last = [x[end:] for x in held], last - end
            yield from whole([x[:last] for x in held])
            held = [x[last:] for x in held]
            if len(held[0]) > HELD:
                yield from part(held)
                held, first = [x[:0] for x in held], False
        if len(held[0]):
            yield from part(held)

    return run


def similar_batches(least: float):
    """Drop candidates whose sketches are too far apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                a, b = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, SKETCH) for i in (2, 3))
                found = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["u", "v"]).filter(pa.array(found >= least))

    return run


def set_batches(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 0):
                sets = [shingles(t, size).tobytes() for t in part.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(sets, pa.binary())], names=["clump", "node", "size", "tile", "others", "hashes"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many hashes each two sets share."""
    m = len(sets)
    out = np.zeros((m, m), np.float32 if m else np.float64)
    if m <= 6:
        for i in range(m):
            for j in range(i + 1, m):
                out[i, j] = out[j, i] = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        return out
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    _, which, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.cumsum(times > 1) - 1
    keep = times[which] > 1
    owner, which = owner[keep], order[which[keep]]
    by = np.argsort(which, kind="stable")
    owner, which = owner[by], which[by]
    step = 4096
    for at in range(0, int(which[-1]) + 1 if len(which) else 0, step):
        lo, hi = np.searchsorted(which, (at, at + step))
        block = np.zeros((m, step), np.float32)
        block[owner[lo:hi], which[lo:hi] - at] = 1
        out += block @ block.T
    return out


def verify(nodes: np.ndarray, sizes: np.ndarray, tiles: np.ndarray, sets: list[np.ndarray], across: bool, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the members of one or two tiles: which have links, to how many documents, and the least member they are tied to."""
    n = np.array([len(s) for s in sets], np.int64)
    both = shared_counts(sets)
    linked = both >= threshold * (n[:, None] + n[None, :] - both) - 1e-6
    np.fill_diagonal(linked, False)
    if across:
        linked &= tiles[:, None] != tiles[None, :]
    root = np.arange(len(nodes))
    order = np.argsort(nodes)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    root = rank.copy()
    while True:  # least rank among neighbours until nothing changes
        near = np.where(linked, root[None, :], len(nodes)).min(axis=1, initial=len(nodes))
        new = np.minimum(root, near)
        new = np.minimum(new, new[order[new]])
        if (new == root).all():
            break
        root = new
    some = linked.any(axis=1)
    return nodes[some], (linked * sizes[None, :]).sum(axis=1)[some], nodes[order[root]][some]


def verify_batches(threshold: float):
    """Rows come sorted by clump and pair of tiles; a group ends where those change."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}

        def done() -> pa.RecordBatch:
            sizes, tiles, sets = zip(*rows.values(), strict=True)
            found = verify(np.array(list(rows), np.int64), np.array(sizes, np.int64), np.array(tiles), [np.frombuffer(s, np.uint64) for s in sets], key[1] != key[2], threshold)
            return pa.RecordBatch.from_arrays([pa.array(x.astype(np.int64)) for x in found], names=["node", "links", "root"])

        for batch in batches:
            for clump, a, b, node, size, tile, hashes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (clump, a, b) != key:
                    if rows:
                        yield done()
                    key, rows = (clump, a, b), {}
                rows[node] = (size, tile, hashes)
        if rows:
            yield done()

    return run


def join(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """Link documents whose sets of `size`-word runs (words lower-cased, parted by white space) have a Jaccard similarity
    of at least threshold.

    docs: doc_id (long), text and any others. Returns a row per input row: doc_id; class_id, the smallest doc_id that links lead to;
    n_links, the other rows linked directly; kept, true for the first row of each class (and its exact repeats); and
    the row's keys dkey and th. Texts of fewer than `size` words are one run of all of them. Null and wordless texts link with nothing and
    are their own class. Null ids come last and don't count for class_id unless the class has no other. Rows that repeat are linked as any others are.
    """
    text = F.col("text").cast("string")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("dkey"), F.xxhash64("text").alias("th"), text.alias("text"))
    root = prefix_length(threshold)
    features, features_at = stored(base.mapInArrow(feature_batches(size, threshold, root), FEATURES), "ngram-features")
    same = [F.first(c).alias(c) for c in ("n", "heads", "tails", "sketch")]
    full = features.filter("node is not null").groupBy("node").agg(F.min(F.struct("dkey", "th")).alias("first"), F.min("doc_id").alias("least"), F.count("*").alias("size"), *same)
    full, full_at = stored(full, "ngram-classes")
    rows, classes = materialize(features.select("doc_id", "dkey", "th", "node"), "ngram-rows"), materialize(full.select("node", "first", "least", "size"), "ngram-nodes")
    drop_path(docs.sparkSession, features_at)

    entries = full.select(F.explode(F.arrays_zip("heads", "tails")).alias("e"), "node", "n").select("e.heads", "e.tails", "node", "n")
    forest = entries.repartitionByRange("heads", "tails", "node").sortWithinPartitions("heads", "tails", "node")
    walked = materialize(forest.mapInArrow(walk_batches(threshold, root), "kind int, u long, v long").distinct(), "ngram-candidates")
    parted = walked.filter("kind = 2")
    joints = parted.join(parted.groupBy("u").agg(F.min("v").alias("m")), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    sketches = full.select("node", "sketch")
    near = walked.filter("kind = 0").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    near = near.join(sketches.select(F.col("node").alias("u"), F.col("sketch").alias("a")), "u").join(sketches.select(F.col("node").alias("v"), F.col("sketch").alias("b")), "v")
    near = near.select("u", "v", "a", "b").mapInArrow(similar_batches(threshold - SLACK), "u long, v long")
    clumps = components(near.union(walked.filter("kind = 1").select("u", "v")).union(joints))
    drop_path(docs.sparkSession, full_at)

    found = clumps.select("node", F.col("root").alias("clump")).join(classes.select("node", "first", "size"), "node")
    # a large clump is dealt over tiles by hash, so that no task takes it whole
    tiles = clumps.groupBy(F.col("root").alias("clump")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    members = found.join(tiles, "clump").withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int"))
    members = members.select("clump", "node", "size", "tile", F.sequence(F.lit(0), F.col("tiles") - 1).alias("others"), F.col("first.dkey").alias("dkey"), F.col("first.th").alias("th"))
    texts = base.select("dkey", "th", "text").join(members.hint("shuffle_hash"), ["dkey", "th"])
    sets = texts.select("text", "clump", "node", "size", "tile", "others").mapInArrow(set_batches(size), "clump long, node long, size long, tile int, others array<int>, hashes binary")
    tiled = sets.select("*", F.explode("others").alias("other")).select("clump", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"), "node", "size", "tile", "hashes")
    tiled = tiled.repartition("clump", "a", "b").sortWithinPartitions("clump", "a", "b")
    links = materialize(tiled.mapInArrow(verify_batches(threshold), "node long, links long, root long"), "ngram-links")

    roots = components(links.select(F.col("node").alias("u"), F.col("root").alias("v")))
    counted = links.groupBy("node").agg(F.sum("links").alias("links"))
    placed = classes.select("node", "first", "least", "size").join(roots, "node", "left").join(counted, "node", "left").withColumn("root", F.coalesce("root", "node"))
    heads = placed.groupBy("root").agg(F.min("first").alias("head"), F.min("least").alias("class_id"))
    placed = placed.join(heads, "root").select("node", "class_id", "head", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = rows.select("doc_id", "dkey", "th", "node").join(placed, "node", "left")
    kept = F.coalesce((F.col("head.dkey") == F.col("dkey")) & (F.col("head.th") == F.col("th")), F.lit(True))
    return out.select("doc_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), kept.alias("kept"), "dkey", "th")


def first_of_each(docs: DataFrame, size: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of docs, all columns, that stay when one document of each class does."""
    stay = join(docs, size, threshold).filter("kept").select("dkey", "th").distinct()
    packed = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("dkey"), F.xxhash64("text").alias("th"))
    once = Window.partitionBy("dkey", "th").orderBy(F.lit(0))
    kept = packed.join(stay.hint("shuffle_hash"), ["dkey", "th"]).withColumn("k", F.row_number().over(once))
    return kept.filter("k = 1").select("row.*")
