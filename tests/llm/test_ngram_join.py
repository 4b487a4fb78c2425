import random

import numpy as np
import pyarrow as pa
import pytest

from tarnlake.llm import ngram_join


def sets_of(text, size):
    w = (text or "").lower().split()
    return {tuple(w[i : i + size]) for i in range(max(1, len(w) - size + 1))} if w else set()


def brute(rows, size=5, threshold=0.8):
    sets = [sets_of(r[1], size) for r in rows]
    near = [[j for j in range(len(rows)) if j != i and sets[i] and len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j])] for i in range(len(rows))]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            m = min([label[i], *(label[j] for j in near[i])])
            changed |= m != label[i]
            label[i] = m
    least = {}
    for i, l in enumerate(label):
        if rows[i][0] is not None:
            least[l] = min(least.get(l, 1 << 60), rows[i][0])
    return sorted(((rows[i][0], least.get(label[i]), len(near[i])) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("tile", [512, 5])
def test_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(ngram_join, "TILE", tile)
    monkeypatch.setattr(ngram_join, "FEW", 8)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randint(6, 150))] for _ in range(60)]
    rows = [(i, " ".join(b), "c") for i, b in enumerate(base)]
    for i in range(200):
        w = list(base[i % 7 if i % 2 else rng.randrange(60)])
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((1000 + i, " ".join(w).upper() if i % 9 == 0 else "  ".join(w), None))
    rows += [(2000, None, "a"), (2001, "", "b"), (2002, " \n", "b"), (2003, "one two", "b"), (2004, "ONE  two", "b"), (None, rows[0][1], "n"), rows[3], rows[3], (2005, "z " * 100_000, "l"), (2006, "z " * 9, "l")]
    df = spark.createDataFrame(rows, "doc_id long, text string, node string").repartition(4)
    got = ngram_join.join(df).collect()
    assert sorted(((r.doc_id, r.class_id, r.n_links) for r in got), key=repr) == brute(rows)
    kept = ngram_join.first_of_each(df).collect()
    assert sorted(r.doc_id for r in kept) == sorted({r.class_id for r in got})
    assert kept[0].__fields__ == df.columns


def test_no_links_and_empty(spark):
    schema = "doc_id long, text string"
    assert ngram_join.join(spark.createDataFrame([], schema)).count() == 0
    got = ngram_join.join(spark.createDataFrame([(1, "a b c d e f"), (2, "g h i j k l")], schema)).collect()
    assert sorted((r.doc_id, r.class_id, r.n_links, r.kept) for r in got) == [(1, 1, 0, True), (2, 2, 0, True)]


def test_prefixes_reach_the_recall():
    found = ngram_join.depths(0.8)
    assert found[-1] == ngram_join.prefix_length(0.8) == 7 and found[3] == 10 and found[6] == 9  # 5 of 6 is the least that a set of 6 can have
    for k, s in ((found[-1], 0.8), (found[6], 5 / 6)):
        assert 1 - (1 - s**k) ** ngram_join.TREES >= ngram_join.RECALL > 1 - (1 - s ** (k + 1)) ** ngram_join.TREES


def test_recall_of_the_forest():
    """Pairs just above the threshold, as the tries see them: none of 3,000 may be missing."""
    rng = np.random.default_rng(3)
    rows = []
    for i in range(3000):
        n = int(rng.integers(20, 300))
        both = int(np.ceil(0.8 * 2 * n / 1.8))
        x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.uint64)
        for k, s in enumerate((x[:n], x[n - both :])):
            for h, t in zip(*ngram_join.signature(ngram_join.min_hashes(s, ngram_join.TREES * ngram_join.DEPTH), 7), strict=True):
                rows.append((h, t, 2 * i + k, n))
    rows.sort()
    columns = [np.array(c, np.int64) for c in zip(*rows, strict=True)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["heads", "tails", "node", "n"])
    found = set()
    for out in ngram_join.walk_batches(0.8, 7)(iter([batch.slice(0, 50_000), batch.slice(50_000)])):
        found |= {(min(u, v), max(u, v)) for kind, u, v in zip(*(c.to_pylist() for c in out.columns), strict=True) if kind == 0}
    assert {(2 * i, 2 * i + 1) for i in range(3000)} - found == set() and len(found) < 3100


@pytest.mark.parametrize("held", [1 << 16, 40])
def test_roots_that_span_batches_and_tasks(monkeypatch, held):
    """A prefix shared by 500, cut over batches and over two tasks, stays one clump."""
    monkeypatch.setattr(ngram_join, "HELD", held)
    head = np.sort(np.concatenate([np.full(500, 7), np.arange(20, 60), np.repeat(np.arange(100, 130), 3)]))
    node = np.arange(len(head)) + 1000
    rows = [head, np.zeros(len(head), np.int64), node, np.full(len(head), 50)]
    edges, joints = [], {}
    for lo, hi in ((0, 200), (200, len(head))):
        batches = [pa.RecordBatch.from_arrays([pa.array(x[a : min(a + 70, hi)]) for x in rows], names=["heads", "tails", "node", "n"]) for a in range(lo, hi, 70)]
        for out in ngram_join.walk_batches(0.8, 7)(iter(batches)):
            for kind, u, v in zip(*(c.to_pylist() for c in out.columns), strict=True):
                if kind == 2:
                    joints.setdefault(u, []).append(v)
                else:
                    edges.append((u, v))
    edges += [(v, vs[0]) for vs in joints.values() for v in vs]
    root = {int(x): int(x) for x in node}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for u, v in edges:
        root[find(u)] = find(v)
    clump = {}
    for h, x in zip(head, node, strict=True):
        clump.setdefault(find(int(x)), set()).add(int(h))
    assert all(len(c) == 1 for c in clump.values()) and len(clump) == 1 + 40 + 30
