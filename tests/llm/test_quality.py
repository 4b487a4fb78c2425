import random
import zlib

import numpy as np

from tarnlake.llm import quality


def test_forest_fits_and_bounds():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.grow(x[:2000], y[:2000], trees=40)
    s = forest.score(x[2000:])
    assert ((s >= 0.5) == y[2000:]).mean() > 0.97 and s.min() >= 0 and s.max() <= 1
    tied = quality.grow(np.zeros((10, 4)), np.ones(10))
    assert tied.score(np.zeros((1, 4)))[0] > 0.9
    assert quality.grow(np.zeros((0, 4)), np.zeros(0)).score(np.zeros((2, 4))).tolist() == [0.5, 0.5]


def slow_grow(x, y, trees, depth, bins, rate, ridge, least):
    """Every split by trying every cut of every feature on the raw values, node by node."""
    mean = min(max(y.mean(), 1e-3), 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    cuts = [sorted({float(q) for q in np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])}) for c in x.T]
    total, forest = np.full(len(x), bias), []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        g, h = y - p, p * (1 - p)

        def node(rows, left):
            best = (1e-6, None)
            if left:
                for f in range(x.shape[1]):
                    for c in cuts[f]:
                        low = [i for i in rows if x[i, f] <= c]
                        high = [i for i in rows if x[i, f] > c]
                        if h[low].sum() < least or h[high].sum() < least:
                            continue
                        gain = sum(g[k].sum() ** 2 / (h[k].sum() + ridge) for k in (low, high)) - g[rows].sum() ** 2 / (h[rows].sum() + ridge)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, c, low, high))
            if best[1] is None:
                return rate * g[rows].sum() / (h[rows].sum() + ridge)
            f, c, low, high = best[1]
            return f, c, node(low, left - 1), node(high, left - 1)

        def walk(tree, row):
            while isinstance(tree, tuple):
                tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
            return tree

        tree = node(list(range(len(x))), depth)
        forest.append(tree)
        total += np.array([walk(tree, r) for r in x])
    return lambda new: 1 / (1 + np.exp(-(bias + np.array([sum(walk(t, r) for t in forest) for r in new]))))


def test_against_a_slow_tree_builder():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(220, 3)).round(1)  # ties within bins
    y = ((x[:, 0] + x[:, 1] * x[:, 2] + rng.normal(size=220) * 0.3) > 0).astype(float)
    settings = {"trees": 6, "depth": 3, "bins": 12, "rate": 0.3, "ridge": 1.0, "least": 3.0}
    new = rng.normal(size=(200, 3))
    assert np.allclose(quality.grow(x, y, **settings).score(new), slow_grow(x, y, **settings)(new), atol=1e-9)


def test_held_out_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice(["the", "cat", "of", "house", "and", "green", "that"]) for _ in range(rng.randint(5, 60))]
        bad = i % 3 == 0
        rows.append((i, " ".join(w.upper() + "!!" if bad else w for w in words), "x"))
        labels.append((i, int(not bad), "e"))
    rows += [(1000, None, "x"), (1001, "", "x"), (None, "a" * 200_000, None), rows[4], rows[4], (1002, " \n ", "")]
    labels += [(4, None, "e"), (None, 1, "e"), (7, 1, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = quality.classify(docs, lab).select("row.doc_id", "score", "predicted", "held_out").collect()
    assert len(got) == len(rows)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in got if r.held_out and r.doc_id < 900]
    assert sum(r.predicted == int(r.doc_id % 3 != 0) for r in held) > 0.98 * len(held)
    assert quality.classify(docs.limit(0), lab).count() == 0
    assert {r.score for r in quality.classify(docs, lab.limit(0)).collect()} == {0.5}
