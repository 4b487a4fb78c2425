import numpy as np
import pytest

from tarnlake.llm import vector_search

SCHEMA = "vec_id long, embedding array<float>, rank int"


def brute(ids, v, every, k):
    out = {}
    for i, q in zip(ids, v, strict=True):
        if i % every == 0:
            s = (v * q).sum(axis=1)
            out[i] = [(ids[j], s[j]) for j in sorted((j for j in range(len(ids)) if ids[j] != i), key=lambda j: (-s[j], ids[j]))[:k]]
    return out


def test_exact_when_all_leaves_are_reached(spark):
    rng = np.random.default_rng(1)
    v = np.float32(rng.normal(size=(400, 8)) * rng.uniform(0.2, 4, size=(400, 1)))
    v[100:160] = v[100]
    rows = [(i, [float(x) for x in v[i]], 1) for i in range(400)]
    odd = [(400, None, 1), (420, [], 1), (440, [0.0] * 8, 1), (460, [float("nan")] * 8, 1), (480, [None] + rows[0][1][1:], 1), (500, [1.0, 2.0], 1), (None, rows[0][1], 1)]
    got = vector_search.search(spark.createDataFrame(rows + odd, SCHEMA).repartition(3), every=20, k=20, recall=1.0).collect()
    want = brute(list(range(400)), v.astype(float), 20, 20)
    assert len(got) == 20 * 20
    # exact scores in order; nearly all that there are
    assert np.mean([(r.vec_id, r.score) == want[r.query_id][r.rank - 1] for r in got]) > 0.97
    for r in got:
        assert r.score == (v[r.vec_id].astype(float) * v[r.query_id].astype(float)).sum()


def clustered(rng):
    return np.concatenate([rng.normal(size=(3000, 32)), np.repeat(rng.normal(size=(100, 32)) * 2, 10, axis=0) + rng.normal(size=(1000, 32)) * 0.3])


def tight(rng):
    return np.repeat(rng.normal(size=(80, 32)), 50, axis=0) + rng.normal(size=(4000, 32)) * 0.05


@pytest.mark.parametrize(("make", "most"), [(clustered, 0.75), (tight, 0.25)])
def test_recall_over_all_queries(spark, monkeypatch, make, most):
    """Recall over every query, with tiles that leaves are dealt over, and how few candidates are scored for it."""
    monkeypatch.setattr(vector_search, "SAMPLE", 2000)
    monkeypatch.setattr(vector_search, "HELD", 1000)
    monkeypatch.setattr(vector_search, "TILE", 60)
    scored = []
    rng = np.random.default_rng(2)
    v = make(rng).astype(np.float32)
    df = spark.createDataFrame([(i, x.tolist(), 0) for i, x in enumerate(v)], SCHEMA)
    got = {}
    for r in vector_search.search(df, every=20).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    want = brute(list(range(4000)), v.astype(float), 20, 20)
    assert set(got) == set(want) and all(len(g) == 20 for g in got.values())
    assert np.mean([len(got[i] & {j for j, _ in w}) / 20 for i, w in want.items()]) >= 0.93
    # the candidates: vectors in leaves that the queue opens
    drawn = v[rng.permutation(4000)[:3000]].astype(float)
    forest = vector_search.grow(drawn[:2000], float(np.linalg.norm(v, axis=1).max()), round(np.log2(100)))
    leaves = forest.leaves(v.astype(float)) + np.arange(vector_search.TREES) * (forest.inner + 1)
    sizes = np.bincount(leaves.ravel(), minlength=vector_search.TREES * (forest.inner + 1))
    wanted = vector_search.effort(forest, drawn[2000:], 5, vector_search.RECALL) * 4000
    order, before = forest.queue(v[::200].astype(float), sizes)
    for o, b in zip(order, before, strict=True):
        scored.append(np.isin(leaves, o[b < wanted]).any(axis=1).mean())
    assert np.mean(scored) < most


def test_repeated_rows_and_shared_ids(spark):
    rows = [(0, [1.0, 0.0], 1), (0, [1.0, 0.0], 1), (0, [0.0, 1.0], 1), (3, [0.5, 0.5], 1), (3, [0.5, 0.5], 2), (5, [0.25, 0.0], 1)]
    got = vector_search.search(spark.createDataFrame(rows, SCHEMA), k=20).collect()
    by_query = {}
    for r in got:
        by_query.setdefault(r.query_key, []).append((r["rank"], r.vec_id, r.score))
    assert {r.query_id for r in got} == {0}
    assert sorted(sorted(x) for x in by_query.values()) == [
        [(1, 0, 1.0), (2, 3, 0.5), (3, 3, 0.5), (4, 5, 0.25), (5, 0, 0.0)],
        [(1, 3, 0.5), (2, 3, 0.5), (3, 0, 0.0), (4, 0, 0.0), (5, 5, 0.0)],
    ]
    assert [len(x) for x in ([r for r in vector_search.search(spark.createDataFrame(rows, SCHEMA), k=2).collect()],)] == [4]


def test_few_and_none(spark):
    assert vector_search.search(spark.createDataFrame([], SCHEMA)).count() == 0
    got = vector_search.search(spark.createDataFrame([(0, [1.0, 0.0], 1), (3, [0.5, 0.5], 1), (2, [0.5, -0.5], 1)], SCHEMA)).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 2, 0.5), (0, 2, 3, 0.5)]


def test_tiles():
    first, parts = vector_search.tiles(np.array([[3000, 3000, 3000, 20_000, 10], [8192, 0, 1, 0, 0]]))
    assert parts.tolist() == [[1, 1, 1, 3, 1], [1, 1, 1, 1, 1]] and first.tolist() == [[0, 0, 1, 2, 5], [6, 6, 7, 7, 7]]
