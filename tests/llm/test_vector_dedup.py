import numpy as np
import pytest

from tarnlake.llm import vector_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, node string"


def brute(rows, least=0.93):
    ok = [r[1] is not None and len(r[1]) > 0 and r[2] is not None and all(x is not None and np.isfinite(x) for x in r[1]) and any(x != 0 for x in r[1]) for r in rows]
    v = [np.array(r[1], np.float32).astype(float) if k else None for r, k in zip(rows, ok, strict=True)]
    near = [[j for j in range(len(rows)) if i != j and ok[i] and ok[j] and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]) and v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= least] for i in range(len(rows))]
    label = list(range(len(rows)))
    while True:
        new = [min([label[i], *(label[j] for j in near[i])]) for i in range(len(rows))]
        if new == label:
            break
        label = new
    ids = {}
    for i, l in enumerate(label):
        if rows[i][0] is not None:
            ids[l] = min(ids.get(l, 1 << 60), rows[i][0])
    return sorted(((rows[i][0], len(near[i]), ids.get(label[i]), rows[i][0] == ids.get(label[i])) for i in range(len(rows))), key=repr)


@pytest.mark.parametrize("tile", [2048, 7])
def test_against_brute_force(spark, tile, monkeypatch):
    monkeypatch.setattr(vector_dedup, "TILE", tile)
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        c = rng.normal(size=16)
        for k in range(rng.integers(1, 9)):
            rows.append((len(rows) * 7 % 1009, [float(x) for x in np.float32((c + rng.normal(size=16) * 0.25) * rng.uniform(0.5, 3))], i % 3, "n"))
    same = rows[0][1]
    rows += [(2000 + i, same, rows[0][2], None) for i in range(20)]
    rows += [(3000, None, 1, ""), (3001, [], 1, ""), (3002, [0.0] * 16, 1, ""), (3003, [float("nan")] * 16, 1, ""), (3004, [None] + same[1:], 1, ""), (3005, same, None, ""), (3006, same[:5], rows[0][2], ""), (3007, [float("inf")] + same[1:], 1, ""), (3008, [3.0], 1, ""), (3009, [5.0], 1, ""), (3010, [-5.0], 1, "")]
    rows += [rows[5], rows[5], (None, same, rows[0][2], "")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vector_dedup.dedup(df).collect()), key=repr)
    assert got == brute(rows)


def test_empty(spark):
    assert vector_dedup.dedup(spark.createDataFrame([], SCHEMA)).count() == 0
