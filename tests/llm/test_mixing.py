import re

from tarnlake.llm.mixing import mix

SCHEMA = "doc_id long, text string, source string, size int, note string"


def water_fill(sizes, weights, most):
    target, free, left = {}, dict(weights), float(sum(sizes.values()))
    while free:
        level = left / sum(free.values())
        full = [s for s in free if level * free[s] > most * sizes[s]]
        if not full:
            target |= {s: level * w for s, w in free.items()}
            break
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
            del free[s]
    return target


def test_targets_and_takes(spark):
    rows = []
    for i in range(3000):
        s = None if i % 17 == 0 else "big" if i % 3 else f"s{i % 5}"
        rows.append((i, None if i % 50 == 0 else " ".join(["wörd"] * (i % 40)) + " x\t\v y", s, 1, "z"))
    rows += [(5000 + i, "a b", "tiny", 1, None) for i in range(3)]
    got = mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    size = {r[0]: len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in rows}
    source = {r[0]: r[2] for r in rows}
    totals = {}
    for i, s in source.items():
        totals[s] = totals.get(s, 0) + size[i]
    order = sorted((s for s in totals if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    want = water_fill(totals, {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, 3)
    taken = {}
    for r in got:
        s = source[r.doc_id]
        assert r["size"] == size[r.doc_id] and r.source_size == totals[s]
        assert abs(r.target - want[s]) < 1e-6 * max(1, want[s])
        assert 0 <= r.taken <= 3 * r["size"]
        taken[s] = taken.get(s, 0) + r.taken
    for s in totals:
        assert abs(taken[s] - want[s]) <= 45
    again = mix(spark.createDataFrame(rows[::-1], SCHEMA)).collect()
    assert sorted((r.doc_id, r.taken) for r in got) == sorted((r.doc_id, r.taken) for r in again)


def test_repeated_rows_and_long_texts(spark):
    """A source of 1,000 equal rows, one with a third of all rows, and texts of very unlike sizes come near their targets."""
    rows = [(1, "a b c d", "a", 0, "")] * 1000 + [(i % 3, "x " * 5, "b", 0, "") for i in range(900)] + [(i, "w " * (200_000 if i == 7 else 40), "c", 0, "") for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = mix(df).collect()
    assert len(got) == len(rows)
    for size, most in ((4, 4), (5, 5)):
        own = [r for r in got if r["size"] == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= most / 2 + 1e-6
        assert all(0 <= r.taken <= 3 * r["size"] for r in own)
    again = mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(3)).collect()
    assert sorted((r.doc_id, r["size"], r.taken) for r in got) == sorted((r.doc_id, r["size"], r.taken) for r in again)
    from tarnlake.llm.mixing import mixed

    assert mixed(df).filter("source = 'a'").count() * 4 == sum(r.taken for r in got if r["size"] == 4)


def test_empty_and_wordless(spark):
    assert mix(spark.createDataFrame([], SCHEMA)).count() == 0
    got = mix(spark.createDataFrame([(1, "", "a", 0, ""), (None, None, None, 0, "")], SCHEMA)).collect()
    assert [(r["size"], r.target, r.taken) for r in got] == [(0, 0.0, 0)] * 2


def test_mixed_rows(spark):
    from tarnlake.llm.mixing import mixed

    docs = spark.createDataFrame([(i, "a b c", "x" if i % 4 else None, 1, "n") for i in range(200)] + [(900, None, "x", 1, "n")], SCHEMA)
    taken = {r.doc_id: r.taken // 3 for r in mix(docs).collect() if r.doc_id < 900}
    rows = mixed(docs).collect()
    assert rows[0].__fields__ == docs.columns
    seen = {}
    for r in rows:
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    assert seen.pop(900) == 1
    assert seen == {k: v for k, v in taken.items() if v}
