import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tarnlake.llm.substring import dedup


def brute(rows, length):
    seen, out = set(), {}
    for key, text in sorted({(d if d is not None else 1 << 63, t or "") for d, t, *_ in rows}):
        b = text.encode()
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            w = b[i : i + length]
            if w in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(w)
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        spans = sum(h and not (i and hit[i - 1]) for i, h in enumerate(hit))
        out[key] = (len(b), sum(hit), spans, hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize("length", [5, 20, 100])
def test_against_brute_force(spark, length):
    rng = random.Random(length)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    rows = []
    for i in range(150):
        t = " ".join(rng.choice(words) for _ in range(rng.randint(0, 80)))
        if i % 3 == 0:
            t = t[: len(t) // 2] + rng.choice(shared) + t[len(t) // 2 :]
        if i % 7 == 0 and rows:
            t = rows[rng.randrange(len(rows))][1] or ""
        if i % 11 == 0 and rows:
            t = (rows[rng.randrange(len(rows))][1] or "") + "zz" + t
        rows.append((i * 3 % 151, t, "x"))
    rows += [(900, None, "y"), (901, "a" * 700, "y"), (902, "ab" * 300, None), (None, shared[0], "n"), (903, "", "z")]
    rows += [rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(5)
    got = dedup(df, length, with_text=True).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text").collect()
    want = brute(rows, length)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == want[r.doc_id if r.doc_id is not None else 1 << 63], r
    assert sum(r.n_removed for r in got) > 100


def test_long_text_spans_pieces(spark):
    rng = random.Random(1)
    head = "".join(rng.choice("abcdefgh ") for _ in range(1_048_576 - 50))
    text = head + "".join(rng.choice("abcdefgh ") for _ in range(3000))
    rows = [(1, text), (2, text[1_048_400:1_048_800]), (3, "q" + text[-200:])]
    got = {r.doc_id: r for r in dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("row.doc_id", "n_removed", "n_spans").collect()}
    assert [got[i].n_removed for i in (1, 2, 3)] == [0, 400, 200]


def test_empty(spark):
    assert dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_many_null_and_repeated_ids(spark):
    """4,000 texts without an id, and ids with several texts: each text counts, in the order of their hashes."""
    rng = random.Random(8)
    shared = ["".join(rng.choice("abcdefghij ") for _ in range(150)) for _ in range(6)]

    def text():
        t = "".join(rng.choice("abcdefghij ") for _ in range(rng.randint(90, 260)))
        return t[:40] + rng.choice(shared) + t[40:] if rng.random() < 0.2 else t

    rows = [(None, text()) for _ in range(4000)] + [(i % 40, text()) for i in range(300)]
    rows += rows[:50] + rows[-5:] + [(None, None), (None, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    hashes = {r.t: r.h for r in df.select(F.coalesce("text", F.lit("")).alias("t")).distinct().select("t", F.xxhash64("t").alias("h")).collect()}
    want = {}  # by id and what is left of which size, as texts of one id can't be told apart in the result
    seen = set()
    for key, _, t in sorted({(d if d is not None else 1 << 63, hashes[t or ""], t or "") for d, t in rows}):
        b, hit = t.encode(), bytearray(len(t.encode()))
        for i in range(len(b) - 99):
            if b[i : i + 100] in seen:
                hit[i : i + 100] = b"\1" * 100
            seen.add(b[i : i + 100])
        want[(key, t)] = (key, len(b), sum(hit), hashlib.sha256(bytes(x for x, h in zip(b, hit, strict=True) if not h)).hexdigest())
    got = dedup(df).select("row.doc_id", "n_bytes", "n_removed", "kept_sha256").collect()
    assert sorted((r.doc_id if r.doc_id is not None else 1 << 63, r.n_bytes, r.n_removed, r.kept_sha256) for r in got) == sorted(want[(d if d is not None else 1 << 63, t or "")] for d, t in rows)
    assert sum(r.n_removed > 0 for r in got) > 500
