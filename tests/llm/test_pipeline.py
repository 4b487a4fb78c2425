import random

import pytest
import sentencepiece
from test_ngram_join import brute as near_classes

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def cut(docs, length=100):
    seen, out = set(), []
    for d in sorted(docs, key=lambda r: r["doc_id"]):
        b = d["text"].encode()
        hit = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                hit[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        kept = bytes(x for x, h in zip(b, hit, strict=True) if not h)
        if kept or not b:
            out.append(d | {"text": kept.decode("utf-8", "ignore")})
    return out


def test_stages(spark, tmp_path):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(300)]
    passage = " ".join(rng.choice(words) for _ in range(60))
    docs, labels = [], []
    for i in range(240):
        w = [rng.choice(words) for _ in range(rng.randint(40, 90))]
        if i % 6 == 0:
            w = [x.upper() + "$$$" for x in w]
        t = " ".join(w)
        if i % 10 == 1:
            t += " " + passage
        if i % 20 == 3:
            t = docs[-2]["text"] + " tail"
        docs.append({"doc_id": i, "text": t, "lang": "en", "source": f"s{i % 4}", "n_chars": len(t)})
        labels.append((i, int(i % 6 != 0), 0))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, outs = frame.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        assert k == 4 or frame.columns == columns
        outs.append([r.asDict() for r in frame.collect()])
    bad = {d["doc_id"] for d in docs if "$$$" in d["text"]}
    assert {d["doc_id"] for d in outs[0]} == {d["doc_id"] for d in docs} - bad
    assert {d["doc_id"] for d in outs[1]} == {c for _, c, _ in near_classes([(d["doc_id"], d["text"]) for d in outs[0]])}
    key = lambda d: d["doc_id"]
    assert [(d["doc_id"], d["text"]) for d in sorted(outs[2], key=key)] == [(d["doc_id"], d["text"]) for d in sorted(cut(outs[1]), key=key)]
    assert all(d["n_chars"] == len(d["text"]) for d in outs[2])
    size = lambda rows, s: sum(len(d["text"].split()) for d in rows if d["source"] == s)
    total = sum(size(outs[2], s) for s in ("s0", "s1", "s2", "s3"))
    for s, weight in zip(("s0", "s1", "s2", "s3"), (1, 2, 3, 1), strict=True):
        assert abs(size(outs[3], s) - min(3 * size(outs[2], s), total * weight / 7)) <= 150
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.pieces.DEFAULT_MODEL)
    assert sorted((d["doc_id"], d["ids"]) for d in outs[4]) == sorted((d["doc_id"], library.encode(d["text"])) for d in outs[3])
    assert sorted(d["n_tokens"] for d in outs[4]) == sorted(r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect())


def test_odd_rows(spark, tmp_path):
    """Null ids and texts, empty and very long texts, repeated rows, ties and columns with the names that the operators use, through every stage."""
    rng = random.Random(9)
    words = [f"word{i}" for i in range(200)]
    passage = " ".join(rng.choice(words) for _ in range(50))
    extra = "doc_id long, text string, lang string, source string, n_chars long, `row` int, score string, h long, key string, size int, part string, th long, dkey string, ids string, node string, n string"
    rows = []

    def add(i, text, source="s"):
        rows.append((i, text, "en", source, None if text is None else len(text), 1, "score", 7, "key", 3, "part", 5, "dkey", "ids", "node", "n"))

    for i in range(60):
        add(i, " ".join(rng.choice(words) for _ in range(30)) + (" " + passage if i % 5 == 0 else ""), f"s{i % 3}")
    for i in range(40):  # without an id: different texts, and equal ones
        add(None, " ".join(rng.choice(words) for _ in range(30)) + (" " + passage if i % 5 == 0 else ""), None)
    add(None, rows[-1][1], None), add(100, None), add(101, ""), add(102, " \n "), add(103, None, None), add(None, None)
    add(104, " ".join(f"long{i * i}" for i in range(40_000)), "s0")
    rows.extend(rows[:4])  # repeated rows
    labels = [(i, 1, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0)]
    spark.createDataFrame(rows, extra).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, outs = frame.columns, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frame, str(tmp_path)).write.parquet(f"{tmp_path}/{k}.parquet")
        frame = spark.read.parquet(f"{tmp_path}/{k}.parquet")
        assert k == 4 or frame.columns == columns
        outs.append([r.asDict() for r in frame.collect()])
    # all labels say good: nothing goes
    assert len(outs[0]) == len(rows)
    # one of equal texts stays, wordless ones are alike to nothing
    worded = lambda rs: sorted(d["text"] for d in rs if d["text"] and d["text"].strip())
    assert worded(outs[1]) == sorted({r[1] for r in rows if r[1] and r[1].strip()})
    assert sorted(repr(d["doc_id"]) for d in outs[1] if not (d["text"] and d["text"].strip())) == sorted(map(repr, (100, 101, 102, 103, None)))
    # the passage is left once, and nothing else is cut
    assert sum(d["text"].count(passage[:-3]) for d in outs[2] if d["text"]) == 1
    assert sum(len(d["text"]) for d in outs[2] if d["text"]) > sum(map(len, worded(outs[1]))) - 20 * (len(passage) + 30)
    assert all(d["row"] == 1 and d["score"] == "score" and d["dkey"] == "dkey" for d in outs[2])
    library = sentencepiece.SentencePieceProcessor(model_file=corpus_pipeline.pieces.DEFAULT_MODEL)
    assert sorted((repr(d["doc_id"]), d["ids"]) for d in outs[4]) == sorted((repr(d["doc_id"]), library.encode(d["text"] or "")) for d in outs[3])


def test_empty_tables(spark, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
