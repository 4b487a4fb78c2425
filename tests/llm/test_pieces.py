import os
import random

import numpy as np
import pytest
import sentencepiece

from tarnlake.llm import pieces

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="no model file")
ODD = ["", " ", "  a", "a  b   c    d", " " * 40 + "x", "x" + " " * 17 + "1", "\n\n", "\n a", "a\n", "a" * 20, "-" * 23, "  \n  ", "<s> <0x41>", "日本語😀 é\x00\t", "x" * 3000]


def test_against_the_library(monkeypatch):
    monkeypatch.setattr(pieces, "ROUND", 5000)
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        tool = pieces.Lattice(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rng = random.Random(0)
    pool = list("abcdefghijklmnopqrstuvwxyzABCXYZ0123456789.,;:!?-_=*#/(){}[]<>\"' \n\t éèüß日本語😀​")
    known = [tool.text(i) for i in tool.table.values()]
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randint(1, 120))) for _ in range(500)]
    texts += ["".join(rng.choice(known) for _ in range(rng.randint(1, 30))).replace("▁", " ") for _ in range(1500)]
    texts += ["".join(rng.choice("aeitnsr") for _ in range(rng.randint(1, 300))) for _ in range(300)]
    for text, ids in zip(texts, tool.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert tool.decode(ids) == text == library.decode(ids.tolist())
    monkeypatch.setattr(pieces, "MEMO", 50)
    monkeypatch.setattr(tool, "memo", pieces.Memo())
    for at in range(0, 400, 40):
        assert [x.tolist() for x in tool.encode(texts[at : at + 40])] == [library.encode(t) for t in texts[at : at + 40]]
    assert len(tool.memo.keys) < 3000
    monkeypatch.setattr(pieces, "CHUNK", 37)
    assert [x.tolist() for x in tool.encode(texts[:200])] == [library.encode(t) for t in texts[:200]]


def test_equal_hashes_of_unlike_units():
    """A text that doesn't decode to its source is encoded without hashes."""
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        tool = pieces.Lattice(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    texts = ["one two three", "four five six", "seven\neight", None, ""]
    tool.encode(texts)
    tool.memo.pool[:] = 500  # as if other units had left their ids
    ids, counts, same = tool.encode_checked(texts)
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == [library.encode(t or "") for t in texts] and all(same)


def test_decode_odd_ids(spark):
    rows = [(1, [-1, 5, None, 10**6], "x"), (2, None, "y"), (3, [], "z")]
    got = {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>, text string")).select("row.doc_id", "text").collect()}
    with open(pieces.DEFAULT_MODEL, "rb") as f:
        assert got == {1: pieces.Lattice(f.read()).decode([5]), 2: None, 3: ""}


def test_frame(spark):
    rows = [(i, t, None, "l") for i, t in enumerate(ODD)] + [(90, None, [1], "l"), (None, "hello  world", None, "l"), (91, "a▁b", None, "l")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, ids array<int>, row string").repartition(3)
    got = pieces.encode(df)
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    texts = {r[0]: r[1] for r in rows}
    found = got.select("row.doc_id", "ids", "n_tokens", "round_trip").collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids)
        assert r.round_trip == (r.doc_id != 91)
    back = pieces.decode(got.select("row.doc_id", "ids")).select("row.doc_id", "text").collect()
    assert all(r.text == (texts[r.doc_id] or "").replace("▁", " ") for r in back)
    assert pieces.encode(df.limit(0)).count() == 0
