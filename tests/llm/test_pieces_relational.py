import os
import random

import pytest
import sentencepiece

from tarnlake.llm import pieces, pieces_relational

pytestmark = pytest.mark.skipif(not os.path.exists(pieces.DEFAULT_MODEL), reason="no model file")


def test_against_the_library(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rng = random.Random(3)
    pool = list("abcdefghijklmnopqrstuvwxyzABC019.,-_*#\"' \n\t éß日語😀")
    texts = [None, "", " ", "  a", "\n\n", "\n a", "a\n", "hello  world", "日本語😀 é\x00\t", "a▁b", "x" * 300]
    texts += ["".join(rng.choice(pool) for _ in range(rng.randint(1, 120))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = pieces_relational.encode(df).select("row.doc_id", "ids", "n_tokens", "round_trip").collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.ids == library.encode(texts[r.doc_id] or "") and r.n_tokens == len(r.ids) and r.round_trip == ("▁" not in (texts[r.doc_id] or ""))
