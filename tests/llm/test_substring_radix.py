import random

from tarnlake.llm import substring, substring_radix


def test_the_two_forms_agree(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    shared = [" ".join(rng.choice(words) for _ in range(40)) for _ in range(4)]
    rows = [(i if i % 9 else None, " ".join(rng.choice(words) for _ in range(rng.randint(0, 60))) + (rng.choice(shared) if i % 3 else ""), "x") for i in range(90)]
    rows += [(900, None, "y"), (901, "a" * 300, "y"), (902, "", "z"), rows[4]]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    one, two = (sorted(map(tuple, f(df, 30).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=repr) for f in (substring.dedup, substring_radix.dedup))
    assert one == two and sum(r[2] for r in one) > 500
