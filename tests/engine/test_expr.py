import itertools
import random

import pytest
from pyspark.sql import functions as F

from tarnlake.functions.registry import Registry
from tarnlake.operators import stats as st
from tarnlake.plans import binding, prune
from tarnlake.plans import compile as comp
from tarnlake.plans.expr import FALSE, TRUE, All, Any_, Const, Not, all_of, any_of, call, col, columns, lit, negate


def test_folding():
    a, b = col("a").eq(1), col("b").eq(2)
    assert all_of() == TRUE and any_of() == FALSE and all_of(a, TRUE) == a and all_of(a, FALSE, b) == FALSE and any_of(a, TRUE) == TRUE
    assert all_of(a, all_of(b, a)) == All((a, b, a)) and any_of(a, any_of(b, a)) == Any_((a, b, a)) and negate(negate(a)) == a and ~TRUE == FALSE
    assert isinstance(col("a").not_in(1), Not) and columns((a & ~b) | call("f", col("c")).is_null()) == {"a", "b", "c"} and Const(True) == TRUE


def test_binding(spark):
    schema = spark.createDataFrame([], "a int, s struct<x:int>").schema
    e = col("a").eq(1) & col("zzz").is_null()
    with pytest.raises(binding.BindingError):
        binding.bind(e, schema)
    assert columns(binding.bind(e, schema, strict=False)) == {"a", "zzz"}
    flat = lit(1).eq(2)
    assert binding.bind(flat, schema) is flat and binding.bind(col("s.x"), schema).field_id == 2


def test_three_values(spark):
    df = spark.createDataFrame([(a, b, c) for a in (True, False, None) for b in (True, False, None) for c in (1.0, float("nan"), None)], "a boolean, b boolean, c double")
    p = lambda e: comp.predicate(e, df.schema)
    A, B = col("a").eq(True), col("b").eq(True)
    out = df.select("a", "b", "c", p(A & B).alias("x"), p(A | B).alias("y"), p(~A).alias("z"), p(col("c").is_nan()).alias("n"), p(col("c").is_not_nan()).alias("m"), p(col("c").eq("s")).alias("t"), p(col("a").eq_null_safe(None)).alias("s"), p(col("c").isin(1.0, None)).alias("i"), p(col("c").not_in(1.0, "q")).alias("j"), p(col("c").isin(None)).alias("k"), p(col("c").isin()).alias("l")).collect()
    for r in out:
        a, b, c = r["a"], r["b"], r["c"]
        assert r["x"] == (False if a is False or b is False else None if a is None or b is None else True)
        assert r["y"] == (True if a or b else None if a is None or b is None else False)
        assert r["z"] == (None if a is None else not a) and r["t"] is None and r["s"] == (a is None)
        assert r["n"] == (c is not None and c != c) and r["m"] == (None if c is None else c == c)
        assert r["i"] == (True if c == 1.0 else None) and r["j"] == (None if c is None else c != 1.0) and r["k"] is None and r["l"] == (None if c is None else False)


def test_functions(spark):
    df = spark.createDataFrame([("Ab", 3), (None, None)], "s string, n int")
    own = Registry()
    own.register("twice", lambda c: c * 2)
    e = [call("upper", col("s")), call("twice", col("n")), call("coalesce", col("n"), 9), call("case", col("n").gt(2), "big", "small"), call("cast", col("n"), "string"), call("like", col("s"), "A%"), call("add", col("n"), 1.5)]
    got = df.select(*[comp.expression(x, df.schema, own).alias(f"c{k}") for k, x in enumerate(e)]).collect()
    assert tuple(got[0]) == ("AB", 6, 3, "big", "3", True, 4.5) and tuple(got[1]) == (None, None, 9, "small", None, None, None)
    assert own.is_registered("UPPER") and not own.is_registered("nope")
    with pytest.raises(KeyError):
        own.invoke("nope")


def test_pruning_is_sound(spark):
    """What is pruned holds no match, and 'always true' units hold nothing else, over random predicates."""
    rng = random.Random(3)
    nan = float("nan")
    rows = []
    for unit in range(24):
        kind = unit % 4
        for _ in range(5):
            i = None if kind == 0 or rng.random() < 0.1 * (kind == 1) else rng.randint(unit // 2, unit // 2 + (kind == 3) * 0 + 3 * (kind != 3))
            f = rng.choice([nan, 1.0, 2.5] if kind == 1 else [None] if kind == 2 else [0.5 * unit])
            s = None if kind == 2 and rng.random() < 0.5 else rng.choice(["a", "ab", "b" * 70, "bc"])[: 3 if kind == 3 else 99]
            rows.append((unit, i, f, s))
    df = spark.createDataFrame(rows, "u int, i int, f double, s string").cache()
    stats = df.groupBy("u").agg(*st.aggregates(df.drop("u").schema)).cache()

    def leaf():
        k = rng.randrange(9)
        op = rng.choice(["eq", "ne", "lt", "le", "gt", "ge", "eq_null_safe"])
        if k < 3:
            return getattr(col("i"), op)(rng.choice([rng.randint(0, 14), 3.5, None]))
        if k < 5:
            return getattr(col("f"), op)(rng.choice([nan, 1.0, 2.5, 4, None]))
        if k < 7:
            return rng.choice([getattr(col("s"), op)(rng.choice(["a", "b", "b" * 70, "zz"])), col("s").starts_with(rng.choice(["a", "b", "", "bbb"]))])
        return rng.choice([col("i").is_null(), col("s").is_not_null(), col("f").is_nan(), col("f").is_not_nan(), col("i").isin(1, 5, None), col("i").isin(), lit(3).lt(col("i")), col("i").eq("x"), call("abs", col("i")).gt(2), lit(1).lt(2)])

    def tree(d):
        if d == 0:
            return leaf()
        return rng.choice([lambda: all_of(tree(d - 1), tree(d - 1)), lambda: any_of(tree(d - 1), tree(d - 1)), lambda: ~tree(d - 1), leaf])()

    preds = [tree(rng.randint(0, 3)) for _ in range(120)]
    find = st.accessor(stats.schema)
    said = {r["u"]: r for r in stats.select("u", *[prune.decision(p, df.schema, F.col("rows"), find).alias(f"p{k}") for k, p in enumerate(preds)]).collect()}
    held = df.select("u", *[comp.predicate(p, df.schema).alias(f"p{k}") for k, p in enumerate(preds)]).collect()
    for unit, own in itertools.groupby(sorted(held, key=lambda r: r["u"]), key=lambda r: r["u"]):
        own = list(own)
        for k, p in enumerate(preds):
            values = [r[f"p{k}"] for r in own]
            if said[unit][f"p{k}"] == "always false":
                assert True not in values, (unit, p)
            if said[unit][f"p{k}"] == "always true":
                assert set(values) == {True}, (unit, p)
    decided = sum(v != "unknown" for r in said.values() for v in list(r)[1:])
    assert decided > 600
