"""Mixing: weights against their definition, passes against a plain count."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tallyfs.llm import mixing


def corpus(spark, n=3000):
    rnd = random.Random(6)
    rows = []
    for i in range(n):
        s = rnd.choice(["big"] * 12 + ["mid"] * 4 + ["small", None])
        rows.append((i, " ".join("w" * rnd.randrange(1, 9) for _ in range(rnd.randrange(0, 40))), s, i % 3))
    rows += [(None, None, "big", 0), (None, "", "empty only", 1), (7, "same row", "mid", 2), (7, "same row", "mid", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, passes int")


def shares(plan, a):
    t = {r.src: r.tokens for r in plan if r.tokens}
    z = sum(v ** a for v in t.values())
    return {s: v ** a / z for s, v in t.items()}


def entropy(w):
    return -sum(p * math.log(p) for p in w.values())


@pytest.mark.parametrize("kw", [{}, {"entropy_part": 1.0}, {"entropy_part": 0.0}, {"entropy_part": None, "max_repeats": 1.5},
                                {"budget": 90_000.0, "max_repeats": 8.0}, {"budget": 7_001.0, "max_repeats": None}])
def test_weights_and_passes(spark, kw):
    docs = corpus(spark)
    mixed, plan = mixing.mix(spark, docs, **kw)
    plan = plan.collect()
    a = plan[0].exponent
    for r in plan:
        if r.tokens:
            assert r.weight == pytest.approx(shares(plan, a)[r.src], rel=1e-9)
    whole = sum(r.tokens for r in plan)
    budget = kw.get("budget") or whole
    repeats = max(r.budget / r.tokens for r in plan if r.tokens)
    limit = kw.get("max_repeats", 4.0)
    if limit:
        assert repeats <= limit * (1 + 1e-6)
    part = kw.get("entropy_part", 0.5)
    if part is not None and (not limit or repeats < limit * 0.999):  # the limit did not decide
        flat, natural = entropy(shares(plan, 0.0)), entropy(shares(plan, 1.0))
        assert entropy(shares(plan, a)) == pytest.approx(natural + part * (flat - natural), abs=1e-6)
    rows = mixed.collect()
    assert len(rows) == docs.count() and "passes" in mixed.columns
    for r in plan:
        src = None if r.src == "null" else r.src[1:]
        own = sorted((x for x in rows if x.source == src), key=lambda x: x.mix_place)
        if not r.tokens:
            assert all(x.mix_copies == 0 for x in own)
            continue
        extra = [x.mix_copies - r.passes for x in own]
        assert set(extra) <= {0, 1} and extra == sorted(extra, reverse=True)  # a prefix of the permutation
        used = sum(x.mix_tokens for x, e in zip(own, extra) if e)
        assert used <= r.rest + 1e-6
        rest = [x for x, e in zip(own, extra) if not e]
        if rest:  # the next row (with its repeats) would not fit
            nxt = sum(x.mix_tokens for x in rest if x.mix_place == rest[0].mix_place)
            assert used + nxt > r.rest - 1e-6
    assert abs(sum(x.mix_tokens * x.mix_copies for x in rows) - budget) < 45 * len(plan) + 1


def test_exploded_rows_and_empty_table(spark):
    docs = corpus(spark, 300)
    mixed, _ = mixing.mix(spark, docs)
    total = mixed.agg(F.sum("mix_copies")).first()[0]
    assert mixing.mixed_rows(mixed, docs.columns).count() == total
    empty, plan = mixing.mix(spark, docs.limit(0))
    assert empty.count() == 0 and plan.count() == 0


def test_infeasible_limit(spark):
    with pytest.raises(ValueError):
        mixing.mix(spark, corpus(spark, 50), budget=1e9, max_repeats=2.0)
