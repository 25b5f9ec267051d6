"""What the driver plans at once stays small: no query joins every order of the
n-gram model, repeats a step of a round, or has an aggregate per figure."""

import math

import pytest
from pyspark.sql.classic.dataframe import DataFrame

from tallyfs.llm import common, kneser_ney, mixing
from tallyfs.plans.materialize import materialize


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def plans(monkeypatch):
    """The plans of what is written or collected."""
    seen = []

    def spied(spark, df, name):
        seen.append(plan(df))
        return materialize(spark, df, name)

    for module in (common, kneser_ney, mixing):
        monkeypatch.setattr(module, "materialize", spied)
    for method in ("collect", "first"):
        def run(self, *a, _do=getattr(DataFrame, method), **k):
            seen.append(plan(self))
            return _do(self, *a, **k)

        monkeypatch.setattr(DataFrame, method, run)
    return seen


def exchanges(plans):
    return max(p.count("Exchange ") for p in plans)


def test_scoring_plans_one_order_at_a_time(spark, plans):
    texts = spark.createDataFrame([(i, f"some words of row {i % 7} and a few more") for i in range(40)], "doc_id long, text string")
    model = kneser_ney.train(spark, texts.filter("doc_id < 30"))
    symbols = model[0][0].count()
    probs = kneser_ney.log_probs(model, kneser_ney.count_grams(texts).select("gram"), symbols)
    rows = probs.collect()
    assert len(rows) == kneser_ney.count_grams(texts).count() == len({r.gram for r in rows})
    assert all(r.logp is not None and r.logp < 0 for r in rows)
    assert exchanges(plans) <= 10, exchanges(plans)


def test_a_round_of_components_plans_each_step_once(spark, plans):
    edges = spark.createDataFrame([(i, i + 1) for i in range(0, 30) if i % 10], "a long, b long")
    found = {r.node: r.component for r in common.connected_components(spark, edges).collect()}
    assert found == {n: 1 + (n - 1) // 10 * 10 for n in range(1, 31)}
    assert exchanges(plans) <= 12, exchanges(plans)


def test_figures_of_the_mix(spark, plans):
    tokens, grid = [5, 40, 1, 954], [k / 32 for k in range(33)]
    totals = spark.createDataFrame([(t,) for t in tokens], "tokens long")
    got = mixing._mix_figures(totals, 1000, 500.0, grid)
    assert len(got) == len(grid)
    for a, (entropy, repeats) in zip(grid, got):
        w = [(t / 1000) ** a for t in tokens]
        z = sum(w)
        assert entropy == pytest.approx(-sum(x / z * math.log(x / z) for x in w))
        assert repeats == pytest.approx(max(500 * x / z / t for x, t in zip(w, tokens)))
    assert max(p.count("partial_sum(") for p in plans) <= 8
