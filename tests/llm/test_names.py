"""No column name of a user's table meets a name that an operator uses inside:
every operator on a table that holds all of them, beside the same table
without them."""

import re
from pathlib import Path

import pytest

import corpus_pipeline as cp
from tallyfs.llm import (common, divergence, exact, filter_audit, kneser_ney, langid, licenses, lines, mixing, sentencepieces,
                         simhash, toxicity)

SOURCE = "".join(p.read_text() for p in Path(common.__file__).parent.glob("*.py")) + Path(cp.__file__).read_text()
TABLE = {"doc_id", "text", "lang", "source", "n_chars"}
#: Every name with an underscore in front that the operators give a column,
#: found in their source, and the plain ones that stand beside a user's columns.
NAMES = sorted({n.lower() for n in re.findall(r'"(_[a-z][a-z0-9_]*)"', SOURCE)} | {
    "_salt_", "rk", "seq", "src", "place", "t", "n", "fp", "digest", "recipe", "text_", "row", "ids", "part", "words", "gram", "shard"})
RESULTS = {"token_ids", "round_trip", "clean_text", "n_lines", "removed", "n_runs", "mix_copies", "mix_tokens", "mix_place", "mix_copy"}


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(i, " ".join(f"word{(i * k) % 17}" for k in range(30 + i)) + "\nshared line of five words here", "en", f"s{i % 3}", 1) for i in range(24)]
    rows += [(30, "long words " * 7000, "en", "s1", 1), (31, rows[3][1], "en", "s2", 1), (3, rows[3][1], "en", "s9", 1), (None, None, None, None, None)]
    plain = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return plain, plain.selectExpr("*", *[f"concat('{n}', doc_id) as `{n}`" for n in NAMES])


OPERATORS = {
    "op2": lambda spark, d: exact.exact_dedup(spark, d),
    "op3": lambda spark, d: licenses.summary(licenses.scan(spark, d)),
    "op4": lambda spark, d: kneser_ney.quality(spark, d, d.filter("doc_id < 20").select("doc_id")),
    "op5": lambda spark, d: simhash.simhash_dedup(spark, d),
    "op6": lambda spark, d: sentencepieces.encode(spark, d, verify=True),
    "op7": lambda spark, d: lines.line_dedup(spark, d),
    "op8": lambda spark, d: mixing.mixed_rows(mixing.mix(spark, d)[0], [c for c in d.columns if c not in RESULTS]),
    "op9": lambda spark, d: toxicity.toxicity(spark, d, d.selectExpr("*", "int(doc_id % 2) as toxic")),
    "op10": lambda spark, d: langid.identify(spark, d, d),
    "op11": lambda spark, d: filter_audit.audit(spark, d, d.select("doc_id").selectExpr("doc_id", "1 as quality", "0 as toxic")),
    "op12": lambda spark, d: divergence.divergence(spark, d, min_docs=2),
}


def shown(df, columns):
    return sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())


@pytest.mark.parametrize("op", sorted(OPERATORS))
def test_operator(spark, tables, op):
    plain, full = tables
    want, got = OPERATORS[op](spark, plain), OPERATORS[op](spark, full)
    assert shown(got, want.columns) == shown(want, want.columns)
    for c in set(NAMES) & set(got.columns) - set(want.columns) - RESULTS:  # the user's columns come back as they were
        assert got.filter(f"not `{c}` <=> concat('{c}', doc_id)").count() == 0, c
    if op in ("op6", "op7", "op8"):
        assert set(NAMES) - RESULTS <= set(got.columns)


@pytest.mark.parametrize("stage", range(1, 5))
def test_stage(spark, tables, stage):
    plain, full = tables
    name, run = cp.STAGES[stage]
    want, got = run(spark, plain, "/root/testdata/sf0.001"), run(spark, full, "/root/testdata/sf0.001")
    assert shown(got, want.columns) == shown(want, want.columns)
    left = sorted(set(NAMES) - RESULTS)
    wrong = " or ".join(f"not `{c}` <=> concat('{c}', doc_id)" for c in left)
    assert got.filter(wrong).count() == 0


def test_quality_stage_judges_a_text_in_its_language(spark, tables):
    plain, full = tables
    want, got = (cp.quality_stage(spark, d, "/root/testdata/sf0.01") for d in (plain, full))
    assert shown(got, want.columns) == shown(want, want.columns) and set(got.columns) == set(full.columns)
