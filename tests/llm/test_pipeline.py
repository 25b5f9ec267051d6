"""The pipeline's stages against plain versions, stage by stage."""

import itertools
import re
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline as cp
from tallyfs.llm import kneser_ney, mixing, sentencepieces, simhash
from tallyfs.plans.materialize import materialize

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def key(r):
    return tuple(r[c] for c in COLUMNS)


def sort_key(r):
    return (r.doc_id is None, r.doc_id or 0)


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in cp.STAGES]
    assert names == ["quality_classifier", "exact_dedup", "simhash_dedup", "mixing", "sentencepiece"]
    out = {}
    for name, stage in cp.STAGES:
        before = docs.collect()
        docs = materialize(spark, stage(spark, docs, SF), f"test_{name}")
        after = docs.collect()
        out[name] = after
        if name != "sentencepiece":
            assert docs.columns == COLUMNS
        if name == "quality_classifier":
            judged = {r.doc_id: r.kept for r in kneser_ney.quality(
                spark, spark.read.parquet(f"{SF}/documents.parquet"), labels.filter("quality = 1").select("doc_id")).collect()}
            assert Counter(map(key, after)) == Counter(key(r) for r in before if judged[r.doc_id])
            good = {r.doc_id for r in labels.filter("quality = 1").collect()}
            assert good <= {r.doc_id for r in after}
        if name == "exact_dedup":
            first = {}
            for r in sorted(before, key=sort_key):
                first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", r.text or ""), r)
            assert Counter(map(key, after)) == Counter(map(key, first.values()))
        if name == "simhash_dedup":
            fps = {r.doc_id: simhash.fingerprint((r.text or "").encode()) for r in before}
            root = {d: d for d in fps}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in itertools.combinations(sorted(fps), 2):
                if (fps[a] ^ fps[b]).bit_count() <= 3:
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
            assert sorted(r.doc_id for r in after) == sorted({find(d) for d in fps})
        if name == "mixing":
            mixed, _ = mixing.mix(spark, materialize(spark, spark.createDataFrame(before, docs.schema), "test_mix"))
            want = Counter({key(r): r.mix_copies for r in mixed.collect() if r.mix_copies})
            assert Counter(map(key, after)) == want
        if name == "sentencepiece":
            lib = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
            assert Counter(map(key, after)) == Counter(map(key, before))
            assert all(r.token_ids == lib.encode(r.text) for r in after)
    assert len(out["simhash_dedup"]) <= len(out["exact_dedup"]) <= len(out["quality_classifier"]) <= 200


@pytest.fixture
def odd_dir(spark, tmp_path):
    rows = [(1, "good words here and there", "en", "a", 5, "x"), (1, "good words here and there", "en", "a", 5, "y"),
            (2, None, None, None, None, "x"), (None, "", "en", "a", 0, "x"), (None, "good  words here and there", None, "b", 1, "x"),
            (3, "word " * 20_000, "en", "b", 1, None), (4, "???", "en", "b", 1, None)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, rk string"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int") \
        .write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/empty/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/empty/labels.parquet")
    return str(tmp_path)


def test_odd_rows_and_empty_tables(spark, odd_dir):
    rows = cp.run(spark, odd_dir).collect()
    texts = Counter(re.sub(r"\s+", " ", r.text or "").strip() for r in rows)
    assert texts["good words here and there"] >= 1 and "rk" in rows[0].asDict()
    assert cp.run(spark, f"{odd_dir}/empty").count() == 0
