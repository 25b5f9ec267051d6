"""Toxicity and language: held-out accuracy, planted cases, defined edges."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyfs.llm import langid, queries, toxicity

SF = "/root/testdata/sf0.1"


def test_toxicity_held_out(spark):
    got = queries.op9_toxicity(spark, SF)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = got.join(labels, "doc_id").filter("toxic is not null").collect()
    assert got.count() == spark.read.parquet(f"{SF}/documents.parquet").count()
    for r in rows[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    held = [r for r in rows if r.held_out]
    caught = [r.predicted for r in held if r.toxic == 1]
    false = [r.predicted for r in held if r.toxic == 0]
    # this table plants part of its toxic words from syllables that clean words have too
    assert sum(caught) >= 0.8 * len(caught)
    assert sum(false) <= 0.01 * len(false)


def test_toxic_sentences_are_located(spark):
    words = "one two three four five six seven".split()
    rows = [(i, ". ".join(" ".join(words[(i + k) % 7:]) for k in range(i % 5 + 1)) + (". you zork fool!" if i % 4 == 0 else ""),
             int(i % 4 == 0), "x") for i in range(400)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int, score string")
    odd = [(1000, None), (1001, ""), (1002, "1 2 3 ..."), (1003, "All one. İ two. YOU Zork fool here\nand three"), (None, "you zork fool"),
           (1003, "All one. İ two. YOU Zork fool here\nand three"), (1004, "one. " * 20_000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    got = toxicity.toxicity(spark, docs, labelled).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got}
    assert by[1000].score == by[1001].score == by[1002].score == 0
    assert [odd[3][1][s.start:s.stop].strip() for s in by[1003].offending] == ["YOU Zork fool here"]
    assert by[None].score >= 0.5 and by[1004].score < 0.5
    none = toxicity.toxicity(spark, docs, labelled.filter("toxic = 0")).collect()
    assert all(r.score == 0 for r in none)
    assert toxicity.toxicity(spark, docs.limit(0), labelled).count() == 0


def _rare_toxic_words(spark, n_words, docs_each):
    import random

    rnd = random.Random(4)
    words = ["".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(n_words)]
    plain = "one two three four five six seven".split()
    texts = [(" ".join(rnd.sample(plain, 4)) + ". " + w + " here", 1) for w in words for _ in range(docs_each)]
    texts += [(" ".join(rnd.sample(plain, 4)) + ". nothing here", 0) for _ in range(4 * len(texts))]
    rows = [(i, t, y) for i, (t, y) in enumerate(texts)]
    return words, spark.createDataFrame(rows, "doc_id long, text string, toxic int").repartition(4)


def test_every_rare_toxic_word_is_learned(spark):
    """400 words of 8 documents each have more than 1,024 features."""
    words, labelled = _rare_toxic_words(spark, 400, 8)
    docs = spark.createDataFrame([(i, w + " here") for i, w in enumerate(words)], "doc_id long, text string")
    assert all(r.score >= 0.5 for r in toxicity.toxicity(spark, docs, labelled).collect())


@pytest.mark.parametrize("held", [1 << 19, 50])
def test_no_feature_is_lost_to_others_with_its_hash(spark, monkeypatch, held):
    """Clean words whose features share the toxic word's hashes (modulo 2**18)."""
    import random

    monkeypatch.setattr(toxicity, "HELD", held, raising=False)
    rnd, toxic = random.Random(1), "zorkfulness"
    open_hashes = {zlib.crc32(f.encode()) % (1 << 18) for f in toxicity.features(toxic)}
    clean = []
    while open_hashes:
        w = "".join(rnd.choice("abcdefghijklm") for _ in range(9))
        hit = open_hashes & {zlib.crc32(f.encode()) % (1 << 18) for f in toxicity.features(w)}
        if hit:
            clean.append(w)
            open_hashes -= hit
    rows = [(i, "one two " + (toxic if i % 5 == 0 else " ".join(clean)), int(i % 5 == 0)) for i in range(300)]
    labelled = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    docs = spark.createDataFrame([(0, toxic), (1, " ".join(clean))], "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.toxicity(spark, docs, labelled).collect()}
    assert got[0] >= 0.5 and got[1] < 0.5


def test_weights_by_tasks_equal_those_of_the_driver(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "EPOCHS", 12)
    _, labelled = _rare_toxic_words(spark, 12, 8)
    one, bias = toxicity.train(spark, labelled)
    monkeypatch.setattr(toxicity, "DRIVER_ENTRIES", 0)
    other, bias_too = toxicity.train(spark, labelled)
    assert one and one == pytest.approx(other, rel=1e-6) and bias == pytest.approx(bias_too, rel=1e-6)


def _bag_rows(spark, rows, feats):
    got = toxicity.bags(spark.createDataFrame(rows, "text string, toxic int").repartition(3), feats).collect()
    return sorted((r.toxic, r.n, r.times, r.size, r.feat) for r in got)


def test_equal_bags_come_once(spark):
    rows = [("zork. " * 10_000 + "zork fool.", 1), ("nothing here", 0), (None, 1), ("", 0), ("zork fool. " + "Zork! " * 10_000, 1),
            ("fool zork\nzork zork. fool", 0), ("fool", 0), ("zork", 1)]
    assert _bag_rows(spark, rows, ["fool$", "zork$"]) == [
        (0, 1, [1], [1], [1]), (0, 1, [1], [2], [0, 1]), (0, 1, [2], [1], [0]),
        (1, 1, [1], [1], [1]), (1, 2, [1, 10_000], [2, 1], [0, 1, 1])]
    assert _bag_rows(spark, [(None, 0)], ["zork$"]) == []


def _plain_loss(rows, feats, w, b):
    """The negative log-likelihood, document by document."""
    loss = 0.0
    for text, y in rows:
        none = 0.0
        for s in toxicity.SENTENCE.findall((text or "").lower()):
            has = [f for word in set(toxicity.WORD.findall(s)) for f in toxicity.features(word) if f in feats]
            if has:
                none -= math.log1p(math.exp(b + sum(w[feats.index(f)] for f in has)))
        if none:
            loss -= math.log(-math.expm1(none)) if y else none
    return loss


def test_gradient_equals_differences_of_the_plain_loss(spark):
    rnd = random.Random(4)
    words = ["zork", "zorka", "fool", "foolish", "plain", "words", "good"]
    docs = [". ".join(" ".join(rnd.choices(words, k=rnd.randrange(4))) for _ in range(rnd.randrange(6))) for _ in range(40)]
    rows = [(rnd.choice(docs), rnd.randrange(2)) for _ in range(150)]
    feats = sorted({"zork$", "zor", "zork", "fool$", "foo", "foolis", "good$"})
    w, b, h = np.array([rnd.uniform(-1, 2) for _ in feats]), -1.5, 1e-5
    table = toxicity.bags(spark.createDataFrame(rows, "text string, toxic int").repartition(3), feats).toArrow()
    got = toxicity.gradient(toxicity.parts(table), w, b)
    for k in range(len(feats)):
        step = np.zeros(len(feats))
        step[k] = h
        want = (_plain_loss(rows, feats, w + step, b) - _plain_loss(rows, feats, w - step, b)) / (2 * h)
        assert abs(got[k] - want) < 1e-5 * max(1, abs(want))
    want = (_plain_loss(rows, feats, w, b + h) - _plain_loss(rows, feats, w, b - h)) / (2 * h)
    assert abs(got[-1] - want) < 1e-5 * max(1, abs(want))


def _plain_score(text, weights, bias):
    keep = 1.0
    for s in toxicity.SENTENCE.findall((text or "").lower()):
        z = sum(weights.get(f, 0.0) for word in set(toxicity.WORD.findall(s)) for f in toxicity.features(word))
        if z:
            keep *= 1 - 1 / (1 + math.exp(-min(30, max(-30, bias + z))))
    return 1 - keep


def test_scores_equal_the_plain_noisy_or(spark):
    weights, bias = {"zork$": 6.0, "zor": 1.5, "fool$": 2.0, "plain$": -0.5}, -4.0
    texts = ["", None, "zork fool. plain zorro\nfool", "ZORK! " * 50, "fool. " * 9, "nothing"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.score for r in toxicity.score(spark, docs, weights, bias).collect()}
    assert all(abs(got[k] - _plain_score(t, weights, bias)) < 1e-9 for k, t in enumerate(texts))


def test_language_held_out(spark):
    got = queries.op10_langid(spark, SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    rows = got.join(docs, "doc_id").filter("lang is not null").collect()
    assert got.count() == docs.count()
    for r in rows[:200]:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


def test_language_edges_and_mixtures(spark):
    rows = [(i, ["the cat and the dog of the house ", "der hund und die katze im haus "][i % 2] * 20, ["en", "de"][i % 2], "s")
            for i in range(40)] + [(90, "???", None, "s"), (91, None, "en", None)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    odd = [(0, None), (1, ""), (2, "12 -- !"), (3, "a"), (4, "the dog " * 200 + "und die katze im haus " * 30), (None, "der hund"),
           (5, "𝒜𝒷"), (6, "DER HUND UND DIE KATZE"), (4, "the dog"), (7, "the house of the dog " * 30_000)]
    docs = spark.createDataFrame(odd, "doc_id long, text string")
    got = langid.identify(spark, docs, learn).collect()
    assert len(got) == len(odd)
    by = {r.doc_id: r for r in got if r.doc_id != 4}
    assert [by[i].lang_pred for i in (0, 1, 2)] == ["und"] * 3 and by[0].score == 0
    assert by[3].lang_pred in ("en", "de") and by[5].lang_pred in ("en", "de")
    assert by[None].lang_pred == "de" and by[6].lang_pred == "de" and by[7].lang_pred == "en"
    mixed = next(r for r in got if r.doc_id == 4 and "," in r.langs)
    assert mixed.lang_pred == "en" and mixed.langs.startswith("en:0.") and ",de:0." in mixed.langs
    assert all(r.lang_pred == "und" for r in langid.identify(spark, docs, learn.limit(0)).collect())


def test_any_number_of_languages(spark, monkeypatch):
    """70 languages; few of them by the dense and the sparse model alike."""
    import random

    rnd = random.Random(6)
    words = {f"l{k:02d}": ["".join(rnd.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(12)] for k in range(70)}
    rows = [(i, " ".join(rnd.choice(ws) for _ in range(60)), lang) for i, (lang, ws) in enumerate(list(words.items()) * 3)]
    learn = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(2)
    docs = spark.createDataFrame([(i, " ".join(rnd.choice(ws) for _ in range(40))) for i, ws in enumerate(words.values())],
                                 "doc_id long, text string")
    got = langid.identify(spark, docs, learn).collect()
    assert {r.doc_id: r.lang_pred for r in got} == dict(enumerate(words))
    few, asked = learn.filter("lang < 'l05'"), docs.filter("doc_id < 10")
    dense = sorted(langid.identify(spark, asked, few).collect())
    langs, like = langid.learn(spark, few)
    ids = langid.np.arange(langid.BUCKETS)
    for r, text in zip(dense, [d.text for d in sorted(asked.collect())]):
        chosen, whole = langid.predict_one(langid.trigrams(text), like)
        assert langs[max(chosen, key=lambda i: whole[i])] == r.lang_pred
        again = langid.predict_one(langid.trigrams(text), like[ids])
        assert again[0] == chosen and (again[1] == whole).all()


def test_mixture_is_the_likelihood_maximum():
    import numpy as np

    rnd = np.random.default_rng(5)
    p = rnd.dirichlet(np.ones(50), size=2).T
    n = rnd.multinomial(20_000, p @ np.array([0.3, 0.7])).astype(float)
    share, ll = langid.mixture(p, n, rounds=200)
    assert share[0] == pytest.approx(0.3, abs=0.03)
    grid = max(float(n @ np.log(p @ np.array([a, 1 - a]))) for a in np.linspace(0.01, 0.99, 99))
    assert ll >= grid - 1e-6
