"""The n-gram model against a plain implementation; decisions on planted text."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyfs.llm import kneser_ney as kn


def plain_model(texts):
    """P(symbol | history) by recursion over dictionaries."""
    raw = Counter()
    for t in texts:
        s = kn.START * 3 + (t or "") + kn.END
        raw.update(s[i:i + 4] for i in range(len(s) - 3))
    levels = {4: raw}
    for k in (3, 2, 1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    tables = {}
    for k, c in levels.items():
        d = kn.discounts(*[sum(v == i for v in c.values()) for i in (1, 2, 3, 4)])
        total, freed = Counter(), defaultdict(float)
        for g, n in c.items():
            total[g[:-1]] += n
            freed[g[:-1]] += d[min(n, 3) - 1]
        tables[k] = (c, d, total, freed)
    v = len(levels[1])

    def p(g):
        if not g:
            return 1 / (v + 1)
        c, d, total, freed = tables[len(g)]
        h = g[:-1]
        if h not in total:
            return p(g[1:])
        n = c[g]
        return (max(n - d[min(n, 3) - 1], 0) / total[h] if n else 0) + freed[h] / total[h] * p(g[1:])

    return p


def docs():
    rnd = random.Random(9)
    words = ["alpha", "beta", "gamma", "delta", "épsilon", "zeta🙂"]
    good = [(i, " ".join(rnd.choice(words) for _ in range(rnd.randrange(5, 60))), "en", i) for i in range(300)]
    bad = [(1000 + i, "$$$ ".join(rnd.choice(words).upper() for _ in range(40)), "en", 0) for i in range(20)]
    odd = [(None, None, None, 1), (2000, "", "xx", None), (2001, "alpha beta " * 3000, "en", 5), (5, good[5][1], "en", 5)]
    return good + bad + odd


@pytest.mark.parametrize("shard", [8_000_000, 700])
def test_model_equals_plain(spark, monkeypatch, shard):
    """Also with texts in several pieces and many shards."""
    monkeypatch.setattr(kn, "SHARD_CHARS", shard)
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, ctx int")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(None,)], "doc_id long")
    got = kn.perplexities(spark, df, trusted).collect()
    p = plain_model([t.replace("🙂", "￿") if t else t for i, t, *_ in rows if i is not None and i < 300 and i % 2 == 0])
    assert len(got) == len(rows)
    text = {i: (t or "").replace("🙂", "￿") for i, t, *_ in rows}
    for r in got:
        s = kn.START * 3 + text[r.doc_id] + kn.END
        assert r.n_chars == len(s) - 3
        assert r.logp == pytest.approx(sum(math.log(p(s[i:i + 4])) for i in range(len(s) - 3)), rel=1e-4)


def test_pieces_hold_every_gram_once():
    text = "abcdefghij" * 3
    for t in ("", "a", None, text):
        marked = kn.START * 3 + (t or "") + kn.END
        want = Counter(marked[i:i + 4] for i in range(len(marked) - 3))
        for chars in (1, 2, 3, 4, 7, 30, 31, 100):
            pieces = [p.decode() for p in kn.pieces_of(t, chars)]
            assert Counter(p[i:i + 4] for p in pieces for i in range(len(p) - 3)) == want
            assert max(len(p) for p in pieces) <= chars + 3


def test_a_batch_is_counted_block_by_block(monkeypatch):
    """What is indexed at once is bounded by the block, not by the batch."""
    monkeypatch.setattr(kn, "BLOCK_CHARS", 1000)
    seen = []
    real = kn.grams
    monkeypatch.setattr(kn, "grams", lambda held: seen.append(sum(map(len, held))) or real(held))
    texts = ["lorem ipsum " * k for k in range(1, 60)] + ["x" * 50_000]
    pieces = [p for t in texts for p in kn.pieces_of(t)]
    codes = kn.distinct_grams(pieces)
    assert max(seen) < 3000 and len(seen) > 20
    assert np.array_equal(codes, np.unique(real(pieces)[0]))


def test_planted_junk_goes_and_clean_stays(spark):
    rows = docs()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)], "doc_id long")
    got = kn.quality(spark, df, trusted).collect()
    assert len(got) == len(rows)
    assert not any(r.kept for r in got if r.doc_id in range(1000, 1020))
    assert all(r.kept for r in got if r.doc_id is not None and r.doc_id < 300)


def test_languages_with_few_or_no_trusted_rows(spark):
    """Without any, rows are kept unjudged; with a few, clean rows stay and junk
    goes by the spread of all languages; null is a language like any other."""
    rnd = random.Random(2)
    words = ["быстрая", "лиса", "прыгает", "через", "ленивую", "собаку"]
    clean = [(3000 + i, " ".join(rnd.choice(words) for _ in range(60)), ["ru", "uk", None][i % 3], 0) for i in range(90)]
    junk = [(4000 + i, "#@!" * 60, "uk", 0) for i in range(5)]
    df = spark.createDataFrame(docs() + clean + junk, "doc_id long, text string, lang string, kept int")
    few = [3000 + i for i in range(90) if i % 3 == 1]
    held = [i for i in few if zlib.crc32(str(i).encode()) % 5 == 0]
    few = held[:2] + [i for i in few if i not in held][:6]
    trusted = spark.createDataFrame([(i,) for i in [*range(0, 300, 2), *few]], "doc_id long")
    got = kn.quality(spark, df, trusted).collect()
    other = {r.doc_id: r for r in got if r.doc_id is not None and r.doc_id >= 3000}
    assert len(other) == 95 and all(r.kept for i, r in other.items() if i < 4000)
    assert not any(other[4000 + i].kept for i in range(5))
    assert all((r.lo is None) == (r.lang != "uk") and (r.hi is None) == (r.lang != "uk") for r in other.values())
    assert not any(r.kept for r in got if r.doc_id in range(1000, 1020))


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_labelled_rows(spark, sf):
    """Good rows that were left out of the counts stay, junk goes."""
    labels = spark.read.parquet(f"/root/testdata/{sf}/labels.parquet")
    docs_ = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    got = kn.quality(spark, docs_, labels.filter("quality = 1").select("doc_id")).join(labels, "doc_id").collect()
    held = [r.kept for r in got if r.quality == 1 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    good, junk = ([r.kept for r in got if r.quality == k] for k in (1, 0))
    assert sum(held) / len(held) >= 0.99 and sum(good) / len(good) >= 0.995
    assert sum(junk) / len(junk) < 0.1


def test_no_trusted_rows_and_empty_table(spark):
    df = spark.createDataFrame(docs()[:5], "doc_id long, text string, lang string, n int")
    none = spark.createDataFrame([], "doc_id long")
    assert [r.kept for r in kn.quality(spark, df, none).collect()] == [True] * 5
    assert kn.quality(spark, df.limit(0), none).count() == 0
