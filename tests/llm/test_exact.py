"""Exact dedup: recipes against plain equality of normalised texts."""

import hashlib
import random
import re

from tallyfs.llm import exact
from tallyfs.llm.common import keep_keys


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def texts():
    rnd = random.Random(5)
    long = " ".join(str(rnd.random()) for _ in range(20_000))
    return ["", None, " ", "a b", "a\t\n b", "a\xa0b", long, long.replace(" ", "\n"), long + "x", "y" + long,
            "z" * 50_000, "z" * 50_001, "B a", "b a"] + ["dup dup"] * 30


def test_cut_points_are_local_and_whole():
    rnd = random.Random(1)
    data = rnd.randbytes(3_000_000)
    cuts = exact.cut_points(data)
    assert cuts[-1] == len(data) and cuts == sorted(set(cuts))
    assert max(b - a for a, b in zip([0] + cuts, cuts)) <= exact.MAX_CHUNK
    shifted = exact.cut_points(b"inserted text" + data)
    assert len({c + 13 for c in cuts} & set(shifted)) > 0.98 * len(cuts)
    assert exact.cut_points(b"") == []


def check(spark, rows, **kw):
    docs = spark.createDataFrame(rows, "doc_id long, text string, recipe int, digest string")
    got = exact.exact_dedup(spark, docs, **kw)
    by_text = {}
    for d, t, *_ in rows:
        by_text.setdefault(norm(t), []).append(d)
    ids = {(r.doc_id, r.text_sha256): r for r in got.collect()}
    for d, t, *_ in rows:
        r = ids[d, hashlib.sha256(norm(t).encode()).hexdigest()]
        same = by_text[norm(t)]
        assert r.group_size == len(same)
        assert r.keep_id == min([x for x in same if x is not None], default=None)
    kept = keep_keys(docs, got.filter("kept").select("rk")).collect()
    assert sorted(norm(r.text) for r in kept) == sorted(by_text)
    return got


def test_recipes_equal_plain_equality(spark):
    rows = [(i, t, i, "c") for i, t in enumerate(texts())]
    rows += [(None, "a b", 1, None), (None, "only null ids", 1, None), (3, "a b", 0, "repeat")]
    check(spark, rows)


def test_colliding_digests_are_widened(spark):
    """One-byte digests collide; the identifiers are then made wider."""
    rnd = random.Random(2)
    rows = [(i, " ".join(str(rnd.random()) for _ in range(3)), 0, "") for i in range(600)]
    rows += [(i + 1000, t, 0, "") for i, t, *_ in rows[:50]]
    check(spark, rows, width=1)


def test_only_repeated_chunks_are_sent(spark):
    rnd = random.Random(6)
    unique = [(i, " ".join(str(rnd.random()) for _ in range(400)), 0, "") for i in range(60)]
    twice = [(i + 100, unique[i][1], 0, "") for i in range(5)]
    docs = spark.createDataFrame(unique + twice, "doc_id long, text string, recipe int, digest string")
    narrow = exact.recipes(docs, 16)
    bits = spark.sparkContext.broadcast(exact.repeated_bits(narrow, 16))
    sent = {bytes(r.digest) for r in exact.chunk_table(docs, 16, bits).collect()}
    want = {d for _, t, *_ in twice for d, _ in exact._chunks(exact.normalise(t.encode()), 16)}
    assert want <= sent and len(sent) <= len(want) + 1


def test_empty(spark):
    assert exact.exact_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
