"""The audit against a walk of every document through every order."""

import itertools
import random
from collections import Counter

import numpy as np
import pytest

from tallyfs.llm import filter_audit as fa

SCHEMA = "doc_id long, text string, lang string, part string, failed int, digest string, n int, good boolean"
LABELS = "doc_id long, quality int, toxic int, n int"


def corpus():
    rnd = random.Random(11)
    rows = []
    for i in range(160):
        n = rnd.choice([0, 1, 60, 99, 100, 101, 180])
        words = [f"w{rnd.randrange(400 if rnd.random() < 0.5 else 20)}é" for _ in range(n)]
        if rnd.random() < 0.3:
            words = [w.upper() + "ABC" for w in words]
        text = rnd.choice([" ", "\n", "\t \x0b", "\x0c\r"]).join(words) + rnd.choice(["", "", "#", "|$"])
        rows.append([i, text, rnd.choice(["en", "de", None, ""])])
    for i in range(160, 240):  # copies, also across languages, and repeated ids
        rows.append([rnd.choice([i, rnd.randrange(160)]), rows[rnd.randrange(160)][1], rnd.choice(["en", "de", None])])
    rows += [[None, rows[3][1], "en"], [None, None, "fr"], [500, None, "en"], [501, "", "en"], [7, rows[7][1], "en"],
             [502, rows[3][1] + " x", "en"], [503, "same Words " * 4000, "de"], [504, "same Words " * 4000, "de"]]
    labels = [(i, rnd.randrange(2), rnd.randrange(2), 1) for i in range(0, 240, 2)] + [(0, 1, 0, 0), (None, 1, 1, 0), (3, None, None, 0)]
    return [tuple(r) for r in rows], labels


def spaces(text):
    out = [""]
    for ch in text:
        if ch in " \t\n\x0b\x0c\r":
            out.append("")
        else:
            out[-1] += ch
    return [w for w in out if w]


def brute(rows, labels):
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(least.get(t or "", i), i)
    good = {i for i, q, _, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x, _ in labels if x == 1 and i is not None}
    docs = []
    for i, t, lang in rows:
        t, w = t or "", spaces(t or "")
        fails = {c for c, bad in zip("ABCDE", (len(w) < 100, 100 * len(set(w)) < 80 * len(w),
                                               100 * sum("A" <= c <= "Z" for c in t) > 10 * len(t),
                                               any(c in "#$%&*|" for c in t), i is not None and least[t] < i)) if bad}
        docs.append((lang or "", fails, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        mine = [d for d in docs if d[0] == part]
        total = Counter()
        for order in itertools.permutations("ABCDE"):
            left = mine
            for k, c in enumerate(order, 1):
                gone = [d for d in left if c in d[1]]
                left = [d for d in left if c not in d[1]]
                total[c] += len(gone)
                out[part, "".join(order), k] = [len(left), len(gone), sum(c in d[1] for d in mine) - len(gone),
                                                sum(d[1] == {c} for d in mine), sum(d[2] for d in gone), sum(d[3] for d in gone), c]
        for key, row in out.items():
            if key[0] == part:
                row[6] = total[row[6]]
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("stretch", [4 << 20, 100])
def test_equals_brute_force(spark, monkeypatch, stretch):
    monkeypatch.setattr(fa, "STRETCH", stretch)
    monkeypatch.setattr(fa, "HELD_PARTS", 1)
    rows, labels = corpus()
    docs = spark.createDataFrame([(*r, "p", 1, "d", 5, True) for r in rows], SCHEMA)
    got = fa.audit(spark, docs, spark.createDataFrame(labels, LABELS)).collect()
    assert {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in got} == brute(rows, labels)
    assert len(got) == 600 * 4


def test_popcount_is_exact():
    rnd = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 4, 5, 26, 1000, 4097):
        words = rnd.integers(0, 1 << 32, n, dtype=np.uint32)
        times = rnd.integers(1, 12, n)
        want = [int(((words.astype(np.int64) >> b & 1) * times).sum()) for b in range(32)]
        assert fa.positional_popcount(words, times).tolist() == want
        assert fa.positional_popcount(words, np.ones(n, dtype=np.int64)).tolist() == [
            int((words >> np.uint32(b) & 1).sum()) for b in range(32)]


def test_giant_text_in_stretches():
    data = b"alpha beta\tgamma " * 5000 + b"x" * 3000 + b" \n" + b" ".join(b"u%d" % i for i in range(3000))
    want = (len(data.split()), len(set(data.split())))
    for size in (64, 1000, 1 << 20):
        assert fa.word_counts(data, size) == want
    assert b"".join(fa.stretches(data, 100)) == data and fa.word_counts(b"", 4) == (0, 0)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    labels = spark.createDataFrame([], LABELS)
    assert fa.audit(spark, docs, labels).count() == 0
    one = fa.audit(spark, spark.createDataFrame([(1, None, None, "", 0, "", 0, None)], SCHEMA), labels).collect()
    assert len(one) == 600 and {r.part for r in one} == {""} and sum(r.removed for r in one) == 120
