"""Divergence against sums over all terms; the tree against all pairs."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tallyfs.llm import divergence as dv

SCHEMA = "doc_id long, text string, lang string, source string, term string, idx int, n long, z long"


def corpus():
    rnd = random.Random(3)
    words = [f"{a}{b}" for a in "abcdefgh" for b in ("É", "straße", "x", "tt", "ô")]
    rows = []
    for i in range(220):
        lang, source = rnd.choice([("en", "s"), ("en", f"s{rnd.randrange(6)}"), ("de", f"s{rnd.randrange(3)}"), ("fr", "only"),
                                   (None, None), ("", "s1")])
        pool = words[:rnd.choice([3, 15, 40])]
        rows.append((i, rnd.choice([" ", "-", "1", "\n"]).join(rnd.choice(pool) for _ in range(rnd.randrange(40))), lang, source))
    rows += [(None, None, "en", "silent"), (None, "", "xx", "a"), (None, "", "xx", "b"), (5, rows[5][1], rows[5][2], rows[5][3]),
             (900, "Aéx " * 3000, "en", "big"), (901, "ONCE", "de", None)]
    return rows


def brute(rows, min_docs, top):
    docs = defaultdict(list)
    for _, text, lang, source in rows:
        t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        docs[lang or ""].append((source or "", Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t))))
    out = set()
    f = lambda p, q: (p - q) * (p - q) // (p + q)
    for lang, mine in docs.items():
        kept = sorted(t for t, n in Counter(t for _, c in mine for t in c).items() if n >= min_docs)
        v, counts = len(kept), defaultdict(Counter)
        for s, c in mine:
            counts[s].update({t: n for t, n in c.items() if t in set(kept)})
        whole = sum(counts.values(), Counter())
        p = {s: {t: 1 + 10**9 * (c[t] + 2) // (sum(c.values()) + 2 * v) for t in kept} for s, c in counts.items()}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(whole.values()) + 2 * v) for t in kept}
        for s in counts:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in counts if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if counts[s][t] > 0 and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out |= {(lang, s, part, item, value, k) for k, (item, value) in enumerate(found[:most], 1)}
    return out


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    """Also with every bound so small that it binds."""
    if small:
        for name, value in (("STRETCH", 50), ("BLOCK_WORDS", 30), ("HELD_COUNTS", 20), ("HELD_TERMS", 9), ("BATCH", 2), ("PAIRS", 3)):
            monkeypatch.setattr(dv, name, value)
    rows = corpus()
    df = spark.createDataFrame([(*r, "t", 1, 2, 3) for r in rows], SCHEMA)
    got = dv.divergence(spark, df, min_docs=4, top_terms=5)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute(rows, 4, 5)


def test_no_kept_terms_and_empty_table(spark):
    df = spark.createDataFrame([(*r, "t", 1, 2, 3) for r in corpus()], SCHEMA)
    assert {tuple(r) for r in dv.divergence(spark, df, min_docs=10_000).collect()} == brute(corpus(), 10_000, 10)
    assert dv.divergence(spark, df.limit(0)).count() == 0


def test_tree_corrections():
    """Each node and ancestor once, as often as rows pass the node."""
    rnd = random.Random(8)
    zeros = [rnd.randrange(1, 50) for _ in range(7)]
    rows = []
    for _ in range(300):
        sources = sorted(rnd.sample(range(7), rnd.randrange(1, 7)))
        rows.append([(s << 32) + zeros[s] + rnd.randrange(1, 4) for s in sources])
    rows.sort()
    want = Counter()
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for r in rows:
        for i, x in enumerate(r):
            for y in r[i + 1:]:
                a, b, pa, pb = x >> 32, y >> 32, x & 0xFFFFFFFF, y & 0xFFFFFFFF
                want[a, b] += f(pa, pb) - f(pa, zeros[b]) - f(zeros[a], pb) + f(zeros[a], zeros[b])
    a, b, v = dv.tree_corrections([np.array(r) for r in rows], [np.array([zeros[x >> 32] for x in r]) for r in rows])
    assert {(x, y): n for x, y, n in zip(a.tolist(), b.tolist(), v.tolist())} == dict(want)
