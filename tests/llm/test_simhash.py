"""SimHash: fingerprints against a plain count, links against all pairs."""

import itertools
import random

import numpy as np
import pytest
import xxhash

from tallyfs.llm import simhash

MASK = (1 << 64) - 1


def plain_fingerprint(text, k=3):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    w = [x for x in low.split(" ") if x]
    if not w:
        return 0
    sh = [" ".join(w[i:i + k]) for i in range(len(w) - k + 1)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(items, linked):
    root = {x: x for x in items}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(items, 2):
        if linked(a, b):
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    return {x: find(x) for x in items}


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a B", "x y z", "É a\x0bB \xa0 c", "w " * 50])
def test_fingerprint(text):
    raw = None if text is None else text.encode()
    assert simhash.fingerprint(raw) == plain_fingerprint(text)


def test_fingerprint_in_blocks(monkeypatch):
    text = " ".join(random.Random(3).choice("abcdefgh") for _ in range(500))
    monkeypatch.setattr(simhash, "BLOCK", 7)
    assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)


@pytest.mark.parametrize("max_bits", [0, 1, 2, 3])
@pytest.mark.parametrize("bucket_rows", [4096, 20])
def test_links_equal_all_pairs(spark, monkeypatch, max_bits, bucket_rows):
    """Random families: dense ones (few free bits) and chains; with a small
    bucket size every level of division is used."""
    rnd, fps = random.Random(7), set()
    for _ in range(40):
        base = rnd.getrandbits(64)
        for _ in range(rnd.choice([1, 2, 6])):
            x = base
            for _ in range(rnd.randrange(5)):
                x ^= 1 << rnd.randrange(64)
            fps.add(x)
    base, at = rnd.getrandbits(64), rnd.sample(range(64), 9)
    for _ in range(150):  # a dense family
        fps.add(base ^ sum(1 << b for b in at if rnd.random() < 0.5))
    fps = sorted(fps)
    expect = components(fps, lambda a, b: (a ^ b).bit_count() <= max_bits)
    monkeypatch.setattr(simhash, "BUCKET_ROWS", bucket_rows)
    signed = [int(np.uint64(x).astype(np.int64)) for x in fps]
    points = spark.createDataFrame([(s, i) for i, s in enumerate(signed)], "fp long, node long")
    links = simhash.near_links(spark, points, max_bits).collect()
    assert all((fps[r.a] ^ fps[r.b]).bit_count() <= max_bits for r in links)
    pairs = {(min(r.a, r.b), max(r.a, r.b)) for r in links}
    got = components(range(len(fps)), lambda a, b: (a, b) in pairs)
    assert {fps[i]: fps[c] for i, c in got.items()} == expect


def test_dedup_edge_rows(spark):
    rows = [(5, "a b c d e", "x"), (3, "A  b c d e", "y"), (3, "A  b c d e", "z"), (None, "a b c d e", "x"),
            (9, None, None), (7, "", "q"), (8, "something else entirely here", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string")  # a clashing name
    got = simhash.simhash_dedup(spark, docs).collect()
    comp = {(r.doc_id, r.fp): r.component_id for r in got}
    assert len(got) == len(rows)
    assert {c for (d, _), c in comp.items() if d in (5, 3, None)} == {3}
    assert {c for (d, _), c in comp.items() if d in (9, 7)} == {7}
    kept = sorted(r.doc_id for r in got if r.kept)
    assert kept == [3, 3, 7, 8]  # both equal rows carry the mark; keep_keys makes one of them
    assert simhash.simhash_dedup(spark, docs.limit(0)).count() == 0
