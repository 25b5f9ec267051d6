"""License places against a plain search of every template at every word."""

import random
import re

from tallyfs.llm import licenses


def plain(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (text or ""))
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    found = []
    for t in licenses.notices():
        for s in range(-len(t["words"]), len(words)):
            if all(0 <= s + at and words[s + at:s + at + len(p)] == p for at, p in t["phrases"]):
                same = sum(0 <= s + k < len(words) and words[s + k] == w for k, w in enumerate(t["words"]))
                found.append((t["label"], t["base"], s, same / len(t["words"])))
    return len(words), sorted(found)


def texts():
    rnd = random.Random(2)
    bits = [t for _, t, _ in licenses.TEMPLATES] + [t for _, t in licenses.BASE]
    out = [None, "", "cc", "CC-BY", "cc by", "x cc BY-NC 4.0", "All rights\nreserved. all RIGHTS reserved", "é cc by", "by cc",
           "free of charge permission is hereby granted", "GNU Lesser General Public License", "cc cc by by cc by" * 3]
    for _ in range(60):
        words = []
        for _ in range(rnd.randrange(1, 6)):
            b = rnd.choice(bits).split()
            words += b if rnd.random() < 0.6 else b[rnd.randrange(len(b)):]
            words += rnd.choices(["the", "of", "cc", "license", "ünï", "x1"], k=rnd.randrange(3))
        out.append(rnd.choice([" ", "-", ", "]).join(w.title() if rnd.random() < 0.3 else w for w in words))
    return out + ["filler " * 50_000 + "released under the MIT license"]


def test_equals_plain_search(spark):
    rows = [(i, t, "w") for i, t in enumerate(texts())] + [(None, "cc by", None), (3, "CC-BY", "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, words string")
    places = licenses.scan(spark, df)
    by_id = {}
    for r in places.collect():
        by_id.setdefault(r.doc_id, []).append((r.n_words, sorted((p.label, p.base, p.start, p.share) for p in r.places)))
    for d, t, _ in rows:
        assert plain(t) in by_id[d], (d, t)
    got = {r.doc_id: r for r in licenses.summary(places).collect()}
    assert (got[0].n_base, got[0].first_word, got[0].labels, got[0].score) == (0, None, "", 0.0)
    assert (got[6].n_base, got[6].first_word, got[6].last_word, got[6].base_labels) == (2, 0, 3, "reserved")
    assert got[5].labels == "cc-by,cc-by-nc"
    assert licenses.scan(spark, df.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "cc by")], "doc_id long, text string")
    plan = licenses.summary(licenses.scan(spark, df))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
