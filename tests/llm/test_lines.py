"""Line runs against brute force over all maximal runs."""

import random

import pytest
from pyspark.sql import functions as F

from tallyfs.llm import lines


def brute(rows, min_words):
    """Removed line numbers per row: for every place the longest earlier copy."""
    seqs = []
    for n, (d, t) in enumerate(rows):
        own = [(i, x.strip(" \t\r\x0b\x0c"), len([w for w in x.replace("\t", " ").replace("\r", " ").split(" ") if w]))
               for i, x in enumerate(t.split("\n"))] if t is not None else []
        seqs.append([x for x in own if x[2]])
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))
    places = [(n, i) for n in order for i in range(len(seqs[n]))]
    gone = {n: set() for n in order}
    for p, (n, i) in enumerate(places):
        for m, j in places[:p]:
            k = 0
            while i + k < len(seqs[n]) and j + k < len(seqs[m]) and seqs[n][i + k][1] == seqs[m][j + k][1]:
                k += 1
            if sum(x[2] for x in seqs[n][i:i + k]) >= min_words:
                gone[n] |= {x[0] for x in seqs[n][i:i + k]}
    return gone


@pytest.mark.parametrize("min_words", [1, 3, 4, 9])
def test_equals_brute_force(spark, min_words):
    rnd = random.Random(8)
    pool = ["a", "b c", "d e f", "g h i j k", "l m n o p q r s", "", "  ", "t\tu"]
    rows = []
    for i in range(45):
        body = [rnd.choice(pool) if rnd.random() < 0.5 else f"own {i} {k} line" for k in range(rnd.randrange(0, 9))]
        if rnd.random() < 0.3:
            body += ["x y", "z", "passage of lines", "that repeats", ""][rnd.randrange(2):]
        rows.append((i, "\n".join(body)))
    rows += [(None, "g h i j k\nb c"), (900, None), (901, ""), (902, "\n\n"), (903, "q w e r t\nq w e r t"), rows[3], rows[3]]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, seq int, removed string").coalesce(1)
    got = lines.line_dedup(spark, df, min_words).collect()
    want = brute(rows, min_words)
    have = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", tuple(r.removed)) for r in got)
    assert have == sorted((d is None, d or 0, t or "", tuple(sorted(want[n]))) for n, (d, t) in enumerate(rows))
    for r in got:
        left = None if r.text is None else [x for i, x in enumerate(r.text.split("\n")) if i not in r.removed]
        assert r.clean_text == (None if left is None else "\n".join(left))
        assert r.n_lines == (0 if r.text is None else len(r.text.split("\n")))


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "a b c d\ne"), (2, "a b c d")], "doc_id long, text string")
    plan = lines.line_dedup(spark, df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_empty(spark):
    assert lines.line_dedup(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0
