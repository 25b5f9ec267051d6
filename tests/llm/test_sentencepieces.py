"""Encoding equals the library's on whole texts, at every chunk size."""

import random

import pytest
import sentencepiece

from tallyfs.llm import sentencepieces as sp

LIB = sentencepiece.SentencePieceProcessor(model_file=sp.MODEL)


def texts():
    rnd = random.Random(4)
    words = ["the", "Encoding", "naïve", "für", "日本語", "🙂", "x" * 30, "a\nb", "\t", "123456", "▁", "=====", "", " ", "ñandú"]
    out = ["", None, " ", "   ", "a", " a", "a ", "a  b   c", "\n\n", "▁", "a▁b", " ", "🙂" * 200, "ab" * 500, "aaaa" * 300,
           "日本語" * 150, " " * 500, "=" * 400, "\x00\x01"]
    for n in (5, 50, 400):
        out += [" ".join(rnd.choice(words) for _ in range(n)) for _ in range(6)]
    out += ["".join(rnd.choice("abcdeorstin") for _ in range(700)) for _ in range(4)]  # no certain place at all
    return out


@pytest.mark.parametrize("chunk,spread", [(64, 64), (64, 300), (100, 100), (sp.CHUNK, sp.SPREAD)])
def test_equals_library(spark, monkeypatch, chunk, spread):
    monkeypatch.setattr(sp, "FAN", 3)  # several levels
    rows = [(i, t, "s", 7) for i, t in enumerate(texts())] + [(0, "", None, None), (None, "a b " * 60, "s", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, idx int")
    got = sp.decode(spark, sp.encode(spark, docs, chunk=chunk, spread=spread, verify=True)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.token_ids == (LIB.encode(r.text) if r.text else []), (r.doc_id, r.text[:40])
        assert r.decoded == (r.text or "").replace("▁", " ")
        assert r.round_trip
        assert r.decoded == LIB.decode(r.token_ids)


def test_empty_table_and_null_ids(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert sp.encode(spark, docs).count() == 0
    rows = spark.createDataFrame([(None,), ([],), ([130, 131],)], "token_ids array<int>")
    assert [r.decoded for r in sp.decode(spark, rows).collect()] == [None, "", "\x7f�"]


@pytest.mark.parametrize("chunk", [64, 100, 1000])
def test_scan_of_one_text(chunk):
    """All chunks of a text in one task; the number of chunks as reported."""
    pieces = sp.Pieces(sp.load_model())
    around = pieces.longest
    for t in texts():
        if t:
            marked = sp.MARK + t.replace(" ", sp.MARK)
            assert sp.scan_text(pieces, marked, around, chunk) == LIB.encode(t), t[:40]
            parts = sp.cut(marked, around, chunk)
            assert "".join(s[left:left + core] for s, left, core, _, _ in parts) == marked
            assert len(parts) == max(1, (len(t) + chunk - around) // chunk)


def test_longer_texts_of_the_tables_go_through_the_scan(spark):
    from tallyfs.llm.queries import op6_sentencepiece

    got = op6_sentencepiece(spark, "/root/testdata/sf0.01").collect()
    assert sum(r.n_chunks > 1 for r in got) >= 5 and all(r.round_trip for r in got)


def test_combine_is_associative():
    rnd = random.Random(1)

    def m():
        return {(rnd.randrange(4), rnd.randrange(4)): float(rnd.randrange(9)) for _ in range(8)}

    for _ in range(50):
        a, b, c = m(), m(), m()
        assert sp.combine(sp.combine(a, b), c) == sp.combine(a, sp.combine(b, c))
