"""License scans by a positional rare-token index.

Templates are short licence notices; their words and positions are postings.
Inverse document frequencies of the licence words come from the whole table;
each template is looked up by its rarest mandatory word, wherever a file has
it. A posting's position places the template; the placement must put the
template's next rarest mandatory word where the file has it, then every mandatory phrase is verified word by word. Since a
template needs all its mandatory words, looking up its rarest loses nothing.
The score is the share of the template's words that stand at their places.

A file keeps its words in one row throughout: lookups are a join with the
bounded list of postings, and nothing but found places is shuffled. Only
DataFrame functions are used.

Defined cases: null text counts as empty; a file without a place has null first
and last word, empty labels and score 0; repeated rows are scanned one by one;
other columns are ignored.
"""

from __future__ import annotations

from math import log

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.llm.common import lower_ascii, prepare

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: label, notice, mandatory phrases (fixed values; every phrase occurs once in its notice).
BASE = [("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved")]
TEMPLATES = [
    ("apache", "licensed under the apache license version 2 0", ["apache license"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software",
     ["permission is hereby granted", "free of charge"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     ["redistribution and use in source and binary forms"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "cc0 1 0 universal public domain dedication", ["cc0 1 0"]),
    ("gnu-gpl", "licensed under the gnu general public license version 3", ["gnu general public license"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("mpl", "mozilla public license version 2 0", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     ["permission to use copy modify and or distribute"]),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ["free and unencumbered software", "public domain"]),
    ("warranty", "the software is provided as is without warranty of any kind", ["without warranty of any kind"]),
]


def notices() -> list[dict]:
    """Templates as dicts: label, base, words, phrases [(start, words)]."""
    out = []
    for label, text, phrases in [(a, t, [t]) for a, t in BASE] + TEMPLATES:
        words = text.split()
        found = []
        for p in phrases:
            w = p.split()
            at = [i for i in range(len(words) - len(w) + 1) if words[i:i + len(w)] == w]
            assert len(at) == 1, (label, p)
            found.append((at[0], w))
        out.append({"label": label, "base": (label, text) in BASE, "words": words, "phrases": found})
    return out


def file_words(docs: DataFrame) -> DataFrame:
    """(doc_id, words) of every row."""
    text = lower_ascii(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.select(F.col("doc_id").cast("long"), F.regexp_extract_all(text, F.lit(WORD), 0).alias("words"))


def word_idf(files: DataFrame, words: list[str]) -> dict[str, float]:
    """Inverse document frequency of the given words over all files."""
    seen = files.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, words)))).alias("w"))
    df = {r.w: r["count"] for r in seen.groupBy("w").count().collect()}  # as many rows as licence words
    n = files.count()
    return {w: log((n + 1) / (df.get(w, 0) + 1)) for w in words}


def postings(idf: dict[str, float]) -> list[dict]:
    """One posting per template: its rarest mandatory word (``anchor``, the one
    that is looked up) and the next rarest with its distance, the notice and
    its phrases."""
    rows = []
    for t in notices():
        must = sorted({s + i for s, p in t["phrases"] for i in range(len(p))})
        rank = sorted(must, key=lambda i: (-idf[t["words"][i]], i))
        first, second = rank[0], rank[1]
        rows.append({"anchor": t["words"][first], "anchor_at": first, "other": t["words"][second],
                     "other_off": second - first, "label": t["label"], "base": t["base"], "notice": t["words"],
                     "phrases": t["phrases"]})
    return rows


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, places (array of label, base,
    start, share), start counted in words from 0."""
    prepare(spark)
    files = file_words(docs)
    licence = sorted({w for t in notices() for w in t["words"]})
    # All postings of a word together: a few dozen templates, a literal of the plan.
    by_word: dict[str, list[dict]] = {}
    for r in postings(word_idf(files, licence)):
        by_word.setdefault(r["anchor"], []).append(r)

    def text(words):
        return F.array(*map(F.lit, words))

    def posting(r):
        phrases = [F.struct(F.lit(at).alias("at"), text(words).alias("words")) for at, words in r["phrases"]]
        return F.struct(F.array(*phrases).alias("phrases"), text(r["notice"]).alias("notice"),
                        *[F.lit(r[k]).alias(k) for k in ("anchor_at", "other", "other_off", "label", "base")])

    index = F.create_map(*[x for w, rs in sorted(by_word.items()) for x in (F.lit(w), F.array(*map(posting, rs)))])
    anchors = F.array(*map(F.lit, sorted(by_word)))
    # The places of the rare words, then the templates placed there.
    hits = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(anchors, w), F.struct(w.alias("w"), i.alias("i")))),
                    lambda h: h.isNotNull())
    files = files.withColumn("_hits", F.when(F.arrays_overlap("words", anchors), hits))
    placed = F.expr("flatten(transform(_hits, h -> transform(_index[h.w], t -> struct(t as t, h.i as i, h.i - t.anchor_at as start))))")
    agree = "filter(_placed, p -> get(words, p.i + p.t.other_off) = p.t.other)"
    verified = (f"filter({agree}, p -> forall(p.t.phrases, q -> p.start + q.at >= 0 and "
                "slice(words, p.start + q.at + 1, size(q.words)) = q.words))")
    share = ("size(filter(sequence(0, size(p.t.notice) - 1), k -> get(words, p.start + k) = p.t.notice[k])) / size(p.t.notice)")
    found = (f"transform({verified}, p -> struct(p.t.label as label, p.t.base as base, p.start as start, {share} as share))")
    none = "cast(array() as array<struct<label:string,base:boolean,start:int,share:double>>)"
    return (files.withColumn("_index", index).withColumn("_placed", F.when(F.col("_hits").isNotNull(), placed))
            .select("doc_id", F.size("words").cast("long").alias("n_words"),
                    F.expr(f"coalesce({found}, {none})").alias("places")))


def summary(places: DataFrame) -> DataFrame:
    """The digest of :func:`scan`: base counts and places, labels, score."""
    base = "filter(places, p -> p.base)"

    def labels(of: str) -> str:
        return f"array_join(array_sort(array_distinct(transform({of}, p -> p.label))), ',')"

    return places.select(
        "doc_id", "n_words", F.expr(f"cast(size({base}) as bigint)").alias("n_base"),
        F.expr(f"cast(array_min(transform({base}, p -> p.start)) as bigint)").alias("first_word"),
        F.expr(f"cast(array_max(transform({base}, p -> p.start)) as bigint)").alias("last_word"),
        F.expr(labels(base)).alias("base_labels"), F.expr(labels("places")).alias("labels"),
        F.expr("coalesce(array_max(transform(places, p -> p.share)), 0.0D)").alias("score"))
