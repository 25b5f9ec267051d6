"""Language of a text as a mixture of languages.

Letters (lower case, runs of other characters as one space) give hashed
character trigrams; their counts per language over all learning rows, smoothed
towards all languages together, are the likelihoods. Expectation-maximisation
estimates a document's language proportions. The set of languages is chosen by
penalised likelihood: languages are added while each raises the log-likelihood
by more than PENALTY times half the logarithm of the number of trigrams.

The number of languages is free. The model sent to the tasks is one entry (12
bytes) for each trigram and language that occur together, and one number for
each trigram and each language; up to DENSE_BYTES the tasks spread it out to
languages x 65,536 single-precision numbers, which gives the same likelihoods.

Defined cases: null texts and texts without a letter are ``und`` with score 0;
ties go to the language first in order; rows with a null lang or null doc_id
are not learned from; with nothing to learn from everything is ``und``;
repeated rows are predicted one by one; other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.llm.common import prepare

BUCKETS = 1 << 16
#: Largest model that the tasks hold as a dense matrix.
DENSE_BYTES = 16 << 20
#: Languages that a learning task counts before it passes its sums on.
HELD_LANGS = 64
ROUNDS = 12
PENALTY = 3.0
#: Weight of the common distribution in each language's, in trigrams.
SMOOTH = 500.0

_ALPHA: np.ndarray | None = None


def _alpha() -> np.ndarray:
    """Which of the first 65,536 characters are letters."""
    global _ALPHA
    if _ALPHA is None:
        _ALPHA = np.array([chr(c).isalpha() for c in range(1 << 16)])
    return _ALPHA


def trigrams(text: str | None) -> np.ndarray | None:
    """Hashed trigrams of a text, or None if it has no letter."""
    if not text:
        return None
    low = text.lower()
    x = np.frombuffer(low.encode("utf-32-le", "replace"), dtype=np.uint32)
    letter = _alpha()[np.minimum(x, 0xFFFF)]
    if x.max() > 0xFFFF:
        far = np.flatnonzero(x > 0xFFFF)
        letter[far] = [chr(c).isalpha() for c in x[far].tolist()]
    if not letter.any():
        return None
    y = np.where(letter, x, 32)
    keep = letter.copy()
    keep[1:] |= letter[:-1]
    y = np.concatenate(([32], y[keep], [32] if letter[-1] else [])).astype(np.uint32)
    h = y[:-2] * np.uint32(0x9E3779B1) + y[1:-1] * np.uint32(0x85EBCA77) + y[2:] * np.uint32(0xC2B2AE3D) if len(y) > 2 \
        else y[:1] * np.uint32(0x9E3779B1)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(16)).astype(np.int64)


class Likelihoods:
    """Likelihoods [trigrams, languages], of which only the entries with
    counts are kept; ``self[ids]`` gives the rows of the trigrams ``ids``."""

    def __init__(self, bucket: np.ndarray, lang: np.ndarray, n: np.ndarray, n_langs: int):
        by_bucket = np.bincount(bucket, weights=n, minlength=BUCKETS)
        order = np.argsort(bucket, kind="stable")
        self.common = (by_bucket + 0.5) / (n.sum() + 0.5 * BUCKETS)
        self.total = np.bincount(lang, weights=n, minlength=n_langs) + SMOOTH
        self.start = np.concatenate(([0], np.cumsum(np.bincount(bucket, minlength=BUCKETS))))
        self.lang, self.n = lang[order].astype(np.int32), n[order].astype(np.int64)
        self.shape = (BUCKETS, n_langs)

    def __getitem__(self, ids: np.ndarray) -> np.ndarray:
        size = self.start[ids + 1] - self.start[ids]
        row = np.repeat(np.arange(len(ids)), size)
        at = np.arange(len(row)) + np.repeat(self.start[ids] - np.cumsum(size) + size, size)
        out = np.repeat(SMOOTH * self.common[ids][:, None], self.shape[1], axis=1)
        out[row, self.lang[at]] += self.n[at]
        return (out / self.total).astype(np.float32)


def learn(spark: SparkSession, rows: DataFrame) -> tuple[list[str], Likelihoods]:
    """(languages, likelihoods) from rows (text, lang)."""

    def run(batches):
        def sums(counts):
            for lang, c in counts.items():
                at = np.flatnonzero(c)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(c[at])],
                                                 names=["lang", "bucket", "n"])

        for b in batches:
            langs = b.column("lang").to_pylist()
            counts: dict[str, np.ndarray] = {}
            for lang, t in zip(langs, b.column("text")):
                g = trigrams(t.as_py())
                if g is not None:
                    if lang not in counts and len(counts) >= HELD_LANGS:
                        yield from sums(counts)
                        counts = {}
                    c = counts.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    c += np.bincount(g, minlength=BUCKETS)
            yield from sums(counts)

    rows = rows.select(F.col("lang").cast("string"), F.col("text").cast("string")).filter("lang is not null")
    langs = sorted(r[0] for r in rows.select("lang").distinct().collect())
    sums = rows.mapInArrow(run, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.toArrow()  # one row per language and trigram that occur together
    lang = pc.index_in(got.column("lang"), value_set=pa.array(langs, pa.string())).to_numpy()
    return langs, Likelihoods(got.column("bucket").to_numpy(), lang, got.column("n").to_numpy(), len(langs))


def mixture(p: np.ndarray, n: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, float]:
    """Proportions of the columns of ``p`` by EM for trigrams with counts
    ``n``, and their log-likelihood."""
    share = np.full(p.shape[1], 1.0 / p.shape[1])
    total = n.sum()
    for _ in range(rounds):
        share = share * ((n / (p @ share)) @ p) / total
    return share, float(n @ np.log(p @ share))


def predict_one(g: np.ndarray, like: np.ndarray) -> tuple[list[int], np.ndarray]:
    """(languages chosen, proportions over all languages)."""
    ids, n = np.unique(g, return_counts=True)
    p, n = like[ids].astype(np.float64), n.astype(np.float64)
    whole, best = mixture(p, n)
    single = n @ np.log(p)
    chosen = [int(np.argmax(single))]
    reached, price = float(single[chosen[0]]), PENALTY * 0.5 * math.log(max(2.0, n.sum()))
    while len(chosen) < p.shape[1] and best - reached > price:
        # whichever language helps most
        trial = [(mixture(p[:, chosen + [k]], n)[1], -k) for k in range(p.shape[1]) if k not in chosen]
        gain, k = max(trial)
        if gain - reached <= price:
            break
        chosen.append(-k)
        reached = gain
    return chosen, whole


def identify(spark: SparkSession, docs: DataFrame, learn_rows: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text) with lang_pred, score (its proportion) and langs
    (the chosen set with proportions, largest first)."""
    prepare(spark)
    langs, like = learn(spark, learn_rows)
    model = spark.sparkContext.broadcast((langs, like))

    def run(batches):
        langs, like = model.value
        if langs and 4 * BUCKETS * len(langs) <= DENSE_BYTES:
            like = like[np.arange(BUCKETS)]
        for b in batches:
            pred, score, sets = [], [], []
            for t in b.column("text"):
                g = trigrams(t.as_py()) if langs else None
                if g is None:
                    pred.append("und")
                    score.append(0.0)
                    sets.append("")
                    continue
                chosen, whole = predict_one(g, like)
                share = whole[chosen] / whole[chosen].sum()
                order = sorted(range(len(chosen)), key=lambda i: (-share[i], langs[chosen[i]]))
                pred.append(langs[chosen[order[0]]])
                score.append(min(1.0, float(whole[chosen[order[0]]])))
                sets.append(",".join(f"{langs[chosen[i]]}:{share[i]:.3f}" for i in order))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(sets, pa.string())], names=["doc_id", "lang_pred", "score", "langs"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double, langs string"))
