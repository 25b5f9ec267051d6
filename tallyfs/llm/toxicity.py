"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic function
of a bias and the weights of its distinct words; a word's weight is the sum of
its features' (the word and its first three to six letters). A sentence without
any feature of the model scores 0, so that thousands of plain sentences add
nothing. The document's
score is the noisy-or of its sentences, 1 - prod(1 - p), and the weights are
fitted to document labels alone by gradient descent on that likelihood. The
sentences with a score of one half or more are the offending ones.

Learning: over all labelled rows, documents with each feature are counted by
label, exactly and for every feature (each task sums its own first); every one
that stands out for the toxic label is kept.
The weights are fitted on all labelled rows: the clean ones collapse into their
distinct sentence bags with counts (their loss is a sum over bags), toxic ones
into their distinct lists of bags, which leaves every sum as it is. Each step's
gradient is summed over these, by the tasks or, for up to DRIVER_ENTRIES
features in bags, on the driver (the same sums). The driver otherwise holds one
weight per feature.

Defined cases: null and empty texts have no sentence and score 0; rows without
label or doc_id are not learned from; without a toxic or a clean row to learn
from every score is 0; repeated rows are scored one by one; other columns are
ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.llm.common import materialize, prepare

SENTENCE = re.compile(r"[^.!?\n]+")
WORD = re.compile(r"[^\W\d_]+")
PREFIXES = (3, 4, 5, 6)
#: Features that a task counts before it passes its sums on.
HELD = 1 << 19
#: Standard errors by which a feature must stand out.
LEAST_Z = 4.5
CACHE = 400_000
EPOCHS, RATE = 400, 0.1
#: Weight of the prior a row, and at most in all: rare words are not shrunk
#: further because the table is larger.
DECAY, PRIOR = 2e-5, 0.4
#: Most entries of bags that are fitted on the driver (4 bytes each, worked on
#: about BLOCK_ENTRIES at a time); more stay on the executors.
DRIVER_ENTRIES = 16_000_000
BLOCK_ENTRIES = 1 << 19


def features(word: str) -> tuple[str, ...]:
    return (word + "$", *(word[:k] for k in PREFIXES if k <= len(word)))


class _Cache(dict):
    """word -> value, at most CACHE entries."""

    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        v = self[word] = self.make(word)
        return v


def choose_features(rows: DataFrame, n_pos: int, n_neg: int) -> list[str]:
    """The features of ``rows`` (text, toxic) that stand out for the toxic
    label: the signed root of the likelihood ratio of a feature's documents
    against the labels' shares is LEAST_Z or more."""

    def counted(batches):
        at: dict[str, int] = {}
        ids = _Cache(lambda w: tuple(at.setdefault(f, len(at)) for f in features(w)))
        n = np.zeros((2, 1 << 16), dtype=np.int64)

        def sums():
            fs = list(at)
            return pa.RecordBatch.from_arrays([pa.array(fs, pa.string()), pa.array(n[1, :len(fs)]), pa.array(n[0, :len(fs)])],
                                              names=["f", "pos", "neg"])

        for b in batches:
            for t, y in zip(b.column("text"), b.column("toxic").to_pylist()):
                words = set(WORD.findall((t.as_py() or "").lower()))
                got = np.unique(np.array([i for w in words for i in ids[w]], dtype=np.int64))
                if len(at) > n.shape[1]:
                    n = np.concatenate([n, np.zeros((2, max(n.shape[1], len(at) - n.shape[1])), dtype=np.int64)], axis=1)
                n[y, got] += 1
                if len(at) >= HELD:
                    yield sums()
                    at.clear()
                    ids.clear()
                    n[:] = 0
        yield sums()

    share = n_pos / (n_pos + n_neg)
    n = F.col("pos") + F.col("neg")
    ratio = (F.when(F.col("pos") > 0, F.col("pos") * F.log(F.col("pos") / (n * share))).otherwise(0.0)
             + F.when(F.col("neg") > 0, F.col("neg") * F.log(F.col("neg") / (n * (1 - share)))).otherwise(0.0))
    best = (rows.mapInArrow(counted, "f string, pos long, neg long").groupBy("f")
            .agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
            .filter(F.col("pos") > n * share).withColumn("z", F.sqrt(2 * F.greatest(ratio, F.lit(0.0))))
            .filter(F.col("z") >= LEAST_Z))
    return sorted(best.select("f").toArrow().column("f").to_pylist())


def bags(rows: DataFrame, feats: list[str]) -> DataFrame:
    """(toxic, n, times, size, feat): what the likelihood needs of ``rows``,
    equal parts once.

    The loss of a clean document is a sum over its sentence bags, so clean rows
    become one row per distinct bag of all of them, with how often it occurs
    (``times``; n is 1). A toxic document needs its bags together: one row per
    distinct list of bags, with how often each occurs, and the number ``n`` of
    documents that have this list. ``size`` holds the entries of each bag,
    ``feat`` the entries of all. Documents without features of the model are
    left out.
    """
    sent = rows.sparkSession.sparkContext.broadcast({f: i for i, f in enumerate(feats)})

    def run(batches):
        at = sent.value
        own = _Cache(lambda w: tuple(at[f] for f in features(w) if f in at))
        longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
        for b in batches:
            clean: dict[tuple[int, ...], int] = {}
            lists: dict[tuple, int] = {}
            for t, y in zip(b.column("text"), b.column("toxic").to_pylist()):
                found: dict[tuple[int, ...], int] = {} if y else clean
                for s in SENTENCE.findall((t.as_py() or "").lower()):
                    bag = tuple(sorted(f for w in set(WORD.findall(s)) for f in own[w]))
                    if bag:
                        found[bag] = found.get(bag, 0) + 1
                if y and found:
                    key = tuple(sorted(found.items()))
                    lists[key] = lists.get(key, 0) + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array([0] * len(clean) + [1] * len(lists), pa.int32()),
                 pa.array([*clean.values(), *lists.values()], pa.int64()),
                 pa.array([[]] * len(clean) + [[k for _, k in key] for key in lists], longs),
                 pa.array([[len(k)] for k in clean] + [[len(k) for k, _ in key] for key in lists], ints),
                 pa.array(list(clean) + [[f for k, _ in key for f in k] for key in lists], ints)],
                names=["toxic", "n", "times", "size", "feat"])

    equal = (rows.mapInArrow(run, "toxic int, n long, times array<long>, size array<int>, feat array<int>")
             .groupBy("toxic", "times", "size", "feat").agg(F.sum("n").alias("n")))
    clean = F.col("toxic") == 0  # a clean bag's times are its sum, not part of its key
    return equal.select("toxic", F.when(clean, F.lit(1)).otherwise(F.col("n")).cast("long").alias("n"),
                        F.when(clean, F.array("n")).otherwise(F.col("times")).alias("times"), "size", "feat")


def parts(table: pa.Table) -> tuple[np.ndarray, ...]:
    """Of the rows of :func:`bags`: label and number of each, row and times
    of each bag, bag and feature of each entry."""
    # straight from the Arrow lists: no Python object per entry
    times, size, feat = (pa.concat_arrays(table.column(c).chunks).flatten().to_numpy() for c in ("times", "size", "feat"))
    per_doc = pa.compute.list_value_length(table.column("times")).to_numpy()
    docs = np.repeat(np.arange(len(per_doc), dtype=np.int32), per_doc)
    return (table.column("toxic").to_numpy(), table.column("n").to_numpy(), docs, times,
            np.repeat(np.arange(len(size), dtype=np.int32), size), feat)


def gradient(held: tuple[np.ndarray, ...], w: np.ndarray, b: float) -> np.ndarray:
    """Gradient of the negative log-likelihood by weights and, last, bias."""
    y, n, docs, times, sents, feats = held
    z = np.clip(b + np.bincount(sents, weights=w[feats], minlength=len(docs)), -30, 30)
    # log of the probability that no sentence offends
    none = np.bincount(docs, weights=-times * np.logaddexp(0, z), minlength=len(y))
    none = np.minimum(none, -1e-12)
    # d loss / d none: 1 - y clean, else -e^none / (1 - e^none)
    g = n * np.where(y > 0, np.exp(none) / -np.expm1(none), -1.0)
    gz = -g[docs] * times / (1 + np.exp(-z))
    return np.append(np.bincount(feats, weights=gz[sents], minlength=len(w)), gz.sum())


def summed_gradient(bagged: DataFrame, w: np.ndarray, b: float) -> np.ndarray:
    """:func:`gradient` over a table of bags, summed by the tasks."""
    model = bagged.sparkSession.sparkContext.broadcast((w, b))

    def run(batches):
        w, b = model.value
        g = np.zeros(len(w) + 1)
        for batch in batches:
            if batch.num_rows:
                g += gradient(parts(pa.Table.from_batches([batch])), w, b)
        at = np.flatnonzero(g)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(g[at])], names=["f", "g"])

    got = bagged.mapInArrow(run, "f long, g double").groupBy("f").agg(F.sum("g").alias("g")).toArrow()  # one row per feature
    model.unpersist()
    out = np.zeros(len(w) + 1)
    out[got.column("f").to_numpy()] = got.column("g").to_numpy()
    return out


def held_gradient(blocks: list[pa.Table], w: np.ndarray, b: float) -> np.ndarray:
    """:func:`gradient` over the same rows in blocks, summed here."""
    g = np.zeros(len(w) + 1)
    for block in blocks:
        g += gradient(parts(block), w, b)
    return g


def fit(bagged: DataFrame, n_features: int, n_rows: int) -> tuple[np.ndarray, float]:
    """Weights and bias that maximise the noisy-or likelihood of the labels."""
    entries = bagged.agg(F.sum(F.size("feat").cast("long") + F.size("size"))).first()[0] or 0
    if not entries:
        return np.zeros(n_features), -6.0
    if entries <= DRIVER_ENTRIES:
        table = bagged.toArrow()
        upto = np.cumsum(pa.compute.list_value_length(table.column("feat")).to_numpy(), dtype=np.int64)
        cuts = np.unique(np.concatenate([[0], np.searchsorted(upto, np.arange(BLOCK_ENTRIES, upto[-1], BLOCK_ENTRIES)), [len(table)]]))
        held = [table.slice(k, m - k) for k, m in zip(cuts[:-1].tolist(), cuts[1:].tolist())]
        step_of = lambda w, b: held_gradient(held, w, b)
    else:
        step_of = lambda w, b: summed_gradient(bagged, w, b)
    decay = min(DECAY, PRIOR / n_rows)
    w, b = np.zeros(n_features), -6.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, EPOCHS + 1):
        grad = step_of(w, b) / n_rows
        grad[:-1] += decay * w
        grad[-1] += decay * (b + 6)
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        move = RATE * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-10)
        w -= move[:-1]
        b -= move[-1]
    return w, float(b)


def train(spark: SparkSession, rows: DataFrame) -> tuple[dict[str, float], float]:
    """(weights by feature, bias) from rows (doc_id, text, toxic 0 or 1)."""
    rows = rows.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("toxic").cast("int").alias("toxic"))
    counts = {r.toxic: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n_neg, n_pos = counts.get(0, 0), counts.get(1, 0)
    if not n_pos or not n_neg:
        return {}, float("-inf")
    feats = choose_features(rows, n_pos, n_neg)
    w, b = fit(materialize(spark, bags(rows, feats), "tox_bags"), len(feats), n_pos + n_neg)
    return dict(zip(feats, w.tolist())), b


def score(spark: SparkSession, docs: DataFrame, weights: dict[str, float], bias: float) -> DataFrame:
    """(doc_id, score, offending): the noisy-or score and the offending
    sentences as (start, stop, score), places in characters."""
    model = spark.sparkContext.broadcast((weights, bias))

    def run(batches):
        weights, bias = model.value
        own = _Cache(lambda w: sum(weights.get(f, 0.0) for f in features(w)))
        spans = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("score", pa.float64())]))
        for b in batches:
            scores, found = [], []
            for t in b.column("text"):
                none, here = 0.0, []
                text = t.as_py() or ""
                low = text.lower()
                if len(low) != len(text):  # so that places are those of the text
                    low = "".join(c if len(c.lower()) != 1 else c.lower() for c in text)
                for s in SENTENCE.finditer(low):
                    words = set(WORD.findall(s.group()))
                    if not words:
                        continue
                    z = 0.0
                    for w in words:
                        z += own[w]
                    if z == 0.0:
                        continue
                    z = min(30.0, max(-30.0, bias + z))
                    none -= float(np.logaddexp(0, z))
                    if z >= 0:
                        here.append({"start": s.start(), "stop": s.end(), "score": 1 / (1 + float(np.exp(-z)))})
                scores.append(-float(np.expm1(none)))
                found.append(here)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores, pa.float64()), pa.array(found, spans)],
                                             names=["doc_id", "score", "offending"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .mapInArrow(run, "doc_id long, score double, offending array<struct<start:int,stop:int,score:double>>"))


def toxicity(spark: SparkSession, docs: DataFrame, labelled: DataFrame) -> DataFrame:
    """Scores of ``docs`` by a model learned from ``labelled`` (doc_id, text,
    toxic)."""
    prepare(spark)
    rows = labelled.filter("toxic in (0, 1) and doc_id is not null").select("doc_id", "text", "toxic")
    return score(spark, docs, *train(spark, materialize(spark, rows, "tox_rows")))
