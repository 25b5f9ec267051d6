"""How filters act together: survivors of every subset of five filters, and
from them every order's removals, redundancies and shares.

Each document is judged by each filter once. Its failures are five bits, and
its truth-table survival word has bit S set if the document passes all filters
of subset S (32 subsets, 32 bits). How many documents survive subset S is then
the number of words with bit S set: a positional popcount, taken per part and
label by carry-save adders. Three words of one weight become a sum word of that
weight and a carry word of the next, 32 counters at once, until one word is left
per weight; its bits are the counters' bits. A word that stands for n documents
enters at the weights of n's bits. Tasks return 32 counts per part and label,
one aggregation adds them, and every order of filters is a walk through the 32
sums.

Filters, by what fails a text (null: empty): A fewer than 100 words; B fewer
distinct words than 80 % of the words; C more A-Z letters than 10 % of the code
points; D a character of ``#$%&*|``; E a smaller doc_id has the same text.
Words are stretches without ASCII white space, compared case-sensitively.

Equal texts are found by SHA-256. Defined cases: a null doc_id is never smaller
than another and none is smaller than it, so such a row never fails E; rows of
one doc_id and text are no copies of each other; a document is good (toxic) if
any ``labels`` row of its doc_id says so; part is the language, null as the
empty string; an empty table has no parts and no rows; a giant text is split
into words by stretches, its distinct words counted in several passes of
bounded memory; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import itertools
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.llm.common import hot_join, lean, materialize, prepare

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
MIN_WORDS = 100
DISTINCT_PERCENT = 80
UPPER_PERCENT = 10
SYMBOLS = b"#$%&*|"
UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes that follow the first one of a code point.
CONTINUED = bytes(range(0x80, 0xC0))
SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: Bytes of text split into words at once, and whose distinct words are held.
STRETCH = 4 << 20
#: Parts that a task counts before it hands their sums on.
HELD_PARTS = 10_000

#: Survival word of each set of failed filters: bit S is set if S has none of them.
WORDS = np.array([sum(1 << s for s in range(SUBSETS) if not s & failed) for failed in range(SUBSETS)], dtype=np.uint32)
BITS = np.arange(SUBSETS, dtype=np.uint32)


def stretches(data: bytes, size: int):
    """``data`` in stretches of about ``size`` bytes; words stay whole."""
    at = 0
    while at < len(data):
        space = SPACE.search(data, at + size) if at + size < len(data) else None
        end = space.start() if space else len(data)
        yield data[at:end]
        at = end


def word_counts(data: bytes, size: int | None = None) -> tuple[int, int]:
    """(words, distinct words). Of a giant text, each pass holds the distinct
    words of one hash class."""
    size = size or STRETCH
    if len(data) <= size:
        words = data.split()  # bytes split at exactly these six spaces
        return len(words), len(set(words))
    n = sum(len(part.split()) for part in stretches(data, size))
    classes, distinct = math.ceil(len(data) / size), 0
    for c in range(classes):
        seen: set = set()
        for part in stretches(data, size):
            seen.update(w for w in part.split() if hash(w) % classes == c)
        distinct += len(seen)
    return n, distinct


def failures(data: bytes) -> int:
    """Bits of the filters A to D that the text fails."""
    n, distinct = word_counts(data)
    upper = len(data) - len(data.translate(None, UPPER))
    points = len(data.translate(None, CONTINUED))
    return ((n < MIN_WORDS) | (100 * distinct < DISTINCT_PERCENT * n) << 1 | (100 * upper > UPPER_PERCENT * points) << 2
            | (len(data.translate(None, SYMBOLS)) < len(data)) << 3)


def _one_weight(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of one weight as one word (or none) of it and carries of the next."""
    carries = []
    while len(x) >= 3:
        k = len(x) // 3
        a, b, c = x[:k], x[k:2 * k], x[2 * k:3 * k]
        u = a ^ b
        carries.append((a & b) | (u & c))
        x = np.concatenate((u ^ c, x[3 * k:]))
    if len(x) == 2:
        carries.append(x[:1] & x[1:])
        x = x[:1] ^ x[1:]
    return x, np.concatenate(carries) if carries else x[:0]


def positional_popcount(words: np.ndarray, times: np.ndarray) -> np.ndarray:
    """How many words have each bit set, ``words[i]`` counted ``times[i]`` times."""
    counts = np.zeros(SUBSETS, dtype=np.int64)
    top = int(times.max()).bit_length() if len(times) else 0
    carried, weight = words[:0], 0
    while weight < top or len(carried):
        x, carried = _one_weight(np.concatenate((carried, words[(times >> weight) & 1 == 1])))
        if len(x):
            counts += ((x[0] >> BITS) & 1).astype(np.int64) << weight
        weight += 1
    return counts


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, part, failed, digest) of every row: failures of A to D."""

    def run(batches):
        for b in batches:
            failed, digest = [], []
            for t in b.column("text"):
                data = t.as_py() or b""
                failed.append(failures(data))
                digest.append(hashlib.sha256(data).digest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("part"), pa.array(failed, pa.int32()), pa.array(digest, pa.binary())],
                names=["doc_id", "part", "failed", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
                       F.col("text").cast("string").cast("binary").alias("text")) \
        .mapInArrow(lean(run), "doc_id long, part string, failed int, digest binary")


def with_copies(judged: DataFrame, spark: SparkSession) -> DataFrame:
    """``failed`` with filter E: another row of the text has a smaller doc_id."""
    firsts = materialize(spark, judged.groupBy("digest").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))
                         .filter("n > 1"), "audit_copies")
    copy = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int")
    return (hot_join(judged, firsts, "digest", "n", "doc_id", how="left")
            .select("doc_id", "part", (F.col("failed") + copy * (1 << FILTERS.index("E"))).alias("failed")))


def survivors(rows: DataFrame) -> DataFrame:
    """(part, subset, n, good, toxic): documents that survive each subset, from
    rows (part, good, toxic, failed, n)."""

    def run(batches):
        held: dict[tuple, np.ndarray] = {}

        def out():
            keys, sums = list(held), list(held.values())
            flat = np.concatenate(sums) if sums else np.array([], dtype=np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1) * SUBSETS, pa.int32()), pa.array(flat))
            batch = pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.bool_()),
                 pa.array([k[2] for k in keys], pa.bool_()), lists], names=["part", "good", "toxic", "counts"])
            held.clear()
            return batch

        for b in batches:
            parts = b.column("part").dictionary_encode()
            good, toxic = (b.column(c).to_numpy(zero_copy_only=False) for c in ("good", "toxic"))
            group = parts.indices.to_numpy().astype(np.int64) * 4 + good * 2 + toxic
            order = np.argsort(group, kind="stable")
            words, times = WORDS[b.column("failed").to_numpy()], b.column("n").to_numpy()
            for run_of in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                i = run_of[0]
                key = (parts.dictionary[int(group[i]) // 4].as_py(), bool(good[i]), bool(toxic[i]))
                held[key] = held.get(key, 0) + positional_popcount(words[run_of], times[run_of])
            if len(held) > HELD_PARTS:
                yield out()
        yield out()

    counted = (rows.select("part", "good", "toxic", "failed", "n")
               .mapInArrow(lean(run), "part string, good boolean, toxic boolean, counts array<long>"))
    each = counted.select("part", "good", "toxic", F.posexplode("counts").alias("subset", "n"))
    return each.groupBy("part", "subset").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("good"), F.col("n")).otherwise(0)).alias("good"),
        F.sum(F.when(F.col("toxic"), F.col("n")).otherwise(0)).alias("toxic"))


def _steps() -> tuple:
    """Of every order and step: the order, the step, the filter's bit, and the
    filters before it as bits."""
    rows = [("".join(order), k + 1, 1 << FILTERS.index(x), sum(1 << FILTERS.index(y) for y in order[:k]))
            for order in itertools.permutations(FILTERS) for k, x in enumerate(order)]
    return tuple(np.array(c) for c in zip(*rows))


def order_table(n: np.ndarray, good: np.ndarray, toxic: np.ndarray) -> dict[str, np.ndarray]:
    """The 600 rows of a part from its survivors per subset."""
    order, step, bit, before = _steps()
    after, whole = before | bit, SUBSETS - 1
    removed = n[before] - n[after]
    share = {}
    for x in range(len(FILTERS)):
        b, rest = 1 << x, [s for s in range(SUBSETS) if not s >> x & 1]
        share[b] = sum(math.factorial(s.bit_count()) * math.factorial(len(FILTERS) - 1 - s.bit_count()) * int(n[s] - n[s | b])
                       for s in rest)
    return {"filter_order": order, "step": step.astype(np.int32), "kept": n[after], "removed": removed,
            "redundant": (n[0] - n[bit]) - removed, "unique_fails": n[whole ^ bit] - n[whole],
            "good_lost": good[before] - good[after], "toxic_lost": toxic[before] - toxic[after],
            "shapley": np.array([share[b] for b in bit.tolist()], dtype=np.int64)}


RESULT = ("part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, "
          "good_lost long, toxic_lost long, shapley long")


def audit(spark: SparkSession, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, order of the five filters and step: documents kept
    after the step, removed by it, failing it but removed earlier
    (``redundant``), failing it only (``unique_fails``), good and toxic ones
    among the removed, and ``shapley``, its removals summed over all orders."""
    prepare(spark)
    judged = materialize(spark, judge(docs), "audit_judged")
    # Rows of one doc_id that share part and failures count as one row times n:
    # no doc_id, null included, is more than a few rows in the join.
    rows = with_copies(judged, spark).groupBy("doc_id", "part", "failed").agg(F.count("*").alias("n"))
    marks = (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("quality") == 1, F.lit(False)).alias("q"),
                           F.coalesce(F.col("toxic") == 1, F.lit(False)).alias("t")).filter("doc_id is not null and (q or t)")
             .groupBy("doc_id").agg(F.max("q").alias("good"), F.max("t").alias("toxic")))
    labelled = rows.join(marks, "doc_id", "left").select(
        "part", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"), "failed", "n")
    per_part = survivors(labelled).groupBy("part").agg(
        F.array_sort(F.collect_list(F.struct("subset", "n", "good", "toxic"))).alias("counts"))  # 32 entries

    def run(batches):
        for b in batches:
            for r in b.to_pylist():
                n, good, toxic = (np.array([c[k] for c in r["counts"]], dtype=np.int64) for k in ("n", "good", "toxic"))
                t = order_table(n, good, toxic)
                size = len(t["step"])
                yield pa.RecordBatch.from_arrays([pa.array([r["part"]] * size, pa.string()), *map(pa.array, t.values())],
                                                 names=["part", *t])

    return per_part.mapInArrow(run, RESULT)
