"""How the sources of a language differ: divergence of every pair of sources
over the language's kept terms, and the terms that mark a source.

A group is a (lang, source). Of the V terms that at least ``min_docs`` documents
of a language have, each group gives a term with c occurrences there
``p = 1 + (SCALE * (c + 2)) div (N + 2 V)``, N its occurrences of all kept
terms; the language likewise. Two sources differ in a term by
``f(p, q) = (p - q)^2 div (p + q)``, a pair of sources by the sum over all kept
terms. All arithmetic is in whole numbers.

Most terms occur in few sources, so the sum over all terms is not taken term by
term. With z the p of a term that does not occur in a group, a pair (a, b) is

    V f(za, zb) + sum of f(pa, zb) - f(za, zb) over the terms of a
                + sum of f(za, pb) - f(za, zb) over the terms of b
                + sum of f(pa, pb) - f(pa, zb) - f(za, pb) + f(za, zb)
                  over the terms of both.

The first three come from counts: V, and how often each p occurs in a group. The
pair corrections come from a frequent-pattern tree of the term rows: a row is
the term's nonzero (source, p) in order of the source, equal beginnings are one
path, and a node knows how many rows pass it. A node and an ancestor then stand
for all rows below, whose correction is computed once and counted that often.
Rows are sorted, so the tree of a stretch of them is made level by level from
the lengths of their common beginnings, without pointers.

Terms are counted in the scan (one row per term and language and task, with the
counts of its sources) and shuffled once. Defined cases: null text, lang and
source count as empty; repeated rows and null ids are documents of their own;
groups without terms take part with N = 0; a language without kept terms has
pairs of value 0 and no terms; a giant text is counted by stretches in several
passes of bounded memory; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfs.llm.common import hot_join, lean, materialize, prepare

SCALE = 1_000_000_000
MIN_DOCS = 10
TOP_TERMS = 10
#: A-Z to a-z, every other ASCII character that is no letter to a space.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: Bytes of text split at once; larger texts are counted in as many passes.
STRETCH = 4 << 20
#: Words reduced at once, distinct counts merged at once, words numbered at once.
BLOCK_WORDS = 1_000_000
HELD_COUNTS = 1_500_000
HELD_TERMS = 500_000
#: Rows of one output batch; (node, ancestor) pairs computed at once.
BATCH = 20_000
PAIRS = 400_000
ID_BITS = 40


class _Numbers(dict):
    """Numbers for keys, in order of arrival."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def _merge(keys: np.ndarray, *sums: np.ndarray):
    """Distinct keys and, for each, the sum of every column."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.array([], dtype=np.int64)
    return (keys[first], *(np.add.reduceat(s[order], first) if len(first) else s for s in sums))


class TermCounter:
    """Occurrences and documents of each term per (lang, source), in memory
    that is bounded by the constants above."""

    def __init__(self):
        self._reset()

    def _reset(self):
        self.terms, self.groups = _Numbers(), _Numbers()
        self.block, self.words, self.doc_groups = [], 0, []
        self.counts, self.held = [], 0

    def add(self, lang: str, source: str, data: bytes) -> None:
        data = data.translate(LOWER)
        passes = max(1, math.ceil(len(data) / STRETCH))
        for k in range(passes):  # a pass has the words of one hash class: no word is in two
            self.doc_groups.append(self.groups[lang, source])
            self._one_pass(data, k, passes)
            if self.words >= BLOCK_WORDS or len(self.doc_groups) >= BLOCK_WORDS:
                self._reduce()

    def _one_pass(self, data: bytes, k: int, passes: int) -> None:
        doc, at = len(self.doc_groups) - 1, 0
        while at < len(data):
            end = len(data) if at + STRETCH >= len(data) else data.find(b" ", at + STRETCH)
            end = len(data) if end < 0 else end
            words = data[at:end].split()
            if passes > 1:
                words = [w for w in words if hash(w) % passes == k]
            ids = np.fromiter(map(self.terms.__getitem__, words), dtype=np.int64, count=len(words))
            n = np.ones(len(ids), dtype=np.int64)
            if passes > 1:
                ids, n = _merge(ids, n)
            self.block.append((ids | (doc << ID_BITS), n))
            self.words += len(ids)
            at = end

    def _reduce(self) -> None:
        """The block's words as counts per (group, term)."""
        if self.block:
            keys, n = _merge(*map(np.concatenate, zip(*self.block)))
            groups = np.array(self.doc_groups, dtype=np.int64)[keys >> ID_BITS]
            keys = (keys & ((1 << ID_BITS) - 1)) | (groups << ID_BITS)
            self.counts.append(_merge(keys, n, np.ones(len(keys), dtype=np.int64)))
            self.held += len(self.counts[-1][0])
        self.block, self.words, self.doc_groups = [], 0, []
        if self.held > HELD_COUNTS and len(self.counts) > 1:
            self.counts = [_merge(*map(np.concatenate, zip(*self.counts)))]
            self.held = len(self.counts[0][0])

    def full(self) -> bool:
        return len(self.terms) > HELD_TERMS or self.held > HELD_COUNTS

    def batches(self):
        """What is counted, as rows (lang, term, df, entries); starts anew."""
        self._reduce()
        if self.counts:
            keys, n, df = _merge(*map(np.concatenate, zip(*self.counts)))
            terms, groups = list(self.terms), list(self.groups)
            self._reset()
            langs = _Numbers()
            lang_of = np.array([langs[g[0]] for g in groups], dtype=np.int64)
            group, term = keys >> ID_BITS, keys & ((1 << ID_BITS) - 1)
            order = np.lexsort((term, lang_of[group]))
            group, term, n, df = group[order], term[order], n[order], df[order]
            lang = lang_of[group]
            first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (lang[1:] != lang[:-1]))))
            ends = np.append(first[1:], len(term))
            sources, names = pa.array([g[1] for g in groups], pa.string()), pa.array(list(langs), pa.string())
            for lo in range(0, len(first), BATCH):
                a, b = first[lo:lo + BATCH], ends[lo:lo + BATCH]
                s, e = a[0], b[-1]
                entries = pa.StructArray.from_arrays([sources.take(pa.array(group[s:e])), pa.array(n[s:e])], names=["s", "n"])
                yield pa.RecordBatch.from_arrays(
                    [names.take(pa.array(lang[a])), pa.array([terms[i] for i in term[a].tolist()], pa.binary()),
                     pa.array(np.add.reduceat(df[s:e], a - s)),
                     pa.ListArray.from_arrays(pa.array(np.append(a - s, e - s), pa.int32()), entries)],
                    names=["lang", "term", "df", "entries"])
        self._reset()


def _named(docs: DataFrame) -> DataFrame:
    return docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])


def kept_terms(docs: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(lang, term, source, n, total, first): occurrences of the kept terms per
    group and in the language; ``first`` marks one row of each term."""

    def run(batches):
        counter = TermCounter()
        for b in batches:
            for lang, source, text in zip(*(b.column(c) for c in ("lang", "source", "text"))):
                counter.add(lang.as_py(), source.as_py(), text.as_py())
                if counter.full():
                    yield from counter.batches()
        yield from counter.batches()

    counted = (_named(docs).withColumn("text", F.col("text").cast("binary"))
               .mapInArrow(lean(run), "lang string, term binary, df long, entries array<struct<s:string,n:long>>"))
    # One shuffle: what follows is grouped by (lang, term) or finer.
    entries = (counted.repartition("lang", "term").select("lang", "term", "df", F.posexplode("entries").alias("at", "e")))
    whole = entries.groupBy("lang", "term", F.col("e.s").alias("source")).agg(
        F.sum("e.n").alias("n"), F.sum(F.when(F.col("at") == 0, F.col("df")).otherwise(0)).alias("df"))
    term = Window.partitionBy("lang", "term")  # at most one row per source
    return (whole.select("lang", "term", "source", "n", F.sum("df").over(term).alias("df"), F.sum("n").over(term).alias("total"),
                         (F.min("source").over(term) == F.col("source")).alias("first"))
            .filter(F.col("df") >= min_docs).drop("df"))


def _p(count: str, n: str, v: str):
    return F.expr(f"cast(1 + (cast({SCALE} as decimal(10,0)) * cast({count} + 2 as decimal(20,0))) "
                  f"div cast({n} + 2 * {v} as decimal(20,0)) as long)")


def _f(p: str, q: str) -> str:
    return f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})"


def source_groups(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(lang, source, idx, n, n_terms, v, n_lang, z): every group, numbered
    within its language, z its p of a term that it lacks (null if V = 0)."""
    groups = _named(docs.select("lang", "source", F.lit("").alias("text"))).select("lang", "source").distinct()
    own = terms.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("n_terms"))
    langs = terms.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.sum(F.col("first").cast("long")).alias("v"))
    rows = groups.join(own, ["lang", "source"], "left").join(langs, "lang", "left").na.fill(0)
    return rows.select("lang", "source", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).alias("idx"),
                       "n", "n_terms", "v", "n_lang", F.when(F.col("v") > 0, _p("0", "n", "v")).alias("z"))


def tree_corrections(paths: list[np.ndarray], zeros: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, sum) of the pair corrections of sorted term rows; a row holds
    ``source << 32 | p`` and its z per source. Sources a < b."""
    size = np.array([len(p) for p in paths], dtype=np.int64)
    off = np.concatenate(([0], np.cumsum(size)))
    item, zero = np.concatenate(paths), np.concatenate(zeros)
    # Common beginning of each row with the row before.
    place = np.arange(len(item)) - np.repeat(off[:-1], size)
    before = np.repeat(np.concatenate(([0], off[:-2])), size) + place
    has = place < np.repeat(np.concatenate(([0], size[:-1])), size)
    same = has & (item[np.where(has, before, 0)] == item)
    common = np.minimum.reduceat(np.where(same, np.iinfo(np.int64).max, place), off[:-1])
    common = np.minimum(common, size)
    keys, sums = [np.array([], dtype=np.int64)], [np.array([], dtype=np.int64)]
    span = 1 + int(item.max() >> 32)
    for depth in range(1, int(size.max())):
        # Nodes of this depth: rows that leave the row before at or above it.
        new = np.flatnonzero(common <= depth)
        passing = np.append(new[1:], len(size)) - new
        deep = size[new] > depth
        new, passing = new[deep], passing[deep]
        step = max(1, PAIRS // depth)
        for lo in range(0, len(new), step):
            node = off[new[lo:lo + step]] + depth
            up = off[new[lo:lo + step], None] + np.arange(depth)
            pb, zb = (item[node] & 0xFFFFFFFF)[:, None], zero[node][:, None]
            pa_, za = item[up] & 0xFFFFFFFF, zero[up]
            value = np.zeros(up.shape, dtype=np.int64)
            for p, q, sign in ((pa_, pb, 1), (pa_, zb, -1), (za, pb, -1), (za, zb, 1)):
                value += sign * ((p - q) ** 2 // (p + q))
            value *= passing[lo:lo + step, None]
            k, v = _merge(((item[up] >> 32) * span + (item[node] >> 32)[:, None]).ravel(), value.ravel())
            keys.append(k)
            sums.append(v)
    k, v = _merge(np.concatenate(keys), np.concatenate(sums))
    return k // span, k % span, v


def pair_corrections(placed: DataFrame) -> DataFrame:
    """(lang, a, b, value) from the term rows of all languages; ``placed`` has
    lang, term, idx, p and z."""
    rows = placed.groupBy("lang", "term").agg(F.array_sort(F.collect_list(F.struct("idx", "p", "z"))).alias("row"))  # <= sources
    rows = rows.filter("size(row) > 1").select(
        "lang", F.expr("transform(row, x -> shiftleft(cast(x.idx as long), 32) + x.p)").alias("path"),
        F.expr("transform(row, x -> x.z)").alias("zeros"))

    def run(batches):
        for b in batches:
            langs = b.column("lang").to_pylist()
            lists = [[v.values.to_numpy() for v in b.column(c)] for c in ("path", "zeros")]
            lo = 0
            while lo < len(langs):
                hi = lo
                while hi < len(langs) and langs[hi] == langs[lo]:
                    hi += 1
                x, y, v = tree_corrections(lists[0][lo:hi], lists[1][lo:hi])
                yield pa.RecordBatch.from_arrays([pa.array([langs[lo]] * len(v), pa.string()), pa.array(x, pa.int32()),
                                                  pa.array(y, pa.int32()), pa.array(v)], names=["lang", "a", "b", "value"])
                lo = hi

    return (rows.sortWithinPartitions("lang", "path").mapInArrow(lean(run), "lang string, a int, b int, value long")
            .groupBy("lang", "a", "b").agg(F.sum("value").alias("value")))


def divergence(spark: SparkSession, docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = TOP_TERMS) -> DataFrame:
    """Rows (lang, source, part, item, value, rank). Part ``pair``: every other
    source of the language and how far it is. Part ``term``: the ``top_terms``
    terms that the source uses more than its language does."""
    prepare(spark)
    terms = materialize(spark, kept_terms(docs, min_docs), "divergence_terms")
    groups = materialize(spark, source_groups(docs, terms), "divergence_groups")
    key = F.struct("lang", "source")
    sides = groups.select(key.alias("g"), "idx", "n_terms", "v", "z", F.col("n").alias("n_group"), "n_lang")
    placed = (hot_join(terms.withColumn("g", key), sides, "g", "n_terms", "term")
              .select("lang", "source", "term", "idx", "z", _p("n", "n_group", "v").alias("p"), _p("total", "n_lang", "v").alias("q")))
    placed = materialize(spark, placed, "divergence_placed")

    top = placed.filter("p > q").select("lang", "source", "term", F.expr(_f("p", "q")).alias("value"))
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term")
    top = (top.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top_terms)
           .select("lang", "source", F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value", "rank"))

    one = groups.select("lang", F.col("idx").alias("a"), F.col("source").alias("source_a"), F.col("z").alias("za"), "v")
    two = groups.select("lang", F.col("idx").alias("b"), F.col("source").alias("source_b"), F.col("z").alias("zb"))
    both = materialize(spark, one.join(two, "lang").filter("a != b"), "divergence_pairs")  # the pairs of the result
    base = both.filter("a < b").select("lang", "a", "b", F.expr(f"coalesce(v * ({_f('za', 'zb')}), 0)").alias("value"),
                                       "source_a", "source_b")
    nothing = [F.lit(None).cast("string").alias(c) for c in ("source_a", "source_b")]
    often = placed.groupBy("lang", F.col("idx").alias("a"), "p").agg(F.count("*").alias("times"))
    single = often.join(both, ["lang", "a"]).select(
        "lang", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"),
        F.expr(f"times * ({_f('p', 'zb')} - {_f('za', 'zb')})").alias("value"), *nothing)
    paired = pair_corrections(placed).select("lang", "a", "b", "value", *nothing)
    sums = (base.unionByName(single).unionByName(paired).groupBy("lang", "a", "b")
            .agg(F.sum("value").alias("value"), F.max("source_a").alias("x"), F.max("source_b").alias("y")))
    ways = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")),
                             F.struct(F.col("y").alias("source"), F.col("x").alias("item"))))
    far = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = sums.select("lang", "value", ways.alias("w")).select("lang", "w.source", "w.item", "value") \
        .select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(far).alias("rank"))
    return pairs.unionByName(top)
