"""SimHash near-duplicates by deletion-variant signatures.

Two fingerprints at most 3 bits apart, cut into two segments, have one segment
that differs by at most one bit. Every segment is indexed once for each of its
bit positions with that bit masked out (one wildcard), so such a pair meets in
an equality bucket and is verified there on all 64 bits.

A bucket of very many fingerprints (a large family of near copies) is divided
again by the same rule on the half that is still free: 64 -> 32 -> 16 -> 8
bits. After three levels at most 11 bits of a bucket are free, so no bucket
holds more than 2,048 fingerprints whatever the data. Buckets give a spanning
forest of their links, never all pairs.

Defined cases: null text counts as empty; a text without words has fingerprint
0 and is linked like any other; a text of fewer words than a shingle is one
shingle; a null doc_id never names a component unless all ids in it are null;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.llm.common import connected_components, hot_join, lean, materialize, prepare, row_key

SEED = 42
BITS = 64
#: Bits voted on at a time, so that a giant text needs bounded memory.
BLOCK = 1 << 17
#: A bucket with more rows is divided again (the last level holds 2^11 at most).
BUCKET_ROWS = 4096
#: Runs up to this length are compared lag by lag, longer ones by search.
SMALL_RUN = 16


def fingerprint(text: bytes | None, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text over word shingles, as unsigned int."""
    words = (text or b"").lower().split()  # bytes: lowers A-Z, splits at \x20 \x09-\x0D
    if not words:
        return 0
    norm = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(norm, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[: len(words) - shingle + 1].tolist()
    stops = (ends[shingle - 1:] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(BITS, dtype=np.int64)
    for k in range(0, len(starts), BLOCK):
        part = [digest(norm[s:e], SEED) for s, e in zip(starts[k:k + BLOCK], stops[k:k + BLOCK])]
        raw = np.array(part, dtype="<u8").view(np.uint8).reshape(len(part), 8)
        total += np.unpackbits(raw, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(total * 2 > len(starts), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, rk, fp): one row per document; fp is the fingerprint's bits as
    a signed long, rk the row's key."""

    def run(batches):
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            fps = np.array([fingerprint(t.as_py(), shingle) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("rk"), pa.array(fps.view(np.int64))],
                                             names=["doc_id", "rk", "fp"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
            .withColumn("rk", row_key())
            .mapInArrow(lean(run), "doc_id long, rk string, fp long"))


def _variants(rows: DataFrame, width: int) -> DataFrame:
    """Every row once per (half of the free ``width`` bits, masked position):
    key (bucket), slot, off (where the free bits start afterwards)."""
    half = width // 2
    mask = (1 << half) - 1
    slots = rows.withColumn("slot", F.explode(F.expr(f"sequence(0, {width - 1})")))
    part = f"(shiftrightunsigned(fp, cast(off + (slot div {half}) * {half} as int)) & {mask}L)"
    masked = f"({part} & ~shiftleft(1L, slot % {half}))"
    return slots.select(F.expr(f"xxhash64(key, slot, {masked})").alias("key"),
                        F.expr(f"cast(off + (1 - slot div {half}) * {half} as int)").alias("off"),
                        F.expr("cast(off + slot as int)").alias("bit"),
                        F.expr(f"cast(slot % {half} = 0 as boolean)").alias("first"), "fp", "node")


def _links(max_bits: int, width: int, last: bool):
    """Partition function over rows sorted by key: verified links (a, b) of
    small buckets, and the rows of over-full ones (``again``)."""
    half = width // 2

    def linked(x, bit, first):
        """Of xors: near enough, and met here only: in this half the pair
        differs at the wildcard's bit, or nowhere and this is the half's first
        slot."""
        lo = bit - bit % half
        d = (x >> lo.astype(np.uint64)) & np.uint64((1 << half) - 1)
        return (np.bitwise_count(x) <= max_bits) & ((d != 0) | first)

    def run(batches):
        names = ["key", "off", "bit", "first", "fp", "node"]
        held: list = []  # rows of the run that the last batch ended in

        def out(a=(), b=(), again=None):
            a, b = np.asarray(a, dtype=np.int64), np.asarray(b, dtype=np.int64)
            n = len(a)
            if again is None:
                cols = [pa.array(a), pa.array(b)] + [pa.nulls(n, t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64())]
            else:
                n = len(again["fp"])
                cols = [pa.nulls(n, pa.int64())] * 2 + [pa.array(again[c]) for c in ("key", "off", "fp", "node")]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key", "off", "fp", "node"])

        def whole_runs(t):
            """Results of rows that hold whole runs only."""
            key, fp, node = t["key"], t["fp"].view(np.uint64), t["node"]
            cut = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
            size = np.diff(np.append(cut, len(key)))
            small = np.repeat(size <= SMALL_RUN, size)
            for lag in range(1, SMALL_RUN):
                i = np.flatnonzero(small[:-lag] & (key[lag:] == key[:-lag]))
                if not len(i):
                    break
                ok = linked(fp[i] ^ fp[i + lag], t["bit"][i], t["first"][i])
                if ok.any():
                    yield out(node[i[ok]], node[i[ok] + lag])
            for s, n in zip(cut[size > SMALL_RUN].tolist(), size[size > SMALL_RUN].tolist()):
                if n > BUCKET_ROWS and not last:
                    yield out(again={c: t[c][s:s + n] for c in ("key", "off", "fp", "node")})
                    continue
                left, a, b = np.arange(s + 1, s + n), [], []
                queue = [s]
                while len(left):
                    if not queue:
                        queue, left = [int(left[0])], left[1:]
                        continue
                    v = queue.pop()
                    near = linked(fp[left] ^ fp[v], t["bit"][left], t["first"][left])
                    found = left[near]
                    a += [node[v]] * len(found)
                    b += node[found].tolist()
                    queue += found.tolist()
                    left = left[~near]
                if a:
                    yield out(a, b)

        over = None  # key of a run already known to be over-full
        for batch in batches:
            t = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in names}
            if held:
                t = {c: np.concatenate([h[c] for h in held] + [t[c]]) for c in names}
                held = []
            if not len(t["key"]):
                continue
            tail = int(np.searchsorted(t["key"], t["key"][-1], side="left"))
            if over is not None:  # the run goes on
                n = int(np.searchsorted(t["key"], over, side="right"))
                if n:
                    yield out(again={c: t[c][:n] for c in ("key", "off", "fp", "node")})
                if n == len(t["key"]):
                    continue
                t, tail, over = {c: v[n:] for c, v in t.items()}, max(0, tail - n), None
            if tail:
                yield from whole_runs({c: v[:tail] for c, v in t.items()})
            rest = {c: v[tail:] for c, v in t.items()}
            if len(rest["key"]) > BUCKET_ROWS and not last:
                yield out(again={c: rest[c] for c in ("key", "off", "fp", "node")})
                over = rest["key"][0]
            else:
                held = [rest]
        if held:
            yield from whole_runs(held[0])

    return run


def near_links(spark: SparkSession, points: DataFrame, max_bits: int = 3) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``points``
    (distinct fp, node) at most ``max_bits`` (0 to 3) bits apart."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments with one wildcard cover at most 3 bits")
    rows = points.select(F.lit(0).cast("long").alias("key"), F.lit(0).alias("off"), "fp", "node")
    found, width = None, BITS
    while True:
        last = width == 16  # 53 bits fixed: 2,048 rows at most
        res = (_variants(rows, width).repartition("key").sortWithinPartitions("key")
               .mapInArrow(lean(_links(max_bits, width, last)),
                           "a long, b long, key long, off int, fp long, node long"))
        res = materialize(spark, res, "simhash_links")
        links = res.filter("a is not null").select("a", "b")
        found = links if found is None else found.unionByName(links)
        rows = res.filter("a is null").select("key", "off", "fp", "node")
        width //= 2
        if last or rows.isEmpty():
            return found


def simhash_dedup(spark: SparkSession, docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: doc_id, rk, fp (signed long), component_id (the
    smallest doc_id reachable through links, itself included), kept (true for
    one row of each component: the smallest doc_id, nulls last; rows equal in
    id and text are one)."""
    prepare(spark)
    fps = materialize(spark, fingerprints(docs, shingle), "simhash_fp")
    # Of equal fingerprints one stands for all. Its node is a number of its own,
    # as ids may be null or repeat.
    points = materialize(spark, fps.groupBy("fp").agg(
        F.count("*").alias("n"),
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rk")).alias("least")), "simhash_points")
    comp = connected_components(spark, near_links(
        spark, points.select("fp", F.col("fp").alias("node")), max_bits))
    classed = points.join(comp, points.fp == comp.node, "left").select(
        "fp", "n", "least", F.coalesce("component", "fp").alias("comp"))
    classed = materialize(spark, classed, "simhash_classes")
    heads = classed.groupBy("comp").agg(F.min("least").alias("head"), F.count("*").alias("n_fp"))
    by_fp = hot_join(classed.select("fp", "n", "comp"), heads, "comp", "n_fp", "fp")
    return (hot_join(fps, by_fp.select("fp", "n", "head"), "fp", "n", "rk")
            .select("doc_id", "rk", "fp", F.col("head.doc_id").alias("component_id"),
                    (F.col("rk") == F.col("head.rk")).alias("kept")))
