"""Exact duplicates by content-defined chunk recipes.

Each normalised text is cut where a rolling hash of its last 16 bytes says so,
and every chunk gets an identifier (a digest of its bytes). A text's recipe is
its ordered list of identifiers. Identifiers are verified: the bytes of every
chunk whose digest occurs more than once travel once per task and must be one
and the same; if any digest names two contents, all identifiers are made again
at twice the width. Tasks know the repeated digests by a bit table of fixed size
(a Bloom filter): every repeated digest is in it, and of the others so few that
hardly any byte moves for nothing. Documents are then
equal exactly when their recipes are, so only recipes are compared and joined:
a long text never moves again.

Defined cases: null text counts as empty (an empty recipe); among equal texts
the smallest doc_id stays, null ids last; rows equal in id and text are
repeats of one document of which one row stays; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.llm.common import hot_join, lean, materialize, prepare, row_key

SPACES = re.compile(rb"[\x20\x09-\x0D]+")
WINDOW = 16
#: One place in 1,024 is a cut; a chunk without one is cut every MAX_CHUNK bytes.
CUT_MASK = np.uint32(0x3FF << 20)
MAX_CHUNK = 16_384
SLICE = 1 << 20
DIGEST_BYTES = 16
#: Chunk bytes that a task remembers, to send a repeated chunk once.
SEEN_CHUNKS = 200_000
#: Bits of the table of repeated digests: 8 MB, whatever their number. When it
#: fills up, more chunks than needed travel; none is missed.
BLOOM_BITS = 1 << 26
#: Chunk bytes that leave a task at once.
BATCH_BYTES = 4 << 20


def _gear() -> np.ndarray:
    """256 mixed 32-bit values, one per byte (a multiply-xor mix of the byte)."""
    x = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(32)).astype(np.uint32)


GEAR = _gear()


def cut_points(data: bytes) -> list[int]:
    """Ends of the chunks of ``data``; they depend on content only."""
    n, cuts = len(data), []
    raw = np.frombuffer(data, dtype=np.uint8)
    for lo in range(0, n, SLICE):
        start = max(0, lo - WINDOW + 1)
        h = GEAR[raw[start:lo + SLICE]]
        step = 1
        while step < WINDOW:  # h[i] = sum of gear[i - k] << k, by doubling
            h[step:] += h[:-step] << np.uint32(step)
            step *= 2
        at = np.flatnonzero((h & CUT_MASK) == 0) + start + 1
        cuts.append(at[(at > lo) & (at >= WINDOW)])
    found = np.unique(np.concatenate(cuts + [np.array([n])])) if n else np.array([], dtype=np.int64)
    out, prev = [], 0
    for end in found.tolist():
        while end - prev > MAX_CHUNK:
            prev += MAX_CHUNK
            out.append(prev)
        if end > prev:
            out.append(end)
            prev = end
    return out


def normalise(text: bytes | None) -> bytes:
    return SPACES.sub(b" ", text or b"")


def _chunks(data: bytes, width: int):
    prev = 0
    for end in cut_points(data):
        piece = data[prev:end]
        yield hashlib.blake2b(piece, digest_size=width).digest(), piece
        prev = end


def recipes(docs: DataFrame, width: int = DIGEST_BYTES) -> DataFrame:
    """(doc_id, rk, recipe, text_sha256): recipe holds the identifiers of the
    text's chunks in order, ``width`` bytes each."""

    def run(batches):
        for b in batches:
            rec, sha = [], []
            for t in b.column("text").cast(pa.binary()):
                data = normalise(t.as_py())
                rec.append(b"".join(d for d, _ in _chunks(data, width)))
                sha.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("rk"), pa.array(rec, pa.binary()), pa.array(sha, pa.string())],
                names=["doc_id", "rk", "recipe", "text_sha256"])

    return (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("rk", row_key())
            .mapInArrow(lean(run), "doc_id long, rk string, recipe binary, text_sha256 string"))


def _places(h: int) -> tuple[int, int, int]:
    """The three bits of a digest, from its 64-bit hash."""
    return h & (BLOOM_BITS - 1), h >> 19 & (BLOOM_BITS - 1), h >> 38 & (BLOOM_BITS - 1)


def repeated_bits(narrow: DataFrame, width: int) -> bytes:
    """The bit table of the digests that occur in the recipes more than once."""
    ids = narrow.select(F.explode(F.expr(
        f"transform(sequence(0, greatest(length(recipe) div {width} - 1, 0)), "
        f"i -> substring(recipe, cast(i * {width} + 1 as int), {width}))")).alias("digest")) \
        .filter(F.length("digest") > 0)
    repeated = ids.groupBy("digest").agg(F.count("*").alias("n")).filter("n > 1")
    h, mask = "xxhash64(digest)", BLOOM_BITS - 1
    bit = F.explode(F.expr(f"array({h} & {mask}L, shiftrightunsigned({h}, 19) & {mask}L, shiftrightunsigned({h}, 38) & {mask}L)"))
    words = repeated.select(bit.alias("b")).groupBy(F.expr("b div 64").alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(b % 64 as int))")).alias("bits")).toArrow()  # BLOOM_BITS / 64 rows at most
    table = np.zeros(BLOOM_BITS // 64, dtype=np.int64)
    table[words.column("word").to_numpy()] = words.column("bits").to_numpy()
    return table.astype("<i8").tobytes()


def chunk_table(docs: DataFrame, width: int, bits) -> DataFrame:
    """(digest, chunk) of all documents' chunks that are in the broadcast table
    ``bits``, repeats within a task mostly left out."""

    def run(batches):
        seen: set = set()
        table = bits.value

        def sent(ids, data):
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(data, pa.binary())],
                                              names=["digest", "chunk"])

        for b in batches:
            ids, data, size = [], [], 0
            for t in b.column("text").cast(pa.binary()):
                for d, piece in _chunks(normalise(t.as_py()), width):
                    if not all(table[p >> 3] >> (p & 7) & 1 for p in _places(xxhash.xxh64_intdigest(d, 42))):
                        continue
                    mark = (d, hash(piece))
                    if mark not in seen:
                        if len(seen) >= SEEN_CHUNKS:
                            seen.clear()
                        seen.add(mark)
                        ids.append(d)
                        data.append(piece)
                        size += len(piece)
                        if size >= BATCH_BYTES:
                            yield sent(ids, data)
                            ids, data, size = [], [], 0
            yield sent(ids, data)

    return docs.select(F.col("text").cast("string")).mapInArrow(lean(run), "digest binary, chunk binary")


def collisions(spark: SparkSession, docs: DataFrame, narrow: DataFrame, width: int) -> DataFrame:
    """Digests that stand for more than one content. Only chunks whose digest
    occurs in the recipes more than once can, so only those are sent."""
    bits = spark.sparkContext.broadcast(repeated_bits(narrow, width))
    return (chunk_table(docs, width, bits).groupBy("digest")
            .agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).filter("least != most"))


def exact_dedup(spark: SparkSession, docs: DataFrame, width: int = DIGEST_BYTES) -> DataFrame:
    """One row per document: doc_id, rk, keep_id, group_size, kept, text_sha256.
    ``kept`` marks one row of each group (rows equal in id and text are one)."""
    prepare(spark)
    while True:
        narrow = materialize(spark, recipes(docs, width), "recipes")
        if collisions(spark, docs, narrow, width).isEmpty():
            break
        width *= 2
        if width > 64:
            raise RuntimeError("two contents share a 64-byte digest")
    groups = materialize(spark, narrow.groupBy("recipe").agg(
        F.count("*").alias("group_size"),
        F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "rk")).alias("head")), "recipe_groups")
    return (hot_join(narrow, groups, "recipe", "group_size", "rk")
            .select("doc_id", "rk", F.col("head.doc_id").alias("keep_id"), "group_size",
                    (F.col("rk") == F.col("head.rk")).alias("kept"), "text_sha256"))
