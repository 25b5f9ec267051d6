"""Shared helpers: row keys, skew-proof joins, connected components."""

from __future__ import annotations

import ctypes

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.plans.materialize import bounded_broadcast, materialize
from tallyfs.session import ensure_checkpoint_dir, ship_package

__all__ = ["bounded_broadcast", "connected_components", "documents", "hot_join", "free_name", "keep_keys", "lean",
           "materialize", "prepare", "row_key", "lower_ascii", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys with more rows than this are dealt out over SALTS tasks in a join.
HOT_ROWS = 2_000
SALTS = 64
#: Most rows of a side that is broadcast, after counting it.
BROADCAST_ROWS = 200_000


def prepare(spark: SparkSession) -> None:
    """Checkpoint folder set, package importable on the executors."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def lower_ascii(col: Column) -> Column:
    """A-Z to a-z, every other character unchanged."""
    return F.translate(col, UPPER, UPPER.lower())


def release_memory() -> None:
    """Give memory that is free but held back to the system: a worker that
    Spark keeps for the next task should not keep the last one's peak."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """``run`` (batches to batches), with the memory released when it ends."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            release_memory()

    return wrapped


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Key of a row by its id and text; rows equal in both share it."""
    return F.concat_ws("|", F.coalesce(F.col(doc_id).cast("string"), F.lit("null")),
                       F.hex(F.xxhash64(F.col(text))),
                       F.coalesce(F.length(F.col(text)), F.lit(-1)).cast("string"))


def hot_join(rows: DataFrame, keys: DataFrame, on: str, count_col: str, salt_by: str,
             hot_rows: int = HOT_ROWS, salts: int = SALTS, how: str = "inner") -> DataFrame:
    """Join (``how`` inner or left) of member ``rows`` to per-key ``keys`` (one
    row per ``on``, with the member count ``count_col``).

    Members of a key with more than ``hot_rows`` rows are dealt over ``salts``
    tasks by a hash of ``salt_by`` and that key's row is repeated per salt.
    Hot keys number at most rows / hot_rows; the list is broadcast only if it
    counts at most BROADCAST_ROWS.
    """
    key, salt = (free_name(rows, free_name(keys, c)) for c in ("_hot_key", "_salt"))
    hot = keys.filter(F.col(count_col) > hot_rows).select(F.col(on).alias(key))
    hot, _ = bounded_broadcast(hot, BROADCAST_ROWS)
    salted = (rows.join(hot, F.col(on) == F.col(key), "left")
              .withColumn(salt, F.when(F.col(key).isNotNull(),
                                       F.pmod(F.xxhash64(salt_by), F.lit(salts)).cast("int")).otherwise(0))
              .drop(key))
    last = F.when(F.col(count_col) > hot_rows, salts - 1).otherwise(0)
    spread = keys.withColumn(salt, F.explode(F.sequence(F.lit(0), last)))
    return salted.join(spread, [on, salt], how).drop(salt)


def keep_keys(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose :func:`row_key` is in ``keys`` (column ``rk``),
    one row for each key: rows equal in id and text count as one. Of rows that
    differ in other columns, the one whose other columns are the smallest as
    JSON is kept."""
    rk = free_name(docs, "_rk")
    keyed = docs.withColumn(rk, row_key())
    kept = keyed.join(keys.select(F.col("rk").alias(rk)), rk, "left_semi")
    others = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit("")
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), order)
    return kept.groupBy(rk).agg(row.alias("row")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def connected_components(spark: SparkSession, edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b): component is the
    smallest node reachable.

    Large-star / small-star: every round replaces the edges by shorter ones to
    the least neighbour, one written table per step, until nothing changes: read
    four times by the second step, the first would be planned as often. Only a
    row count and a checksum reach the driver.
    """
    cur = materialize(spark, edges.filter("a != b")
                      .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    before = None
    for _ in range(max_rounds):
        mark = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(mark) == before or mark[0] == 0:
            break
        before = tuple(mark)
        both = cur.unionByName(cur.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = (both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(cur.join(least, "a").filter("a > m").select("a", F.col("m").alias("b"))).distinct())
        large = materialize(spark, large, "cc_large")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionByName(least.select("a", F.col("m").alias("b"))).distinct())
        cur = materialize(spark, small, "cc")
    else:
        raise RuntimeError("components did not settle")
    roots = cur.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component"))
    return roots.unionByName(cur.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
