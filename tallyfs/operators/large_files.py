"""The last tier of the funnel for large files (D6): blocks before the whole.

Files that share size and prefix are compared by the digests of their blocks,
which many tasks read (``sources/blocks.py``). A file whose root no other has is
no duplicate and is never read by one task. Of the files that share a root, one
(the smallest path) is read from beginning to end for the SHA-256 that names the
group; the others take it over. Thus every byte is read in parallel once, and
one copy of each group a second time, where reading every file whole would make
each of them one task's work.

The one copy is checked while it is read: if it cannot be read, or its root is
no longer the one its blocks gave (it changed in between), the files of its
class are read whole one by one, as small files are.

Defined cases: a file with an unreadable block is an error row; a path that the
table repeats is read once and its rows count as copies; files are taken to have
the size they were listed with.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.operators.duplicates import salted_join
from tallyfs.plans.materialize import materialize
from tallyfs.sources.blocks import BLOCK_BYTES, FAN, block_digests, block_roots, whole_hashes
from tallyfs.sources.readers import full_hash_files
from tallyfs.sources.storage import Store


@dataclass
class LargeFiles:
    """Outcome of the tier; written tables."""

    rows: DataFrame   # path, size, quick_hash, full_hash (null: no duplicate), error
    reads: DataFrame  # (stage, files, bytes): what was read by blocks, once for a class, and one by one


def hash_large_files(spark: SparkSession, files: DataFrame, target_task_bytes: int, block_bytes: int = BLOCK_BYTES,
                     threads: int = 4, store: Store | None = None, fan: int = FAN) -> LargeFiles:
    """Full hashes of those ``files`` (path, size, quick_hash; all in groups of
    equal size and prefix) that have a copy."""
    paths = materialize(spark, files.groupBy("path", "size", "quick_hash").agg(F.count("*").alias("rows")), "large_paths")
    n, total, blocks = paths.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)),
                                 F.coalesce(F.sum(F.expr(f"(size - 1) div {block_bytes} + 1")), F.lit(0))).first()
    digests = materialize(spark, block_digests(paths.select("path", "size"), target_task_bytes, block_bytes, threads,
                                               total_bytes=total, n_blocks=max(1, blocks), store=store), "large_blocks")
    roots = materialize(spark, paths.join(block_roots(digests, fan), ["path", "size"]), "large_roots")

    key = ["size", "quick_hash", "root"]
    classes = materialize(spark, roots.filter("root is not null").groupBy(*key)
                          .agg(F.sum("rows").alias("n"), F.min("path").alias("path")).filter("n >= 2"), "large_classes")
    n_once, once_bytes = classes.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    once = materialize(spark, whole_hashes(classes.select("path", "size"), target_task_bytes, block_bytes, fan, threads,
                                           total_bytes=once_bytes, n_rows=max(1, n_once), store=store), "large_whole")
    named = classes.join(once.select("path", "full_hash", F.col("root").alias("seen"), F.col("error").alias("failed")), "path") \
        .select(*key, "n", F.when(F.col("failed").isNull() & (F.col("seen") == F.col("root")), F.col("full_hash")).alias("full_hash"))
    named = materialize(spark, named, "large_named")
    marked = salted_join(roots, named, key, "n", "left")
    marked = materialize(spark, marked.withColumn("again", F.col("n").isNotNull() & F.col("full_hash").isNull()).drop("n"), "large_marked")

    out = ["path", "size", "quick_hash", "full_hash", "error"]
    done = marked.filter("not again").select(*out, "rows")
    n_again, again_bytes = marked.filter("again").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    if n_again:  # a copy that changed or vanished while the tier ran
        alone = full_hash_files(marked.filter("again").select(*out, "rows"), 0, target_task_bytes, threads,
                                total_bytes=again_bytes, n_rows=n_again, store=store, carry=("rows",))
        done = done.unionByName(alone)
    rows = done.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "rows"))).select(*out)
    reads = spark.createDataFrame([("blocks", n, int(total)), ("once", n_once, int(once_bytes)), ("again", n_again, int(again_bytes))],
                                  "stage string, files bigint, bytes bigint")
    return LargeFiles(materialize(spark, rows, "large_files"), reads)
