"""Duplicates of a tree that is scanned again and again.

The state holds one narrow row per eligible file: path, size, time and the
hashes it has been read for so far. A new scan is merged with it by path; a file
whose size and time are as before keeps its hashes. Then the funnel runs over
the merged rows, but reads only what is still unknown *and* needed: the first
8 KB of files whose size is shared (new files, and older ones whose size has
only now become shared), the whole of files whose prefix is shared and that were
not read whole before. Groups therefore equal those of a full run on all files,
while the bytes read follow the change, not the tree.

Every tier is one partial aggregation that finds the keys with unread members
and one left join with these few keys; hot sizes and hashes are salted. The new
state is written as the next version of a ``VersionedTable`` and swapped in at
the end: a run that dies leaves the old state in force.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.operators.duplicates import PathReader, eligible_files, salted_join
from tallyfs.plans.materialize import materialize
from tallyfs.plans.versioned import VersionedTable
from tallyfs.sources.readers import full_hash_files, quick_hash_files

STATE_SCHEMA = "path string, size bigint, mtime timestamp, quick_hash string, full_hash string, error string"
COLUMNS = ["path", "size", "mtime", "quick_hash", "full_hash", "error"]


@dataclass
class Update:
    """Outcome of one update; all tables are written ones."""

    files: DataFrame    # the state: one row per eligible file
    groups: DataFrame   # (full_hash, size, copies) over all of them
    reads: DataFrame    # (stage, files, bytes) that this update read
    version: int


def merge_scan(state: DataFrame, inv: DataFrame, complete: bool) -> DataFrame:
    """State rows after a scan, hashes kept where size and time are the same.
    ``complete``: the scan saw the whole tree, so what it lacks is gone;
    otherwise it adds to the state."""
    now = eligible_files(inv).select("path", F.col("size").alias("now_size"), F.col("mtime").alias("now_mtime"),
                                     F.lit(True).alias("now"))
    rows = now.join(state, "path", "left" if complete else "full_outer")
    seen = F.coalesce("now", F.lit(False))
    same = ~seen | (F.col("size").eqNullSafe(F.col("now_size")) & F.col("now_mtime").isNotNull()
                    & F.col("mtime").eqNullSafe(F.col("now_mtime")))
    return rows.select("path", F.when(seen, F.col("now_size")).otherwise(F.col("size")).alias("size"),
                       F.when(seen, F.col("now_mtime")).otherwise(F.col("mtime")).alias("mtime"),
                       *[F.when(same, F.col(c)).alias(c) for c in ("quick_hash", "full_hash")],
                       F.lit(None).cast("string").alias("error"))


def _open_keys(rows: DataFrame, on: list[str], unread: str) -> DataFrame:
    """Keys of two or more files of which some still have no ``unread`` hash."""
    return (rows.groupBy(*on).agg(F.count("*").alias("n"), F.count_if(F.col(unread).isNull()).alias("todo"))
            .filter("n >= 2 and todo > 0").drop("todo"))


def _mark(spark: SparkSession, rows: DataFrame, on: list[str], unread: str, name: str) -> tuple[DataFrame, int, int]:
    """``rows`` with ``read`` (to be read now), their number and bytes."""
    keys = materialize(spark, _open_keys(rows.filter(" and ".join(f"{c} is not null" for c in on)), on, unread), f"{name}_keys")
    marked = salted_join(rows, keys, on, "n", "left").withColumn(
        "read", F.col("n").isNotNull() & F.col(unread).isNull()).drop("n")
    marked = materialize(spark, marked, name)
    n, size = marked.filter("read").agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    return marked, int(n), int(size)


def update_duplicates(spark: SparkSession, base: str, inv: DataFrame, reader: PathReader | None = None,
                      complete: bool = True) -> Update:
    """Bring the state below ``base`` up to the scan ``inv`` (an inventory by
    path) and return the duplicates of all its files."""
    reader = reader or PathReader()
    table = VersionedTable(spark, base)
    before = table.current()
    state = table.read("files", STATE_SCHEMA)
    if state is None:
        state = spark.createDataFrame([], STATE_SCHEMA)
    rows = materialize(spark, merge_scan(state, inv, complete), "dup_merged")

    marked, n, _ = _mark(spark, rows, ["size"], "quick_hash", "dup_sizes")
    part = marked.filter("read").select("path", "size", "mtime")
    rows = marked.filter("not read").select(*COLUMNS)
    if n:
        read = quick_hash_files(part, reader.prefix_bytes, reader.files_per_task, reader.io_threads, n_rows=n,
                                store=reader.store, carry=("mtime",))
        rows = rows.unionByName(read)
    rows = materialize(spark, rows, "dup_prefixes")
    reads = [("quick_hash", n, int(part.agg(F.coalesce(F.sum(F.least("size", F.lit(reader.prefix_bytes))), F.lit(0))).first()[0]))]

    marked, n, size = _mark(spark, rows, ["size", "quick_hash"], "full_hash", "dup_hashes")
    part = marked.filter("read").select(*COLUMNS)
    rows = marked.filter("not read").select(*COLUMNS)
    if n:
        rows = rows.unionByName(full_hash_files(part, reader.prefix_bytes, reader.target_task_bytes, reader.io_threads,
                                                total_bytes=size, n_rows=n, store=reader.store, carry=("mtime",)))
    reads.append(("full_hash", n, size))

    folder = table.begin()
    rows.write.mode("errorifexists").parquet(f"{folder}/files")
    version = table.commit(folder, after=before[0] if before else None)
    files = spark.read.schema(STATE_SCHEMA).parquet(f"{folder}/files")
    groups = (files.filter("full_hash is not null").groupBy("full_hash", "size").agg(F.count("*").alias("copies"))
              .filter("copies >= 2"))
    return Update(files, groups, spark.createDataFrame(reads, "stage string, files bigint, bytes bigint"), version)
