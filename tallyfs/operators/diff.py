"""Comparing two scans of the same tree (J3, announced by the reference).

A full outer join on path of the file rows of both scans; each path is
``added``, ``removed``, ``changed`` (size or modification time differs) or
``unchanged``. Paths are unique per scan, so the join has no hot key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfs.operators.aggregates import files_only
from tallyfs.plans.materialize import materialize


def scan_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, size_before, size_after) for every file of either scan."""
    a = files_only(before).select("path", F.col("size").alias("size_before"), F.col("mtime").alias("_mt_a"))
    b = files_only(after).select("path", F.col("size").alias("size_after"), F.col("mtime").alias("_mt_b"))
    in_a = F.col("_in_a")
    in_b = F.col("_in_b")
    j = (a.withColumn("_in_a", F.lit(True))
         .join(b.withColumn("_in_b", F.lit(True)), "path", "full_outer"))
    status = (F.when(in_a.isNull(), F.lit("added"))
              .when(in_b.isNull(), F.lit("removed"))
              .when(~F.col("size_before").eqNullSafe(F.col("size_after"))
                    | ~F.col("_mt_a").eqNullSafe(F.col("_mt_b")), F.lit("changed"))
              .otherwise(F.lit("unchanged")))
    return j.select("path", status.alias("status"), "size_before", "size_after")


def diff_summary(diff: DataFrame) -> DataFrame:
    """(status, files, bytes_before, bytes_after)."""
    return diff.groupBy("status").agg(
        F.count(F.lit(1)).alias("files"),
        F.coalesce(F.sum("size_before"), F.lit(0)).cast("long").alias("bytes_before"),
        F.coalesce(F.sum("size_after"), F.lit(0)).cast("long").alias("bytes_after"))


def rank_in_groups(rows: DataFrame, group: list[str], order: str) -> DataFrame:
    """``rows`` with ``rank``: the place of a row in its group by ``order``,
    from 1, however large the group.

    Rows are range-partitioned by group and order, so a large group lies in
    several partitions; a row's rank is its place within its partition's part
    of the group plus the sizes of the parts before (one row per partition and
    group). No window sees more than a partition.
    """
    ranged = materialize(rows.sparkSession, rows.repartitionByRange(*group, order).withColumn("_part", F.spark_partition_id()),
                         "ranged")
    part = ranged.groupBy(*group, "_part").agg(F.count("*").alias("_size"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    part = part.select(*group, "_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    local = ranged.withColumn("_place", F.row_number().over(Window.partitionBy("_part", *group).orderBy(order)))
    return local.join(part, [*group, "_part"]).withColumn("rank", F.col("_place") + F.col("_before")) \
        .drop("_part", "_place", "_before")


def scan_moves(before: DataFrame, after: DataFrame) -> DataFrame:
    """(path, status, path_before, size) for every file of either scan that is
    not where it was: ``moved``, ``added`` or ``removed``.

    Both inventories carry ``full_hash``. A file that is gone and one that is
    new are one moved file if size and hash are equal; of several, the first
    gone (by path) pairs with the first new, and so on. Files without a hash
    are never paired.
    """
    def narrow(inv: DataFrame) -> DataFrame:
        return files_only(inv).select("path", "size", "full_hash")

    spark = before.sparkSession
    gone = materialize(spark, narrow(before).join(narrow(after).select("path"), "path", "left_anti"), "gone")
    new = materialize(spark, narrow(after).join(narrow(before).select("path"), "path", "left_anti"), "new")
    key = ["full_hash", "size"]
    ranked = [rank_in_groups(df.filter("full_hash is not null and size is not null"), key, "path") for df in (gone, new)]
    pairs = (ranked[0].withColumnRenamed("path", "path_before")
             .join(ranked[1], [*key, "rank"], "full_outer"))  # unique keys on both sides
    status = (F.when(F.col("path").isNull(), F.lit("removed")).when(F.col("path_before").isNull(), F.lit("added"))
              .otherwise(F.lit("moved")))
    hashed = pairs.select(F.coalesce("path", "path_before").alias("path"), status.alias("status"),
                          F.when(F.col("path").isNotNull(), F.col("path_before")).alias("path_before"), "size")
    rest = [df.filter("full_hash is null or size is null").select(
        "path", F.lit(s).alias("status"), F.lit(None).cast("string").alias("path_before"), "size")
        for df, s in ((gone, "removed"), (new, "added"))]
    return hashed.unionByName(rest[0]).unionByName(rest[1])
