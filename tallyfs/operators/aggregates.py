"""Totals, extension counts, category sizes and largest files (D1–D3, E1–E4).

All are hash aggregations (partial aggregation runs before the shuffle, so a
hot extension or category costs one row per task, not one row per file) or
bounded top-k (``TakeOrderedAndProject``: every task keeps k rows).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfs.functions.columns import category_of, extension_label, size_text
from tallyfs.plans.materialize import bounded_broadcast
from tallyfs.schema import (
    KIND_DIR,
    KIND_FILE,
    KIND_SKIPPED,
    LARGEST_FILES_K,
    NO_EXTENSION,
    OTHERS,
    TOP_EXTENSIONS_K,
)


def files_only(inv: DataFrame) -> DataFrame:
    """Readable file rows (kind = 'file')."""
    return inv.filter(F.col("kind") == KIND_FILE)


def scan_summary(inv: DataFrame) -> DataFrame:
    """One row: files, folders, bytes, skipped. Zero (not null) when empty.

    Unknown sizes (null) are counted as files but add nothing to ``bytes``.
    """
    kind = F.col("kind")
    return inv.agg(
        F.count_if(kind == KIND_FILE).alias("files"),
        F.count_if(kind == KIND_DIR).alias("folders"),
        F.coalesce(F.sum(F.when(kind == KIND_FILE, F.col("size"))), F.lit(0)).cast("long").alias("bytes"),
        F.count_if(kind == KIND_SKIPPED).alias("skipped"),
    )


def skipped_items(inv: DataFrame) -> DataFrame:
    """(path, error): everything the listing could not read."""
    return inv.filter(F.col("kind") == KIND_SKIPPED).select("path", "error")


def extension_counts(inv: DataFrame) -> DataFrame:
    """(extension, n): files per extension; no extension is ``No extension``."""
    return (files_only(inv)
            .groupBy(extension_label("extension").alias("extension"))
            .agg(F.count(F.lit(1)).alias("n")))


def top_extensions(inv: DataFrame, k: int = TOP_EXTENSIONS_K) -> DataFrame:
    """The k most frequent extensions; ties by extension name."""
    return extension_counts(inv).orderBy(F.col("n").desc(), F.col("extension").asc()).limit(k)


def all_extensions(inv: DataFrame) -> DataFrame:
    """Every extension, most frequent first (ordering only matters when written)."""
    return extension_counts(inv).orderBy(F.col("n").desc(), F.col("extension").asc())


def with_category(inv: DataFrame, dimension: DataFrame | None = None,
                  broadcast_limit: int = 100_000) -> DataFrame:
    """Add ``category``.

    The fixed dictionary is a literal CASE chain (no join). A caller's own
    dimension (extension, category) is reduced to one category per extension
    (the smallest name, so a repeated extension cannot multiply file rows)
    and joined; it is broadcast only when its row count is within
    ``broadcast_limit``.
    """
    if dimension is None:
        return inv.withColumn("category", category_of("extension"))
    dim = (dimension.groupBy(F.lower(F.col("extension")).alias("_dim_ext"))
           .agg(F.min("category").alias("_dim_cat")))
    dim, _ = bounded_broadcast(dim, broadcast_limit)
    joined = inv.join(dim, inv["extension"] == dim["_dim_ext"], "left")
    return joined.withColumn(
        "category",
        F.when(F.col("extension").isNull() | (F.col("extension") == ""), F.lit(NO_EXTENSION))
        .otherwise(F.coalesce(F.col("_dim_cat"), F.lit(OTHERS))),
    ).drop("_dim_ext", "_dim_cat")


def category_sizes(inv: DataFrame, dimension: DataFrame | None = None) -> DataFrame:
    """(category, bytes, n): bytes and files per category. Files are summed per
    extension first, so a category join sees one row per extension."""
    per_ext = (files_only(inv).groupBy("extension")
               .agg(F.coalesce(F.sum("size"), F.lit(0)).alias("_bytes"), F.count(F.lit(1)).alias("_n")))
    return (with_category(per_ext, dimension)
            .groupBy("category")
            .agg(F.sum("_bytes").cast("long").alias("bytes"), F.sum("_n").cast("long").alias("n")))


def category_labels(inv: DataFrame) -> DataFrame:
    """(category, bytes, size_text): the category report as shown to users."""
    return category_sizes(inv).select("category", "bytes", size_text("bytes").alias("size_text"))


def largest_files(inv: DataFrame, k: int = LARGEST_FILES_K) -> DataFrame:
    """The k largest files, largest first; ties by path."""
    return (files_only(inv).filter(F.col("size").isNotNull())
            .select("path", "name", "size", "extension")
            .orderBy(F.col("size").desc(), F.col("path").asc())
            .limit(k)
            .withColumn("size_text", size_text("size")))


def largest_file(inv: DataFrame) -> DataFrame:
    """The single largest file (a tie goes to the smallest path)."""
    return largest_files(inv, 1)
