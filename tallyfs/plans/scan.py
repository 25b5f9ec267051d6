"""A scan as the reference runs it: list a tree, replace every ZIP by its
entries, keep unreadable archives aside, and persist the result once so all
analyses read the same table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.functions.columns import is_archive
from tallyfs.plans.materialize import materialize
from tallyfs.schema import ARCHIVE_EXTENSIONS, KIND_FILE
from tallyfs.sources.archives import KIND_ARCHIVE_ERROR, expand_archives, list_archives
from tallyfs.sources.storage import Store
from tallyfs.sources.tree import tree_inventory


@dataclass
class Scan:
    inventory: DataFrame        # files (archives replaced by entries), folders, skipped
    archive_errors: DataFrame   # (path, error): archives that could not be read


def scan_tree(spark: SparkSession, root: str, prune: tuple[str, ...] = (),
              dirs_per_task: int = 64,
              archive_extensions: tuple[str, ...] = ARCHIVE_EXTENSIONS, store: Store | None = None) -> Scan:
    """List ``root`` and expand archives by path (ZIP only by default, as
    the reference; add e.g. ``"tar"`` to ``archive_extensions`` for tars). A
    root with a scheme, or one in a ``store``, is read through a file-system
    handle.

    The listing levels and the archive entries are written tables, so the
    returned inventory is a union of persisted tables (short lineage); no
    archive job runs when the tree holds no ZIP.
    """
    listing = tree_inventory(spark, root, dirs_per_task=dirs_per_task, prune=prune, store=store)
    zip_row = (F.col("kind") == KIND_FILE) & is_archive("extension", archive_extensions)
    zips = listing.filter(zip_row)
    n_zips = zips.count()
    if n_zips == 0:
        empty = spark.createDataFrame([], "path string, error string")
        return Scan(listing, empty)
    listed = materialize(spark, list_archives(zips, n_archives=n_zips, store=store), "archives")
    inv = expand_archives(listing, listed=listed, archive_extensions=archive_extensions)
    errors = listed.filter(F.col("kind") == KIND_ARCHIVE_ERROR).select("path", "error")
    return Scan(inv, errors)
