"""Listing a directory tree as a distributed job (A1–A3, J2).

The tree is walked breadth first, one Spark job per level. A level's input is
a DataFrame of directories (the frontier); tasks list their directories with
``os.scandir`` and emit one row per entry: files, folders (root excluded) and
skipped items. Each level is written to the shared checkpoint folder, which
ends its lineage; the folders of that level are the next frontier. Nothing
about the tree passes through the driver except per-level counts.

Reading one directory is sequential, but checking and stat'ing its files is
not: past ``inline_files`` files in one directory, the rest are stat'ed by a
separate stage spread evenly over tasks, so a directory that holds a large
share of the tree does not make one task do all the per-file system calls.

Unlike Spark's ``binaryFile`` source this sees every entry: names starting
with ``.`` or ``_``, zero-byte files, empty directories, broken links.
Links to directories are followed, except a link that resolves to one of its
own ancestors (it is listed as a folder with an error and not entered).
A plain path must be a mount that all executors share. A root with a scheme
(``hdfs://``, ``s3://``, ``file://``) or a caller's own ``store`` is listed
through a file-system handle (``sources/storage.py``): one selector call per
folder brings names, sizes and times, so no file is stat'ed, and paths keep
their scheme.
"""

from __future__ import annotations

import math
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.functions.columns import extension_of
from tallyfs.plans.materialize import materialize
from tallyfs.schema import INVENTORY_COLUMNS, KIND_DIR, KIND_FILE, KIND_SKIPPED
from tallyfs.session import local_fs_path, ship_package
from tallyfs.sources.storage import DIR, MISSING, Store, normal_path, store_of

LEVEL_SCHEMA = ("kind string, path string, name string, size bigint, "
                "mtime_s double, error string, descend boolean, chain array<string>, deferred boolean")
LEVEL_COLUMNS = ["kind", "path", "name", "size", "mtime_s", "error", "descend", "chain", "deferred"]
FRONTIER_SCHEMA = "path string, chain array<string>"
BATCH_ROWS = 10_000


def readable_name(name: str) -> str | None:
    """None for a name that is Unicode, else the name with its undecodable
    bytes written as ``\\udcNN``."""
    try:
        name.encode("utf-8")
        return None
    except UnicodeEncodeError:
        return name.encode("utf-8", "backslashreplace").decode("utf-8")


def _ident(st: os.stat_result) -> str:
    return f"{st.st_dev}:{st.st_ino}"


def _row(kind, path, name, size=None, mtime=None, error=None, descend=False,
         chain=None, deferred=False) -> tuple:
    return (kind, path, name, size, mtime, error, descend, chain, deferred)


def _err(exc: OSError) -> str:
    return f"{type(exc).__name__}: {exc.strerror or exc}"


def _file_row(path: str, name: str, stat_fn) -> tuple:
    """A readable file with its size and time, or a skipped row."""
    if not os.access(path, os.R_OK):
        return _row(KIND_SKIPPED, path, name, error="not readable")
    try:
        st = stat_fn()
    except OSError as exc:
        return _row(KIND_SKIPPED, path, name, error=_err(exc))
    return _row(KIND_FILE, path, name, int(st.st_size), mtime=st.st_mtime)


def _list_dir(path: str, chain: list[str], prune: frozenset[str], inline_files: int) -> Iterator[tuple]:
    """Rows for the entries of one directory.

    The first ``inline_files`` files are checked and stat'ed here; files past
    that are emitted as ``deferred`` rows (name only) and stat'ed by a later,
    evenly spread stage, so a directory holding a large share of all files
    costs one task only the sequential read of its entries.
    """
    try:
        it = os.scandir(path)
    except OSError as exc:
        # Passed the readability check one level up but cannot be listed:
        # it stays a folder and is also counted as skipped.
        yield _row(KIND_SKIPPED, path, os.path.basename(path), error=_err(exc))
        return
    n_files = 0
    with it:
        for entry in it:
            child = path.rstrip("/") + "/" + entry.name if path != "/" else "/" + entry.name
            if (shown := readable_name(entry.name)) is not None:
                # not a string Spark can hold: a skipped row, never entered
                yield _row(KIND_SKIPPED, path.rstrip("/") + "/" + shown, shown, error="undecodable name")
                continue
            try:
                is_dir = entry.is_dir(follow_symlinks=True)
            except OSError:
                is_dir = False
            if not is_dir:
                n_files += 1
                if n_files > inline_files:
                    yield _row(KIND_FILE, child, entry.name, deferred=True)
                else:
                    yield _file_row(child, entry.name, lambda e=entry: e.stat(follow_symlinks=True))
                continue
            if prune and entry.name.lower() in prune:
                yield _row(KIND_SKIPPED, child, entry.name, error="pruned")
                continue
            if not os.access(child, os.R_OK):
                yield _row(KIND_SKIPPED, child, entry.name, error="not readable")
                continue
            try:
                st = entry.stat(follow_symlinks=True)
            except OSError as exc:
                yield _row(KIND_SKIPPED, child, entry.name, error=_err(exc))
                continue
            ident = _ident(st)
            if ident in chain:
                yield _row(KIND_DIR, child, entry.name, mtime=st.st_mtime,
                           error="link to an ancestor, not entered")
                continue
            yield _row(KIND_DIR, child, entry.name, mtime=st.st_mtime, descend=True, chain=chain + [ident])


def _list_store(store: Store, path: str, chain: list[str], prune: frozenset[str]) -> Iterator[tuple]:
    """Rows for the entries of one folder of a store; the same rules as for a
    mounted folder."""
    try:
        for e in store.entries(path):
            if (shown := readable_name(e.name)) is not None:
                yield _row(KIND_SKIPPED, path.rstrip("/") + "/" + shown, shown, error="undecodable name")
            elif e.kind == MISSING:
                yield _row(KIND_SKIPPED, e.path, e.name, error="not readable")
            elif e.kind != DIR:
                yield _row(KIND_FILE, e.path, e.name, e.size or 0, mtime=e.mtime_s)
            elif e.name.lower() in prune:
                yield _row(KIND_SKIPPED, e.path, e.name, error="pruned")
            elif e.ident in chain:
                yield _row(KIND_DIR, e.path, e.name, mtime=e.mtime_s, error="link to an ancestor, not entered")
            else:
                yield _row(KIND_DIR, e.path, e.name, mtime=e.mtime_s, descend=True, chain=chain + [e.ident])
    except OSError as exc:  # it stays a folder and is also counted as skipped
        yield _row(KIND_SKIPPED, path, os.path.basename(path), error=_err(exc))


def _frame(rows: list[tuple]) -> pd.DataFrame:
    df = pd.DataFrame(rows, columns=LEVEL_COLUMNS)
    df["size"] = df["size"].astype("Int64")
    return df


def _scan_level(prune: frozenset[str], inline_files: int, dirs_acc, deferred_acc, store: Store | None = None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buf: list[tuple] = []
        n_dirs = n_deferred = 0
        for pdf in batches:
            for path, chain in zip(pdf["path"], pdf["chain"]):
                chain_list = list(chain) if chain is not None else []
                listed = (_list_store(store, path, chain_list, prune) if store is not None
                          else _list_dir(local_fs_path(path), chain_list, prune, inline_files))
                for row in listed:
                    n_dirs += row[6]
                    n_deferred += row[8]
                    buf.append(row)
                    if len(buf) >= BATCH_ROWS:
                        yield _frame(buf)
                        buf = []
        if buf:
            yield _frame(buf)
        dirs_acc.add(n_dirs)
        deferred_acc.add(n_deferred)
    return run


def _stat_deferred(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [_file_row(p, n, lambda p=p: os.stat(local_fs_path(p)))
                for p, n in zip(pdf["path"], pdf["name"])]
        yield _frame(rows)


def _root(root: str, store: Store | None) -> tuple[str, str, Store | None]:
    """(path, identity, store) of the folder to list; raises if it is none."""
    store = store_of(root, store)
    if store is None:
        root = local_fs_path(root)
        if not os.path.isdir(root):
            raise FileNotFoundError(f"not a directory: {root}")
        return root, _ident(os.stat(root)), None
    root = normal_path(root)
    entry = store.entry(root)
    if entry.kind != DIR:
        raise FileNotFoundError(f"not a directory: {root}")
    return root, entry.ident, store


def tree_levels(spark: SparkSession, root: str, dirs_per_task: int = 64,
                prune: tuple[str, ...] = (), inline_files: int = 20_000,
                files_per_stat_task: int = 20_000, store: Store | None = None) -> list[DataFrame]:
    """List ``root`` level by level; returns the written level tables."""
    root, ident, store = _root(root, store)
    prune_set = frozenset(p.lower() for p in prune)
    floor = max(spark.sparkContext.defaultParallelism, 1)
    ship_package(spark)
    frontier = spark.createDataFrame([(root, [ident])], FRONTIER_SCHEMA)
    n_dirs = 1
    levels: list[DataFrame] = []
    depth = 0
    sc = spark.sparkContext
    while n_dirs > 0:
        # dirs_per_task directories a task, but never fewer tasks than cores
        # while there are directories to spread
        parts = max(math.ceil(n_dirs / dirs_per_task), min(n_dirs, floor))
        spread = frontier.repartition(parts, "path") if parts > 1 else frontier.coalesce(1)
        # Counts for the next step come back with the listing tasks. A retried
        # task can only make them larger, which neither ends the walk early
        # nor skips the stat stage.
        dirs_acc, deferred_acc = sc.accumulator(0), sc.accumulator(0)
        listed = spread.mapInPandas(_scan_level(prune_set, inline_files, dirs_acc, deferred_acc, store),
                                    LEVEL_SCHEMA)
        level = materialize(spark, listed, f"tree-level{depth}")
        n_deferred, n_dirs = deferred_acc.value, dirs_acc.value
        if n_deferred:
            deferred = level.filter(F.col("deferred"))
            stat_parts = max(floor, math.ceil(n_deferred / files_per_stat_task))
            stats = deferred.select("path", "name").repartition(stat_parts, "path") \
                .mapInPandas(_stat_deferred, LEVEL_SCHEMA)
            stats = materialize(spark, stats, f"tree-level{depth}-stat")
            level = level.filter(~F.col("deferred")).unionByName(stats)
        levels.append(level)
        frontier = level.filter(F.col("descend")).select("path", "chain")
        depth += 1
    return levels


def tree_inventory(spark: SparkSession, root: str, dirs_per_task: int = 64,
                   prune: tuple[str, ...] = (), inline_files: int = 20_000, store: Store | None = None) -> DataFrame:
    """Inventory of every entry below ``root`` (root itself excluded).

    ``prune`` names directories (case-insensitive) that are not entered but
    counted as skipped, e.g. ``SYSTEM_DIRECTORIES``.
    A name that is not valid Unicode is a skipped row with its odd bytes
    escaped; such a folder is not entered.
    A missing root raises; everything below it becomes rows.
    """
    levels = tree_levels(spark, root, dirs_per_task, prune, inline_files, store=store)
    out = levels[0]
    for lv in levels[1:]:
        out = out.unionByName(lv)
    return level_inventory(out)


def level_inventory(out: DataFrame) -> DataFrame:
    """Rows of the listing as inventory rows."""
    return out.select(
        "kind", "path", "name", "size",
        F.when(F.col("kind") == KIND_FILE, extension_of("name")).alias("extension"),
        F.lit(False).alias("from_archive"),
        F.lit(None).cast("string").alias("archive_path"),
        F.timestamp_seconds("mtime_s").alias("mtime"),
        "error",
    ).select(*INVENTORY_COLUMNS)
