"""Listing a tree again by what is known of it.

A folder's time changes when an entry is added, removed or renamed in it. So a
folder with the time it had in an earlier inventory still has the same names,
and need not be listed: its entries come from the inventory. What may have
changed without the folder knowing is each entry itself (a file rewritten in
place, a link that broke), so the entries are looked at again, one by one, by
evenly spread tasks (``look=True``; the result then equals a fresh listing), or
trusted (``look=False``: only folders are looked at, for their times).

Level by level as in ``sources/tree.py``: the level's folders are joined with
the stored times; those that changed are listed, the others joined with their
stored entries. A folder that changed within ``settle_s`` of the time when it was
listed is listed again, as its time may not have moved on.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.plans.materialize import materialize
from tallyfs.schema import KIND_DIR, KIND_FILE, KIND_SKIPPED
from tallyfs.session import ship_package
from tallyfs.sources.storage import DIR, MISSING, Store
from tallyfs.sources.tree import (BATCH_ROWS, LEVEL_SCHEMA, _err, _file_row, _frame, _ident, _root, _row, _scan_level,
                                  level_inventory)

FRONTIER = "path string, chain array<string>, mtime timestamp"


@dataclass
class Relisting:
    inventory: DataFrame
    folders: DataFrame   # (path, listed): every folder met, the root included, and whether it was listed


def _parent(path):
    """The folder of an entry, as the frontier writes it."""
    up = F.regexp_extract(path, "^(.*)/[^/]*$", 1)
    return F.when(up == "", F.lit("/")).otherwise(up)


def _look(path: str, name: str, chain: list[str], prune: frozenset[str], store: Store | None) -> tuple | None:
    """The row that a listing would give for one entry; None if it is gone."""
    if store is not None:
        e = store.entry(path)
        if e.kind == MISSING:
            return _row(KIND_SKIPPED, path, name, error="not readable")
        if e.kind != DIR:
            return _row(KIND_FILE, path, name, e.size or 0, mtime=e.mtime_s)
        ident, mtime = e.ident, e.mtime_s
    else:
        if not os.path.lexists(path):
            return None
        if not os.path.isdir(path):
            return _file_row(path, name, lambda: os.stat(path))
        ident = None
    if name.lower() in prune:
        return _row(KIND_SKIPPED, path, name, error="pruned")
    if ident is None:
        if not os.access(path, os.R_OK):
            return _row(KIND_SKIPPED, path, name, error="not readable")
        try:
            st = os.stat(path)
        except OSError as exc:
            return _row(KIND_SKIPPED, path, name, error=_err(exc))
        ident, mtime = _ident(st), st.st_mtime
    if ident in chain:
        return _row(KIND_DIR, path, name, mtime=mtime, error="link to an ancestor, not entered")
    return _row(KIND_DIR, path, name, mtime=mtime, descend=True, chain=chain + [ident])


def _look_all(prune: frozenset[str], store: Store | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [_look(p, n, list(c), prune, store) for p, n, c in zip(pdf["path"], pdf["name"], pdf["chain"])]
            yield _frame([r for r in rows if r is not None])
    return run


def relist_tree(spark: SparkSession, root: str, known: DataFrame, prune: tuple[str, ...] = (), look: bool = True,
                listed_at: float | None = None, settle_s: float = 2.0, dirs_per_task: int = 64,
                store: Store | None = None) -> Relisting:
    """Inventory of ``root`` from an earlier one, ``known`` (the rows of
    ``tree_inventory`` with the same ``prune``).

    ``listed_at`` (seconds) is when that listing began; folders whose time is
    not ``settle_s`` older are not trusted. The root itself has no stored time
    and is always listed.
    """
    root, ident, store = _root(root, store)
    prune_set = frozenset(p.lower() for p in prune)
    ship_package(spark)
    known = materialize(spark, known.filter("not from_archive").select(
        "kind", "path", "name", "size", F.unix_micros("mtime").alias("micros"), "error", _parent(F.col("path")).alias("folder")), "relist_known")
    times = known.filter(F.col("kind") == KIND_DIR).select("path", F.col("micros").alias("known_micros"))
    if listed_at is not None:
        times = times.filter(F.col("known_micros") < int((listed_at - settle_s) * 1e6))
    frontier = spark.createDataFrame([(root, [ident], None)], "path string, chain array<string>, micros bigint")
    levels, folders, floor, depth = [], [], max(spark.sparkContext.defaultParallelism, 1), 0
    while True:
        met = materialize(spark, frontier.join(times, "path", "left").withColumn(
            "listed", ~F.coalesce(F.col("micros") == F.col("known_micros"), F.lit(False))), f"relist-folders{depth}")
        n, n_listed = met.agg(F.count("*"), F.count_if("listed")).first()
        if not n:
            break
        folders.append(met.select("path", "listed"))
        parts = []
        if n_listed:
            acc = [spark.sparkContext.accumulator(0) for _ in range(2)]
            spread = met.filter("listed").select("path", "chain").repartition(
                max(-(-n_listed // dirs_per_task), min(n_listed, floor)), "path")
            # files are looked at where they are listed: what is deferred there is for giant new folders only
            parts.append(spread.mapInPandas(_scan_level(prune_set, 1 << 62, *acc, store), LEVEL_SCHEMA))
        if n_listed < n:
            kept = met.filter("not listed").select(F.col("path").alias("folder"), "chain")
            # a folder with very many entries: its entries are dealt out by path
            entries = known.join(kept, "folder")
            seen = entries if look else entries.filter(F.col("kind") == KIND_DIR)
            parts.append(seen.select("path", "name", "chain").repartition("path").mapInPandas(_look_all(prune_set, store), LEVEL_SCHEMA))
            if not look:
                parts.append(entries.filter(F.col("kind") != KIND_DIR).select(
                    "kind", "path", "name", "size", (F.col("micros") / 1e6).alias("mtime_s"), "error",
                    F.lit(False).alias("descend"), F.lit(None).cast("array<string>").alias("chain"), F.lit(False).alias("deferred")))
        level = parts[0]
        for p in parts[1:]:
            level = level.unionByName(p)
        level = materialize(spark, level, f"relist-level{depth}")
        levels.append(level)
        frontier = level.filter("descend").select("path", "chain", F.unix_micros(F.timestamp_seconds("mtime_s")).alias("micros"))
        depth += 1
    out, met = levels[0], folders[0]
    for level, f in zip(levels[1:], folders[1:]):
        out, met = out.unionByName(level), met.unionByName(f)
    return Relisting(level_inventory(out), met)
