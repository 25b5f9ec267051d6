"""Content readers by path (A7, A8): hashes computed on the executors.

Each task opens the files of its rows, reads at most the prefix (quick hash)
or streams the whole file in chunks (full hash, constant memory, no 2 GB
limit), and returns narrow rows. A few threads per task overlap the storage
latency of many small reads. A file that cannot be read becomes an ``error``
row; it never fails the job.
"""

from __future__ import annotations

import errno
import hashlib
import math
import os
import stat
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfs.session import local_fs_path, ship_package
from tallyfs.sources.storage import Store, has_scheme

HASH_SCHEMA = "path string, size bigint, quick_hash string, full_hash string, error string"
CHUNK = 1 << 20


def open_regular(path: str):
    """Open a regular file for reading. A FIFO, socket or device would block
    or never end, so it is refused (``O_NONBLOCK`` keeps the open itself from
    waiting on a FIFO). A path with a scheme is opened through its file
    system's handle."""
    if has_scheme(path):
        return Store().open(path)
    fd = os.open(local_fs_path(path), os.O_RDONLY | getattr(os, "O_NONBLOCK", 0))
    try:
        if not stat.S_ISREG(os.fstat(fd).st_mode):
            raise OSError(errno.EINVAL, "not a regular file")
        if hasattr(os, "set_blocking"):
            os.set_blocking(fd, True)
        return os.fdopen(fd, "rb")
    except BaseException:
        os.close(fd)
        raise


def _quick(path: str, size: int | None, prefix: int, opener=open_regular) -> tuple[str | None, str | None, str | None]:
    try:
        with opener(path) as fh:
            head = fh.read(prefix)
    except OSError as exc:
        return None, None, f"{type(exc).__name__}: {exc.strerror or exc}"
    quick = hashlib.sha256(head).hexdigest()
    # A file no larger than the prefix was read whole: its quick hash is its full hash.
    full = quick if size is not None and size <= prefix and len(head) == size else None
    return quick, full, None


def _full(path: str, opener=open_regular) -> tuple[str | None, str | None]:
    digest = hashlib.sha256()
    try:
        with opener(path) as fh:
            while True:
                block = fh.read(CHUNK)
                if not block:
                    break
                digest.update(block)
    except OSError as exc:
        return None, f"{type(exc).__name__}: {exc.strerror or exc}"
    return digest.hexdigest(), None


def _pool_map(fn, items: list, threads: int) -> list:
    """``fn`` over ``items`` in order, ``threads`` at a time. File reads and
    hashing release the GIL, so a few threads hide storage latency."""
    if threads <= 1 or len(items) <= 1:
        return [fn(x) for x in items]
    with ThreadPoolExecutor(max_workers=threads) as pool:
        return list(pool.map(fn, items))


def _opener(store: Store | None):
    return store.open if store is not None else open_regular


def _quick_batches(prefix: int, threads: int, store: Store | None, carry: tuple[str, ...]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            items = [(p, None if pd.isna(s) else int(s)) for p, s in zip(pdf["path"], pdf["size"])]
            out = _pool_map(lambda it: _quick(it[0], it[1], prefix, _opener(store)), items, threads)
            yield pd.DataFrame({
                "path": pdf["path"],
                "size": pdf["size"],
                "quick_hash": [o[0] for o in out],
                "full_hash": [o[1] for o in out],
                "error": [o[2] for o in out],
                **{c: pdf[c] for c in carry},
            })
    return run


def _full_batches(threads: int, store: Store | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            need = list(pdf.index[pdf["full_hash"].isna()])
            done = _pool_map(lambda i: _full(pdf.at[i, "path"], _opener(store)), need, threads)
            full = pdf["full_hash"].copy()
            err = pdf["error"].copy()
            for i, (h, e) in zip(need, done):
                full.at[i] = h
                err.at[i] = e
            yield pdf.assign(full_hash=full, error=err)
    return run


def _partitions(n: int, per_task: float, floor: int, rows: int | None = None) -> int:
    """``n / per_task`` tasks, at least one per core, never more than rows."""
    parts = max(floor, int(math.ceil(n / max(per_task, 1))))
    return max(1, min(parts, rows)) if rows is not None else parts


def _carried(df: DataFrame, carry: tuple[str, ...]) -> str:
    return "".join(f", `{c}` {df.schema[c].dataType.simpleString()}" for c in carry)


def quick_hash_files(cands: DataFrame, prefix: int, files_per_task: int, threads: int = 4,
                     n_rows: int | None = None, store: Store | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(path, size) -> (path, size, quick_hash, full_hash, error), and the
    columns ``carry`` as they are.

    Reading 8 KB costs about the same for every file, so tasks are balanced
    by file count.
    """
    spark = cands.sparkSession
    floor = spark.sparkContext.defaultParallelism
    n = cands.count() if n_rows is None else n_rows
    ship_package(spark)
    spread = cands.repartition(_partitions(n, files_per_task, floor, rows=n), "path")
    return spread.mapInPandas(_quick_batches(prefix, threads, store, carry), HASH_SCHEMA + _carried(cands, carry))


def full_hash_files(survivors: DataFrame, prefix: int, target_task_bytes: int,
                    threads: int = 4, total_bytes: int | None = None, n_rows: int | None = None,
                    store: Store | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """Fill ``full_hash`` for rows that lack it by streaming the whole file.

    Tasks are sized by bytes: the number of partitions is the survivors' total
    size over ``target_task_bytes``; rows are spread by a hash of the path, so
    no task gets a long run of large files.
    """
    spark = survivors.sparkSession
    floor = spark.sparkContext.defaultParallelism
    todo = survivors.select("path", "size", "quick_hash", "full_hash", "error", *carry)
    total = total_bytes if total_bytes is not None else \
        todo.filter(F.col("full_hash").isNull()).agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    ship_package(spark)
    spread = todo.repartition(_partitions(int(total), target_task_bytes, floor, rows=n_rows), "path")
    return spread.mapInPandas(_full_batches(threads, store), HASH_SCHEMA + _carried(todo, carry))
