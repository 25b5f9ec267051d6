"""Large files by byte ranges: block digests made by many tasks (A8, D6).

A file's SHA-256 is sequential, so one task would read a file of a terabyte
alone. Its blocks are not: every range of ``block_bytes`` is a row of its own,
dealt over the tasks by a hash of path and number, read in 1 MiB pieces and
reduced to its SHA-256. A file's *root* is the SHA-256 over its ordered block
digests, built in two steps so that no row holds more than ``FAN`` of them:
``FAN`` neighbouring digests give one inner digest, the inner ones the root.

Files of one size with one root have the same content as surely as files with
one SHA-256. Only narrow rows (path, number, digest) are shuffled.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfs.session import ship_package
from tallyfs.sources.readers import CHUNK, _opener, _partitions, _pool_map
from tallyfs.sources.storage import Store

BLOCK_BYTES = 128 << 20
#: Digests that one inner digest covers (512 GB of a file at the default block size).
FAN = 4096

DIGEST_SCHEMA = "path string, size bigint, block bigint, digest string, error string"
WHOLE_SCHEMA = "path string, full_hash string, root string, error string"


def _reason(exc: OSError) -> str:
    return f"{type(exc).__name__}: {exc.strerror or exc}"


def _range_digest(path: str, start: int, length: int, opener) -> tuple[str | None, str | None]:
    """SHA-256 of one range, or of what is left of it in a file that shrank."""
    digest = hashlib.sha256()
    try:
        with opener(path) as fh:
            fh.seek(start)
            while length > 0:
                piece = fh.read(min(CHUNK, length))
                if not piece:
                    break
                digest.update(piece)
                length -= len(piece)
    except OSError as exc:
        return None, _reason(exc)
    return digest.hexdigest(), None


class _Root:
    """The root of a content that arrives piece by piece."""

    def __init__(self, block_bytes: int, fan: int):
        self.block_bytes, self.fan = block_bytes, fan
        self.block, self.left = hashlib.sha256(), block_bytes
        self.inner, self.held = hashlib.sha256(), 0
        self.outer = hashlib.sha256()

    def _end_inner(self) -> None:
        self.outer.update(self.inner.hexdigest().encode())
        self.inner, self.held = hashlib.sha256(), 0

    def _end_block(self) -> None:
        if self.held == self.fan:
            self._end_inner()
        self.inner.update(self.block.hexdigest().encode())
        self.held += 1
        self.block, self.left = hashlib.sha256(), self.block_bytes

    def update(self, piece: bytes) -> None:
        view = memoryview(piece)
        while len(view):
            now = view[:self.left]
            self.block.update(now)
            self.left -= len(now)
            view = view[len(now):]
            if not self.left:
                self._end_block()

    def hexdigest(self) -> str:
        if self.left < self.block_bytes:
            self._end_block()
        if self.held:
            self._end_inner()
        return self.outer.hexdigest()


def _whole(path: str, block_bytes: int, fan: int, opener) -> tuple[str | None, str | None, str | None]:
    full, root = hashlib.sha256(), _Root(block_bytes, fan)
    try:
        with opener(path) as fh:
            while piece := fh.read(CHUNK):
                full.update(piece)
                root.update(piece)
    except OSError as exc:
        return None, None, _reason(exc)
    return full.hexdigest(), root.hexdigest(), None


def block_ranges(files: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, size, block, start, length): the ranges of files (path, size)."""
    last = F.expr(f"(size - 1) div {block_bytes}")
    return (files.filter("size > 0").select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("block"))
            .withColumn("start", F.col("block") * block_bytes)
            .withColumn("length", F.least(F.lit(block_bytes).cast("long"), F.col("size") - F.col("start"))))


def block_digests(files: DataFrame, target_task_bytes: int, block_bytes: int = BLOCK_BYTES, threads: int = 4,
                  total_bytes: int | None = None, n_blocks: int | None = None, store: Store | None = None) -> DataFrame:
    """(path, size, block, digest, error) of every block of files (path, size).

    The tasks are sized by bytes, the blocks of one file spread over all of
    them; a task holds ``threads`` pieces of 1 MiB at a time.
    """
    if total_bytes is None:
        total_bytes = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = _opener(store)
        for pdf in batches:
            items = list(zip(pdf["path"], pdf["start"], pdf["length"]))
            out = _pool_map(lambda it: _range_digest(it[0], int(it[1]), int(it[2]), opener), items, threads)
            yield pd.DataFrame({"path": pdf["path"], "size": pdf["size"], "block": pdf["block"],
                                "digest": [o[0] for o in out], "error": [o[1] for o in out]})

    ship_package(files.sparkSession)
    parts = _partitions(int(total_bytes), target_task_bytes, files.sparkSession.sparkContext.defaultParallelism, rows=n_blocks)
    return block_ranges(files, block_bytes).repartition(parts, "path", "block").mapInPandas(run, DIGEST_SCHEMA)


def block_roots(digests: DataFrame, fan: int = FAN) -> DataFrame:
    """(path, size, root, error) of files from their block digests; root is
    null for a file with an unreadable block."""

    def over(number: str, digest: str):
        listed = F.array_sort(F.collect_list(F.struct(F.col(number), F.col(digest))))
        return F.sha2(F.concat_ws("", F.transform(listed, lambda x: x[digest])), 256)

    inner = (digests.groupBy("path", "size", F.expr(f"block div {fan}").alias("part"))
             .agg(over("block", "digest").alias("inner"), F.min("error").alias("error")))
    return (inner.groupBy("path", "size").agg(over("part", "inner").alias("root"), F.min("error").alias("error"))
            .withColumn("root", F.when(F.col("error").isNull(), F.col("root"))))


def whole_hashes(files: DataFrame, target_task_bytes: int, block_bytes: int = BLOCK_BYTES, fan: int = FAN, threads: int = 4,
                 total_bytes: int | None = None, n_rows: int | None = None, store: Store | None = None) -> DataFrame:
    """(path, full_hash, root, error) of files (path, size), each read once
    from its beginning to its end."""
    if total_bytes is None:
        total_bytes = files.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opener = _opener(store)
        for pdf in batches:
            out = _pool_map(lambda p: _whole(p, block_bytes, fan, opener), list(pdf["path"]), threads)
            yield pd.DataFrame({"path": pdf["path"], "full_hash": [o[0] for o in out],
                                "root": [o[1] for o in out], "error": [o[2] for o in out]})

    ship_package(files.sparkSession)
    parts = _partitions(int(total_bytes), target_task_bytes, files.sparkSession.sparkContext.defaultParallelism, rows=n_rows)
    return files.select("path").repartition(parts, "path").mapInPandas(run, WHOLE_SCHEMA)
