"""A real directory tree made from the documents table, for the listing job
and the path readers.

Every document becomes one file, named by the corpus rules, below a fresh
folder of the shared checkpoint directory: ``<root>/corpus/<source>/<lang>/
<dir>/<name>``; documents the corpus places inside ``bundle.zip`` become plain
files below a *directory* named ``bundle.zip``. Files are written by the
executors (no grouping, so no task gets more than its share). The tree is then
listed and hashed by path like any other tree; reported paths are given
relative to the tree as ``/corpus/...``.

A checkpoint directory on a mounted file system is read as a mount; with
``handle``, and for any other scheme, files are written, listed and read through
a file-system handle. Links and FIFOs need a mount.
"""

from __future__ import annotations

import contextlib
import itertools
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.operators import aggregates
from tallyfs.operators import duplicates as dup
from tallyfs.operators.incremental import Update, update_duplicates
from tallyfs.plans.corpus import CORPUS_ROOT, corpus_table
from tallyfs.plans.scan import Scan, scan_tree
from tallyfs.schema import SYSTEM_DIRECTORIES
from tallyfs.session import local_fs_path, scratch_path, ship_package
from tallyfs.sources import datasource
from tallyfs.sources.relist import Relisting, relist_tree
from tallyfs.sources.storage import Store, has_scheme, normal_path
from tallyfs.sources.tree import tree_inventory


# Fixed fixture values of the odd tree: a document with remainder 5 of 97 has a
# broken link beside it, one with remainder 7 of 89 a FIFO; of a changed tree:
# a document with remainder 4 of 13 is one byte longer.
LINKS, PIPES, GROWN = (97, 5), (89, 7), (13, 4)
# Of a changed tree: a document with remainder 5 of 29 gets a second file beside
# it, one with remainder 6 of 31 goes. Documents with remainder 0 of 5 come late.
# A document with remainder 8 of 41 has a copy in a system folder.
ADDED, GONE, SYSTEM = (29, 5), (31, 6), (41, 8)
LATE = "doc_id % 5 = 0"
#: A writing task gets its documents in Arrow batches of about these bytes (a
#: longer document is a batch of its own) and turns so many rows of one into
#: Python values at a time.
BATCH_CONF, BATCH_BYTES, ROWS_AT_ONCE = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20, 64


def _picked(doc_id: int | None, rule: tuple[int, int]) -> bool:
    return doc_id is not None and doc_id % rule[0] == rule[1]


def _again(make, *args) -> None:
    """A retried task finds what its first attempt made."""
    try:
        make(*args)
    except FileExistsError:
        pass


def _put(root: str):
    """How a task writes one file, whole, with its folder."""
    if has_scheme(root):
        store = Store()

        def put(path: str, data: bytes) -> None:
            with store.create(path) as fh:
                fh.write(data)
        return put
    made: set[str] = set()

    def put(path: str, data: bytes) -> None:
        parent = os.path.dirname(path)
        if parent not in made:
            os.makedirs(parent, exist_ok=True)
            made.add(parent)
        with open(path, "wb") as fh:
            fh.write(data)
    return put


@contextlib.contextmanager
def _small_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started meanwhile hand texts to Python ``BATCH_BYTES`` at a time."""
    before = spark.conf.get(BATCH_CONF, None)
    spark.conf.set(BATCH_CONF, BATCH_BYTES)
    try:
        yield
    finally:
        spark.conf.unset(BATCH_CONF) if before is None else spark.conf.set(BATCH_CONF, before)


def _few_rows(batch: pa.RecordBatch) -> Iterator[list[tuple]]:
    """The rows of a batch, ``ROWS_AT_ONCE`` at a time: the texts of a whole
    batch are held once, in Arrow, and never as Python values too."""
    for at in range(0, batch.num_rows, ROWS_AT_ONCE):
        yield list(zip(*(column.to_pylist() for column in batch.slice(at, ROWS_AT_ONCE).columns)))


def _write_files(root: str, odd: bool = False, grown: bool = False, changed: bool = False, system: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, put = 0, _put(root)
        for rows in itertools.chain.from_iterable(map(_few_rows, batches)):
            for rel, content, doc_id in rows:
                full, data = f"{root}/{rel}", content or b""
                if changed:
                    if _picked(doc_id, ADDED):
                        put(full + ".new", data)
                    if _picked(doc_id, GONE) and os.path.exists(full):
                        os.remove(full)
                    continue
                if grown and not _picked(doc_id, GROWN):
                    continue
                put(full, data + b"x" * grown)
                n += 1
                parent = os.path.dirname(full)
                if odd and _picked(doc_id, LINKS):
                    _again(os.symlink, "no-such-target", full + ".lnk")
                    n += 1
                if odd and _picked(doc_id, PIPES):
                    _again(os.mkfifo, os.path.join(parent, f"pipe_{doc_id}"))
                    n += 1
                if system and _picked(doc_id, SYSTEM):
                    put(f"{parent}/$RECYCLE.BIN/{os.path.basename(full)}", data)
        yield pa.RecordBatch.from_pydict({"n": [n]})
    return run


def _write(spark: SparkSession, sf_dir: str, root: str, where: str = "true", **kinds) -> int:
    """Write the documents' files below ``root``; returns how many entries."""
    docs = corpus_table(spark, sf_dir).filter(where).select(
        F.expr(f"replace(substring(path, {len(CORPUS_ROOT) + 2}), 'bundle.zip!/', 'bundle.zip/')").alias("rel"),
        F.col("text").cast("binary").alias("content"), "doc_id")
    ship_package(spark)
    with _small_batches(spark):
        return docs.mapInArrow(_write_files(root, **kinds), "n long").agg(F.sum("n")).first()[0] or 0


def _fresh_root(spark: SparkSession, handle: bool = False, odd: bool = False) -> str:
    """A fresh folder that stands for ``/corpus``, with its scheme if it is to
    be reached through a handle."""
    base = normal_path(scratch_path(spark, "doc-tree"))
    local = not has_scheme(base) or base.startswith("file:")
    if odd and not local:
        raise RuntimeError("links and FIFOs need a checkpoint directory on a mounted file system")
    if local:
        base = ("file://" if handle else "") + local_fs_path(base.removeprefix("file://"))
    root = base + CORPUS_ROOT
    if local:
        os.makedirs(root.removeprefix("file://"), exist_ok=True)  # an empty table has an empty tree
    else:
        Store().make_folder(root)
    return root


def write_doc_tree(spark: SparkSession, sf_dir: str, odd: bool = False, handle: bool = False) -> tuple[str, int]:
    """Write the tree, with ``odd`` also links and FIFOs; returns the folder
    that stands for ``/corpus`` and the number of entries that are no folder."""
    root = _fresh_root(spark, handle, odd)
    return root, _write(spark, sf_dir, root.removeprefix("file://") if odd else root, odd=odd)


def _as_corpus(df: DataFrame, tree_root: str) -> DataFrame:
    """Report paths relative to the tree, as ``/corpus/...``."""
    return df.withColumn("path", F.concat(F.lit(CORPUS_ROOT), F.expr(f"substring(path, {len(tree_root) + 1})")))


def doc_tree_scan(spark: SparkSession, sf_dir: str, odd: bool = False, handle: bool = False) -> tuple[Scan, str]:
    """Scan of a fresh tree and its root. Raises if the listing does not see
    every entry that was written (a folder that is not shared)."""
    root, written = write_doc_tree(spark, sf_dir, odd, handle)
    scan = scan_tree(spark, root)
    listed = scan.inventory.filter("kind != 'dir'").count() + scan.archive_errors.count()
    if listed != written:
        raise RuntimeError(f"{written} entries were written, {listed} are listed: is {root} shared by all executors?")
    return scan, root


def doc_tree_inventory(spark: SparkSession, sf_dir: str, odd: bool = False, handle: bool = False) -> tuple[DataFrame, str]:
    scan, root = doc_tree_scan(spark, sf_dir, odd, handle)
    return scan.inventory, root


def doc_tree_archive_errors(spark: SparkSession, sf_dir: str, handle: bool = False) -> DataFrame:
    """(path): files named ``*.zip`` that are not archives (read by path)."""
    scan, root = doc_tree_scan(spark, sf_dir, handle=handle)
    return _as_corpus(scan.archive_errors.select("path"), root)


def doc_tree_files(spark: SparkSession, sf_dir: str, handle: bool = False) -> DataFrame:
    inv, root = doc_tree_inventory(spark, sf_dir, handle=handle)
    return _as_corpus(inv.filter(F.col("kind") == "file").select("path", "name", "size", "extension"), root)


def doc_tree_duplicates(spark: SparkSession, sf_dir: str, odd: bool = False, handle: bool = False) -> DataFrame:
    """Duplicate groups found by reading the files (8 KB, then whole)."""
    inv, _root = doc_tree_inventory(spark, sf_dir, odd, handle)
    return dup.find_duplicates(inv, dup.PathReader()).groups


def doc_tree_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    inv, root = doc_tree_inventory(spark, sf_dir)
    return _as_corpus(dup.duplicate_listing(dup.find_duplicates(inv, dup.PathReader())), root)


def skipped_items(spark: SparkSession, sf_dir: str, handle: bool = False) -> DataFrame:
    """(path, error) of the odd tree's unreadable entries."""
    inv, root = doc_tree_inventory(spark, sf_dir, odd=True, handle=handle)
    return _as_corpus(aggregates.skipped_items(inv), root)


def hash_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, size, error) of candidates of the odd tree that cannot be hashed."""
    inv, root = doc_tree_inventory(spark, sf_dir, odd=True)
    return _as_corpus(dup.find_duplicates(inv, dup.PathReader()).hash_errors, root)


def cached_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups of a changed tree, found with the hash cache of a run
    before the change."""
    inv, root = doc_tree_inventory(spark, sf_dir)
    reader = dup.PathReader(cache=scratch_path(spark, "hash-cache"))
    dup.update_hash_cache(inv, dup.find_duplicates(inv, reader), reader.cache)
    _write(spark, sf_dir, root, grown=True)
    return dup.find_duplicates(scan_tree(spark, root).inventory, reader).groups


def pruned_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, error) of the system folders that a listing leaves out."""
    root = _fresh_root(spark)
    _write(spark, sf_dir, root, system=True)
    return _as_corpus(aggregates.skipped_items(tree_inventory(spark, root, prune=SYSTEM_DIRECTORIES)), root)


def _relisted(spark: SparkSession, sf_dir: str) -> tuple[Relisting, str]:
    """A changed tree, listed by what was known before the change."""
    root = _fresh_root(spark)
    _write(spark, sf_dir, root)
    known = tree_inventory(spark, root)
    _write(spark, sf_dir, root, grown=True)
    _write(spark, sf_dir, root, changed=True)
    return relist_tree(spark, root, known), root


def relisted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The changed tree's files, from the earlier listing and its folders' times."""
    found, root = _relisted(spark, sf_dir)
    return _as_corpus(found.inventory.filter("kind = 'file'").select("path", "name", "size", "extension"), root)


def relisted_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(listed, folders): how many folders had to be listed again."""
    return _relisted(spark, sf_dir)[0].folders.groupBy("listed").agg(F.count("*").alias("folders"))


#: The documents are small; prefix and block are too, so that they have many blocks.
SMALL_BLOCKS = {"prefix_bytes": 64, "block_bytes": 512}


def _by_blocks(spark: SparkSession, sf_dir: str) -> dup.DuplicateResult:
    inv, _root = doc_tree_inventory(spark, sf_dir)
    return dup.find_duplicates(inv, dup.PathReader(**SMALL_BLOCKS))


def block_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate groups found by prefix, blocks and one whole read a group."""
    return _by_blocks(spark, sf_dir).groups


def block_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, files, bytes) read in blocks, whole for a group, whole again."""
    reads = _by_blocks(spark, sf_dir).large_reads
    if reads is None:  # no file of more than one block
        reads = spark.createDataFrame([(s, 0, 0) for s in ("blocks", "once", "again")], "stage string, files bigint, bytes bigint")
    return reads


def _updated(spark: SparkSession, sf_dir: str) -> Update:
    """Duplicates of a tree that grew and changed after it was first scanned."""
    root, base = _fresh_root(spark), scratch_path(spark, "duplicate-state")
    _write(spark, sf_dir, root, where=f"not ({LATE})")
    update_duplicates(spark, base, scan_tree(spark, root).inventory)
    _write(spark, sf_dir, root, where=LATE)
    _write(spark, sf_dir, root, grown=True)
    return update_duplicates(spark, base, scan_tree(spark, root).inventory)


def incremental_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _updated(spark, sf_dir).groups


def incremental_reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stage, files, bytes) that the second scan read."""
    return _updated(spark, sf_dir).reads


def tree_source_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files below folders whose path begins with ``/corpus/src1``, read as a
    table; other sources' folders are never opened."""
    root = _fresh_root(spark)
    _write(spark, sf_dir, root)
    datasource.register(spark)
    rows = spark.read.format(datasource.NAME).option("path", root).load()
    return _as_corpus(rows.filter(F.col("path").startswith(f"{root}/src1") & (F.col("kind") == "file")).select("path", "name", "size"), root)
