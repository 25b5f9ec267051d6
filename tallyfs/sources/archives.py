"""Archive entries (A4–A6, J4): each ZIP becomes one row per file entry.

Only a ZIP's central directory is read (``zipfile`` seeks to it), never the
compressed data; a long directory is dealt out in byte ranges (``zip_split``). Tar containers (opt-in through ``archive_extensions``) have
no directory and are read as a stream. Archives come either from storage (by path, opened on the
executors) or from a binary column of a table-backed inventory. An archive
that cannot be read yields one ``archive_error`` row instead of entries; it
never fails the job. Output is streamed in bounded batches, so an archive with
millions of entries does not build one huge frame.
"""

from __future__ import annotations

import bz2
import gzip
import io
import itertools
import lzma
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfs.functions.columns import extension_of, is_archive
from tallyfs.schema import ARCHIVE_EXTENSIONS, ARCHIVE_SEPARATOR, INVENTORY_COLUMNS, KIND_FILE
from tallyfs.session import ship_package
from tallyfs.sources.readers import open_regular
from tallyfs.sources.storage import Store, python_file
from tallyfs.sources.tree import readable_name
from tallyfs.sources.zip_split import (SPLIT_BYTES, aligned_ranges, checked_ranges, cut_ranges, directory_places,
                                       range_source)

KIND_ARCHIVE_ERROR = "archive_error"
ENTRY_SCHEMA = ("kind string, path string, name string, size bigint, "
                "from_archive boolean, archive_path string, error string")
BATCH_ROWS = 10_000
# Containers read as tar streams when a caller adds them to the archive
# extensions (the default is ZIP only).
TAR_EXTENSIONS = (".tar", ".tgz", ".gz", ".bz2", ".xz")
SINGLE_EXTENSIONS = (".gz", ".bz2", ".xz")


def _entries(archive: str, source, store: Store | None = None) -> Iterator[tuple]:
    """Rows for one archive; the last row is an error row if reading failed
    (entries listed before the failure are kept)."""
    low = archive.lower()
    try:
        if isinstance(source, str):
            source = python_file(store.open(source) if store is not None else open_regular(source))
        if low.endswith(TAR_EXTENSIONS):
            found = _tar_entries(source, archive[archive.rfind("/") + 1:])
        else:
            found = _zip_entries(source)
        for entry, size in found:
            name = entry[entry.rfind("/") + 1:]
            if (shown := readable_name(entry)) is not None:
                yield (KIND_ARCHIVE_ERROR, archive + ARCHIVE_SEPARATOR + shown, readable_name(name) or name, None, False,
                       None, "undecodable name")
                continue
            yield (KIND_FILE, archive + ARCHIVE_SEPARATOR + entry, name, size, True, archive, None)
    except Exception as exc:  # whatever a damaged archive makes a codec raise
        yield (KIND_ARCHIVE_ERROR, archive, archive[archive.rfind("/") + 1:], None, False,
               None, f"{type(exc).__name__}: {exc}")
    finally:
        if hasattr(source, "close"):
            source.close()


def _zip_entries(source) -> Iterator[tuple[str, int | None]]:
    """File entries of a ZIP from its central directory; names without the
    UTF-8 flag are decoded as UTF-8 too (a failure makes an error row)."""
    with zipfile.ZipFile(source, metadata_encoding="utf-8") as zf:
        for info in zf.infolist():
            if info.is_dir():
                continue
            size = info.file_size if info.file_size is not None and info.file_size >= 0 else None
            yield info.filename, size


def _tar_entries(source, leaf: str) -> Iterator[tuple[str, int | None]]:
    """Regular-file members of a (possibly compressed) tar. A tar has no
    central directory, so the whole stream is read, member by member. A
    compressed file that is no tar is a container of one entry, named like the
    file without its ending, of unknown size."""
    try:
        tf = tarfile.open(fileobj=source, mode="r:*")
    except tarfile.ReadError:
        single = next((x for x in SINGLE_EXTENSIONS if leaf.lower().endswith(x)), None)
        source.seek(0)
        if single is None or not _decompresses(source, single):
            raise
        yield leaf[:-len(single)], None
        return
    with tf:
        for member in tf:
            if member.isfile():
                yield member.name, int(member.size)


def _decompresses(source, ending: str) -> bool:
    """Whether the first bytes are those of a compressed stream."""
    if not source.read(1):
        return False
    source.seek(0)
    opener = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}[ending]
    try:
        with opener(source) as fh:
            fh.read(1)
        return True
    except (OSError, EOFError, lzma.LZMAError):
        return False


def _frame(rows: list[tuple]) -> pd.DataFrame:
    cols = ["kind", "path", "name", "size", "from_archive", "archive_path", "error"]
    df = pd.DataFrame(rows, columns=cols)
    df["size"] = df["size"].astype("Int64")
    return df


def _in_batches(rows: Iterator[tuple]) -> Iterator[pd.DataFrame]:
    while buf := list(itertools.islice(rows, BATCH_ROWS)):
        yield _frame(buf)


def _list_batches(content_col: str | None, store: Store | None = None):
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            paths = pdf["path"].tolist()
            blobs = pdf[content_col].tolist() if content_col else [None] * len(paths)
            for path, blob in zip(paths, blobs):
                source = io.BytesIO(blob if blob is not None else b"") if content_col else path
                yield from _entries(path, source, store)
    return lambda batches: _in_batches(listed(batches))


def _list_ranges(store: Store | None):
    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                yield from _entries(r.path, range_source(r, store))
    return lambda batches: _in_batches(listed(batches))


def _list_split(large: DataFrame, n: int, archives_per_task: int, store: Store | None,
                split_bytes: int) -> tuple[DataFrame, DataFrame]:
    """(archives of ``large`` that are better read whole, rows of the others)."""
    spark = large.sparkSession
    places = directory_places(large, n, archives_per_task, store)
    whole = places.filter(f"hi is null or hi - lo <= {int(split_bytes)}").select("path")
    good, bad = checked_ranges(aligned_ranges(cut_ranges(places, split_bytes), store), store)
    errors = bad.select(
        F.lit(KIND_ARCHIVE_ERROR).alias("kind"), "path", F.substring_index("path", "/", -1).alias("name"),
        F.lit(None).cast("long").alias("size"), F.lit(False).alias("from_archive"),
        F.lit(None).cast("string").alias("archive_path"), "error")
    ship_package(spark)
    return whole, good.mapInPandas(_list_ranges(store), ENTRY_SCHEMA).unionByName(errors)


def list_archives(archives: DataFrame, content: str | None = None,
                  archives_per_task: int = 256, n_archives: int | None = None, store: Store | None = None,
                  split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Entries and error rows of the archives in ``archives`` (rows with a
    ``path``, and a binary ``content`` column for table-backed archives).

    Archives read by path are spread over tasks by a hash of their path,
    ``archives_per_task`` each; a ZIP larger than ``split_bytes`` (by the
    column ``size``, if there is one) whose directory is longer than that is
    listed in ranges of ``split_bytes``, about 8 MB of directory to a task. Archives held in a
    content column are listed where the scan put them, so their bytes are never
    shuffled.
    """
    spark = archives.sparkSession
    ship_package(spark)
    cols = ["path"] + ([content] if content else [])
    src, split = archives.select(*cols), None
    if content is None:
        n = src.count() if n_archives is None else n_archives
        if "size" in archives.columns:
            stream = F.lower("path").rlike("(" + "|".join(TAR_EXTENSIONS).replace(".", "[.]") + ")$")
            large = F.coalesce((F.col("size") > split_bytes) & ~stream, F.lit(False))
            if n_large := archives.filter(large).count():
                whole, split = _list_split(archives.filter(large), n_large, archives_per_task, store, split_bytes)
                src = archives.filter(~large).select("path").unionByName(whole)
        parts = max(spark.sparkContext.defaultParallelism, -(-n // archives_per_task))
        src = src.repartition(max(1, min(parts, n)), "path")
    listed = src.mapInPandas(_list_batches(content, store), ENTRY_SCHEMA)
    if split is not None:
        listed = listed.unionByName(split)
    return listed.select(
        "kind", "path", "name", "size", F.when(F.col("kind") == KIND_FILE, extension_of("name")).alias("extension"),
        "from_archive", "archive_path", F.lit(None).cast("timestamp").alias("mtime"), "error")


def archive_entries(files: DataFrame, content: str | None = None,
                    archive_extensions: tuple[str, ...] = ARCHIVE_EXTENSIONS) -> DataFrame:
    """File entries of every archive among ``files`` (directory entries
    dropped), in inventory columns."""
    zips = files.filter((F.col("kind") == KIND_FILE) & is_archive("extension", archive_extensions))
    return list_archives(zips, content).filter(F.col("kind") == KIND_FILE)


def archive_errors(files: DataFrame, content: str | None = None,
                   archive_extensions: tuple[str, ...] = ARCHIVE_EXTENSIONS) -> DataFrame:
    """(path, error) for archives that cannot be read; they add nothing to
    any total."""
    zips = files.filter((F.col("kind") == KIND_FILE) & is_archive("extension", archive_extensions))
    return list_archives(zips, content).filter(F.col("kind") == KIND_ARCHIVE_ERROR).select("path", "error")


def expand_archives(inv: DataFrame, content: str | None = None,
                    listed: DataFrame | None = None,
                    archive_extensions: tuple[str, ...] = ARCHIVE_EXTENSIONS) -> DataFrame:
    """Replace every archive by its entries: the archive's own row and size
    leave the inventory, its entries (uncompressed sizes) join it.

    ``listed`` may pass a materialized :func:`list_archives` result so the
    archives are read once for entries and errors.
    """
    zip_row = (F.col("kind") == KIND_FILE) & is_archive("extension", archive_extensions)
    if listed is None:
        listed = list_archives(inv.filter(zip_row), content)
    entries = listed.filter(F.col("kind") == KIND_FILE)
    keep = inv.filter(~zip_row).select(*INVENTORY_COLUMNS)
    return keep.unionByName(entries.select(*INVENTORY_COLUMNS))
