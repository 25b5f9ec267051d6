"""Archives made from the driver's tables, for the archive operators.

Documents are packed into ZIP files of ``DOCS_PER_BUNDLE`` consecutive ids:
``/corpus/bundle_<doc_id div 64>.zip`` holding
``<source>/<lang>/doc_<doc_id>.TXT``. A group is bounded by the bundle size,
whatever the skew of ``source`` or ``lang``. Web pages stored under a ``.zip`` name are
archives that cannot be opened.
"""

from __future__ import annotations

import gzip
import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.plans.corpus import read_table
from tallyfs.plans.materialize import materialize
from tallyfs.session import scratch_path, ship_package
from tallyfs.sources.archives import KIND_FILE, list_archives
from tallyfs.sources.storage import Store, normal_path
from tallyfs.sources.table import table_files
from tallyfs.sources.zip_split import cut_ranges, directory_places

DOCS_PER_BUNDLE = 64
#: The bundles' directories are a few KB long; ranges of this length cut them.
BUNDLE_RANGE = 1024
_FIXED_TIME = (1980, 1, 1, 0, 0, 0)


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w", compression=zipfile.ZIP_DEFLATED) as zf:
        for source in sorted(set(pdf["source"])):  # directory entries, which are no files
            zf.writestr(zipfile.ZipInfo(f"{source}/", date_time=_FIXED_TIME), b"")
        for doc_id, source, lang, text in zip(pdf["doc_id"], pdf["source"], pdf["lang"], pdf["text"]):
            info = zipfile.ZipInfo(f"{source}/{lang}/doc_{int(doc_id)}.TXT", date_time=_FIXED_TIME)
            info.compress_type = zipfile.ZIP_DEFLATED
            zf.writestr(info, (text or "").encode("utf-8"))
    path = f"/corpus/bundle_{int(pdf['bundle'].iloc[0])}.zip"
    return pd.DataFrame({"path": [path], "content": [buf.getvalue()]})


def _pack_tar(pdf: pd.DataFrame, mode: str = "w", ending: str = "tar") -> pd.DataFrame:
    pdf = pdf.sort_values("doc_id")
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode=mode) as tf:
        for doc_id, source, lang, text in zip(pdf["doc_id"], pdf["source"], pdf["lang"], pdf["text"]):
            data = (text or "").encode("utf-8")
            info = tarfile.TarInfo(f"{source}/{lang}/doc_{int(doc_id)}.TXT")
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))
    path = f"/corpus/bundle_{int(pdf['bundle'].iloc[0])}.{ending}"
    return pd.DataFrame({"path": [path], "content": [buf.getvalue()]})


def _pack_mixed(pdf: pd.DataFrame) -> pd.DataFrame:
    """By the bundle's number a tar.gz, a tar.xz, or one gzip file per document."""
    k = int(pdf["bundle"].iloc[0]) % 3
    if k < 2:
        return _pack_tar(pdf, *(("w:gz", "tar.gz"), ("w:xz", "tar.xz"))[k])
    return pd.DataFrame({"path": [f"/corpus/doc_{int(i)}.TXT.gz" for i in pdf["doc_id"]],
                         "content": [gzip.compress((t or "").encode("utf-8"), mtime=0) for t in pdf["text"]]})


def bundle_table(spark: SparkSession, sf_dir: str, fmt: str = "zip") -> DataFrame:
    """(path, content): one ZIP per ``doc_id div 64``; with ``fmt`` a tar, or
    ``mixed`` compressed containers."""
    d = read_table(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", "text",
        F.floor(F.col("doc_id") / DOCS_PER_BUNDLE).cast("long").alias("bundle"))
    ship_package(spark)
    pack = {"tar": lambda pdf: _pack_tar(pdf), "mixed": _pack_mixed}.get(fmt, _pack)
    return d.groupBy("bundle").applyInPandas(pack, "path string, content binary")


def bundle_inventory(spark: SparkSession, sf_dir: str, fmt: str = "zip") -> DataFrame:
    """File rows (with content) of the bundles."""
    return table_files(bundle_table(spark, sf_dir, fmt), path="path", content="content")


def fake_archive_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages stored as ``/corpus/pages/page_<id>.zip``: ZIP by name, HTML inside."""
    p = read_table(spark, sf_dir, "pages").select(
        F.concat(F.lit("/corpus/pages/page_"), F.col("page_id").cast("string"), F.lit(".zip")).alias("path"),
        "html")
    return table_files(p, path="path", content="html")


def plain_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as plain text files ``/corpus/benchmark/item_<id>.txt``."""
    b = read_table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("/corpus/benchmark/item_"), F.col("item_id").cast("string"), F.lit(".txt")).alias("path"),
        "text")
    return table_files(b, path="path", content="text")


def mixed_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain files, good archives and unreadable archives in one inventory."""
    return (plain_inventory(spark, sf_dir)
            .unionByName(bundle_inventory(spark, sf_dir))
            .unionByName(fake_archive_inventory(spark, sf_dir)))


def _write_bundles(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store = Store()
        for pdf in batches:
            paths = [root + path.removeprefix("/corpus") for path in pdf["path"]]
            for path, data in zip(paths, pdf["content"]):
                with store.create(path) as fh:
                    fh.write(data)
            yield pd.DataFrame({"path": paths, "size": [len(data) for data in pdf["content"]]})
    return run


def written_bundles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """(path, size) of the bundles written as files, and their folder."""
    root = normal_path(scratch_path(spark, "bundles"))
    Store().make_folder(root)
    files = bundle_table(spark, sf_dir).mapInPandas(_write_bundles(root), "path string, size bigint")
    return materialize(spark, files, "bundle_files"), root


def split_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the written bundles, their directories dealt out by ranges."""
    files, root = written_bundles(spark, sf_dir)
    rows = list_archives(files, split_bytes=BUNDLE_RANGE).filter(F.col("kind") == KIND_FILE)
    cut = [F.concat(F.lit("/corpus"), F.expr(f"substring({c}, {len(root) + 1})")).alias(c) for c in ("path", "archive_path")]
    return rows.select(*cut, "name", "size", "extension", "from_archive")


def split_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(path, directory_bytes, ranges) of the written bundles whose directory is cut."""
    files, root = written_bundles(spark, sf_dir)
    places = directory_places(files, files.count(), 256, None)
    ranges = cut_ranges(places, BUNDLE_RANGE).groupBy("path").agg(
        (F.max("end") - F.min("lo")).alias("directory_bytes"), F.count("*").alias("ranges"))
    return ranges.withColumn("path", F.concat(F.lit("/corpus"), F.expr(f"substring(path, {len(root) + 1})")))
