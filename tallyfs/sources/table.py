"""Inventories derived from tables that hold content (A9).

A table with a path column and a content column (string or binary) becomes
an inventory with the same columns the tree listing produces. Folder rows are
derived from the paths: every distinct ancestor below the root, where an
archive entry counts through the archive's own parent directory.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyfs.functions.columns import (
    _re_escape,
    archive_of,
    extension_of,
    leaf_name,
    parent_path,
)
from tallyfs.schema import (
    KIND_DIR,
    KIND_FILE,
)


def _as_binary(df: DataFrame, content: str) -> Column:
    """The content as bytes. Spark strings are UTF-8 already, so a cast is a
    plain byte copy (``encode`` would go through a Java string and a charset
    encoder for every row)."""
    dtype = df.schema[content].dataType
    if isinstance(dtype, T.BinaryType):
        return F.col(content)
    return F.col(content).cast("string").cast("binary")


def table_files(df: DataFrame, path: str = "path", content: str | None = "content",
                size: str | None = None, mtime: str | None = None,
                sep: str = "/", name: str | None = None, from_archive: str | None = None,
                archive_path: str | None = None) -> DataFrame:
    """File rows of an inventory from a table; a path names one file.

    ``size`` defaults to the byte length of ``content`` (UTF-8 for strings).
    ``name`` defaults to the text after the last separator of the path (for
    an archive entry ``a.zip!/d/x`` that is ``x``). ``from_archive`` and
    ``archive_path`` name columns that say what is an archive entry; without
    them a path is one if ``!/`` follows a name with an archive's extension.
    """
    if size is not None:
        size_col = F.col(size).cast("long")
    elif content is not None:
        # octet_length of a string is its UTF-8 byte count, read without a copy
        size_col = F.octet_length(F.col(content)).cast("long")
    else:
        raise ValueError("need a size column or a content column")
    first = [
        F.col(path).alias("path"),
        (F.col(name) if name is not None else leaf_name(path, sep)).alias("name"),
        size_col.alias("size"),
        (F.col(mtime).cast("timestamp") if mtime else F.lit(None).cast("timestamp")).alias("mtime"),
    ]
    if content is not None:
        first.append(_as_binary(df, content).alias("content"))
    archive = F.col(archive_path).cast("string") if archive_path else archive_of(path)
    if from_archive:
        inside = F.coalesce(F.col(from_archive).cast("boolean"), F.lit(False))
        archive = F.when(inside, archive)
    else:
        inside = archive.isNotNull()
    first += [inside.alias("_inside"), archive.alias("_archive")]
    base = df.select(*first)
    cols = [
        F.lit(KIND_FILE).alias("kind"),
        "path",
        "name",
        "size",
        extension_of("name").alias("extension"),
        F.col("_inside").alias("from_archive"),
        F.col("_archive").alias("archive_path"),
        "mtime",
        F.lit(None).cast("string").alias("error"),
    ]
    if content is not None:
        cols.append("content")
    return base.select(*cols)


def folder_rows(files: DataFrame, root: str | None = None, sep: str = "/") -> DataFrame:
    """Directory rows implied by file paths: distinct ancestors strictly below
    ``root`` (all ancestors but the file-system root when ``root`` is None).

    Parents are de-duplicated before the prefixes are exploded, so the explode
    sees one row per directory that holds files, not one per file.
    """
    base = F.coalesce(F.col("archive_path"), F.col("path"))
    parents = files.select(parent_path(base, sep).alias("dir")).distinct()
    if root is not None:
        root = root.rstrip(sep) or sep
        parents = parents.filter(F.col("dir").startswith(root + sep))
        depth0 = len(root.split(sep))
    else:
        depth0 = 1
    esc = _re_escape(sep).replace("\\", "\\\\").replace("'", "\\'")
    lit_sep = sep.replace("\\", "\\\\").replace("'", "\\'")
    parts = f"split(dir, '{esc}')"
    dirs = (parents.filter(F.expr(f"size({parts}) > {depth0}"))
            .selectExpr(f"explode(transform(sequence({depth0 + 1}, size({parts})), "
                        f"k -> array_join(slice({parts}, 1, k), '{lit_sep}'))) as path")
            .distinct())
    return dirs.select(
        F.lit(KIND_DIR).alias("kind"),
        F.col("path"),
        leaf_name("path", sep).alias("name"),
        F.lit(None).cast("long").alias("size"),
        F.lit(None).cast("string").alias("extension"),
        F.lit(False).alias("from_archive"),
        F.lit(None).cast("string").alias("archive_path"),
        F.lit(None).cast("timestamp").alias("mtime"),
        F.lit(None).cast("string").alias("error"),
    )


def table_inventory(df: DataFrame, path: str = "path", content: str | None = "content",
                    root: str | None = None, size: str | None = None,
                    mtime: str | None = None, sep: str = "/",
                    with_folders: bool = True) -> DataFrame:
    """Full inventory (files and folders) from a table with content.

    The result has the inventory columns plus ``content`` (null on folders)
    when a content column is given.
    """
    files = table_files(df, path=path, content=content, size=size, mtime=mtime, sep=sep)
    if not with_folders:
        return files
    dirs = folder_rows(files.select("path", "archive_path"), root=root, sep=sep)
    if "content" in files.columns:
        dirs = dirs.withColumn("content", F.lit(None).cast("binary"))
    return files.unionByName(dirs)
