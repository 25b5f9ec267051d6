"""Scalar column functions over inventory columns.

All of them are built-in Spark expressions, so they stay inside whole-stage
codegen; none is a Python UDF.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyfs.schema import (
    ARCHIVE_EXTENSIONS,
    ARCHIVE_SEPARATOR,
    CATEGORY_EXTENSIONS,
    EXCLUDED_DIRECTORIES,
    NO_EXTENSION,
    OTHERS,
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _memo(fn):
    """Build an expression once per set of plain (name / literal) arguments.

    An unresolved Column is an expression tree that any number of DataFrames
    may use, so rebuilding it (dozens of calls into the JVM for the longer
    ones) for every query only costs driver time.
    """
    cached = functools.lru_cache(maxsize=256)(fn)

    @functools.wraps(fn)
    def wrapper(*args, **kwargs):
        try:
            hash((args, tuple(sorted(kwargs.items()))))
        except TypeError:
            return fn(*args, **kwargs)
        if any(isinstance(a, Column) for a in args) or any(isinstance(v, Column) for v in kwargs.values()):
            return fn(*args, **kwargs)
        return cached(*args, **kwargs)
    return wrapper


@_memo
def extension_of(name: Column | str) -> Column:
    """Text after the last dot, lowercased; ``""`` when the name has no dot.

    ``.gitignore`` -> ``gitignore``, ``a.tar.gz`` -> ``gz``, ``name.`` -> ``""``.
    """
    n = _col(name)
    return F.when(F.instr(n, ".") > 0, F.lower(F.substring_index(n, ".", -1))).otherwise(F.lit(""))


@_memo
def leaf_name(path: Column | str, sep: str = "/") -> Column:
    """Text after the last separator (the whole value when there is none)."""
    return F.substring_index(_col(path), sep, -1)


@_memo
def parent_path(path: Column | str, sep: str = "/") -> Column:
    """Everything before the last separator (``""`` for a bare name)."""
    esc = _re_escape(sep)
    return F.regexp_extract(_col(path), r"^(.*)" + esc + r"[^" + esc + r"]*$", 1)


def _re_escape(s: str) -> str:
    return "".join("\\" + ch if ch in r"\^$.|?*+()[]{}/" else ch for ch in s)


@_memo
def archive_of(path: Column | str, archive_extensions: tuple[str, ...] = ARCHIVE_EXTENSIONS) -> Column:
    """Archive part of a virtual path ``<archive>!/<entry>``, null for a plain
    path. Only a name with an archive's extension makes an archive: a folder
    may end in ``!`` too."""
    ends = "|".join(_re_escape(x) for x in archive_extensions)
    found = F.regexp_extract(_col(path), rf"(?is)^(.*?\.(?:{ends})){_re_escape(ARCHIVE_SEPARATOR)}", 1)
    return F.when(found != "", found)


@_memo
def extension_label(extension: Column | str) -> Column:
    """Empty or null extension -> ``No extension``."""
    e = _col(extension)
    return F.when(e.isNull() | (e == ""), F.lit(NO_EXTENSION)).otherwise(e)


@_memo
def category_of(extension: Column | str) -> Column:
    """Fixed category of an extension (see :data:`CATEGORY_EXTENSIONS`).

    A CASE chain over literal sets: no join, no shuffle, evaluated in codegen.
    """
    e = _col(extension)
    expr = F.when(e.isNull() | (e == ""), F.lit(NO_EXTENSION))
    for category, exts in CATEGORY_EXTENSIONS.items():
        expr = expr.when(e.isin(*exts), F.lit(category))
    return expr.otherwise(F.lit(OTHERS))


@_memo
def is_hidden(name: Column | str) -> Column:
    """Hidden file: the leaf name starts with a dot (ancestors are not tested)."""
    return _col(name).startswith(".")


@_memo
def is_excluded(path: Column | str, sep: str = "/",
                excluded: tuple[str, ...] = EXCLUDED_DIRECTORIES) -> Column:
    """True when any ancestor directory name (case-insensitive) is excluded.

    Every ancestor counts, also those above a scan root; the leaf itself is not
    tested.
    """
    parts = F.split(_col(path), _re_escape(sep))
    ancestors = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))
    wanted = F.array(*[F.lit(x) for x in excluded])
    return F.coalesce(F.arrays_overlap(F.transform(ancestors, F.lower), wanted), F.lit(False))


@_memo
def is_archive(extension: Column | str,
               archive_extensions: tuple[str, ...] = ARCHIVE_EXTENSIONS) -> Column:
    return F.coalesce(_col(extension).isin(*archive_extensions), F.lit(False))


@_memo
def hash_eligible(name: Column | str = "name", path: Column | str = "path",
                  from_archive: Column | str = "from_archive", sep: str = "/") -> Column:
    """Files that take part in duplicate detection: not an archive entry, not
    hidden, not below an excluded directory."""
    return (~F.coalesce(_col(from_archive), F.lit(False))) & ~is_hidden(name) & ~is_excluded(path, sep)


_KB = 1024
_MB = 1024 * 1024
_GB = 1024 * 1024 * 1024


@_memo
def size_text(size: Column | str) -> Column:
    """Human size: ``500B`` below 1 KiB, else two decimals in KB / MB / GB
    (powers of 1024, halves rounded up, no TB)."""
    s = _col(size)
    return (
        F.when(s.isNull(), F.lit(None).cast("string"))
        .when(s < _KB, F.concat(s.cast("string"), F.lit("B")))
        .when(s < _MB, F.format_string("%.2f KB", s / F.lit(float(_KB))))
        .when(s < _GB, F.format_string("%.2f MB", s / F.lit(float(_MB))))
        .otherwise(F.format_string("%.2f GB", s / F.lit(float(_GB))))
    )


def sha256_hex(content: Column | str) -> Column:
    """Lowercase hex SHA-256 of a binary column."""
    return F.sha2(_col(content), 256)


def quick_sha256_hex(content: Column | str, prefix_bytes: int) -> Column:
    """Lowercase hex SHA-256 of the first ``prefix_bytes`` bytes."""
    return F.sha2(F.substring(_col(content), 1, prefix_bytes), 256)
