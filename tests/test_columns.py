"""Scalar column functions (B1–B9) on hand-made values."""

from pyspark.sql import functions as F

from tallyfs.functions import (
    category_of,
    extension_label,
    extension_of,
    is_excluded,
    is_hidden,
    leaf_name,
    size_text,
)


def _eval(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(v,) for v in values], f"x {typ}")
    return [r[0] for r in df.select(fn(F.col("x"))).collect()]


def test_extension_of(spark):
    names = [".gitignore", "a.tar.gz", "name.", "Makefile", "report.PDF", "__init__.py", "a b%20.txt", "x.TXT"]
    assert _eval(spark, names, extension_of) == ["gitignore", "gz", "", "", "pdf", "py", "txt", "txt"]


def test_extension_label_and_category(spark):
    exts = ["", "jpg", "pdf", "mp3", "mkv", "gz", "java", "parquet", "7z", "jpeg", "go"]
    assert _eval(spark, exts, extension_label)[:2] == ["No extension", "jpg"]
    assert _eval(spark, exts, category_of) == [
        "No extension", "Images", "Documents", "Audio", "Video", "Archive", "Source Code",
        "Others", "Archive", "Images", "Source Code"]


def test_hidden_is_leaf_only(spark):
    assert _eval(spark, [".env", "a.txt", ".hid"], is_hidden) == [True, False, True]


def test_excluded_ancestors_case_insensitive(spark):
    paths = ["/x/NODE_MODULES/a/b.js", "/x/node_modules", "/x/Program Files (x86)/a.exe",
             "/bin/ls", "/x/binary/a", "/a/.git/objects/ab", "/a/TARGET/x.class", "/a/b.txt"]
    # the leaf itself is not tested: "/x/node_modules" is a file named node_modules
    assert _eval(spark, paths, is_excluded) == [True, False, True, True, False, True, True, False]


def test_leaf_name(spark):
    assert _eval(spark, ["a/b/c.txt", "c.txt", "dir/"], leaf_name) == ["c.txt", "c.txt", ""]


def test_size_text_golden(spark):
    sizes = [0, 500, 1023, 1024, 1152, 2048, 1572864, 3610000000]
    want = ["0B", "500B", "1023B", "1.00 KB", "1.13 KB", "2.00 KB", "1.50 MB", "3.36 GB"]
    assert _eval(spark, sizes, size_text, "bigint") == want
