"""Small files that say a result is complete.

A marker is created exclusively, so of two writers of one name one fails, and it
ends with a line end: a marker that was not written to its end says nothing.
"""

from __future__ import annotations

from pyspark.sql import SparkSession


def _path(spark: SparkSession, text: str):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def put_marker(spark: SparkSession, name: str, text: str) -> None:
    """Create the marker ``name``; raises if it is there."""
    path, fs = _path(spark, name)
    stream = fs.create(path, False)
    try:
        stream.write(bytearray((text + "\n").encode()))
    finally:
        stream.close()


def markers(spark: SparkSession, folder: str) -> dict[str, str]:
    """Text of every whole marker in a folder, by name."""
    path, fs = _path(spark, folder)
    if not fs.exists(path):
        return {}
    out = {}
    for status in fs.listStatus(path):
        stream = fs.open(status.getPath())
        try:
            text = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        if text.endswith("\n"):
            out[status.getPath().getName()] = text[:-1]
    return out
