"""Tables whose versions are swapped at once.

A version is a folder of its own below ``<base>/data``; it is visible once a
small marker ``<base>/_versions/<number>`` names it. The marker is created
exclusively, so of two runs that commit the same number one fails, and a run
that dies while writing leaves the version before it in force: a folder without
a marker is never read, nor is a marker that was not written to its end.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

DIGITS = 12


class VersionedTable:
    """A folder of versions. ``read(part)`` reads a table of the current one."""

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        path = self._path(self.base)
        self._fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _path(self, text: str):
        return self._jvm.org.apache.hadoop.fs.Path(text)

    def _marker(self, number: int) -> str:
        return f"{self.base}/_versions/{number:0{DIGITS}d}"

    def versions(self) -> list[int]:
        """Numbers that have a marker, whole or not, ascending."""
        folder = self._path(f"{self.base}/_versions")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n) for n in names if n.isdigit())

    def _named(self, number: int) -> str | None:
        stream = self._fs.open(self._path(self._marker(number)))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return text[:-1] if text.endswith("\n") else None

    def current(self) -> tuple[int, str] | None:
        """(number, folder) of the newest committed version."""
        for number in reversed(self.versions()):
            if (name := self._named(number)) is not None:
                return number, f"{self.base}/data/{name}"
        return None

    def read(self, part: str, schema: str) -> DataFrame | None:
        """A table of the current version, or None before the first commit."""
        now = self.current()
        return None if now is None else self.spark.read.schema(schema).parquet(f"{now[1]}/{part}")

    def begin(self) -> str:
        """A fresh folder for the tables of the next version."""
        return f"{self.base}/data/{uuid.uuid4().hex}"

    def commit(self, folder: str, after: int | None = None) -> int:
        """Make ``folder`` the version after ``after`` (by default the newest
        marker). Raises if another run has taken that number."""
        if after is None:
            after = max(self.versions(), default=0)
        marker = self._path(self._marker(after + 1))
        try:
            stream = self._fs.create(marker, False)
        except Exception as exc:
            if "FileAlreadyExists" in str(exc):
                raise RuntimeError(f"version {after + 1} of {self.base} was committed by another run") from exc
            raise
        stream.write(bytearray((folder.rsplit("/", 1)[1] + "\n").encode()))
        stream.close()
        return after + 1
