"""The directory of one large ZIP as many tasks (A4).

A ZIP ends with a directory: one header per entry, of no fixed length, which
says where the next one starts. A directory of more than ``split_bytes`` is cut
into byte ranges, and a range owns the headers that start in it:

1. A task per archive reads only the end of the file and says where the
   directory lies.
2. A task per range looks for a header's signature from which the chain of
   lengths leads through the range to another header, and notes where it starts
   and where the first header behind the range does.
3. A signature may also occur within a name or comment. The start of every range
   must therefore be where the range before it ended; ranges that began
   elsewhere are read again from the right place until all agree. The first
   range begins rightly, so this ends, mostly at once.

The bytes of a range, closed with an end record, are a small ZIP directory of
their own, read by the same reader as whole archives. Directories are never
shuffled: every step reads its range of the file again. An archive with a range
that cannot be read has one error and no entries, as when it is read whole.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyfs.plans.materialize import bounded_broadcast, materialize
from tallyfs.session import ship_package
from tallyfs.sources.readers import open_regular
from tallyfs.sources.storage import Store

#: Bytes of a range; a directory of no more is read whole by one task. About
#: 100,000 entries.
SPLIT_BYTES = 8 << 20
BROADCAST_PATHS = 100_000

# Fixed values of the format.
HEADER, HEADER_BYTES, LENGTHS_AT = b"PK\x01\x02", 46, 28
END, END_RECORD = b"PK\x05\x06", struct.Struct("<4s4H2LH")
END64, END64_RECORD = b"PK\x06\x06", struct.Struct("<4sQ2H2L4Q")
LOCATOR, LOCATOR_RECORD = b"PK\x06\x07", struct.Struct("<4sLQL")
MAX_FIELD = (1 << 16) - 1
MAX_HEADER = HEADER_BYTES + 3 * MAX_FIELD

PLACE_SCHEMA = "path string, lo bigint, hi bigint"
RANGE_SCHEMA = "path string, k int, lo bigint, hi bigint, end bigint, start bigint, next bigint"
ERROR_SCHEMA = "path string, k int, error string"


def _open(path: str, store: Store | None):
    return store.open(path) if store is not None else open_regular(path)


def _read(fh, start: int, stop: int) -> bytes:
    fh.seek(start)
    return fh.read(max(0, stop - start))


def directory_range(fh) -> tuple[int, int] | None:
    """First byte of an archive's directory and the byte behind it; None if the
    file has no end record that says so."""
    size = fh.seek(0, io.SEEK_END)
    base = max(0, size - MAX_FIELD - END_RECORD.size - LOCATOR_RECORD.size - END64_RECORD.size)
    tail = _read(fh, base, size)
    at = len(tail) - END_RECORD.size
    if at < 0:
        return None
    if tail[at:at + 4] != END or tail[-2:] != b"\0\0":
        at = tail.rfind(END)
        if at < 0 or at + END_RECORD.size > len(tail):
            return None
    length, stop = END_RECORD.unpack_from(tail, at)[5], at
    locator = at - LOCATOR_RECORD.size
    record = locator - END64_RECORD.size
    if record >= 0 and tail[locator:locator + 4] == LOCATOR and tail[record:record + 4] == END64:
        length, stop = END64_RECORD.unpack_from(tail, record)[8], record
    hi = base + stop
    return (hi - length, hi) if length <= hi else None


def follow(data: bytes, at: int, limit: int) -> int | None:
    """Where the first header at or behind ``limit`` starts, by the chain from
    ``at``; None if the chain meets something else."""
    while at < limit:
        if data[at:at + 4] != HEADER or at + HEADER_BYTES > len(data):
            return None
        at += HEADER_BYTES + sum(struct.unpack_from("<3H", data, at + LENGTHS_AT))
    return at


def find_start(data: bytes, limit: int, last: bool) -> tuple[int, int] | None:
    """The first signature before ``limit`` whose chain reaches a header behind
    it (in the last range: the end), and that place."""
    at = data.find(HEADER)
    while 0 <= at < limit:
        behind = follow(data, at, limit)
        if behind is not None and (behind >= limit if last else data[behind:behind + 4] in (HEADER, b"")):
            return at, behind
        at = data.find(HEADER, at + 1)
    return None


def _places(store: Store | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for path in pdf["path"]:
                try:
                    fh = _open(path, store)
                    try:
                        found.append(directory_range(fh) or (None, None))
                    finally:
                        fh.close()
                except OSError:  # reading it whole says why
                    found.append((None, None))
            out = pd.DataFrame(found, columns=["lo", "hi"]).astype("Int64")
            out.insert(0, "path", pdf["path"].to_numpy())
            yield out
    return run


def _walk_one(fh, lo: int, hi: int, end: int, due: int | None) -> tuple[int | None, int | None]:
    """(start, next) of a range, from ``due`` if that is known."""
    if due is not None and due >= hi:
        return due, due
    start = lo if due is None else due
    data = _read(fh, start, min(hi + MAX_HEADER + 4, end))
    if due is not None:
        behind = follow(data, 0, hi - start)
        return due, None if behind is None else start + behind
    found = find_start(data, hi - start, hi == end)
    return (None, None) if found is None else (start + found[0], start + found[1])


def _walk(store: Store | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                due = None if pd.isna(r.due) else int(r.due)
                try:
                    fh = _open(r.path, store)
                    try:
                        start, behind = _walk_one(fh, int(r.lo), int(r.hi), int(r.end), due)
                    finally:
                        fh.close()
                except OSError:  # the check of the range meets it again and keeps the message
                    start, behind = due, None
                out.append((r.path, int(r.k), int(r.lo), int(r.hi), int(r.end), start, behind))
            df = pd.DataFrame(out, columns=["path", "k", "lo", "hi", "end", "start", "next"])
            yield df.astype({"start": "Int64", "next": "Int64"})
    return run


def range_directory(fh, start: int, stop: int) -> io.BytesIO:
    """The headers between two places as a ZIP without content."""
    data = _read(fh, start, stop)
    return io.BytesIO(data + END_RECORD.pack(END, 0, 0, 0, 0, len(data), 0, 0))


def range_source(r, store: Store | None) -> io.BytesIO:
    """``range_directory`` of a row of the ranges. A range whose chain breaks
    has no ``next``; its bytes make the reader say what is wrong."""
    stop = min(int(r.hi) + MAX_HEADER, int(r.end)) if pd.isna(r.next) else min(int(r.next), int(r.end))
    fh = _open(r.path, store)
    try:
        return range_directory(fh, int(r.start), stop)
    finally:
        fh.close()


def _check(store: Store | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            bad = []
            for r in pdf.itertuples(index=False):
                try:
                    with zipfile.ZipFile(range_source(r, store), metadata_encoding="utf-8"):
                        broken = None
                    if pd.isna(r.next):
                        broken = "BadZipFile: Bad magic number for central directory"
                except Exception as exc:  # whatever a damaged directory makes the reader raise
                    broken = f"{type(exc).__name__}: {exc}"
                if broken is not None:
                    bad.append((r.path, int(r.k), broken))
            yield pd.DataFrame(bad, columns=["path", "k", "error"])
    return run


def directory_places(large: DataFrame, n: int, archives_per_task: int, store: Store | None) -> DataFrame:
    """(path, lo, hi) of each archive's directory, nulls where there is none."""
    spark = large.sparkSession
    ship_package(spark)
    parts = max(spark.sparkContext.defaultParallelism, -(-n // archives_per_task))
    return materialize(spark, large.select("path").repartition(max(1, min(n, parts)), "path")
                       .mapInPandas(_places(store), PLACE_SCHEMA), "zip_places")


def cut_ranges(places: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, k, lo, hi, end): the byte ranges of the directories longer than
    ``split_bytes``; ``end`` is the directory's."""
    cut = places.filter(F.col("hi") - F.col("lo") > split_bytes).select(
        "path", F.col("hi").alias("end"),
        F.posexplode(F.expr(f"sequence(lo, hi - 1, {int(split_bytes)}L)")).alias("k", "lo"))
    return cut.select("path", "k", "lo", F.least(F.col("lo") + int(split_bytes), F.col("end")).alias("hi"), "end")


def _deal(ranges: DataFrame, task_bytes: int) -> tuple[DataFrame, int]:
    """The ranges spread over tasks of about ``task_bytes`` of directory, and
    the number of ranges."""
    n, size = ranges.agg(F.count("*"), F.coalesce(F.sum(F.col("hi") - F.col("lo")), F.lit(0))).first()
    tasks = max(ranges.sparkSession.sparkContext.defaultParallelism, -(-size // task_bytes))
    return ranges.repartition(max(1, min(n, tasks)), "path", "k"), n


def aligned_ranges(ranges: DataFrame, store: Store | None = None, task_bytes: int = SPLIT_BYTES) -> DataFrame:
    """The ranges with ``start``, their first header, and ``next``, the first
    one behind them. ``next`` is null where the directory is damaged, and what
    follows in that archive means nothing."""
    spark = ranges.sparkSession
    ship_package(spark)
    first, _ = _deal(ranges.withColumn("due", F.when(F.col("k") == 0, F.col("lo"))), task_bytes)
    known = materialize(spark, first.mapInPandas(_walk(store), RANGE_SCHEMA), "zip_ranges")
    # A window holds the ranges of one archive, a few numbers for each.
    before = Window.partitionBy("path").orderBy("k")
    while True:
        seen = known.withColumn("due", F.lag("next").over(before))
        wrong = F.col("due").isNotNull() & ~F.col("start").eqNullSafe(F.col("due"))
        again, n_wrong = _deal(seen.filter(wrong), task_bytes)
        if n_wrong == 0:
            return known
        known = materialize(spark, seen.filter(~wrong).drop("due").unionByName(again.mapInPandas(_walk(store), RANGE_SCHEMA)), "zip_ranges")


def checked_ranges(ranges: DataFrame, store: Store | None = None,
                   task_bytes: int = SPLIT_BYTES) -> tuple[DataFrame, DataFrame]:
    """(ranges with headers of sound archives, (path, error) of damaged ones:
    what their first damaged range says)."""
    spark = ranges.sparkSession
    owning = ranges.filter("start is not null and start < hi")
    dealt, _ = _deal(owning, task_bytes)
    bad = dealt.mapInPandas(_check(store), ERROR_SCHEMA).groupBy("path").agg(F.min_by("error", "k").alias("error"))
    bad = materialize(spark, bad, "zip_errors")
    few, _ = bounded_broadcast(bad.select("path"), BROADCAST_PATHS)
    sound, _ = _deal(owning.join(few, "path", "left_anti"), task_bytes)
    return sound, bad
