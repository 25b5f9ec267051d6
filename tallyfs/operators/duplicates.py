"""Exact-duplicate detection: size -> first 8 KB hash -> full SHA-256 (D4–D7,
G1, G3, G4, I4, I5).

Each tier is an aggregation (partial aggregation first, so a size or hash held
by a third of all files costs one row per task before the shuffle) followed by
a semi join that keeps the members of groups of two or more. Content is never
shuffled: hashes are computed where the content is, and only narrow rows
(path, size, hashes) cross the network.

Groups are kept in long form (one row per file); nothing ever collects the
members of a group into one value, as one group (the zero-byte files, say) may
hold millions of paths.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfs.functions.columns import hash_eligible, quick_sha256_hex, sha256_hex
from tallyfs.operators.aggregates import files_only
from tallyfs.plans.materialize import materialize
from tallyfs.schema import QUICK_HASH_BYTES
from tallyfs.sources.storage import Store

# Largest number of hot keys (64-char hash, size: under 100 bytes a row, so
# under 50 MB) that may be broadcast; beyond it they are joined by a shuffle.
DEFAULT_BROADCAST_KEYS = 500_000

# A key (size, hash or group) with more members than this is "hot": joining
# its members to its key row is spread by a hash of the path over as many salts
# as it has this many members, whether or not AQE's skew handling is on. Hot
# keys number at most rows / HOT_COPIES, so they are a small, bounded broadcast.
HOT_COPIES = 1_000_000


def eligible_files(inv: DataFrame) -> DataFrame:
    """Files that take part in duplicate detection (known size, not from an
    archive, not hidden, not below an excluded directory)."""
    return files_only(inv).filter(F.col("size").isNotNull() & hash_eligible())


def size_stats(inv: DataFrame) -> DataFrame:
    """(size, n_all, n_eligible) over all files with a known size."""
    return (files_only(inv).filter(F.col("size").isNotNull())
            .groupBy("size")
            .agg(F.count(F.lit(1)).alias("n_all"),
                 F.count_if(hash_eligible()).alias("n_eligible")))


def size_groups(inv: DataFrame) -> DataFrame:
    """(size, n): sizes seen at least twice among all files (tier 1 as the
    size map is built, before eligibility)."""
    return (files_only(inv).filter(F.col("size").isNotNull())
            .groupBy("size").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= 2))


def candidates(inv: DataFrame) -> DataFrame:
    """(path, size): eligible files whose size is seen at least twice among
    *all* files — the set handed to the quick hash, counted the reference's
    way (ineligible files still make a size look shared). A size held by a
    large share of the files is salted (:func:`salted_join`). The inventory is
    read once, into narrow rows that the sizes and the members both use."""
    narrow = files_only(inv).filter(F.col("size").isNotNull()).select("kind", "path", "size", hash_eligible().alias("_in"))
    narrow = materialize(inv.sparkSession, narrow, "sizes")
    return salted_join(narrow.filter("_in").select("path", "size"), size_groups(narrow), ["size"], "n", "left_semi")


# ---------------------------------------------------------------------------
# Content readers
# ---------------------------------------------------------------------------

HASH_COLUMNS = ["path", "size", "quick_hash", "full_hash", "error"]


class ContentReader:
    """Where file bytes come from, and so how the funnel spends its reads."""


@dataclass
class ColumnReader(ContentReader):
    """Content held in a binary column (table-backed inventories).

    Reading a table's content column costs the same whether one row of a row
    group is wanted or all of them, and here even ``size`` is often derived
    from the content. So the content is read in exactly one pass that gives
    every eligible file its quick hash and its full hash (for a file of at
    most 8 KB the quick hash *is* the full hash) and keeps only narrow rows.
    The three tiers then run over those narrow rows; they give the same
    groups as hashing candidates alone, without a second scan of the content.
    """

    content: str = "content"
    prefix_bytes: int = QUICK_HASH_BYTES

    def hash_rows(self, df: DataFrame) -> DataFrame:
        c = F.col(self.content)
        quick = quick_sha256_hex(c, self.prefix_bytes)
        return df.select(
            "path", "size", F.monotonically_increasing_id().alias("rid"),
            quick.alias("quick_hash"),
            F.when(F.col("size") <= self.prefix_bytes, quick).otherwise(sha256_hex(c)).alias("full_hash"),
            F.when(c.isNull(), F.lit("content missing")).alias("error"),
        )


@dataclass
class HashedColumns(ContentReader):
    """The inventory already carries ``quick_hash`` and ``full_hash`` (see
    :func:`hash_annotate`)."""


@dataclass
class PathReader(ContentReader):
    """Content read from storage by path on the executors (listed trees).

    Here every byte read is I/O, so the funnel is followed literally: only
    files whose size is shared are opened, for at most 8 KB; only survivors
    of that tier larger than 8 KB are read whole, streamed in 1 MiB chunks,
    with tasks balanced by bytes rather than by file count. Files of more than
    one block are first compared by blocks that many tasks read
    (``operators/large_files.py``); with a hash cache all are read whole, since
    their full hashes are what the cache keeps.
    """

    prefix_bytes: int = QUICK_HASH_BYTES
    target_task_bytes: int = 256 * 1024 * 1024
    block_bytes: int | None = 128 * 1024 * 1024  # None: no file is split
    files_per_task: int = 2_000
    io_threads: int = 4        # concurrent reads per task (storage latency)
    cache: str | None = None   # hash cache table, see :func:`update_hash_cache`
    store: Store | None = None  # file system of the paths, if not that of their scheme or a mount


def default_reader(inv: DataFrame) -> ContentReader:
    if "content" in inv.columns:
        return ColumnReader()
    if "full_hash" in inv.columns:
        return HashedColumns()
    return PathReader()


def hash_annotate(inv: DataFrame, reader: ColumnReader | None = None) -> DataFrame:
    """Inventory without content, plus ``quick_hash`` / ``full_hash`` on the
    eligible files (null elsewhere): one pass over the content serves every
    section of an analysis."""
    reader = reader or ColumnReader()
    c = F.col(reader.content)
    quick = quick_sha256_hex(c, reader.prefix_bytes)
    elig = (F.col("kind") == "file") & F.col("size").isNotNull() & hash_eligible()
    return inv.select(
        *[x for x in inv.columns if x != reader.content],
        F.when(elig, quick).alias("quick_hash"),
        F.when(elig, F.when(F.col("size") <= reader.prefix_bytes, quick).otherwise(sha256_hex(c)))
        .alias("full_hash"),
        F.monotonically_increasing_id().alias("rid"),
    )


# ---------------------------------------------------------------------------
# The funnel
# ---------------------------------------------------------------------------

class DuplicateResult:
    """Outputs of one funnel run (all DataFrames).

    ``survivors`` and ``files`` are built on first use: selecting them runs
    a small job that looks for hot keys (see :func:`salted_join`), which
    a caller that only wants ``groups`` should not pay for.
    """

    def __init__(self, size_keys: DataFrame, hashed: DataFrame | Callable[[], DataFrame],
                 quick_groups: DataFrame, groups: DataFrame, grouped_rows: DataFrame,
                 full: DataFrame | None = None, survivors: DataFrame | None = None,
                 full_errors: DataFrame | None = None, large_reads: DataFrame | None = None):
        self.size_keys = size_keys          # (size) shared by >= 2 eligible files
        self._hashed = hashed               # candidates, or how to build them
        self.quick_groups = quick_groups    # (size, quick_hash, n) with n >= 2
        self.groups = groups                # (full_hash, size, copies) with copies >= 2
        self.grouped_rows = grouped_rows    # rows with a full hash that groups were built from
        self._full = full
        self._survivors = survivors
        self._full_errors = full_errors
        self.large_reads = large_reads      # (stage, files, bytes) of files compared by blocks, if there were any

    @property
    def hashed(self) -> DataFrame:
        """path, size, quick_hash, full_hash, error of the candidates."""
        if callable(self._hashed):
            self._hashed = self._hashed()
        return self._hashed

    @property
    def survivors(self) -> DataFrame:
        """Candidates in a quick group (size and first 8 KB shared)."""
        if self._survivors is None:
            ok = self.hashed.filter(F.col("quick_hash").isNotNull())
            self._survivors = salted_join(ok, self.quick_groups, ["size", "quick_hash"], "n", "left_semi")
        return self._survivors

    @property
    def full(self) -> DataFrame:
        """Survivors with their full hash (null for a large file that its
        blocks already told from all others)."""
        return self._full if self._full is not None else self.survivors

    @property
    def files(self) -> DataFrame:
        """(full_hash, size, path): every member of every group."""
        if getattr(self, "_files", None) is None:
            self._files = salted_join(self.grouped_rows.select("full_hash", "size", "path"),
                                      self.groups, ["full_hash", "size"], "copies", "left_semi")
        return self._files

    @property
    def hash_errors(self) -> DataFrame:
        """(path, size, error): files that could not be hashed."""
        errors = self.hashed.filter(F.col("error").isNotNull()).select("path", "size", "error")
        if self._full_errors is not None:
            errors = errors.unionByName(self._full_errors)
        return errors


def _shared_sizes(rows: DataFrame, with_counts: bool = False) -> DataFrame:
    keys = (rows.groupBy("size").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= 2))
    return keys if with_counts else keys.select("size")


def find_duplicates(inv: DataFrame, reader: ContentReader | None = None,
                    materialize_stages: bool = True) -> DuplicateResult:
    """Run the three-tier funnel over an inventory.

    Eligibility is applied before tier 1 (it cannot change the groups, only
    the work). Every tier is an aggregation with partial aggregation and a
    semi join on narrow rows. With ``materialize_stages`` the hashed rows
    (and, for path reads, the size keys and the full hashes) are written to
    the shared checkpoint folder, so the later outputs reuse them and a lost
    executor never re-reads content.
    """
    reader = reader or default_reader(inv)
    spark = inv.sparkSession
    elig = eligible_files(inv)

    def keep(df: DataFrame, name: str) -> DataFrame:
        return materialize(spark, df, name) if materialize_stages else df

    if isinstance(reader, PathReader):
        from tallyfs.sources.readers import HASH_SCHEMA, full_hash_files, quick_hash_files

        sized = keep(_shared_sizes(elig.select("size"), with_counts=True), "size_keys")
        size_keys = sized.select("size")
        cands = salted_join(elig.select("path", "size", "mtime"), sized, ["size"], "n", "left_semi")
        cached = read_hash_cache(spark, reader.cache) if reader.cache else None
        if cached is None:
            # the candidate count comes from the small size table, so the
            # semi join runs once, inside the hashing job
            n_cands = int(sized.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
            if n_cands == 0:
                hashed = spark.createDataFrame([], HASH_SCHEMA)
            else:
                hashed = keep(quick_hash_files(cands.select("path", "size"), reader.prefix_bytes,
                                               reader.files_per_task, reader.io_threads, n_rows=n_cands, store=reader.store),
                              "hashed")
        else:
            key = ["path", "size", "mtime"]
            hits = (cands.join(cached, key)
                    .groupBy(*key).agg(F.max("quick_hash").alias("quick_hash"),
                                       F.max("full_hash").alias("full_hash"))
                    .select("path", "size", "quick_hash", "full_hash",
                            F.lit(None).cast("string").alias("error")))
            misses = cands.join(cached, key, "left_anti").select("path", "size")
            hashed = keep(hits.unionByName(
                quick_hash_files(misses, reader.prefix_bytes, reader.files_per_task, reader.io_threads, store=reader.store)),
                "hashed")
        quick_groups = _quick_groups(hashed.filter(F.col("quick_hash").isNotNull()))
        survivors = salted_join(hashed.filter(F.col("quick_hash").isNotNull()), quick_groups,
                                ["size", "quick_hash"], "n", "left_semi")
        # Survivors and bytes still to read whole come from the small
        # quick-group table. The full hashes are written once: groups,
        # members and errors all read them, and whole files must not be read
        # again for each of them.
        split = None if reader.cache else reader.block_bytes
        large = F.col("size") > max(split, reader.prefix_bytes) if split else F.lit(False)
        todo = quick_groups.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("files"),
            F.coalesce(F.sum(F.when(large, F.col("n"))), F.lit(0)).alias("large"),
            F.coalesce(F.sum(F.when((F.col("size") > reader.prefix_bytes) & ~large, F.col("size") * F.col("n"))),
                       F.lit(0)).alias("bytes")).first()
        large_reads = None
        if todo["files"] == 0:
            full = spark.createDataFrame([], HASH_SCHEMA)
        else:
            # small files have their full hash already: they pass by
            survivors = keep(survivors, "survivors")
            whole = full_hash_files(survivors.filter(F.col("full_hash").isNull() & ~large), reader.prefix_bytes,
                                    reader.target_task_bytes, reader.io_threads, total_bytes=int(todo["bytes"]),
                                    n_rows=int(todo["files"]), store=reader.store)
            if todo["large"]:
                from tallyfs.operators.large_files import hash_large_files

                split_rows = hash_large_files(spark, survivors.filter(F.col("full_hash").isNull() & large), reader.target_task_bytes,
                                              split, reader.io_threads, reader.store)
                whole, large_reads = whole.unionByName(split_rows.rows), split_rows.reads
            full = keep(survivors.filter(F.col("full_hash").isNotNull()).select(*whole.columns).unionByName(whole), "full")
        full_ok = full.filter(F.col("full_hash").isNotNull())
        groups = _full_groups(full_ok)
        full_errors = full.filter(F.col("error").isNotNull()).select("path", "size", "error")
        return DuplicateResult(size_keys, hashed, quick_groups, groups, full_ok, full=full,
                               survivors=survivors, full_errors=full_errors, large_reads=large_reads)

    if isinstance(reader, ColumnReader):
        # rows without content have an error; testing that needs no hash
        rows = keep(reader.hash_rows(elig.select("path", "size", reader.content)), "hashed_all")
        hashed_ok = rows.filter(F.col("error").isNull())
    else:
        rows = elig.select("path", "size", *[c for c in ("rid",) if c in elig.columns], "quick_hash", "full_hash",
                           F.lit(None).cast("string").alias("error"))
        hashed_ok = rows.filter(F.col("full_hash").isNotNull())
    sized = _shared_sizes(rows.select("size"), with_counts=True)
    # Every eligible file already has both hashes. Files with equal hashes
    # have equal sizes (and equal full hashes equal prefixes), so grouping the
    # hashed rows directly gives exactly the quick groups of the candidates
    # and the groups of the survivors; the tier semi joins are only built
    # when their outputs are asked for.
    return DuplicateResult(sized.select("size"),
                           lambda: salted_join(rows, sized, ["size"], "n", "left_semi"),
                           _quick_groups(hashed_ok), _full_groups(hashed_ok), hashed_ok)


def _quick_groups(hashed_ok: DataFrame) -> DataFrame:
    return (hashed_ok.groupBy("size", "quick_hash").agg(F.count(F.lit(1)).alias("n"))
            .filter(F.col("n") >= 2))


def _full_groups(full_ok: DataFrame) -> DataFrame:
    return (full_ok.groupBy("full_hash", "size").agg(F.count(F.lit(1)).alias("copies"))
            .filter(F.col("copies") >= 2))


def duplicate_groups(inv: DataFrame, reader: ContentReader | None = None) -> DataFrame:
    """(full_hash, size, copies): confirmed groups of identical files."""
    return find_duplicates(inv, reader).groups


def duplicate_summary(groups: DataFrame) -> DataFrame:
    """One row: groups, has_duplicates, duplicate_files, duplicate_bytes (all
    copies) and wasted_bytes (all copies but one). Zero, not null, when there
    are none."""
    return groups.agg(
        F.count(F.lit(1)).alias("groups"),
        (F.count(F.lit(1)) > 0).alias("has_duplicates"),
        F.coalesce(F.sum("copies"), F.lit(0)).cast("long").alias("duplicate_files"),
        F.coalesce(F.sum(F.col("size") * F.col("copies")), F.lit(0)).cast("long").alias("duplicate_bytes"),
        F.coalesce(F.sum(F.col("size") * (F.col("copies") - 1)), F.lit(0)).cast("long").alias("wasted_bytes"),
    )


def number_groups(groups: DataFrame) -> tuple[DataFrame, int]:
    """Add ``group_no`` 1..N in order (size desc, full_hash asc) without
    sending all groups to one task; also returns N.

    Groups are range-partitioned on the sort key and the partition id is
    written with them (so a recomputation cannot renumber); each task numbers
    its own rows, and per-partition offsets (one row per partition, so
    bounded by the partition count) are broadcast back.
    """
    order = [F.col("size").desc(), F.col("full_hash").asc()]
    ranged = (groups.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    ranged = materialize(groups.sparkSession, ranged, "ranged_groups")
    n_groups = ranged.count()
    local = ranged.withColumn("_rn", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_cnt"))
    offsets = counts.select(
        "_part",
        (F.sum("_cnt").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
        .alias("_off"))
    numbered = (local.join(F.broadcast(offsets), "_part")
                .withColumn("group_no", (F.coalesce(F.col("_off"), F.lit(0)) + F.col("_rn")).cast("long"))
                .drop("_part", "_rn", "_off"))
    return numbered, n_groups


def salted_join(rows: DataFrame, keys: DataFrame, on: list[str], count_col: str, how: str = "inner",
                hot_copies: int = HOT_COPIES) -> DataFrame:
    """Join member ``rows`` (with a ``path``) to per-key rows ``keys`` that
    carry the member count ``count_col``; ``how`` is ``inner`` or ``left``
    (keys' columns come along) or ``left_semi``.

    Keys with more than ``hot_copies`` members are hot: their rows get a salt
    from a hash of the path and their key row is repeated once per salt, twice
    as many as the members are times ``hot_copies``: no salt is expected to have
    more than about half of ``hot_copies`` members, however many the key has,
    with or without AQE. Other keys join as usual. Hot keys number at most rows/hot_copies;
    they are broadcast after a size check.
    """
    right = keys.select(*on) if how == "left_semi" else keys
    hot = keys.filter(F.col(count_col) > hot_copies).select(
        *on, F.ceil(F.col(count_col) * 2 / F.lit(hot_copies)).cast("int").alias("_salts"))
    n_hot = hot.limit(DEFAULT_BROADCAST_KEYS + 1).count()
    if n_hot == 0:
        return rows.join(right, on, how)
    if n_hot <= DEFAULT_BROADCAST_KEYS:
        hot = F.broadcast(hot)
    salted_rows = (rows.join(hot, on, "left")
                   .withColumn("_salt", F.pmod(F.xxhash64("path"), F.coalesce("_salts", F.lit(1))).cast("int"))
                   .drop("_salts"))
    salted_keys = (right.join(hot, on, "left")
                   .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
                   .drop("_salts"))
    return salted_rows.join(salted_keys, on + ["_salt"], how).drop("_salt")


def join_to_groups(files: DataFrame, groups: DataFrame, hot_copies: int = HOT_COPIES) -> DataFrame:
    """Inner join of member rows ``files`` to per-group rows ``groups`` on
    (full_hash, size); ``groups`` carries ``copies``. Hot groups are salted
    (:func:`salted_join`)."""
    return salted_join(files, groups, ["full_hash", "size"], "copies", "inner", hot_copies)


def duplicate_listing(result: DuplicateResult, hot_copies: int = HOT_COPIES) -> DataFrame:
    """(group_no, full_hash, size, path): every file of every group, groups
    numbered by (size desc, full_hash).

    One join of the hashed rows with the numbered groups, on (full_hash,
    size), with hot groups salted (:func:`join_to_groups`).
    """
    numbered, _ = number_groups(result.groups)
    keys = numbered.select("group_no", "full_hash", "size", "copies")
    joined = join_to_groups(result.grouped_rows.select("full_hash", "size", "path"), keys, hot_copies)
    return joined.select("group_no", "full_hash", "size", "path")


def reclaimable_files(result: DuplicateResult, hot_copies: int = HOT_COPIES) -> DataFrame:
    """(full_hash, size, path): the copies whose bytes are wasted — every member
    but the smallest path of each group. Its total size is the wasted bytes.

    The keeper is a min() aggregate (partial aggregation handles a huge group)
    joined back with hot groups salted, instead of a window that would put a
    whole group in one task. A table may name a path twice; then its rows are
    told apart by the number that the hashing pass gave them (``rid``).
    """
    rows = result.grouped_rows
    rid = F.col("rid") if "rid" in rows.columns else F.lit(0)
    rows = rows.select("full_hash", "size", "path", rid.cast("long").alias("_rid"))
    keepers = rows.groupBy("full_hash", "size").agg(
        F.min(F.struct("path", "_rid")).alias("_keep"), F.count(F.lit(1)).alias("copies")).filter("copies >= 2")
    keepers = materialize(rows.sparkSession, keepers, "keepers")
    return (join_to_groups(rows, keepers, hot_copies)
            .filter((F.col("path") != F.col("_keep.path")) | (F.col("_rid") != F.col("_keep._rid")))
            .select("full_hash", "size", "path"))


def funnel_stats(inv: DataFrame, result: DuplicateResult) -> DataFrame:
    """Files entering and leaving each tier (tier, stage, files_in, files_out).

    Tier 1 counts as the reference does: its input is every file of known
    size, its output the eligible files whose size is shared with any file.
    The members of a tier are counted from its groups, so no member is joined;
    the inventory is read once.
    """
    sizes = size_stats(inv).agg(F.sum("n_all").alias("files"),
                                F.sum(F.when(F.col("n_all") >= 2, F.col("n_eligible"))).alias("candidates"))
    pairs = F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("value")) for c in ("files", "candidates")])
    measures = (
        sizes.select(F.inline(pairs))
        .unionByName(result.quick_groups.agg(F.lit("survivors").alias("measure"), F.sum("n").alias("value")))
        .unionByName(result.groups.agg(F.lit("duplicates").alias("measure"), F.sum("copies").alias("value")))
    )

    def m(name: str):
        return F.coalesce(F.max(F.when(F.col("measure") == name, F.col("value"))), F.lit(0)).cast("long")

    row = measures.agg(m("files").alias("files"), m("candidates").alias("cand"),
                       m("survivors").alias("quick_out"), m("duplicates").alias("full_out"))
    return row.select(F.inline(F.array(
        F.struct(F.lit(1).alias("tier"), F.lit("size").alias("stage"),
                 F.col("files").alias("files_in"), F.col("cand").alias("files_out")),
        F.struct(F.lit(2).alias("tier"), F.lit("quick_hash").alias("stage"),
                 F.col("cand").alias("files_in"), F.col("quick_out").alias("files_out")),
        F.struct(F.lit(3).alias("tier"), F.lit("full_hash").alias("stage"),
                 F.col("quick_out").alias("files_in"), F.col("full_out").alias("files_out")),
    )))


# ---------------------------------------------------------------------------
# Hash cache (J1): reuse hashes of files unchanged since an earlier scan
# ---------------------------------------------------------------------------

CACHE_SCHEMA = "path string, size bigint, mtime timestamp, quick_hash string, full_hash string"


def read_hash_cache(spark, cache: str) -> DataFrame | None:
    """The cache table, or None if it was never written."""
    try:
        return spark.read.schema(CACHE_SCHEMA).parquet(cache)
    except Exception as exc:  # AnalysisException: path does not exist
        if "PATH_NOT_FOUND" in str(exc) or "does not exist" in str(exc):
            return None
        raise


def update_hash_cache(inv: DataFrame, result: DuplicateResult, cache: str) -> None:
    """Append the hashes this run computed, keyed by (path, size, mtime).

    A file is re-read only when its size or modification time changed. Rows
    are appended (a file may appear twice: first with its quick hash, later
    with its full hash); readers take the maximum per key among the
    candidates they join, so the cache is never rewritten whole.
    """
    known = result.hashed.select("path", "size", "quick_hash", "full_hash") \
        .filter(F.col("quick_hash").isNotNull())
    full = result.full.filter(F.col("full_hash").isNotNull()).select(
        "path", "size", F.col("quick_hash").alias("q2"), F.col("full_hash").alias("f2"))
    merged = (known.join(full, ["path", "size"], "left")
              .select("path", "size", F.coalesce("quick_hash", "q2").alias("quick_hash"),
                      F.coalesce("full_hash", "f2").alias("full_hash")))
    mtimes = files_only(inv).select("path", "size", "mtime").filter(F.col("mtime").isNotNull())
    rows = merged.join(mtimes, ["path", "size"]).select("path", "size", "mtime", "quick_hash", "full_hash")
    previous = read_hash_cache(inv.sparkSession, cache)
    if previous is not None:
        rows = rows.join(previous, ["path", "size", "mtime", "quick_hash", "full_hash"], "left_anti")
    rows.write.mode("append").parquet(cache)


def compact_hash_cache(inv: DataFrame, cache: str, out: str) -> None:
    """Write to ``out`` the rows of ``cache`` that files of ``inv`` can still
    use, one per (path, size, mtime). The caller then reads ``out``."""
    spark = inv.sparkSession
    known = read_hash_cache(spark, cache)
    if known is None:
        known = spark.createDataFrame([], CACHE_SCHEMA)
    key = ["path", "size", "mtime"]
    rows = known.join(files_only(inv).select(*key), key, "left_semi")
    rows.groupBy(*key).agg(F.max("quick_hash").alias("quick_hash"), F.max("full_hash").alias("full_hash")) \
        .write.mode("errorifexists").parquet(out)
