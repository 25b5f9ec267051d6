"""Report sinks (H1, H2, H4).

Every section is written as its own dataset below
``<base>/<section>/scan_id=<id>/`` with save mode ``errorifexists``: a
second run never truncates an earlier one, even within the same second, as
the scan id carries a random suffix. Tables keep numeric bytes *and* the
size text. The duplicate listing is written in long form by the executors;
it never passes through the driver.

A scan is committed by a manifest ``<base>/_scans/<id>``, written after its last
section. It names the sections; readers take committed scans only, so a run that
died between two sections leaves nothing that looks like a report.
"""

from __future__ import annotations

import datetime as _dt
import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.functions.columns import size_text
from tallyfs.plans.markers import markers, put_marker



def new_scan_id(now: _dt.datetime | None = None) -> str:
    """``YYYYMMDD_HHMMSS_<8 hex>``: sortable by time, unique per run."""
    now = now or _dt.datetime.now()
    return now.strftime("%Y%m%d_%H%M%S") + "_" + uuid.uuid4().hex[:8]


def section_path(base: str, section: str, scan_id: str) -> str:
    return f"{base.rstrip('/')}/{section}/scan_id={scan_id}"


def _with_size_text(df: DataFrame) -> DataFrame:
    for c in ("bytes", "size", "duplicate_bytes", "wasted_bytes"):
        if c in df.columns and f"{c}_text" not in df.columns and "size_text" not in df.columns:
            return df.withColumn("size_text", size_text(c))
    return df


def write_report(sections: dict[str, DataFrame], base: str, scan_id: str | None = None,
                 fmt: str = "parquet", names: tuple[str, ...] | None = None) -> dict[str, str]:
    """Write the chosen sections (all by default); returns section -> path.

    ``fmt`` is ``parquet`` or ``csv`` (CSV with a header row and proper
    quoting).
    """
    scan_id = scan_id or new_scan_id()
    out: dict[str, str] = {}
    for name, df in sections.items():
        if names is not None and name not in names:
            continue
        path = section_path(base, name, scan_id)
        data = _with_size_text(df)
        writer = data.write.mode("errorifexists")
        if fmt == "csv":
            writer.option("header", "true").option("quoteAll", "false").csv(path)
        elif fmt == "parquet":
            writer.parquet(path)
        else:
            raise ValueError(f"unknown format {fmt!r}")
        out[name] = path
    return out


def write_text_listing(listing: DataFrame, base: str, scan_id: str) -> str:
    """Duplicate listing as text lines ``<group_no>\\t<size text>\\t<path>``,
    sorted by group and path (a distributed range sort, many output files)."""
    path = section_path(base, "duplicate_listing_text", scan_id)
    lines = (listing.orderBy("group_no", "path")
             .select(F.concat_ws("\t", F.col("group_no").cast("string"), size_text("size"),
                                 F.col("path")).alias("value")))
    lines.write.mode("errorifexists").text(path)
    return path


def write_text_summary(rows: DataFrame, base: str, scan_id: str) -> str:
    """Summary rows as text lines ``<section>\t<key> -> <value or size text>``,
    ordered by section and value. Usually a few dozen rows, but with all
    extensions one per extension, so the write stays a distributed sort."""
    path = section_path(base, "summary_text", scan_id)
    shown = F.coalesce(F.col("size_text"), F.col("value").cast("string"))
    lines = (rows.orderBy("section", F.col("value").desc(), "key")
             .select(F.concat_ws("\t", F.col("section"),
                                 F.concat_ws(" -> ", F.col("key"), shown)).alias("value")))
    lines.write.mode("errorifexists").text(path)
    return path


def commit_scan(spark: SparkSession, base: str, scan_id: str, sections: dict[str, str]) -> None:
    """Make the sections of a scan visible to readers, all at once.
    ``sections``: section -> format (``csv``, ``parquet`` or ``text``). Raises if
    the scan was committed before."""
    put_marker(spark, f"{base.rstrip('/')}/_scans/{scan_id}", json.dumps(sections, sort_keys=True))


def committed_scans(spark: SparkSession, base: str) -> dict[str, dict[str, str]]:
    """scan id -> its sections and their formats, oldest scan first."""
    found = markers(spark, f"{base.rstrip('/')}/_scans")
    return {scan: json.loads(found[scan]) for scan in sorted(found)}


def read_section(spark: SparkSession, base: str, section: str, schema: str, scan_id: str | None = None) -> DataFrame:
    """One section of every committed scan, or of one, with its ``scan_id``
    (which must not be a column of the section). Scans without it add no rows;
    without any committed scan the result is empty."""
    parts: dict[str, list[str]] = {}
    for scan, sections in committed_scans(spark, base).items():
        if section in sections and scan_id in (None, scan):
            parts.setdefault(sections[section], []).append(section_path(base, section, scan))
    out = spark.createDataFrame([], schema).withColumn("scan_id", F.lit(None).cast("string"))
    for fmt, paths in sorted(parts.items()):
        reader = spark.read.option("basePath", f"{base.rstrip('/')}/{section}").schema(f"{schema}, scan_id string")
        if fmt == "csv":
            reader = reader.option("header", "true")
        out = out.unionByName(reader.format(fmt).load(paths))
    return out
