"""User-level entry points (I1–I3) and the condensed summary view (H3).

``analyze`` returns a mapping of DataFrames, one per requested section; an
absent key means the section was not requested. An inventory with content is
written once as narrow rows when ``analyze`` is called; a section is planned
when it is first read (duplicate sections then run the funnel) and its own
result is computed when it is shown or written.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyfs.functions.columns import size_text
from tallyfs.operators.aggregates import (
    all_extensions,
    category_sizes,
    largest_file,
    largest_files,
    scan_summary,
    top_extensions,
)
from tallyfs.operators.duplicates import (
    ContentReader,
    DuplicateResult,
    duplicate_listing,
    duplicate_summary,
    find_duplicates,
    funnel_stats,
    hash_annotate,
    reclaimable_files,
)
from tallyfs.plans.materialize import materialize


@dataclass(frozen=True)
class Sections:
    """Which analyses run and which reports are written."""

    extensions: bool = False
    categories: bool = False
    largest: bool = False
    duplicates: bool = False
    text_report: bool = False
    csv_report: bool = False
    all_extensions: bool = False


ANALYSES = frozenset({"extensions", "categories", "largest", "duplicates"})
REPORTS = frozenset({"text_report", "csv_report"})
#: What each preset stands for.
PRESETS = {"full": ANALYSES | REPORTS, "quick": ANALYSES - {"duplicates"}}
#: Requests that the quick preset rules out.
NOT_WITH_QUICK = frozenset({"full", "duplicates"})


def select_sections(full: bool = False, quick: bool = False, duplicates: bool = False,
                    extensions: bool = False, categories: bool = False, largest: bool = False,
                    txt: bool = False, csv: bool = False, all_extensions: bool = False) -> Sections:
    """The sections that a set of switches asks for: the union of the chosen
    presets and the single sections, ``full`` if no analysis is among them.
    ``quick`` leaves duplicates out, so asking for them beside it is an error.
    """
    switches = {"full": full, "quick": quick, "duplicates": duplicates, "extensions": extensions,
                "categories": categories, "largest": largest, "text_report": txt, "csv_report": csv}
    asked = {name for name, on in switches.items() if on}
    if quick and (clash := asked & NOT_WITH_QUICK):
        raise ValueError(f"a quick run does not look for duplicates; drop quick or {sorted(clash)}")
    if not asked & (ANALYSES | PRESETS.keys()):
        asked.add("full")
    chosen = frozenset().union(*(PRESETS.get(name, {name}) for name in asked))
    return Sections(all_extensions=all_extensions, **{name: name in chosen for name in ANALYSES | REPORTS})


FULL = select_sections(full=True)
QUICK = select_sections(quick=True)


class Report(Mapping):
    """Result sections of one analysis, built on first access.

    Only requested sections are keys. Building a section only plans it
    (DataFrames stay lazy); the duplicate funnel, which writes its stages to
    the checkpoint folder, runs once, when the first duplicate section is
    read.
    """

    def __init__(self, factories: dict[str, Callable[[], DataFrame]]):
        self._factories = factories
        self._built: dict[str, DataFrame] = {}

    def __getitem__(self, key: str) -> DataFrame:
        if key not in self._built:
            self._built[key] = self._factories[key]()
        return self._built[key]

    def __contains__(self, key: object) -> bool:
        # Mapping's default would build the section to answer
        return key in self._factories

    def __iter__(self) -> Iterator[str]:
        return iter(self._factories)

    def __len__(self) -> int:
        return len(self._factories)


def analyze(inv: DataFrame, sections: Sections = FULL, reader: ContentReader | None = None,
            persist: bool | None = None) -> Report:
    """Result sections for an inventory (a :class:`Report`).

    Keys: ``summary`` always; ``extensions`` (top 10 or all); ``categories``;
    ``largest_files`` and ``largest_file``; ``duplicate_groups``,
    ``duplicate_summary``, ``duplicate_listing``, ``reclaimable_files``,
    ``funnel_stats``, ``hash_errors``.

    With ``persist`` (default: when the inventory carries ``content``) the
    inventory's narrow columns are written once to the shared checkpoint
    folder, together with both hashes of every eligible file when duplicates
    are wanted (:func:`hash_annotate`); every section reads that table, so
    the content is read once per analysis. A listed tree (:func:`scan_tree`)
    is persisted already and is hashed by path.
    """
    has_content = "content" in inv.columns
    wants_hashes = sections.duplicates and has_content
    narrow = hash_annotate(inv) if wants_hashes else (inv.drop("content") if has_content else inv)
    if persist is None:
        persist = has_content
    if persist:
        narrow = materialize(inv.sparkSession, narrow, "inventory")
    f: dict[str, Callable[[], DataFrame]] = {"summary": lambda: scan_summary(narrow)}
    if sections.extensions:
        f["extensions"] = (lambda: all_extensions(narrow)) if sections.all_extensions \
            else (lambda: top_extensions(narrow))
    if sections.categories:
        f["categories"] = lambda: category_sizes(narrow)
    if sections.largest:
        f["largest_files"] = lambda: largest_files(narrow)
        f["largest_file"] = lambda: largest_file(narrow)
    if sections.duplicates:
        funnel: list[DuplicateResult] = []

        def result() -> DuplicateResult:
            if not funnel:
                source = narrow if wants_hashes and reader is None else inv
                funnel.append(find_duplicates(source, reader))
            return funnel[0]

        f["duplicate_groups"] = lambda: result().groups
        f["duplicate_summary"] = lambda: duplicate_summary(result().groups)
        f["duplicate_listing"] = lambda: duplicate_listing(result())
        f["reclaimable_files"] = lambda: reclaimable_files(result())
        f["funnel_stats"] = lambda: funnel_stats(narrow, result())
        f["hash_errors"] = lambda: result().hash_errors
    return Report(f)


SUMMARY_ROW_SCHEMA = "section string, key string, value bigint, size_text string"


def summary_rows(sections: Mapping[str, DataFrame]) -> DataFrame:
    """Condensed view of the sections as (section, key, value, size_text):
    totals, extensions, categories, largest files and duplicate totals, but
    no duplicate paths. Each part is already small (one row, top-k or one row
    per category), so the union is small."""
    parts: list[DataFrame] = []

    def kv(df: DataFrame, section: str, key: str, value: str, with_text: bool) -> DataFrame:
        return df.select(F.lit(section).alias("section"), F.col(key).cast("string").alias("key"),
                         F.col(value).cast("long").alias("value"),
                         (size_text(value) if with_text else F.lit(None).cast("string")).alias("size_text"))

    s = sections["summary"]
    totals = s.select(F.inline(F.array(
        F.struct(F.lit("files").alias("key"), F.col("files").alias("value")),
        F.struct(F.lit("folders").alias("key"), F.col("folders").alias("value")),
        F.struct(F.lit("bytes").alias("key"), F.col("bytes").alias("value")),
        F.struct(F.lit("skipped").alias("key"), F.col("skipped").alias("value")),
    )))
    parts.append(totals.select(F.lit("summary").alias("section"), "key", F.col("value").cast("long"),
                               F.when(F.col("key") == "bytes", size_text("value")).alias("size_text")))
    if "extensions" in sections:
        parts.append(kv(sections["extensions"], "extensions", "extension", "n", False))
    if "categories" in sections:
        parts.append(kv(sections["categories"], "categories", "category", "bytes", True))
    if "largest_files" in sections:
        parts.append(kv(sections["largest_files"], "largest_files", "path", "size", True))
    if "duplicate_summary" in sections:
        d = sections["duplicate_summary"]
        dup = d.select(F.inline(F.array(
            F.struct(F.lit("groups").alias("key"), F.col("groups").alias("value")),
            F.struct(F.lit("duplicate_bytes").alias("key"), F.col("duplicate_bytes").alias("value")),
            F.struct(F.lit("wasted_bytes").alias("key"), F.col("wasted_bytes").alias("value")),
        )))
        parts.append(dup.select(F.lit("duplicates").alias("section"), "key", F.col("value").cast("long"),
                                F.when(F.col("key") != "groups", size_text("value")).alias("size_text")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def write_outputs(report: Report, sections: Sections, base: str, scan_id: str | None = None) -> dict[str, str]:
    """Write the reports the sections ask for; returns output -> path.

    * ``csv_report``: the category and extension tables as CSV datasets.
    * ``text_report``: the summary as text lines, and, when duplicates ran,
      the full listing of every duplicate path (long form, written by the
      executors).

    The scan is committed when all of them are written.
    """
    from tallyfs.sinks.reports import commit_scan, new_scan_id, write_report, write_text_listing, write_text_summary

    scan_id = scan_id or new_scan_id()
    spark = report["summary"].sparkSession
    out: dict[str, str] = {}
    if sections.csv_report:
        tables = {k: report[k] for k in ("categories", "extensions") if k in report}
        out.update(write_report(tables, base, scan_id, fmt="csv"))
    if sections.text_report:
        out["summary_text"] = write_text_summary(summary_rows(report), base, scan_id)
        if "duplicate_listing" in report:
            out["duplicate_listing_text"] = write_text_listing(report["duplicate_listing"], base, scan_id)
    commit_scan(spark, base, scan_id, {k: "text" if k.endswith("_text") else "csv" for k in out})
    return out
