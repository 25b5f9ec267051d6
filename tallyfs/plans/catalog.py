"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over
the driver's tables. ``__spark_entry__`` exposes them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyfs.functions.columns import category_of, hash_eligible, is_excluded, is_hidden, size_text
from tallyfs.operators import aggregates as agg
from tallyfs.operators import duplicates as dup
from tallyfs.operators.diff import diff_summary, scan_diff, scan_moves
from tallyfs.plans import bundles, doc_tree
from tallyfs.plans.analyze import FULL, QUICK, Sections, analyze, summary_rows, write_outputs
from tallyfs.plans.bundles import bundle_inventory, fake_archive_inventory, mixed_inventory
from tallyfs.plans.corpus import changed_inventories, corpus_inventory, url_inventory
from tallyfs.plans.materialize import materialize
from tallyfs.schema import KIND_DIR
from tallyfs.session import scratch_path
from tallyfs.sinks.reports import read_section, write_report
from tallyfs.sources import archives as arc

Query = Callable[[SparkSession, str], DataFrame]


def _inv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_inventory(spark, sf_dir)


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """File rows only (folder rows are not needed by per-file queries)."""
    return corpus_inventory(spark, sf_dir, with_folders=False)


def q_scan_summary(spark, sf_dir):
    return agg.scan_summary(_inv(spark, sf_dir))


def q_extension_counts(spark, sf_dir):
    return agg.extension_counts(_files(spark, sf_dir))


def q_top_extensions(spark, sf_dir):
    return agg.top_extensions(_files(spark, sf_dir))


def q_all_extensions(spark, sf_dir):
    return agg.all_extensions(_files(spark, sf_dir))


def q_category_sizes(spark, sf_dir):
    return agg.category_sizes(_files(spark, sf_dir))


def q_category_labels(spark, sf_dir):
    return agg.category_labels(_files(spark, sf_dir))


def q_largest_files(spark, sf_dir):
    return agg.largest_files(_files(spark, sf_dir))


def q_largest_file(spark, sf_dir):
    return agg.largest_file(_files(spark, sf_dir))


def q_size_text(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.select("path", "size", size_text("size").alias("size_text"))


def q_leaf_names(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.select("path", "name", "extension", "from_archive", "archive_path")


def q_file_categories(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.select("path", "extension", category_of("extension").alias("category"))


def q_folder_rows(spark, sf_dir):
    inv = _inv(spark, sf_dir)
    return inv.filter(F.col("kind") == KIND_DIR).select("path", "name")


def q_hidden_files(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.filter(is_hidden("name")).select("path", "name")


def q_excluded_files(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.filter(is_excluded("path")).select("path")


def q_hash_eligible(spark, sf_dir):
    f = _files(spark, sf_dir)
    return f.filter(hash_eligible()).select("path", "size")


def q_size_groups(spark, sf_dir):
    return dup.size_groups(_files(spark, sf_dir))


def q_candidates(spark, sf_dir):
    return dup.candidates(_files(spark, sf_dir))


def q_quick_groups(spark, sf_dir):
    # the prefix hash only: nothing is written, the full hash is pruned
    return dup.find_duplicates(_files(spark, sf_dir), materialize_stages=False).quick_groups


def q_duplicate_groups(spark, sf_dir):
    # One output read once: no stage needs persisting, the plan is one
    # content scan and one aggregation.
    return dup.find_duplicates(_files(spark, sf_dir), materialize_stages=False).groups


def q_duplicate_summary(spark, sf_dir):
    return dup.duplicate_summary(dup.find_duplicates(_files(spark, sf_dir), materialize_stages=False).groups)


def q_duplicate_listing(spark, sf_dir):
    return dup.duplicate_listing(dup.find_duplicates(_files(spark, sf_dir)))


def q_reclaimable_files(spark, sf_dir):
    return dup.reclaimable_files(dup.find_duplicates(_files(spark, sf_dir)))


def q_funnel_stats(spark, sf_dir):
    # one pass over the content gives the sizes and the hashes
    narrow = materialize(spark, dup.hash_annotate(_files(spark, sf_dir)), "hashed")
    return dup.funnel_stats(narrow, dup.find_duplicates(narrow))


def q_summary_rows(spark, sf_dir):
    return summary_rows(analyze(_inv(spark, sf_dir), FULL))


def q_quick_preset(spark, sf_dir):
    return summary_rows(analyze(_inv(spark, sf_dir), QUICK))


def q_url_extensions(spark, sf_dir):
    return agg.extension_counts(url_inventory(spark, sf_dir))


def q_url_categories(spark, sf_dir):
    return agg.category_sizes(url_inventory(spark, sf_dir))


ENTRY_COLUMNS = ["path", "name", "size", "extension", "from_archive", "archive_path"]


def q_archive_entries(spark, sf_dir):
    return arc.archive_entries(bundle_inventory(spark, sf_dir), "content").select(*ENTRY_COLUMNS)


def q_tar_entries(spark, sf_dir):
    inv = bundle_inventory(spark, sf_dir, fmt="tar")
    return arc.archive_entries(inv, "content", archive_extensions=("tar",)).select(*ENTRY_COLUMNS)


def q_compressed_entries(spark, sf_dir):
    """Entries of tar.gz, tar.xz and gzip files."""
    inv = bundle_inventory(spark, sf_dir, fmt="mixed")
    return arc.archive_entries(inv, "content", archive_extensions=("gz", "xz")).select(*ENTRY_COLUMNS)


def q_split_entries(spark, sf_dir):
    return bundles.split_entries(spark, sf_dir)


def q_split_ranges(spark, sf_dir):
    return bundles.split_ranges(spark, sf_dir)


def q_archive_errors(spark, sf_dir):
    return arc.archive_errors(fake_archive_inventory(spark, sf_dir), "content").select("path")


def q_expand_archives(spark, sf_dir):
    return arc.expand_archives(mixed_inventory(spark, sf_dir), "content").select(*ENTRY_COLUMNS)


def q_doc_tree_summary(spark, sf_dir):
    inv, _root = doc_tree.doc_tree_inventory(spark, sf_dir)
    return agg.scan_summary(inv)


def q_doc_tree_files(spark, sf_dir):
    return doc_tree.doc_tree_files(spark, sf_dir)


def q_doc_tree_duplicates(spark, sf_dir):
    return doc_tree.doc_tree_duplicates(spark, sf_dir)


def q_doc_tree_archive_errors(spark, sf_dir):
    return doc_tree.doc_tree_archive_errors(spark, sf_dir)


def q_doc_tree_listing(spark, sf_dir):
    return doc_tree.doc_tree_listing(spark, sf_dir)


# The tree_ queries and the two after them list the documents' tree with broken
# links and FIFOs in it.
def _odd(spark, sf_dir):
    return doc_tree.doc_tree_inventory(spark, sf_dir, odd=True)[0]


def q_tree_inventory(spark, sf_dir):
    return _odd(spark, sf_dir).select("kind", "name", "size", "extension")


def q_tree_summary(spark, sf_dir):
    return agg.scan_summary(_odd(spark, sf_dir))


def q_tree_duplicate_summary(spark, sf_dir):
    return dup.duplicate_summary(doc_tree.doc_tree_duplicates(spark, sf_dir, odd=True))


def q_skipped_items(spark, sf_dir):
    return doc_tree.skipped_items(spark, sf_dir)


def q_hash_errors(spark, sf_dir):
    return doc_tree.hash_errors(spark, sf_dir)


def q_cached_groups(spark, sf_dir):
    return doc_tree.cached_groups(spark, sf_dir)


# The store_ queries write, list and read the tree through a file-system handle.
def q_store_files(spark, sf_dir):
    return doc_tree.doc_tree_files(spark, sf_dir, handle=True)


def q_store_duplicates(spark, sf_dir):
    return doc_tree.doc_tree_duplicates(spark, sf_dir, handle=True)


def q_store_archive_errors(spark, sf_dir):
    return doc_tree.doc_tree_archive_errors(spark, sf_dir, handle=True)


def q_store_skipped_items(spark, sf_dir):
    return doc_tree.skipped_items(spark, sf_dir, handle=True)


def q_store_summary(spark, sf_dir):
    return agg.scan_summary(doc_tree.doc_tree_inventory(spark, sf_dir, odd=True, handle=True)[0])


def q_pruned_items(spark, sf_dir):
    return doc_tree.pruned_items(spark, sf_dir)


def q_relisted_files(spark, sf_dir):
    return doc_tree.relisted_files(spark, sf_dir)


def q_relisted_folders(spark, sf_dir):
    return doc_tree.relisted_folders(spark, sf_dir)


def q_incremental_groups(spark, sf_dir):
    return doc_tree.incremental_groups(spark, sf_dir)


def q_incremental_reads(spark, sf_dir):
    return doc_tree.incremental_reads(spark, sf_dir)


def q_block_groups(spark, sf_dir):
    return doc_tree.block_groups(spark, sf_dir)


def q_block_reads(spark, sf_dir):
    return doc_tree.block_reads(spark, sf_dir)


def q_tree_source_files(spark, sf_dir):
    return doc_tree.tree_source_files(spark, sf_dir)


def q_scan_moves(spark, sf_dir):
    return scan_moves(*changed_inventories(spark, sf_dir, hashed=True))


def q_scan_diff(spark, sf_dir):
    before, after = changed_inventories(spark, sf_dir)
    return scan_diff(before, after)


def q_diff_summary(spark, sf_dir):
    before, after = changed_inventories(spark, sf_dir)
    return diff_summary(scan_diff(before, after))


def _reported(spark, sf_dir, sections):
    """The outputs of a full analysis, written below the checkpoint folder."""
    report = analyze(_inv(spark, sf_dir), FULL)
    return write_outputs(report, sections, scratch_path(spark, "reports"))


def q_report_csv(spark, sf_dir):
    """The CSV tables, read back."""
    out = _reported(spark, sf_dir, Sections(csv_report=True))
    cats = spark.read.csv(out["categories"], header=True, schema="category string, bytes bigint, n bigint, size_text string")
    exts = spark.read.csv(out["extensions"], header=True, schema="extension string, n bigint")
    return cats.select(F.lit("categories").alias("section"), F.col("category").alias("key"), "n", "bytes",
                       "size_text").unionByName(
        exts.select(F.lit("extensions").alias("section"), F.col("extension").alias("key"), "n",
                    F.lit(None).cast("long").alias("bytes"), F.lit(None).cast("string").alias("size_text")))


def q_report_text(spark, sf_dir):
    """The lines of the text summary and of the duplicate listing, read back."""
    out = _reported(spark, sf_dir, Sections(text_report=True))
    return spark.read.text([out["summary_text"], out["duplicate_listing_text"]]).select(F.col("value").alias("line"))


CATEGORY_TABLE = "category string, bytes bigint, n bigint, size_text string"


def q_committed_reports(spark, sf_dir):
    """The category tables of the committed scans below a folder that holds a
    whole report and one that ended after its first section."""
    base = scratch_path(spark, "reports")
    report = analyze(_inv(spark, sf_dir), QUICK)
    write_outputs(report, Sections(csv_report=True), base, "whole")
    write_report({"categories": report["categories"]}, base, "ended-early", fmt="csv")
    return read_section(spark, base, "categories", CATEGORY_TABLE)


def q_user_categories(spark, sf_dir):
    """Category sizes by a caller's own dimension: the category of an extension
    is the smallest file name that has it; pdf and no extension have none."""
    dim = _files(spark, sf_dir).groupBy("extension").agg(F.min("name").alias("category"))
    return agg.category_sizes(_files(spark, sf_dir), dim.filter("extension not in ('pdf', '')"))


QUERIES: dict[str, Query] = {
    "scan_summary": q_scan_summary,
    "extension_counts": q_extension_counts,
    "top_extensions": q_top_extensions,
    "all_extensions": q_all_extensions,
    "category_sizes": q_category_sizes,
    "category_labels": q_category_labels,
    "largest_files": q_largest_files,
    "largest_file": q_largest_file,
    "size_text": q_size_text,
    "leaf_names": q_leaf_names,
    "file_categories": q_file_categories,
    "folder_rows": q_folder_rows,
    "hidden_files": q_hidden_files,
    "excluded_files": q_excluded_files,
    "hash_eligible": q_hash_eligible,
    "size_groups": q_size_groups,
    "candidates": q_candidates,
    "quick_groups": q_quick_groups,
    "duplicate_groups": q_duplicate_groups,
    "duplicate_summary": q_duplicate_summary,
    "duplicate_listing": q_duplicate_listing,
    "reclaimable_files": q_reclaimable_files,
    "funnel_stats": q_funnel_stats,
    "summary_rows": q_summary_rows,
    "quick_preset": q_quick_preset,
    "url_extensions": q_url_extensions,
    "url_categories": q_url_categories,
    "archive_entries": q_archive_entries,
    "tar_entries": q_tar_entries,
    "archive_errors": q_archive_errors,
    "expand_archives": q_expand_archives,
    "doc_tree_summary": q_doc_tree_summary,
    "doc_tree_files": q_doc_tree_files,
    "doc_tree_duplicates": q_doc_tree_duplicates,
    "doc_tree_listing": q_doc_tree_listing,
    "doc_tree_archive_errors": q_doc_tree_archive_errors,
    "skipped_items": q_skipped_items,
    "hash_errors": q_hash_errors,
    "cached_groups": q_cached_groups,
    "scan_diff": q_scan_diff,
    "diff_summary": q_diff_summary,
    "report_csv": q_report_csv,
    "report_text": q_report_text,
    "user_categories": q_user_categories,
    "tree_inventory": q_tree_inventory,
    "tree_summary": q_tree_summary,
    "tree_duplicate_summary": q_tree_duplicate_summary,
    "compressed_entries": q_compressed_entries,
    "store_files": q_store_files,
    "store_duplicates": q_store_duplicates,
    "store_archive_errors": q_store_archive_errors,
    "store_skipped_items": q_store_skipped_items,
    "store_summary": q_store_summary,
    "pruned_items": q_pruned_items,
    "relisted_files": q_relisted_files,
    "relisted_folders": q_relisted_folders,
    "incremental_groups": q_incremental_groups,
    "incremental_reads": q_incremental_reads,
    "tree_source_files": q_tree_source_files,
    "scan_moves": q_scan_moves,
    "committed_reports": q_committed_reports,
    "split_entries": q_split_entries,
    "split_ranges": q_split_ranges,
    "block_groups": q_block_groups,
    "block_reads": q_block_reads,
}
