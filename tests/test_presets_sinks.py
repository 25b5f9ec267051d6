"""Section selection (I3), summary rows (H3) and report sinks (H1, H2, H4)."""

import os

import pytest

from table_dirs import SF001
from tallyfs.operators import duplicates as dup
from tallyfs.plans.analyze import FULL, QUICK, analyze, select_sections, summary_rows
from tallyfs.plans.corpus import corpus_inventory
from tallyfs.sinks import new_scan_id, write_report, write_text_listing


def test_select_sections():
    assert select_sections() == FULL
    assert select_sections(txt=True) == FULL and select_sections(csv=True) == FULL
    assert select_sections(all_extensions=True).duplicates
    q = select_sections(quick=True)
    assert q.extensions and q.categories and q.largest and not q.duplicates and not q.text_report
    d = select_sections(duplicates=True)
    assert d.duplicates and not d.extensions and not d.csv_report
    assert select_sections(quick=True, csv=True).csv_report
    with pytest.raises(ValueError):
        select_sections(quick=True, full=True)
    with pytest.raises(ValueError):
        select_sections(quick=True, duplicates=True)


def test_quick_reads_no_content(spark):
    inv = corpus_inventory(spark, SF001)
    out = analyze(inv, QUICK)
    assert "duplicate_groups" not in out
    rows = summary_rows(out).collect()
    assert {r["section"] for r in rows} == {"summary", "extensions", "categories", "largest_files"}


def test_write_report_never_overwrites(spark, tmp_path):
    inv = corpus_inventory(spark, SF001)
    out = analyze(inv, FULL)
    sid = new_scan_id()
    base = str(tmp_path / "reports")
    paths = write_report({k: out[k] for k in ("summary", "categories", "extensions")}, base, sid, fmt="csv")
    assert all(os.path.isdir(p) for p in paths.values())
    back = spark.read.option("header", "true").csv(paths["categories"])
    assert set(back.columns) == {"category", "bytes", "n", "size_text"}
    with pytest.raises(Exception):
        write_report({"summary": out["summary"]}, base, sid, fmt="csv")
    other = write_report({"summary": out["summary"]}, base, new_scan_id())
    assert other["summary"] != paths["summary"]


def test_text_listing(spark, tmp_path):
    inv = corpus_inventory(spark, SF001)
    res = dup.find_duplicates(inv)
    p = write_text_listing(dup.duplicate_listing(res), str(tmp_path / "r"), new_scan_id())
    lines = [r["value"] for r in spark.read.text(p).collect()]
    assert len(lines) == 11 and all(len(x.split("\t")) == 3 for x in lines)


def test_write_outputs_full(spark, tmp_path):
    from tallyfs.plans.analyze import write_outputs

    inv = corpus_inventory(spark, SF001)
    paths = write_outputs(analyze(inv, FULL), FULL, str(tmp_path / "out"))
    assert set(paths) == {"categories", "extensions", "summary_text", "duplicate_listing_text"}
    text = [r["value"] for r in spark.read.text(paths["summary_text"]).collect()]
    assert "summary\tfiles -> 200" in text
    assert len(spark.read.text(paths["duplicate_listing_text"]).collect()) == 11
    quick = write_outputs(analyze(inv, QUICK), select_sections(quick=True, txt=True), str(tmp_path / "q"))
    assert set(quick) == {"summary_text"}


def test_report_is_lazy(spark):
    inv = corpus_inventory(spark, SF001)
    report = analyze(inv, FULL)
    assert "duplicate_listing" in report and "nothing" not in report
    assert report._built == {}
    report["summary"]
    assert set(report._built) == {"summary"}


def test_write_report_parquet_round_trip(spark, tmp_path):
    inv = corpus_inventory(spark, SF001)
    report = analyze(inv, FULL)
    paths = write_report(report, str(tmp_path / "pq"), new_scan_id(),
                         names=("duplicate_groups", "duplicate_listing", "categories"))
    assert set(paths) == {"duplicate_groups", "duplicate_listing", "categories"}
    back = spark.read.parquet(paths["duplicate_listing"])
    assert back.count() == 11 and "size_text" in back.columns
    assert spark.read.parquet(paths["categories"]).agg({"bytes": "sum"}).first()[0] == 495892
    assert "/scan_id=" in paths["categories"]


def test_only_committed_scans_are_read(spark, tmp_path, monkeypatch):
    from tallyfs.plans.analyze import write_outputs
    from tallyfs.sinks import reports

    base, report = str(tmp_path / "r"), analyze(corpus_inventory(spark, SF001), QUICK)
    schema = "category string, bytes bigint, n bigint, size_text string"
    assert reports.committed_scans(spark, base) == {}
    assert reports.read_section(spark, base, "categories", schema).count() == 0
    both = select_sections(quick=True, csv=True)
    write_outputs(report, both, base, "s1")
    write_outputs(report, both, base, "s2")

    # A run that dies between its last two sections, and one whose manifest was cut short.
    def dies(*args):
        raise RuntimeError("lost")
    with monkeypatch.context() as m:
        m.setattr(reports, "write_text_summary", dies)
        with pytest.raises(RuntimeError, match="lost"):
            write_outputs(report, select_sections(quick=True, csv=True, txt=True), base, "s3")
    assert os.path.isdir(reports.section_path(base, "categories", "s3"))
    write_report({"categories": report["categories"]}, base, "s4", fmt="csv")
    with open(f"{base}/_scans/s4", "w") as fh:
        fh.write('{"categories": "csv"}')

    assert list(reports.committed_scans(spark, base)) == ["s1", "s2"]
    rows = reports.read_section(spark, base, "categories", schema)
    assert {r["scan_id"] for r in rows.select("scan_id").distinct().collect()} == {"s1", "s2"}
    assert rows.count() == 2 * report["categories"].count()
    assert rows.filter("scan_id = 's2'").agg({"bytes": "sum"}).first()[0] == 495892
    one = reports.read_section(spark, base, "categories", schema, "s1")
    assert {r["scan_id"] for r in one.collect()} == {"s1"}
    assert reports.read_section(spark, base, "nothing", schema).count() == 0
    with pytest.raises(Exception, match="exists"):
        reports.commit_scan(spark, base, "s1", {})
