"""Odd names, odd archives, folders that end in ``!``, repeated paths, task
sizes, and every combination of the section switches."""

import gzip
import io
import itertools
import os
import tarfile

import pytest
from pyspark.sql import functions as F

from tallyfs import session
from tallyfs.operators import duplicates as dup
from tallyfs.plans.analyze import Sections, select_sections
from tallyfs.session import clean_scratch, scratch_path
from tallyfs.sources.archives import archive_entries, archive_errors
from tallyfs.sources.readers import _partitions
from tallyfs.sources.table import folder_rows, table_files, table_inventory
from tallyfs.sources.tree import tree_inventory


def test_task_count_follows_the_bytes():
    assert _partitions(100 * 10**12, 256 << 20, 2) == 372_530
    assert _partitions(10, 256 << 20, 8, rows=3) == 3


def test_undecodable_names_are_skipped_rows(spark, tmp_path):
    root = os.fsencode(tmp_path)
    os.makedirs(root + b"/bad\xff/inside")
    os.makedirs(root + b"/good")
    for name in (b"/f\xe9.txt", b"/good/x.TXT", b"/bad\xff/inside/lost.txt"):
        with open(root + name, "wb") as fh:
            fh.write(b"12345")
    rows = {r.name: r for r in tree_inventory(spark, str(tmp_path)).collect()}
    assert set(rows) == {"bad\\udcff", "f\\udce9.txt", "good", "x.TXT"}
    assert {r.kind for n, r in rows.items() if "\\" in n} == {"skipped"}
    assert rows["bad\\udcff"].error == "undecodable name"
    assert (rows["x.TXT"].extension, rows["x.TXT"].size) == ("txt", 5)


def test_pruned_folders_are_skipped_rows(spark, tmp_path):
    (tmp_path / "Cache" / "deep").mkdir(parents=True)
    (tmp_path / "Cache" / "a.txt").write_text("a")
    rows = tree_inventory(spark, str(tmp_path), prune=("cache",)).collect()
    assert [(r.kind, r.name, r.error) for r in rows] == [("skipped", "Cache", "pruned")]


def _archives(spark, items):
    df = spark.createDataFrame([(p, bytearray(b)) for p, b in items], "path string, content binary")
    return table_files(df)


def test_tar_names_and_single_compressed_files(spark):
    buf = io.BytesIO()
    with tarfile.open(fileobj=buf, mode="w", encoding="utf-8", errors="surrogateescape") as tf:
        for name in ("ok.txt", "b\udcffd.txt"):
            info = tarfile.TarInfo(name)
            info.size = 3
            tf.addfile(info, io.BytesIO(b"abc"))
    inv = _archives(spark, [("/a/t.tar", buf.getvalue()), ("/a/log.gz", gzip.compress(b"hello")), ("/a/broken.xz", b"\xfd7zXZ\x00junk"),
                            ("/a/empty.gz", b"")])
    kinds = ("tar", "gz", "xz")
    got = archive_entries(inv, "content", kinds).collect()
    assert {(r.path, r.size, r.extension) for r in got} == {("/a/t.tar!/ok.txt", 3, "txt"), ("/a/log.gz!/log", None, "")}
    bad = {r.path for r in archive_errors(inv, "content", kinds).collect()}
    assert {"/a/t.tar!/b\\udcffd.txt", "/a/broken.xz"} <= bad


def test_folder_ending_in_exclamation_mark(spark, tmp_path):
    rows = [("/r/wow!/a.txt", "same"), ("/r/wow!/b.txt", "same"), ("/r/x.zip!/wow!/c.txt", "same"), ("/r/Y.ZIP!/d", "q")]
    inv = table_inventory(spark.createDataFrame(rows, "path string, content string"), root="/r")
    files = {r.path: r for r in inv.filter("kind = 'file'").collect()}
    assert [files[p].archive_path for p, _ in rows] == [None, None, "/r/x.zip", "/r/Y.ZIP"]
    assert [(g.copies, g.size) for g in dup.find_duplicates(inv).groups.collect()] == [(2, 4)]
    assert [r.path for r in folder_rows(inv.filter("kind = 'file'"), "/r").collect()] == ["/r/wow!"]
    (tmp_path / "wow!").mkdir()
    for n in ("a.txt", "b.txt"):
        (tmp_path / "wow!" / n).write_text("same")
    assert dup.find_duplicates(tree_inventory(spark, str(tmp_path)), dup.PathReader()).groups.count() == 1
    # said by columns, whatever the path looks like
    said = spark.createDataFrame([("/r/a.bin!/x", "s", True, "/r/a.bin"), ("/r/z.zip!/y", "s", False, None)],
                                 "path string, content string, inside boolean, box string")
    got = table_files(said, from_archive="inside", archive_path="box").collect()
    assert [(r.from_archive, r.archive_path) for r in got] == [(True, "/r/a.bin"), (False, None)]


def test_reclaimable_bytes_are_the_wasted_bytes(spark):
    rows = [("a", "12345678"), ("a", "12345678"), ("b", "12345678"), ("c", "z" * 9000), ("d", "z" * 9000), ("e", "solo")]
    res = dup.find_duplicates(table_files(spark.createDataFrame(rows, "path string, content string")))
    wasted = dup.duplicate_summary(res.groups).first().wasted_bytes
    assert dup.reclaimable_files(res).agg(F.sum("size")).first()[0] == wasted == 16 + 9000


def test_content_is_hashed_once(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "x")], "path string, content string")
    plan = dup.find_duplicates(table_files(df), materialize_stages=False).groups._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Filter" in line and "sha2" in line]


def test_hash_cache_is_compacted(spark, tmp_path):
    for n, body in (("a", "same"), ("b", "same"), ("c", "other!")):
        (tmp_path / n).write_text(body)
    cache, out = (scratch_path(spark, x) for x in ("cache", "compact"))
    for _ in range(2):
        inv = tree_inventory(spark, str(tmp_path))
        dup.update_hash_cache(inv, dup.find_duplicates(inv, dup.PathReader(cache=cache)), cache)
        (tmp_path / "b").write_text("same again")
    inv = tree_inventory(spark, str(tmp_path))
    dup.compact_hash_cache(inv, cache, out)
    rows = dup.read_hash_cache(spark, out).collect()
    now = {(r.path, r.size) for r in inv.collect()}
    assert rows and {(r.path, r.size) for r in rows} <= now and len({r.path for r in rows}) == len(rows)
    dup.compact_hash_cache(inv, out + "-none", out + "-empty")
    assert dup.read_hash_cache(spark, out + "-empty").count() == 0


def test_scratch_folders_can_be_deleted(spark, monkeypatch):
    monkeypatch.setattr(session, "_SCRATCH", [])  # other tests still read theirs
    path = scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    assert os.path.isdir(path.removeprefix("file:"))
    assert clean_scratch(spark) == 1
    assert not os.path.exists(path.removeprefix("file:"))


@pytest.mark.parametrize("flags", list(itertools.product([False, True], repeat=9)))
def test_section_switches(flags):
    full, quick, dups, exts, cats, largest, txt, csv, every = flags
    kw = dict(zip(("full", "quick", "duplicates", "extensions", "categories", "largest", "txt", "csv", "all_extensions"), flags))
    if quick and (full or dups):
        with pytest.raises(ValueError):
            select_sections(**kw)
        return
    everything = full or not any((quick, dups, exts, cats, largest))
    assert select_sections(**kw) == Sections(
        extensions=everything or quick or exts, categories=everything or quick or cats, largest=everything or quick or largest,
        duplicates=everything or dups, text_report=everything or txt, csv_report=everything or csv, all_extensions=every)
