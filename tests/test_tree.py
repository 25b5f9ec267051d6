"""Golden trees built in a temporary directory: listing, archives, path-backed
duplicate funnel (fixtures G-1, G-2, G-3)."""

import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from tallyfs.operators import aggregates as agg
from tallyfs.operators import duplicates as dup
from tallyfs.plans.analyze import analyze
from tallyfs.plans.scan import scan_tree
from tallyfs.schema import EMPTY_SHA256
from tallyfs.sources.table import table_files


def _write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(data)


@pytest.fixture(scope="module")
def testdir(tmp_path_factory):
    """The reference's hand-made TestDir: 15 files, 6 folders, 89 bytes,
    3 duplicate groups (89 B in duplicates, 58 B wasted), plus a fake ZIP."""
    root = tmp_path_factory.mktemp("g1") / "TestDir"
    r = str(root)
    blank = b" \r\n"
    _write(f"{r}/docs/notes.txt", b"hello notes!\r\n")
    _write(f"{r}/docs/notes/notes_copy.txt", b"hello notes!\r\n")
    _write(f"{r}/misc/data.csv", b"a,b,c\r\n1,2,3\r\n")
    _write(f"{r}/misc/data_copy.csv", b"a,b,c\r\n1,2,3\r\n")
    for rel in ["media/pics/a.jpg", "media/pics/b.jpg", "media/clip.mp4", "docs/slides.pptx",
                "docs/paper.pdf", "code/Main.java", "code/Makefile", "media/pics/c.png",
                "code/run.py", "code/index.html", "media/pics/d.webp"]:
        _write(f"{r}/{rel}", blank)
    _write(f"{r}/misc/backup.zip", b"PK\x03")
    return r


def test_testdir_totals(spark, testdir):
    scan = scan_tree(spark, testdir)
    inv = scan.inventory
    s = agg.scan_summary(inv).first().asDict()
    assert s == {"files": 15, "folders": 6, "bytes": 89, "skipped": 0}
    exts = {r["extension"]: r["n"] for r in agg.extension_counts(inv).collect()}
    assert len(exts) == 12 and exts["jpg"] == 2 and exts["txt"] == 2 and exts["csv"] == 2
    assert exts["No extension"] == 1
    cats = {r["category"]: r["bytes"] for r in agg.category_sizes(inv).collect()}
    assert cats == {"Images": 12, "Documents": 34, "Source Code": 9, "Video": 3,
                    "No extension": 3, "Others": 28}
    errs = scan.archive_errors.collect()
    assert [os.path.basename(e["path"]) for e in errs] == ["backup.zip"]


def test_testdir_duplicates(spark, testdir):
    inv = scan_tree(spark, testdir).inventory
    res = dup.find_duplicates(inv, dup.PathReader())
    s = dup.duplicate_summary(res.groups).first().asDict()
    assert s == {"groups": 3, "has_duplicates": True, "duplicate_files": 15, "duplicate_bytes": 89,
                 "wasted_bytes": 58}
    rec = dup.reclaimable_files(res).agg(F.sum("size")).first()[0]
    assert rec == 58
    listing = dup.duplicate_listing(res).collect()
    assert sorted({r["group_no"] for r in listing}) == [1, 2, 3]
    # groups numbered by size desc, then hash: the 3-byte group is last
    assert {r["size"] for r in listing if r["group_no"] == 3} == {3}


def test_top_five_golden(spark):
    sizes = [10, 3, 7, 15, 2, 9, 4, 6]
    df = spark.createDataFrame([(f"/r/f{i}", s) for i, s in enumerate(sizes)], "path string, size bigint")
    inv = table_files(df, path="path", content=None, size="size")
    assert [r["size"] for r in agg.largest_files(inv).collect()] == [15, 10, 9, 7, 6]


@pytest.fixture(scope="module")
def edges(tmp_path_factory):
    root = tmp_path_factory.mktemp("g2") / "edges"
    r = str(root)
    _write(f"{r}/.gitignore", b"*.pyc\n")
    _write(f"{r}/pkg/__init__.py", b"")
    _write(f"{r}/.hid/inside.txt", b"hidden dir file")
    _write(f"{r}/_u/under.txt", b"underscore dir file")
    _write(f"{r}/zero1", b"")
    _write(f"{r}/z/zero2.dat", b"")
    os.makedirs(f"{r}/empty")
    os.symlink(f"{r}/nowhere", f"{r}/broken_link")
    os.symlink(r, f"{r}/z/loop")
    _write(f"{r}/a b%20.txt", b"space")
    _write(f"{r}/name.", b"dot at end")
    _write(f"{r}/Makefile", b"all:\n")
    _write(f"{r}/archive.tar.gz", b"not really gz")
    _write(f"{r}/report.PDF", b"%PDF-1.4")
    _write(f"{r}/NODE_MODULES/x/dep.js", b"module.exports=1")
    inner = io.BytesIO()
    with zipfile.ZipFile(inner, "w") as zf:
        zf.writestr("deep.txt", b"deep")
    outer = io.BytesIO()
    with zipfile.ZipFile(outer, "w") as zf:
        zf.writestr("folder/", b"")
        zf.writestr("folder/Photo.JPG", b"jpegbytes")
        zf.writestr("inner.zip", inner.getvalue())
        zf.writestr("readme", b"r")
    _write(f"{r}/bundle.zip", outer.getvalue())
    _write(f"{r}/fake.zip", b"abc")
    return r


def test_edges_listing(spark, edges):
    scan = scan_tree(spark, edges)
    rows = {os.path.relpath(r["path"], edges): r for r in scan.inventory.collect()}
    for rel in [".gitignore", "pkg/__init__.py", ".hid/inside.txt", "_u/under.txt", "zero1",
                "z/zero2.dat", "a b%20.txt", "name.", "Makefile", "archive.tar.gz", "report.PDF",
                "NODE_MODULES/x/dep.js"]:
        assert rows[rel]["kind"] == "file", rel
    assert rows["empty"]["kind"] == "dir"
    assert rows["broken_link"]["kind"] == "skipped"
    assert rows["z/loop"]["kind"] == "dir" and rows["z/loop"]["error"]
    assert not any(k.startswith("z/loop/") for k in rows)
    assert rows[".gitignore"]["extension"] == "gitignore"
    assert rows["name."]["extension"] == ""
    assert rows["archive.tar.gz"]["extension"] == "gz"
    assert rows["report.PDF"]["extension"] == "pdf"
    # the ZIP is replaced by its file entries; the directory entry is dropped
    assert "bundle.zip" not in rows and "fake.zip" not in rows
    entries = {k: v for k, v in rows.items() if v["from_archive"]}
    assert set(entries) == {"bundle.zip!/folder/Photo.JPG", "bundle.zip!/inner.zip", "bundle.zip!/readme"}
    assert entries["bundle.zip!/folder/Photo.JPG"]["extension"] == "jpg"
    assert entries["bundle.zip!/inner.zip"]["extension"] == "zip"
    assert entries["bundle.zip!/readme"]["size"] == 1
    assert [os.path.basename(e["path"]) for e in scan.archive_errors.collect()] == ["fake.zip"]
    s = agg.scan_summary(scan.inventory).first()
    assert s["skipped"] == 1
    assert [os.path.basename(x["path"]) for x in agg.skipped_items(scan.inventory).collect()] == ["broken_link"]


def test_edges_duplicates(spark, edges):
    inv = scan_tree(spark, edges).inventory
    res = dup.find_duplicates(inv, dup.PathReader())
    groups = res.groups.collect()
    # the three empty files: pkg/__init__.py, zero1, z/zero2.dat form one group
    assert [(g["full_hash"], g["size"], g["copies"]) for g in groups] == [(EMPTY_SHA256, 0, 3)]
    assert dup.duplicate_summary(res.groups).first()["wasted_bytes"] == 0
    elig = {os.path.relpath(r["path"], edges) for r in dup.eligible_files(inv).collect()}
    assert "NODE_MODULES/x/dep.js" not in elig and ".gitignore" not in elig
    assert ".hid/inside.txt" in elig  # only the leaf name makes a file hidden


def test_prefix_trap(spark, tmp_path):
    r = str(tmp_path / "g3")
    head = bytes(range(256)) * 32  # 8192 bytes
    _write(f"{r}/a.bin", head + b"x" * 1807 + b"1")
    _write(f"{r}/b.bin", head + b"x" * 1807 + b"2")
    _write(f"{r}/c.bin", head)
    _write(f"{r}/d.bin", head)
    _write(f"{r}/e.bin", head + b"!")
    _write(f"{r}/f.bin", head + b"!")
    inv = scan_tree(spark, r).inventory
    res = dup.find_duplicates(inv, dup.PathReader())
    quick = sorted((q["size"], q["n"]) for q in res.quick_groups.collect())
    assert quick == [(8192, 2), (8193, 2), (10000, 2)]
    assert sorted((g["size"], g["copies"]) for g in res.groups.collect()) == [(8192, 2), (8193, 2)]
    # the same bytes held in a column give the same groups
    tbl = spark.read.format("binaryFile").load(r).select(
        F.regexp_replace("path", "^file:", "").alias("path"), "content")
    col_res = dup.find_duplicates(table_files(tbl, path="path", content="content"), dup.ColumnReader())
    assert sorted((g["full_hash"], g["size"], g["copies"]) for g in col_res.groups.collect()) == \
        sorted((g["full_hash"], g["size"], g["copies"]) for g in res.groups.collect())


def test_missing_root_raises(spark, tmp_path):
    with pytest.raises(FileNotFoundError):
        scan_tree(spark, str(tmp_path / "does-not-exist"))


def test_prune_directories(spark, tmp_path):
    r = str(tmp_path / "prune")
    _write(f"{r}/keep/a.txt", b"a")
    _write(f"{r}/$RECYCLE.BIN/b.txt", b"b")
    from tallyfs.sources.tree import tree_inventory
    inv = tree_inventory(spark, r, prune=("$recycle.bin",))
    assert sorted((os.path.relpath(x["path"], r), x["kind"]) for x in inv.collect()) == [
        ("$RECYCLE.BIN", "skipped"), ("keep", "dir"), ("keep/a.txt", "file")]  # counted, not entered


def test_analyze_sections_on_tree(spark, testdir):
    inv = scan_tree(spark, testdir).inventory
    out = analyze(inv)
    assert set(out) >= {"summary", "extensions", "categories", "largest_files", "duplicate_groups",
                        "duplicate_summary", "duplicate_listing", "reclaimable_files", "funnel_stats"}
    tiers = [(r["tier"], r["files_in"], r["files_out"]) for r in out["funnel_stats"].orderBy("tier").collect()]
    assert tiers == [(1, 15, 15), (2, 15, 15), (3, 15, 15)]


def test_tar_entries_opt_in(spark, tmp_path):
    import tarfile

    r = str(tmp_path / "tars")
    os.makedirs(r)
    with tarfile.open(f"{r}/pack.tar", "w") as tf:
        for name, data in [("a/x.TXT", b"12345"), ("b.py", b"print()")]:
            info = tarfile.TarInfo(name)
            info.size = len(data)
            tf.addfile(info, io.BytesIO(data))
    default = scan_tree(spark, r).inventory.collect()
    assert [os.path.basename(x["path"]) for x in default] == ["pack.tar"]
    inv = scan_tree(spark, r, archive_extensions=("zip", "tar")).inventory
    got = sorted((os.path.relpath(x["path"], r), x["size"], x["extension"]) for x in inv.collect())
    assert got == [("pack.tar!/a/x.TXT", 5, "txt"), ("pack.tar!/b.py", 7, "py")]


def test_scan_diff(spark, tmp_path):
    from tallyfs.operators.diff import diff_summary, scan_diff

    r = str(tmp_path / "diff")
    _write(f"{r}/keep.txt", b"same")
    _write(f"{r}/grow.txt", b"a")
    _write(f"{r}/gone.txt", b"bye")
    before = scan_tree(spark, r).inventory
    os.remove(f"{r}/gone.txt")
    _write(f"{r}/grow.txt", b"abc")
    _write(f"{r}/new/n.txt", b"new")
    after = scan_tree(spark, r).inventory
    d = {os.path.relpath(x["path"], r): x["status"] for x in scan_diff(before, after).collect()}
    assert d == {"keep.txt": "unchanged", "grow.txt": "changed", "gone.txt": "removed", "new/n.txt": "added"}
    s = {x["status"]: (x["files"], x["bytes_before"], x["bytes_after"])
         for x in diff_summary(scan_diff(before, after)).collect()}
    assert s["changed"] == (1, 1, 3) and s["added"] == (1, 0, 3) and s["removed"] == (1, 3, 0)


def test_hash_cache_reuses_unchanged_files(spark, tmp_path):
    r = str(tmp_path / "cache_tree")
    _write(f"{r}/a.txt", b"x" * 9000)
    _write(f"{r}/b.txt", b"x" * 9000)
    _write(f"{r}/c.txt", b"y" * 9000)
    cache = str(tmp_path / "hash_cache")
    inv = scan_tree(spark, r).inventory
    res = dup.find_duplicates(inv, dup.PathReader(cache=cache))
    assert res.groups.count() == 1
    dup.update_hash_cache(inv, res, cache)
    rows = {os.path.basename(x["path"]): x for x in spark.read.parquet(cache).collect()}
    # all three share a size, so all got a quick hash; only a and b reached tier 3
    assert set(rows) == {"a.txt", "b.txt", "c.txt"}
    assert rows["c.txt"]["full_hash"] is None and rows["a.txt"]["full_hash"] == rows["b.txt"]["full_hash"]
    # b's bytes change without a size change; a new copy of a appears
    _write(f"{r}/b.txt", b"z" * 9000)
    os.utime(f"{r}/b.txt", (1, 1))
    _write(f"{r}/d.txt", b"x" * 9000)
    inv2 = scan_tree(spark, r).inventory
    res2 = dup.find_duplicates(inv2, dup.PathReader(cache=cache))
    groups = [(g["size"], g["copies"]) for g in res2.groups.collect()]
    assert groups == [(9000, 2)]
    members = sorted(os.path.basename(x["path"]) for x in res2.files.collect())
    assert members == ["a.txt", "d.txt"]


def test_hot_directory_deferred_stats(spark, tmp_path):
    """Past the inline limit, files of one directory are stat'ed by a spread
    stage: same rows as stat'ing everything inline."""
    from tallyfs.sources.tree import tree_inventory

    r = str(tmp_path / "hot")
    for i in range(300):
        _write(f"{r}/big/f{i:03d}.dat", b"x" * (i % 17))
    _write(f"{r}/small/a.txt", b"abc")
    os.symlink(f"{r}/nowhere", f"{r}/big/broken")
    cols = ["kind", "path", "name", "size", "extension", "error"]
    inline = sorted(tuple(x[c] for c in cols) for x in tree_inventory(spark, r).collect())
    spread = sorted(tuple(x[c] for c in cols) for x in tree_inventory(spark, r, inline_files=10).collect())
    assert spread == inline
    assert sum(1 for x in spread if x[0] == "file") == 301
    assert [x[1] for x in spread if x[0] == "skipped"] == [f"{r}/big/broken"]


def test_fifo_is_listed_but_never_read(spark, tmp_path):
    """A named pipe counts as a file (as the reference counts it) but is not
    opened for hashing: it becomes a hash error instead of a hung task."""
    r = str(tmp_path / "fifo")
    _write(f"{r}/empty1", b"")
    _write(f"{r}/empty2", b"")
    os.mkfifo(f"{r}/pipe")
    inv = scan_tree(spark, r).inventory
    assert agg.scan_summary(inv).first()["files"] == 3
    res = dup.find_duplicates(inv, dup.PathReader())
    assert [(g["size"], g["copies"]) for g in res.groups.collect()] == [(0, 2)]
    errs = [(os.path.basename(e["path"]), e["error"]) for e in res.hash_errors.collect()]
    assert len(errs) == 1 and errs[0][0] == "pipe" and "regular" in errs[0][1]


def test_fifo_named_zip_is_an_archive_error(spark, tmp_path):
    r = str(tmp_path / "fifozip")
    _write(f"{r}/a.txt", b"a")
    os.mkfifo(f"{r}/trap.zip")
    scan = scan_tree(spark, r)
    assert [os.path.basename(x["path"]) for x in scan.inventory.collect()] == ["a.txt"]
    assert [os.path.basename(e["path"]) for e in scan.archive_errors.collect()] == ["trap.zip"]


def test_zip_with_undecodable_name_is_an_error_row(spark, tmp_path):
    r = str(tmp_path / "badname")
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        zf.writestr("cafe.txt", b"x")          # ASCII name: no UTF-8 flag is set
    raw = buf.getvalue().replace(b"cafe.txt", b"caf\xe9.txt")  # Latin-1 byte, not UTF-8
    _write(f"{r}/names.zip", raw)
    _write(f"{r}/ok.txt", b"ok")
    scan = scan_tree(spark, r)
    assert [os.path.basename(x["path"]) for x in scan.inventory.collect()] == ["ok.txt"]
    errs = scan.archive_errors.collect()
    assert len(errs) == 1 and "UnicodeDecodeError" in errs[0]["error"]


def test_empty_tree(spark, tmp_path):
    r = str(tmp_path / "empty_root")
    os.makedirs(r)
    inv = scan_tree(spark, r).inventory
    assert agg.scan_summary(inv).first().asDict() == {"files": 0, "folders": 0, "bytes": 0, "skipped": 0}
    assert agg.largest_files(inv).count() == 0 and agg.top_extensions(inv).count() == 0
    res = dup.find_duplicates(inv, dup.PathReader())
    assert dup.duplicate_summary(res.groups).first().asDict() == {
        "groups": 0, "has_duplicates": False, "duplicate_files": 0, "duplicate_bytes": 0, "wasted_bytes": 0}
    from tallyfs.plans.analyze import summary_rows
    rows = summary_rows(analyze(inv)).collect()
    assert {(x["section"], x["key"]) for x in rows} == {
        ("summary", "files"), ("summary", "folders"), ("summary", "bytes"), ("summary", "skipped"),
        ("duplicates", "groups"), ("duplicates", "duplicate_bytes"), ("duplicates", "wasted_bytes")}
