"""One archive's directory as many tasks: equal to reading it whole."""

import io
import os
import zipfile

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyfs.sources import zip_split as zs
from tallyfs.sources.archives import list_archives

# A signature with lengths of zero: within a name or comment it looks like a header.
FALSE_HEADER = zs.HEADER + b"\0" * (zs.HEADER_BYTES - 4)


def make_zip(path, n, comment=b"", size=lambda i: i % 7, name=lambda i: f"folder{i % 3}/file_{i}.txt", tail=b""):
    with zipfile.ZipFile(path, "w") as zf:
        for i in range(n):
            info = zipfile.ZipInfo(name(i))
            info.comment = comment
            zf.writestr(info, b"x" * size(i))
        zf.comment = tail
    return str(path)


def listed(spark, paths, **kw):
    files = spark.createDataFrame([(p, os.path.getsize(p)) for p in paths], "path string, size bigint")
    cols = ["kind", "path", "name", "size", "extension", "from_archive", "archive_path"]
    return sorted(map(tuple, list_archives(files, **kw).select(*cols).collect()), key=str)


def errors(spark, paths, **kw):
    files = spark.createDataFrame([(p, os.path.getsize(p)) for p in paths], "path string, size bigint")
    return {r["path"]: r["error"] for r in list_archives(files, **kw).filter("kind != 'file'").collect()}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_split_equals_whole(spark, tmp_path, scheme):
    plain = make_zip(tmp_path / "plain.zip", 60)
    tricky = make_zip(tmp_path / "tricky.zip", 20, comment=FALSE_HEADER * 3, tail=b"a comment at the end")
    empty = make_zip(tmp_path / "empty.zip", 0)
    paths = [plain, tricky, empty]
    whole = listed(spark, paths)
    assert len(whole) == 80
    files = spark.createDataFrame([(scheme + p, os.path.getsize(p)) for p in paths], "path string, size bigint")
    for split in (150, 2000):
        rows = list_archives(files, split_bytes=split).select("kind", "path", "name", "size", "extension", "from_archive", "archive_path")
        got = sorted([tuple(v.removeprefix("file://") if isinstance(v, str) else v for v in r) for r in rows.collect()], key=str)
        assert got == whole


def test_ranges_that_began_wrongly_are_read_again(spark, tmp_path):
    """Comments made of false headers: a range that starts in one begins wrongly."""
    path = make_zip(tmp_path / "a.zip", 40, comment=FALSE_HEADER * 40)
    with open(path, "rb") as fh:
        lo, hi = zs.directory_range(fh)
        first = zs._walk_one(fh, lo + 500, lo + 1000, hi, None)
    ranges = zs.cut_ranges(spark.createDataFrame([(path, lo, hi)], zs.PLACE_SCHEMA), 500)
    rows = sorted(zs.aligned_ranges(ranges).collect(), key=lambda r: r["k"])
    assert rows[0]["start"] == lo and rows[-1]["next"] == hi
    assert all(a["next"] == b["start"] for a, b in zip(rows, rows[1:]))
    assert first[0] != rows[1]["start"]  # the guess was wrong, the result is not
    assert len(listed(spark, [path], split_bytes=500)) == 40


def test_damaged_archives_have_one_error_and_no_entries(spark, tmp_path):
    sound = make_zip(tmp_path / "sound.zip", 60)
    damaged = make_zip(tmp_path / "damaged.zip", 60)
    undecodable = make_zip(tmp_path / "names.zip", 60, name=lambda i: f"n{i:04d}" + ("é" if i == 40 else ""))
    with open(damaged, "r+b") as fh:
        lo, hi = zs.directory_range(fh)
        fh.seek(lo)
        at = fh.read(hi - lo).index(b"file_30.txt") - zs.HEADER_BYTES - len("folder0/")
        fh.seek(lo + at)
        fh.write(b"XXXX")
    with open(undecodable, "r+b") as fh:
        lo, hi = zs.directory_range(fh)
        fh.seek(lo)
        data = bytearray(fh.read(hi - lo))
        at = data.index("é".encode())
        data[at:at + 2] = b"\xff\xfe"
        data[at - 5 - zs.HEADER_BYTES + 9] &= ~0x08  # the name is not said to be UTF-8
        fh.seek(lo)
        fh.write(data)
    fake = tmp_path / "fake.zip"
    fake.write_bytes(b"no archive" * 100)
    paths = [sound, damaged, undecodable, str(fake)]
    whole, split = listed(spark, paths), listed(spark, paths, split_bytes=700)
    assert split == whole and sum(r[0] == "file" for r in split) == 60
    assert errors(spark, paths, split_bytes=700) == errors(spark, paths)


def test_tasks_grow_with_the_entries_of_one_archive(spark, tmp_path):
    counts = []
    for n in (60, 600):
        path = make_zip(tmp_path / f"{n}.zip", n)
        places = zs.directory_places(spark.createDataFrame([(path,)], "path string"), 1, 256, None)
        good, bad = zs.checked_ranges(zs.aligned_ranges(zs.cut_ranges(places, 1000)), task_bytes=1000)
        assert bad.count() == 0
        counts.append(good.rdd.getNumPartitions())
        starts = good.selectExpr("next - start as n").collect()
        assert max(r["n"] for r in starts) < 1000 + 100  # no range is much longer than the others
    assert counts[1] >= 9 * counts[0] - 9 and counts[0] >= 4


def test_zip64_directory(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 10)
    path = make_zip(tmp_path / "z64.zip", 50)
    with open(path, "rb") as fh, zipfile.ZipFile(path) as zf:
        data = fh.read()
        assert zs.LOCATOR in data
        lo, hi = zs.directory_range(fh)
        assert lo == zf.start_dir and data[hi:hi + 4] == zs.END64
    prefixed = tmp_path / "sfx.zip"
    prefixed.write_bytes(b"#!/bin/sh\n" * 9 + data)
    with open(prefixed, "rb") as fh:
        assert zs.directory_range(fh) == (lo + 90, hi + 90)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 30), st.sampled_from([b"", b"c", FALSE_HEADER, zs.HEADER])), max_size=12),
       st.integers(1, 200))
def test_ranges_cover_every_header_once(entries, split):
    """Brute force in one process: guesses mended by the place that is due."""
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as zf:
        for i, (n, comment) in enumerate(entries):
            info = zipfile.ZipInfo("d" * n + f"_{i}")
            info.comment = comment
            zf.writestr(info, b"")
    place = zs.directory_range(buf)
    assert place is not None
    lo, hi = place
    names, due = [], lo
    for start in range(lo, hi, split):
        stop = min(start + split, hi)
        got = zs._walk_one(buf, start, stop, hi, lo if start == lo else None)
        if got[0] != due:
            got = zs._walk_one(buf, start, stop, hi, due)
        assert got[0] == due and got[1] is not None
        if got[0] < stop:
            with zipfile.ZipFile(zs.range_directory(buf, got[0], got[1])) as zf:
                names += zf.namelist()
        due = got[1]
    assert names == ["d" * n + f"_{i}" for i, (n, _) in enumerate(entries)]
