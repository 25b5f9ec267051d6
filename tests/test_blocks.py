"""Large files by blocks: digests and roots against plain hashing, groups equal
to those of whole reads, one whole read a group, and files that change between
the two reads."""

import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tallyfs.operators import duplicates as dup
from tallyfs.operators import large_files
from tallyfs.sources import blocks
from tallyfs.sources.storage import Store
from tallyfs.sources.tree import tree_inventory

KB = 1024


def sha(data):
    return hashlib.sha256(data).hexdigest()


def plain_root(data, size, fan):
    digests = [sha(data[k:k + size]) for k in range(0, len(data), size)]
    inner = [sha("".join(digests[k:k + fan]).encode()) for k in range(0, len(digests), fan)]
    return sha("".join(inner).encode())


def put(folder, name, data):
    os.makedirs(folder, exist_ok=True)
    path = os.path.join(folder, name)
    with open(path, "wb") as fh:
        fh.write(data)
    return path


@pytest.mark.parametrize("length", [1, 99, 100, 101, 300, 1000, 1001, 2_345])
def test_roots_equal_plain_hashing(spark, tmp_path, length):
    data = random.Random(length).randbytes(length)
    path = put(str(tmp_path), "f", data)
    files = spark.createDataFrame([(path, length)], "path string, size bigint")
    digests = blocks.block_digests(files, 500, block_bytes=100)
    got = {r.block: r.digest for r in digests.collect()}
    assert got == {k: sha(data[k * 100:k * 100 + 100]) for k in range(-(-length // 100))}
    assert blocks.block_roots(digests, fan=4).first().root == plain_root(data, 100, 4)
    whole = blocks.whole_hashes(files, 500, block_bytes=100, fan=4).first()
    assert (whole.full_hash, whole.root, whole.error) == (sha(data), plain_root(data, 100, 4), None)


def test_pieces_of_any_size_give_one_root():
    data = random.Random(1).randbytes(5_000)
    for step in (1, 7, 100, 4_999, 5_000):
        root = blocks._Root(100, 4)
        for k in range(0, len(data), step):
            root.update(data[k:k + step])
        assert root.hexdigest() == plain_root(data, 100, 4)


def test_one_file_is_many_tasks(spark, tmp_path):
    """The blocks of a single file are dealt over tasks, more of them for a
    larger file, and no task gets a large part."""
    for n in (64, 256):
        path = put(str(tmp_path), f"f{n}", bytes(n * KB))
        files = spark.createDataFrame([(path, n * KB)], "path string, size bigint")
        digests = blocks.block_digests(files, 4 * KB, block_bytes=KB)
        per_task = [r["count"] for r in digests.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(per_task) == n and len(per_task) >= n // 8 and max(per_task) <= 20


def tree(folder):
    """Files of one size and prefix that differ late, copies, and small ones."""
    head, rnd = b"p" * 9_000, random.Random(3)
    late = [head + bytes([k]) * 40_000 for k in range(6)]
    contents = {}
    for k in range(60):
        kind = rnd.randrange(4)
        data = rnd.choice(late[:3]) if kind == 0 else late[3] if kind == 1 else b"small" * rnd.randrange(3) if kind == 2 else \
            head + rnd.randbytes(40_000)
        contents[put(f"{folder}/d{k % 4}", f"f{k}", data)] = data
    return contents


@pytest.mark.parametrize("scheme", ["", "file://"])
@pytest.mark.parametrize("block_bytes", [1_000, 16 * KB, 1 << 30, None])
def test_groups_equal_whole_reads(spark, tmp_path, scheme, block_bytes):
    contents = tree(str(tmp_path / "t"))
    inv = tree_inventory(spark, f"{scheme}{tmp_path}/t")
    res = dup.find_duplicates(inv, dup.PathReader(block_bytes=block_bytes))
    want = sorted((sha(c), len(c), n) for c, n in Counter(contents.values()).items() if n >= 2)
    assert sorted(tuple(r) for r in res.groups.select("full_hash", "size", "copies").collect()) == want
    assert sorted((r.full_hash, r.path.removeprefix(scheme)) for r in res.files.collect()) == sorted(
        (sha(c), p) for p, c in contents.items() if Counter(contents.values())[c] >= 2)
    assert res.hash_errors.count() == 0
    if block_bytes and block_bytes < KB * KB:
        n = {r.stage: (r.files, r.bytes) for r in res.large_reads.collect()}
        large = [c for c in contents.values() if len(c) > 9_000]
        assert n["blocks"] == (len(large), 49_000 * len(large)) and n["again"] == (0, 0)
        copied = [c for c, k in Counter(large).items() if k >= 2]
        assert n["once"] == (len(copied), 49_000 * len(copied))
        # what is no duplicate has no full hash: no task read it whole
        alone = [r.path for r in res.full.filter("full_hash is null and error is null").collect()]
        assert len(alone) == sum(1 for k in Counter(large).values() if k == 1)
    else:
        assert res.large_reads is None


def rows_of(spark, paths, size):
    return spark.createDataFrame([(p, size, "q") for p in paths], "path string, size bigint, quick_hash string")


def outcome(found):
    return sorted((os.path.basename(r.path), r.full_hash, r.error) for r in found.rows.collect())


@pytest.mark.parametrize("change", ["other", "longer", "gone"])
def test_a_copy_that_changes_between_the_reads(spark, tmp_path, monkeypatch, change):
    """Every file is read by itself then, as if there were no blocks."""
    data, new = b"a" * 3_000, b"b" * 3_000
    paths = [put(str(tmp_path), n, data) for n in ("f1", "f2", "f3")]
    real = large_files.whole_hashes

    def late(files, *a, **k):
        if change == "gone":
            os.remove(paths[0])
        else:
            put(str(tmp_path), "f1", new if change == "other" else data + b"c")
        return real(files, *a, **k)

    monkeypatch.setattr(large_files, "whole_hashes", late)
    found = large_files.hash_large_files(spark, rows_of(spark, paths, 3_000), 10_000, block_bytes=500)
    got = outcome(found)
    assert got[1:] == [("f2", sha(data), None), ("f3", sha(data), None)]
    if change == "gone":
        assert got[0][1] is None and "No such file" in got[0][2]
    else:
        assert got[0] == ("f1", sha(new if change == "other" else data + b"c"), None)
    assert {r.stage: r.files for r in found.reads.collect()} == {"blocks": 3, "once": 1, "again": 3}


def test_unreadable_short_repeated_and_none(spark, tmp_path):
    data = b"a" * 3_000
    paths = [put(str(tmp_path), n, data) for n in ("f1", "f2")]
    short = put(str(tmp_path), "short", data[:1_200])
    twice = put(str(tmp_path), "twice", b"t" * 3_000)
    found = large_files.hash_large_files(spark, rows_of(spark, [*paths, short, twice, twice, str(tmp_path / "none")], 3_000), 10_000,
                                         block_bytes=500, store=None)
    got = outcome(found)
    assert got[:2] == [("f1", sha(data), None), ("f2", sha(data), None)]
    assert got[2][:2] == ("none", None) and "No such file" in got[2][2]
    assert got[3:] == [("short", None, None)] + [("twice", sha(b"t" * 3_000), None)] * 2
    empty = large_files.hash_large_files(spark, rows_of(spark, [], 0), 10_000, store=Store())
    assert empty.rows.count() == 0 and sum(r.files for r in empty.reads.collect()) == 0


def test_a_cache_keeps_whole_hashes(spark, tmp_path):
    tree(str(tmp_path / "t"))
    inv = tree_inventory(spark, f"{tmp_path}/t")
    reader = dup.PathReader(block_bytes=1_000, cache=f"{tmp_path}/cache")
    first = dup.find_duplicates(inv, reader)
    assert first.large_reads is None and first.full.filter("full_hash is null").count() == 0
    dup.update_hash_cache(inv, first, reader.cache)
    again = dup.find_duplicates(inv, reader)
    assert sorted(map(tuple, again.groups.collect())) == sorted(map(tuple, first.groups.collect()))
