"""A tree scanned again: state and groups equal a full run, and little is read;
versions; listing by what is known; moves."""

import os
import random

import pytest
from pyspark.sql import functions as F

from tallyfs.operators import duplicates as dup
from tallyfs.operators.diff import rank_in_groups, scan_moves
from tallyfs.operators.incremental import update_duplicates
from tallyfs.plans.versioned import VersionedTable
from tallyfs.sources.relist import relist_tree
from tallyfs.sources.table import table_files
from tallyfs.sources.tree import tree_inventory


def put(path, data):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as fh:
        fh.write(data)


def groups(df):
    return sorted(tuple(r) for r in df.select("full_hash", "size", "copies").collect())


def reads(update):
    return {r.stage: (r.files, r.bytes) for r in update.reads.collect()}


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_updates_equal_full_runs(spark, tmp_path, scheme):
    rnd = random.Random(5)
    root, base = f"{tmp_path}/tree", f"{tmp_path}/state"
    contents = [b"", b"a", b"b", b"same" * 10, os.urandom(9000), b"p" * 8192, b"p" * 8192 + b"1", b"p" * 8192 + b"2"]
    paths = [f"{root}/d{k % 5}/f{k}" for k in range(60)]
    for p in paths[:30]:
        put(p, rnd.choice(contents))
    for step in range(4):
        inv = tree_inventory(spark, scheme + root)
        update = update_duplicates(spark, base, inv)
        assert groups(update.groups) == groups(dup.find_duplicates(inv, dup.PathReader()).groups)
        assert update.version == step + 1 and update.files.count() == inv.filter("kind = 'file'").count()
        if step == 2:  # nothing changed: nothing is read
            assert reads(update) == {"quick_hash": (0, 0), "full_hash": (0, 0)}
        if step != 1:
            for p in rnd.sample(paths, 12):
                put(p, rnd.choice(contents))
                os.utime(p, (1e9 + step, 1e9 + step))
            for p in rnd.sample(paths[:30], 3):
                if os.path.exists(p):
                    os.remove(p)


def test_only_what_became_shared_is_read(spark, tmp_path):
    root, base = f"{tmp_path}/tree", f"{tmp_path}/state"
    put(f"{root}/one", b"1" * 100)
    put(f"{root}/big", b"z" * 20_000)
    put(f"{root}/a", b"twin")
    put(f"{root}/b", b"twin")
    first = update_duplicates(spark, base, tree_inventory(spark, root))
    assert reads(first) == {"quick_hash": (2, 8), "full_hash": (0, 0)}
    put(f"{root}/late1", b"1" * 100)   # the older singleton "one" is read now
    put(f"{root}/late2", b"y" * 20_000)  # same size, other prefix: not read whole
    second = update_duplicates(spark, base, tree_inventory(spark, root))
    assert reads(second) == {"quick_hash": (4, 200 + 2 * 8192), "full_hash": (0, 0)}
    put(f"{root}/late3", b"z" * 20_000)  # "big" is read whole only now
    third = update_duplicates(spark, base, tree_inventory(spark, root))
    assert reads(third) == {"quick_hash": (1, 8192), "full_hash": (2, 40_000)}
    assert sorted(c for _, _, c in groups(third.groups)) == [2, 2, 2]


def test_partial_scans_add(spark, tmp_path):
    base = f"{tmp_path}/state"
    for k in range(3):
        put(f"{tmp_path}/t{k}/f", b"content")
        put(f"{tmp_path}/t{k}/g", b"%d" % k)
        update = update_duplicates(spark, base, tree_inventory(spark, f"{tmp_path}/t{k}"), complete=False)
    assert update.files.count() == 6 and [c for _, _, c in groups(update.groups)] == [3]
    gone = update_duplicates(spark, base, tree_inventory(spark, f"{tmp_path}/t0"))
    assert gone.files.count() == 2 and groups(gone.groups) == []


def test_a_run_that_dies_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root, base = f"{tmp_path}/tree", f"{tmp_path}/state"
    put(f"{root}/a", b"twin")
    put(f"{root}/b", b"twin")
    update_duplicates(spark, base, tree_inventory(spark, root))
    put(f"{root}/c", b"twin")
    real = VersionedTable.commit

    def die(self, folder, after=None):
        raise KeyboardInterrupt

    monkeypatch.setattr(VersionedTable, "commit", die)
    with pytest.raises(KeyboardInterrupt):
        update_duplicates(spark, base, tree_inventory(spark, root))
    monkeypatch.setattr(VersionedTable, "commit", real)
    table = VersionedTable(spark, base)
    assert table.current()[0] == 1 and table.read("files", "path string").count() == 2
    # a marker that was not written to its end names nothing
    with open(f"{base}/_versions/{2:012d}", "w") as fh:
        fh.write("half")
    assert table.current()[0] == 1
    folder = table.begin()
    with pytest.raises(RuntimeError, match="another run"):
        table.commit(folder, after=1)
    spark.range(5).write.parquet(f"{folder}/files")
    assert table.commit(folder) == 3 and table.current() == (3, folder)


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_relisting_equals_a_fresh_listing(spark, tmp_path, scheme):
    root = f"{tmp_path}/tree"
    for k in range(40):
        put(f"{root}/d{k % 4}/e{k % 3}/f{k}.txt", b"x" * k)
    os.makedirs(f"{root}/empty/deep")
    os.makedirs(f"{root}/$RECYCLE.BIN/x")
    os.symlink("nowhere", f"{root}/d0/link")
    os.symlink(root, f"{root}/d0/loop")

    def shown(inv):
        return sorted(repr(tuple(r)) for r in inv.collect())

    def folders(found):
        return {r.path.removeprefix("file://").removeprefix(root) for r in found.folders.filter("listed").collect()}

    prune = ("$recycle.bin",)
    known = tree_inventory(spark, scheme + root, prune=prune)
    same = relist_tree(spark, scheme + root, known, prune)
    assert shown(same.inventory) == shown(known) and folders(same) == {""}
    put(f"{root}/d1/e1/f1.txt", b"rewritten in place")
    put(f"{root}/d2/new/deeper/f.txt", b"new")
    os.remove(f"{root}/d3/e0/f3.txt")
    os.rmdir(f"{root}/empty/deep")
    put(f"{root}/nowhere", b"the link beside it is still broken")
    fresh = tree_inventory(spark, scheme + root, prune=prune)
    again = relist_tree(spark, scheme + root, known, prune)
    assert shown(again.inventory) == shown(fresh)
    assert folders(again) == {"", "/d2", "/d2/new", "/d2/new/deeper", "/d3/e0", "/empty"}
    # trusted entries: what was rewritten in place keeps its old size
    trusted = relist_tree(spark, scheme + root, known, prune, look=False)
    differ = set(shown(trusted.inventory)) ^ set(shown(fresh))
    assert len(differ) == 2 and all("/d1/e1/f1.txt" in d for d in differ)
    # folders that changed just before they were listed are not trusted
    assert len(folders(relist_tree(spark, scheme + root, known, prune, listed_at=0.0))) > 10


def test_ranks_of_a_large_group(spark):
    df = spark.range(5000).selectExpr("if(id % 3 = 0, 'hot', concat('k', id % 700)) as g", "concat('p', lpad(id, 5, '0')) as path")
    got = rank_in_groups(df, ["g"], "path")
    assert set(got.columns) == {"g", "path", "rank"}
    by = {}
    for r in sorted(df.collect(), key=lambda r: r.path):
        by.setdefault(r.g, []).append(r.path)
    assert {(r.g, r.path): r.rank for r in got.collect()} == {(g, p): k for g, ps in by.items() for k, p in enumerate(ps, 1)}


def test_moves(spark):
    def inv(rows):
        df = spark.createDataFrame([(p, len(c), c) for p, c in rows], "path string, n long, c string")
        return table_files(df, path="path", content=None, size="n").join(
            df.select("path", F.when(F.length("c") > 0, F.col("c")).alias("full_hash")), "path")

    before = inv([("/a", "x"), ("/b", "x"), ("/c", "x"), ("/keep", "x"), ("/gone", "g"), ("/none", "")])
    after = inv([("/keep", "x"), ("/n1", "x"), ("/n2", "x"), ("/new", "n"), ("/none2", "")])
    got = {(r.path, r.status, r.path_before) for r in scan_moves(before, after).collect()}
    assert got == {("/n1", "moved", "/a"), ("/n2", "moved", "/b"), ("/c", "removed", None), ("/gone", "removed", None),
                   ("/new", "added", None), ("/none", "removed", None), ("/none2", "added", None)}
