"""The golden trees through a file-system handle, stores of a caller's own, and
the tree as a table."""

import os
import tracemalloc

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet
import pytest
from pyspark.sql import functions as F

from tallyfs.operators import aggregates as agg
from tallyfs.operators import duplicates as dup
from tallyfs.plans import doc_tree
from tallyfs.plans.scan import scan_tree
from tallyfs.sources import datasource
from tallyfs.sources.storage import Store, has_scheme, normal_path, read_at, split_scheme
from tallyfs.sources.tree import _list_store, tree_inventory
from test_tree import edges, testdir  # noqa: F401  the golden trees

COLUMNS = ["kind", "path", "name", "size", "extension", "error"]


def rows(inv, strip=""):
    return sorted(repr(tuple(r)) for r in inv.withColumn("path", F.expr(f"replace(path, '{strip}', '')")).select(*COLUMNS).collect())


@pytest.mark.parametrize("name", ["testdir", "edges"])
def test_golden_trees_through_a_handle(spark, request, name):
    root = request.getfixturevalue(name)
    mount, handle = scan_tree(spark, root), scan_tree(spark, "file://" + root)
    assert rows(handle.inventory, "file://") == rows(mount.inventory)
    assert agg.scan_summary(handle.inventory).collect() == agg.scan_summary(mount.inventory).collect()
    assert all(r.path.startswith("file:///") for r in handle.inventory.collect())
    times = [{r.path.removeprefix("file://"): r.mtime for r in s.inventory.filter("kind = 'file' and not from_archive").collect()}
             for s in (mount, handle)]
    assert times[0].keys() == times[1].keys()
    groups = [sorted(map(tuple, dup.find_duplicates(s.inventory, dup.PathReader()).groups.collect())) for s in (mount, handle)]
    assert groups[0] == groups[1]
    errors = [sorted(r.path.removeprefix("file://") for r in s.archive_errors.collect()) for s in (mount, handle)]
    assert errors[0] == errors[1] and errors[0]


def test_store_of_the_callers_own(spark, edges):  # noqa: F811
    """A sub-tree under a name of its own; nothing of it is a mounted path."""
    own = Store("data://", pafs.SubTreeFileSystem(edges, pafs.LocalFileSystem()))
    inv = tree_inventory(spark, "data://z", store=own)
    got = {r.path for r in inv.collect()}
    assert "data://z/zero2.dat" in got and all(p.startswith("data://z/") for p in got)
    files = inv.filter("kind = 'file'")
    groups = dup.find_duplicates(files, dup.PathReader(store=own)).hashed
    assert groups.filter("error is not null").count() == 0
    with pytest.raises(OSError):
        own.open("other://z/zero2.dat")


def test_ranges_and_refusals(tmp_path):
    store, path = Store(), f"file://{tmp_path}/a/b c%20#?.bin"
    with store.create(path) as fh:
        fh.write(bytes(range(200)))
    assert store.read_range(path, 10, 5) == bytes(range(10, 15))
    assert store.read_range(path, 198, 50) == bytes([198, 199]) and store.read_range(path, 500, 5) == b""
    with store.open(path) as fh:
        assert read_at(fh, 0, 3) == b"\x00\x01\x02" and fh.seek(1) == 1 and fh.read(2) == b"\x01\x02"
    assert [e.name for e in store.entries(f"file://{tmp_path}/a")] == ["b c%20#?.bin"]
    assert store.entry(path).size == 200 and store.entry(path + "x").kind == "missing"
    os.mkfifo(tmp_path / "pipe")
    with pytest.raises(OSError):
        store.open(f"file://{tmp_path}/pipe")
    with pytest.raises(OSError):
        list(store.entries(f"file://{tmp_path}/none"))


def test_path_forms():
    assert has_scheme("s3://b/k") and has_scheme("file:/x") and not has_scheme("/a:b/c") and not has_scheme("c:/x")
    assert split_scheme("file:/x/y") == ("file://", "/x/y") and split_scheme("s3a://b/k%20 l") == ("s3a://", "b/k%20 l")
    assert split_scheme("hdfs://h:8020/x") == ("hdfs://h:8020", "/x") and split_scheme("hdfs:///x") == ("hdfs://", "/x")
    assert normal_path("file:/x/") == "file:///x" and normal_path("/x/") == "/x" and normal_path("file:///") == "file:///"


@pytest.mark.parametrize("scheme", ["", "file://"])
@pytest.mark.parametrize("subtrees", [1, 3, 64])
def test_tree_as_a_table(spark, edges, scheme, subtrees):  # noqa: F811
    datasource.register(spark)
    df = spark.read.format("tallyfs_tree").option("path", scheme + edges).option("subtrees", subtrees).load()
    want = sorted((r.kind, r.path, r.name, r.size, r.mtime, r.error) for r in tree_inventory(spark, scheme + edges).collect())
    assert sorted(map(tuple, df.collect()), key=repr) == sorted(want, key=repr)


def test_unwanted_subtrees_are_never_opened(spark, tmp_path):
    for k in range(40):
        os.makedirs(tmp_path / f"d{k}" / "deep")
        (tmp_path / f"d{k}" / "deep" / "f.txt").write_text("x")
    datasource.register(spark)
    df = spark.read.format("tallyfs_tree").option("path", str(tmp_path)).load().filter(F.col("path").startswith(f"{tmp_path}/d7/de"))
    assert sorted(r.path for r in df.collect()) == [f"{tmp_path}/d7/deep", f"{tmp_path}/d7/deep/f.txt"]
    assert "StartsWith" not in df._jdf.queryExecution().executedPlan().toString()  # the reader took it over
    reader = datasource.TreeReader({"path": str(tmp_path), "prune": "", "subtrees": "8"})
    reader.beginnings = [f"{tmp_path}/d7/de"]
    opened = []
    real, reader._list = reader._list, lambda p, c, s: opened.append(p) or real(p, c, s)
    for part in reader.partitions():
        list(reader.read(part))
    assert set(opened) == {str(tmp_path), f"{tmp_path}/d7", f"{tmp_path}/d7/deep"}


def test_a_long_folder_is_never_held_whole(tmp_path):
    """Python's memory while a folder is listed does not grow with the folder,
    and what is not stat'ed yet is seen as it is then."""
    names = {f"doc_{i:06d}.txt" for i in range(20_000)}
    for name in names:
        open(tmp_path / name, "wb").close()
    store, folder = Store(), f"file://{tmp_path}"
    next(store.entries(folder))  # the handle is open
    tracemalloc.start()
    try:
        n = sum(1 for _ in store.entries(folder))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == len(names) and peak < 1_000_000
    found = store.entries(folder)
    first = next(found)
    for name in names:
        (tmp_path / name).write_bytes(b"x")
    rest = list(found)
    assert {first.name, *(e.name for e in rest)} == names and len(rest) == len(names) - 1
    assert sum(e.size for e in rest) > 15_000


def test_odd_names_of_a_local_folder(tmp_path):
    os.symlink("nowhere", tmp_path / "broken")
    os.symlink(".", tmp_path / "up")
    os.mkfifo(tmp_path / "pipe")
    (tmp_path / "a%20?.txt").write_bytes(b"ab")
    open(os.fsencode(tmp_path) + b"/f\xe9.txt", "wb").close()
    folder = f"file://{tmp_path}"
    got = {r[2]: (r[0], r[3], r[5]) for r in _list_store(Store(), folder, [Store().entry(folder).ident], frozenset())}
    assert got == {"broken": ("skipped", None, "not readable"), "up": ("dir", None, "link to an ancestor, not entered"),
                   "pipe": ("file", 0, None), "a%20?.txt": ("file", 2, None),
                   "f\\udce9.txt": ("skipped", None, "undecodable name")}


def _documents(path, rows):
    columns = list(zip(*rows))
    types = [("doc_id", pa.int64()), ("text", pa.string()), ("lang", pa.string()), ("source", pa.string())]
    table = pa.table({name: pa.array(values, kind) for (name, kind), values in zip(types, columns)})
    os.makedirs(path)
    pa.parquet.write_table(table.append_column("n_chars", pa.array([0] * len(rows), pa.int64())), f"{path}/documents.parquet")
    return str(path)


def test_documents_are_written_from_small_batches(spark, tmp_path, monkeypatch):
    """Ten thousand rows of long texts would be one batch of a task."""
    rows = [(i, f"{i} " + "long text é" * (1_000 if i != 7 else 600_000), "en", "src0") for i in range(2_000)]
    sf_dir = _documents(tmp_path / "in", rows)
    longest = max(len(r[1].encode()) for r in rows)

    def too_large(root, **kinds):
        def run(batches):
            for b in batches:
                yield pa.RecordBatch.from_pydict({"n": [int(b.nbytes > doc_tree.BATCH_BYTES + longest)]})
        return run

    before = spark.conf.get(doc_tree.BATCH_CONF, None)
    with monkeypatch.context() as m:
        m.setattr(doc_tree, "_write_files", too_large)
        assert doc_tree._write(spark, sf_dir, str(tmp_path / "none")) == 0
    assert spark.conf.get(doc_tree.BATCH_CONF, None) == before

    content = [r[1] for r in rows]
    batch = pa.RecordBatch.from_pydict({"rel": [f"d/f{i}" for i in range(2_000)], "content": pa.array(content, pa.binary()),
                                        "doc_id": [r[0] for r in rows]}).slice(8)
    tracemalloc.start()
    try:
        counts = [b.to_pydict() for b in doc_tree._write_files(str(tmp_path / "out"))(iter([batch]))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert counts == [{"n": [1_992]}] and peak < batch.nbytes / 5
    assert all((tmp_path / "out" / "d" / f"f{i}").read_bytes() == content[i].encode() for i in (8, 71, 72, 1_999))


@pytest.mark.parametrize("handle", [False, True])
def test_written_documents_are_the_texts(spark, tmp_path, handle):
    rows = [(1, "plain", "en", "src0"), (2, None, "en", "src0"), (7, "é中\U0001f600\x00\r\n", "fr", "src1"),
            (96, "", "de", "src0"), (None, "no id", "en", "src1"), (3, "x" * 300_000, "es", "src1")]
    root, n = doc_tree.write_doc_tree(spark, _documents(tmp_path / "in", rows), odd=not handle, handle=handle)
    base = root.removeprefix("file://")
    got = sorted(open(os.path.join(d, f), "rb").read() for d, _, files in os.walk(base) for f in files
                 if os.path.isfile(os.path.join(d, f)) and not f.startswith("pipe_"))
    assert got == sorted((r[1] or "").encode() for r in rows)
    pipes = sorted(f for _, _, files in os.walk(base) for f in files if f.startswith("pipe_"))
    assert (pipes, n) == (([], len(rows)) if handle else (["pipe_7", "pipe_96"], len(rows) + 2))
