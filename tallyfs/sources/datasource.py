"""A directory tree as a table: ``spark.read.format("tallyfs_tree")``.

``register(spark)`` makes the format known; the option ``path`` names the root
(a mount or a path with a scheme), ``prune`` folder names to leave out, separated
by commas, and ``subtrees`` how many partitions to aim at. Columns are those of a
listing: kind, path, name, size, mtime, error.

Filters that ask for a beginning of ``path`` are taken over by the reader: a
folder that can hold no such path is never opened. Partitions are subtrees: the
planner opens folders from the root down until it has met ``subtrees`` of them
(so it lists that many folders at most, whatever the size of the tree); each
becomes one task that walks it. ``tree_inventory`` deals every level out anew and
is the better choice for a whole tree with one giant branch; this source is for
queries that want a part of a tree, in SQL.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, InputPartition, StringStartsWith

from tallyfs.session import ship_package
from tallyfs.sources.storage import Store, store_of
from tallyfs.sources.tree import BATCH_ROWS, _list_dir, _list_store, _root

NAME = "tallyfs_tree"
SCHEMA = "kind string, path string, name string, size bigint, mtime timestamp, error string"
ARROW = pa.schema([("kind", pa.string()), ("path", pa.string()), ("name", pa.string()), ("size", pa.int64()),
                   ("mtime", pa.timestamp("us", tz="UTC")), ("error", pa.string())])


class Subtree(InputPartition):
    """Folders to list, (path, identities of the folders above and itself);
    with ``deep`` all that lies below them too."""

    def __init__(self, folders: list[tuple[str, list[str]]], deep: bool):
        super().__init__(None)
        self.folders, self.deep = folders, deep


class TreeReader(DataSourceReader):
    def __init__(self, options: dict):
        if "path" not in options:
            raise ValueError("the option path names the folder to list")
        self.path = options["path"]
        self.prune = frozenset(n.strip().lower() for n in options.get("prune", "").split(",") if n.strip())
        self.subtrees = int(options.get("subtrees", "64"))
        self.beginnings: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, StringStartsWith) and f.attribute == ("path",):
                self.beginnings.append(f.value)  # exact: rows are tested too
            else:
                if isinstance(f, EqualTo) and f.attribute == ("path",) and isinstance(f.value, str):
                    self.beginnings.append(f.value)  # narrows the walk; Spark tests equality
                yield f

    def _may_hold(self, folder: str) -> bool:
        """Whether a path below ``folder`` can begin as asked for."""
        inside = folder.rstrip("/") + "/"
        return all(inside.startswith(b) or b.startswith(inside) for b in self.beginnings)

    def _list(self, path: str, chain: list[str], store: Store | None) -> Iterator[tuple]:
        return _list_store(store, path, chain, self.prune) if store else _list_dir(path, chain, self.prune, 1 << 62)

    def partitions(self) -> list[InputPartition]:
        root, ident, store = _root(self.path, store_of(self.path))
        opened, waiting = [], [(root, [ident])] if self._may_hold(root) else []
        while waiting and len(waiting) < self.subtrees and len(opened) < self.subtrees:
            folder = waiting.pop(0)
            opened.append(folder)
            waiting += [(row[1], row[7]) for row in self._list(*folder, store) if row[6] and self._may_hold(row[1])]
        parts: list[InputPartition] = [Subtree([f], True) for f in waiting]
        return parts + ([Subtree(opened, False)] if opened else [])

    def read(self, partition: Subtree) -> Iterator[pa.RecordBatch]:
        stack, rows = list(partition.folders), []
        while stack:
            path, chain = stack.pop()
            for kind, at, name, size, mtime, error, descend, below, _ in self._list(path, chain, store_of(path)):
                if descend and partition.deep and self._may_hold(at):
                    stack.append((at, below))
                if all(at.startswith(b) for b in self.beginnings):
                    rows.append((kind, at, name, size, None if mtime is None else int(mtime * 1e6), error))
                if len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows = []
        if rows:
            yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), ARROW)], schema=ARROW)


class TreeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    """Make the format known to the session and let filters reach it."""
    ship_package(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TreeSource)
