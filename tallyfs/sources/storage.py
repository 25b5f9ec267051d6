"""File systems as the tasks see them: one handle for listing, reading by
ranges and writing.

A plain path (``/mnt/share/x``) is a folder mounted on every executor and is
read with ``os`` calls (``sources/tree.py``, ``sources/readers.py``). A path
with a scheme (``hdfs://host/x``, ``s3://bucket/x``, ``file:///x``) is read
through a ``pyarrow.fs`` handle that each task opens for itself: a selector
lists a folder with sizes and times in one call, files are opened for ranged
reads, and nothing needs a mount. ``Store(prefix, filesystem)`` carries a handle
of the caller's own (credentials, a sub-tree, another implementation); it is
pickled with the task.

Paths keep their scheme everywhere in an inventory, so that a row alone says
how to open its file. They are taken literally: no character of a name is
percent-decoded.
"""

from __future__ import annotations

import errno
import io
import itertools
import os
import posixpath
import stat
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs

FILE, DIR, OTHER, MISSING = "file", "dir", "other", "missing"
#: Schemes whose paths begin with a host (or nothing); in the others the first
#: part after the scheme is a bucket, which belongs to the path.
HOST_SCHEMES = ("hdfs", "viewfs")
#: Hadoop's names of schemes that the handles know by another one.
SAME_SCHEME = {"s3a": "s3", "s3n": "s3", "gcs": "gs", "abfss": "abfs"}
#: Bytes of one ranged read when a file is read on.
READ_BYTES = 1 << 20
#: Names of a local folder that the handle is asked about in one call.
NAMES_AT_ONCE = 1_000


@dataclass(frozen=True)
class Entry:
    """One entry of a folder. ``ident`` tells folders apart that links make
    reachable by several paths."""

    path: str
    name: str
    kind: str
    size: int | None = None
    mtime_s: float | None = None
    ident: str | None = None


def has_scheme(path: str) -> bool:
    """Whether ``path`` names its file system."""
    head = path.split("/", 1)[0]
    return head.endswith(":") and len(head) > 2


def split_scheme(path: str) -> tuple[str, str]:
    """(prefix, path as the handle wants it) of a path with a scheme; joined
    they name the file again."""
    scheme, rest = path.split(":", 1)
    if scheme == "file":
        return "file://", "/" + rest.lstrip("/")
    rest = rest[2:] if rest.startswith("//") else rest.lstrip("/")
    if scheme in HOST_SCHEMES:
        host, _, tail = rest.partition("/")
        return f"{scheme}://{host}", "/" + tail
    return f"{scheme}://", rest


def normal_path(path: str) -> str:
    """``path`` in the one form that inventories use (``file:/x`` becomes
    ``file:///x``), without an ending slash."""
    if has_scheme(path):
        prefix, rest = split_scheme(path)
        return prefix + (rest.rstrip("/") or "/")
    return path.rstrip("/") or "/"


_HANDLES: dict[str, pafs.FileSystem] = {}


def _handle(prefix: str, path: str) -> pafs.FileSystem:
    """The handle of a prefix, opened once per process. A bucket's handle may
    depend on the bucket (its region), so it is kept by bucket."""
    scheme = prefix.split("://", 1)[0]
    bucket = "" if scheme == "file" or scheme in HOST_SCHEMES else path.split("/", 1)[0]
    key = prefix + bucket
    if key not in _HANDLES:
        if scheme == "file":
            _HANDLES[key] = pafs.LocalFileSystem()
        else:
            uri = f"{SAME_SCHEME.get(scheme, scheme)}://" + (bucket or prefix.split("://", 1)[1] + "/")
            _HANDLES[key] = pafs.FileSystem.from_uri(uri)[0]
    return _HANDLES[key]


def _encodes(name: str) -> bool:
    try:
        name.encode("utf-8")
        return True
    except UnicodeEncodeError:
        return False


def _as_os_error(exc: Exception, path: str) -> OSError:
    return exc if isinstance(exc, OSError) else OSError(errno.EIO, str(exc), path)


class Store:
    """A file system by its handle. ``prefix`` is what a path has before the
    part that the handle understands; without ``filesystem`` the handle is made
    from the path's own scheme, on the executor."""

    def __init__(self, prefix: str = "", filesystem: pafs.FileSystem | None = None):
        if filesystem is not None and not prefix.endswith("://"):
            raise ValueError("a store of its own needs a prefix such as 'data://'")
        self.prefix, self.filesystem = prefix, filesystem

    def _at(self, path: str) -> tuple[pafs.FileSystem, str]:
        if self.filesystem is not None:
            if not path.startswith(self.prefix):
                raise OSError(errno.EINVAL, f"not in the store {self.prefix}", path)
            return self.filesystem, path[len(self.prefix):]
        prefix, rest = split_scheme(path) if has_scheme(path) else ("file://", path)
        return _handle(prefix, rest), rest

    def _entry(self, path: str, info: pafs.FileInfo, local: bool) -> Entry:
        kind = {pafs.FileType.File: FILE, pafs.FileType.Directory: DIR, pafs.FileType.Unknown: OTHER}.get(info.type, MISSING)
        mtime = info.mtime_ns / 1e9 if info.mtime_ns is not None else None
        ident = path
        if local and kind == DIR:
            try:
                st = os.stat(info.path)
                ident, mtime = f"{st.st_dev}:{st.st_ino}", st.st_mtime
            except OSError:  # gone since; it will not be listed either
                pass
        return Entry(path, posixpath.basename(path.rstrip("/")), kind, info.size, mtime, ident)

    def entry(self, path: str) -> Entry:
        """What ``path`` is now; kind ``missing`` if there is nothing."""
        fs, rest = self._at(path)
        try:
            return self._entry(path, fs.get_file_info(rest.rstrip("/") or "/"), fs.type_name == "local")
        except (pa.ArrowException, OSError) as exc:
            raise _as_os_error(exc, path) from exc

    def _local_entries(self, fs: pafs.FileSystem, rest: str, base: str) -> Iterator[Entry]:
        try:
            found = os.scandir(rest)
        except OSError:
            fs.get_file_info(pafs.FileSelector(rest))  # says why in the handle's words
            raise
        with found:
            names = (entry.name for entry in found)
            while part := list(itertools.islice(names, NAMES_AT_ONCE)):
                known = [name for name in part if _encodes(name)]
                infos = dict(zip(known, fs.get_file_info([f"{rest.rstrip('/')}/{name}" for name in known])))
                for name in part:
                    if name not in infos or infos[name].type == pafs.FileType.NotFound:
                        yield Entry(base + name, name, MISSING)
                    else:
                        yield self._entry(base + name, infos[name], True)

    def entries(self, path: str) -> Iterator[Entry]:
        """Everything directly in a folder, with sizes and times. A local folder
        is read on by ``NAMES_AT_ONCE`` names, so a long one is never held whole;
        its links without a target, and names that are not Unicode, are of kind
        ``missing``. Other handles bring a folder in one selector call."""
        fs, rest = self._at(path)
        base = path.rstrip("/") + "/"
        try:
            if fs.type_name == "local":
                yield from self._local_entries(fs, rest, base)
            else:
                for info in fs.get_file_info(pafs.FileSelector(rest, recursive=False)):
                    yield self._entry(base + info.base_name, info, False)
        except (pa.ArrowException, UnicodeError, OSError) as exc:
            raise _as_os_error(exc, path) from exc

    def open(self, path: str):
        """A regular file for reading at any place (``read``, ``seek``,
        ``read_at``). Anything else is refused before it is opened: opening a
        FIFO would wait for ever."""
        fs, rest = self._at(path)
        try:
            if fs.type_name == "local" and not stat.S_ISREG(os.stat(rest).st_mode):
                raise OSError(errno.EINVAL, "not a regular file")
            return fs.open_input_file(rest)
        except (pa.ArrowException, OSError) as exc:
            raise _as_os_error(exc, path) from exc

    def read_range(self, path: str, start: int, length: int) -> bytes:
        """At most ``length`` bytes from ``start``; fewer at the end."""
        with self.open(path) as fh:
            return read_at(fh, start, length)

    def make_folder(self, path: str) -> None:
        """A folder with those above it; there may be one already."""
        fs, rest = self._at(path)
        try:
            fs.create_dir(rest, recursive=True)
        except (pa.ArrowException, OSError) as exc:
            raise _as_os_error(exc, path) from exc

    def create(self, path: str):
        """A new file for writing, its folder made if need be. It is complete
        once closed; object stores show it only then."""
        fs, rest = self._at(path)
        try:
            if fs.type_name in ("local", "hdfs", "subtree") or fs.type_name.startswith("py::"):
                fs.create_dir(posixpath.dirname(rest), recursive=True)
            return fs.open_output_stream(rest, compression=None)  # not by the name
        except (pa.ArrowException, OSError) as exc:
            raise _as_os_error(exc, path) from exc


def read_at(fh, start: int, length: int) -> bytes:
    """At most ``length`` bytes of an open file from ``start``."""
    try:
        size = fh.size()
        return b"" if start >= size else fh.read_at(min(length, size - start), start)
    except pa.ArrowException as exc:
        raise OSError(errno.EIO, str(exc)) from exc


class _PythonFile(io.RawIOBase):
    """A handle's file as Python's readers expect one: a place before the first
    byte is an ``OSError``."""

    def __init__(self, fh):
        self._fh = fh

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def seek(self, place: int, whence: int = io.SEEK_SET) -> int:
        try:
            return self._fh.seek(place, whence)
        except pa.ArrowException as exc:
            raise OSError(errno.EINVAL, str(exc)) from exc

    def tell(self) -> int:
        return self._fh.tell()

    def readinto(self, buffer) -> int:
        data = self._fh.read(len(buffer))
        buffer[:len(data)] = data
        return len(data)

    def close(self) -> None:
        self._fh.close()
        super().close()


def python_file(fh):
    """``fh`` for a reader of Python's library."""
    return io.BufferedReader(_PythonFile(fh)) if isinstance(fh, pa.NativeFile) else fh


def store_of(path: str, store: Store | None = None) -> Store | None:
    """The store that ``path`` is in: the caller's, or that of its scheme; None
    for a path on a mount."""
    if store is not None:
        return store
    return Store() if has_scheme(path) else None
