"""WARC archives: a writer that turns repeated payloads into revisits, and a
reader whose tasks take byte ranges.

Writing: each task writes archives of its own rows, one gzip member per record,
and returns their names; only archives named in the written list count, so a
task that runs twice leaves no record twice. Of the rows with equal payloads
(SHA-256) of at least ``min_revisit_bytes``, the one with the largest key is a
``response``; the others are ``revisit`` records, which hold the response's
headers and its record id but no payload.

Reading: a file is cut into ranges, wherever they fall. A task scans its range
for the gzip magic, and a place counts as a member if its header decodes and a
WARC record begins there; from then on members follow one another. A task owns
the records of members that start inside its range and reads past its end to
finish the last. What it took for its first member is not believed: the magic
may stand inside another member (an archive within an archive, stored without
compression). Each range reports where it began and where its last member ended,
and a range that did not begin where the ranges before it ended is read again
from there, until all agree. Records are parsed as a stream; a payload is only
held if the caller wants it.

Defined cases: a null payload is empty; a null key is smaller than any other, so
such a row is a response only if no row of its payload has a key; rows that
share payload and largest key are all responses; a null url has no target URI; a
member that cannot be decoded gives an ``error`` row and reading goes on at the
next member of the range; an empty table gives one empty list and no records;
other columns are ignored. A gzip file of one giant member is one task, as its
inside has no place to start from.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyfs.llm.common import BROADCAST_ROWS, bounded_broadcast, hot_join, lean, materialize, prepare
from tallyfs.sources.storage import Store, normal_path, read_at, store_of

DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_BYTES = 1 << 30
#: Bytes of a range: a lost task costs little, and a range costs one seek.
SPLIT_BYTES = 1 << 20
SPLITS_PER_TASK = 64
MAGIC = b"\x1f\x8b\x08"
WINDOW = 1 << 18
#: Compressed bytes looked at to see what a candidate decodes to.
PROBE = 1 << 16
OUT_BYTES = 1 << 18
HEAD_BYTES = 1 << 20
END = b"\r\n\r\n"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(key: int | None, sha256: bytes) -> str:
    """The id of the record of a row: the same whoever computes it."""
    name = hashlib.sha256(f"{key}|".encode() + sha256).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=name, version=5)}>"


def _line(value: str) -> str:
    """A header's value on one line."""
    return value.replace("\r", "%0D").replace("\n", "%0A")


def warc_record(fields: list[tuple[str, str | None]], block: bytes) -> bytes:
    head = "".join(f"{k}: {_line(v)}\r\n" for k, v in [*fields, ("Content-Length", str(len(block)))] if v is not None)
    return b"WARC/1.1\r\n" + head.encode("utf-8", "replace") + b"\r\n" + block + END


def member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def page_record(key: int | None, url: str | None, payload: bytes, sha256: bytes, first: tuple | None) -> bytes:
    """The record of a row; ``first`` is (key, url) of the response that it
    revisits."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if first else http + payload
    fields = [("WARC-Type", "revisit" if first else "response"), ("WARC-Record-ID", record_id(key, sha256)), ("WARC-Date", DATE),
              ("WARC-Target-URI", url), ("Content-Type", "application/http; msgtype=response"),
              ("WARC-Payload-Digest", "sha1:" + base32_sha1(hashlib.sha1(payload).digest())),
              ("WARC-Block-Digest", "sha1:" + base32_sha1(hashlib.sha1(block).digest())),
              ("Page-Key", None if key is None else str(key))]
    if first:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first[0], sha256)),
                   ("WARC-Refers-To-Target-URI", first[1]), ("WARC-Refers-To-Date", DATE)]
    return warc_record(fields, block)


def info_record() -> bytes:
    return warc_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE),
                        ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")


def write_warc(spark: SparkSession, pages: DataFrame, folder: str, key: str = "page_id", url: str = "url",
               payload: str = "html", min_revisit_bytes: int = 0, file_bytes: int = FILE_BYTES,
               store: Store | None = None) -> DataFrame:
    """Write ``pages`` below ``folder``; returns the list of archives (path,
    bytes, records) as a written table."""
    prepare(spark)
    folder = normal_path(folder)
    store = store_of(folder, store) or Store()
    if "://" not in folder:
        folder = "file://" + folder
    rows = pages.select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload).cast("binary"), F.expr("X''")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha2("payload", 256)))
    # Only payloads that repeat have a row here.
    firsts = (rows.filter(F.octet_length("payload") >= min_revisit_bytes).groupBy("digest")
              .agg(F.count("*").alias("n"), F.max(F.struct(F.col("key").isNotNull().alias("has"), "key", "url")).alias("first"))
              .filter("n > 1"))
    firsts = materialize(spark, firsts, "warc_firsts")
    small, fits = bounded_broadcast(firsts, BROADCAST_ROWS)
    # Below the bound payloads stay where they are; beyond it they are shuffled
    # by their digest, repeated ones dealt out.
    joined = rows.join(small, "digest", "left") if fits else hot_join(rows, firsts, "digest", "n", "key", how="left")
    again = F.col("first").isNotNull() & ~F.col("first.key").eqNullSafe(F.col("key"))
    rows = joined.select("key", "url", "payload", "digest", F.when(again, F.col("first")).alias("first"))

    def run(batches):
        out, path, size, n, done = None, None, 0, 0, []

        def close():
            out.close()
            done.append((path, size, n))

        for b in batches:
            for k, u, p, d, f in zip(*(b.column(c) for c in ("key", "url", "payload", "digest", "first"))):
                f = f.as_py()
                data = member(page_record(k.as_py(), u.as_py(), p.as_py(), d.as_py(), f and (f["key"], f["url"])))
                if out is not None and size + len(data) > file_bytes:
                    close()
                    out = None
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
                    out, size, n = store.create(path), 0, 0
                    head = member(info_record())
                    out.write(head)
                    size += len(head)
                out.write(data)
                size += len(data)
                n += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], t) for i, t in
                                          enumerate((pa.string(), pa.int64(), pa.int64()))], names=["path", "bytes", "records"])

    return materialize(spark, rows.mapInArrow(lean(run), "path string, bytes long, records long"), "warc_archives")


class RangeReader:
    """An open file read by windows."""

    def __init__(self, fh):
        self.fh, self.at, self.held = fh, 0, b""

    def read(self, at: int, n: int) -> bytes:
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.at, self.held = at, read_at(self.fh, at, max(n, WINDOW))
        return self.held[at - self.at:at - self.at + n]


def begins_record(src: RangeReader, at: int) -> bool:
    """Whether a gzip member begins here and a WARC record in it."""
    head = src.read(at, PROBE)
    if len(head) < 18 or head[3] & 0xE0:
        return False
    try:
        return zlib.decompressobj(31).decompress(head, 64).startswith(b"WARC/")
    except zlib.error:
        return False


def find_member(src: RangeReader, at: int, stop: int) -> int | None:
    """The first place from ``at`` to before ``stop`` where a member begins."""
    while at < stop:
        n = min(WINDOW, stop - at + len(MAGIC) - 1)
        chunk = src.read(at, n)
        hit = chunk.find(MAGIC)
        if hit < 0:
            if len(chunk) < n:
                return None
            at += n - len(MAGIC) + 1
        elif at + hit >= stop:
            return None
        elif begins_record(src, at + hit):
            return at + hit
        else:
            at += hit + 1
    return None


class Records:
    """Records of a decoded stream that is fed piece by piece."""

    def __init__(self, keep: bool):
        self.keep, self.buf, self.done = keep, bytearray(), []
        self._next = self._head

    def feed(self, data: bytes) -> None:
        self.buf += data
        while self._next():
            pass

    def finish(self) -> None:
        if self.buf or self._next != self._head:
            raise ValueError("the record is cut off")

    def _fields(self, first: bytes) -> dict[str, str] | None:
        end = self.buf.find(END)
        if end < 0:
            if len(self.buf) > HEAD_BYTES:
                raise ValueError("a header without end")
            return None
        lines = bytes(self.buf[:end]).decode("utf-8", "replace").split("\r\n")
        if not lines[0].startswith(first.decode()):
            raise ValueError(f"no {first.decode()} header")
        del self.buf[:end + len(END)]
        return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}

    def _head(self) -> bool:
        if not self.buf:
            return False
        if (fields := self._fields(b"WARC/")) is None:
            return False
        self.left = int(fields.get("content-length", "-1"))
        if self.left < 0:
            raise ValueError("no content length")
        self.rec = {"type": fields.get("warc-type"), "id": fields.get("warc-record-id"), "url": fields.get("warc-target-uri"),
                    "key": int(fields["page-key"]) if "page-key" in fields else None, "refers": fields.get("warc-refers-to"),
                    "digest": (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None}
        self.length, self.sha, self.kept = None, hashlib.sha1(), bytearray() if self.keep else None
        self.size = 0
        http = fields.get("content-type", "").startswith("application/http")
        self._next = self._http if http and self.left else self._body
        return True

    def _http(self) -> bool:
        """The HTTP header that the block begins with; it is no payload."""
        end = self.buf.find(END, 0, self.left)
        if end < 0:
            if len(self.buf) >= self.left or len(self.buf) > HEAD_BYTES:  # none: all of it is payload
                self._next = self._body
                return True
            return False
        for line in bytes(self.buf[:end]).split(b"\r\n")[1:]:
            name, _, value = line.partition(b":")
            if name.strip().lower() == b"content-length" and value.strip().isdigit():
                self.length = int(value)
        del self.buf[:end + len(END)]
        self.left -= end + len(END)
        self._next = self._body
        return True

    def _body(self) -> bool:
        part = bytes(self.buf[:self.left])
        del self.buf[:len(part)]
        self.left -= len(part)
        self.size += len(part)
        self.sha.update(part)
        if self.kept is not None:
            self.kept += part
        if self.left:
            return False
        self._next = self._tail
        return True

    def _tail(self) -> bool:
        if len(self.buf) < len(END):
            return False
        if not self.buf.startswith(END):
            raise ValueError("no end of the record")
        del self.buf[:len(END)]
        rec, found = self.rec, base32_sha1(self.sha.digest())
        whole = rec["type"] != "revisit"
        rec["bytes"] = self.size if whole or self.length is None else self.length
        rec["digest_ok"] = None if not whole or rec["digest"] is None else rec["digest"] == found
        rec["digest"] = found if whole else rec["digest"]
        rec["payload"] = bytes(self.kept) if self.kept is not None and whole else None
        self.done.append(rec)
        self._next = self._head
        return True


def read_member(src: RangeReader, at: int, records: Records) -> int:
    """Decode the member at ``at`` into ``records``; returns where it ends."""
    z = zlib.decompressobj(31)
    while not z.eof:
        data = src.read(at, WINDOW)
        if not data:
            raise EOFError("the member is cut off")
        records.feed(z.decompress(data, OUT_BYTES))
        while z.unconsumed_tail and not z.eof:
            records.feed(z.decompress(z.unconsumed_tail, OUT_BYTES))
        at += len(data) - len(z.unused_data)
    records.finish()
    return at


def read_range(fh, size: int, start: int, stop: int, first: int | None, keep: bool):
    """Of one range: rows (kind, offset, record or message) and at last
    (``range``, begin, end): where its first own member was found, or None, and
    where its last one ended, or None if that is lost. ``first`` is where to
    begin, if that is known."""
    src = RangeReader(fh)
    at = first if first is not None else 0 if start == 0 and size else find_member(src, start, stop)
    begin = at
    while at is not None and at < stop:
        records = Records(keep)
        try:
            end = read_member(src, at, records)
        except (zlib.error, EOFError, ValueError) as exc:
            yield "error", at, f"{type(exc).__name__}: {exc}"
            at = find_member(src, at + 1, stop)
            continue
        for rec in records.done:
            yield "record", at, rec
        at = end
    yield "range", begin, at


COLUMNS = {"type": "string", "id": "string", "key": "long", "url": "string", "refers": "string", "bytes": "long",
           "digest": "string", "digest_ok": "boolean", "payload": "binary"}
SCHEMA = "path string, start long, kind string, offset long, stop_at long, error string, " + ", ".join(
    f"{k} {v}" for k, v in COLUMNS.items())
RANGES = "path string, size long, start long, stop long, first long"


def _decode(ranges: DataFrame, store: Store | None, keep: bool) -> DataFrame:
    types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(),
             pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_(), pa.binary()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def run(batches):
        rows, held = [], 0

        def out():
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)] if rows else
                                               [pa.array([], t) for t in types], names=names)
            rows.clear()
            return batch

        for b in batches:
            for r in b.to_pylist():
                with (store_of(r["path"], store) or Store()).open(r["path"]) as fh:
                    for kind, at, what in read_range(fh, r["size"], r["start"], r["stop"], r["first"], keep):
                        rec = what if kind == "record" else {}
                        rows.append((r["path"], r["start"], kind, at, what if kind == "range" else None,
                                     what if kind == "error" else None, *(rec.get(c) for c in COLUMNS)))
                        held += len(rec.get("payload") or b"")
                        if len(rows) >= 5_000 or held > 8 << 20:
                            yield out()
                            held = 0
        yield out()

    return ranges.mapInArrow(lean(run), SCHEMA)


def _wrong_ranges(found: DataFrame, ranges: DataFrame) -> DataFrame:
    """Ranges that did not begin where those before them ended, with the right
    ``first`` (``stop`` if none of their bytes begin a member)."""
    ends = found.filter("kind = 'range'").select("path", "start", F.col("offset").alias("begin"), "stop_at")
    earlier = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    known = (ends.withColumn("due", F.last("stop_at", ignorenulls=True).over(earlier))
             .join(ranges.drop("first"), ["path", "start"]).filter("due >= start"))
    due = F.when(F.col("due") < F.col("stop"), F.col("due"))
    return (known.filter(~F.col("begin").eqNullSafe(due))
            .select("path", "size", "start", "stop", F.coalesce(due, F.col("stop")).alias("first")))


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES, payload: bool = False,
              store: Store | None = None) -> DataFrame:
    """Records and errors of ``archives`` (path, bytes): path, offset (of the
    member), kind (``record`` or ``error``), error, type, id, key, url, refers
    (record id), bytes and digest of the payload (of a revisit: as its headers
    say), digest_ok, and with ``payload`` the payload."""
    prepare(spark)
    ranges = archives.select(
        "path", F.col("bytes").alias("size"),
        F.explode(F.expr(f"sequence(0L, greatest(bytes - 1, 0L) div {split_bytes})")).alias("k")).select(
        "path", "size", F.expr(f"k * {split_bytes}").alias("start"), F.expr(f"least(size, (k + 1) * {split_bytes})").alias("stop"),
        F.lit(None).cast("long").alias("first"))
    ranges = materialize(spark, ranges, "warc_ranges")
    n = ranges.count()
    tasks = max(1, min(n, max(spark.sparkContext.defaultParallelism, -(-n // SPLITS_PER_TASK))))
    found = materialize(spark, _decode(ranges.repartition(tasks, "path", "start"), store, payload), "warc_found")
    while True:
        wrong = materialize(spark, _wrong_ranges(found, ranges), "warc_wrong")
        if wrong.isEmpty():
            break
        # Every pass puts at least the first wrong range of each file right.
        again = _decode(wrong.filter("first < stop"), store, payload)
        none = wrong.filter("first = stop").select("path", "start", F.lit("range").alias("kind"))
        found = materialize(spark, found.join(wrong, ["path", "start"], "left_anti").unionByName(again)
                            .unionByName(none, allowMissingColumns=True), "warc_found")
    return found.filter("kind != 'range'").drop("start", "stop_at", *([] if payload else ["payload"]))


def resolve(records: DataFrame) -> DataFrame:
    """``records`` (of type response or revisit) with ``refers_key``: the key of
    the response that a revisit names."""
    revisits = records.filter("type = 'revisit'")
    keys = revisits.groupBy("refers").agg(F.count("*").alias("n"))
    named = records.filter("type = 'response'").select(F.col("id").alias("refers"), F.col("key").alias("refers_key")).distinct()
    keys = keys.join(named, "refers", "left")
    found = hot_join(revisits, keys, "refers", "n", "offset", how="left").select(*records.columns, "refers_key")
    rest = records.filter("type = 'response'").select("*", F.lit(None).cast("long").alias("refers_key"))
    return rest.unionByName(found)
