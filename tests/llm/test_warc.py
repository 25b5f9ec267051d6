"""Archives written and read back, cut into ranges anywhere, damaged, nested."""

import base64
import gzip
import hashlib
import io
import os
import random
import zlib

import pytest

from tallyfs.llm import warc

SCHEMA = "page_id long, url string, html string, key long, payload string, digest string, first string"


def pages():
    rnd = random.Random(4)
    bodies = ["", "<p>é🙂</p>", "<html>" + "word " * 3000, *("".join(rnd.choice("abcdefghij \n") for _ in range(rnd.randrange(2000)))
                                                        for _ in range(60))]
    rows = [(i, f"http://x.example/{i}\r\nWARC-Type: fake", rnd.choice(bodies)) for i in range(150)]
    rows += [(None, None, bodies[1]), (None, None, "only without key"), (None, "u", "only without key"), (200, None, None),
             (3, "http://again", rows[3][2]), (3, "http://other", "another text of page 3"), (300, "u", "x" * 1_000_000)]
    return rows


def expected(rows, least=0):
    key = lambda i: (i is not None, i or 0)
    top = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", i), i, key=key)
    out = []
    for i, u, h in rows:
        data = (h or "").encode()
        m = top[h or ""] if len(data) >= least else i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if m == i else "revisit",
                    None if m == i else m))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "p", "d", "f") for r in rows], SCHEMA)


def found(records):
    good = records.filter("kind = 'record' and type != 'warcinfo'")
    return sorted(((r.key, r.bytes, r.digest, r.type, r.refers_key) for r in warc.resolve(good).collect()), key=repr)


@pytest.mark.parametrize("split,least,file_bytes", [(1 << 20, 0, 1 << 30), (37, 0, 1 << 30), (4000, 10, 5000)])
def test_round_trip(spark, tmp_path, split, least, file_bytes):
    rows = pages() if split > 100 else pages()[:60]
    archives = warc.write_warc(spark, frame(spark, rows).repartition(3), str(tmp_path), min_revisit_bytes=least, file_bytes=file_bytes)
    assert archives.agg({"records": "sum"}).first()[0] == len(rows)
    if file_bytes < 1 << 20:
        assert archives.count() > 6
    records = warc.read_warc(spark, archives, split_bytes=split).cache()
    assert records.filter("kind = 'error' or not coalesce(digest_ok, true)").count() == 0
    assert found(records) == expected(rows, least)


def test_other_readers_understand_the_archive(spark, tmp_path):
    """Plain gzip and the record format, without this module's parser."""
    rows = pages()
    archives = warc.write_warc(spark, frame(spark, rows).coalesce(1), str(tmp_path)).collect()
    assert len(archives) == 1 and os.path.getsize(archives[0].path.removeprefix("file://")) == archives[0].bytes
    data = gzip.open(archives[0].path.removeprefix("file://")).read()
    stream, seen = io.BytesIO(data), []
    while line := stream.readline():
        assert line == b"WARC/1.1\r\n"
        head = {}
        while (line := stream.readline()) != b"\r\n":
            k, v = line.rstrip(b"\r\n").split(b": ", 1)
            head[k] = v
        block = stream.read(int(head[b"Content-Length"]))
        assert stream.read(4) == b"\r\n\r\n"
        if head[b"WARC-Type"] != b"warcinfo":
            assert head[b"WARC-Block-Digest"] == b"sha1:" + base64.b32encode(hashlib.sha1(block).digest())
        seen.append((head[b"WARC-Type"], block.partition(b"\r\n\r\n")[2], head.get(b"WARC-Record-ID")))
    kinds = [k for k, _, _ in seen]
    assert kinds[0] == b"warcinfo" and kinds.count(b"revisit") == sum(r[3] == "revisit" for r in expected(rows))
    assert {b for k, b, _ in seen if k == b"response"} == {(h or "").encode() for _, _, h in rows}


def response(body, key):
    return warc.page_record(key, f"http://a/{key}", body, hashlib.sha256(body).digest(), None)


def files(spark, tmp_path, *contents):
    rows = []
    for i, data in enumerate(contents):
        path = f"{tmp_path}/f{i}.warc.gz"
        with open(path, "wb") as fh:
            fh.write(data)
        rows.append((path, len(data)))
    return spark.createDataFrame(rows, "path string, bytes long")


@pytest.mark.parametrize("split", [50, 700, 5000, 1 << 20])
def test_archives_within_archives(spark, tmp_path, split):
    """A stored member shows the members inside it; they are no records."""
    rnd = random.Random(split)
    inner = b"".join(warc.member(response(b"inner %d " % i + rnd.randbytes(200), 1000 + i)) for i in range(30))
    data = b"".join([warc.member(response(b"first", 1)), warc.member(response(inner, 2), level=0), warc.member(response(b"last", 3)),
                     warc.member(response(inner + inner, 4), level=0), warc.member(response(b"end", 5))])
    got = warc.read_warc(spark, files(spark, tmp_path, data), split_bytes=split, payload=True).collect()
    assert sorted((r.kind, r.key, r.bytes, r.digest_ok) for r in got) == [
        ("record", 1, 5, True), ("record", 2, len(inner), True), ("record", 3, 4, True), ("record", 4, 2 * len(inner), True),
        ("record", 5, 3, True)]
    assert {r.key: bytes(r.payload) for r in got}[4] == inner + inner


@pytest.mark.parametrize("split", [64, 1000, 1 << 20])
def test_damage_costs_only_the_damaged(spark, tmp_path, split):
    rnd = random.Random(1)
    members = [warc.member(response(rnd.randbytes(300), i)) for i in range(20)]
    broken = bytearray(members[7])
    broken[len(broken) // 2] ^= 0xFF
    data = b"".join([*members[:7], bytes(broken), *members[8:12], b"\0" * 100, *members[12:]])
    cut = b"".join(members)[:-40]
    several = zlib.compress(b"".join(response(b"r%d" % i, i) for i in range(5)), wbits=31) + warc.member(b"")
    got = warc.read_warc(spark, files(spark, tmp_path, data, cut, several, b"no archive at all", b""), split_bytes=split).collect()
    by = {}
    for r in got:
        by.setdefault((r.path[-9], r.kind), []).append(r.key)
    assert sorted(by["0", "record"]) == [i for i in range(20) if i != 7] and len(by["0", "error"]) == 2
    assert sorted(by["1", "record"]) == list(range(19)) and len(by["1", "error"]) == 1
    assert sorted(by["2", "record"]) == list(range(5)) and ("2", "error") not in by
    assert ("3", "record") not in by and len(by["3", "error"]) == 1 and ("4", "record") not in by


def test_empty_table(spark, tmp_path):
    archives = warc.write_warc(spark, frame(spark, []), str(tmp_path))
    assert archives.count() == 0 and warc.read_warc(spark, archives).count() == 0


def test_payloads_are_shuffled_beyond_the_bound(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_ROWS", 0)
    rows = pages()
    archives = warc.write_warc(spark, frame(spark, rows), str(tmp_path))
    assert found(warc.read_warc(spark, archives)) == expected(rows)
