"""One size and one hash holding a third of all rows: results stay whole and
equal a brute-force answer computed in Python on the same small fixture."""

import hashlib
from collections import Counter

from tallyfs.operators import duplicates as dup
from tallyfs.sources.table import table_files


def test_hot_group(spark):
    rows = []
    for i in range(3000):
        if i % 3 == 0:
            content = b""                      # hot: a third of all files are empty
        elif i % 3 == 1:
            content = b"same-%d" % (i % 7)     # a handful of mid-size groups
        else:
            content = b"unique-%d" % i
        rows.append((f"/d/{i // 100}/f{i}.bin", bytearray(content)))
    df = spark.createDataFrame(rows, "path string, content binary").repartition(16)
    inv = table_files(df, path="path", content="content")
    res = dup.find_duplicates(inv, dup.ColumnReader())
    got = sorted((g["full_hash"], g["size"], g["copies"]) for g in res.groups.collect())
    cnt = Counter((hashlib.sha256(bytes(c)).hexdigest(), len(c)) for _, c in rows)
    want = sorted((h, s, n) for (h, s), n in cnt.items() if n >= 2)
    assert got == want
    rec = dup.reclaimable_files(res).count()
    assert rec == sum(n - 1 for _, _, n in want)
    listing = dup.duplicate_listing(res)
    assert listing.count() == sum(n for _, _, n in want)
    assert listing.select("group_no").distinct().count() == len(want)
    # with the hot-group threshold below the empty group's 1,000 members the
    # salted joins run, and give the same rows
    salted_rec = sorted(map(tuple, dup.reclaimable_files(res, hot_copies=100).collect()))
    assert salted_rec == sorted(map(tuple, dup.reclaimable_files(res).collect()))
    groups = res.groups.withColumn("payload", res.groups["copies"] * 2)
    joined = dup.join_to_groups(res.files, groups, hot_copies=100)
    assert joined.count() == sum(n for _, _, n in want)
    assert joined.filter("payload != copies * 2").count() == 0
    # salted semi joins keep exactly the rows a plain semi join keeps
    keys = res.groups.select("full_hash", "size", "copies")
    plain = res.files.join(keys.select("full_hash", "size"), ["full_hash", "size"], "left_semi")
    salted = dup.salted_join(res.files, keys, ["full_hash", "size"], "copies", "left_semi", hot_copies=100)
    assert sorted(map(tuple, salted.collect())) == sorted(map(tuple, plain.collect()))
    assert "_salt" not in salted.columns


def test_salts_follow_the_size_of_the_key(spark):
    """A key twice as large gets twice as many salts: the rows that one task
    gets of it stay below the bound."""
    for n in (4_000, 16_000):
        rows = spark.range(n).selectExpr("concat('/d/f', id) as path", "cast(0 as bigint) as size")
        keys = spark.createDataFrame([(0, n)], "size bigint, n bigint")
        joined = dup.salted_join(rows, keys, ["size"], "n", "left_semi", hot_copies=1_000)
        assert joined.count() == n
        # the salts as the join deals them
        salts = rows.selectExpr(f"pmod(xxhash64(path), {n * 2 // 1_000}) as s").groupBy("s").count().collect()
        assert len(salts) == n * 2 // 1_000 and max(r["count"] for r in salts) < 1_000
