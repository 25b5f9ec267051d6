"""FIXTURES.md numbers for the corpus inventory, and invariants between
operators (sections must agree with each other)."""

import pytest
from pyspark.sql import functions as F

from table_dirs import SF001, SF01
from tallyfs.operators import aggregates as agg
from tallyfs.operators import duplicates as dup
from tallyfs.plans.corpus import corpus_inventory

EXPECTED = {
    SF001: dict(files=200, bytes=495892, folders=136, eligible=131, sizes2=16, cand_ref=19,
                cand_elig=13, groups=5, dup_files=11, dup_bytes=19864, wasted=12025, largest=19535,
                exts=16),
    SF01: dict(files=1000, bytes=2472458, folders=180, eligible=656, sizes2=144, cand_ref=208,
               cand_elig=149, groups=30, dup_files=62, dup_bytes=120159, wasted=60806, largest=33047,
               exts=18),
}


@pytest.fixture(scope="module", params=[SF001, SF01])
def corpus(request, spark):
    return request.param, corpus_inventory(spark, request.param)


def test_totals(corpus):
    sf, inv = corpus
    e = EXPECTED[sf]
    s = agg.scan_summary(inv).first()
    assert (s["files"], s["bytes"], s["folders"], s["skipped"]) == (e["files"], e["bytes"], e["folders"], 0)
    assert agg.extension_counts(inv).count() == e["exts"]
    assert agg.largest_file(inv).first()["size"] == e["largest"]


def test_funnel_numbers(corpus):
    sf, inv = corpus
    e = EXPECTED[sf]
    assert dup.eligible_files(inv).count() == e["eligible"]
    assert dup.size_groups(inv).count() == e["sizes2"]
    assert dup.candidates(inv).count() == e["cand_ref"]
    res = dup.find_duplicates(inv)
    assert res.hashed.count() == e["cand_elig"]
    assert res.survivors.count() == e["dup_files"]
    s = dup.duplicate_summary(res.groups).first()
    assert (s["groups"], s["duplicate_files"], s["duplicate_bytes"], s["wasted_bytes"]) == \
        (e["groups"], e["dup_files"], e["dup_bytes"], e["wasted"])


def test_invariants(corpus):
    sf, inv = corpus
    s = agg.scan_summary(inv).first()
    cat = agg.category_sizes(inv).agg(F.sum("bytes"), F.sum("n")).first()
    assert (cat[0], cat[1]) == (s["bytes"], s["files"])
    assert agg.extension_counts(inv).agg(F.sum("n")).first()[0] == s["files"]
    res = dup.find_duplicates(inv)
    summ = dup.duplicate_summary(res.groups).first()
    assert dup.reclaimable_files(res).agg(F.sum("size")).first()[0] == summ["wasted_bytes"]
    one_each = res.groups.agg(F.sum("size")).first()[0]
    assert summ["duplicate_bytes"] - summ["wasted_bytes"] == one_each
    tiers = dup.funnel_stats(inv, res).orderBy("tier").collect()
    for t in tiers:
        assert t["files_out"] <= t["files_in"]
    for a, b in zip(tiers, tiers[1:]):
        assert a["files_out"] == b["files_in"]


def test_funnel_equals_direct_grouping(corpus):
    """The funnel finds exactly the groups a direct group-by over full hashes finds."""
    sf, inv = corpus
    res = dup.find_duplicates(inv)
    direct = (dup.eligible_files(inv)
              .groupBy(F.sha2("content", 256).alias("full_hash"), "size")
              .agg(F.count(F.lit(1)).alias("copies")).filter("copies >= 2"))
    assert sorted(map(tuple, res.groups.collect())) == sorted(map(tuple, direct.select("full_hash", "size", "copies").collect()))


def test_sort_merge_plans_give_same_groups(spark):
    """With broadcasts switched off every semi join shuffles narrow rows
    (sort-merge): same groups."""
    inv = corpus_inventory(spark, SF01)
    want = sorted(map(tuple, dup.find_duplicates(inv).groups.collect()))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = sorted(map(tuple, dup.find_duplicates(inv).groups.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert got == want


def test_prehashed_inventory_gives_same_groups(spark):
    inv = corpus_inventory(spark, SF01)
    want = sorted(map(tuple, dup.find_duplicates(inv).groups.collect()))
    pre = dup.hash_annotate(inv)
    got = sorted(map(tuple, dup.find_duplicates(pre).groups.collect()))
    assert got == want


def test_custom_category_dimension(spark):
    """A caller's own (extension, category) table replaces the fixed one;
    unknown extensions are Others, empty ones No extension; small dimensions
    are broadcast, larger ones joined with a shuffle — same result."""
    inv = corpus_inventory(spark, SF001, with_folders=False)
    dim = spark.createDataFrame([("txt", "Text"), ("py", "Code"), ("java", "Code")], "extension string, category string")
    got = {r["category"]: r["n"] for r in agg.category_sizes(inv, dim).collect()}
    counts = {r["extension"]: r["n"] for r in agg.extension_counts(inv).collect()}
    assert got["Text"] == counts["txt"]
    assert got["Code"] == counts["py"] + counts["java"]
    assert got["No extension"] == counts["No extension"]
    assert sum(got.values()) == 200
    shuffled = agg.with_category(agg.files_only(inv), dim, broadcast_limit=0)
    again = {r["category"]: r["n"] for r in shuffled.groupBy("category").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert again == got
