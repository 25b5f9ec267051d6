"""Physical-plan properties the design relies on at scale."""

from table_dirs import SF001
from tallyfs.operators import aggregates as agg
from tallyfs.operators import duplicates as dup
from tallyfs.plans.corpus import corpus_inventory
from tallyfs.plans.materialize import materialize


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(p: str) -> list[str]:
    return [line for line in p.splitlines() if "Exchange" in line]


def test_aggregates_are_partial_before_the_shuffle(spark):
    p = plan(agg.category_sizes(corpus_inventory(spark, SF001, with_folders=False)))
    assert "partial_sum" in p and "partial_count" in p
    # one per extension, then one per category over those few rows
    assert len([x for x in exchanges(p) if "hashpartitioning" in x]) == 2


def test_scan_reads_only_needed_columns(spark):
    inv = materialize(spark, corpus_inventory(spark, SF001).drop("content"), "plan-inv")
    assert "TakeOrderedAndProject" in plan(agg.top_extensions(inv))
    text = plan(agg.extension_counts(inv))
    assert "PushedFilters: [IsNotNull(kind), EqualTo(kind,file)]" in text
    assert "ReadSchema: struct<kind:string,extension:string>" in text


def test_content_never_crosses_an_exchange(spark):
    inv = corpus_inventory(spark, SF001, with_folders=False)
    res = dup.find_duplicates(inv, materialize_stages=False)
    for df in (res.hashed, res.groups, res.files):
        for line in exchanges(plan(df)):
            assert "content" not in line and "text" not in line, line
    # the hashing pass itself has no exchange at all: one scan, hashes computed in place
    assert exchanges(plan(dup.ColumnReader().hash_rows(dup.eligible_files(inv)))) == []


def test_largest_files_is_bounded_top_k(spark):
    p = plan(agg.largest_files(corpus_inventory(spark, SF001, with_folders=False)))
    assert "TakeOrderedAndProject(limit=5" in p
    assert "Sort " not in p.replace("TakeOrderedAndProject", "")
