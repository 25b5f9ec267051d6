"""The driver's correctness gate, run locally: every registered query against
its DuckDB SQL at sf0.01 (row count, column names, value hash)."""

import pytest

import __spark_entry__ as E
from table_dirs import SF01
from oracle_check import compare, duck
from tallyfs.plans.catalog import QUERIES

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("name", sorted(k for k in E.queries() if k in QUERIES))  # optional ones have their own tests
def test_query_matches_oracle(spark, con, name):
    q = E.queries()[name]
    if name not in SQL:
        assert q(spark, SF01).count() >= 0
        return
    r = compare(spark, con, name, q, SQL[name], SF01)
    assert r["cols_match"], r
    assert r["rows_spark"] == r["rows_oracle"], r
    assert r["hash_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["section", "key", "value", "size_text"]
    assert df.count() > 0
