"""The registered queries against their SQL, compared as the driver does."""

import pytest
from oracle_check import compare, duck

from tallyfs.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_equals_sql(spark, name):
    res = compare(spark, duck(SF), name, QUERIES[name], ORACLE_SQL[name], SF)
    assert res["cols_match"], res
    assert res["rows_spark"] == res["rows_oracle"] > 0, res
    assert res["hash_match"], res
