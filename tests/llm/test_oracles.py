"""The corpus queries that SQL can express, against DuckDB."""

import pytest
from oracle_compare import compare, duck

from outfold.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


@pytest.mark.parametrize("key", ORACLES)
def test_matches_sql(spark, key):
    r = compare(QUERIES[key](spark, SF), duck(SF), ORACLES[key])
    assert r["match"], r
