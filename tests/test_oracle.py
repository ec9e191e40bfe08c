"""Every registered query against its DuckDB oracle at sf0.01 (the driver's
correctness gate), and rows-only keys for a stable schema."""

import pytest
from conftest import SF001, SF01
from oracle_compare import compare, duck

from outfold.plans.registry import entries

ENTRIES = entries()
WITH_ORACLE = sorted(k for k, e in ENTRIES.items() if e.oracle)
ROWS_ONLY = sorted(k for k, e in ENTRIES.items() if not e.oracle)


@pytest.fixture(scope="module")
def con():
    return duck(SF01)


@pytest.mark.parametrize("key", WITH_ORACLE)
def test_matches_oracle(spark, con, key):
    r = compare(ENTRIES[key].build(spark, SF01), con, ENTRIES[key].oracle)
    assert r["match"], r


@pytest.mark.parametrize("key", ROWS_ONLY)
def test_rows_only_runs(spark, key):
    df = ENTRIES[key].build(spark, SF001)
    assert df.count() >= 0
    assert df.columns


def test_entry_smoke(spark):
    import __spark_entry__ as se
    df = se.entry(spark)
    rows = df.collect()
    assert len(rows) == 1
    assert round(rows[0]["mae"], 6) == 125761.311616
    assert set(se.oracle_sql()) <= set(se.queries())
