"""The correctness gate: every registered query against its DuckDB oracle (sf0.01)."""

import os

import pytest

import __spark_entry__ as E
from tests.oracle import compare, duck

SF = os.environ.get("MARKHIVE_ORACLE_SF", "/root/testdata/sf0.01")
NAMES = sorted(E.oracle_sql())


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_oracle():
    # the training-data operators that SQL can't express have brute-force tests of their own
    assert set(E.queries()) - set(E.oracle_sql()) <= set(E._LLM_QUERIES)
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    r = compare(spark, name, SF, con)
    assert r["spark_rows"] == r["oracle_rows"], r
    assert r["columns_match"], r
    assert r["values_match"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["link_id", "file_id", "folder", "url", "title", "key_url", "key_title"]
