"""Every registered query against its DuckDB oracle (sf0.001), and the
rows-only queries for a non-failing run; plus the entry smoke check."""

import pytest

import __spark_entry__ as E
from tools.oracle_check import compare, duck

KEYS = sorted(E.queries())


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, sf, key):
    status, rows, _t, problems, *_ = compare(spark, con, key, sf)
    assert status in ("OK", "rows-only"), problems


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and len(df.schema.fields) > 0
