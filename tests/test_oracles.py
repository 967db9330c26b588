"""Every registered query against its DuckDB oracle (the driver's correctness gate)."""

import pytest

from __spark_entry__ import oracle_sql
from oracle_check import compare, duck

from gridlake.plans.catalog import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, sf_dir, name):
    r = compare(spark, con, name, QUERIES[name], oracle_sql().get(name), sf_dir)
    assert r["status"] in ("match", "rows-only"), r


def test_every_query_has_an_oracle():
    assert set(QUERIES) <= set(oracle_sql())


def test_entry_runs(spark):
    from __spark_entry__ import entry

    df = entry(spark)
    assert df.columns == ["sheet", "row", "col", "value"]
    assert df.count() >= 0
