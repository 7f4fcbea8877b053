"""Every query with an oracle equals its DuckDB SQL on the sf0.001 tables;
every other query runs and keeps its schema."""

import pytest

import __spark_entry__ as E
from joblake.plans.oracle import compare, duck_connection

from conftest import SMALL

ORACLE = E.oracle_sql()
QUERIES = E.queries()
ROWS_ONLY = sorted(set(QUERIES) - set(ORACLE))


@pytest.fixture(scope="module")
def con():
    return duck_connection(SMALL)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_oracle(spark, con, name):
    res = compare(QUERIES[name](spark, SMALL), con, ORACLE[name])
    assert res["ok"], res


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only_runs(spark, name):
    df = QUERIES[name](spark, SMALL)
    schema = df.schema.simpleString()
    assert df.count() >= 0
    assert df.schema.simpleString() == schema


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert {"kind", "id", "name", "raw_count", "improvement_priority"} <= set(df.columns)
