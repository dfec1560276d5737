"""Every catalog key against its DuckDB oracle on the driver's smallest tables (the driver's own
gate runs the same pairs at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as E
from compare import duck_rows, spark_rows
from tables_at import SMALL
from ledgerloom.catalog import QUERIES
from ledgerloom.fixtures import BASE_TABLES
from ledgerloom.oracle import oracle_sql

ORACLES = oracle_sql()
KEYS = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    c.execute("SET TimeZone='UTC'")
    return c


def test_every_key_has_an_oracle():
    assert set(KEYS) == set(ORACLES), set(KEYS) ^ set(ORACLES)
    assert set(KEYS) <= set(E.queries()) and set(ORACLES) <= set(E.oracle_sql())


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, con, key):
    s_cols, s_rows = spark_rows(QUERIES[key](spark, SMALL))
    o_cols, o_rows = duck_rows(con, ORACLES[key])
    assert s_cols == o_cols
    assert len(s_rows) == len(o_rows)
    assert s_rows == o_rows


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["date", "daily_total"]
    assert df.count() >= 0
