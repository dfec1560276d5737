"""The corpus queries against their DuckDB SQL on the smallest tables; those without SQL run and give whole results."""

import duckdb
import pytest

import __spark_entry__ as E
from compare import duck_rows, spark_rows
from tables_at import SMALL
from ledgerloom.llm.oracle import ORACLE_SQL
from ledgerloom.llm.queries import QUERIES

TABLES = ("documents", "embeddings", "pages", "benchmark", "labels", "conversations")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def test_registered():
    assert set(QUERIES) <= set(E.queries()) and set(ORACLE_SQL) <= set(E.oracle_sql())
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)} | {"pipeline"}


@pytest.mark.parametrize("key", sorted(ORACLE_SQL))
def test_query_matches_oracle(spark, con, key):
    assert spark_rows(QUERIES[key](spark, SMALL)) == duck_rows(con, ORACLE_SQL[key])


@pytest.mark.parametrize("key, table, column", [("op3_token_counts", "documents", "doc_id"), ("op5_url_filter", "pages", "page_id"),
                                                ("op8_sharding", "documents", "doc_id"), ("op9_language_id", "documents", "doc_id")])
def test_one_row_each(spark, con, key, table, column):
    ids = sorted(r[0] for r in QUERIES[key](spark, SMALL).select(column).collect())
    assert ids == [r[0] for r in con.execute(f"SELECT {column} FROM {table} ORDER BY 1").fetchall()]
