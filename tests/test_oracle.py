"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from pagemill.plans import crawl_queries, oracle, queries, record_queries, scrape_queries, site_queries, state_queries

ORACLE_SQL = oracle.ORACLE_SQL | crawl_queries.ORACLE_SQL | record_queries.ORACLE_SQL | state_queries.ORACLE_SQL | site_queries.ORACLE_SQL | scrape_queries.ORACLE_SQL
QUERIES = queries.QUERIES | crawl_queries.QUERIES | record_queries.QUERIES | state_queries.QUERIES | site_queries.QUERIES | scrape_queries.QUERIES

DIR = "/root/testdata/sf0.001"
TABLES = "customer orders events documents pages conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    columns = sorted(df.columns)
    got = sorted(repr(tuple(r[c] for c in columns)) for r in df.collect())
    result = duck.execute(ORACLE_SQL[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == columns
    assert got == sorted(repr(tuple(r[names.index(c)] for c in columns)) for r in result.fetchall())


def test_oracle_names_are_queries():
    assert set(ORACLE_SQL) <= set(QUERIES)
