"""Every deterministic registered query against its DuckDB twin (order-insensitive, exact)."""

import hashlib

import duckdb
import pytest

import __spark_entry__ as entry
from library_support import SF_SMALL
from mixshard.plans.oracle import SQL
from mixshard.plans.oracle_draws import SQL as DRAWS

TABLES = "part lineitem embeddings".split()


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join("NULL" if r[i] is None else repr(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_sql_or_is_random():
    from mixshard.plans.catalog import DETERMINISTIC, RANDOM

    q, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(q)
    assert {k for k in q if k not in sql and k in {**DETERMINISTIC, **RANDOM}} == set(RANDOM)


@pytest.mark.parametrize("name", sorted(SQL | DRAWS))
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    srows = [tuple(r) for r in df.collect()]
    rel = con.sql(entry.oracle_sql()[name])
    orows = rel.fetchall()
    assert sorted(df.columns) == sorted(rel.columns)
    assert len(srows) == len(orows)
    assert _digest(srows, df.columns) == _digest(orows, rel.columns)
