"""Every query with a SQL oracle must match DuckDB on the same parquet tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from chartwise.sources.tables import TABLES

from folders import SF_SMALL

ORACLES = entry.oracle_sql()
QUERIES = entry.queries()


def canon(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if hasattr(v, "item"):
        return canon(v.item())
    if hasattr(v, "as_integer_ratio") and not isinstance(v, int):
        return round(float(v), 9)
    return v


def rows(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr)


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_is_registered_with_a_callable():
    assert set(ORACLES) <= set(QUERIES)
    assert len(QUERIES) >= 80


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_oracle(spark, con, name):
    df = QUERIES[name](spark, SF_SMALL)
    s_cols, s_rows = df.columns, [tuple(r) for r in df.collect()]
    res = con.execute(ORACLES[name])
    o_cols = [d[0] for d in res.description]
    o_rows = res.fetchall()
    assert sorted(s_cols) == sorted(o_cols)
    assert rows(s_cols, s_rows) == rows(o_cols, o_rows)
