"""Every query of the time-series operators against its SQL on DuckDB."""

import math
import os

import duckdb
import pytest

from tidemark.plans import market_queries, more_queries, rest_queries  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL

DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DIR):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{DIR}/{f}')")
    return c


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])

    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else v

    return sorted(([plain(r[i]) for i in order] for r in table), key=str)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DIR)
    found = [tuple(r) for r in df.collect()]
    if name in SQL:
        want = duck.execute(SQL[name])
        names = [c[0] for c in want.description]
        assert sorted(names) == sorted(df.columns)
        got, expected = rows(df.columns, found), rows(names, want.fetchall())
        assert len(got) == len(expected)
        for a, b in zip(got, expected):
            assert a == pytest.approx(b, abs=2e-5) if all(isinstance(x, float) for x in a) else [pytest.approx(x, abs=2e-5) if isinstance(x, float) else x for x in b] == a
