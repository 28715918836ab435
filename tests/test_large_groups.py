"""Work that must not grow with the square of a group, and values beyond the finite ones."""

import pytest
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.functions import recursive
from tidemark.operators import backtest, indicators, joins, labels
from tidemark.plans import market_queries, more_queries, rest_queries  # noqa: F401
from tidemark.plans.registry import QUERIES, SQL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().lower()


def test_forward_frames_do_not_end_with_the_partition(spark):
    t = spark.createDataFrame([("a", "d", k, 1000 * k, 5.0 * (k % 7), k % 3 - 1) for k in range(40)], "symbol string, day string, seq long, time_msc long, last double, signal int")
    t = t.withColumns({"high": F.col("last"), "low": F.col("last")})
    chunked = joins.as_of(t.select("symbol", "time_msc", "seq"), t.select("symbol", "time_msc", F.col("seq").alias("v")), "time_msc", ["v"], ["symbol"], forward=True, chunk=F.floor(F.col("time_msc") / 9000))
    for df in (backtest.expired(t, t, 3000), chunked, labels.with_stops(t, 1.0, 10.0, 20.0), labels.both_sides(t, 100.0, 10.0, 20.0)):
        for frame in ("currentrow$(), unboundedfollowing$()", "1, unboundedfollowing$()"):
            assert frame not in plan(df)


def test_forward_ties_and_nulls(spark):
    left = spark.createDataFrame([("a", 1, 0), ("a", 5, 1), ("a", 9, 2), ("a", None, 3), (None, 2, 4)], "k string, at long, id long")
    right = spark.createDataFrame([("a", 5, 7), ("a", 5, 3), ("a", 8, 1), (None, 4, 9)], "k string, at long, v long")
    for chunk in (None, F.floor(F.col("at") / 4)):
        found = {r["id"]: r["v"] for r in joins.as_of(left, right, "at", ["v"], ["k"], forward=True, chunk=chunk).collect()}
        assert found == {0: 3, 1: 3, 2: None, 3: 3, 4: 9}


def test_session_starts_of_a_long_dense_series(spark):
    rows = [(s, k + 1, (k * k * 7 + s * 13) % 5 + 3 * k) for s in range(2) for k in range(600)]
    rows = [(s, k, x) for s in range(2) for k, x in enumerate(sorted(r[2] for r in rows if r[0] == s), 1)]
    want = {}
    for s, k, x in rows:
        begun = x if k == 1 or x - begun > 40 else begun
        want[s, k] = x - begun
    df = spark.createDataFrame(rows, "s long, k long, x long")
    assert {(r["s"], r["k"]): r["since"] for r in indicators.since_start(df, ["s"], "k", "x", 40).collect()} == want


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """Ticks with prices of 0 and beyond 500, several in a millisecond, and moves of just the filter's limits."""
    c = duckdb.connect()
    d = tmp_path_factory.mktemp("odd")
    (d / "events.parquet").mkdir()
    for part in range(4):  # each file spans all days
        c.execute(f"""COPY (SELECT n AS event_id, TIMESTAMP '2024-01-01' + to_microseconds(n // 3 * 600_000_000) AS ts, n % 15 AS user_id, CASE WHEN n % 4 < 2 THEN 'view' ELSE 'click' END AS event_type,
          CASE WHEN n IN (700, 702, 1501, 1503) OR n % 399 = 0 THEN 0.0 WHEN n % 500 = 0 THEN 501.5 ELSE (n * 7919 % 2003) / 10.0 + n % 7 * 0.01 END AS value, '{{"k": ' || (n % 90 + 10) || '}}' AS props FROM range(3000) r(n) WHERE n % 4 = {part}) TO '{d}/events.parquet/{part}.parquet'""")
    c.execute(f"CREATE VIEW events AS SELECT * FROM '{d}/events.parquet/*.parquet' ORDER BY event_id")
    return str(d), c


@pytest.mark.parametrize("name", ["a1_packed_ticks", "b10_replace_matched", "d2_first_bar_from", "e9_fracdiff", "e9_long_fracdiff", "e10_bar_return", "e11_volatility", "e17_cusum", "e18_masked_cusum", "e19_differences", "f7_cusum_events", "f12_terciles", "g5_buy_labels", "g6_sell_labels", "g7_merged_sides", "g8_both_sides", "i3_inner_by_number", "j8_scores", "m1_scalars", "o11_expiry", "p4_late_ticks"])
def test_odd_prices_against_sql(spark, odd, name, monkeypatch):
    monkeypatch.setattr(more_queries, "FILE", 400)
    d, c = odd
    df = QUERIES[name](spark, d)
    cols = sorted(df.columns)
    plain = lambda rows: Counter(tuple(None if v is None else str(v) if isinstance(v, str) else "nan" if v != v else round(float(v), 5) + 0.0 for v in r) for r in rows)
    want = plain(c.execute(f"SELECT {', '.join(cols)} FROM ({SQL[name]})").fetchall())
    got = plain(map(tuple, df.select(*cols).collect()))
    assert got == want, (len(got - want), list((got - want).items())[:3], list((want - got).items())[:3])


def test_filter_adds_in_the_order_of_its_sql():
    """0.1 + 0.3 - 0.1 is more than 0.3, 0.1 + (0.3 - 0.1) is not."""
    assert recursive.cusum(np.array([0.0, 0.1, 0.3]), 0.3).tolist() == [0, 0, 1]


def test_simulators_go_on_where_a_batch_ends(spark):
    """Batches of seven rows, a null symbol, and no group that a task holds whole."""
    t = spark.createDataFrame([(s, k, float((k * 37 + ord((s or "z")[0])) % 101)) for s in ("a", "b", None) for k in range(60)], "symbol string, seq long, last double")
    grid = spark.createDataFrame([(i, f, 9, 0, 2**40) for i, f in enumerate((3, 5))], "scenario long, fast int, slow int, lo long, hi long")
    found = []
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        one, all_ = backtest.simulate(t, backtest.cross_strategy(3, 9), 1000.0, 0.2, 1.0), backtest.sweep(t, grid, 1000.0, 0.2, 1.0)
        assert "flatmapgroups" not in plan(one) + plan(all_)
        found.append((sorted(map(str, one.collect())), sorted(map(str, all_.collect()))))
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found[0] == found[1] and len(found[0][0]) == 180 and len(found[0][1]) == 6
