"""Golden vectors and properties of the sequential kernels."""

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

import golden
from tidemark.functions import recursive as r
from tidemark.operators import averages, backtest, hygiene, indicators, joins, labels
from tidemark.plans import scans
from tidemark.plans.ordered import overlapping, row_number, running_sum
from pyspark.sql import functions as F

X = [1, 1, 2, 3, 4, 5, 5, 3, 1]


def frame(spark, values):
    return spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(values)], "symbol string, seq long, x double")


def test_moving_average_and_bands(spark):
    w = indicators.by("symbol", order="seq")
    df = indicators.bands(frame(spark, X), "x", 2, 2.5, w).withColumn("m", indicators.sma(F.col("x"), 2, w)).orderBy("seq").collect()
    assert [v["m"] for v in df] == [None, 1, 1.5, 2.5, 3.5, 4.5, 5, 4, 2]
    assert [v["up"] for v in df] == [None, 1, 2.75, 3.75, 4.75, 5.75, 5, 6.5, 4.5]
    assert [v["down"] for v in df] == [None, 1, 0.25, 1.25, 2.25, 3.25, 5, 1.5, -0.5]


def plain_ema(x, n, alpha=None):
    a, out = 2 / (n + 1) if alpha is None else alpha, [None] * len(x)
    for i in range(n - 1, len(x)):
        out[i] = sum(x[:n]) / n if i == n - 1 else out[i - 1] + a * (x[i] - out[i - 1])
    return out


def test_recursive_averages_across_blocks(spark, monkeypatch):
    """Blocks of seven rows carry over what one long loop gives, for series that are shorter than the average as well."""
    x = np.cumsum(np.random.default_rng(4).normal(size=60)) + 50
    df = frame(spark, x).unionByName(frame(spark, x[:3]).withColumn("symbol", F.lit("b")))
    monkeypatch.setattr(averages.affine, "__defaults__", (7,))
    got = {(v["symbol"], v["seq"]): v for v in averages.ema(df, ["symbol"], "seq", "x", 5).collect()}
    assert [got["a", i]["ema"] for i in range(60)] == [None if v is None else pytest.approx(v) for v in plain_ema(x, 5)]
    assert [got["b", i]["ema"] for i in range(3)] == [None] * 3
    got = {v["seq"]: v for v in averages.rsi(df, ["symbol"], "seq", "x", 4).where("symbol = 'a'").collect()}
    d = np.diff(x)
    u, v = (plain_ema(np.maximum(s * d, 0), 4, 1 / 4) for s in (1, -1))
    assert [got[i + 1]["rsi"] for i in range(59)] == [None if a is None else pytest.approx(100 * a / (a + b)) for a, b in zip(u, v)]


def test_a_null_value_leaves_the_average_as_it_was(spark, monkeypatch):
    x = [1.0, None, 3.0, 5.0, None, None, 4.0, 8.0]
    df = spark.createDataFrame([(None, i, v) for i, v in enumerate(x)], "symbol string, seq long, x double")
    monkeypatch.setattr(averages.affine, "__defaults__", (2,))
    got = [v["ema"] for v in averages.ema(df, ["symbol"], "seq", "x", 2).orderBy("seq").collect()]
    want = plain_ema([v for v in x if v is not None], 2)
    assert got == [None, None, pytest.approx(2.0), *map(pytest.approx, (want[2], want[2], want[2], want[3], want[4]))]


def test_macd_and_rsi_by_hand(spark):
    """The fast average begins where the slow one does, with the mean of the values that end there; nothing moved is 0."""
    got = averages.macd(frame(spark, [1, 2, 4, 8, 16]), ["symbol"], "seq", "x", 2, 4).orderBy("seq").collect()
    slow = 15 / 4
    fast = (4 + 8) / 2
    assert [g["macd"] for g in got] == [None, None, None, pytest.approx(fast - slow), pytest.approx(fast + 2 / 3 * (16 - fast) - (slow + 2 / 5 * (16 - slow)))]
    got = averages.rsi(frame(spark, [5, 5, 5, 6, 5]), ["symbol"], "seq", "x", 2).orderBy("seq").collect()
    assert [g["rsi"] for g in got] == [None, None, 0.0, 100.0, pytest.approx(100 * 0.25 / 0.75)]


def test_golden_fractional_difference(spark):
    got = r.fracdiff(np.array(golden.FRACTIONAL_IN), 0.56, 10)
    assert np.isnan(got[:9]).all() and np.allclose(got[9:], golden.FRACTIONAL_OUT, atol=2e-8)
    df = frame(spark, golden.FRACTIONAL_IN).withColumn("f", indicators.fracdiff(F.col("x"), 0.56, 10, indicators.by("symbol", order="seq"))).orderBy("seq")
    assert np.allclose([v["f"] for v in df.collect()][9:], golden.FRACTIONAL_OUT, atol=2e-8)


def test_golden_supremum(spark):
    x = np.array(golden.SUPREMUM_IN, dtype=float)
    got, _ = r.sadf(x, 15, 12, 3, True, "max")
    assert np.isnan(got[:14]).all() and np.allclose(got[14:], golden.SUPREMUM_OUT, atol=1e-5)
    df = indicators.sadf(frame(spark, x), ["symbol"], "seq", "x", 15, 12, 3, mode="max", block=20).orderBy("seq")
    assert np.allclose([v["sadf"] for v in df.collect()][14:], golden.SUPREMUM_OUT, atol=1e-5)
    single = np.sort([[r.adf(x[i + 1 - w : i + 1], 3, True) for w in (15, 14, 13)] for i in range(14, 150)], axis=1)
    middle, spread = r.sadf(x, 15, 12, 3, True)
    assert np.allclose(middle[14:], single[:, 1]) and np.allclose(spread[14:], 0)  # of three values ranks 2, 2 and 2


@pytest.mark.parametrize("n, ranks", [(8, (5, 6, 6)), (3, (1, 1, 1)), (1, (0, 0, 0)), (100, (84, 91, 98))])
def test_ranks_of_order_statistics(n, ranks):
    assert tuple(r.rank_of(p, n) for p in (0.85, 0.92, 0.99)) == ranks


def test_supremum_of_hundreds_of_widths():
    """Sums of products give what single regressions give, for long windows, over a level far from 0 and a stretch that is flat."""
    x = 5e4 + 40 * np.cumsum(np.random.default_rng(5).normal(size=700))
    x[300:340] = x[300]
    for order, trend in ((2, True), (1, False)):
        moments = r.Moments(x, order, trend)
        for w in (20, 150, 320):
            want, got = r.adf_windows(x, w, order, trend), moments.statistics(w)
            varied = np.array([(np.diff(x[i : i + w]) != 0).sum() >= w // 2 for i in range(len(want))])
            assert np.allclose(got[varied], want[varied], rtol=1e-8, atol=1e-8) and varied.sum() > 350


def test_golden_sums(spark, monkeypatch):
    x, valid = np.array(golden.SUMS_IN), np.ones(136)
    valid[55:95] = 0
    want = [0 if v != v else int(v) for v in golden.SUMS_OUT]
    assert r.cusum(x, 1.5, valid > 0).tolist() == want
    monkeypatch.setattr(scans, "BLOCK", 9)
    monkeypatch.setattr(scans, "WARM", 3)
    df = spark.createDataFrame([("a", i, float(v), float(o)) for i, (v, o) in enumerate(zip(x, valid))], "symbol string, seq long, x double, ok double")
    assert [v["event"] for v in indicators.cusum(df, ["symbol"], "seq", "x", 1.5, "ok").orderBy("seq").collect()] == want


@pytest.mark.parametrize("h", [0.5, 3.0, 200.0])
def test_sums_in_blocks_are_the_whole_series(spark, monkeypatch, h):
    """Blocks of ten rows, of several series and a null one, with missing values; the largest bound is never passed, so that the sums
    of the first block reach the last."""
    monkeypatch.setattr(scans, "BLOCK", 10)
    monkeypatch.setattr(scans, "WARM", 2)
    g = np.random.default_rng(11)
    x = {s: np.where(g.random(n) < 0.05, np.nan, np.cumsum(g.normal(size=n))) for s, n in (("a", 95), (None, 40), ("c", 1))}
    df = spark.createDataFrame([(s, i, None if np.isnan(v) else float(v)) for s, vs in x.items() for i, v in enumerate(vs)], "symbol string, seq long, x double")
    got = {(v["symbol"], v["seq"]): v["event"] for v in indicators.cusum(df, ["symbol"], "seq", "x", h).collect()}
    assert got == {(s, i): e for s, vs in x.items() for i, e in enumerate(r.cusum(vs, h).tolist())}


@pytest.mark.parametrize("limit", [0, 3, 40, 10_000])
def test_sessions_by_doubling(spark, limit):
    g = np.random.default_rng(3)
    x = {s: np.cumsum(g.integers(0, 6, n)) for s, n in (("a", 300), (None, 50), ("c", 1))}
    df = spark.createDataFrame([(s, i + 1, int(v)) for s, vs in x.items() for i, v in enumerate(vs)], "symbol string, k long, t long")
    got = {(v["symbol"], v["k"]): v["since"] for v in indicators.since_start(df, ["symbol"], "k", "t", limit).collect()}
    assert got == {(s, i + 1): v for s, vs in x.items() for i, v in enumerate(r.since_start(vs.astype(float), limit).tolist())}


def test_quantiles_of_ties_and_nulls(spark):
    from tidemark.operators import features, stats

    g = np.random.default_rng(8)
    x = {"a": g.integers(0, 5, 301) / 2, None: g.normal(size=100), "c": np.array([7.0]), "d": np.array([])}
    df = spark.createDataFrame([(s, float(v)) for s, vs in x.items() for v in vs] + [("a", None), ("d", None)], "symbol string, x double").repartition(5)
    points = {"q0": 0.0, "q1": 0.1, "q5": 0.5, "q9": 0.93, "q10": 1.0}
    got = {v["symbol"]: [v[p] for p in points] for v in stats.quantiles(df, ["symbol"], "x", points).collect()}
    assert got == {s: [pytest.approx(np.quantile(vs, p)) if len(vs) else None for p in points.values()] for s, vs in x.items()}
    assert [tuple(v) for v in stats.quantiles(df, [], "x", {"m": 0.5}).collect()] == [(pytest.approx(np.median(np.concatenate([*x.values()]))),)]
    z = features.normal_score(df, "x", ["symbol"], "z").where("symbol = 'a' AND x IS NOT NULL").groupBy("x").agg(F.min("z"), F.max("z")).orderBy("x").collect()
    assert len(z) == 5 and all(v[1] == v[2] for v in z) and [v[1] for v in z] == sorted(v[1] for v in z)


def test_mama_follows_a_price():
    x = 100 + 10 * np.sin(np.arange(300) / 4)
    m, f = r.mama(x, 0.5, 0.05)
    assert np.isnan(m[:32]).all() and not np.isnan(m[32:]).any() and m[32:].min() > 85 and m[32:].max() < 115
    flat, _ = r.mama(np.full(80, 7.0), 0.5, 0.05)
    assert np.allclose(flat[32:], 7)


def test_adf_windows_are_single_regressions():
    x = np.cumsum(np.random.default_rng(7).normal(size=60))
    got = r.adf_windows(x, 20, 2, True)
    for i in (0, 13, 40):
        y = x[i : i + 20]
        d = np.diff(y)
        a = np.column_stack([y[2:-1], np.ones(17), np.arange(17), d[1:-1], d[:-2]])
        b, rss, *_ = np.linalg.lstsq(a, d[2:], rcond=None)
        assert got[i] == pytest.approx(b[0] / np.sqrt(np.linalg.inv(a.T @ a)[0, 0] * rss[0] / 12))
    flat, _ = r.sadf(np.concatenate([np.zeros(30), x]), 24, 16, 2, True)
    assert len(flat) == 90 and np.isnan(flat[:23]).all()


def test_fracdiff_expression_is_the_convolution(spark):
    w = indicators.by("symbol", order="seq")
    x = np.cumsum(np.random.default_rng(1).normal(size=60)) + 10
    got = [v["f"] for v in frame(spark, x).withColumn("f", indicators.fracdiff(F.col("x"), 0.56, 10, w)).orderBy("seq").collect()]
    want = r.fracdiff(x, 0.56, 10)
    assert got[:9] == [None] * 9 and np.allclose(got[9:], want[9:])


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=2, max_size=40))
def test_cusum_sums_stay_within_the_bound(xs):
    events = r.cusum(np.array(xs), 3.0)
    assert set(events.tolist()) <= {-1, 0, 1} and events[0] == 0


def test_cusum_mask_resets():
    x = np.array([0.0, 1, 2, 3, 4, 5])
    assert r.cusum(x, 2.5).tolist() == [0, 0, 0, 1, 0, 0]
    assert r.cusum(x, 2.5, np.array([1, 1, 0, 1, 1, 1]) > 0).tolist() == [0, 0, 0, 0, 0, 0]


def test_adf_is_negative_for_a_mean_reverting_series():
    g = np.random.default_rng(2)
    y = [0.0]
    for _ in range(300):
        y.append(0.2 * y[-1] + g.normal())
    assert r.adf(np.array(y), 2, True) < -5
    assert np.isnan(r.adf(np.ones(30), 1, False))


def test_blocks_equal_the_whole_series(spark):
    x = np.cumsum(np.random.default_rng(3).normal(size=90))
    df = frame(spark, x)
    whole = indicators.sadf(df, ["symbol"], "seq", "x", 20, 14, 1, block=1000).orderBy("seq").collect()
    cut = indicators.sadf(df, ["symbol"], "seq", "x", 20, 14, 1, block=17).orderBy("seq").collect()
    a, b = (np.array([[v["sadf"], v["spread"]] for v in rows], dtype=float) for rows in (whole, cut))
    assert np.allclose(a, b, rtol=1e-9, atol=1e-9, equal_nan=True) and len(cut) == 90  # sums of products start anew in each block


def test_running_sum_by_chunks(spark):
    df = spark.createDataFrame([("a", i, i % 7) for i in range(100)], "symbol string, seq long, v long")
    got = running_sum(df, F.col("v"), "s", ["symbol"], ["seq"], F.floor(F.col("seq") / 9)).orderBy("seq").collect()
    assert [g["s"] for g in got] == np.cumsum([i % 7 for i in range(100)]).tolist()
    n = row_number(df, "n", ["symbol"], ["seq"], F.floor(F.col("seq") / 9))
    assert overlapping(n, "n", 10, 3).where("NOT warmup").count() == 100


def test_null_keys_and_times_stay(spark):
    rows = [(None, 1, 1), (None, 2, 2), ("a", None, 4), ("a", 1, 8), ("a", 20, 16)]
    df = spark.createDataFrame(rows, "symbol string, seq long, v long")
    got = {(x["symbol"], x["seq"]): x["s"] for x in running_sum(df, F.col("v"), "s", ["symbol"], ["seq"], F.floor(F.col("seq") / 9)).collect()}
    assert got == {(None, 1): 1, (None, 2): 3, ("a", None): 4, ("a", 1): 12, ("a", 20): 28}
    left = df.select("symbol", "seq", F.col("v").alias("id"))
    right = spark.createDataFrame([(None, 1, 5.0), ("a", 1, 6.0), ("a", None, 7.0)], "symbol string, seq long, x double")
    for forward, want in ((False, {1: 5.0, 2: 5.0, 4: 7.0, 8: 6.0, 16: 6.0}), (True, {1: 5.0, 2: None, 4: 7.0, 8: 6.0, 16: None})):
        for chunk in (None, F.floor(F.col("seq") / 9)):
            assert {x["id"]: x["x"] for x in joins.as_of(left, right, "seq", ["x"], ["symbol"], forward, chunk).collect()} == want


def test_as_of_both_ways(spark):
    a = spark.createDataFrame([("s", 5, 1), ("s", 1, 2), ("t", 5, 3)], "k string, t long, id long")
    b = spark.createDataFrame([("s", 3, 30.0), ("s", 5, 50.0), ("s", 9, 90.0)], "k string, t long, v double")
    back = {x["id"]: x["v"] for x in joins.as_of(a, b, "t", ["v"], ["k"]).collect()}
    ahead = {x["id"]: x["v"] for x in joins.as_of(a, b, "t", ["v"], ["k"], forward=True).collect()}
    assert back == {1: 50.0, 2: None, 3: None} and ahead == {1: 50.0, 2: 30.0, 3: None}


def test_fill_and_flag(spark):
    t = spark.createDataFrame([("a", 0, 0.0, 2.0, 2.0), ("a", 1, 1.0, 0.0, 1.0), ("a", 2, 0.0, 0.0, 0.0)], "symbol string, seq long, bid double, ask double, last double")
    got = hygiene.aggressor(hygiene.fill_quotes(t)).orderBy("seq").collect()
    assert [(g["bid"], g["ask"], g["last"], g["flag"]) for g in got] == [(0.0, 2.0, 2.0, 1), (1.0, 2.0, 1.0, -1), (1.0, 2.0, 1.0, -1)]


def test_simulator_accounts_for_both_sides():
    a = backtest.Account(1000.0, 1.0, 0.0)
    a.trade(3, 10.0)
    a.trade(-6, 12.0)
    assert a.money == 1006.0 and a.position == -3 and a.entry == 12.0
    a.trade(3, 11.0)
    assert a.money == 1009.0 and a.position == 0


def test_stop_fills_on_the_next_tick():
    a = backtest.Account(1000.0, 1.0, 0.0)
    a.send(backtest.Order(backtest.BUY, 1, stop=9.0))
    for p in (10.0, 8.5, 8.0):
        a.step(p)
    assert a.position == 0 and a.money == 998.0


def test_triple_barrier_by_hand(spark):
    bars = spark.createDataFrame([("a", i, p, p, p, 0, p, 0.05) for i, p in enumerate([100.0, 101.0, 102.0, 106.0, 90.0, 90.0])], "symbol string, uid long, open double, high double, low double, highfirst int, wprice double, sigma double")
    ev = spark.createDataFrame([("a", 0), ("a", 3)], "symbol string, twhen long")
    got = sorted((r["twhen"], r["vertbar"], r["side"], r["tdone"]) for r in labels.triple_barrier(ev, bars, 1.0, 1, 1, 4).collect())
    assert got == [(0, 1, 1, 1), (0, 2, 1, 2), (0, 3, 1, 3), (3, 1, -1, 4)]


def test_mama_in_parts_is_that_of_the_whole():
    x = np.random.default_rng(2).normal(100, 5, 300)
    whole, parts = r.mama(x, 0.5, 0.05), r.Mama(0.5, 0.05)
    found = [parts.run(p) for p in np.split(x, [1, 2, 5, 31, 40, 40, 217])]
    for k in range(2):
        assert np.array_equal(np.concatenate([f[k] for f in found]), whole[k], equal_nan=True)


def test_mama_holds_a_batch_of_a_series(spark):
    from tidemark.operators import averages

    x = np.random.default_rng(3).normal(100, 5, 90)
    rows = [(s, i, float(v)) for s, n in (("a", 90), (None, 50), ("b", 3)) for i, v in enumerate(x[:n])]
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, 7)
    try:
        df = averages.mama(spark.createDataFrame(rows, "symbol string, seq long, last double"), ["symbol"], "seq", "last")
        assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()
        got = {(v["symbol"], v["seq"]): (v["mama"], v["fama"]) for v in df.collect()}
    finally:
        spark.conf.set(limit, before)
    m, f = r.mama(x, 0.5, 0.05)
    assert got == {(s, i): (m[i], f[i]) if i >= 32 else (None, None) for s, i, _ in rows}
