"""Queries without SQL take every row and symbol: against plain loops."""

import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import backtest
from tidemark.plans import market_queries, more_queries, rest_queries
from tidemark.plans.registry import QUERIES
from tidemark.sources import market

DIR = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")


@pytest.fixture(scope="module")
def series(spark):
    """Deals of each symbol in the order of k."""
    n = market_queries._numbered(spark, DIR).select("symbol", "k", "seq", "last").toPandas()
    return {s: g.sort_values("k") for s, g in n.groupby("symbol")}


def stump(train, test):
    """The side of the mean return that was right more often in training, row by row."""
    up = train["r"] > train["r"].mean()
    follow = (up == (train["y"] == 1)).mean() >= 0.5
    return float(((test["r"] > train["r"].mean()) == (test["y"] == 1)).eq(follow).mean())


def found(spark, name, *columns):
    return [tuple(r) for r in QUERIES[name](spark, DIR).select(*columns).collect()]


def test_cash_replay_takes_every_row(spark, series):
    want = []
    for s, g in series.items():
        price, cash, taken = dict(zip(g["k"], g["last"])), 600.0, set()
        for k in range(1, max(price) + 41):
            if k - 40 in taken:  # sells sort before buys
                cash += price[k - 40] * 1.01
            if k in price:
                ok = price[k] <= cash
                want.append((s, k, int(ok)))
                if ok:
                    cash -= price[k]
                    taken.add(k)
    assert sorted(found(spark, "o8_cash_replay", "symbol", "order_id", "accepted")) == sorted(want)


def test_minute_simulator_takes_every_bar(spark):
    h = more_queries._hours(spark, DIR).withColumns({"day": F.to_date("time"), "k": F.hour("time")}).toPandas().sort_values("k")
    want = []
    for (s, day), g in h.groupby(["symbol", "day"]):
        side, n, last = 0, 0, g["k"].max()
        for b in g.itertuples():
            if side:
                r = side * ((b.low if side > 0 else b.high) / entry - 1)
                if r >= 0.2 or r <= -0.3 or b.k - at >= 6 or b.k == last:
                    want.append((s, str(day), at, b.k))
                    side = 0
            elif n < 3 and b.k != last:
                side, at, n = 1 if b.close > b.open else -1, b.k, n + 1
                entry = b.high if side > 0 else b.low
    got = [(s, str(d)[:10], a, b) for s, d, a, b in found(spark, "o6_minute_simulator", "symbol", "day", "opened", "shut")]
    assert sorted(got) == sorted(want) and {a % 5 for _, _, a, _ in got} == set(range(5))


def test_folds_of_every_symbol(spark, series):
    whole = [(s, f, p, n) for s, g in series.items() for f in range((g["k"].max() - 800) // 500 + 1) for p, n in (("train", 570), ("valid", 190), ("predict", 40))]
    assert len(series) > 1 and sorted(found(spark, "n2_split", "symbol", "fold", "part", "n")) == sorted(whole)
    rows = rest_queries._model_rows(spark, DIR).toPandas()
    for name, step, share, valid in (("n5_walk_forward", 100, 0.7, True), ("n6_sliding_predictions", 20, 0.9, False)):
        want = {}
        for s, g in rows.groupby("symbol"):
            for f in range((g["k"].max() - 150) // step + 1):
                place = g["k"] - f * step
                train, test = g[(place > 0) & (place <= int(130 * share))], g[(place > (int(130 * share) if valid else 130)) & (place <= 150)]
                want[s, f] = stump(train, test) if train["y"].nunique() > 1 and test["y"].nunique() > 1 else None
        got = {(s, f): x for s, f, x in found(spark, name, "symbol", "fold", "score")}
        assert got.keys() == want.keys() and len({s for s, _ in got}) == len(series)
        assert [got[x] for x in got] == pytest.approx([want[x] for x in got], nan_ok=True)


def test_scenarios_over_all_of_seq(spark, series):
    want = []
    for s, g in series.items():
        for lo in range(0, max(x["seq"].max() for x in series.values()) + 1, 400):
            prices = g[(g["seq"] >= lo) & (g["seq"] < lo + 800)].sort_values("seq")["last"].tolist()
            for j, act in enumerate((backtest.cross_strategy(3, 10), backtest.cross_strategy(5, 20))):
                account, memory = backtest.Account(10_000.0, 0.2, 1.0), {}
                for p in prices:
                    account.step(p)
                    act(account, p, memory)
                want += [(s, lo // 400 * 2 + j, account.deals, pytest.approx(account.equity(p), abs=1e-4))] if prices else []
    got = found(spark, "o9_scenarios", "symbol", "scenario", "deals", "equity")
    assert sorted(got) == sorted(want, key=lambda x: x[:3]) and len(got) > 8 * len(series)


def test_parameter_search_beyond_a_hundred_thousand(spark, monkeypatch):
    ticks = spark.createDataFrame([("a", i * 20_000, 10.0 + i * (i % 3)) for i in range(12)], "symbol string, seq long, last double")
    monkeypatch.setattr(market, "deals", lambda *_: ticks)
    got = {s: e for s, e in found(spark, "n11_parameter_search", "scenario", "equity")}
    for i, (f, s) in enumerate((f, s) for f in (3, 5, 8) for s in (13, 21)):
        account, memory, act = backtest.Account(10_000.0, 0.2, 1.0), {}, backtest.cross_strategy(f, s)
        for _, _, p in ticks.collect():
            account.step(p)
            act(account, p, memory)
        assert got[i] == pytest.approx(account.equity(p))
