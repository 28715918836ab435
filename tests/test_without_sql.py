"""Queries that SQL does not say: against plain loops over whole tables."""

import os
import struct
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import Window, functions as F

from tidemark.functions import recursive
from tidemark.operators import bars
from tidemark.plans import market_queries, rest_queries  # noqa: F401  they register themselves
from tidemark.plans.registry import QUERIES
from tidemark.sources import market

DIR, MORE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the tables")


def rows(spark, name, *columns, folder=DIR):
    return sorted(map(tuple, QUERIES[name](spark, folder).select(*columns).collect()), key=lambda r: tuple((x is not None, x) for x in r))


@pytest.fixture(scope="module")
def value_bars(spark):
    b = market_queries._volatile(spark, MORE).toPandas()
    return {s: g.sort_values("uid") for s, g in b.groupby("symbol")}


def regression(y, order, trend):
    """t statistic of the lagged level, by least squares."""
    d = np.diff(y)
    n = len(d) - order
    a = np.column_stack([y[order:-1] - y.mean(), np.ones(n), *([np.arange(n)] if trend else []), *(d[order - k : len(d) - k] for k in range(1, order + 1))])
    b, *_ = np.linalg.lstsq(a, d[order:], rcond=None)
    rest = d[order:] - a @ b
    return b[0] / np.sqrt(np.linalg.inv(a.T @ a)[0, 0] * (rest @ rest) / (n - a.shape[1]))


def test_adf(spark):
    h = bars.minute_bars(market.deals(spark, DIR), 60).withColumn("month", F.date_trunc("month", "time")).toPandas()
    want = []
    for (s, _), g in h.groupby(["symbol", "month"]):
        y = g.sort_values("time")["close"].to_numpy()
        want.append((s, None if len(y) < 9 else round(regression(y, 2, True), 6)))
    got = rows(spark, "e12_adf", "symbol", "adf")
    assert [g[0] for g in got] == sorted(w[0] for w in want)
    many = [w for w in want if w[1] is not None]
    assert len(many) >= 5 and all(any(g == (s, pytest.approx(v, abs=2e-6)) for g in got if g[1] is not None) for s, v in many)


@pytest.mark.parametrize("name, maxw, minw, order, mode", [("e13_sadf", 24, 16, 2, "quantile"), ("e15_sadf_max", 20, 16, 1, "max")])
def test_supremum(spark, value_bars, name, maxw, minw, order, mode):
    got = {(s, u): (v, w) for s, u, v, w in rows(spark, name, "symbol", "uid", "sadf", "spread", folder=MORE)}
    seen = 0
    for s, g in value_bars.items():
        x = np.log(g["wprice"].to_numpy())
        for i, uid in enumerate(g["uid"]):
            if i < maxw - 1:
                assert got[s, uid] == (None, None)
                continue
            t = [regression(x[i + 1 - w : i + 1], order, True) for w in range(maxw, minw, -1)]
            at = [int(max(np.floor(p * len(t) + 1), 2)) - 2 for p in (0.85, 0.92, 0.99)]
            want = (max(t), int(np.argmax(t)) / (len(t) - 1)) if mode == "max" else (sorted(t)[at[1]], sorted(t)[at[2]] - sorted(t)[at[0]])
            assert got[s, uid] == (pytest.approx(want[0], abs=2e-6), pytest.approx(want[1], abs=2e-6))
            seen += 1
    assert seen > 800


def test_structural_features(spark):
    """Supremum ADF, the sums over that, and 128 weights, by series, against the kernels over whole ones."""
    from tidemark.operators import features

    r = np.random.default_rng(2)
    x = {s: np.cumsum(r.normal(size=n)) + 50 for s, n in (("a", 400), ("b", 90))}
    df = spark.createDataFrame([(s, i, float(v)) for s, vs in x.items() for i, v in enumerate(vs)], "symbol string, uid long, x double")
    got = features.structural(df, ["symbol"], "uid", "x", 24, 16, 2, 1.0, 0.56, 128).orderBy("symbol", "uid").collect()
    for s, vs in x.items():
        own = [g for g in got if g["symbol"] == s]
        sadf, _ = recursive.sadf(vs, 24, 16, 2, True)
        assert np.allclose([np.nan if g["sadf"] is None else g["sadf"] for g in own], sadf, equal_nan=True)
        assert [g["csum"] for g in own] == recursive.cusum(sadf, 1.0).tolist() and any(g["csum"] for g in own)
        assert np.allclose([np.nan if g["fd"] is None else g["fd"] for g in own], recursive.fracdiff(vs, 0.56, 128), equal_nan=True)


def test_synthetic_ticks(spark):
    want = []
    for b in bars.minute_bars(market.deals(spark, DIR)).select("symbol", F.unix_timestamp("time").alias("t"), "open", "high", "low", "volume").collect():
        h = zlib.crc32(f"{b['symbol']}|{b['t']}".encode()) % (58 * 57)
        one, two = divmod(h, 57)
        two += two >= one
        want += [(b["symbol"], b["t"] + at, round(p, 6), b["volume"] // 3) for at, p in ((0, b["open"]), (1 + one, b["high"]), (1 + two, b["low"]))]
    assert rows(spark, "a18_synthetic_ticks", "symbol", "sec", "last", "volume") == sorted(want)


def test_sample_is_settled_by_hashes(spark):
    def drawn(symbol, seq):
        h = xxhash.xxh64_intdigest(symbol.encode(), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<q", seq), h)
        h = xxhash.xxh64_intdigest(struct.pack("<i", 7), h)
        return (h - (1 << 64 if h >= 1 << 63 else 0)) % 1_000_000 < 100_000

    deals = [tuple(r) for r in market.deals(spark, DIR).select("symbol", "seq").collect()]
    assert rows(spark, "k4_sample", "symbol", "seq") == sorted(d for d in deals if drawn(*d)) and len(deals) > 500


def test_random_folds_are_settled_by_hashes(spark):
    def order(fold):
        h = xxhash.xxh64_intdigest(struct.pack("<q", fold), 42)
        h = xxhash.xxh64_intdigest(struct.pack("<i", 1), h)
        return h - (1 << 64 if h >= 1 << 63 else 0)

    want = []
    for s, n in market.deals(spark, MORE).groupBy("symbol").count().collect():
        want += [(s, f, 300, f * 100 + 1) for f in sorted(range((n - 300) // 100 + 1), key=order)[:2]]
    assert rows(spark, "n2_random_folds", "symbol", "fold", "n", "lo", folder=MORE) == sorted(want) and len(want) == 10


def test_intermediate_files_can_be_cleared(spark):
    from tidemark.plans import scratch

    kept = scratch.stored(spark.range(5), "numbers")
    path = kept.inputFiles()[0].removeprefix("file://")
    assert kept.count() == 5 and os.path.exists(path)
    scratch.clear(spark)
    assert not os.path.exists(path)


def test_event_vectors_of_eleven_features(spark):
    """Few bars have so much history here; where there are vectors they hold eleven features of four bars and the label's three."""
    out = QUERIES["h1_eleven_features"](spark, MORE).collect()
    assert len(out) > 500 and {r["size"] for r in out} == {47}
    b = {(r["symbol"], r["uid"]): r for r in market_queries._volatile(spark, MORE).collect()}
    for r in out[:200]:
        assert r["second"] == pytest.approx(b[r["symbol"], r["twhen"] - 3]["wprice"], abs=1e-6) and r["first"] == pytest.approx(b[r["symbol"], r["twhen"] - 3]["dtp"], abs=1e-6)
        assert r["last"] == r["vertbar"] and r["inf_start"] == r["twhen"] - 3 - 23 and r["twhen"] >= 127 + 3
