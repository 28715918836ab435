"""Mixtures of all series at once against a plain loop over one."""

from collections import Counter

import numpy as np
import pytest

from tidemark.operators import mixtures


def plain(values, k, width, steps):
    v, c = (np.array(x, dtype=float) for x in zip(*sorted(Counter(((np.floor(np.array(values) / width) + 0.5) * width).tolist()).items())))
    n = c.sum()
    mean, square = (c * v).sum() / n, (c * v * v).sum() / n
    w, m, s = np.full(k, 1 / k), mean + 1.5 * np.sqrt(square - mean**2) * (2 * (np.arange(k) + 0.5) / k - 1), np.full(k, square - mean**2)
    least = 1e-6 * (square - mean**2)
    for step in range(steps + 1):
        d = w * np.exp(-0.5 * (v[:, None] - m) ** 2 / s) / np.sqrt(2 * np.pi * s)
        if step == steps:
            break
        r = c[:, None] * d / d.sum(1, keepdims=True)
        w, m = r.sum(0) / n, (r * v[:, None]).sum(0) / r.sum(0)
        s = np.maximum((r * v[:, None] ** 2).sum(0) / r.sum(0) - m**2, least)
    return w, m, s, (c * np.log(d.sum(1))).sum(), n


def test_mixtures_and_boundaries(spark):
    r = np.random.default_rng(4)
    x = {"a": np.concatenate([r.normal(-5, 1, 300), r.normal(4, 2, 500)]), None: r.normal(10, 3, 200), "flat": np.full(9, 2.0)}
    df = spark.createDataFrame([(s, float(v)) for s, vs in x.items() for v in vs] + [("a", None)], "symbol string, x double").repartition(3)
    m = mixtures.fit(df, ["symbol"], "x", [1, 2, 3], 0.25, 6).cache()
    got = {(g["symbol"], g["k"]): g for g in m.collect()}
    assert set(got) == {(s, k) for s in ("a", None) for k in (1, 2, 3)}
    for (s, k), g in got.items():
        w, mean, variance, likely, n = plain(x[s], k, 0.25, 6)
        order = np.argsort(mean)
        assert [tuple(p) for p in g["parts"]] == [pytest.approx((w[i], mean[i], variance[i]), rel=1e-6) for i in order]
        assert (g["log_likelihood"], g["aic"], g["bic"]) == pytest.approx((likely, 2 * (3 * k - 1) - 2 * likely, (3 * k - 1) * np.log(n) - 2 * likely))
    assert got["a", 2]["bic"] < got["a", 1]["bic"]
    for b in mixtures.boundaries(m, ["symbol"]).collect():
        (w, mean, s), (w2, mean2, s2) = got[b["symbol"], b["k"]]["parts"][b["nth"] - 1 : b["nth"] + 1]
        assert mean <= b["boundary"] <= mean2
        if (b["symbol"], b["k"]) == ("a", 2):
            assert w * np.exp(-0.5 * (b["boundary"] - mean) ** 2 / s) / np.sqrt(s) == pytest.approx(w2 * np.exp(-0.5 * (b["boundary"] - mean2) ** 2 / s2) / np.sqrt(s2))
