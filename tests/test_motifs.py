"""Nearest windows against all pairs."""

import numpy as np
import pytest

from tidemark.operators import motifs


def brute(rows, n, apart):
    out = []
    for s, i, x in rows:
        far = sorted((float(np.sqrt(sum((a - b) ** 2 for a, b in zip(x, y)))), j) for t, j, y in rows if t == s and abs(i - j) >= apart)
        out += [(s, i, k + 1, j, pytest.approx(d)) for k, (d, j) in enumerate(far[:n])]
    return sorted(out, key=lambda r: (str(r[0]), r[1], r[2]))


@pytest.mark.parametrize("block", [8, 1024])
def test_nearest_windows(spark, monkeypatch, block):
    """Several series, one without a name, clusters, equal windows, and a series of a single window."""
    monkeypatch.setattr(motifs, "BLOCK", block)
    monkeypatch.setattr(motifs, "STRIPE", 3 * block)
    r = np.random.default_rng(6)
    rows = []
    for s, n in (("a", 150), (None, 40), ("one", 1)):
        walk = np.cumsum(np.round(r.normal(size=n + 3), 2))
        walk[60:70] = walk[20:30] if n > 100 else walk[60:70]
        rows += [(s, i, walk[i : i + 4].tolist()) for i in range(n)]
    df = spark.createDataFrame(rows + [("a", 900, None), ("a", 901, [1.0, None, 2.0, 3.0])], "symbol string, id long, x array<double>").repartition(3)
    got = [tuple(v) for v in motifs.nearest(df, ["symbol"], 3, 4).select("symbol", "id", "rank", "other", "distance").collect()]
    assert sorted(got, key=lambda v: (str(v[0]), v[1], v[2])) == brute(rows, 3, 4)


def test_far_cells_are_not_visited(spark, monkeypatch):
    """Tight clusters far from each other: windows only meet their own."""
    monkeypatch.setattr(motifs, "BLOCK", 16)
    r = np.random.default_rng(1)
    rows = [("a", i, [float(100 * (i % 6)) + float(v) for v in r.normal(size=3)]) for i in range(300)]
    seen = []
    kept = motifs.stored
    monkeypatch.setattr(motifs, "stored", lambda df, name: seen.append((name, out := kept(df, name))) or out)
    assert motifs.nearest(spark.createDataFrame(rows, "symbol string, id long, x array<double>"), ["symbol"], 2, 1).count() == 600
    visits = dict(seen)["visits"].count()
    blocks = dict(seen)["cell-plan"].selectExpr("sum(blocks)").first()[0]
    assert visits < 0.5 * 300 * blocks


def test_no_windows(spark):
    df = spark.createDataFrame([], "symbol string, id long, x array<double>")
    assert motifs.nearest(df, ["symbol"], 2, 1).collect() == []


def test_infinite_windows_against_a_plain_loop(spark):
    inf, series = float("inf"), {"a": 40, "b": 6}
    rows = [(s, i, [float((i * 7 + j * 3) % 11) for j in range(2)]) for s, m in series.items() for i in range(m)]
    rows = [(s, i, [inf, x[1]] if i in (3, 9, 30) else [x[0], inf] if i == 4 else x) for s, i, x in rows]
    want = set()
    for s, i, x in rows:
        far = []
        for t, j, y in rows:
            if s == t and abs(i - j) >= 2:
                d = sum((p - q) ** 2 for p, q in zip(x, y)) ** 0.5
                far.append((d != d, 0.0 if d != d else d, j))
        want |= {(s, i, r, j) for r, (_, _, j) in enumerate(sorted(far)[:3], 1)}
    df = spark.createDataFrame(rows, "symbol string, id long, x array<double>")
    assert {(r["symbol"], r["id"], r["rank"], r["other"]) for r in motifs.nearest(df, ["symbol"], 3, 2).collect()} == want


def test_work_for_a_window_grows_slower_than_the_series(monkeypatch):
    """Leaves that the bounds rule out are not compared: four times the windows take well under sixteen times the pairs."""
    pairs = []
    compare = motifs._Nearest._compare
    monkeypatch.setattr(motifs._Nearest, "_compare", lambda self, rows, hosts, ids: pairs.append(len(rows) * len(hosts)) or compare(self, rows, hosts, ids))
    r, counts = np.random.default_rng(4), []
    for n in (4_000, 16_000):
        x = r.normal(size=(n, 3))
        near = motifs._Nearest(x, np.arange(n), np.full(n, np.inf), 3, 4)
        pairs.clear()
        near.meet(x, np.arange(n), True)
        counts.append(sum(pairs))
        far = ((x[:50, None] - x[None]) ** 2).sum(2)
        far[np.abs(np.arange(50)[:, None] - np.arange(n)) < 4] = np.inf
        assert (near.id[:50] == np.argsort(far, axis=1, kind="stable")[:, :3]).all()
    assert counts[1] < 8 * counts[0]
