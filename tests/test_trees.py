"""Extremely randomised trees against a plain loop that draws the same thresholds."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import trees


def draw(*of):
    return int(hashlib.md5("|".join(map(str, of)).encode()).hexdigest()[:8], 16) / 2**32


def grow(x, y, key, tree, node, depth, tries, seed=1):
    """(share of ones, feature, threshold, left, right) of a node and those below it."""
    share = y.mean()
    if depth == 0 or len(y) < 2 or share in (0, 1):
        return share, None
    cuts = sorted((draw(seed, *key, tree, node, i, "which"), i, x[:, i].min() + draw(seed, *key, tree, node, i) * (x[:, i].max() - x[:, i].min())) for i in range(x.shape[1]) if x[:, i].min() < x[:, i].max())[:tries]
    impure = lambda v: v.sum() * (len(v) - v.sum()) / len(v)
    found = [(impure(y[x[:, i] < t]) + impure(y[x[:, i] >= t]), i, t) for _, i, t in cuts if (x[:, i] < t).any()]
    if not found:
        return share, None
    _, i, t = min(found)
    low = x[:, i] < t
    return share, (i, t, grow(x[low], y[low], key, tree, 2 * node, depth - 1, tries, seed), grow(x[~low], y[~low], key, tree, 2 * node + 1, depth - 1, tries, seed))


def leaf(tree, x):
    while tree[1]:
        i, t, low, high = tree[1]
        tree = low if x[i] < t else high
    return tree[0]


def test_trees_of_all_folds_are_those_of_a_loop(spark):
    r = np.random.default_rng(3)
    rows = []
    for symbol, fold in (("a", 0), ("a", 1), (None, 0), ("one", 0)):
        x = np.round(r.normal(size=(90, 3)), 3)
        x[:, 2] = 7.0 if symbol is None else x[:, 2]
        y = ((x[:, 0] + 0.3 * r.normal(size=90)) > 0).astype(int) if symbol != "one" else np.ones(90, dtype=int)
        rows += [(symbol, fold, int(k), *map(float, v), int(t)) for k, (v, t) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "symbol string, fold int, k int, f0 double, f1 double, f2 double, y int").repartition(4)
    train, test = df.where("k < 60"), df.where("k >= 60")
    names, keys = ["f0", "f1", "f2"], ["symbol", "fold"]
    model = trees.fit(train, names, "y", keys, trees=4, depth=3, tries=2)
    got = {(v["symbol"], v["fold"], v["k"]): v["p"] for v in trees.predict(test, model, names, keys, depth=3).collect()}
    for symbol, fold in (("a", 0), ("a", 1), (None, 0)):
        own = [v for v in rows if v[:2] == (symbol, fold)]
        x, y = np.array([v[3:6] for v in own]), np.array([v[6] for v in own])
        forest = [grow(x[:60], y[:60], ("" if symbol is None else symbol, fold), t, 1, 3, 2) for t in range(4)]
        assert [got[symbol, fold, k] for k in range(60, 90)] == [pytest.approx(np.mean([leaf(t, v) for t in forest])) for v in x[60:]]
    assert {got["one", 0, k] for k in range(60, 90)} == {None}
    assert np.mean([(got["a", 0, v[2]] >= 0.5) == v[6] for v in rows if v[:2] == ("a", 0) and v[2] >= 60]) > 0.7


def test_no_rows(spark):
    df = spark.createDataFrame([], "symbol string, x double, y int")
    assert trees.fit(df, ["x"], "y", ["symbol"], trees=2, depth=2).collect() == []
    assert trees.predict(df, trees.fit(df, ["x"], "y", ["symbol"], trees=2, depth=2), ["x"], ["symbol"], 2).where(F.col("p").isNotNull()).collect() == []


def test_rows_of_a_fold_meet_its_trees_once_and_are_summed_where_they_are(spark, monkeypatch):
    """No shuffle of rows once for each tree: between the join and the nodes' sums there is none, also with null keys."""
    plans = []
    kept = trees.stored
    monkeypatch.setattr(trees, "stored", lambda df, name: plans.append((name, df._jdf.queryExecution().executedPlan().toString())) or kept(df, name))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.createDataFrame([(None if i % 2 else "a", float(i % 13), i % 3 % 2) for i in range(60)], "symbol string, x double, y int")
        trees.fit(df, ["x"], "y", ["symbol"], trees=2, depth=1).collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    nodes = [p for name, p in plans if name == "nodes"]
    assert nodes and all(p.split("SortMergeJoin")[0].count("Exchange") == 0 for p in nodes)
