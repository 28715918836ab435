"""Operators 11 to 13 against brute force, over the tables at hand and over rows made to be awkward."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import impacts, metric_join, queries, resampling

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the tables")


def table(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


# 11


def cloud(seed, groups, singles, dim=16, spread=0.05):
    r = np.random.default_rng(seed)
    rows = [c + spread * r.normal(size=dim) for c, n in zip(r.normal(size=(len(groups), dim)), groups) for _ in range(n)]
    return [x.tolist() for x in [*rows, *r.normal(size=(singles, dim))]]


def joined(spark, rows, **more):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    return {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in metric_join.links(df, **more).collect()}


@tables
def test_op11(spark):
    out = queries.QUERIES["op11_metric_range_join"](spark, SF)
    assert dict(out.dtypes) == {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert {r["vec_id"]: tuple(r[c] for c in ("n_links", "component_id", "kept")) for r in out.collect()} == metric_join.brute_force(table(spark, "embeddings", "vec_id", "embedding"))


@pytest.mark.parametrize("spread", [0.02, 0.08, 0.15])
def test_cells_cores_blocks_and_stripes_lose_no_link(spark, monkeypatch, spread):
    for name, value in (("BLOCK", 16), ("STRIPE", 40), ("ROWS", 7)):
        monkeypatch.setattr(metric_join, name, value)
    rows = list(enumerate(cloud(3, [90, 40, 12, 2], 120, spread=spread)))
    rows += [(1000 + i, rows[0][1]) for i in range(20)] + [(1100 + i, [3 * x for x in rows[200][1]]) for i in range(3)]
    want = metric_join.brute_force(rows)
    assert joined(spark, rows) == want and len({c for _, c, _ in want.values()}) < len(rows)


def test_chains_are_one_component(spark, monkeypatch):
    monkeypatch.setattr(metric_join, "BLOCK", 8)
    angle = math.acos(0.95) * 0.9
    rows = [(50 - k, [math.cos(k * angle), math.sin(k * angle)]) for k in range(20)]
    assert joined(spark, rows) == metric_join.brute_force(rows)


def test_op11_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (2, [2.0, -0.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (8, [None, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1e200, 1e190]), (11, [-1.0, 0.0])]
    assert joined(spark, rows) == {1: (2, 1, True), 2: (2, 1, False), 10: (2, 1, False), **{i: (0, i, True) for i in (3, 4, 5, 6, 7, 8, 9, 11)}}
    df = spark.createDataFrame([(1, [1.0, 0.0], "x"), (1, [1.0, 0.0], "x"), (1, [0.0, 1.0], "y"), (0, [0.0, 2.0], "y"), (None, [1.0, 0.0], "z")], "vec_id long, embedding array<float>, component_id string")
    out = Counter(tuple(r) for r in metric_join.links(df).select("vec_id", "n_links", "component_id", "kept").collect())
    assert out == Counter({(1, 1, 0, False): 3, (0, 1, 0, True): 1, (None, 0, None, True): 1})
    assert metric_join.links(df.limit(0)).collect() == []


# 12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def brute_rank(docs, items, k=20):
    own = {d: Counter(terms(t)) for d, t in docs}
    n, total = sum(bool(c) for c in own.values()), sum(c.total() for c in own.values())
    df = Counter(w for c in own.values() for w in c)
    out = []
    for i, t in items:
        score = Counter()
        for w in terms(t):
            for d, c in own.items():
                if c[w]:
                    m = 100 - 25 + (25 * c.total() * n) // total
                    score[d] += math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((1000000000 * c[w]) // (1000 * c[w] + 12 * m))
        best = sorted((-s, d) for d, s in score.items() if s > 0)[:k]
        out += [(i, r + 1, d, -s) for r, (s, d) in enumerate(best)]
    return sorted(out)


@tables
def test_op12(spark):
    out = queries.QUERIES["op12_sparse_product_search"](spark, SF)
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, out.collect())) == brute_rank(table(spark, "documents", "doc_id", "text"), table(spark, "benchmark", "item_id", "text"))


def test_products_of_many_blocks_and_rounds(spark, monkeypatch):
    """Blocks of a few texts and rounds of a few items: ties, repeated terms and terms of all documents."""
    from tidemark.llm import search

    monkeypatch.setattr(search, "SHARD", 400)
    monkeypatch.setattr(impacts, "ITEMS", 7)
    r = np.random.default_rng(5)
    words = [f"W{i}" for i in range(60)] + ["é1", "ß", "x-y"]
    docs = [(i, " ".join(r.choice(words, r.integers(0, 40))) + " all") for i in range(150)] + [(150 + i, "same Words here") for i in range(30)]
    items = [(i, " ".join(r.choice(words, r.integers(0, 12))) + " words" * (i % 3)) for i in range(40)]
    got = impacts.rank(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), spark.createDataFrame(items, "item_id long, text string"), k=5)
    assert sorted(map(tuple, got.collect())) == brute_rank(docs, items, 5)


def test_op12_odd_rows(spark):
    docs = spark.createDataFrame([(1, "red apple", 0), (1, "red apple", 0), (2, "Red", 0), (None, "red", 0), (3, None, 0), (4, "--", 0)], "doc_id long, text string, score int")
    items = spark.createDataFrame([(7, "red, RED"), (8, None), (9, " "), (10, "blue"), (None, "apple")], "item_id long, text string")
    out = sorted(map(tuple, impacts.rank(docs, items).select("rank", "doc_id", "item_id").collect()), key=str)
    assert out == [(1, 1, None), (1, 2, 7), (2, 1, 7), (2, 1, None), (3, 1, 7)]
    assert impacts.rank(docs.limit(0), items).collect() == [] and impacts.rank(docs, items.limit(0)).collect() == []


# 13

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_resample(docs, target, percent=10, seed=2024, least=20, buckets=10_000):
    def found(text):
        return [zlib.crc32(w.encode()) % buckets for w in WORD.findall((text or "").translate(LOWER))]

    own = [found(t) for _, t in docs]
    s, t = Counter(b for f in own for b in f), Counter(b for x in target for b in found(x))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in s}
    rows = []
    for (d, _), f in zip(docs, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{d}".encode()).hexdigest()[:8], 16)
        rows.append([d, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    fit = sorted((-r[3], r[0], r) for r in rows if r[1] >= least)
    for k, (_, _, r) in enumerate(fit[: percent * len(fit) // 100]):
        r[4] = k + 1
    return sorted(map(tuple, rows))


@tables
def test_op13(spark):
    out = queries.QUERIES["op13_importance_resampling"](spark, SF)
    assert dict(out.dtypes) == dict.fromkeys(["doc_id", "n_features", "weight", "score", "rank"], "bigint")
    want = brute_resample(table(spark, "documents", "doc_id", "text"), [t for t, in table(spark, "benchmark", "text")])
    assert sorted(map(tuple, out.collect())) == want and any(r[4] for r in want)


@pytest.mark.parametrize("percent", [0, 1, 35, 100])
def test_draws_by_rank(spark, percent):
    r = np.random.default_rng(9)
    words = [f"w{i}" for i in range(80)] + ["É", "A-b", "n0"]
    docs = [(i, " ".join(r.choice(words, r.integers(0, 60)))) for i in range(200)]
    docs += [(300 + i, docs[7][1]) for i in range(100)] + [(500, None), (501, ""), (502, " -- ")]
    target = [" ".join(r.choice(words[:20], 30)) for _ in range(10)] * 2 + [None]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame([(t,) for t in target], "text string"), percent=percent)
    assert sorted(map(tuple, got.collect())) == brute_resample(docs, target, percent)


def test_op13_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(25))
    docs = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, text, 7), (2, "few words", 8)], "doc_id long, text string, weight int")
    target = spark.createDataFrame([("w1 w2", 1)], "text string, doc_id int")
    out = sorted((tuple(r) for r in resampling.resample(docs, target, percent=50).collect()), key=str)
    assert [(d, n, r) for d, n, _, _, r in out] == [(1, 25, 1), (1, 25, None), (2, 2, None), (None, 25, None)]
    assert [s is None for _, _, _, s, _ in out] == [False, False, False, True] and len({w for d, _, w, _, _ in out if d != 2}) == 1
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert resampling.resample(docs, target.limit(0)).where(F.col("rank").isNotNull()).count() == 0
    plain = [(d, t) for d, t, _ in [(1, text, 0), (2, "few words", 0)]]
    got = resampling.resample(spark.createDataFrame(plain, "doc_id long, text string"), target.limit(0))
    assert sorted(map(tuple, got.collect())) == brute_resample(plain, [])
