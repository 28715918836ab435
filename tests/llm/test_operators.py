"""The ten operators against brute force, round trips and held-out accuracy, with the awkward rows of any table."""

import math
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import coder, ctw, decontaminate, language, near, packing, quality, queries, search, sharding, store, substring
from tidemark.llm.tokens import PieceEncoder
from tidemark.llm.words import Words, shingle_sets

SF = "/root/testdata/sf0.001"
WORDS = [f"w{i}" for i in range(400)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, blanks, one very long text, odd white space."""
    base, passage = prose(1, 120), prose(2, 70)
    edited = base.split()
    edited[60] = "changed"
    out = [base, base, " ".join(edited), base.upper(), prose(3, 30) + " " + passage + " " + prose(4, 30), passage, prose(5, 10) + " " + passage, "", " \t\n ", None, "one two", "one two", prose(6, 3), "x y z " + prose(7, 60), prose(8, 5000), "|" * 50, passage + "\n\n" + passage]
    return [(i, t, None if i % 5 == 0 else "en", "src0" if i % 3 else None, None) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_words_are_the_bytes_split():
    texts = [b"a  b\tc\x0bd", b"", b" x ", "é ü z".encode(), b"q" * 100_000]
    w = Words(texts, lower=False)
    assert [w.raw[a:b] for a, b in zip(w.start, w.end)] == [x for t in texts for x in t.split()]
    assert np.diff(w.first).tolist() == [len(t.split()) for t in texts]
    assert len(list(shingle_sets([b"a b", b"A B", b""]))[2]) == 0
    a, b, _ = shingle_sets([b"a b", b"A B", b""])
    assert a.tolist() == b.tolist() and len(a) == 1


# 1


def test_ctw_base_score_and_probabilities(spark, docs, rows):
    marked = docs.withColumn("held_out", F.col("doc_id") % 4 == 1)
    found = {r["doc_id"]: r for r in ctw.scores(marked).collect()}
    toks = {i: (t or "").encode().lower().split() + [b""] for i, t, *_ in rows}
    c = Counter(w for i, ws in toks.items() if i % 4 != 1 for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in toks.items():
        r = found[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(ws), sum(w in c for w in ws), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c.get(w, 0) + 1) / (n + v + 1)) for w in ws))
        assert r["score"] < 0


def test_ctw_is_a_distribution():
    """The probabilities of all bytes in a context add up to one, known context or not."""
    key, _ = ctw._keys([b"abc \n", b"abd \n", b"a \n", b"\n", b"xabcabcabc \n"])
    unique, n = np.unique(key, return_counts=True)
    import pandas as pd

    rows = []
    for g in np.unique(unique >> 40):
        t = ctw._Tree(unique[unique >> 40 == g], n[unique >> 40 == g])
        m = np.flatnonzero(t.met)
        rows.append(pd.DataFrame({"last": t.last, "node": m, "n0": t.n0[m], "n1": t.n1[m], "whole": t.whole[m]}))
    top = ctw._top(pd.concat(rows).groupby(["last", "node"], as_index=False).sum())
    met = int(unique[0])
    for context in (met >> 8, (met >> 40 << 32) | 12345, (int(unique[-1]) >> 48 << 40) | 12345):
        have = unique >> 40 == context >> 32
        keys = np.unique(np.concatenate([unique[have], (context << 8) | np.arange(256)]))
        tree = ctw._Tree(keys, np.array([n[unique == k].sum() for k in keys]))
        assert (10 ** tree.log_chances(top))[keys >> 8 == context].sum() == pytest.approx(1)


def brute_ctw(learn, texts, depth=6):
    """log10 of each text's probability by context trees that are walked bit by bit, a node for each (context, bits before)."""
    close = lambda t: b"".join(w + b" " for w in t.lower().split()) + b"\n"
    lg = math.lgamma

    def decisions(text):
        text = bytes(depth - 1) + b" " + close(text)
        for i in range(depth, len(text)):
            for bit in range(8):
                yield [text[i - d : i] for d in range(depth + 1)], (256 | text[i]) >> (8 - bit), (text[i] >> (7 - bit)) & 1

    n = {}
    for t in learn:
        for contexts, node, one in decisions(t):
            for c in contexts:
                n.setdefault((c, node), [0, 0])[one] += 1
    own = {x: lg(a + 0.5) + lg(b + 0.5) - lg(a + b + 1) - math.log(math.pi) for x, (a, b) in n.items()}
    below, whole = Counter(), {}
    for c, node in sorted(n, key=lambda x: -len(x[0])):
        x = (c, node)
        whole[x] = own[x] if len(c) == depth else np.logaddexp(own[x], below[x]) - math.log(2)
        if c:
            below[c[1:], node] += whole[x]
    out = []
    for t in texts:
        total = 0.0
        for contexts, node, one in decisions(t):
            met = [(c, node) for c in contexts if (c, node) in n]
            p, rest = 0.0, 1.0
            for x in met:
                share = 1.0 if x == met[-1] else math.exp(own[x] - math.log(2) - whole[x])
                p += rest * share * (n[x][one] + 0.5) / (sum(n[x]) + 1)
                rest *= 1 - share
            total += math.log10(p if met else 0.5)
        out.append(total)
    return out


def test_ctw_contexts_run_over_words(spark):
    """Scores are those of trees over whole texts, and depend on the order of words."""
    learn = ["the cat sat on the mat", "A dog  sat\ton a log", "on the mat the cat sat é", "", None]
    asked = ["the cat sat on a mat", "mat a on sat cat the", "zzz the dog", "", "cat"]
    rows = [(i, t, False) for i, t in enumerate(learn)] + [(100 + i, t, True) for i, t in enumerate(asked)]
    found = {r["doc_id"]: r["score"] for r in ctw.scores(spark.createDataFrame(rows, "doc_id long, text string, held_out boolean").repartition(3)).collect()}
    want = brute_ctw([(t or "").encode() for t in learn], [(t or "").encode() for t in learn + asked])
    assert [found[i] for i, *_ in rows] == pytest.approx(want, rel=1e-9)
    assert found[100] > found[101] + 1


def test_ctw_slices_and_blocks_change_nothing(spark, rows, monkeypatch):
    """Small blocks, slices and merges give the scores of the large ones; so do null doc_ids, repeated rows and other columns."""
    marked = [(i if i % 4 else None, t, i % 3 == 0) for i, t, *_ in rows[:14]] * 2
    learn = [t for _, t, h in marked if not h]
    want = Counter(round(x, 6) for x in brute_ctw([(t or "").encode() for t in learn], [(t or "").encode() for _, t, _ in marked]))
    table = spark.createDataFrame([(*r, "b", 1) for r in marked], "doc_id long, text string, held_out boolean, block string, n int")
    assert Counter(round(r["score"], 6) for r in ctw.scores(table.repartition(4)).collect()) == want
    key, _ = ctw._keys([ctw._closed((t or "").encode()) for t in learn])
    unique, n = np.unique(key, return_counts=True)
    most = np.bincount(unique >> 40).argmax()
    unique, n = unique[unique >> 40 == most], n[unique >> 40 == most]
    top = tuple(np.full((256, 256), x) for x in (0.1, 0.7, 0.5))
    whole = ctw._Tree(unique, n)
    monkeypatch.setattr(ctw, "_SLICE", 3)
    cut = ctw._Tree(unique, n)
    assert len(cut.slices) > 1 and np.allclose(cut.whole, whole.whole) and np.allclose(cut.log_chances(top), whole.log_chances(top))


def test_ctw_estimates_of_large_counts():
    n0, n1 = np.array([[0, 5], [70_000, 10**9]]), np.array([[0, 10**7], [3, 10**9]])
    want = [[math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi) for a, b in zip(x, y)] for x, y in zip(n0.tolist(), n1.tolist())]
    assert np.allclose(ctw._kt(n0, n1), want, rtol=1e-9)


def test_ctw_learns_nothing_from_held_out_rows(spark, docs):
    a = ctw.scores(docs.withColumn("held_out", F.lit(True))).collect()
    assert all(r["train_tokens"] == 0 and r["n_known"] == 0 for r in a)
    r = min(a, key=lambda r: r["n_tokens"])
    assert r["score"] == pytest.approx(-8 * math.log10(2))  # the end alone, every bit even


def test_ctw_empty(empty):
    assert ctw.scores(empty.withColumn("held_out", F.lit(False))).collect() == []



def test_ctw_parts_and_blocks_change_nothing(spark, rows, monkeypatch):
    """Trees that are cut into parts, and many small blocks, give the scores of one block and whole trees."""
    d = spark.createDataFrame([(i, t, i % 4 == 1) for i, t, *_ in rows if t is None or len(t) < 5000], "doc_id long, text string, held_out boolean").repartition(2)
    want = {r["doc_id"]: r["score"] for r in ctw.scores(d).collect()}
    monkeypatch.setattr(ctw, "PART", 60)
    monkeypatch.setattr(ctw, "BLOCK", 300)
    monkeypatch.setattr(ctw, "_CHUNK", 200)
    assert {r["doc_id"]: r["score"] for r in ctw.scores(d).collect()} == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}


def test_ctw_tasks_hold_one_row_at_a_time(monkeypatch):
    """A part of five thousand blocks: what is held is the distinct pairs, not the blocks' rows."""
    import tracemalloc

    import pyarrow as pa

    r = np.random.default_rng(4)
    tree = 0x6120
    own = [np.sort((tree << 40) | r.integers(0, 1 << 30, 2_000)) for _ in range(20)]
    packed = [ctw._planes(np.diff(k, prepend=tree << 40)) for k in own]
    times = ctw._planes(np.ones(2_000, dtype=np.int64))

    def batches(blocks):
        for i in range(blocks):
            yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([0], pa.int32()), pa.array([packed[i % 20]]), pa.array([times])], ["tree", "part", "pairs", "times"])

    monkeypatch.setattr(ctw, "_MERGE", 50_000)
    peak = []
    for blocks in (50, 5_000):
        tracemalloc.start()
        out = list(ctw._merged(batches(blocks)))
        peak.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert len(out) == 1 and ctw._unplanes(out[0].column("times")[0].as_py()).sum() == blocks * 2_000
    assert peak[1] < 1.2 * peak[0]


# 2


def brute_bm25(rows, queries, k, k1=1.2, b=0.75):
    words = {i: Counter((t or "").encode().lower().split()) for i, t, *_ in rows}
    mean = sum(sum(c.values()) for c in words.values()) / len(words)
    df = Counter(w for c in words.values() for w in c)
    out = []
    for q, t in queries:
        s = {}
        for w, n in Counter((t or "").encode().lower().split()).items():
            for i, c in words.items():
                if w in c:
                    s[i] = s.get(i, 0) + n * math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * c[w] * (k1 + 1) / (c[w] + k1 * (1 - b + b * sum(c.values()) / mean))
        out += [(q, r + 1, i, round(v, 6)) for r, (i, v) in enumerate(sorted(s.items(), key=lambda x: (-round(x[1], 9), x[0]))[:k])]
    return sorted(out)


def test_search_is_exact(spark, docs, rows, monkeypatch):
    asked = [(1, prose(2, 20)), (2, prose(8, 40)), (3, "nowhere"), (4, None), (5, ""), (6, "W1 w1 w2")]
    q = spark.createDataFrame(asked, "query_id long, text string")
    got = sorted((r["query_id"], r["rank"], r["doc_id"], round(r["score"], 6)) for r in search.top_k(docs, q, k=4).collect())
    assert got == brute_bm25(rows, asked, 4)


def test_search_runs_whole_documents(spark, monkeypatch):
    """Every 20th document as a query, in several rounds and shards, long and short ones."""
    monkeypatch.setattr(search, "QUERIES", 4)
    monkeypatch.setattr(search, "SHARD", 20_000)
    got = sorted((r["query_id"], r["rank"], r["doc_id"], r["score"]) for r in queries.QUERIES["op2_bm25_documents"](spark, SF).collect())
    table = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    asked = [(i, t) for i, t in table if i % 20 == 0]
    assert len(asked) >= 10 and {len(set((t or "").lower().split())) > 150 for _, t in asked} == {True, False}
    want = brute_bm25(table, asked, 10)
    assert [x[:3] for x in got] == [x[:3] for x in want]
    assert [x[3] for x in got] == pytest.approx([x[3] for x in want], abs=2e-6)


def test_search_prunes_within_blocks():
    """Block maxima and pivots against scoring every document, over random postings."""
    r = np.random.default_rng(5)
    texts = [(i, " ".join(r.choice(WORDS[:40], r.integers(1, 60), p=np.arange(40, 0, -1) / 820))) for i in range(900)]
    df = Counter(w for _, t in texts for w in set(t.split()))
    h = Words([t.encode() for _, t in texts], lower=True)
    terms, code = np.unique(h.hash, return_inverse=True)
    key, count = np.unique(code * len(texts) + h.doc, return_counts=True)
    shard = search.Shard.__new__(search.Shard)
    shard.doc_id, shard.length = np.arange(900), np.bincount(h.doc, minlength=900)
    shard.terms, shard.starts = terms, np.searchsorted(key // 900, np.arange(len(terms) + 1))
    shard.docs, shard.counts = key % 900, count
    mean = len(h.hash) / 900
    pruned = search.Pruned(shard, mean, 1.2, 0.75)
    for seed in range(20):
        words = list(dict.fromkeys(np.random.default_rng(seed).choice(WORDS[:40], 6 if seed % 2 else 30)))
        plan = [(int(Words([w.encode()], lower=True).hash[0]), math.log(1 + (900 - df[w] + 0.5) / (df[w] + 0.5))) for w in words]
        order = np.argsort([t for t, _ in plan])
        asked, weights = np.array([plan[i][0] for i in order], dtype=np.uint64), np.array([plan[i][1] for i in order])
        got = pruned.top(asked, weights, 10)
        all_ = {}
        for t, w in plan:
            at = int(np.searchsorted(terms, np.uint64(t)))
            for x, n in zip(shard.docs[shard.starts[at] : shard.starts[at + 1]].tolist(), shard.counts[shard.starts[at] : shard.starts[at + 1]].tolist()):
                all_[x] = all_.get(x, 0) + w * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * shard.length[x] / mean))
        want = sorted(((round(s, 9), d) for d, s in all_.items()), key=lambda x: (-x[0], x[1]))[:10]
        assert [d for _, d in got] == [d for _, d in want] and [s for s, _ in got] == pytest.approx([s for s, _ in want], abs=2e-9)
        bound = pruned.bounds(*(lambda p: (p[0], weights[p[1]]))(shard.places(asked))) + 1e-6
        assert all(s <= bound[d] for d, s in all_.items())


def test_search_skips_what_cannot_win():
    """A text with a dozen near copies: of a thousand documents only few are scored."""
    r, often = np.random.default_rng(6), 1 / np.arange(1, 4001)
    base, *others = (" ".join(f"w{w}" for w in r.choice(4000, 80, p=often / often.sum())) for _ in range(1001))
    texts = [f"y{i} {base}" if i % 80 == 0 else t for i, t in enumerate(others)]
    h = Words([t.encode() for t in texts], lower=True)
    shard = search.Shard.__new__(search.Shard)
    shard.terms, code = np.unique(h.hash, return_inverse=True)
    key, shard.counts = np.unique(code * 1000 + h.doc, return_counts=True)
    shard.doc_id, shard.length, shard.docs = np.arange(1000), np.bincount(h.doc), key % 1000
    shard.starts = np.searchsorted(key // 1000, np.arange(len(shard.terms) + 1))
    pruned, passed = search.Pruned(shard, 80.0, 1.2, 0.75), []
    scored = pruned.scores
    pruned.scores = lambda docs: passed.extend(docs.tolist()) or scored(docs)
    asked, times = np.unique(Words([base.encode()], lower=True).hash, return_counts=True)
    got = pruned.top(asked, times * 1.0, 10)
    assert all(d % 80 == 0 for _, d in got) and len(passed) < 500


def test_search_ties_go_to_the_smaller_id(spark):
    """Many equal documents, in any order and over several tasks, for short and long queries."""
    rows = [(int(i), "red apple tree", 1) for i in np.random.default_rng(1).permutation(90)] + [(100 + i, "green", 1) for i in range(9)]
    q = spark.createDataFrame([(1, "apple tree"), (2, " ".join(["apple", *(f"z{i}" for i in range(70)), "red"]))], "query_id long, text string")
    got = search.top_k(spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3), q, k=7).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["doc_id"]) for r in got] == [(k, i) for k in (1, 2) for i in range(7)]


def test_search_empty(empty, spark):
    q = spark.createDataFrame([(1, "a")], "query_id long, text string")
    assert search.top_k(empty, q).collect() == [] and search.top_k(spark.createDataFrame([(1, "a")], "doc_id long, text string"), q.limit(0)).collect() == []


# 3


def test_near_duplicates(docs, rows):
    want = near.brute_force([r[:2] for r in rows])
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.classes(docs).collect()}
    assert got == want and want[3][1] == 0 and want[11][1] == 10


def test_near_repeated_ids(spark):
    """Rows of one doc_id are compared by their own texts, and link what they are similar to."""
    a, b = prose(71, 80), prose(72, 80)
    rows = [(5, a), (5, b), (7, a + " tail"), (8, b + " tail"), (9, b + " tail"), (5, ""), (6, None), (None, a), (None, a), (10, prose(73, 50))]
    out = near.classes(spark.createDataFrame(rows, "doc_id long, text string").withColumns({"row": F.lit(1), "id": F.lit("x")}).repartition(3)).collect()
    assert len(out) == len(rows)
    assert {(r["doc_id"], r["component_id"], r["kept"]) for r in out} == {(5, 5, True), (7, 5, False), (8, 5, False), (9, 5, False), (6, 6, True), (None, None, True), (10, 10, True)}
    assert sorted(r["n_shingles"] for r in out if r["doc_id"] == 5) == [0, 76, 76]


def test_near_long_lists(spark, monkeypatch):
    """A cloud of near copies of which only some are linked, in blocks smaller than the cloud."""
    monkeypatch.setattr(near, "BLOCK", 8)
    monkeypatch.setattr(near, "SMALL", 3)
    base, out = prose(1, 200).split(), []
    r = np.random.default_rng(9)
    for i in range(60):
        w = list(base)
        for at in r.integers(0, 200, i % 12):
            w[at] = f"e{i}_{at}"
        out.append((i, " ".join(w)))
    want = near.brute_force(out)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in near.classes(spark.createDataFrame(out, "doc_id long, text string")).collect()}
    assert got == want and len({v[1] for v in want.values()}) > 2


def test_marked(spark):
    """Rows whose key the table has are marked, of others hardly any, and none for an empty table; other columns stay."""
    rows = spark.range(200_000).selectExpr("IF(id = 7, NULL, id) AS k", "CAST(id AS string) AS page", "id AS bits")
    out = store.marked(rows, "k", spark.range(0, 400_000, 20), "may")
    assert out.columns == ["k", "page", "bits", "may"] and out.where("bits % 20 = 0 AND NOT may").count() == 0
    assert out.count() == 200_000 and out.where("may").count() < 11_000 and out.where("k IS NULL AND page = '7'").count() == 1
    assert store.marked(rows, "k", spark.range(0), "may").where("may").count() == 0


def test_other_steps_drop_tokenizers():
    """What packing leaves in a worker is gone when a task of another step begins there."""
    PieceEncoder.of(queries._vocabulary("byte_bpe_50k.json"))
    list(store.slices(iter([pa.record_batch({"text": ["a"]})])))
    assert not PieceEncoder._known


def test_near_nulls_and_empty(spark, empty):
    assert near.classes(empty).collect() == []
    d = spark.createDataFrame([(None, "a b c"), (1, "a b c"), (1, "a b c"), (2, None)], "doc_id long, text string")
    assert sorted((r["doc_id"] or 0, r["kept"]) for r in near.classes(d).collect()) == [(0, True), (1, True), (1, True), (2, True)]


# 4


def test_coder_round_trip():
    r = np.random.default_rng(0)
    for ids in (np.zeros(0), np.array([5]), r.integers(0, 49408, 3000), np.array([1, 2, 3] * 900), np.full(2000, 49407), r.zipf(1.4, 5000) % 49408):
        head, payload = coder.encode(ids.astype(np.uint32), 49408)
        assert (coder.decode(head, payload) == ids).all()
    head, payload = coder.encode(np.array([1, 2, 3] * 900), 49408)
    assert len(payload) < 200
    with pytest.raises(ValueError):
        coder.decode(head, bytes([payload[0] ^ 1]) + payload[1:])


def test_coder_mixes_its_predictions():
    """Text-like ids take less room than their order-0 entropy, in which the list of new ids is counted; damage is found."""
    r = np.random.default_rng(3)
    words = [r.integers(0, 49408, r.integers(1, 4)) for _ in range(400)]
    follow = np.minimum(r.zipf(1.3, (400, 4)), 400) - 1
    at, ids = 0, []
    for _ in range(20_000):
        at = follow[at, r.integers(0, 4)] if r.random() < 0.5 else min(r.zipf(1.2), 400) - 1
        ids.append(words[at])
    ids = np.concatenate(ids).astype(np.uint32)
    share = np.unique(ids, return_counts=True)[1] / len(ids)
    head, payload = coder.encode(ids, 49408)
    assert (len(head) + len(payload)) * 8 < -(share * np.log2(share)).sum() * len(ids)
    assert (coder.decode(head, payload) == ids).all()
    with pytest.raises(ValueError):
        coder.decode(head[:40] + bytes([head[40] ^ 1]) + head[41:], payload)


def test_coder_takes_little_time():
    """Whole blocks and a short last one; both together took 4.8 microseconds an id when a step made up to three decisions on few lanes."""
    ids = np.minimum(np.random.default_rng(5).zipf(1.3, 1_000_000 - 77), 3000)
    began = time.process_time()
    head, payload = coder.encode(ids, 49408)
    assert (coder.decode(head, payload) == ids).all()
    assert time.process_time() - began < 3e-6 * len(ids)


def test_coder_carries_and_rare_ids():
    """Ids that surprise (a rare one where a candidate was trusted) and runs that end in carries come back, for any number of lanes."""
    r = np.random.default_rng(6)
    for n in (1, 1023, 1024, 1025, 5000, 70_000):
        for ids in (np.where(r.random(n) < 0.01, r.integers(0, 49408, n), 7), np.where(r.random(n) < 0.5, 49407, 0), r.integers(0, 300_000, n)):
            head, payload = coder.encode(ids, 300_000)
            assert (coder.decode(head, payload) == ids).all()


def test_files_of_repeated_and_null_ids(spark, tmp_path):
    path = queries._vocabulary("word_bpe_49k.json")
    rows = [(3, "a b", 1), (3, "a b", 1), (None, "x", 1), (None, None, 1), (1, "c", 1)]
    coder.write(spark.createDataFrame(rows, "doc_id long, text string, part int").repartition(3), path, 1, f"{tmp_path}/ids")
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in coder.read(spark, f"{tmp_path}/ids").collect())
    assert [d for _, d, _ in got] == [None, None, 1, 3, 3] and all(a + n == b for (a, _, n), (b, _, _) in zip(got, got[1:]))


def test_files_hold_every_document_in_order(spark, docs, rows, tmp_path):
    path = queries._vocabulary("word_bpe_49k.json")
    coder.write(docs, path, 1, f"{tmp_path}/ids")
    got = {r["doc_id"]: r for r in coder.read(spark, f"{tmp_path}/ids").collect()}
    e, at = PieceEncoder(path).tokenizer, 0
    for i, t, *_ in rows:
        ids = np.array(e.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (got[i]["start"], got[i]["n_tokens"], got[i]["ids"]) == (at, len(ids), ids.tobytes())
        at += len(ids)


def test_files_of_an_empty_table(spark, empty, tmp_path):
    coder.write(empty, queries._vocabulary("word_bpe_49k.json"), 1, f"{tmp_path}/none")
    assert coder.read(spark, f"{tmp_path}/none").collect() == []


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_are_the_tokenizers_ids(name):
    e = PieceEncoder(queries._vocabulary(name))
    texts = ["a  b", " a", "a ", "\n\na b", "don't I'll 's  '", "é́ a", "a\u0085b c", "", "  ", "<|endoftext|> a", "İ A B", "ß ẞ", "ΑΣ Σ", "x​ y", "a\r\n b", "日本 語 、", " ̈", "a　 b", "foo!!! bar 'll", "Größe\nÀÖ abc", "a\x1cb \x1d c", "1 23 4a"]
    for t in texts:
        ids, n = e.ids([t, t])
        want = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and n.tolist() == [len(want)] * 2


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_pieces_with_a_sign_are_learnt_once(name):
    """A word with a full stop or a comma behind it is not learnt again; where signs meet or something else follows, it is."""
    e = PieceEncoder(queries._vocabulary(name))
    texts = ["so wort wort. wort, wort wort,", "so wort.. wort., x. y", "so a.b wort.c wort,́ d", "so wort.\nwort,\n\nwort. ", "so Wort. WORT, wort.", "ж. wort, Größe. Größe,"]
    for t in texts:
        ids, n = e.ids([t, "", t])
        want = e.tokenizer.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want * 2 and n.tolist() == [len(want), 0, len(want)]
    e = PieceEncoder(queries._vocabulary(name))
    e.ids(texts[:1])
    assert len(e.places) == 2


# 5


def test_quality_is_learned_and_held_out(spark):
    r = np.random.default_rng(1)
    good = [(i, " ".join(r.choice(WORDS, 80)), 1) for i in range(0, 300)]
    bad = [(i, " | ".join(r.choice(WORDS, 60)) + " %%%", 0) for i in range(300, 420)]
    d = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.fit(d.where("doc_id % 3 <> 0").drop("quality"), d.select("doc_id", "quality"))
    got = quality.score(d.where("doc_id % 3 = 0"), model).collect()
    assert np.mean([(g["score"] >= 0.7) == (g["quality"] == 1) for g in got]) > 0.95


def test_quality_odd_rows(spark, docs, empty):
    none = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    clash = docs.withColumn("score", F.lit("mine"))
    got = quality.score(clash, none).collect()
    assert len(got) == docs.count() and all(g["score"] == "mine" and 0 <= g["_score"] <= 1 for g in got)
    assert quality.score(empty, none).collect() == []


def test_attention_gradient():
    """Backpropagation against finite differences, and a fit that learns its rows."""
    r = np.random.default_rng(3)
    x, bags, y = r.normal(size=(12, quality.PAIRS + quality.SHAPES)), np.array([3, 4, 5]), np.array([1.0, 0, 1])
    m = quality.Model()

    def loss():
        p = m._forward(x, bags)["score"]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, g in m.gradient(x, bags, y).items():
        for at in [tuple(r.integers(0, n) for n in g.shape) for _ in range(5)]:
            kept = m.p[name][at]
            m.p[name][at] = kept + 1e-5
            up = loss()
            m.p[name][at] = kept - 1e-5
            assert (up - loss()) / 2e-5 == pytest.approx(g[at], abs=1e-7, rel=1e-4), name
            m.p[name][at] = kept
    m = quality.Model().fit(x, bags, y, epochs=60, batch=3)
    assert ((m.score(x, bags) > 0.5) == (y > 0.5)).all()


def test_quality_keeps_columns(spark):
    rows = [(1, "a b c", 9), (1, "a b c", 9), (None, None, 8)]
    out = quality.score(spark.createDataFrame(rows, "doc_id long, text string, score int"), quality.Model()).collect()
    assert [r["score"] for r in out] == [9, 9, 8] and all(0 <= r["_score"] <= 1 for r in out) and out[0]["_score"] == out[1]["_score"]


# 6


def test_leaks(spark):
    item = prose(20, 60)
    changed = item.split()
    changed[58] = "other"
    b = spark.createDataFrame([(7, item), (8, "short item"), (9, None), (10, prose(21, 25))], "item_id long, text string")
    d = spark.createDataFrame([(1, prose(30, 33) + " " + item.upper() + " " + prose(31, 41)), (2, " ".join(changed)), (3, prose(32, 500)), (4, None), (5, ""), (6, prose(21, 25)), (7, item + " " + item)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["item_id"], r["start_word"]) for r in decontaminate.leaks(d, b).collect())
    assert got == [(1, 7, 33), (2, 7, 0), (6, 10, 0), (7, 7, 0), (7, 7, 60)]
    assert decontaminate.leaks(d.limit(0), b).collect() == [] and decontaminate.leaks(d, b.limit(0)).collect() == []


def test_leaks_of_every_similar_passage(spark):
    """Recall against brute force: rewritten blocks, scattered edits, insertions and truncation just above 0.8."""
    r = np.random.default_rng(11)
    fresh = iter(range(10**6))
    items, texts = [], []
    grams = lambda w: Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))

    def similar(a, b):
        a, b = grams(a), grams(b)
        return (a & b).total() / (a | b).total()

    for n in (20, 59, 100, 150, 200, 300):
        for nth in range(12):
            item = [f"i{x}" for x in r.integers(0, 5000, n)]
            change = {
                "block": lambda w, m: w[: n // 2 - m // 2] + [f"f{next(fresh)}" for _ in range(m)] + w[n // 2 - m // 2 + m :],
                "edits": lambda w, m: [f"f{next(fresh)}" if i in set(np.linspace(3, n - 4, m).astype(int)) else x for i, x in enumerate(w)],
                "insert": lambda w, m: w[: n // 3] + [f"f{next(fresh)}" for _ in range(m)] + w[n // 3 :],
                "cut": lambda w, m: w[: n - m],
                "behead": lambda w, m: w[m:],
            }
            for kind, f in change.items():
                passage = next(p for m in range(n // 2, -1, -1) if similar(item, p := f(item, m) if m else item) >= 0.8)
                alone = kind in ("cut", "behead") and nth % 2
                texts.append((len(texts), " ".join(passage if alone else [f"a{next(fresh)}" for _ in range(nth * 7)] + passage + [f"b{next(fresh)}" for _ in range(30)]), len(items)))
            items.append((len(items), " ".join(item)))
    d = spark.createDataFrame([t[:2] for t in texts], "doc_id long, text string").repartition(3)
    got = decontaminate.leaks(d, spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(i, x) for i, _, x in texts} == {(g["doc_id"], g["item_id"]) for g in got}
    for g in got:
        passage = texts[g["doc_id"]][1].split()[g["start_word"] : g["start_word"] + g["n_words"]]
        assert g["similarity"] == pytest.approx(similar(items[g["item_id"]][1].split(), passage)) and 0 <= g["distance"] <= 64


def test_block_tables_find_every_fingerprint_within_the_radius():
    r = np.random.default_rng(4)
    index = decontaminate.Index([(1, prose(40, 50).encode())])
    (prints, tables, *_), *_ = index.sizes.values()
    for _ in range(300):
        x = int(prints[0])
        for bit in r.choice(64, decontaminate.RADIUS, replace=False):
            x ^= 1 << int(bit)
        blocks = np.array([x], dtype=np.uint64).view(np.uint16)
        assert any(tables[k][blocks[k]] for k in range(4))


# 7


def test_substring(docs, rows):
    want = substring.brute_force([r[:2] for r in rows])
    cut = substring.cut(docs, substring.repeats(docs)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("sha"))
    assert {r["doc_id"]: (r["n_words"], r["n_removed"], r["sha"]) for r in cut.collect()} == want
    assert want[1][1] == 120 and want[6][1] == 70


@pytest.mark.parametrize("seed", range(3))
def test_substring_random(spark, seed):
    r = np.random.default_rng(seed)
    pool = [[f"{seed}p{k}w{i}" for i in range(90)] for k in range(4)]
    out = []
    for i in range(40):
        words = []
        for _ in range(r.integers(0, 5)):
            p = pool[r.integers(4)]
            a = r.integers(0, 40)
            words += p[a : a + r.integers(5, 60)] + [f"x{r.integers(9999)}" for _ in range(r.integers(0, 3))]
        out.append((i, " ".join(words)))
    d = spark.createDataFrame(out, "doc_id long, text string")
    got = {x["doc_id"]: (x["n_words"], x["n_removed"]) for x in substring.cut(d, substring.repeats(d, 30, 12)).collect()}
    assert got == {k: v[:2] for k, v in substring.brute_force(out, 30).items()}


def test_substring_keeps_columns(spark, empty, docs):
    assert substring.cut(empty, substring.repeats(empty)).collect() == []
    clash = docs.withColumns({"spans": F.lit(1), "n_words": F.lit("x"), "text_key": F.lit(3), "anchor": F.lit(2)})
    cut = substring.cut(clash, substring.repeats(clash))
    assert cut.columns == [*clash.columns, "_n_words", "n_removed", "kept_words"]
    plain = {r["doc_id"]: r["n_removed"] for r in substring.cut(docs, substring.repeats(docs)).collect()}
    for r in cut.collect():
        assert (r["spans"], r["n_words"], r["text_key"], r["anchor"]) == (1, "x", 3, 2) and r["n_removed"] == plain[r["doc_id"]]


def test_substring_repeated_ids(spark):
    """Of rows with one doc_id each loses its own repeats and nothing else."""
    passage, unique = prose(81, 70), prose(82, 100)
    rows = [(1, passage), (5, prose(83, 30) + " " + passage), (5, unique), (5, unique), (None, passage), (7, unique)]
    out = substring.cut(d := spark.createDataFrame(rows, "doc_id long, text string").repartition(3), substring.repeats(d)).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in out) == sorted([("1", 70, 0), ("5", 100, 70), ("5", 100, 0), ("5", 100, 0), ("None", 70, 0), ("7", 100, 100)])


def test_substring_hot_anchors(spark):
    """A passage in most documents, with many different extensions, goes by the broadcast joins."""
    passage = prose(84, 60)
    rows = [(i, prose(900 + i, i % 7) + " " + passage + " " + prose(1900 + i, i % 5)) for i in range(60)]
    want = {k: v[:2] for k, v in substring.brute_force(rows).items()}
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in substring.cut(d, substring.repeats(d)).collect()} == want


# 8


def test_shards_fit(docs, rows):
    limit = 3000
    got = sharding.shards(docs, limit).collect()
    assert len(got) == len(rows)
    sums = Counter()
    for g in got:
        sums[g["local_depth"], g["prefix"], g["row_prefix"]] += g["n_bytes"]
    for g in got:
        s = sums[g["local_depth"], g["prefix"], g["row_prefix"]]
        assert s == g["shard_bytes"] and (s <= limit or g["n_bytes"] == s)


def test_shards_split_one_hot_key(spark, empty):
    d = spark.createDataFrame([(1 if i % 3 else None, "x" * 10) for i in range(300)], "doc_id long, text string")
    got = sharding.shards(d, 200).collect()
    assert len(got) == 300 and max(g["shard_bytes"] for g in got) <= 200 and max(g["local_depth"] for g in got) > sharding.KEY_BITS
    assert sharding.shards(empty, 10).collect() == []


def test_shards_are_the_shortest_prefixes_that_fit(spark):
    """Against a plain walk through the bits; prefixes of several rounds, and keys in very different numbers."""
    import hashlib

    rows = [(i if i % 2 else 8, "x" * (i % 40)) for i in range(900)] + [(5, ""), (5, None)]
    h = {k: int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16) for k, _ in rows}
    limit = 120
    got = Counter((g["doc_id"], g["n_bytes"], g["local_depth"], g["prefix"]) for g in sharding.shards(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), limit).collect() if g["local_depth"] <= sharding.KEY_BITS)
    want = Counter()
    for k, t in rows:
        for depth in range(sharding.KEY_BITS + 1):
            own = [len(x or "") for j, x in rows if h[j] >> (sharding.KEY_BITS - depth) == h[k] >> (sharding.KEY_BITS - depth)]
            if sum(own) <= limit:
                want[k, len(t or ""), depth, h[k] >> (sharding.KEY_BITS - depth)] += 1
                break
    assert got == want and max(d for _, _, d, _ in want) > 0


def test_shards_write_each_row_once(spark, tmp_path, empty):
    rows = [(i % 3 if i % 5 else None, f"text {i % 7}", "p") for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, prefix string").repartition(4)
    sharding.write(d, 100, f"{tmp_path}/a")
    back = sharding.read(spark, f"{tmp_path}/a")
    assert Counter((r["doc_id"], r["text"], r["prefix"]) for r in back.collect()) == Counter(rows)
    assert back.groupBy("local_depth", "_prefix", "row_prefix").agg(F.sum(F.octet_length("text")).alias("n")).agg(F.max("n")).first()[0] <= 100
    sharding.write(empty, 100, f"{tmp_path}/b")
    assert sharding.read(spark, f"{tmp_path}/b", empty.schema).collect() == []


def test_shards_are_written_alike_with_and_without_a_directory(spark, tmp_path, monkeypatch):
    d = spark.createDataFrame([(i, "x" * (i % 30)) for i in range(400)], "doc_id long, text string").repartition(3)
    want = {(r["doc_id"], r["local_depth"], r["prefix"]) for r in sharding.shards(d, 200).collect()}
    for k, most in enumerate((100_000, 0)):
        monkeypatch.setattr(sharding, "DIRECTORY", most)
        sharding.write(d, 200, f"{tmp_path}/{k}")
        back = sharding.read(spark, f"{tmp_path}/{k}", d.schema).collect()
        assert {(r["doc_id"], r["local_depth"], r["prefix"]) for r in back} == want and len(back) == 400 and all(len(r["text"]) == r["doc_id"] % 30 for r in back)


def test_quality_learns_from_the_documents_at_hand(spark):
    """Labels of documents that are not there take no place in the sample."""
    d = spark.createDataFrame([(i, ("good words here " if i % 2 else "bad stuff there ") * 20) for i in range(60)], "doc_id long, text string")
    marks = spark.createDataFrame([(i, int(i % 2)) for i in range(3000)], "doc_id long, quality int")
    got = quality.score(d, quality.fit(d, marks, sample=60)).collect()
    assert np.mean([(r["score"] > 0.5) == bool(r["doc_id"] % 2) for r in got]) == 1


# 9


def test_packing(docs, rows):
    found = packing.pack(packing.pieces(docs, queries._vocabulary("byte_bpe_50k.json"), 2, with_ids=True)).collect()
    e = PieceEncoder(queries._vocabulary("byte_bpe_50k.json")).tokenizer
    at = Counter()
    for r in sorted(found, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at[r["sequence_id"]]
        at[r["sequence_id"]] += r["length"]
        assert zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes()) == r["ids_crc32"]
    assert max(at.values()) <= 1024
    for i, t, *_ in rows:
        own = sorted((r["piece"], r["start"], r["ids"]) for r in found if r["doc_id"] == i)
        assert sum((p[2] for p in own), []) == e.encode(t or "", add_special_tokens=False).ids + [2]
        assert all(len(p[2]) == 1024 for p in own[1:])


def test_packing_plan_is_tight():
    r = np.random.default_rng(6)
    counts = Counter(np.clip(r.geometric(1 / 300, 5000), 1, 1024).tolist())
    plan = packing.plan(counts, 1024)
    used = Counter()
    for bins, n in plan:
        assert sum(bins) <= 1024
        for b in bins:
            used[b] += n
    assert used == counts
    assert sum(n for _, n in plan) <= -(-sum(k * n for k, n in counts.items()) // 1024) + 1


@pytest.mark.parametrize("seed", range(4))
def test_packing_plan_is_no_worse_than_best_fit(seed):
    r = np.random.default_rng(seed)
    counts = Counter(np.clip(r.lognormal(5, 1.2, 800).astype(int), 1, 1024).tolist())
    rooms = Counter()
    bins = 0
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            room = min((k for k, n in rooms.items() if n and k >= length), default=None)
            bins += room is None
            if room is not None:
                rooms[room] -= 1
            rooms[(room or 1024) - length] += 1
    plan = packing.plan(counts, 1024)
    assert sum(n for _, n in plan) <= bins
    used = Counter()
    for items, n in plan:
        used.update({k: n * c for k, c in Counter(items).items()})
    assert used == counts


def test_packing_odd_rows(spark):
    """Repeated rows, null ids and columns called like those that are added."""
    rows = [(7, "a b c", "x", 5), (7, "a b c", "x", 5), (None, None, None, None), (None, "", "y", 1)]
    p = packing.pieces(spark.createDataFrame(rows, "doc_id long, text string, part string, offset int"), queries._vocabulary("byte_bpe_50k.json"), 2)
    out = packing.pack(p.withColumns({"offset": F.lit("mine"), "part": F.lit("p"), "n": F.lit(3)})).collect()
    assert len(out) == 4 and all((r["offset"], r["part"], r["n"]) == ("mine", "p", 3) for r in out)
    assert sorted(r["_offset"] for r in out)[0] == 0 and len({(r["sequence_id"], r["_offset"]) for r in out}) == 4


def test_packing_empty(empty):
    assert packing.pack(packing.pieces(empty, queries._vocabulary("byte_bpe_50k.json"), 2)).collect() == []


# 10


def test_recurrent_gradient():
    """Backpropagation through time against finite differences, in both directions."""
    r = np.random.default_rng(5)
    net = language.Network(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n = np.array([7, 5, 5, 2, 1])
    x = np.where(np.arange(language.SEGMENT)[None] < n[:, None], r.integers(97, 123, (5, language.SEGMENT)), 0)
    y = np.array([0, 1, 2, 1, 0])
    inside = np.arange(language.SEGMENT)[None] < n[:, None]

    def loss():
        p = net.positions(x, n)
        return -np.log(p[np.arange(5)[:, None], np.arange(language.SEGMENT)[None], y[:, None]])[inside].mean()

    for name, g in net.gradient(x, n, y).items():
        spots = np.argwhere(np.abs(g) > 1e-4)
        for at in map(tuple, spots[r.integers(0, len(spots), 5)]):
            kept = net.p[name][at]
            net.p[name][at] = kept + 1e-3
            up = loss()
            net.p[name][at] = kept - 1e-3
            assert (up - loss()) / 2e-3 == pytest.approx(g[at], rel=2e-2, abs=2e-5), name
            net.p[name][at] = kept


def test_language_learns_rare_ones_and_keeps_columns(spark):
    """A language of few documents is learned beside one of many."""
    r = np.random.default_rng(2)
    kinds = {"aa": ["the", "thing", "other", "with"], "bb": ["über", "größe", "und", "nicht"]}
    rows = [(i, " ".join(r.choice(kinds["aa" if i % 40 else "bb"], 12)), "aa" if i % 40 else "bb", "mine") for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")
    net = language.train(d, sample=20, steps=80)
    out = language.predict(d.unionByName(d.where("doc_id = 0")), net).collect()
    assert net.languages == ["aa", "bb"] and len(out) == 401 and all(r["score"] == "mine" and 0 <= r["_score"] <= 1 for r in out)
    assert np.mean([r["lang"] == r["lang_pred"] for r in out]) > 0.97


def test_language_reads_across_words():
    """The order of a text's words changes what the network sees; texts of any length are covered once, white space is one space."""
    r = np.random.default_rng(3)
    net = language.Network(["a", "b"])
    texts = [b"one two  three\tfour", b"four three two one", b"", b" \n ", b"x" * 1000, b"A" * language.CORE]
    x, length, first, end, doc = language.segments(texts)
    assert np.bincount(doc, end - first, 6).tolist() == [18, 18, 0, 0, 1000, language.CORE]
    assert bytes(x[0, : length[0]]) == b"one two three four" and (x[doc == 5][0, : language.CORE] == ord("a")).all()
    y = net.label(x, length, first, end)
    assert abs(y[0] - y[1]).max() > 1e-3 and np.allclose(y.sum(1), end - first, atol=1e-3)
    whole = bytes(r.integers(97, 123, 300).astype(np.uint8))
    x, length, first, end, _ = language.segments([whole])
    assert b"".join(bytes(v[a:b]) for v, a, b in zip(x, first, end)) == whole and length.max() == language.SEGMENT


def test_language(spark, docs, empty):
    r = np.random.default_rng(2)
    kinds = {"aa": ["the", "thing", "other", "with"], "bb": ["über", "größe", "und", "nicht"], "cc": ["ción", "que", "los", "para"]}
    d = spark.createDataFrame([(i, " ".join(r.choice(kinds[k], 12)), k) for i in range(240) for k in [list(kinds)[i % 3]]], "doc_id long, text string, lang string")
    net = language.train(d.where("doc_id % 4 <> 0"), steps=120)
    got = language.predict(d.where("doc_id % 4 = 0"), net).collect()
    assert np.mean([g["lang"] == g["lang_pred"] for g in got]) > 0.95 and all(0 <= g["score"] <= 1 for g in got)
    odd = {r["doc_id"]: r for r in language.predict(docs, net).collect()}
    assert all(odd[i]["lang_pred"] == "und" and odd[i]["score"] == 0 for i in (7, 8, 9, 15)) and odd[0]["lang_pred"] in kinds
    assert language.predict(empty, net).collect() == []
    assert {r["lang_pred"] for r in language.predict(docs, language.train(empty)).collect()} == {"und"}


def test_recurrent_gradient_of_a_small_network():
    """Backpropagation through time against finite differences."""
    net = language.Network(["a", "b"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    r = np.random.default_rng(8)
    x = np.zeros((3, language.SEGMENT), dtype=np.uint8)
    n = np.array([5, 3, 2])
    for i, m in enumerate(n):
        x[i, :m] = r.integers(97, 110, m)
    y = np.array([0, 1, 1])

    def loss():
        p = net.positions(x, n)
        return -sum(np.log(p[i, t, y[i]]) for i in range(3) for t in range(n[i])) / n.sum()

    seen = {}

    grad = net.gradient(x, n, y)
    for k in ("Rf", "Rb", "Ef", "Eb"):
        for _ in range(4):
            i = tuple(r.integers(0, s) for s in net.p[k].shape) if k[0] == "R" else (int(r.integers(0, net.p[k].shape[0])), int(x[0, 1]))
            old = net.p[k][i]
            net.p[k][i] = old + 1e-4
            up = loss()
            net.p[k][i] = old - 1e-4
            down = loss()
            net.p[k][i] = old
            seen[k, i] = ((up - down) / 2e-4, grad[k][i])
    for a, b in seen.values():
        assert a == pytest.approx(b, abs=2e-4)
