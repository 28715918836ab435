"""Every stage of the pipeline against a brute-force version, on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import near, store, substring

WORDS = [f"w{i}" for i in range(300)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("tables"))
    item = prose(900, 40)
    texts = [prose(i, 90) for i in range(60)] + [" | ".join(prose(100 + i, 60).split()) for i in range(30)]
    texts += [texts[0], texts[1] + " tail", prose(200, 40) + " " + item + " " + prose(201, 40), prose(202, 20) + " " + " ".join(texts[2].split()[:55]) + " " + prose(203, 20), "", None]
    rows = [(i, t, "en", None, None if t is None else len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(not 60 <= i < 90), 0) for i in range(90)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_quality_filter(spark, docs, folder):
    kept = {r["doc_id"] for r in corpus_pipeline.quality_filter(spark, docs, folder).collect()}
    assert not kept & set(range(60, 90)) and set(range(60)) <= kept and {90, 91, 92, 93} <= kept


def test_near_dedup(spark, docs, folder):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {d for d, v in near.brute_force(rows, percent=80).items() if v[2]}
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, folder).collect()} == want and not want & {90, 91}


def test_near_dedup_shuffles_few_texts(spark, docs, folder, monkeypatch):
    """Whole texts are told apart before a shuffle: only those that may go, or whose sets are compared, are moved."""
    seen, marked = [], store.marked
    for module in (store, near):
        monkeypatch.setattr(module, "marked", lambda *a: seen.append(marked(*a)) or seen[-1])
    assert corpus_pipeline.near_dedup(spark, docs, folder).count() == docs.count() - 2
    moved = [d.where("may").count() for d in seen if "text" in d.columns]
    assert len(moved) == 4 and max(moved) < 10


def test_substring_dedup(spark, docs, folder):
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    want = {d: v[0] - v[1] for d, v in substring.brute_force(rows).items()}
    got = corpus_pipeline.substring_dedup(spark, docs, folder)
    assert got.columns == docs.columns
    for r in got.collect():
        assert len((r["text"] or "").split()) == want[r["doc_id"]] and r["n_chars"] == (None if r["text"] is None else len(r["text"]))


def test_decontamination(spark, docs, folder):
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in corpus_pipeline.decontamination(spark, docs, folder).collect()}
    assert gone == {92}


NAMES = ["score", "spans", "n_words", "n_removed", "kept_words", "text_key", "owner", "row", "part", "sequence_id", "ids", "item_id", "kept", "component_id", "held_out", "value", "n"]


def test_stages_keep_clashing_columns(spark, docs, folder):
    """Columns that are called like those of the operators come through with their own values."""
    more = docs.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in NAMES})
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, more, folder)
        assert out.columns == more.columns
        rows = out.collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in NAMES), name
        assert {r["doc_id"] for r in rows} == {r["doc_id"] for r in stage(spark, docs, folder).collect()}


def test_stages_with_repeated_ids_nulls_and_long_texts(spark, docs, folder):
    """Rows of one doc_id keep their own texts; rows with null doc_id stay; a long text is a text like others."""
    passage, other = prose(500, 70), prose(501, 100)
    rows = [(4, passage, "en", None, 1), (5, prose(502, 20) + " " + passage, "en", None, 1), (5, other, None, "x", 1), (5, other, None, "x", 1), (None, passage, None, None, 1), (6, prose(503, 30_000), "en", None, 1), (7, None, None, None, None)]
    odd = spark.createDataFrame(rows, docs.schema)
    assert odd.count() == len(corpus_pipeline.near_dedup(spark, odd, folder).collect())
    cut = [(r["doc_id"], len((r["text"] or "").split())) for r in corpus_pipeline.substring_dedup(spark, odd, folder).collect()]
    assert sorted(cut, key=str) == sorted([(4, 70), (5, 20), (5, 100), (5, 100), (None, 70), (6, 30_000), (7, 0)], key=str)
    assert corpus_pipeline.decontamination(spark, odd, folder).count() == len(rows)
    assert corpus_pipeline.quality_filter(spark, odd, folder).count() <= len(rows)
    packed = corpus_pipeline.pack_sequences(spark, odd, folder).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r["doc_id"] for r in packed} == {None, 4, 5, 6, 7} and {r["n"] for r in packed if r["doc_id"] == 7} == {1}


def test_stages_of_empty_tables(spark, docs, folder):
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).collect() == []


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    ids = {r["doc_id"] for r in out.select("doc_id").distinct().collect()}
    assert set(range(60)) <= ids and not ids & (set(range(60, 90)) | {90, 91, 92}) and 93 in ids
    assert out.groupBy("sequence_id").sum("length").agg({"sum(length)": "max"}).first()[0] <= 1024
