"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again by the next.

All but the last return the columns of documents; n_chars follows the text where a stage changes it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import decontaminate, near, packing, quality, store, substring


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model scores below 0.7 go. It learns from the labels of the documents at hand. Repeated rows
    are each scored by their own text, null and empty texts like others."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col(store.free("score", docs.columns)) >= 0.7).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 or more of five-word shingles, the smallest doc_id stays, with all
    rows that have it. Rows with null doc_id and texts without a word stay."""
    gone = store.materialize(near.classes(docs, words=5, percent=80).where("NOT kept").select("doc_id").distinct(), "gone")
    may = store.free("may", docs.columns)
    rows = store.marked(docs, "doc_id", gone, may)  # whole texts are shuffled only where the row may go
    left = rows.where(F.col(may)).join(gone, "doc_id", "left_anti").select(*docs.columns)
    return rows.where(~F.col(may)).select(*docs.columns).unionByName(left)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words covered by a 50-word passage that also starts in a document with a smaller doc_id go; documents stay, if
    need be empty. Rows with null doc_id stay whole, repeated rows lose the same words."""
    cut = substring.cut(docs, substring.repeats(docs, window=50)).select(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else cut


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage similar to a benchmark item (0.8 or more) go, with all rows of their doc_id; rows with
    null doc_id stay."""
    found = decontaminate.leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's tokens, in pieces that fill sequences of 1024; a null or empty text is the end id alone. Rows are
    packed one by one, also repeated ones and those with null doc_id."""
    import public_tokenizers

    return packing.pack(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=2))


STAGES = [
    ("quality_filter", quality_filter),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("pack_sequences", pack_sequences),
]

#: A trained model and a tokenizer are not SQL; tests/llm holds every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = store.new_path(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
