"""The numbered queries, their SQL where SQL can express them, and nothing else."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import coder, ctw, decontaminate, impacts, language, metric_join, near, packing, quality, resampling, search, sharding, store, substring


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remainder(n: int):
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ctw_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return ctw.scores(docs.select("doc_id", "text", (_remainder(7) == 2).alias("held_out")))


def op2_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: every benchmark item whose item_id is divisible by 20, against all documents."""
    queries = _table(spark, sf_dir, "benchmark").where("item_id % 20 = 0").select(F.col("item_id").alias("query_id"), "text")
    return search.top_k(_table(spark, sf_dir, "documents"), queries, k=10).withColumn("score", F.round("score", 6))


def op2_bm25_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Queries: the whole text of every document whose doc_id is divisible by 20, against all documents."""
    docs = _table(spark, sf_dir, "documents")
    queries = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), "text")
    return search.top_k(docs, queries, k=10).withColumn("score", F.round("score", 6))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(_table(spark, sf_dir, "documents"), words=5, percent=85)


def op4_range_coded_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.new_path(spark, "ids")
    coder.write(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1, path=path)
    return coder.read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op5_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", (_remainder(4) == 2).alias("held_out"))
    model = quality.fit(docs.where("NOT held_out"), _table(spark, sf_dir, "labels"))
    scored = quality.score(docs, model)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op6_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = substring.cut(docs, substring.repeats(docs, window=50))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_words").cast("binary"), 256).alias("kept_sha256"))


SHARD_BYTES = 1 << 20


def op8_extendible_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the documents to shards of a megabyte at most and reads them back."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = store.new_path(spark, "shards")
    sharding.write(docs, SHARD_BYTES, path)
    rows = sharding.read(spark, path, docs.schema).withColumn("n_bytes", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")).drop("text")
    sums = rows.groupBy(*sharding.SHARD).agg(F.sum("n_bytes").alias("shard_bytes"))
    return rows.join(sums, list(sharding.SHARD)).select("doc_id", "n_bytes", *sharding.SHARD, "shard_bytes")


def op9_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return packing.pack(packing.pieces(docs, _vocabulary("byte_bpe_50k.json"), end_id=2))


def op10_bigru_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (_remainder(3) == 1).alias("held_out"))
    net = language.train(docs.where("NOT held_out"))
    return language.predict(docs.select("doc_id", "held_out", "text"), net).select("doc_id", "held_out", "lang_pred", "score")


def op11_metric_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with the number of its links at a cosine of 0.95 or more, and its component."""
    return metric_join.links(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op12_sparse_product_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return impacts.rank(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=20)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its weight towards the benchmark's words, a tenth of them drawn."""
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), percent=10, seed=2024)


QUERIES = {
    "op1_ctw_scores": op1_ctw_scores,
    "op2_bm25_search": op2_bm25_search,
    "op2_bm25_documents": op2_bm25_documents,
    "op3_minhash_dedup": op3_minhash_dedup,
    "op4_range_coded_ids": op4_range_coded_ids,
    "op5_mil_quality": op5_mil_quality,
    "op6_simhash_decontamination": op6_simhash_decontamination,
    "op7_substring_dedup": op7_substring_dedup,
    "op8_extendible_shards": op8_extendible_shards,
    "op9_best_two_fit_packing": op9_best_two_fit_packing,
    "op10_bigru_language": op10_bigru_language,
    "op11_metric_range_join": op11_metric_range_join,
    "op12_sparse_product_search": op12_sparse_product_search,
    "op13_importance_resampling": op13_importance_resampling,
}

ORACLE_SQL: dict[str, str] = {
    "op2_bm25_search": f"SELECT query_id, rank, doc_id, round(score, 6) AS score FROM ({search.oracle(10)})",
    "op8_extendible_shards": sharding.oracle(SHARD_BYTES),
    "op12_sparse_product_search": impacts.oracle(20),
}
