"""Importance resampling towards a target's distribution, by hashed word features.

Identical texts are collapsed first, by grouping whole texts: features and weight are made once for each text, counts are
multiplied by how many documents have it, and the weight is joined back to those. Only then comes the noise of each
document, which makes the highest scores a sample without replacement in proportion to the weights (Gumbel top-k).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import join_counted, materialize, slices
from .words import OTHER, Words, chunks, encoded

BUCKETS = 10_000
_KEY = "sha2(coalesce({0}, ''), 256)"


def features(texts: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(key, n, n_features, bucket, times) of texts (key, n, text): how often the text has words of each bucket.

    Words are runs of digits, a-z and characters beyond ASCII after A-Z were lower-cased; a word's bucket is the CRC-32 of
    its bytes modulo ``buckets``.
    """

    def count(batches):
        for batch in slices(batches):
            for at, some in chunks(encoded(batch.column("text").to_pylist())):
                words = Words([t.lower() for t in some], False, OTHER)
                _, first, code = np.unique(words.hash, return_index=True, return_inverse=True)
                raw, start, end = words.raw, words.start[first].tolist(), words.end[first].tolist()
                of = np.fromiter((zlib.crc32(raw[a:b]) % buckets for a, b in zip(start, end)), dtype=np.int64, count=len(first))
                key, times = np.unique(words.doc * buckets + of[code], return_counts=True)
                doc, bucket = np.divmod(key, buckets)
                offsets = pa.array(np.searchsorted(doc, np.arange(len(some) + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x.astype(np.int32))) for x in (bucket, times)]
                own = [batch.column(c).slice(at, len(some)) for c in ("key", "n")]
                yield pa.RecordBatch.from_arrays([*own, pa.array(np.diff(words.first).astype(np.int64)), *lists], ["key", "n", "n_features", "bucket", "times"])

    return texts.select("key", "n", "text").mapInArrow(count, "key string, n long, n_features long, bucket array<int>, times array<int>")


def _collapsed(docs: DataFrame, buckets: int, name: str) -> DataFrame:
    """features() of the different texts; null counts as empty."""
    texts = docs.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("n")).withColumn("key", F.expr(_KEY.format("text")))
    return materialize(features(texts, buckets), name)


def _histogram(texts: DataFrame, buckets: int) -> np.ndarray:
    """Features of all documents in each bucket; a task sends one row for each bucket at most."""

    def add(batches):
        total = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            bucket, times = (batch.column(c).flatten().to_numpy() for c in ("bucket", "times"))
            size = batch.column("bucket").value_lengths().to_numpy()
            np.add.at(total, bucket, times * np.repeat(batch.column("n").to_numpy(), size))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], ["bucket", "times"])

    found = texts.select("n", "bucket", "times").mapInArrow(add, "bucket int, times long").groupBy("bucket").agg(F.sum("times").alias("times")).toArrow()
    out = np.zeros(buckets, dtype=np.int64)
    out[found["bucket"].to_numpy()] = found["times"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1) (S + buckets) / ((s + 1) (T + buckets)))) of each bucket."""
    n, s_all, t_all = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + n) / ((s + 1.0) * (t_all + n)))) for s, t in zip(source.tolist(), target.tolist())], dtype=np.int64)


def weighted(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(key, n, n_features, weight): the floored mean gain of each text's features, 0 without any."""

    def mean(batches):
        for batch in batches:
            value = gain[batch.column("bucket").flatten().to_numpy()] * batch.column("times").flatten().to_numpy()
            end = np.cumsum(batch.column("bucket").value_lengths().to_numpy())
            total = np.diff(np.concatenate([[0], np.concatenate([[0], np.cumsum(value)])[end]]))
            weight = total // np.maximum(1, batch.column("n_features").to_numpy())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "n", "n_features")), pa.array(weight.astype(np.int64))], ["key", "n", "n_features", "weight"])

    return texts.mapInArrow(mean, "key string, n long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, seed: int = 2024, least: int = 20, buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_features, weight, score, rank) of every row of docs (doc_id, text); target: (text).

    weight: how much more often the target has the text's words, see gains(). score: weight plus floor(-1000 ln(-ln(u))), with
    u = (h + 0.5) / 2^32 and h the first 32 bits of sha256("<seed>:<doc_id>"). Of the N rows with ``least`` words or more,
    floor(percent N / 100) with the highest scores are drawn, equal scores by smaller doc_id; rank counts them from 1 and is
    null for the others.

    Null and empty texts have no features and weight 0. Rows with null doc_id have null score, count in the statistics and
    are not drawn. Repeated rows are rows of their own; those of one doc_id and text have the same score, and which of them
    comes first is arbitrary. An empty target or empty docs count as no features. Other columns take no part.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = _collapsed(docs, buckets, "features")
    gain = gains(_histogram(texts, buckets), _histogram(_collapsed(target.select("text"), buckets, "target-features"), buckets))
    weights = materialize(weighted(texts, gain), "weights")
    keyed = materialize(docs.select("doc_id", F.expr(_KEY.format("text")).alias("key")), "text-keys")
    scored = join_counted(keyed, weights, ["key"])
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = scored.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"))
    scored = materialize(scored.withColumn("fit", (F.col("n_features") >= least) & F.col("score").isNotNull()), "scores")
    return _drawn(scored, percent)


def _drawn(scored: DataFrame, percent: int) -> DataFrame:
    """The rows that are fit get ranks. The driver sees one row for each score (whole numbers of a few ten thousand) and for
    each partition; only rows that can be drawn are sorted, by ranges."""
    counts = scored.where("fit").groupBy("score").agg(F.count("*").alias("n")).toArrow()
    score, n = counts["score"].to_numpy(), counts["n"].to_numpy()
    order = np.argsort(-score)
    upto = np.cumsum(n[order])
    wanted = percent * int(upto[-1]) // 100 if len(upto) else 0
    none = scored.withColumn("rank", F.lit(None).cast("long"))
    columns = ["doc_id", "n_features", "weight", "score", "rank"]
    if not wanted:
        return none.select(columns)
    bar = int(score[order][np.searchsorted(upto, wanted)])
    high = F.col("fit") & (F.col("score") >= bar)
    top = scored.where(high).withColumn("row", F.monotonically_increasing_id())
    top = top.repartitionByRange(F.desc("score"), "doc_id", "row").sortWithinPartitions(F.desc("score"), "doc_id", "row")
    top = materialize(top.withColumn("place", F.monotonically_increasing_id()), "drawn")
    part = F.shiftright("place", 33)
    sizes = sorted(top.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect())
    before = dict(zip((p for p, _ in sizes), np.cumsum([0, *(c for _, c in sizes)]).tolist()))
    starts = F.broadcast(top.sparkSession.createDataFrame(list(before.items()), "part long, before long"))  # one row a partition
    rank = F.col("before") + F.col("place").bitwiseAND((1 << 33) - 1) + 1
    top = top.withColumn("part", part).join(starts, "part").withColumn("rank", F.when(rank <= wanted, rank))
    return top.select(columns).unionByName(none.where(F.coalesce(~high, F.lit(True))).select(columns))
