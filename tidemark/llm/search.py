"""Exact top-k search: BM25 over inverted indexes with block-max WAND.

Documents are indexed in shards of bounded text size. Statistics (documents, lengths, document frequencies of the
queries' words) are summed over all shards first, so that a shard scores as the whole collection would, and the best k of
all shards' best k are the best k. Within a shard the maxima of posting blocks decide which documents can still enter the
best k; only those are scored, whether a query has two words or a thousand.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from .store import materialize, slices
from .words import SPACE, Words, chunks, encoded

SHARD = 8 << 20  #: bytes of text
BLOCK = 4  #: documents whose postings share a maximum
QUERIES = 2_000  #: queries that are broadcast at once
_INDEX = "shard long, doc_id binary, length binary, terms binary, starts binary, docs binary, counts binary, n_docs long, n_filled long, n_words long"


def _pack(a: np.ndarray) -> bytes:
    return zlib.compress(a.tobytes(), 1)


def _unpack(b: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(b), dtype=kind)


def index(docs: DataFrame, apart: np.ndarray = SPACE) -> DataFrame:
    """One row per shard: its documents in ascending doc_id order, and each word's postings (place and count).

    Words are runs of bytes that are not ``apart``, A-Z lower-cased, told apart by 64-bit hashes. Null and empty texts are
    documents without words (n_filled counts the others); rows with null doc_id are not indexed; repeated rows are documents of
    their own.
    """

    def build(batches):
        part, nth, hashes, owners, ids, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            nonlocal nth
            doc_id = np.array(ids, dtype=np.int64)
            order = np.argsort(doc_id, kind="stable")
            rank = np.empty(len(order), dtype=np.int64)
            rank[order] = np.arange(len(order))
            h, d = np.concatenate(hashes), rank[np.concatenate(owners)]
            terms, code = np.unique(h, return_inverse=True)
            key, count = np.unique(code.astype(np.int64) * len(order) + d, return_counts=True)
            term, doc = np.divmod(key, max(1, len(order)))
            starts = np.searchsorted(term, np.arange(len(terms) + 1)).astype(np.uint32)
            length = np.bincount(d, minlength=len(order)).astype(np.uint32)
            row = [(part << 32) | nth, *map(_pack, (doc_id[order], length, terms, starts, doc.astype(np.uint32), count.astype(np.uint32))), len(order), int(np.count_nonzero(length)), len(h)]
            nth += 1
            kinds = [pa.int64(), *[pa.binary()] * 6, *[pa.int64()] * 3]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _INDEX.split(", ")])

        for batch in slices(batches):
            found = batch.column("doc_id").to_pylist()
            for at, texts in chunks(encoded(batch.column("text").to_pylist())):
                words = Words(texts, True, apart)
                hashes.append(words.hash)
                owners.append(words.doc + len(ids))
                ids.extend(found[at : at + len(texts)])
                size += len(words.raw)
                if size >= SHARD:
                    yield flush()
                    hashes, owners, ids, size = [], [], [], 0
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL").mapInArrow(build, _INDEX)


class Shard:
    def __init__(self, row: dict):
        self.doc_id, self.length = _unpack(row["doc_id"], np.int64), _unpack(row["length"], np.uint32)
        self.terms, self.starts = _unpack(row["terms"], np.uint64), _unpack(row["starts"], np.uint32)
        self.docs, self.counts = _unpack(row["docs"], np.uint32), _unpack(row["counts"], np.uint32)

    def places(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the terms are in ``self.terms``, and whether they are."""
        at = np.minimum(np.searchsorted(self.terms, terms), max(0, len(self.terms) - 1))
        return at, self.terms[at] == terms if len(self.terms) else np.zeros(len(terms), bool)

    def df(self, terms: np.ndarray) -> np.ndarray:
        at, hit = self.places(terms)
        return np.where(hit, self.starts[np.minimum(at + 1, len(self.starts) - 1)] - self.starts[at], 0).astype(np.int64)


class Pruned:
    """Block-max WAND over one shard, for all its documents at once.

    A list's postings come in blocks, those of BLOCK neighbouring documents, with the largest score of each. Added up over a
    query's lists, the maxima of a document's blocks bound its score; lists without a posting there add nothing. Documents are scored
    in the order of their bounds, by the words that they have, until the next bound is below the k-th best score: no other
    document can enter the best k."""

    def __init__(self, shard: Shard, mean: float, k1: float, b: float):
        """Each posting's score is for a word of weight 1."""
        self.shard, n = shard, len(shard.doc_id)
        part = shard.counts * (k1 + 1) / (shard.counts + k1 * (1 - b + b * shard.length[shard.docs] / mean))
        size = np.diff(shard.starts.astype(np.int64))
        term = np.repeat(np.arange(len(size)), size)
        piece = shard.docs // BLOCK
        start = np.flatnonzero((np.diff(term, prepend=-1) != 0) | (np.diff(piece.astype(np.int64), prepend=-1) != 0))
        self.block = np.searchsorted(term[start], np.arange(len(size) + 1))  # first block of each list
        self.most = np.maximum.reduceat(part, start) if len(start) else part
        self.piece = piece[start].astype(np.int64)
        order = np.argsort(shard.docs, kind="stable")
        self.term, self.part = term[order], part[order]
        self.begin = np.searchsorted(shard.docs[order], np.arange(n + 1))
        self.weight = np.zeros(len(size))

    def bounds(self, at: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """No document scores more than this. at: lists."""
        n = len(self.shard.doc_id)
        many = self.block[at + 1] - self.block[at]
        b = _runs(self.block[at], many)
        return np.bincount(self.piece[b], self.most[b] * np.repeat(weights, many), -(-n // BLOCK)).repeat(BLOCK)[:n]

    def scores(self, docs: np.ndarray) -> np.ndarray:
        size = self.begin[docs + 1] - self.begin[docs]
        p = _runs(self.begin[docs], size)
        total = np.concatenate([[0.0], self.weight[self.term[p]] * self.part[p]])
        return np.round(np.add.reduceat(total, np.cumsum(size) - size + 1), 9) if len(p) else np.zeros(len(docs))

    def top(self, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[float, int]]:
        """(score, doc_id) of the best k, by scores rounded to nine places, equal ones by smaller doc_id."""
        at, hit = self.shard.places(terms)
        at, weights = at[hit], weights[hit]
        if not len(at):
            return []
        bound = self.bounds(at, weights) + 1e-6  # for rounding
        self.weight[at] = weights
        order = np.argsort(-bound, kind="stable")
        doc, score = np.zeros(0, np.int64), np.zeros(0)
        done, step, bar = 0, 4 * k, 0.0
        while done < len(order) and bound[order[done]] >= bar:
            some = order[done : done + step]
            some = np.sort(some[(bound[some] >= bar) & (self.begin[some + 1] > self.begin[some])])
            doc, score = np.concatenate([doc, some]), np.concatenate([score, self.scores(some)])
            best = np.lexsort((self.shard.doc_id[doc], -score))[:k]
            doc, score = doc[best], score[best]
            done, step = done + step, 2 * step
            bar = score[-1] if len(score) == k else 0.0
        self.weight[at] = 0
        return [(float(s), int(d)) for s, d in zip(score, self.shard.doc_id[doc]) if s > 0]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The places start[i], start[i] + 1, ..., size[i] of them, one run after the other."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def top_k(docs: DataFrame, queries: DataFrame, k: int = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, rank, doc_id, score): the k best documents of each query (query_id, text) by BM25, exactly.

    Weight of a word: log(1 + (N - df + 0.5) / (df + 0.5)) times its count in the query. Scores are compared after rounding
    to nine places, equal ones by smaller doc_id. Documents that share no word with a query are not listed. Null or blank
    queries have no row. Documents with null doc_id are left out, null and empty texts count as documents without words, rows that
    repeat a doc_id compete one by one; other columns take no part. The queries are broadcast, QUERIES at a time.
    """
    shards = materialize(index(docs), "index")
    n, words = shards.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    rounds = max(1, -(-queries.count() // QUERIES))
    out = None
    for r in range(rounds):
        some = queries.where(F.pmod(F.xxhash64("query_id", "text"), F.lit(rounds)) == r) if rounds > 1 else queries
        rows = [(q, *np.unique(Words(encoded([t]), lower=True).hash, return_counts=True)) for q, t in some.select(F.col("query_id").cast("long"), "text").collect() if t is not None]
        asked = np.unique(np.concatenate([h for _, h, _ in rows] or [np.zeros(0, np.uint64)]))

        def count(batches, asked=asked):
            for batch in slices(batches, 1):
                for row in batch.to_pylist():
                    df = Shard(row).df(asked)
                    yield pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)[df > 0]), pa.array(df[df > 0])], ["term", "df"])

        df = shards.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # words of QUERIES queries
        f = np.zeros(len(asked))
        f[np.searchsorted(asked, df["term"].to_numpy().view(np.uint64))] = df["df"].to_numpy()
        worth = np.log(1 + (n - f + 0.5) / (f + 0.5))
        plans = []
        for q, h, c in rows:
            at = np.searchsorted(asked, h)
            at, c = at[f[at] > 0], c[f[at] > 0]
            plans.append((q, asked[at], worth[at] * c))
        plans = docs.sparkSession.sparkContext.broadcast(plans)
        mean = max(1e-9, words / n) if n else 1.0

        def search(batches, plans=plans, mean=mean):
            for batch in slices(batches, 1):
                for row in batch.to_pylist():
                    shard = Pruned(Shard(row), mean, k1, b)
                    hits = [(q, d, s) for q, terms, weights in plans.value for s, d in shard.top(terms, weights, k)]
                    if hits:
                        yield pa.RecordBatch.from_arrays([pa.array([h[i] for h in hits], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))], ["query_id", "doc_id", "score"])

        found = shards.mapInArrow(search, "query_id long, doc_id long, score double")
        out = found if out is None else out.unionByName(found)
    out = out.withColumn("score", F.round("score", 9))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "doc_id", "score")


def oracle(k: int = 10, where: str = "item_id % 20 = 0", k1: float = 1.2, b: float = 0.75) -> str:
    """The same in DuckDB, every document scored."""
    split = "regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+')"
    return f"""
    WITH d AS (SELECT doc_id, unnest({split.format("text")}) AS w FROM documents), q AS (SELECT item_id AS query_id, unnest({split.format("text")}) AS w FROM benchmark WHERE {where}),
    tf AS (SELECT doc_id, w, count(*) AS tf FROM d WHERE w IN (SELECT w FROM q) GROUP BY ALL), ql AS (SELECT query_id, w, count(*) AS qf FROM q GROUP BY ALL),
    len AS (SELECT doc_id, count(*) AS dl FROM d GROUP BY 1), g AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT count(*) FROM d) AS total),
    df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
    s AS (SELECT query_id, doc_id, round(sum(qf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * {k1 + 1} / (tf + {k1} * ({1 - b} + {b} * dl / (total / n)))), 9) AS score
          FROM ql JOIN tf USING (w) JOIN df USING (w) JOIN len USING (doc_id), g GROUP BY 1, 2)
    SELECT query_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {k}"""
