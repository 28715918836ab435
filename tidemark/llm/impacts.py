"""Ranked lexical search as a blocked sparse matrix product.

The left matrix has a row for each item (how often it has each term), the right one a row for each term (its integer impact
on each document). The right matrix is kept in column blocks of bounded text size. A block's product is made row by row as
Gustavson does: an item's row is the merger of the term rows it asks for, each times its multiplicity, added up in 64-bit
integers. Of each block's row the k best stay; they are merged block by block within a task and then between tasks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .search import Shard, index
from .store import materialize, slices
from .words import OTHER, Words, encoded

ITEMS = 2_000  #: items that are broadcast at once
ITEM_BYTES = 16 << 20  #: and about how much of their text at most; a longer item goes alone


def _best(score: np.ndarray, doc_id: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, equal ones by smaller doc_id."""
    some = np.arange(len(score))
    if len(score) > k:
        some = np.flatnonzero(score >= np.partition(score, -k)[-k])
    return some[np.lexsort((doc_id[some], -score[some]))][:k]


class Product:
    """Items (terms, multiplicities) times blocks, with the k best of every item's row so far."""

    def __init__(self, items: list[tuple[np.ndarray, np.ndarray]], worth: np.ndarray, terms: np.ndarray, n: int, total: int, k: int):
        """terms: sorted; worth: each one's weight. n, total: documents with terms and their terms."""
        self.items, self.worth, self.terms, self.n, self.total, self.k = items, worth, terms, n, total, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]

    def add(self, block: Shard) -> None:
        at, hit = block.places(self.terms)
        start = np.where(hit, block.starts[at].astype(np.int64), 0)
        size = np.where(hit, block.starts[np.minimum(at + 1, len(block.starts) - 1)].astype(np.int64) - start, 0)
        m = 100 - 25 + 25 * block.length.astype(np.int64) * self.n // max(1, self.total)
        rows: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for i, (terms, times) in enumerate(self.items):
            total = np.zeros(len(block.doc_id), dtype=np.int64)
            for t, c in zip(terms.tolist(), times.tolist()):
                if not size[t]:
                    continue
                if t not in rows:
                    docs = block.docs[start[t] : start[t] + size[t]]
                    tf = block.counts[start[t] : start[t] + size[t]].astype(np.int64)
                    rows[t] = docs, self.worth[t] * (1_000_000_000 * tf // (1000 * tf + 12 * m[docs]))
                docs, impact = rows[t]
                total[docs] += impact if c == 1 else c * impact  # a row has each document once
            some = np.flatnonzero(total)
            some = some[_best(total[some], block.doc_id[some], self.k)]
            score, doc_id = (np.concatenate(x) for x in zip(self.found[i], (total[some], block.doc_id[some])))
            keep = _best(score, doc_id, self.k)
            self.found[i] = score[keep], doc_id[keep]


def _rounds(items: DataFrame) -> int:
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    return max(1, -(-n // ITEMS), -(-size // ITEM_BYTES))


def rank(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """(item_id, rank, doc_id, score): the k documents (doc_id, text) with the highest scores above 0 for each item (item_id, text).

    Terms are runs of ASCII letters, digits and all characters beyond ASCII, A-Z lower-cased. With N documents that have a
    term, L terms in all and n in one document, a term that df documents have weighs w = floor(1000 ln((2 N + 2) / (2 df + 1)))
    and adds w ((10^9 tf) div (1000 tf + 12 m)), m = 75 + (25 n N) div L, each time the item has it. Equal scores go to the
    smaller doc_id.

    Documents with null doc_id are not read; those with null or empty text have no term and are in no count. Items with null
    text or no term, and those whose terms no document has, have no row; a null item_id is an id like others. Rows that
    repeat a doc_id compete one by one, rows that repeat an item_id are ranked one by one. Other columns take no part.
    """
    blocks = materialize(index(docs, OTHER), "term-document-blocks")
    n, total = blocks.agg(F.coalesce(F.sum("n_filled"), F.lit(0)), F.coalesce(F.sum("n_words"), F.lit(0))).first()
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text IS NOT NULL")
    rounds = _rounds(items)
    out = None
    for r in range(rounds):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r) if rounds > 1 else items
        found = _round(blocks, [(i, *np.unique(Words(encoded([t]), True, OTHER).hash, return_counts=True)) for i, t in some.collect()], n, total, k, r)
        out = found if out is None else out.unionByName(found)
    w = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return out.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _round(blocks: DataFrame, rows: list, n: int, total: int, k: int, r: int) -> DataFrame:
    sc = blocks.sparkSession.sparkContext
    asked = np.unique(np.concatenate([h for _, h, _ in rows] or [np.zeros(0, np.uint64)]))

    def count(batches):
        df = np.zeros(len(asked), dtype=np.int64)
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                df += Shard(row).df(asked)
        yield pa.RecordBatch.from_arrays([pa.array(asked.view(np.int64)[df > 0]), pa.array(df[df > 0])], ["term", "df"])

    table = blocks.mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()  # terms of ITEMS items
    df = np.zeros(len(asked), dtype=np.int64)
    df[np.searchsorted(asked, table["term"].to_numpy().view(np.uint64))] = table["df"].to_numpy()
    weight = {d: math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in np.unique(df).tolist()}
    worth = np.array([weight[d] for d in df.tolist()], dtype=np.int64)
    known = df > 0
    plan = [(np.searchsorted(asked, h), c.astype(np.int64)) for _, h, c in rows]
    plan = [(t[known[t]], c[known[t]]) for t, c in plan]
    plan, ids = sc.broadcast((plan, worth, asked)), [i for i, *_ in rows]

    def multiply(batches):
        product = Product(*plan.value, n, total, k)
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                product.add(Shard(row))
        for i, (score, doc_id) in enumerate(product.found):
            if len(score):
                whole = [pa.array([v] * len(score), pa.int64()) for v in ((r << 32) | i, ids[i])]
                yield pa.RecordBatch.from_arrays([*whole, pa.array(doc_id), pa.array(score)], ["item", "item_id", "doc_id", "score"])

    return blocks.mapInArrow(multiply, "item long, item_id long, doc_id long, score long")


def oracle(k: int = 20) -> str:
    """The same in DuckDB, every document scored."""
    split = "unnest(regexp_extract_all(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
    return f"""
    WITH d AS (SELECT doc_id, {split.format("text")} AS w FROM documents), q AS (SELECT item_id, {split.format("text")} AS w FROM benchmark),
    size AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1), g AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM size),
    tf AS (SELECT doc_id, w, count(*) AS tf FROM d WHERE w IN (SELECT w FROM q) GROUP BY ALL), df AS (SELECT w, count(*) AS df FROM tf GROUP BY 1),
    worth AS (SELECT w, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS worth FROM df, g),
    s AS (SELECT item_id, doc_id, sum(worth * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // total))))::BIGINT AS score
          FROM q JOIN tf USING (w) JOIN worth USING (w) JOIN size USING (doc_id), g GROUP BY 1, 2)
    SELECT item_id, rank::INTEGER AS rank, doc_id, score
    FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""
