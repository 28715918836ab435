"""Substring dedup by seed and extend.

Seeds are winnowed anchors: of the word n-grams in every window, the one with the smallest hash, so that two equal
windows always choose the same anchor. Documents are joined on anchors. An anchor that only one document has is
dropped there and then. Every other occurrence is extended to both sides over the windows that chose it, and the
extensions are compared: first as a whole (copies agree entirely and need one row each), then window by window
between the first documents of each distinct extension. Matching windows are united to maximal repeats.

No list of an anchor's documents is ever gathered or paired: comparisons are grouped minima, joined back (those of hot
anchors by broadcast), so a passage that a third of all documents share costs one row per occurrence, wherever it stands.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import free, join_counted, materialize, slices
from .words import Words, chunks, encoded

_OCCURRENCE = "doc_id long, text_key long, anchor long, whole long, pos int, n int, wins array<long>"


def _chosen(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """The smallest gram hash of each window, and the windows that lie within one text."""
    grams, _ = words.windows(gram)
    _, ok = words.windows(window)
    span, low, width = window - gram + 1, grams, 1
    while 2 * width <= span:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    rest = span - width
    return (np.minimum(low[: len(low) - rest], low[rest:]) if rest else low)[: len(ok)], ok


#: tells rows of one doc_id apart: rows with equal texts have equal spans
TEXT_KEY = "xxhash64(text)"


def repeats(docs: DataFrame, window: int = 50, gram: int = 20) -> DataFrame:
    """Maximal repeats: (doc_id, text_key, spans), where spans lists the [start, end) word ranges, sorted and disjoint, that
    are covered by windows which also start in a document with a smaller doc_id. Documents without one are not listed.

    Words are kept as they are (case and punctuation count). Null or empty texts and texts shorter than the window
    have no repeat; rows with null doc_id neither give nor get one. Rows that repeat a doc_id do not repeat each other; each
    has spans of its own, by TEXT_KEY. Other columns take no part.
    """
    if not 0 < gram <= window:
        raise ValueError("the anchor must not be longer than the window")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")

    def anchors(batches):
        for batch in slices(batches):
            ids = batch.column("doc_id").to_numpy(zero_copy_only=False)
            for at, texts in chunks(encoded(batch.column("text").to_pylist())):
                words = Words(texts, lower=False)
                if len(words.hash) < window:
                    continue
                low, ok = _chosen(words, window, gram)
                doc = words.doc[: len(ok)]
                new = ok.copy()
                new[1:] &= (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                key = np.unique(np.rec.fromarrays([doc[new], low[new]], names="d,a"))
                yield pa.RecordBatch.from_arrays([pa.array(ids[at + key.d]), pa.array(key.a.view(np.int64))], ["doc_id", "anchor"])

    seeds = materialize(docs.mapInArrow(anchors, "doc_id long, anchor long"), "anchors")
    shared = materialize(seeds.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n"), "shared-anchors")
    wanted = join_counted(seeds, shared, ["anchor"]).groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors"))

    def extend(batches):
        for batch in slices(batches):
            ids, text_key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc_id", "text_key"))
            listed = batch.column("anchors")
            for at, texts in chunks(encoded(batch.column("text").to_pylist())):
                words = Words(texts, lower=False)
                if len(words.hash) < window:
                    continue
                low, ok = _chosen(words, window, gram)
                part = listed.slice(at, len(texts))
                # membership of (text, anchor), both hashed to one number; a clash only adds a row to compare
                owner = np.repeat(np.arange(len(texts), dtype=np.uint64), np.diff(part.offsets.to_numpy()))
                values = part.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                tag = lambda d, a: a ^ (d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
                doc = words.doc[: len(ok)]
                hit = ok & np.isin(tag(doc, low), tag(owner, values))
                new = hit.copy()
                new[1:] &= ~hit[:-1] | (low[1:] != low[:-1]) | (doc[1:] != doc[:-1])
                start = np.flatnonzero(new)
                if not len(start):
                    continue
                run = np.cumsum(new)[hit] - 1
                n = np.bincount(run, minlength=len(start))
                wins, _ = words.windows(window, salt=7)
                whole = words.spans(start, start + n + window - 1, salt=11)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(ids[at + doc[start]]), pa.array(text_key[at + doc[start]]), pa.array(low[start].view(np.int64)), pa.array(whole.view(np.int64)),
                        pa.array((start - words.first[doc[start]]).astype(np.int32)), pa.array(n.astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(wins[hit].view(np.int64))),
                    ],
                    ["doc_id", "text_key", "anchor", "whole", "pos", "n", "wins"],
                )

    found = materialize(docs.join(wanted, "doc_id").withColumn("text_key", F.expr(TEXT_KEY)).mapInArrow(extend, _OCCURRENCE), "occurrences")
    one = ["anchor", "whole"]
    classes = materialize(found.groupBy(*one).agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("times")), "extensions")
    copied = classes.where("least < most").select(*one, "least", F.col("times").alias("n"))
    copies = join_counted(found.select("doc_id", "text_key", *one, "pos", F.col("n").alias("length")), copied, one).where("doc_id > least")
    several = classes.groupBy("anchor").agg(F.min("least").alias("lo"), F.max("least").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "n")
    several = join_counted(classes, materialize(several, "several"), ["anchor"]).select(*one, "least", F.col("times").alias("n"))
    firsts = join_counted(found.drop("n"), materialize(several, "first-extensions"), one).where("doc_id = least")
    each = firsts.select("doc_id", "text_key", "anchor", F.posexplode("wins").alias("k", "win"), "pos").selectExpr("doc_id", "text_key", "anchor", "win", "pos + k AS pos")
    each = materialize(each, "windows")
    source = each.groupBy("anchor", "win").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi").select("anchor", "win", "lo", "n")
    single = join_counted(each, materialize(source, "first-windows"), ["anchor", "win"]).where("doc_id > lo").selectExpr("doc_id", "text_key", "pos", "1 AS n")
    covered = copies.select("doc_id", "text_key", "pos", F.col("length").alias("n")).unionByName(single)
    return covered.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("pos", "n"))).alias("hits")).select(
        "doc_id",
        "text_key",
        F.expr(
            f"""aggregate(hits, CAST(array() AS array<struct<start:int,end:int>>), (spans, h) ->
                CASE WHEN size(spans) > 0 AND element_at(spans, -1).end >= h.pos
                     THEN concat(slice(spans, 1, size(spans) - 1), array(named_struct('start', element_at(spans, -1).start,
                          'end', greatest(element_at(spans, -1).end, h.pos + h.n + {window - 1}))))
                     ELSE concat(spans, array(named_struct('start', h.pos, 'end', h.pos + h.n + {window - 1}))) END)"""
        ).alias("spans"),
    )


def cut(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """Columns of ``docs`` with the words in ``spans`` removed: ``text`` is what is left, each word followed by the white
    space that followed it; a text without a span stays as it is. Adds n_words, n_removed and kept_words (the kept words
    joined by one space); a column of ``docs`` that has one of these names stays, and the new one gets an underscore
    before it. A null text stays null, with no words. Repeated rows are each cut by their own spans."""
    names = docs.columns
    added = [free(n, names) for n in ("n_words", "n_removed", "kept_words")]
    spans_name, key, owner = (free(n, names) for n in ("spans", "text_key", "owner"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{added[0]}` long, `{added[1]}` long, `{added[2]}` string"

    def remove(batches):
        for batch in slices(batches):
            texts, removed = encoded(batch.column("text").to_pylist()), batch.column(spans_name).to_pylist()
            left, n_words, n_removed, kept = [], [], [], []
            for text, spans in zip(texts, removed):
                split = text.split()
                n_words.append(len(split))
                if spans:
                    keep = np.ones(len(split), dtype=bool)
                    for s in spans:
                        keep[s["start"] : s["end"]] = False
                    words = Words([text], lower=False)
                    last = np.append(words.start[1:], len(text))
                    kept.append(b" ".join(w for w, k in zip(split, keep) if k).decode("utf-8", "surrogatepass"))
                    left.append(b"".join(text[a:b] for a, b in zip(words.start[keep], last[keep])).decode("utf-8", "surrogatepass"))
                    n_removed.append(int((~keep).sum()))
                else:
                    kept.append(b" ".join(split).decode("utf-8", "surrogatepass"))
                    left.append(None)
                    n_removed.append(0)
            out = [batch.column(c) for c in names]
            k = names.index("text")
            out[k] = pa.array([old if new is None else new for old, new in zip(out[k].to_pylist(), left)], pa.string())
            yield pa.RecordBatch.from_arrays([*out, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], [*names, *added])

    spans = spans.select(F.col("doc_id").alias(owner), F.col("text_key").alias(key), F.col("spans").alias(spans_name))
    joined = docs.join(spans, (docs["doc_id"] == spans[owner]) & (F.xxhash64(docs["text"]) == spans[key]), "left").select(*(docs[f"`{c}`"] for c in names), spans_name)
    return joined.mapInArrow(remove, schema)


def brute_force(rows: list[tuple[int, str | None]], window: int = 50) -> dict[int, tuple[int, int, str]]:
    """doc_id to (n_words, n_removed, kept_sha256), over all windows in one dictionary; for tests."""
    split = {d: (t or "").encode().split() for d, t in rows}
    first: dict[tuple, int] = {}
    for d in sorted(split):
        for i in range(len(split[d]) - window + 1):
            first.setdefault(tuple(split[d][i : i + window]), d)
    out = {}
    for d, words in split.items():
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < d:
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out[d] = (len(words), sum(gone), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out
