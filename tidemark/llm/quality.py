"""Quality by attention-based multiple-instance learning.

A text is a bag of passages. Each passage is encoded from hashed byte pairs and the shape of its words by one hidden
layer; gated attention weighs the passages; the weighted mean gives the document's score. Labels belong to documents
alone, and the attention is learned from them, in numpy, on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import free, slices
from .words import LOWER, SPACE, Words, chunks, encoded

PASSAGE = 40  #: words
PAIRS = 120  #: hashed byte pairs
SHAPES = 8
SAMPLE = 4_000  #: labelled documents that the model is fitted on, at most
_CHUNK = 1 << 18  #: bytes of text whose features are made at once
_KIND = np.zeros(256, dtype=np.int64)  # 1: punctuation, 2: digits, 3: capitals, 4: beyond ASCII
_KIND[33:127] = 1
_KIND[ord("0") : ord("9") + 1] = 2
_KIND[ord("a") : ord("z") + 1] = 0
_KIND[ord("A") : ord("Z") + 1] = 3
_KIND[128:] = 4


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(passages x features, each text's number of passages); a text without words has one passage of zeros."""
    words = Words(texts, lower=True)
    counts = np.diff(words.first)
    bags = np.maximum(1, -(-counts // PASSAGE))
    first = np.cumsum(bags) - bags
    n = int(bags.sum())
    nth = np.arange(len(words.hash)) - words.first[words.doc]
    of = first[words.doc] + nth // PASSAGE
    buf = np.frombuffer(words.raw, dtype=np.uint8)
    ends = np.append(words.start[1:], len(buf))
    at = np.zeros(len(buf), dtype=np.int64)
    if len(of):
        at[words.start[0] :] = np.repeat(of, ends - words.start)
    low = LOWER[buf].astype(np.int64)
    low[SPACE[buf]] = 32
    pair = (low[:-1] * 257 + low[1:]) * 40503 % 65521 % PAIRS
    table = np.bincount(at[:-1] * PAIRS + pair, minlength=n * PAIRS).reshape(n, PAIRS).astype(np.float32)
    kinds = np.bincount(at * 5 + _KIND[buf], minlength=n * 5).reshape(n, 5).astype(np.float32)
    size = np.maximum(1, kinds.sum(1))
    out = np.zeros((n, PAIRS + SHAPES), dtype=np.float32)
    out[:, :PAIRS] = np.sqrt(table / np.maximum(1, table.sum(1))[:, None])
    held = np.bincount(of, minlength=n)
    many = np.maximum(1, held)
    out[:, PAIRS : PAIRS + 4] = kinds[:, 1:] / size[:, None] * 3
    out[:, PAIRS + 4] = np.bincount(of, words.end - words.start, minlength=n) / many / 10
    if len(of):
        again = np.zeros(len(of))
        again[1:] = (words.hash[1:] == words.hash[:-1]) & (of[1:] == of[:-1])
        out[:, PAIRS + 5] = np.bincount(of, again, minlength=n) / many
        key = np.unique(np.rec.fromarrays([of, words.hash], names="p,h"))
        out[:, PAIRS + 6] = np.bincount(key.p, minlength=n) / many
    out[:, PAIRS + 7] = held / PASSAGE
    out[held == 0] = 0
    return out, bags


class Model:
    """h = tanh(x E + b); a = softmax over a text's passages of w (tanh(h V) * sigmoid(h U)); score = sigmoid(c sum(a h))."""

    HIDDEN, GATE = 24, 12

    def __init__(self, seed: int = 1):
        r = np.random.default_rng(seed)
        d, h, g = PAIRS + SHAPES, self.HIDDEN, self.GATE
        self.p = {"E": r.normal(0, d**-0.5, (d, h)), "b": np.zeros(h), "V": r.normal(0, h**-0.5, (h, g)), "U": r.normal(0, h**-0.5, (h, g)), "w": r.normal(0, g**-0.5, g), "c": r.normal(0, h**-0.5, h), "k": np.zeros(1)}
        self.mean, self.scale = np.zeros(d), np.ones(d)

    def _forward(self, x: np.ndarray, bags: np.ndarray) -> dict:
        p, first = self.p, np.cumsum(bags) - bags
        h = np.tanh(x @ p["E"] + p["b"])
        t, s = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * s) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), bags))
        a = e / np.repeat(np.add.reduceat(e, first), bags)
        z = np.add.reduceat(a[:, None] * h, first)
        return {"h": h, "t": t, "s": s, "a": a, "z": z, "score": 1 / (1 + np.exp(-np.clip(z @ p["c"] + p["k"], -30, 30))), "first": first}

    def _norm(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale).astype(np.float32)

    def score(self, x: np.ndarray, bags: np.ndarray) -> np.ndarray:
        return self._forward(self._norm(x), bags)["score"]

    def gradient(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of some texts' labels, by backpropagation."""
        f, p, n = self._forward(x, bags), self.p, bags
        d = (f["score"] - y) / len(y)
        dz = np.repeat(d[:, None] * p["c"], n, axis=0)
        da = (dz * f["h"]).sum(1)
        de = f["a"] * (da - np.repeat(np.add.reduceat(f["a"] * da, f["first"]), n))
        dt, ds = de[:, None] * p["w"] * f["s"] * (1 - f["t"] ** 2), de[:, None] * p["w"] * f["t"] * f["s"] * (1 - f["s"])
        dh = (f["a"][:, None] * dz + dt @ p["V"].T + ds @ p["U"].T) * (1 - f["h"] ** 2)
        return {"E": x.T @ dh, "b": dh.sum(0), "V": f["h"].T @ dt, "U": f["h"].T @ ds, "w": de @ (f["t"] * f["s"]), "c": f["z"].T @ d, "k": d.sum(keepdims=True)}

    def fit(self, x: np.ndarray, bags: np.ndarray, y: np.ndarray, epochs: int = 40, batch: int = 128, rate: float = 0.004, decay: float = 1e-4, seed: int = 2) -> Model:
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        x, first, r = self._norm(x), np.cumsum(bags) - bags, np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(v) for k, v in self.p.items()}
        step = 0
        for epoch in range(epochs):
            order = r.permutation(len(y))
            for at in range(0, len(y), batch):
                docs = order[at : at + batch]
                n = bags[docs]
                rows = np.arange(int(n.sum())) + np.repeat(first[docs] - (np.cumsum(n) - n), n)
                grad = self.gradient(x[rows], n, y[docs])
                p = self.p
                step += 1
                pace = rate * (1 - 0.9 * epoch / epochs)
                for k, g in grad.items():
                    g = g + decay * p[k]
                    m[k] += 0.1 * (g - m[k])
                    v[k] += 0.001 * (g * g - v[k])
                    p[k] = p[k] - pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """A model from at most ``sample`` labelled ones of ``docs`` (those whose hashed ids are smallest). Null labels, ids and texts
    are left out; a document with several labels counts as good if any says so. Without any label, or with one kind
    alone, the model knows nothing more than their share."""
    spark = docs.sparkSession
    chosen = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = chosen.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")  # ids only: labels of other documents take no place
    chosen = chosen.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").where("text IS NOT NULL").join(F.broadcast(chosen), "doc_id")  # at most `sample` rows of two numbers

    def encode(batches):
        for batch in slices(batches):
            for at, texts in chunks(encoded(batch.column("text").to_pylist()), _CHUNK):
                x, bags = features(texts)
                first = np.cumsum(bags) - bags
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(at, len(texts)), batch.column("quality").slice(at, len(texts)), pa.array([x[a : a + n].astype(np.float16).tobytes() for a, n in zip(first, bags)], pa.binary())], ["doc_id", "quality", "x"]
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    got = sorted(rows.mapInArrow(encode, f"doc_id {kind}, quality int, x binary").collect(), key=lambda r: (r["doc_id"], r["quality"]))
    model = Model()
    if not got:
        return model
    bags = [np.frombuffer(r["x"], dtype=np.float16).reshape(-1, PAIRS + SHAPES) for r in got]
    return model.fit(np.concatenate(bags).astype(np.float32), np.array([len(b) for b in bags]), np.array([float(r["quality"] > 0) for r in got]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Columns of ``docs`` and score (0 to 1). Null and empty texts are one empty passage and get a score like others. Repeated
    rows each get theirs. If ``docs`` has a column score, that stays and the new one gets an underscore before it."""
    names = docs.columns
    added = free("score", names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{added}` double"

    def apply(batches):
        for batch in slices(batches):
            parts = [model.score(*features(texts)) for _, texts in chunks(encoded(batch.column("text").to_pylist()), _CHUNK)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(parts).astype(np.float64) if parts else [], pa.float64())], [*names, added])

    return docs.mapInArrow(apply, schema)
