"""Language of a text by a bidirectional gated recurrent network over bytes.

The network runs over a text's bytes (lower-cased, white space as single spaces) in both directions, through words and spaces
alike, labels every byte position with a language, and a text's probabilities are the mean of its positions'. Texts are cut into
segments of CORE bytes that are read together with LAP bytes to either side, which serve as history only. Training is
backpropagation through time in numpy on a bounded sample.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .store import free, slices
from .words import LOWER, SPACE, chunks, encoded

CORE, LAP = 96, 8  #: bytes
SEGMENT = CORE + 2 * LAP
SAMPLE = 1_000  #: labelled documents of each language that the network is trained on, at most
SEGMENTS = 24  #: of each of them, evenly spaced over the whole text, at most
ROWS = 1_000  #: segments that the network reads at once


def segments(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes (rows padded with zeros), length, first and end of the core, and text of every segment."""
    buf = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    space = SPACE[buf]
    own = ~space
    own[1:] |= ~space[:-1]  # of a run of white space the first byte stays
    size = np.array([len(t) + 1 for t in texts])
    end = np.cumsum(size)
    own[end - 1] = False
    upto = np.concatenate([[0], np.cumsum(own)])
    raw = np.where(space, 32, LOWER[buf])[own]
    first, n = upto[end - size], upto[end] - upto[end - size]
    count = -(-n // CORE)
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    doc, core = np.repeat(np.arange(len(texts)), count), nth * CORE
    start = np.maximum(core - LAP, 0)
    length = np.minimum(core + CORE + LAP, n[doc]) - start
    at = np.arange(SEGMENT)[None]
    x = np.where(at < length[:, None], raw[np.minimum((first[doc] + start)[:, None] + at, max(0, len(raw) - 1))], 0) if len(doc) else np.zeros((0, SEGMENT), np.uint8)
    return x.astype(np.uint8), length, core - start, np.minimum(core + CORE, n[doc]) - start, doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


class Network:
    """Arrays hold positions, then hidden units, then segments, so that numpy works on long rows; segments are sorted, longest first."""

    HIDDEN = 8

    def __init__(self, languages: list[str], seed: int = 3):
        r, h, k = np.random.default_rng(seed), self.HIDDEN, len(languages)
        self.languages = languages
        self.p = {}
        for d in "fb":  # forward, backward: byte vectors already multiplied into the gates (update, reset, new)
            self.p |= {f"E{d}": r.normal(0, 0.3, (3 * h, 256)), f"R{d}": r.normal(0, h**-0.5, (3 * h, h)), f"O{d}": r.normal(0, h**-0.5, (k, h))}
        self.p["o"] = np.zeros((k, 1))
        self.p = {n: v.astype(np.float32) for n, v in self.p.items()}

    def _run(self, d: str, x: np.ndarray, active: np.ndarray, keep: bool):
        """Hidden states of each position; a segment's state begins at 0, at its first byte or, backward, at its last."""
        h, (t_all, n) = self.HIDDEN, x.shape
        e, r = self.p["E" + d], self.p["R" + d]
        states, tape = np.zeros((t_all, h, n), dtype=e.dtype), {}
        state = np.zeros((h, n), dtype=e.dtype)
        for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
            m = active[t]
            if not m:
                continue
            s = state[:, :m]
            a, b = e.take(x[t, :m], axis=1), r @ s
            gates = _sigmoid(a[: 2 * h] + b[: 2 * h])
            z, q = gates[:h], gates[h:]
            new = np.tanh(a[2 * h :] + q * b[2 * h :])
            now = new + z * (s - new)
            if keep:
                tape[t] = s.copy(), b[2 * h :], z, q, new
            state[:, :m] = now
            states[t, :, :m] = now
        return states, tape

    def _read(self, x: np.ndarray, length: np.ndarray, keep: bool = False):
        """Probabilities (positions x languages x segments), and what backpropagation needs."""
        active = (length[None] > np.arange(SEGMENT)[:, None]).sum(1)
        x = np.ascontiguousarray(x.T).astype(np.intp)
        f, tf = self._run("f", x, active, keep)
        b, tb = self._run("b", x, active, keep)
        y = self.p["Of"] @ f + self.p["Ob"] @ b + self.p["o"]
        y = np.exp(y - y.max(1, keepdims=True))
        y /= y.sum(1, keepdims=True)
        return y, x, f, b, tf, tb, active

    def positions(self, x: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Probabilities (segments x positions x languages)."""
        return self._read(x, length)[0].transpose(2, 0, 1)

    def label(self, x: np.ndarray, length: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Sum over positions ``first`` to ``end`` of each segment's probabilities."""
        out = np.zeros((len(x), len(self.languages)), dtype=np.float32)
        order, t = np.argsort(-length, kind="stable"), np.arange(SEGMENT)[:, None]
        for at in range(0, len(x), ROWS):
            some = order[at : at + ROWS]
            y = self._read(x[some], length[some])[0]
            out[some] = np.einsum("tkn,tn->nk", y, ((t >= first[some]) & (t < end[some])).astype(np.float32))
        return out

    def _back(self, d: str, x, states_grad, tape, active, grad):
        h, r = self.HIDDEN, self.p["R" + d]
        carry = np.zeros((h, x.shape[1]), dtype=r.dtype)
        for t in sorted(tape, reverse=d == "f"):
            m = active[t]
            s, bn, z, q, new = tape[t]
            g = carry[:, :m] + states_grad[t, :, :m]
            dn = g * (1 - z) * (1 - new**2)
            da = np.concatenate([g * (s - new) * z * (1 - z), dn * bn * q * (1 - q), dn])
            db = da.copy()
            db[2 * h :] *= q
            np.add.at(grad["E" + d].T, x[t, :m], da.T)
            grad["R" + d] += db @ s.T
            carry[:, :m] = g * z + r.T @ db

    def gradient(self, x: np.ndarray, length: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss of all positions, by backpropagation through time; segments sorted, longest first."""
        g, x, f, b, tf, tb, active = self._read(x, length, keep=True)
        g[:, y, np.arange(len(y))] -= 1
        g *= (np.arange(SEGMENT)[:, None] < length)[:, None]
        g /= length.sum()
        grad = {k: np.zeros_like(p) for k, p in self.p.items()}
        grad["Of"], grad["Ob"], grad["o"] = np.einsum("thn,tkn->kh", f, g), np.einsum("thn,tkn->kh", b, g), g.sum((0, 2))[:, None]
        self._back("f", x, self.p["Of"].T @ g, tf, active, grad)
        self._back("b", x, self.p["Ob"].T @ g, tb, active, grad)
        return grad

    def fit(self, x: np.ndarray, length: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 96, rate: float = 0.01, seed: int = 4) -> Network:
        r = np.random.default_rng(seed)
        m, v = ({k: np.zeros_like(p) for k, p in self.p.items()} for _ in range(2))
        for step in range(1, steps + 1):
            some = r.integers(0, len(x), min(batch, len(x)))
            some = some[np.argsort(-length[some], kind="stable")]
            grad = self.gradient(x[some], length[some], y[some])
            pace = rate * (1 - 0.95 * step / steps)
            for k, d in grad.items():
                m[k] += 0.1 * (d - m[k])
                v[k] += 0.002 * (d * d - v[k])
                self.p[k] -= (pace * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.998**step)) + 1e-8)).astype(np.float32)
        return self


def train(docs: DataFrame, sample: int = SAMPLE, steps: int = 400) -> Network:
    """A network from (doc_id, text, lang): of each language at most ``sample`` documents, those whose hashed ids are smallest,
    and at most SEGMENTS segments of each, in equal weight for each language, so that a rare language is learned as well. Rows
    with null text, lang or doc_id are left out; repeated rows count. No row at all gives a network without languages."""
    rows = docs.select("doc_id", "text", "lang").where("doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL")
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = rows.select("doc_id", "lang").withColumn("nth", nth).where(F.col("nth") <= sample).select("doc_id").distinct()

    def pick(batches):
        for batch in slices(batches):
            langs = batch.column("lang").to_pylist()
            for at, texts in chunks(encoded(batch.column("text").to_pylist())):
                x, length, _, _, doc = segments(texts)
                bound = np.searchsorted(doc, np.arange(len(texts) + 1))
                for i in range(len(texts)):
                    a, b = bound[i], bound[i + 1]
                    some = np.unique(np.linspace(a, b - 1, min(SEGMENTS, b - a)).astype(int)) if b > a else []
                    if len(some):
                        yield pa.RecordBatch.from_arrays([pa.array([langs[at + i]] * len(some)), pa.array([x[j, : length[j]].tobytes() for j in some], pa.binary())], ["lang", "segment"])

    got = rows.join(F.broadcast(chosen), "doc_id").mapInArrow(pick, "lang string, segment binary").toPandas()  # at most sample * SEGMENTS short strings of each language
    languages = sorted(set(got.lang))
    net = Network(languages)
    if len(languages) > 1:
        got = got.sort_values(["lang", "segment"])
        least = max(2_000, got.lang.value_counts().min())
        got = got.groupby("lang").sample(n=least, replace=True, random_state=5)
        raw = got.segment.to_list()
        x = np.frombuffer(b"".join(s.ljust(SEGMENT, b"\0") for s in raw), dtype=np.uint8).reshape(-1, SEGMENT)
        net.fit(x, np.array([len(s) for s in raw]), got.lang.map({k: i for i, k in enumerate(languages)}).to_numpy(), steps=steps)
    return net


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """Columns of ``docs``, lang_pred and score (the pooled probability). ``und`` with score 0 where the text is null or
    has no letter, or the network knows no language. Repeated rows each get theirs. If ``docs`` has a column of one of these names,
    that stays and the new one gets an underscore before it."""
    names = docs.columns
    added = [free(n, names) for n in ("lang_pred", "score")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + f", `{added[0]}` string, `{added[1]}` double"
    k = len(net.languages)

    def apply(batches):
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            pooled = np.zeros((len(texts), k))
            for at, some in chunks(encoded(texts), 1 << 20) if k else ():
                x, length, first, end, doc = segments(some)
                got = net.label(x, length, first, end)
                for j in range(k):
                    pooled[at : at + len(some), j] = np.bincount(doc, got[:, j], minlength=len(some))
            total = pooled.sum(1)
            best = pooled.argmax(1) if k else np.zeros(len(texts), dtype=int)
            lettered = [bool(k) and total[i] > 0 and t is not None and any(map(str.isalpha, t)) for i, t in enumerate(texts)]
            lang = [net.languages[best[i]] if ok else "und" for i, ok in enumerate(lettered)]
            score = [float(min(1.0, pooled[i, best[i]] / total[i])) if ok else 0.0 for i, ok in enumerate(lettered)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], [*names, *added])

    return docs.mapInArrow(apply, schema)
