"""Language-model scores by context-tree weighting over bytes.

A text is its words, each closed by a space, and a line feed at the end. Every byte is eight binary decisions; each
decision has a context tree over the ``DEPTH`` bytes before it, whatever words they belong to; only the start of the text
cuts them off. A node's counts give a Krichevsky-Trofimov estimate; estimates of all depths are mixed with the weights that
the training data gives them (the node's own probability of its data against that of its subtrees). Contexts that training
never met take no part in a mixture.

Blocks of text count their (context, byte) pairs and send them, sorted and packed, to the tree of the last two bytes; a tree
with more than PART bytes of them is cut into parts by the third last byte. A part's task merges what the blocks counted, one
block after the other, and writes the sums. A second pass reads those, works on contexts of three bytes at a time, and sends
each block that then comes by the probabilities of its pairs. Words are counted in the same way, by BUCKETS of their hashes.
What depth 2 adds up over a tree's parts is joined to them; depths 0 and 1 (at most 65,280 nodes) are put together on the
driver and broadcast. A task so holds one block, the distinct pairs of a part, or a bucket's distinct words, and one row of
one block besides.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import materialize, slices
from .words import Words, chunks, encoded

DEPTH = 6  #: bytes of context; a context and the next byte fill seven bytes of a long
BLOCK = 32 << 20  #: bytes of text whose words and contexts are counted together
_CHUNK = 1 << 20
_SLICE = 1 << 15  #: pairs of a tree that are worked on at once, at least
_MERGE = 1 << 20  #: pairs that wait to be merged
_LOG2 = np.log(2.0)
BUCKETS = 1024  #: of words
PART = 8 << 20  #: packed bytes of a tree's pairs, over all blocks, beyond which it is cut by the third last byte
_TABLES = "block long, doc_id array<long>, held_out array<boolean>, text binary, bucket int, words binary, tree int, pairs binary, times binary"
_KINDS = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.binary(), pa.int32(), pa.binary(), pa.int32(), pa.binary(), pa.binary()]
_NAMES = [c.split()[0] for c in _TABLES.split(", ")]


def _rows(rows: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(rows, k) for c, k in zip(_NAMES, _KINDS)], _NAMES)


def _summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, and the sums of their counts."""
    key, n = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(n, first) if len(first) else n


class _Sum:
    """Counts of keys that come in sorted parts; merged whenever much waits."""

    def __init__(self):
        self.parts: list = []
        self.waiting = 0

    def add(self, key: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((key, n))
        self.waiting += len(key)
        if self.waiting > _MERGE and self.waiting > len(self.parts[0][0]):
            self.parts, self.waiting = [self.total()], 0

    def total(self) -> tuple[np.ndarray, np.ndarray]:
        return _summed(self.parts)


def _packed(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(x)


def _unpacked(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompressobj().decompress(x)


def _planes(x: np.ndarray) -> bytes:
    """Numbers, packed byte by byte: all lowest bytes first."""
    return _packed(np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def _unplanes(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(x), dtype=np.uint8).reshape(8, -1).T).view("<i8").ravel()


def _keys_of(pairs: bytes, tree: int) -> np.ndarray:
    return np.cumsum(_unplanes(pairs)) + (tree << 40)


def _fixed(p: np.ndarray) -> bytes:
    """log10 of probabilities in five bytes each, to 2**-33 (the least is above -256: eight bits, each from counts of a long)."""
    return np.rint(-p * 2**32).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].tobytes()


def _unfixed(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), dtype=np.uint8)
    out[:, :5] = np.frombuffer(b, dtype=np.uint8).reshape(-1, 5)
    return out.view("<u8").ravel() / -(2.0**32)


def _blocks(batches) -> Iterator[pa.RecordBatch]:
    """For each block of text one row of its documents, a row for each of its words and how often they are learned, and a
    row for each tree that it has pairs in."""
    part, nth = TaskContext.get().partitionId() if TaskContext.get() else 0, 0
    ids: list = []
    held: list = []
    closed: list = []  # packed, but for the end
    packer = zstandard.ZstdCompressor(level=6).compressobj()
    words: list = []  # by chunk: hashes, how often they are learned, lengths, bytes
    pairs = _Sum()
    size = 0

    def flush():
        nonlocal nth, packer, pairs, size
        block = (part << 32) | nth
        nth += 1
        yield _rows(1, block=[block], doc_id=[ids], held_out=[held], text=[b"".join([*closed, packer.flush()])])
        packer = zstandard.ZstdCompressor(level=6).compressobj()
        for x in (ids, held, closed):
            x.clear()
        yield from _listed(block, words)
        words.clear()
        key, n = pairs.total()
        pairs, size = _Sum(), 0
        tree, first = np.unique(key >> 40, return_index=True)
        for at in range(0, len(tree), 200):
            some = [(key[a:b], n[a:b]) for a, b in zip(first[at : at + 200], np.append(first, len(key))[at + 1 :])]
            yield _rows(
                len(some), block=np.full(len(some), block), tree=tree[at : at + 200].astype(np.int32),
                pairs=[_planes(np.diff(k, prepend=int(t) << 40)) for (k, _), t in zip(some, tree[at : at + 200])], times=[_planes(m) for _, m in some],
            )

    for batch in slices(batches):
        some_ids, some_held = batch.column("doc_id").to_pylist(), batch.column("held_out").to_pylist()
        for at, texts in chunks(encoded(batch.column("text").to_pylist()), _CHUNK):
            own = some_held[at : at + len(texts)]
            learned = ~np.array(own, dtype=bool)
            texts = [_closed(t) for t in texts]
            words.append(_words(texts, learned))
            key, length = _keys(texts)
            code, unique = pd.factorize(key)
            n = np.bincount(code, np.repeat(learned, length), minlength=len(unique)).astype(np.int64)
            order = np.argsort(unique)
            pairs.add(unique[order], n[order])
            ids.extend(some_ids[at : at + len(texts)])
            held.extend(own)
            closed.append(packer.compress(b"".join(texts)))
            size += len(key)
            if size >= BLOCK:
                yield from flush()
    if ids:
        yield from flush()


def _gather(raw: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The bytes of some slices, one after the other."""
    end = np.cumsum(length)
    return raw[np.arange(end[-1] if len(end) else 0) + np.repeat(start - (end - length), length)]


def _words(texts: list[bytes], learned: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashes of the distinct words, how often learned texts have them, their lengths, and their bytes."""
    words = Words(texts, lower=False)
    code, unique = pd.factorize(words.hash)
    n = np.bincount(code, learned[words.doc], minlength=len(unique)).astype(np.int64)
    first = np.zeros(len(unique), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code) - 1, -1, -1)
    length = words.end[first] - words.start[first]
    return unique, n, length, _gather(np.frombuffer(words.raw, dtype=np.uint8), words.start[first], length)


def _in_order(h: np.ndarray) -> np.ndarray:
    """The order of a block's words: by bucket, then by hash. h is sorted."""
    return np.argsort(h % np.uint64(BUCKETS), kind="stable")


def _listed(block: int, words: list) -> Iterator[pa.RecordBatch]:
    """A row for each bucket of a block's distinct words, with how often they are learned."""
    h, n, length, raw = (np.concatenate([w[i] for w in words]) for i in range(4))
    unique, first, inverse = np.unique(h, return_index=True, return_inverse=True)
    order = _in_order(unique)
    n = np.bincount(inverse, n, minlength=len(unique)).astype(np.int64)[order]
    start, length = (np.cumsum(length) - length)[first][order], length[first][order]
    bucket, at = np.unique(unique[order] % np.uint64(BUCKETS), return_index=True)
    data = _gather(np.append(raw, np.uint8(10)), np.column_stack([start, np.full(len(start), len(raw))]).ravel(), np.column_stack([length, np.ones_like(length)]).ravel())
    end = np.append(0, np.cumsum(length + 1))
    at = np.append(at, len(n))
    for some in np.array_split(np.arange(len(bucket)), -(-len(bucket) // 200) or 1):
        yield _rows(
            len(some), block=np.full(len(some), block), bucket=bucket[some].astype(np.int32),
            words=[_packed(data[end[at[i]] : end[at[i + 1]]].tobytes()) for i in some], times=[_planes(n[at[i] : at[i + 1]]) for i in some],
        )


def _counts(batches) -> Iterator[pa.RecordBatch]:
    """(bucket, words, times, n_words, n_known): the distinct words of a bucket over all blocks, how often each is learned, how often
    all are, and how many."""
    for bucket, rows in _runs(batches, ("bucket",), ("words", "times")):
        total: dict[bytes, int] = {}
        for words, times in rows:
            for w, n in zip(_unpacked(words).split(b"\n"), _unplanes(times).tolist()):
                total[w] = total.get(w, 0) + n
        n = np.fromiter(total.values(), dtype=np.int64, count=len(total))
        values = (bucket[0], _packed(b"\n".join([*total, b""])), _planes(n), int(n.sum()), int((n > 0).sum()))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["bucket", "words", "times", "n_words", "n_known"])


def _looked_up(batches) -> Iterator[pa.RecordBatch]:
    """(block, bucket, c): how often all blocks learn each of a block's words. A bucket's sums (without a block) come before its blocks."""
    for bucket, rows in _runs(batches, ("bucket",), ("block", "words", "times")):
        total: dict[bytes, int] = {}
        for block, words, times in rows:
            split = _unpacked(words).split(b"\n")[:-1]
            if block is None:
                total = dict(zip(split, _unplanes(times).tolist()))
                continue
            c = np.fromiter(map(total.__getitem__, split), dtype=np.int64, count=len(split))
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([bucket[0]], pa.int32()), pa.array([_planes(c)], pa.binary())], ["block", "bucket", "c"])


def _closed(text: bytes) -> bytes:
    """The text's words, lower-cased, as they are scored."""
    words = text.lower().split()
    return b" ".join(words) + b" \n" if words else b"\n"


def _split(closed: bytes) -> Iterator[list[bytes]]:
    """The closed texts of a block, some at a time."""
    at = 0
    while at < len(closed):
        end = closed.find(b"\n", min(len(closed) - 1, at + _CHUNK)) + 1
        yield [t + b"\n" for t in closed[at : end - 1].split(b"\n")]
        at = end


def _keys(closed: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The (context, byte) keys of closed texts, and how many each has: last byte of the context first, the byte itself last.
    A space comes before a text."""
    length = np.array([len(w) for w in closed])
    buf = np.frombuffer(b"".join(closed), dtype=np.uint8).astype(np.int64)
    first = np.cumsum(length) - length
    key = buf.copy()
    for back in range(1, DEPTH + 1):
        before = np.zeros(len(buf), dtype=np.int64)
        before[back:] = buf[: max(0, len(buf) - back)]
        for nth in range(back):  # the first bytes of a text have less before them
            before[(first + nth)[length > nth]] = 32 if nth == back - 1 else 0
        key |= before << (8 * (DEPTH + 1 - back))
    return key, length


_TABLE = 1 << 16
#: log of gamma(k + 1/2) and gamma(k + 1)
_HALF = np.concatenate([[0.0], np.cumsum(np.log(np.arange(_TABLE - 1) + 0.5))]) + 0.5 * np.log(np.pi)
_WHOLE = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1.0, _TABLE)))])


def _lgamma(k: np.ndarray, table: np.ndarray, plus: float) -> np.ndarray:
    """log of gamma(k + plus) of counts, by Stirling's series beyond the table."""
    out = table[np.minimum(k, _TABLE - 1).astype(np.int64)]
    large = k >= _TABLE
    if large.any():
        y = k[large] + plus
        i = 1 / y
        out[large] = (y - 0.5) * np.log(y) - y + 0.9189385332046727 + i * (1 / 12 - i * i / 360)
    return out


def _kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Log of the Krichevsky-Trofimov probability of any one sequence with these counts."""
    return _lgamma(n0, _HALF, 0.5) + _lgamma(n1, _HALF, 0.5) - _lgamma(n0 + n1, _WHOLE, 1.0) - np.log(np.pi)


def _one(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return (n1 + 0.5) / (n0 + n1 + 1)


class _Subtree:
    """Nodes of depth DEPTH to ``least`` from distinct keys and their counts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, least: int):
        byte, context = key & 255, key >> 8
        bit = np.arange(8)
        node = ((context[:, None] << 8) | ((256 | byte[:, None]) >> (8 - bit))).ravel()
        ones = ((byte[:, None] >> (7 - bit)) & 1).ravel()
        weight = np.repeat(n.astype(np.float64), 8)
        keys, inverse = np.unique(node, return_inverse=True)
        n1 = np.bincount(inverse, weight * ones, minlength=len(keys))
        n0 = np.bincount(inverse, weight, minlength=len(keys)) - n1
        self.least, self.levels = least, {}
        whole, share, parent = _kt(n0, n1), np.ones(len(keys)), None
        for depth in range(DEPTH, least - 1, -1):
            self.levels[depth] = [keys, n0, n1, share, None]
            if depth < DEPTH:
                self.levels[depth + 1][4] = parent
            if depth > least:
                above, parent = np.unique(((keys >> 16) << 8) | (keys & 255), return_inverse=True)
                n0, n1, below = (np.bincount(parent, x, minlength=len(above)) for x in (n0, n1, whole))
                own = _kt(n0, n1)
                keys, whole = above, np.logaddexp(own, below) - _LOG2
                share = np.exp(own - _LOG2 - whole)
        self.whole = whole

    def chances(self, sure: np.ndarray, rest: np.ndarray) -> dict[int, np.ndarray]:
        """Of each node: the probability of a one if it is the deepest that training met. sure and rest: what the depths
        above ``least`` have settled for each of its nodes, and the weight they leave."""
        s, r = sure, rest
        out = {}
        for depth in range(self.least, DEPTH + 1):
            _, n0, n1, share, parent = self.levels[depth]
            if depth > self.least:
                s, r = s[parent], r[parent]
            one = _one(n0, n1)
            out[depth] = s + r * one
            s, r = s + r * share * one, r * (1 - share)
        return out


def _cut(key: np.ndarray) -> list[tuple[int, int]]:
    """Slices of a tree's sorted keys that end between contexts of three bytes."""
    edge = np.append(np.flatnonzero(np.diff(key >> 32)) + 1, len(key))
    out, at = [], 0
    while at < len(key):
        end = int(edge[min(np.searchsorted(edge, at + _SLICE), len(edge) - 1)])
        out.append((at, end))
        at = end
    return out


class _Tree:
    """All nodes under two last bytes, or those of a part: of depth 2 at once, deeper ones slice by slice.

    of_all: the sums of depth 2 (zeros, ones, probabilities below) over all parts of the tree."""

    def __init__(self, key: np.ndarray, n: np.ndarray, of_all: np.ndarray | None = None):
        self.key, self.n, self.last = key, n, int(key[0] >> 48)
        self.slices = _cut(key)
        self.only = None
        if of_all is None:
            of_all = np.zeros((3, 256))
            for a, b in self.slices:
                if (sub := self._sub(a, b)) is None:
                    continue
                keys, n0, n1, _, _ = sub.levels[3]
                for total, x in zip(of_all, (n0, n1, sub.whole)):
                    total += np.bincount(keys & 255, x, minlength=256)
                self.only = sub if len(self.slices) == 1 else None
        self.sums = of_all
        self.n0, self.n1, below = of_all
        self.met = self.n0 + self.n1 > 0
        own = _kt(self.n0, self.n1)
        self.whole = np.where(self.met, np.logaddexp(own, below) - _LOG2, 0)
        self.share = np.exp(own - _LOG2 - self.whole)

    def _sub(self, a: int, b: int) -> _Subtree | None:
        met = self.n[a:b] > 0
        return _Subtree(self.key[a:b][met], self.n[a:b][met], 3) if met.any() else None

    def log_chances(self, top) -> np.ndarray:
        """log10 of the probability of each key's byte in its context."""
        sure, rest, q1 = (x[self.last] for x in top)
        one = _one(self.n0, self.n1)
        q2 = np.where(self.met, sure + rest * one, q1)
        sure, rest = sure + rest * self.share * one, rest * (1 - self.share)
        out = np.zeros(len(self.key))
        for a, b in self.slices:
            sub = self.only or self._sub(a, b)
            known = sub.chances(sure[sub.levels[3][0] & 255], rest[sub.levels[3][0] & 255]) if sub else {}
            byte, context = self.key[a:b] & 255, self.key[a:b] >> 8
            for bit in range(8):
                m = (256 | byte) >> (8 - bit)
                p = q2[m]
                left = np.arange(b - a)
                for depth in range(DEPTH, 2, -1) if sub else ():
                    keys = sub.levels[depth][0]
                    want = ((context[left] >> (8 * (DEPTH - depth))) << 8) | m[left]
                    at = np.minimum(np.searchsorted(keys, want), len(keys) - 1)
                    hit = keys[at] == want
                    p[left[hit]] = known[depth][at[hit]]
                    left = left[~hit]
                    if not len(left):
                        break
                out[a:b] += np.log10(np.where((byte >> (7 - bit)) & 1, p, 1 - p))
        return out


def _top(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """From the sums of depth-2 nodes by last byte and node: sure and rest for depth 2, and the probability of a one where
    depth 2 has not met a node."""
    n0, n1, below = (np.zeros((256, 256)) for _ in range(3))
    b, m = rows["last"].to_numpy(), rows["node"].to_numpy()
    n0[b, m], n1[b, m], below[b, m] = rows["n0"], rows["n1"], rows["whole"]
    own1 = _kt(n0, n1)
    whole1 = np.where(n0 + n1 > 0, np.logaddexp(own1, below) - _LOG2, 0)
    own0 = _kt(n0.sum(0), n1.sum(0))
    whole0 = np.logaddexp(own0, whole1.sum(0)) - _LOG2
    share0, share1 = np.exp(own0 - _LOG2 - whole0), np.exp(own1 - _LOG2 - whole1)
    one0, one1 = _one(n0.sum(0), n1.sum(0)), _one(n0, n1)
    q1 = np.where(n0 + n1 > 0, share0 * one0 + (1 - share0) * one1, one0)
    sure = share0 * one0 + (1 - share0) * share1 * one1
    return sure, (1 - share0) * (1 - share1), q1


def _runs(batches, key: tuple[str, ...], columns: tuple[str, ...]) -> Iterator[tuple[tuple, Iterator[list]]]:
    """Each key and its rows, one after the other, from batches that are sorted by key. Nothing is kept of rows that went by."""

    def rows():
        for batch in batches:
            for at in range(batch.num_rows):  # one at a time: a row may hold megabytes
                yield tuple(batch.column(k)[at].as_py() for k in key), [batch.column(c)[at].as_py() for c in columns]

    for k, some in groupby(rows(), lambda r: r[0]):
        yield k, (r for _, r in some)


def _cut_up(batches, parts: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (tree, block, pairs, times) with the part of the tree that they belong to; those of trees of several parts as several rows."""
    names, kinds = ["tree", "part", "block", "pairs", "times"], (pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
    for batch in slices(batches, 64):
        for tree, block, pairs, times in zip(*(batch.column(c).to_pylist() for c in ("tree", "block", "pairs", "times"))):
            rows = [(tree, 0, block, pairs, times)]
            if parts[tree] > 1:
                key, n = _keys_of(pairs, tree), _unplanes(times)
                part, first = np.unique((key >> 32 & 255) * parts[tree] >> 8, return_index=True)
                ends = np.append(first[1:], len(key))
                rows = [(tree, int(k), block, _planes(np.diff(key[a:b], prepend=tree << 40)), _planes(n[a:b])) for k, a, b in zip(part, first, ends)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def _merged(batches) -> Iterator[pa.RecordBatch]:
    """(tree, part, pairs, times, sums): the distinct pairs of each part over all blocks, and what they add to depth 2."""
    for (tree, part), rows in _runs(batches, ("tree", "part"), ("pairs", "times")):
        total = _Sum()
        for pairs, times in rows:
            total.add(_keys_of(pairs, tree), _unplanes(times))
        key, n = total.total()
        values = (tree, part, _planes(np.diff(key, prepend=tree << 40)), _planes(n), _packed(_Tree(key, n).sums.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, (pa.int32(), pa.int32(), *[pa.binary()] * 3))], ["tree", "part", "pairs", "times", "sums"])


def _summed_parts(batches) -> Iterator[pa.RecordBatch]:
    """(tree, sums) of whole trees."""
    for (tree,), rows in _runs(batches, ("tree",), ("sums",)):
        total = np.zeros((3, 256))
        for (sums,) in rows:
            total += np.frombuffer(_unpacked(sums)).reshape(3, 256)
        yield pa.RecordBatch.from_arrays([pa.array([tree], pa.int32()), pa.array([_packed(total.tobytes())], pa.binary())], ["tree", "sums"])


def _roots(batches) -> Iterator[pa.RecordBatch]:
    """Counts and probabilities of nodes of depth 2, by last byte."""
    for batch in slices(batches):
        for tree, sums in zip(batch.column("tree").to_pylist(), batch.column("sums").to_pylist()):
            t = _Tree(np.array([tree << 40]), np.zeros(1, np.int64), np.frombuffer(_unpacked(sums)).reshape(3, 256))
            node = np.flatnonzero(t.met)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(node), t.last)), pa.array(node), *(pa.array(x[node]) for x in (t.n0, t.n1, t.whole))], ["last", "node", "n0", "n1", "whole"])


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of (doc_id, text, held_out).

    The model and the counts learn from rows whose held_out is false; null counts as true. Tokens are words (runs of bytes
    other than ASCII white space, A-Z lower-cased) and one end. base_score sums log10((c + 1) / (N + V + 1)); score is the
    context tree's log10 probability of the text, lower-cased and with single spaces as tokens have it. Null, empty and
    blank texts are the end alone. Repeated rows each count, rows with null doc_id as well. Without anything to learn from,
    every bit is even. Other columns take no part.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce("held_out", F.lit(True)).alias("held_out"))
    tables = materialize(rows.mapInArrow(_blocks, _TABLES), "blocks")
    named = tables.where("bucket IS NOT NULL").select("bucket", "block", "words", "times")
    counted = named.drop("block").repartition("bucket").sortWithinPartitions("bucket")
    counted = materialize(counted.mapInArrow(_counts, "bucket int, words binary, times binary, n_words long, n_known long"), "word-counts")
    end = tables.agg(F.coalesce(F.sum(F.expr("size(filter(held_out, x -> NOT x))")), F.lit(0))).first()[0]  # ends that are learned
    n, v = counted.agg(F.coalesce(F.sum("n_words"), F.lit(0)), F.coalesce(F.sum("n_known"), F.lit(0))).first()
    total = (n + end, v + (end > 0))
    asked = named.unionByName(counted.select("bucket", F.lit(None).cast("long").alias("block"), "words", "times"))
    known = asked.repartition("bucket").sortWithinPartitions("bucket", F.asc_nulls_first("block")).mapInArrow(_looked_up, "block long, bucket int, c binary")

    of_trees = tables.where("tree IS NOT NULL").select("tree", "block", "pairs", "times")
    size = of_trees.groupBy("tree").agg(F.sum(F.octet_length("pairs") + F.octet_length("times")).alias("n")).where(F.col("n") > PART).collect()  # of 65,280 trees at most
    parts = np.ones(1 << 16, dtype=np.int64)
    for r in size:
        parts[r["tree"]] = min(256, -(-r["n"] // PART))
    dealt = of_trees.mapInArrow(lambda batches: _cut_up(batches, parts), "tree int, part int, block long, pairs binary, times binary")
    merged = dealt.drop("block").repartition("tree", "part").sortWithinPartitions("tree", "part")
    merged = materialize(merged.mapInArrow(_merged, "tree int, part int, pairs binary, times binary, sums binary"), "trees")
    whole = merged.select("tree", "sums").repartition("tree").sortWithinPartitions("tree").mapInArrow(_summed_parts, "tree int, sums binary")
    whole = materialize(whole, "tree-sums")
    found = whole.mapInArrow(_roots, "last long, node long, n0 double, n1 double, whole double")
    top = spark.sparkContext.broadcast(_top(found.groupBy("last", "node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "whole"))).toPandas()))

    def chances(batches):
        for (t, _), rows in _runs(batches, ("tree", "part"), ("block", "pairs", "times", "sums")):
            for block, pairs, times, sums in rows:
                key = _keys_of(pairs, t)
                if block is None:  # what was merged comes before the blocks
                    have = key
                    p = _Tree(key, _unplanes(times), np.frombuffer(_unpacked(sums)).reshape(3, 256)).log_chances(top.value)
                    continue
                yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([t], pa.int32()), pa.array([pairs], pa.binary()), pa.array([_fixed(p[np.searchsorted(have, key)])], pa.binary())], ["block", "tree", "pairs", "p"])

    first = merged.drop("sums").join(whole, "tree").withColumn("block", F.lit(None).cast("long"))
    both = dealt.unionByName(first, allowMissingColumns=True).repartition("tree", "part").sortWithinPartitions("tree", "part", F.asc_nulls_first("block"))
    priced = both.mapInArrow(chances, "block long, tree int, pairs binary, p binary")
    looked_up = priced.unionByName(known, allowMissingColumns=True)
    base = np.log10(total[0] + total[1] + 1)

    def add_up(texts: pa.Table, found: pa.Table) -> pa.Table:
        ids, held, closed = (texts.column(c)[0].as_py() for c in ("doc_id", "held_out", "text"))
        closed = _unpacked(closed)
        word = np.unique(np.concatenate([np.unique(Words(some, lower=False).hash) for some in _split(closed)]))
        buckets = found.filter(pa.compute.is_valid(found["bucket"])).select(["bucket", "c"]).sort_by("bucket")
        count = np.concatenate([np.zeros(0, np.int64), *map(_unplanes, buckets["c"].to_pylist())])
        word = pd.Index(word[_in_order(word)])
        trees = found.filter(pa.compute.is_valid(found["tree"])).select(["tree", "pairs", "p"])
        place = pd.Index(np.concatenate([_keys_of(b, t) for t, b in zip(trees["tree"].to_pylist(), trees["pairs"].to_pylist())]))
        worth = _unfixed(b"".join(trees["p"].to_pylist()))
        del found, trees, buckets
        parts = []
        for some in _split(closed):
            w = Words(some, lower=False)
            n = count[word.get_indexer(w.hash)]
            tokens, seen, value = (np.bincount(w.doc, x, minlength=len(some)) for x in (None, n > 0, np.log10(n + 1) - base))
            key, length = _keys(some)
            p = np.add.reduceat(worth[place.get_indexer(key)], np.cumsum(length) - length)
            parts.append((tokens + 1, seen + (end > 0), value + np.log10(end + 1) - base, p))
        tokens, seen, value, p = (np.concatenate([x[i] for x in parts]) for i in range(4))
        values = (ids, held, tokens.astype(np.int64), seen.astype(np.int64), np.full(len(ids), total[0]), value, p)
        kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.table([pa.array(v, k) for v, k in zip(values, kinds)], [x.split()[0] for x in schema.split(", ")])

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    texts = tables.where("text IS NOT NULL").select(F.col("block").alias("own"), "doc_id", "held_out", "text")
    return texts.groupBy("own").cogroup(looked_up.groupBy("block")).applyInArrow(add_up, schema)
