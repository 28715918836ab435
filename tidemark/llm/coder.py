"""Token ids as files of independently reset, checksummed blocks, by an adaptive context-mixing range coder.

A frame's head lists its ids and their shares (order 0). Within a block, what last followed the two ids before (order 2) or else
what most often followed the one before (order 1) is the candidate for the next id. How likely it is, is predicted three
times: from how often order 2 and order 1 were right, and from the id's share. A logistic mixture of the three, whose
weights learn from each outcome, drives the coder. An id that is not the candidate is coded by its share.
Blocks start from nothing, so each can be decoded alone with its frame's head.

A file's rows are frames: whole documents in ascending doc_id order, cut into blocks of BLOCK ids. All blocks of a frame
are coded in lockstep, one numpy lane per block; numpy's price of a step hardly depends on the lanes, so that frames are large.
All arithmetic is of whole numbers (one division is of doubles, whose floor is exact), so that frames decode alike everywhere.
Files are written and read by Spark, as Parquet.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .store import slices, spread
from .tokens import PieceEncoder

MAGIC = b"TMK3"
BLOCK = 1024  #: ids
FRAME = 1 << 23  #: ids
_SLOTS = 1024  #: contexts of each order that a block remembers
_FRAME = "part int, before long, n_ids long, doc_id array<long>, sizes array<long>, head binary, payload binary"
_ONE = 1 << 16  #: probabilities are of so many parts

#: the logistic function of x / 128 for x from -1023 to 1023, in parts of _ONE
_SQUASH = np.clip(np.rint(_ONE / (1 + np.exp(-np.arange(-1023, 1024) / 128))), 64, _ONE - 1024).astype(np.int64)


class _Range:
    """A range coder per lane: a range below 2**48 is kept at 2**32 at least by words of 16 bits; carries are added at the end."""

    def __init__(self, lanes: int, blocks: list[bytes] | None = None):
        self.range = np.full(lanes, (1 << 48) - 1, dtype=np.int64)
        self.low = np.zeros(lanes, dtype=np.int64)  # decoding: how far the code is above it
        self.decoding = blocks is not None
        if self.decoding:
            # two words of zeros behind each block, as far as it is read
            self.words = np.frombuffer(b"".join(b + bytes(4) for b in blocks) + bytes(8), dtype="<u2").astype(np.int64)
            n = np.array([len(b) // 2 + 2 for b in blocks], dtype=np.int64)
            self.at = np.cumsum(n) - n
            for _ in range(3):
                self.low = self.low << 16 | self.words.take(self.at, mode="clip")
                self.at += 1
        else:
            self.width = 2 * BLOCK + 8
            self.words = np.zeros(lanes * self.width, dtype=np.int32)
            self.at = np.arange(lanes, dtype=np.int64) * self.width

    def shift(self, low: np.ndarray, size: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Write or read words of the lanes whose range is small, until none is."""
        small = size < (1 << 32)
        while True:
            by = small.astype(np.int64)
            if self.decoding:
                word = self.words.take(at, mode="clip")
                word *= by
                at += by
                by <<= 4
                low = low << by
                low |= word
            else:
                self.words[at] = low >> 32  # written anew where the lane stays
                at += by
                by <<= 4
                low = np.where(small, low & 0xFFFFFFFF, low) << by
            size = size << by
            small = size < (1 << 32)
            if not small.any():
                return low, size

    def finish(self) -> list[bytes]:
        self.words[self.at] = (self.low + 0xFFFFFFFF) >> 32
        self.at += 1
        over = np.flatnonzero(self.words > 0xFFFF)
        while len(over):
            self.words[over] &= 0xFFFF
            over = over - 1
            self.words[over] += 1
            over = over[self.words[over] > 0xFFFF]
        return [self.words[i * self.width : at].astype("<u2").tobytes() for i, at in enumerate(self.at.tolist())]


def _run(coder: _Range, last: int, parts: np.ndarray, table: np.ndarray) -> None:
    """Code table (BLOCK x lanes: places in the list of ids) or fill it in. last: ids of the last lane; the others have BLOCK.
    parts: of each listed id, a power of two in all."""
    lanes, total = table.shape[1], int(parts.sum())
    bits, listed = total.bit_length() - 1, len(parts)
    # behind the list: nothing more to say
    size, start = np.append(parts, total), np.append(np.cumsum(parts) - parts, 0)
    of = np.repeat(np.arange(listed), parts) if coder.decoding else None
    share = np.rint(256 * np.log(parts / np.maximum(1, total - parts))).astype(np.int32)
    # for each order and context: the candidate, and in three bits how far it is trusted (0: none)
    next1, next2 = (np.zeros(lanes * _SLOTS, dtype=np.int32) for _ in range(2))
    base = np.arange(lanes, dtype=np.int64) * _SLOTS
    w2, w1, w0 = (np.full(lanes, w, dtype=np.int32) for w in (24_000, 16_000, 8_000))
    r1 = r2 = np.zeros(lanes, dtype=np.int64)
    low, span, at = coder.low, coder.range, coder.at
    for t in range(BLOCK if lanes > 1 else last):
        if t == last:
            coder.low = low
            m = lanes - 1
            base, w2, w1, w0, r1, r2, low, span, at = (x[:m] for x in (base, w2, w1, w0, r1, r2, low, span, at))
        a1 = (r1 & (_SLOTS - 1)) + base
        a2 = r2 * 361
        a2 += r1
        a2 &= _SLOTS - 1
        a2 += base
        e1, e2 = next1.take(a1), next2.take(a2)
        q1, q2, c1, c2 = e1 & 7, e2 & 7, e1 >> 3, e2 >> 3
        some = (q1 | q2) > 0
        c = np.where(q2, c2, c1)
        x2, x1 = q2 * 150, q1 * 80
        np.negative(x1, out=x1, where=c1 != c)
        c = c.astype(np.int64)
        x0 = share.take(c)
        z = w2 * x2
        z += w1 * x1
        z += w0 * x0
        z >>= 17
        z += 1023
        p = _SQUASH.take(z, mode="clip")
        p *= some
        # whether the candidate comes; then which id else
        bound = span >> 16
        bound *= p
        if coder.decoding:
            hit = low < bound
            low = np.where(hit, low, low - bound)
            span = np.where(hit, bound, span - bound)
            r = span >> bits
            s = np.where(hit, c, of.take((low / r).astype(np.int64), mode="clip"))
            table[t, : len(s)] = s
            k = np.where(hit, listed, s)
            low -= start.take(k) * r
        else:
            s = table[t, : len(c)].astype(np.int64)
            hit = (s == c) & some
            span = np.where(hit, bound, span - bound)
            r = span >> bits
            k = np.where(hit, listed, s)
            bound += start.take(k) * r
            low = low + np.where(hit, 0, bound)
        low, span = coder.shift(low, size.take(k) * r, at)
        error = (hit * _ONE - p).astype(np.int32)
        error *= some
        for w, x in ((w2, x2), (w1, x1), (w0, x0)):
            x *= error
            x >>= 14
            w += x
        # order 2 follows the last id, order 1 changes once others have worn its candidate down
        got = s.astype(np.int32)
        new = got << 3
        new |= 1
        next2[a2] = np.where(c2 == got, e2 + (q2 < 7), new)
        next1[a1] = np.where(c1 == got, e1 + (q1 < 7), np.where(q1 > 2, e1 - 2, new))
        r2, r1 = r1, s
    if len(low) < lanes:
        coder.low[: len(low)] = low
    else:
        coder.low = low


def _lanes(n: int) -> np.ndarray:
    count = -(-n // BLOCK)
    return np.minimum(BLOCK, n - np.arange(count) * BLOCK)


def _parts(often: np.ndarray) -> np.ndarray:
    """Shares in whole parts, one at least, a power of two in all."""
    total = 1 << max(16, len(often).bit_length() + 2)
    parts = 1 + often * (total - len(often)) // max(1, int(often.sum()))
    parts[np.argmax(parts)] += total - parts.sum()
    return parts


def _prior(ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, bytes]:
    """(the listed ids, their parts, the two packed) where listing them pays, else all of the vocabulary alike and no bytes."""
    often = np.bincount(ids, minlength=size)
    listed = np.flatnonzero(often)
    often = often[listed]
    every = np.arange(size), _parts(np.ones(size, dtype=np.int64)), b""
    if not len(listed):
        return every
    parts = _parts(often)
    packed = zlib.compress(np.diff(listed, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 9)
    packed = np.array([len(listed), len(packed)], dtype="<u4").tobytes() + packed + zlib.compress(parts.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 9)
    spared = (often * (np.log2(size) + np.log2(parts / parts.sum()))).sum()
    return (listed, parts, packed) if spared > 8 * len(packed) else every


def _unprior(packed: bytes, size: int) -> tuple[np.ndarray, np.ndarray]:
    if not packed:
        return np.arange(size), _parts(np.ones(size, dtype=np.int64))
    n, first = np.frombuffer(packed[:8], dtype="<u4").tolist()
    steps, parts = (np.frombuffer(zlib.decompress(x), dtype=np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64) for x in (packed[8 : 8 + first], packed[8 + first :]))
    return np.cumsum(steps), parts


def encode(ids: np.ndarray, size: int) -> tuple[bytes, bytes]:
    """(head, payload) of a frame. The head: magic, vocabulary size, number of blocks, bytes of the list of ids, CRC-32 of these numbers
    and of what follows: that list, and for each block its ids, its bytes, and the CRC-32 of both."""
    ids = ids.astype("<u4")
    length = _lanes(len(ids))
    listed, parts, packed = _prior(ids, size)
    place = np.zeros(size, dtype=np.int32)
    place[listed] = np.arange(len(listed))
    table = np.zeros(len(length) * BLOCK, dtype=np.int32)
    table[: len(ids)] = place[ids]
    table = np.ascontiguousarray(table.reshape(-1, BLOCK).T)
    blocks = []
    if len(ids):
        coder = _Range(len(length))
        _run(coder, int(length[-1]), parts, table)
        blocks = coder.finish()
    rows = np.array([[n, len(b), zlib.crc32(b), zlib.crc32(ids[i * BLOCK : i * BLOCK + n])] for i, (n, b) in enumerate(zip(length.tolist(), blocks))], dtype="<u4")
    numbers = np.array([size, len(blocks), len(packed)], dtype="<u4").tobytes()
    rest = packed + rows.tobytes()
    return MAGIC + numbers + np.array([zlib.crc32(numbers + rest)], dtype="<u4").tobytes() + rest, b"".join(blocks)


def decode(head: bytes, payload: bytes) -> np.ndarray:
    """The ids of a frame; ValueError if anything of it has changed."""
    if head[:4] != MAGIC:
        raise ValueError("not a frame of token ids")
    size, count, packed, check = np.frombuffer(head[4:20], dtype="<u4").tolist()
    if zlib.crc32(head[4:16] + head[20:]) != check:
        raise ValueError("the frame's head is damaged")
    rows = np.frombuffer(head[20 + packed :], dtype="<u4").reshape(count, 4).tolist()
    blocks, at = [], 0
    for i, (_, n, crc, _) in enumerate(rows):
        blocks.append(payload[at : at + n])
        at += n
        if zlib.crc32(blocks[-1]) != crc:
            raise ValueError(f"block {i} is damaged")
    if not count:
        return np.zeros(0, dtype=np.uint32)
    listed, parts = _unprior(head[20 : 20 + packed], size)
    table = np.zeros((BLOCK, count), dtype=np.int32)
    _run(_Range(count, blocks), rows[-1][0], parts, table)
    out = listed.astype("<u4")[table.T.ravel()][: (count - 1) * BLOCK + rows[-1][0]]
    for i, (n, _, _, crc) in enumerate(rows):
        if zlib.crc32(out[i * BLOCK : i * BLOCK + n]) != crc:
            raise ValueError(f"block {i} does not decode to its ids")
    return out


def write(docs: DataFrame, vocabulary: str, end_id: int, path: str, size: int | None = None) -> None:
    """Encode every text (null: empty), the end id behind each, in ascending doc_id order into files under ``path``.

    Rows with null doc_id come first, rows that repeat a doc_id one after the other. An empty table gives files without a row.
    """

    def code(batches):
        encoder = PieceEncoder.of(vocabulary, memory=1_000_000)
        vocab = size or max(encoder.tokenizer.get_vocab_size(), end_id + 1)
        part, before, held, docs_, sizes, n = TaskContext.get().partitionId(), 0, [], [], [], 0

        def flush():
            nonlocal before
            head, payload = encode(np.concatenate(held), vocab)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
            row = [part, before, n, docs_, sizes, head, payload]
            before += n
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], [c.split()[0] for c in _FRAME.split(", ")])

        for batch in slices(batches, 2000, tokenizes=True):
            ids, count = encoder.ids([t or "" for t in batch.column("text").to_pylist()])
            stop = np.cumsum(count)
            for doc, a, b in zip(batch.column("doc_id").to_pylist(), stop - count, stop):
                if held and n + b - a + 1 > FRAME:
                    yield flush()
                    held, docs_, sizes, n = [], [], [], 0
                held.append(np.append(ids[a:b], np.uint32(end_id)))
                docs_.append(doc)
                sizes.append(int(b - a + 1))
                n += int(b - a + 1)
        if held:
            yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(spread(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(code, _FRAME).write.parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) in the files' order: start counts the ids of all documents before."""
    frames = spark.read.schema(_FRAME).parquet(path)
    parts = frames.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per file
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before_part"))

    def decoded(batches):
        for batch in slices(batches, 1):
            for row in batch.to_pylist():
                ids = decode(row["head"], row["payload"])
                n = np.array(row["sizes"], dtype=np.int64)
                stop = np.cumsum(n)
                for a in range(0, len(n), 500):
                    some = slice(a, a + 500)
                    lo, hi = stop[some][0] - n[some][0], stop[some][-1]
                    bound = np.concatenate([[lo], stop[some]]) - lo
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([row["part"]] * len(n[some]), pa.int32()), pa.array(row["doc_id"][some], pa.int64()), pa.array(row["before"] + stop[some] - n[some]), pa.array(n[some]),
                         pa.array([ids[lo + x : lo + y].astype("<u4").tobytes() for x, y in zip(bound, bound[1:])], pa.binary())],
                        ["part", "doc_id", "local", "n_tokens", "ids"],
                    )

    docs = frames.select("part", "before", "doc_id", "sizes", "head", "payload").mapInArrow(decoded, "part int, doc_id long, local long, n_tokens long, ids binary")
    docs = docs.join(F.broadcast(parts), "part")  # one row per file, of which there are as many as shuffle partitions
    return docs.select("doc_id", (F.col("before_part") + F.col("local")).alias("start"), "n_tokens", "ids")
