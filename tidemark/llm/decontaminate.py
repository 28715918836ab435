"""Benchmark decontamination by SimHash of item-sized windows.

Every item is fingerprinted over its word pairs, once for each of ``STRIDE`` offsets, so that documents need windows at every
``STRIDE``-th word only and an unchanged item always meets a window with its own fingerprint. Window sizes follow the items:
exact for short ones, in steps of five per cent for longer ones. A fingerprint of 64 bits is four blocks of 16; blocks
within two bits of an item's are looked up in tables, which by the pigeonhole principle finds every fingerprint within
11 bits. All passages around those windows are verified by exact weighted-shingle similarity.

That finds nearly all. Near the threshold a fingerprint may be further off, and a text may be shorter than an item's window. A
passage that is similar enough lacks at most a known share of an item's shingles, so that it has one of any few more: these are looked up in every
text, and where one is found all passages are compared. No passage is missed, whatever its fingerprint.
"""

from __future__ import annotations

from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import slices
from .words import U64, Words, chunks, encoded

STRIDE = 4
RADIUS = 11
ITEMS = 5_000  #: items broadcast at once; more are worked off in rounds
_CHUNK = 1 << 20
_BALL = np.array([0, *(1 << i for i in range(16)), *((1 << i) | (1 << j) for i, j in combinations(range(16), 2))], dtype=np.uint16)


def _grid(n: int) -> int:
    """The largest window size up to n."""
    size = 1
    while (after := max(size + 1, int(size * 1.05))) <= n:
        size = after
    return size


class _Bits:
    """Fingerprints of windows from running sums of each bit."""

    def __init__(self, words: Words):
        pairs, _ = words.windows(2)
        self.pairs, self.single = self._sums(pairs), words.hash
        self.strided = [np.ascontiguousarray(self.pairs[r::STRIDE]) for r in range(STRIDE)]

    @staticmethod
    def _sums(h: np.ndarray) -> np.ndarray:
        out = np.zeros((len(h) + 1, 64), dtype=np.uint16)
        if len(h):
            # sums wrap, differences of nearby ones do not; running along the rows of the transpose is the fast way
            bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).T.astype(np.uint16, order="C")
            out[1:] = np.add.accumulate(bits, axis=1, dtype=np.uint16, out=bits).T
        return out

    def every(self, step: int, size: int) -> np.ndarray:
        """Fingerprints of the windows that start at every ``step``-th word (also of those across texts)."""
        n = max(0, -(-(len(self.single) - size + 1) // step))
        if size == 1:
            return self.single[::step][:n]
        m = size - 1
        if step == STRIDE:
            over = self.strided[m % step][m // step : m // step + n] - self.strided[0][:n]
        else:
            over = self.pairs[m::step][:n] - self.pairs[::step][:n]
        return np.packbits(over > m // 2, axis=None).view(U64)


def _shingles(words: Words, n: int) -> tuple[np.ndarray, int]:
    k = min(5, n) or 1
    return words.windows(k)[0], k


class Index:
    """Fingerprints of the items by window size, their block tables, and their shingles."""

    def __init__(self, items: list[tuple[int, bytes]], threshold: float = 0.8):
        self.items, self.texts = [], []
        sizes: dict[int, list] = {}
        for item, text in items:
            words = Words([text], lower=True)
            n = len(words.hash)
            if not n:
                continue
            grams, k = _shingles(words, n)
            step = STRIDE if n >= 2 * STRIDE else 1
            size = _grid(n - step + 1)
            prints = _Bits(words).every(1, size)[:step]
            sizes.setdefault((size, step), []).extend((int(p), len(self.items), o) for o, p in enumerate(prints))
            self.items.append((item, n, k, Counter(grams.tolist())))
            self.texts.append(text)
        self.sizes = {}
        for key, rows in sizes.items():
            prints = np.array([r[0] for r in rows], dtype=U64)
            tables = np.zeros((4, 1 << 16), dtype=bool)
            for b, block in enumerate(prints.view(np.uint16).reshape(-1, 4).T):
                tables[b, (block[:, None] ^ _BALL).ravel()] = True
            self.sizes[key] = (prints, tables, np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        often = Counter(g for _, _, _, own in self.items for g in own)
        asked: dict[int, list] = {}
        for place, (_, _, k, own) in enumerate(self.items):
            spare = int((1 - threshold) * own.total() + 1e-9)  # so many may be lacking
            for g in sorted(own, key=lambda g: (often[g], g)):
                asked.setdefault(k, []).append((g, place))
                spare -= own[g]
                if spare < 0:
                    break
        self.asked = {}
        for k, pairs in asked.items():
            pairs.sort()
            hashes = np.array([g for g, _ in pairs], dtype=U64)
            table = np.zeros(1 << 16, dtype=bool)
            table[hashes & U64(0xFFFF)] = True
            self.asked[k] = (hashes, np.array([x for _, x in pairs]), table)

    def candidates(self, words: Words):
        """(item's place, first word, distance) of windows within the radius."""
        if not len(words.hash):
            return
        bits = _Bits(words)
        for (size, step), (prints, tables, place, offset) in self.sizes.items():
            got = bits.every(step, size)
            blocks = got.view(np.uint16).reshape(-1, 4)
            hit = np.flatnonzero(tables[0][blocks[:, 0]] | tables[1][blocks[:, 1]] | tables[2][blocks[:, 2]] | tables[3][blocks[:, 3]])
            hit = hit[words.doc[hit * step] == words.doc[hit * step + size - 1]]
            for at in range(0, len(hit), 50_000):
                some = hit[at : at + 50_000]
                apart = np.bitwise_count(got[some][:, None] ^ prints[None])
                w, p = np.nonzero(apart <= RADIUS)
                yield from zip(place[p].tolist(), (some[w] * step - offset[p]).tolist(), apart[w, p].tolist(), words.doc[some[w] * step].tolist())

    def sharing(self, words: Words, grams: dict[int, np.ndarray]) -> set[tuple[int, int]]:
        """(text's place, item's place) of texts that have a shingle which similar passages cannot all lack."""
        out: set = set()
        for k, (hashes, place, table) in self.asked.items():
            if k not in grams:
                grams[k] = words.windows(k)[0]
            hit = np.flatnonzero(table[grams[k] & U64(0xFFFF)])
            hit = hit[words.doc[hit] == words.doc[hit + k - 1]]
            lo, hi = np.searchsorted(hashes, grams[k][hit]), np.searchsorted(hashes, grams[k][hit], side="right")
            for doc, a, b in zip(words.doc[hit[lo < hi]].tolist(), lo[lo < hi].tolist(), hi[lo < hi].tolist()):
                out.update((doc, x) for x in place[a:b].tolist())
        return out

    def passages(self, grams: np.ndarray, place: int, threshold: float):
        """(similarity, first word, words) of all similar passages of a text that begin and end with shingles of the item:
        without them at its ends a passage is more similar."""
        _, _, k, own = self.items[place]
        total = own.total()
        at = np.flatnonzero(np.isin(grams, np.fromiter(own, dtype=U64, count=len(own)))).tolist()
        seen = grams[at].tolist()
        longest, least = total / threshold + 1e-9, threshold * total - 1e-9
        until = 0
        for i, first in enumerate(at):
            while until < len(at) and at[until] - first + 1 <= longest:
                until += 1
            if until - i < least:
                continue
            left, common = dict(own), 0
            for j in range(i, until):
                if left[seen[j]] > 0:
                    left[seen[j]] -= 1
                    common += 1
                size = at[j] - first + 1
                similarity = common / (total + size - common)
                if similarity >= threshold:
                    yield similarity, first, size + k - 1

    def apart(self, words: Words, first: int, n: int, place: int) -> int:
        """Distance of the fingerprints of a passage and of the whole item."""
        of = lambda h: np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0) > len(h) // 2 if len(h) else np.zeros(64, bool)
        pairs = words.windows(2)[0][first : first + n - 1] if n > 1 else words.hash[first : first + 1]
        item = Words([self.texts[place]], lower=True)
        own = item.windows(2)[0] if len(item.hash) > 1 else item.hash
        return int((of(pairs) != of(own)).sum())

    def _around(self, words: Words) -> dict[tuple[int, int], list[tuple[int, int, int]]]:
        """(text's place, item's place) to stretches of words (from, to, least distance) in which passages are looked for: a quarter of
        the item's length to either side of each window within the radius, one stretch where they meet."""
        out: dict[tuple[int, int], list] = {}
        for place, a, apart, doc in sorted(set(self.candidates(words)), key=lambda c: (c[3], c[0], c[1])):
            n = self.items[place][1]
            x, y = max(a - n // 4 - 5, int(words.first[doc])), min(a + n + n // 4 + 5, int(words.first[doc + 1]))
            spans = out.setdefault((doc, place), [])
            if spans and x <= spans[-1][1]:
                x, _, least = spans.pop()
                apart = min(apart, least)
            if x < y:
                spans.append((x, y, apart))
        return out

    def verify(self, words: Words, threshold: float, whole: bool = True):
        """(text's place, item_id, first word, words, similarity, distance), the best of overlapping ones. Without ``whole`` only
        fingerprints lead to passages."""
        grams: dict[int, np.ndarray] = {}
        best: dict[tuple[int, int], list] = {}
        for (doc, place), spans in self._around(words).items():
            k = self.items[place][2]
            if k not in grams:
                grams[k] = words.windows(k)[0]
            for x, y, apart in spans:
                found = self.passages(grams[k][x : y - k + 1], place, threshold)
                best.setdefault((doc, place), []).extend((-s, x - int(words.first[doc]) + first, m, apart) for s, first, m in found)
        for doc, place in self.sharing(words, grams) if whole else ():
            lo, hi, k = int(words.first[doc]), int(words.first[doc + 1]), self.items[place][2]
            best.setdefault((doc, place), []).extend((-s, x, m, 65) for s, x, m in self.passages(grams[k][lo : hi - k + 1], place, threshold))
        for (doc, place), hits in best.items():
            taken: list = []
            for s, x, m, apart in sorted(hits):
                if all(x + m <= t[1] or t[1] + t[2] <= x for t in taken):
                    taken.append((s, x, m, apart))
            for s, x, m, apart in taken:
                yield doc, self.items[place][0], int(x), int(m), -s, int(apart) if apart <= 64 else self.apart(words, int(words.first[doc]) + x, m, place)


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, whole: bool = True) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, distance): each passage of a document whose five-word shingles,
    weighted by how often they occur, have a Jaccard similarity of at least ``threshold`` to those of an item.

    Words are runs of bytes other than ASCII white space, A-Z lower-cased; items of fewer than five words are one shingle.
    Null and empty texts or items give nothing; equal items each give their rows, and so do rows that repeat a doc_id. A document's
    null doc_id is an id like others, items with null item_id are left out. Other columns take no part. The items are broadcast, ITEMS
    at a time, so what is broadcast is bounded whatever the benchmark's size. Without ``whole`` only what fingerprints lead to is found.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text")).where("text IS NOT NULL AND item_id IS NOT NULL")
    rounds = max(1, -(-items.count() // ITEMS))
    schema = "doc_id long, item_id long, start_word int, n_words int, similarity double, distance int"
    out = None
    for r in range(rounds):
        some = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(rounds)) == r) if rounds > 1 else items
        index = spark.sparkContext.broadcast(Index([(i, encoded([t])[0]) for i, t in some.collect()], threshold))

        def search(batches, index=index):
            for batch in slices(batches):
                ids = batch.column("doc_id").to_pylist()
                for at, texts in chunks(encoded(batch.column("text").to_pylist()), _CHUNK):
                    rows = [(ids[at + doc], *rest) for doc, *rest in index.value.verify(Words(texts, lower=True), threshold, whole)]
                    if rows:
                        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.int32())
                        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "item_id", "start_word", "n_words", "similarity", "distance"])

        found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(search, schema)
        out = found if out is None else out.unionByName(found)
    return out
