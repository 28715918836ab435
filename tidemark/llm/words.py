"""Words of many texts at once, as 64-bit hashes in numpy.

A word is a maximal run of bytes other than ``\\x20`` and ``\\x09-\\x0D``. Hashes depend on the bytes alone,
so they agree between tasks, runs and machines.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
OTHER = np.arange(256) < 0x80  #: what stands between terms: ASCII that is neither letter nor digit
OTHER[[*range(ord("0"), ord("9") + 1), *range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
CHUNK = 1 << 22  #: bytes of text that are worked on at once; a longer text is a chunk of its own


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64: every input bit moves every output bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


BYTE = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15))


class Powers:
    """Powers of an odd number modulo 2**64 and of its inverse, grown on demand."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up), 1 << 16)
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, dtype=U64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up[:n], self.down[:n]


_OF_BYTES, _OF_WORDS = Powers(0x5851F42D4C957F2D), Powers(0xD1342543DE82EF95)


class Words:
    """The words of some texts: ``hash`` of each, ``doc`` (place of its text), ``first`` (each text's first word; one
    entry more than texts), and ``start``/``end`` in ``raw``."""

    def __init__(self, texts: list[bytes], lower: bool, apart: np.ndarray = SPACE):
        """apart: which bytes stand between words; the line feed must be one."""
        self.raw = b"\n".join(texts) + b"\n"
        buf = np.frombuffer(self.raw, dtype=np.uint8)
        space = apart[buf]
        edge = np.flatnonzero(np.diff(space, prepend=True))
        self.start, self.end = edge[0::2], edge[1::2]
        up, down = _OF_BYTES.upto(len(buf) + 1)
        total = np.zeros(len(buf) + 1, dtype=U64)
        np.cumsum(BYTE[LOWER[buf] if lower else buf] * up[1:], out=total[1:])
        self.hash = mix((total[self.end] - total[self.start]) * down[self.start])
        offset = np.zeros(len(texts) + 1, dtype=np.int64)
        np.cumsum([len(t) + 1 for t in texts], out=offset[1:])
        self.first = np.searchsorted(self.start, offset)
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))

    def windows(self, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all runs of n words, and whether each lies within one text."""
        w = self.hash
        if len(w) < n:
            return np.zeros(0, dtype=U64), np.zeros(0, dtype=bool)
        up, down = _OF_WORDS.upto(len(w) + 1)
        total = np.zeros(len(w) + 1, dtype=U64)
        np.cumsum((mix(w ^ U64(salt)) if salt else w) * up[1:], out=total[1:])
        m = len(w) - n + 1
        return mix((total[n:] - total[:m]) * down[:m] + U64(n)), self.doc[n - 1 :] == self.doc[:m]

    def spans(self, a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
        """Hashes of the runs of words a[i]:b[i]."""
        up, down = _OF_WORDS.upto(len(self.hash) + 1)
        total = np.zeros(len(self.hash) + 1, dtype=U64)
        np.cumsum((mix(self.hash ^ U64(salt)) if salt else self.hash) * up[1:], out=total[1:])
        return mix((total[b] - total[a]) * down[a] + (b - a).astype(U64))


def shingle_sets(texts: list[bytes], n: int = 5) -> Iterator[np.ndarray]:
    """Each text's distinct n-word shingles, lower-cased, as sorted hashes: the whole sequence as one where there are
    fewer words, none where there is no word."""
    words = Words(texts, lower=True)
    grams, whole = words.windows(n)
    for i in range(len(texts)):
        a, b = words.first[i], words.first[i + 1]
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            yield words.spans(np.array([a]), np.array([b]))
        else:
            yield np.zeros(0, dtype=U64)


def encoded(texts) -> list[bytes]:
    """UTF-8 of the texts; null counts as empty."""
    return [t.encode("utf-8", "surrogatepass") if isinstance(t, str) else b"" for t in texts]


def chunks(texts: list[bytes], limit: int = CHUNK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts of up to ``limit`` bytes, each with the place of its first."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > limit:
            yield at, texts[at:i]
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, texts[at:]
