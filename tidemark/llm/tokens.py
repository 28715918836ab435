"""Token ids of whole texts by the tokenizers library, each distinct piece encoded once per batch.

A byte-level or word-level pre-tokenizer never joins what stands before a space or line feed to what stands behind it, if
the character before it is not white space and the one behind the space is not white space either. Texts are split there;
a piece keeps its leading space, so that its ids are those it has within the text. Arrow splits the texts and finds the
distinct pieces of a batch. The ids of each distinct piece are kept by the worker (a bounded memory), and texts are put
together from them in numpy.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: a space or line feed between two characters that are not white space: the only places where texts are split
_SAFE = re.compile(r"(?<=[^\s\x1c-\x1f\x85])(?=[ \n][^\s\x1c-\x1f\x85])")
#: two characters next to each other that are white space to Python
_ADJACENT = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]{2}"
#: words of these letters alone are one piece for any pre-tokenizer that keeps runs of letters together
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
_PLAIN = re.compile(_LETTERS)
#: signs that are a piece of their own behind a word, if white space follows
_SIGNS = ".,"
MEMORY = 400_000  #: pieces that a worker remembers


class _Places(dict):
    """Numbers pieces as they first appear."""

    def __init__(self):
        self.fresh: list[str] = []

    def __missing__(self, piece: str) -> int:
        self.fresh.append(piece)
        self[piece] = k = len(self)
        return k


#: the letters by which byte-level vocabularies write bytes, for those beyond ASCII that UTF-8 uses
_SHOWN = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
_LETTER = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN) if b > 127}


class PieceEncoder:
    """ids(texts): (ids as uint32 in text order, number of ids of each text)."""

    _known: dict[str, PieceEncoder] = {}

    def __init__(self, path: str, memory: int = MEMORY):
        self.memory = memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.models import BPE
        from tokenizers.pre_tokenizers import WhitespaceSplit

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        whole = json.loads(self.tokenizer.to_str())
        suffix = whole["model"].get("end_of_word_suffix")
        self.space = suffix is None
        self.lower = whole["normalizer"] is not None
        #: the model alone, for words of plain letters written as it has them; nothing is gained by a cache of new words
        model = {k: v for k, v in whole["model"].items() if k not in ("type", "vocab", "merges") and v is not None}
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in whole["model"]["merges"]]
        self.model = Tokenizer(BPE(whole["model"]["vocab"], merges, cache_capacity=0, **model))
        self.model.pre_tokenizer = WhitespaceSplit()
        #: for each id, whether a word of plain letters begins with it (byte-level) or ends with it (word-level)
        vocab = self.tokenizer.get_vocab()
        self.border = np.zeros(max(vocab.values(), default=0) + 1, dtype=bool)
        self.border[[i for t, i in vocab.items() if (t.startswith("\u0120") if self.space else t.endswith(suffix))]] = True
        signs = {c: self.tokenizer.encode(c, add_special_tokens=False).ids for c in _SIGNS}
        self.signs = {c: ids[0] for c, ids in signs.items() if len(ids) == 1}
        self._forget()

    @classmethod
    def of(cls, path: str, memory: int = MEMORY) -> PieceEncoder:
        """One for each worker and vocabulary file."""
        if path not in cls._known:
            cls._known[path] = cls(path, memory)
        return cls._known[path]

    @classmethod
    def drop(cls) -> None:
        """Leaves the worker's tokenizers and pieces to be collected; those in use stay until their task ends."""
        cls._known.clear()

    def _forget(self) -> None:
        self.places = _Places()
        self.flat = np.zeros(1 << 16, dtype=np.uint32)
        self.start = np.zeros(1 << 16, dtype=np.int64)
        self.length = np.zeros(1 << 16, dtype=np.int64)
        self.used = 0

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, number of ids of each) of words of plain letters, encoded as texts of 500 words by the tokenizer's model."""
        if not words:
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        if self.lower:
            words = [w.lower() for w in words]
        words = [w if w.isascii() else w.encode().decode("latin-1").translate(_LETTER) for w in words]
        texts = [" ".join(words[a : a + 500]) for a in range(0, len(words), 500)]
        if self.space:
            texts = ["\u0120" + t.replace(" ", " \u0120") for t in texts]
        ids = np.concatenate([np.array(e.ids, dtype=np.uint32) for e in self.model.encode_batch_fast(texts, add_special_tokens=False)])
        at = np.flatnonzero(self.border[ids])
        n = np.diff(at, append=len(ids)) if self.space else np.diff(at, prepend=-1)
        if len(n) != len(words) or int(n.sum()) != len(ids):
            raise ValueError("words of plain letters are not pieces of their own in this vocabulary")
        return ids, n

    def _learn(self, fresh: list[str]) -> None:
        if not fresh:
            return
        is_plain = np.fromiter((_PLAIN.fullmatch(p) is not None for p in fresh), dtype=bool, count=len(fresh))
        other = [p for p, k in zip(fresh, is_plain) if not k]
        ids, n = self._words([p for p, k in zip(fresh, is_plain) if k])
        found = []
        for at in range(0, len(other), 5000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast([_text(p) for p in other[at : at + 5000]], add_special_tokens=False)]
        new = np.concatenate([ids, np.fromiter(chain.from_iterable(found), dtype=np.uint32)])
        n = np.concatenate([n, np.fromiter(map(len, found), dtype=np.int64, count=len(found))])
        place = len(self.places) - len(fresh) + np.concatenate([np.flatnonzero(is_plain), np.flatnonzero(~is_plain)])
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.places) > len(self.start):
            self.start, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.length))
        self.flat[self.used : self.used + len(new)] = new
        self.length[place] = n
        self.start[place] = self.used + np.cumsum(n) - n
        self.used += len(new)

    def _signed(self, pieces: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """(the pieces without a sign that stands behind a word of plain letters, that sign's id or -1)"""
        if not self.space:
            pieces = pc.utf8_ltrim(pieces, "\n")
        signs = np.full(len(pieces), -1, dtype=np.int64)
        if self.signs:
            ends = pc.match_substring_regex(pieces, f"^{_LETTERS}[{''.join(self.signs)}]$")
            for sign, i in self.signs.items():
                signs[pc.and_(ends, pc.ends_with(pieces, sign)).to_numpy(zero_copy_only=False)] = i
            pieces = pc.if_else(ends, pc.utf8_slice_codeunits(pieces, 0, -1), pieces)
        return pieces, signs

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.places) > self.memory:
            self._forget()
        if not len(texts):
            return np.zeros(0, dtype=np.uint32), np.zeros(0, dtype=np.int64)
        split = _split(texts, self.lower)
        bound = split.offsets.to_numpy()
        pieces = split.flatten().dictionary_encode()
        bases, sign = self._signed(pieces.dictionary)
        bases = bases.dictionary_encode()
        of = np.fromiter(map(self.places.__getitem__, bases.dictionary.to_numpy(zero_copy_only=False)), dtype=np.int64, count=len(bases.dictionary))
        fresh, self.places.fresh = self.places.fresh, []
        self._learn(fresh)
        of = of[bases.indices.to_numpy()]
        # the ids of the batch's distinct pieces, then those of its texts
        ids, n = _gather(self.flat, self.start[of], self.length[of] + (sign >= 0))
        end = np.cumsum(n)
        ids[end[sign >= 0] - 1] = sign[sign >= 0]
        which = pieces.indices.to_numpy()
        ids, n = _gather(ids, (end - n)[which], n[which])
        return ids, np.diff(np.concatenate([[0], np.cumsum(n)])[bound - bound[0]])


def _gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(all runs of n elements of flat from start, one after the other; n). What a run reads beyond flat's end is any element."""
    end = np.cumsum(n)
    total = int(end[-1]) if len(end) else 0
    return flat.take(np.arange(total) + np.repeat(start - (end - n), n), mode="clip"), n


def _split(texts: list[str], lower: bool) -> pa.LargeListArray:
    """Pieces of each text whose ids, in order, are the text's, as _text() reads them: a piece's leading space is left away,
    the first piece is marked by two line feeds (no other can start with two). lower: capitals don't matter; those of texts
    in ASCII become small letters, so that fewer pieces differ."""
    all_ = pa.array(texts, pa.large_string())  # not a slice: ascii_lower() goes wrong on one
    if lower:
        all_ = pc.if_else(pc.string_is_ascii(all_), pc.ascii_lower(all_), all_)
    odd = pc.match_substring_regex(all_, _ADJACENT)
    plain = pc.replace_substring(all_, "\n", " \n")
    plain = pc.if_else(pc.starts_with(plain, " \n"), pc.utf8_slice_codeunits(plain, 1), plain)
    plain = pc.binary_join_element_wise(pa.scalar("\n\n", pa.large_string()), plain, pa.scalar("", pa.large_string()))
    if not pc.any(odd).as_py():
        return _listed(pc.split_pattern(plain, " "))
    rows = pc.split_pattern(plain.filter(pc.invert(odd)), " ")
    slow = pa.array([_split_odd(t) for t in all_.filter(odd).to_pylist()], pa.large_list(pa.large_string()))
    odd = odd.to_numpy(zero_copy_only=False)
    place = np.where(odd, len(rows) + np.cumsum(odd) - 1, np.cumsum(~odd) - 1)
    return pa.concat_arrays([_listed(rows), slow]).take(pa.array(place))


def _listed(rows: pa.Array) -> pa.LargeListArray:
    return rows.cast(pa.large_list(pa.large_string()))


def _split_odd(text: str) -> list[str]:
    """The pieces of a text with white space next to white space."""
    split = _SAFE.split(text)
    split[1:] = [p[1:] if p[0] == " " else p for p in split[1:]]
    split[0] = "\n\n" + split[0]
    return split


def _text(piece: str) -> str:
    return piece[2:] if piece.startswith("\n\n") else piece if piece.startswith("\n") else " " + piece
