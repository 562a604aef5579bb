"""Subword ids of many texts at once, without a Python object per word: the same ids as `tokens.Encoder`.

Chunks between [\\x20\\x09-\\x0D] are found in the text buffer and each distinct one of a batch is encoded once. Plain chunks (ASCII and
Latin-1 letters, no apostrophe, at most LONGEST bytes) are cut into pre-tokens by classes of bytes, and the merges of all distinct pre-tokens are made side by
side: in each step every pre-token makes its lowest merge, until none has one left. Other chunks, and texts that may spell a special
token, go through the encoder one by one. Pre-tokens are kept for later
batches, bounded in number. Chunks and pre-tokens are compared by 64-bit hashes.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa

from lexloom.llm import textscan as ts
from lexloom.llm.tokens import LONGEST, Encoder, split

_NONE = np.int32(2**31 - 1)
_PARTS = 1 << 14  # pre-tokens whose merges are made side by side: their arrays stay in a core's cache
#: So many pre-tokens, and so many ids of theirs, a worker keeps; beyond it begins again.
KEPT, KEPT_IDS = 1 << 20, 4 << 20
_MIXERS = (2654435769, 2246822519, 3266489917, 668265263)  # Fixed values: odd multipliers of the tables of merges
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
_LETTER, _DIGIT, _OTHER = 1, 2, 3
_CLASS = np.zeros(256, np.uint8)
_CLASS[33:127] = _OTHER
_CLASS[48:58] = _DIGIT
_CLASS[97:123] = _CLASS[65:91] = _CLASS[0x80:0xC0] = _CLASS[0xC3] = _LETTER
_CLASS[39] = 0  # contractions


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each distinct value stands (once), and the number of each value's distinct one."""
    order = np.argsort(h)
    ordered = h.take(order)
    new = np.ones(len(h), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    nth = np.empty(len(h), np.int64)
    nth[order] = np.cumsum(new) - 1
    return order[new], nth


def spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of all spans, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


class Merges:
    """The merges of a byte-level BPE model whose tokens are each made by one merge, after those of their parts."""

    def __init__(self, model: dict):
        vocab, merges = model["vocab"], [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        suffix = model["end_of_word_suffix"] or ""
        made = {token: rank for rank, token in enumerate(a + b.removesuffix(suffix) + suffix if b.endswith(suffix) and suffix else a + b for a, b in merges)}
        self.sound = len(made) == len(merges) and not any(model[k] for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges"))
        self.sound &= max(vocab.values()) < 2**16 and all(made.get(part, -1) < rank for rank, pair in enumerate(merges) for part in pair)
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = iter(range(256, 512))
        alphabet = [chr(b if b in shown else next(others)) for b in range(256)]
        self.inner = np.array([vocab[c] for c in alphabet], np.int32)
        self.last = np.array([vocab[c + suffix] for c in alphabet], np.int32)
        self.token = np.array([vocab[token] for token in made], np.int32)
        keys = np.array([vocab[a] << 16 | vocab[b] for a, b in merges], np.uint32)
        ranks = np.arange(len(keys), dtype=np.int32)
        self.tables = []
        for mixer in _MIXERS:
            at = (keys * np.uint32(mixer)) >> np.uint32(14)
            held, rank = np.full(1 << 18, 2**32 - 1, np.uint32), np.full(1 << 18, _NONE)
            held[at], rank[at] = keys, ranks
            self.tables.append((np.uint32(mixer), held, rank))
            left = held[at] != keys
            keys, ranks = keys[left], ranks[left]
        self.sound &= not len(keys)
        self.forget()

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of the merge of each pair; _NONE where there is none."""
        key = (a.astype(np.uint32) << np.uint32(16)) | b.astype(np.uint32)
        out = np.full(len(key), _NONE)
        for mixer, held, rank in self.tables:
            at = (key * mixer) >> np.uint32(14)
            np.copyto(out, rank.take(at), where=held.take(at) == key)
        return out

    def forget(self) -> None:
        self.keys, self.at, self.held = np.zeros(0, np.uint64), np.zeros((2, 0), np.int64), np.zeros(0, np.int32)

    def remembered(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of distinct pre-tokens with ascending hashes h, where each one's begin, and their number; new ones are encoded and kept."""
        spot = np.searchsorted(self.keys, h)
        old = self.keys.take(spot, mode="clip") == h if len(self.keys) else np.zeros(len(h), bool)
        new = np.flatnonzero(~old)
        begin, count = np.empty(len(h), np.int64), np.empty(len(h), np.int64)
        begin[old], count[old] = self.at[:, spot[old]]
        ids, count[new] = self.encode(data, starts[new], sizes[new])
        begin[new] = len(self.held) + np.cumsum(count[new]) - count[new]
        ids = np.concatenate([self.held, ids])
        if len(self.keys) + len(new) > KEPT or len(ids) > KEPT_IDS:
            self.forget()
        else:
            self.keys, self.at, self.held = np.insert(self.keys, spot[new], h[new]), np.insert(self.at, spot[new], (begin[new], count[new]), axis=1), ids
        return ids, begin, count

    def encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of data[start : start + size] for each, one after another, and their numbers. No size is 0."""
        found = [self._encode(data, starts[i : i + _PARTS], sizes[i : i + _PARTS]) for i in range(0, len(starts), _PARTS)]
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _encode(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        raw = data.take(spans(starts, sizes))
        first = np.cumsum(sizes) - sizes
        sym = self.inner.take(raw)
        sym[first + sizes - 1] = self.last.take(raw[first + sizes - 1])
        word = np.arange(len(starts))
        rank = np.full(len(sym), _NONE)
        rank[:-1] = self.ranks(sym[:-1], sym[1:])
        rank[first + sizes - 1] = _NONE
        done: list[tuple] = []
        while len(word):
            least = np.minimum.reduceat(rank, first)
            keep = np.ones(len(sym), bool)
            over = least == _NONE
            if over.any():
                done.append((word[over], sizes[over], sym.take(spans(first[over], sizes[over]))))
                np.logical_not(np.repeat(over, sizes), out=keep)
                least[over] = 0
            hits = np.flatnonzero((rank == np.repeat(least, sizes)) & keep)
            if len(hits) > 1:  # of a run of equal symbols, pairs are made from the left
                place = np.arange(len(hits))
                new = np.append(True, hits[1:] != hits[:-1] + 1)
                hits = hits[(place - np.maximum.accumulate(np.where(new, place, 0))) & 1 == 0]
            sym[hits] = self.token.take(rank[hits])
            keep[hits + 1] = False
            rank[hits] = rank[hits + 1]  # no merge beyond the last symbol; any other is looked up below
            ended = rank[hits] == _NONE
            merged = np.zeros(len(sym), bool)
            merged[hits] = True
            sizes = sizes - np.bincount(np.searchsorted(first, hits, "right") - 1, minlength=len(sizes))
            sizes, word = sizes[~over], word[~over]
            sym, rank, merged = sym[keep], rank[keep], merged[keep]
            first = np.cumsum(sizes) - sizes
            at = np.flatnonzero(merged)
            ends = np.zeros(len(sym) + 1, bool)
            ends[first + sizes] = True  # the place after each word
            right = at[~ends[at + 1]]
            left = at[~(ends[at] | (at == 0))] - 1
            rank[at] = _NONE
            both = np.concatenate([left, right])
            rank[both] = self.ranks(sym.take(both), sym.take(both + 1))
        order = np.concatenate([d[0] for d in done])
        counts = np.concatenate([d[1] for d in done])
        ids = np.concatenate([d[2] for d in done])
        begins, by = np.cumsum(counts) - counts, np.argsort(order)
        return ids.take(spans(begins[by], counts[by])), counts[by]


_merges: dict[str, Merges] = {}


def merges(path: str) -> Merges:
    if path not in _merges:
        with open(path, encoding="utf-8") as f:
            _merges[path] = Merges(json.load(f)["model"])
    return _merges[path]


def _chunk_ids(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, enc: Encoder, known: Merges) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ids of chunks of case-folded data: all of them, where each chunk's begin, and their number."""
    begins = np.cumsum(sizes) - sizes
    raw = data.take(spans(starts, sizes))
    before = np.append(np.uint8(0), raw[:-1])
    kind = _CLASS.take(raw)
    latin = before == 0xC3
    upper = latin & (raw >= 0x80) & (raw <= 0x9E) & (raw != 0x97)
    bad = (kind == 0) | ((raw >= 0x80) & (raw < 0xC0) & ~latin) | (latin & ((raw == 0x97) | (raw == 0xB7))) | ((raw == 124) & (before == 60))
    plain = (np.add.reduceat(bad, begins, dtype=np.int64) == 0) & (sizes <= LONGEST) & known.sound
    raw[upper] += 32
    inside = np.repeat(plain, sizes)
    opens = (kind == _DIGIT) | (kind != np.append(np.uint8(0), kind[:-1]))
    opens[begins] = True
    at = np.flatnonzero(opens & inside)
    closes = np.flatnonzero((np.append(opens[1:], True)) & inside) + 1
    h = ts.hashes(raw, at, closes)
    one, nth = distinct(h)
    ids, first, counts = known.remembered(h[one], raw, at[one], (closes - at)[one])
    ids, counts = ids.take(spans(first[nth], counts[nth])), counts[nth]
    n_ids = np.bincount(np.searchsorted(begins, at, "right") - 1, counts, len(sizes)).astype(np.int64)
    where = np.cumsum(n_ids) - n_ids
    rest = np.flatnonzero(~plain)
    if len(rest):
        others = [np.frombuffer(enc[data[starts[i] : starts[i] + sizes[i]].tobytes()], "<u4") for i in rest]
        n_ids[rest] = [len(x) for x in others]
        where[rest] = len(ids) + np.cumsum(n_ids[rest]) - n_ids[rest]
        ids = np.concatenate([ids, *others]).astype(np.int32)
    return ids, where, n_ids


def encode(texts: pa.Array, enc: Encoder, known: Merges) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The ids of each text, special strings inside texts as the library reads them, and the hashes of its words, A-Z lower-cased; a null text has none."""
    data, offsets = ts.buffers(texts)
    starts, ends, of = ts.words(data, offsets)
    if not len(texts):
        return [], []
    found, h = np.zeros(0, np.int32), np.zeros(0, np.uint64)
    per_row = np.zeros(len(texts), np.int64)
    if len(starts):
        folded = FOLD.take(data)
        h = ts.hashes(folded, starts, ends)
        one, nth = distinct(h)
        ids, where, n_ids = _chunk_ids(folded, starts[one], (ends - starts)[one], enc, known)
        sizes = n_ids.take(nth)
        found = ids.take(spans(where.take(nth), sizes))
        per_row = np.bincount(of, sizes, len(texts)).astype(np.int64)
    out = np.split(found, np.cumsum(per_row)[:-1])
    marks = np.flatnonzero((data[:-1] == 60) & (data[1:] == 124))
    for row in np.unique(np.searchsorted(offsets, marks, "right") - 1):
        text = data[offsets[row] : offsets[row + 1]].tobytes()
        if b"<|" in text:
            out[row] = np.frombuffer(b"".join(map(enc.__getitem__, split(text))), "<u4")
    return out, np.split(h, np.searchsorted(of, np.arange(1, len(texts))))
