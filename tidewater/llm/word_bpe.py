"""Ids of a word-level BPE by way of hash tables of pre-tokens, exactly as the tokenizers library gives them.

The tokenizer drops white space between pre-tokens and never merges across two of them, so the ids of a text are those
of its pre-tokens, one after the other, and each need only be encoded once. Batches are cut into units by numpy: the
pre-tokens of words that have ASCII and the letters U+00C0 to U+00FF alone, by the tokenizer's pattern, and other words
whole, which are one or more pre-tokens. Units are looked up by 64-bit hash. Whether a tokenizer is of this kind is tried on a probe; if it isn't,
and for texts with special strings in them, the library encodes whole texts.
"""

from __future__ import annotations

import functools
import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .base import word_tokenizer
from .textbytes import ODD, hashes, mixed, raw, word_spans

#: Kinds of bytes: blanks, letters, digits, other ASCII, and what isn't ASCII.
BLANK, LETTER, DIGIT, OTHER, WIDE = range(5)
_KIND = np.full(256, OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = BLANK
_KIND[[*range(65, 91), *range(97, 123)]] = LETTER
_KIND[48:58] = DIGIT
_KIND[128:] = WIDE
PROBE = "The cat's 12 DOGS,they'll  re-run\n\tx='y' don'T!'s 'tis A1b2 ''s <tag/> naïve, ÉCOLE. a×b÷ Straße's 漢字 'REx we'd've ...5"


def _accented(data: np.ndarray) -> np.ndarray:
    """Places of the letters U+00C0 to U+00FF, which are two bytes; the signs of multiplication and division aren't letters."""
    lead = np.flatnonzero(data == 0xC3)
    return lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]


def folded(data: np.ndarray) -> np.ndarray:
    """data with the capitals among these letters made small; those of ASCII have the hashes of small ones anyway."""
    second = _accented(data) + 1
    capital = second[data[second] <= 0x9E]
    if not len(capital):
        return data
    out = data.copy()
    out[capital] += 0x20
    return out


def units(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where units begin and end, and the number of units before each text, and of all.

    The pattern: 's 't 'm 'd 're 've 'll, runs of letters, single digits, runs of anything else.
    """
    starts, ends, _ = word_spans(data, at)
    kind = _KIND.take(data.astype(np.intp))
    accented = _accented(data)
    kind[accented] = kind[accented + 1] = LETTER
    if (wide := np.flatnonzero(kind == WIDE)).size:
        words = np.zeros(len(starts), bool)
        words[np.searchsorted(starts, wide, "right") - 1] = True
        step = np.zeros(len(data) + 1, np.int8)
        step[starts[words]] += 1
        step[ends[words]] -= 1
        kind[np.cumsum(step[:-1], dtype=np.int8) > 0] = WIDE
    first = np.ones(len(data) + 1, bool)
    first[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    first[starts] = True
    first[:-1] &= kind != BLANK
    # An apostrophe that begins a run, before one of the endings.
    quote = np.flatnonzero((data == 39) & first[:-1] & (kind == OTHER))
    if quote.size:
        word_end = ends[np.searchsorted(starts, quote, "right") - 1]
        low = np.append(data, [0, 0]) | 32
        one, two = low[quote + 1], low[quote + 2]
        letter = np.append(kind, [0, 0])[quote + 1] == LETTER
        fits = (quote + 2 <= word_end) & letter
        short = fits & np.isin(one, np.frombuffer(b"stmd", np.uint8))
        long = fits & ~short & (quote + 3 <= word_end) & (np.append(kind, [0, 0])[quote + 2] == LETTER) & ((((one == 114) | (one == 118)) & (two == 101)) | ((one == 108) & (two == 108)))
        for some, size in ((quote[short], 2), (quote[long], 3)):
            first[some + 1] = False
            rest = some + size
            inside = rest < len(data)
            rest = rest[inside]
            # What follows begins anew, if it is in the same word.
            first[rest[rest < word_end[short if size == 2 else long][inside]]] = True
    begins = np.flatnonzero(first[:-1])
    until = ends[np.searchsorted(starts, begins, "right") - 1]
    if len(begins):
        until = np.minimum(until, np.append(begins[1:], len(data)))
    return begins, until, np.searchsorted(begins, at)


class HashTable:
    """64-bit keys, not 0, to 32-bit values: three tables of 2^bits, 2^(bits-1) and 2^(bits-2) slots; a key is in the first whose slot was free for it."""

    def __init__(self, bits: int):
        self.shifts = [64 - bits + i for i in range(3)]
        self.keys = [np.zeros(1 << (64 - s), np.uint64) for s in self.shifts]
        self.values = [np.zeros(1 << (64 - s), np.int32) for s in self.shifts]
        self.size, self.room = 0, (1 << bits) * 3 // 4

    def _slots(self, keys: np.ndarray, level: int) -> np.ndarray:
        return ((keys if not level else mixed(keys * ODD ^ np.uint64(level))) >> np.uint64(self.shifts[level])).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The value of each key, -1 for those that aren't there."""
        slot = self._slots(keys, 0)
        out = np.where(self.keys[0][slot] == keys, self.values[0][slot], np.int32(-1))
        for level in (1, 2):
            rest = np.flatnonzero(out < 0)
            if not len(rest):
                break
            some = keys[rest]
            slot = self._slots(some, level)
            out[rest] = np.where(self.keys[level][slot] == some, self.values[level][slot], np.int32(-1))
        return out

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Distinct keys that aren't there yet. The few that find no slot stay out."""
        for level in range(3):
            slot = self._slots(keys, level)
            free = np.flatnonzero(self.keys[level][slot] == 0)
            _, first = np.unique(slot[free], return_index=True)
            use = free[first]
            self.keys[level][slot[use]], self.values[level][slot[use]] = keys[use], values[use]
            self.size += len(use)
            keep = np.ones(len(keys), bool)
            keep[use] = False
            keys, values = keys[keep], values[keep]


class Vocabulary:
    """A tokenizer, whether its texts may be cut into units, whether capitals are small letters to it, and its special strings."""

    def __init__(self, path: str):
        self.tokenizer = word_tokenizer(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.lower = self.ids(["AbCÉÞ"]) == self.ids(["abcéþ"])
        self.suffix = (json.loads(self.tokenizer.to_str())["model"].get("end_of_word_suffix") or "") if path.endswith(".json") else ""
        data, at = raw(pa.array([PROBE]))
        begins, ends, _ = units(data, at)
        pieces = [data[a:b].tobytes().decode() for a, b in zip(begins.tolist(), ends.tolist())]
        self.cuts = [i for ids in self.ids(pieces) for i in ids] == self.ids([PROBE])[0]

    def ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, texts: list[str], at_once: int = 512) -> tuple[np.ndarray, np.ndarray]:
        """The ids of many short texts without special strings, one after the other, and their numbers: encoded as one text, parted by a special string."""
        if not self.special:
            found = self.ids(texts)
            return np.fromiter((i for ids in found for i in ids), np.uint32), np.array([len(ids) for ids in found], np.int64)
        part = self.special[0]
        found = self.ids([part.join(texts[i : i + at_once]) + part for i in range(0, len(texts), at_once)])
        ids = np.fromiter((i for some in found for i in some), np.uint32, sum(map(len, found)))
        ends = np.flatnonzero(ids == self.tokenizer.token_to_id(part))
        if len(ends) != len(texts):
            raise ValueError("the tokenizer doesn't part texts at its special strings")
        return np.delete(ids, ends), np.diff(ends, prepend=-1) - 1

    def hashes(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return hashes(folded(data) if self.lower else data, begins, ends, self.lower)

    def whole_words(self) -> list[str]:
        """The pre-tokens that are one entry of the vocabulary, in its order: they were frequent when it was made."""
        found = sorted(self.tokenizer.get_vocab(with_added_tokens=False).items(), key=lambda x: x[1])
        words = [w.removesuffix(self.suffix) for w, _ in found if w.endswith(self.suffix)]
        words = [w for w in words if w and w.isascii()]  # what isn't ASCII is written in another alphabet of bytes there
        data, at = raw(pa.array(words, pa.string()))
        _, _, first = units(data, at)
        return [w for w, n in zip(words, np.diff(first).tolist()) if n == 1 and not w[0].isspace() and not w[-1].isspace()]

    def set_apart(self, texts: pa.Array) -> np.ndarray:
        """Texts that only the library can encode."""
        out = np.full(len(texts), not self.cuts)
        data = raw(texts)[0].tobytes()
        for special in self.special:
            if special.encode() in data:
                out |= pc.match_substring(texts, special).to_numpy(zero_copy_only=False)
        return out


@functools.lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class UnitCache:
    """A worker's cache of the ids of units. Its size is bounded: when it is full it begins anew."""

    def __init__(self, path: str, bits: int = 20):
        self.of, self.bits = vocabulary(path), bits
        self.clear()

    def clear(self) -> None:
        self.table, self.flat, self.used = HashTable(self.bits), np.zeros(1 << 16, np.uint32), 0
        self.begin, self.length, self.known = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64), 0

    def _keep(self, ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """The places of more units, whose ids follow one another."""
        n, total = len(lengths), len(ids)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.known + n > len(self.begin):
            self.begin, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.begin, self.length))
        own = slice(self.known, self.known + n)
        self.length[own] = lengths
        self.begin[own] = self.used + np.cumsum(lengths) - lengths
        self.flat[self.used : self.used + total] = ids
        self.used, self.known = self.used + total, self.known + n
        return np.arange(own.start, own.stop)

    def places(self, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The place of each unit's ids; new ones are encoded, each once."""
        if self.table.size > self.table.room or self.used > 8 << self.bits:
            self.clear()
        out = self.table.find(keys).astype(np.int64)
        missing = np.flatnonzero(out < 0)
        if len(missing):
            some, first, back = np.unique(keys[missing], return_index=True, return_inverse=True)
            at = missing[first]
            texts = [data[a:b].tobytes().decode("utf-8", "surrogatepass") for a, b in zip(begins[at].tolist(), ends[at].tolist())]
            new = self._keep(*self.of.joined(texts))
            self.table.add(some, new.astype(np.int32))
            out[missing] = new[back]
        return out

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, each text ended by end_id if there is one, and where each begins, and the end."""
        apart = self.of.set_apart(texts)
        data, at = raw(texts)
        if apart.any():
            mine = [self.encode(texts.filter(pa.array(~apart)), end_id), np.flatnonzero(~apart)]
            whole = [np.array(i + [end_id] * (end_id is not None), np.uint32) for i in self.of.ids(texts.filter(pa.array(apart)).to_pylist())]
            parts: list = [None] * len(texts)
            for i, x in zip(np.flatnonzero(apart).tolist(), whole):
                parts[i] = x
            (flat, bounds), places = mine
            for k, i in enumerate(places.tolist()):
                parts[i] = flat[bounds[k] : bounds[k + 1]]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        begins, ends, first = units(data, at)
        place = self.places(data, begins, ends, self.of.hashes(data, begins, ends))
        lengths = self.length[place]
        total = np.concatenate([[0], np.cumsum(lengths)])
        take = np.repeat(self.begin[place] - total[:-1], lengths) + np.arange(total[-1])
        ids, bounds = self.flat[take], total[first]
        if end_id is None:
            return ids, bounds
        out = np.full(len(ids) + len(texts), end_id, np.uint32)
        out[np.arange(len(ids)) + np.repeat(np.arange(len(texts)), np.diff(bounds))] = ids
        return out, bounds + np.arange(len(texts) + 1)


#: Caches of this worker, by name: they outlive a task.
_held: dict[tuple, UnitCache] = {}


def held(kind: type, *args):
    """The worker's cache of a kind for these arguments."""
    if (kind, *args) not in _held:
        _held[kind, *args] = kind(*args)
    return _held[kind, *args]
