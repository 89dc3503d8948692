"""Words of many texts at once, by numpy over the bytes of an Arrow column: no Python object is made for a word.

A word is a run of bytes without the six ASCII blanks. Its 64-bit hash is a polynomial over a random value of each byte,
read off running sums; ASCII capitals may share the values of small letters. Words of more than LONG bytes are hashed one by one.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
import xxhash

#: Bytes that are hashed at once, and the longest word that is hashed with others.
CHUNK, LONG = 1 << 16, 1 << 12
ODD = np.uint64(0x9E3779B97F4A7C15)
_STEP = 0x2545F4914F6CDD1D


def blank(data: np.ndarray) -> np.ndarray:
    """Which bytes are blanks: a space, or 9 to 13."""
    return (data == 32) | (data - np.uint8(9) < 5)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the step and of its inverse modulo 2^64, for places in a chunk."""
    out = []
    for base in (_STEP, pow(_STEP, -1, 1 << 64)):
        steps = np.full(CHUNK + LONG + 1, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps))
    return tuple(out)


@functools.lru_cache(maxsize=2)
def _values(lower: bool) -> np.ndarray:
    """A random value of each byte."""
    return np.array([xxhash.xxh3_64_intdigest(bytes([b]).lower() if lower else bytes([b])) for b in range(256)], np.uint64)


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, without a copy, and where each text begins, and the end."""
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, places, data = texts.buffers()
    if places is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    at = np.frombuffer(places, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
    return data, at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where words begin and end, and the number of words before each text, and of all."""
    word = ~blank(data)
    begins = np.empty(len(data) + 1, bool)
    begins[:-1] = word
    begins[-1] = False
    ends = begins.copy()
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    begins[1:-1] &= ~word[:-1] | edge[1:-1]
    ends[:-2] &= ~word[1:] | edge[1:-1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, at)


def hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """The hash of each data[start:end], which follow one another; never 0."""
    power, inverse = _powers()
    value = _values(lower)
    n = len(starts)
    out = np.empty(n, np.uint64)
    size = ends - starts
    stops = np.minimum(ends, starts + LONG)
    total = np.zeros(CHUNK + LONG + 1, np.uint64)
    i = 0
    while i < n:
        low = int(starts[i])
        j = int(np.searchsorted(starts, low + CHUNK))
        high = int(stops[j - 1])
        term = value.take(data[low:high].astype(np.intp))
        term *= power[: high - low]
        np.cumsum(term, out=total[1 : high - low + 1])
        s = starts[i:j] - low
        out[i:j] = (total[stops[i:j] - low] - total[s]) * inverse[s]
        i = j
    out ^= size.astype(np.uint64) * ODD
    out = mixed(out)
    for k in np.flatnonzero(size > LONG).tolist():
        piece = data[starts[k] : ends[k]].tobytes()
        out[k] = xxhash.xxh3_64_intdigest(piece.lower() if lower else piece)
    out[out == 0] = 1
    return out


def words(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words, and the number of words before each text, and of all."""
    data, at = raw(texts)
    starts, ends, first = word_spans(data, at)
    return hashes(data, starts, ends, lower), first
