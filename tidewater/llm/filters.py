"""A Bloom filter of digests, of one size whatever their number: 8 MB that every worker can hold.

It is built in segments, by the first byte of a digest, so that no task and no row holds more than a segment. Beyond
some ten million digests it says yes more often, which costs work and never a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textbytes import mixed, raw

SEGMENTS, SEGMENT_BITS, PLACES = 256, 1 << 18, 3


def _places(digests: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The segment of each digest, and its places there."""
    data, at = raw(digests)
    n = len(digests)
    width = len(data) // n if n else 0
    head = np.zeros((n, 16), np.uint8)
    if width:
        head[:, : min(width, 16)] = data.reshape(n, width)[:, :16]
    a, b = head.view(np.uint64).T
    x = mixed(a ^ mixed(b))
    return head[:, 0].astype(np.int64), np.stack([((x >> np.uint64(18 * i)) % np.uint64(SEGMENT_BITS)).astype(np.int64) for i in range(PLACES)])


def build(df: DataFrame, column: str) -> np.ndarray:
    """The filter of the values of a column of digests of one width: (SEGMENTS, SEGMENT_BITS / 8) bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            segment, places = _places(batch.column("digest"))
            for s in np.unique(segment).tolist():
                bits = held.setdefault(s, np.zeros(SEGMENT_BITS, bool))
                bits[places[:, segment == s].ravel()] = True
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([np.packbits(b, bitorder="little").tobytes() for b in held.values()], pa.binary())], names=["segment", "bits"])

    digests = df.select(F.col(column).alias("digest"))
    dealt = digests.repartition(F.substring("digest", 1, 1)).mapInArrow(run, "segment int, bits binary")
    out = np.zeros((SEGMENTS, SEGMENT_BITS // 8), np.uint8)
    for segment, bits in dealt.collect():  # at most one row a segment
        out[segment] |= np.frombuffer(bits, np.uint8)
    return out


def might_hold(bits: np.ndarray, digests: pa.Array) -> np.ndarray:
    """Which digests may be in the filter; the others aren't."""
    segment, places = _places(digests)
    out = np.ones(len(digests), bool)
    for at in places:
        out &= bits[segment, at >> 3] >> (at & 7).astype(np.uint8) & np.uint8(1) == 1
    return out
