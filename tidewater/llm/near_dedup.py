"""Near-duplicate classes by improved consistent weighted sampling over TF-IDF shingles.

A text's shingles are its runs of five words, lower-cased; a shorter text is one shingle. Texts alike in their words are
one node. A shingle's weight is its term frequency times its inverse document frequency, both bounded:

    tf(n) = 1.25 - 0.25 / n                                     how often it occurs in the text, saturating as in BM25
    idf(d) = 0.5 + 0.5 min(1, ln(N / d) / ln 100)               d of N documents have it

A shingle that at most one document in a hundred has weighs 1, one that all have weighs half as much. So document
frequencies are needed only for common shingles, of which there can be no more than a hundred times the mean number of
shingles of a document, at any number of documents: a table that every worker can hold. It is exact. A count-min sketch
over all documents, whose noise is a fixed share of N, shows which shingles may be common; those are then counted.

Each node has SAMPLES consistent weighted samples; BANDS bands of ROWS samples are its buckets. In a bucket, all are
compared with the most central member, the one with most others in its buckets. Every pair of members that this leaves
in different classes is compared too, block by block, by products of matrices. To compare is to compute the weighted
Jaccard similarity of both vectors, and a pair is linked if it is 0.8 or more. Classes are the connected components of
the links, by label propagation with pointer jumping.

Each text is read and cut into shingles once. A task keeps a memtable of its nodes, so copies of one text give one
vector a task; everything else starts from these vectors.

Defined results: null and empty texts are one class, as equal texts are. A class's id is the smallest doc_id in it, null
if none of its rows has one; kept marks one row of each class, with that id. Equal rows are one class. Other columns are
ignored. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from . import filters
from .base import Scratch, map_batches, plus, read_table, slices
from .textbytes import ODD, mixed, raw, words

SHINGLE, THRESHOLD = 5, 0.8
BANDS, ROWS = 19, 5
SAMPLES = BANDS * ROWS
#: Share of documents from which on a shingle is common, the weight of one that all have, and the most that tf adds.
COMMON, LEAST, REPEATED = 0.01, 0.5, 0.25
#: Width and depth of the sketch: 8 MB reach the driver, a bit of each cell all workers. CHUNK cells are a row.
WIDTH, DEPTH, CHUNK, SALTS = 1 << 19, 2, 1 << 13, 16
#: Bytes of vectors that a task holds before it sends them on.
HELD_BYTES = 16 << 20
#: Shingles that are sampled at once, which stay in the processor's cache.
PART = 1 << 15
#: Bytes of vectors of one node's pairs that are verified in one task; members and bytes of a block; columns held at once.
SHARE_BYTES, BLOCK, BLOCK_BYTES, COLUMNS = 4 << 20, 256, 8 << 20, 4096

MOST = np.uint64(0xFFFFFFFFFFFFFFFF)
_SEEDS = mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * ODD) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
    """Of each text: sorted distinct hashes of its shingles (48 bits, the low 16 are 0), how often each occurs, where its own begin, and its node."""
    data, _ = raw(texts)
    if (data >= 128).any():
        texts = pc.utf8_lower(texts)
    w, first = words(texts)
    n, k = len(texts), SHINGLE
    m = np.diff(first)
    out = np.zeros(len(w), np.uint64)
    use = np.zeros(len(w) + 1, bool)
    whole = len(w) - k + 1
    if whole > 0:
        for i in range(k):
            out[:whole] = (out[:whole] ^ w[i : whole + i]) * ODD
        steps = np.zeros(len(w) + 1, np.int64)
        long = m >= k
        np.add.at(steps, first[:-1][long], 1)
        np.add.at(steps, first[1:][long] - k + 1, -1)
        use = np.cumsum(steps) > 0
    for size in range(1, k):
        at = first[:-1][m == size]
        short = np.zeros(len(at), np.uint64)
        for i in range(size):
            short = (short ^ w[at + i]) * ODD
        out[at] = short
        use[at] = True
    h = mixed(out[use[:-1]]) & np.uint64(0xFFFFFFFFFFFF0000)
    bounds = np.concatenate([[0], np.cumsum(np.where(m >= k, m - k + 1, m > 0))])
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[bounds[:-1][m > 0]] = True
    at = np.flatnonzero(new)
    edges = first.tolist()
    nodes = [xxhash.xxh3_128_digest(w[a:b].tobytes()) for a, b in zip(edges, edges[1:])]
    return h[at], np.diff(np.append(at, len(h))), np.searchsorted(at, bounds), nodes


def _packed(h: np.ndarray) -> bytes:
    return (h >> np.uint64(16)).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _unpacked(h: pa.Array, tf: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and frequencies of all entries one after the other, and where each begins."""
    data, at = raw(h)
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, 2:] = data.reshape(-1, 6)
    bounds = at // 6
    often = np.ones(len(out), np.int64)
    counts, places = raw(tf)
    for i in np.flatnonzero(np.diff(places)).tolist():
        often[bounds[i] : bounds[i + 1]] = np.frombuffer(counts[places[i] : places[i + 1]].tobytes(), "<u4")
    return out.view(np.uint64).ravel(), often, bounds


def entries(docs: DataFrame) -> DataFrame:
    """Of (doc_id, row_id, text): a record (doc_id, row_id, node) of each row, and of each node in a memtable one with its least doc_id, its rows and its shingles."""
    fields = [*docs.select("doc_id", "row_id").schema.names, "node", "rows", "h", "tf"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size, kinds = 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            items = list(held.items())
            held.clear()
            at = 0
            while at < len(items):
                stop, total = at, 0
                while stop < len(items) and (stop == at or total < 2 << 20):
                    total += len(items[stop][1][2])
                    stop += 1
                some = items[at:stop]
                at = stop
                yield pa.RecordBatch.from_arrays(
                    [pa.array([e[1] for _, e in some], kinds[0]), pa.nulls(len(some), kinds[1]), pa.array([node for node, _ in some], pa.binary()), pa.array([e[0] for _, e in some], pa.int64()), pa.array([e[2] for _, e in some], pa.binary()), pa.array([e[3] for _, e in some], pa.binary())],
                    names=fields,
                )

        for batch in batches:
            kinds = batch.column("doc_id").type, batch.column("row_id").type
            for part in slices(batch, "text"):
                h, tf, bounds, nodes = shingle_sets(part.column("text"))
                for i, (doc_id, node) in enumerate(zip(part.column("doc_id").to_pylist(), nodes)):
                    entry = held.get(node)
                    if entry is None:
                        own = slice(bounds[i], bounds[i + 1])
                        often = tf[own].astype("<u4").tobytes() if (tf[own] > 1).any() else b""
                        held[node] = [1, doc_id, _packed(h[own]), often]
                        size += len(held[node][2]) + len(often) + 200
                        continue
                    entry[0] += 1
                    if entry[1] is None or doc_id is not None and doc_id < entry[1]:
                        entry[1] = doc_id
                none = pa.nulls(len(nodes), pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_id"), pa.array(nodes, pa.binary()), pa.nulls(len(nodes), pa.int64()), none, none], names=fields)
                if size > HELD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    return docs.mapInArrow(run, plus(docs.select("doc_id", "row_id"), "node binary, rows long, h binary, tf binary"))


def _cells(h: np.ndarray, row: int) -> np.ndarray:
    return ((h >> np.uint64(45 - 20 * row)) % np.uint64(WIDTH)).astype(np.int64)


def frequency_sketch(entered: DataFrame) -> tuple[np.ndarray, int]:
    """Document frequencies of all shingles by cell, and the number of documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, n = np.zeros((DEPTH, WIDTH), np.int64), 0
        for batch in batches:
            for part in slices(batch, "h", 4096, 4 << 20):
                h, _, bounds = _unpacked(part.column("h"), part.column("tf"))
                rows = np.array(part.column("rows").to_pylist(), np.int64)
                n += int(rows.sum())
                more = np.repeat(rows - 1, np.diff(bounds))
                again = np.flatnonzero(more)
                for row in range(DEPTH):
                    cells = _cells(h, row)
                    sketch[row] += np.bincount(cells, minlength=WIDTH)
                    if len(again):
                        np.add.at(sketch[row], cells[again], more[again])
        parts = sketch.reshape(-1, CHUNK)
        some = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array([-1, *some]), pa.array([np.array([n]).tobytes(), *(parts[i].astype("<u4").tobytes() for i in some)], pa.binary())], names=["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts")):
                blob = counts.as_buffer()
                # What comes from one task has 32 bits, sums and the number of documents have 64.
                values = np.frombuffer(blob, "<u4" if part >= 0 and len(blob) == 4 * CHUNK else "<i8").astype(np.int64)
                total[part] = total[part] + values if part in total else values
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([v.tobytes() for v in total.values()], pa.binary())], names=["part", "counts"])

    schema = "part long, counts binary"
    made = entered.select("rows", "h", "tf").mapInArrow(count, schema)
    # Added up in two steps, so that no task has the parts of all others.
    halfway = made.withColumn("salt", F.spark_partition_id() % SALTS).repartition("part", "salt").select("part", "counts").mapInArrow(add, schema)
    sketch, n = np.zeros((DEPTH * WIDTH // CHUNK, CHUNK), np.int64), 0
    for part, counts in halfway.repartition("part").mapInArrow(add, schema).collect():  # of a fixed size
        if part < 0:
            n = int(np.frombuffer(counts, "<i8")[0])
        else:
            sketch[part] = np.frombuffer(counts, "<i8")
    return sketch.reshape(DEPTH, WIDTH), n


def common_shingles(entered: DataFrame, sketch: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of all shingles that more than COMMON of the n documents have, and how many have each."""
    least = COMMON * n
    hot = entered.sparkSession.sparkContext.broadcast(sketch > least)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, int] = {}
        for batch in batches:
            for part in slices(batch, "h", 4096, 4 << 20):
                h, _, bounds = _unpacked(part.column("h"), part.column("tf"))
                rows = np.repeat(np.array(part.column("rows").to_pylist(), np.int64), np.diff(bounds))
                # A sketch never counts too few, so no common shingle is missed.
                at = np.flatnonzero(hot.value[0][_cells(h, 0)])
                for row in range(1, DEPTH):
                    at = at[hot.value[row][_cells(h[at], row)]]
                some, back = np.unique(h[at], return_inverse=True)
                for x, k in zip(some.view(np.int64).tolist(), np.bincount(back, rows[at], len(some)).tolist()):
                    total[x] = total.get(x, 0) + int(k)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array(list(total.values()), pa.int64())], names=["x", "df"])

    counted = entered.select("rows", "h", "tf").mapInArrow(count, "x long, df long").groupBy("x").agg(F.sum("df").alias("df"))
    # At most 1 / COMMON times the mean number of shingles of a document.
    found = counted.filter(F.col("df") > least).toArrow()
    h, df = (found.column(c).to_numpy().astype(np.int64) for c in ("x", "df"))
    order = np.argsort(h.view(np.uint64))
    return h.view(np.uint64)[order], df[order]


class Idf:
    """The inverse document frequencies that aren't 1, by shingle."""

    def __init__(self, h: np.ndarray, df: np.ndarray, n: int):
        self.h = h
        self.idf = (LEAST + (1 - LEAST) * np.clip(np.log(n / df) / -np.log(COMMON), 0, 1)).astype(np.float32)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(h >> np.uint64(44)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.ones(len(h), np.float32)
        if len(self.h):
            at = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
            place = np.minimum(np.searchsorted(self.h, h[at]), len(self.h) - 1)
            out[at] = np.where(self.h[place] == h[at], self.idf[place], np.float32(1))
        return out


def weights(h: np.ndarray, tf: np.ndarray, idf: Idf) -> np.ndarray:
    out = idf.of(h)
    again = np.flatnonzero(tf > 1)
    out[again] *= (1 + REPEATED - REPEATED / tf[again]).astype(np.float32)
    return out


def _reweighted(u: np.ndarray, log_w: np.ndarray) -> np.ndarray:
    """The place in the order of samples of shingles whose weight isn't 1, from the place u that they have at weight 1.

    Consistent sampling draws r and c from Gamma(2, 1) and beta from (0, 1), takes t = floor(ln w / r + beta) and orders by
    ln a = ln c - r (t - beta + 1). At weight 1, t is 0 and a is exponential. So a is drawn first, as -ln(1 - u), and with two
    exponentials e and x more, c = a + e, r = x + ln(c / a) and beta = x / r have that joint distribution. Weights of 1
    then need no arithmetic at all: u itself is the order.
    """
    a = -np.log1p(-((u >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
    v = mixed(u ^ np.uint64(0xA0761D6478BD642F))
    e, x = (-np.log((part.astype(np.float64) + 0.5) * 2.0**-32) for part in (v >> np.uint64(32), v & np.uint64(0xFFFFFFFF)))
    c = a + e
    r = x + np.log(c / a)
    beta = x / r
    t = np.floor(log_w / r + beta)
    share = -np.expm1(-np.exp(np.log(c) - r * (t - beta + 1)))
    return np.where(t == 0, u, (np.minimum(share, 1 - 2.0**-53) * 2.0**64).astype(np.uint64))


def samples(h: np.ndarray, w: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Consistent weighted samples of sets that lie one after the other, none of them empty: (sets, SAMPLES) 64-bit values.

    The smallest place of a set names its sample: it is a function of the shingle and its quantised weight alone.
    """
    out = np.full((len(bounds) - 1, SAMPLES), MOST)
    buffer = np.empty(min(PART, len(h)), np.uint64)
    for p in range(0, len(h), PART):
        own = h[p : p + PART]
        low, high = np.searchsorted(bounds, (p, p + len(own) - 1), "right") - 1
        starts = np.maximum(bounds[low : high + 1] - p, 0)
        odd = np.flatnonzero(w[p : p + PART] != 1)
        u = buffer[: len(own)]
        found = np.empty((high - low + 1, SAMPLES), np.uint64)
        for k in range(SAMPLES):
            np.multiply(own, _SEEDS[k], out=u)
            u[odd] = MOST
            found[:, k] = np.minimum.reduceat(u, starts)
        for at in (odd[i : i + 4096] for i in range(0, len(odd), 4096)):
            other, of = w[p : p + PART][at].astype(np.float64), np.searchsorted(starts, at, "right") - 1
            place = own[at][:, None] * _SEEDS
            # A weight below 1 can only put off a place, so most need no look.
            i, k = np.nonzero((place < found[of]) | (other > 1)[:, None])
            np.minimum.at(found, (of[i], k), _reweighted(place[i, k], np.log(other)[i]))
        out[low : high + 1] = np.minimum(out[low : high + 1], found)
    return out


def band_keys(sample: np.ndarray) -> np.ndarray:
    """64-bit keys of the bands: (sets, BANDS)."""
    parts = sample.reshape(-1, BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * ODD, parts.shape[:2]).copy()
    for i in range(ROWS):
        key = mixed(key ^ parts[:, :, i]) * ODD
    return key.view(np.int64)


def signatures(entered: DataFrame, idf) -> DataFrame:
    """(node, doc_id, rows, size, keys) of each entry; a text without words has no keys."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            h, tf, bounds = _unpacked(batch.column("h"), batch.column("tf"))
            size = np.diff(bounds)
            keys = band_keys(samples(h, weights(h, tf, idf.value), np.append(bounds[:-1][size > 0], len(h))))
            ends = np.cumsum(np.where(size > 0, BANDS, 0)).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(keys.ravel()))
            return pa.RecordBatch.from_arrays([batch.column("node"), batch.column("doc_id"), batch.column("rows"), pa.array(size), made], names=["node", "doc_id", "rows", "size", "keys"])

        return one

    return map_batches(entered, make, plus(entered.select("node", "doc_id", "rows"), "size long, keys array<long>"), 4096, "h", 2 << 20)


def vectors(entered: DataFrame, idf, wanted) -> DataFrame:
    """(node, h, w): sorted shingle hashes and their weights, of the entries whose nodes the filter may hold."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            batch = batch.filter(pa.array(filters.might_hold(wanted.value, batch.column("node"))))
            h, tf, bounds = _unpacked(batch.column("h"), batch.column("tf"))
            w = weights(h, tf, idf.value)
            ends = bounds.tolist()
            blobs = ([x[a:b].tobytes() for a, b in zip(ends, ends[1:])] for x in (h, w))
            return pa.RecordBatch.from_arrays([batch.column("node"), *(pa.array(b, pa.binary()) for b in blobs)], names=["node", "h", "w"])

        return one

    return map_batches(entered.select("node", "h", "tf"), make, plus(entered.select("node"), "h binary, w binary"), 4096, "h", 2 << 20)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """The weighted Jaccard similarity of two sorted vectors."""
    (ha, wa), (hb, wb) = (a, b) if len(a[0]) <= len(b[0]) else (b, a)
    if not len(ha):
        return float(not len(hb))
    at = np.minimum(np.searchsorted(hb, ha), len(hb) - 1)
    both = hb[at] == ha
    shared = np.minimum(wa[both], wb[at[both]]).sum(dtype=np.float64)
    return float(shared / (wa.sum(dtype=np.float64) + wb.sum(dtype=np.float64) - shared))


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], pa.binary()), pa.array([y for _, y in found], pa.binary())], names=["a", "b"])


class _Vectors:
    """The vectors of a batch: a view of its bytes for each row."""

    def __init__(self, batch: pa.RecordBatch):
        (self.h, self.at), (self.w, _) = raw(batch.column("h")), raw(batch.column("w"))

    def __getitem__(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.at[i], self.at[i + 1]
        return np.frombuffer(self.h[a:b].tobytes(), np.uint64), np.frombuffer(self.w[a // 2 : b // 2].tobytes(), np.float32)


def verified(pairs: DataFrame, vector: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """The (a, b) of pairs (a, b, size of b) with a similarity of at least threshold. A node's vector goes once to each share of its pairs."""
    share = F.pmod(F.xxhash64("b"), F.col("shares")).cast("int")
    shares = scratch.written(pairs.groupBy("a").agg(F.ceil(F.sum(F.col("size") + 16) * 12 / SHARE_BYTES).cast("int").alias("shares")), "near-shares")
    heads = shares.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"))
    own = heads.join(vector, F.col("a") == F.col("node")).select("a", "share", F.lit(0).alias("kind"), F.lit(None).cast("binary").alias("b"), "h", "w")
    other = pairs.join(shares, "a").withColumn("share", share).join(vector, F.col("b") == F.col("node")).select("a", "share", F.lit(1).alias("kind"), "b", "h", "w")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, now = None, None
        for batch in batches:
            for part in slices(batch, "h"):
                found, held = [], _Vectors(part)
                for i, (a, share, kind, b) in enumerate(zip(*(part.column(c).to_pylist() for c in ("a", "share", "kind", "b")))):
                    if kind == 0:
                        head, now = held[i], (a, share)
                    elif now == (a, share) and similarity(head, held[i]) >= threshold - 1e-6:
                        found.append((a, b))
                yield _pairs(found)

    rows = own.unionByName(other).repartition("a", "share").sortWithinPartitions("a", "share", "kind")
    return rows.mapInArrow(run, "a binary, b binary")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, class) of all nodes in links (a, b): the smallest node each is connected to."""
    both = scratch.written(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))), "near-edges")
    label = scratch.written(both.groupBy(F.col("u").alias("node")).agg(F.least(F.col("node"), F.min("v")).alias("class")), "near-labels")
    while True:
        near = both.join(label, both["u"] == label["node"]).groupBy("v").agg(F.min("class").alias("near"))
        new = label.join(near, label["node"] == near["v"], "left").select("node", F.col("class").alias("was"), F.least("class", "near").alias("class"))
        jump = label.select(F.col("node").alias("at"), F.col("class").alias("over"))
        new = new.join(jump, new["class"] == jump["at"], "left").select("node", "was", F.least("class", "over").alias("class"))
        moved = Observation()
        new = scratch.written(new.observe(moved, F.count(F.when(F.col("was") != F.col("class"), 1)).alias("n")), "near-labels")
        if not moved.get["n"]:
            return new.select("node", "class")
        label = new.select("node", "class")


def block_similarity(left: list[tuple], right: list[tuple]) -> np.ndarray:
    """similarity() of each of left with each of right, lists of vectors (h, w), but for rounding.

    A shingle has a column for each weight that it has in the block, in which all have a one who have at least that
    weight: the smaller of two weights is a sum over the columns that both have.
    """
    sizes = [len(h) for h, _ in left + right]
    row = np.repeat(np.arange(len(sizes)), sizes)
    h, w = (np.concatenate([v[k] for v in left + right]) for k in (0, 1))
    order = np.lexsort((w, h))
    h, w, row = h[order], w[order], row[order]
    new_h = np.r_[True, h[1:] != h[:-1]]
    new = new_h | np.r_[True, w[1:] != w[:-1]]
    kind = np.cumsum(new) - 1
    base = np.flatnonzero(new_h[new])[np.cumsum(new_h[new]) - 1]  # the first kind of each kind's shingle
    weight_of = w[new].astype(np.float64)
    level = np.arange(len(base)) - base
    gain = weight_of.copy()
    gain[level > 0] -= weight_of[:-1][level[1:] > 0]
    more = level[kind] + 1
    rows, columns = np.repeat(row, more), np.repeat(base[kind], more) + np.arange(more.sum()) - np.repeat(np.cumsum(more) - more, more)
    held = np.bincount(columns, minlength=len(gain)) > 1
    use = held[columns]
    rows, columns = rows[use], (np.cumsum(held) - 1)[columns[use]]
    gain = gain[held]
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    n, m = len(left), len(right)
    weight = np.zeros((n, m))
    for at in range(0, len(gain), COLUMNS):
        low, high = np.searchsorted(columns, (at, at + COLUMNS))
        ones = np.zeros((n + m, min(COLUMNS, len(gain) - at)))
        ones[rows[low:high], columns[low:high] - at] = 1
        weight += (ones[:n] * gain[at : at + COLUMNS]) @ ones[n:].T
    total = np.array([w.sum(dtype=np.float64) for _, w in left + right])
    return weight / (total[:n, None] + total[n:] - weight)


def block_links(rest: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b) between members of one bucket that are of different classes: enough of them to join all that are linked.

    rest: (key, blocks, node, class, h, w). A bucket is cut into blocks of about BLOCK members and BLOCK_BYTES; each pair of
    blocks is one group, in which every pair of members of different classes is compared by its vectors, until their classes are one.
    """
    rest = rest.withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    spread = rest.select("key", "node", "class", "h", "w", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    spread = spread.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "node", "class", "h", "w").repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(group: tuple, members: list[tuple]) -> Iterator[tuple[bytes, bytes]]:
        _, i, j = group
        left = [m for m in members if m[0] == i]
        right = [m for m in members if m[0] == j]
        names = {c: k for k, c in enumerate(dict.fromkeys(m[2] for m in members))}
        if not left or not right or len(names) < 2:
            return
        x, y = (np.array([names[m[2]] for m in side]) for side in (left, right))
        a, b = ([m[3] for m in side] for side in (left, right))
        least = threshold - 1e-6
        if len(a) * len(b) <= 16:
            near = np.array([[p != q and similarity(u, v) >= least for q, v in zip(y, b)] for p, u in zip(x, a)])
        else:
            found = block_similarity(a, b)
            near = found >= least
            for p, q in np.argwhere((abs(found - least) < 1e-4) & (x[:, None] != y)):
                near[p, q] = similarity(a[p], b[q]) >= least
        while len(open_ := np.argwhere(near & (x[:, None] != y))):
            p, q = open_[0]
            yield left[p][1], right[q][1]
            old, now = y[q], x[p]
            x[x == old] = now
            y[y == old] = now

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, members = None, []
        for batch in batches:
            for part in slices(batch, "h"):
                found, held = [], _Vectors(part)
                for n, (key, i, j, own, node, kind) in enumerate(zip(*(part.column(c).to_pylist() for c in ("key", "i", "j", "own", "node", "class")))):
                    if (key, i, j) != group:
                        if len(members) > 1:
                            found.extend(compare(group, members))
                        group, members = (key, i, j), []
                    members.append((own, node, kind, held[n]))
                yield _pairs(found)
        yield _pairs(list(compare(group, members)) if len(members) > 1 else [])

    return spread.mapInArrow(run, "a binary, b binary").distinct()


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, row_col: str | None = None) -> DataFrame:
    """(doc_id, row_id, class_id, class_size, kept) of each row. row_id is row_col, a unique number of each row, or one of our own."""
    spark, scratch = df.sparkSession, Scratch()
    row_id = (F.col(row_col).cast("long") if row_col else F.monotonically_increasing_id()).alias("row_id")
    docs = df.select(F.col(id_col).alias("doc_id"), row_id, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    made = scratch.written(entries(docs), "near-entries", compression="uncompressed")
    rows = scratch.written(made.filter("rows is null").select("doc_id", "row_id", "node"), "near-rows")
    entered = made.filter("rows is not null").drop("row_id")

    sketch, n = frequency_sketch(entered)
    idf = spark.sparkContext.broadcast(Idf(*common_shingles(entered, sketch, n), n))
    signed = signatures(entered, idf)
    nodes = scratch.written(signed.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.sum("rows").alias("rows"), F.first("size").alias("size"), F.first("keys").alias("keys")), "near-nodes")

    # Buckets of two or more; of buckets with the same members, which a digest of 128 bits shows, one.
    keyed = nodes.select("node", "size", F.explode("keys").alias("key"))
    digest = (F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") * 12 / BLOCK_BYTES)).cast("int").alias("blocks")
    shared = keyed.groupBy("key").agg(F.count("*").alias("n"), blocks, *digest).filter("n > 1")
    shared = scratch.written(shared.groupBy("n", "blocks", "x", "y").agg(F.min("key").alias("key")).select("key", "n", "blocks"), "near-keys")
    buckets = scratch.written(keyed.join(shared, "key").select("key", "n", "blocks", "node", "size"), "near-buckets")
    degree = scratch.written(buckets.groupBy("node").agg(F.sum("n").alias("degree")), "near-degrees")
    heads = buckets.join(degree, "node").groupBy("key").agg(F.max(F.struct("degree", "node"))["node"].alias("head"))
    first = scratch.written(buckets.join(heads, "key").filter("node != head").select(F.col("head").alias("a"), F.col("node").alias("b"), "size").distinct(), "near-pairs")

    wanted = spark.sparkContext.broadcast(filters.build(degree, "node"))
    vector = vectors(entered, idf, wanted).join(degree.select("node"), "node", "left_semi").dropDuplicates(["node"])
    vector = scratch.written(vector, "near-vectors", compression="uncompressed")

    links = scratch.written(verified(first, vector, threshold, scratch), "near-links")
    member = scratch.written(buckets.join(components(links, scratch), "node", "left").select("key", "blocks", "node", F.coalesce("class", "node").alias("class")), "near-members")
    torn = member.groupBy("key").agg(F.min("class").alias("low"), F.max("class").alias("high")).filter("low != high").select("key")
    rest = member.join(scratch.written(torn, "near-torn"), "key").join(vector, "node").select("key", "blocks", "node", "class", "h", "w")
    links = scratch.written(links.unionByName(block_links(rest, threshold)), "near-links")
    label = components(links, scratch).withColumnRenamed("node", "labelled")

    classes = nodes.select("node", "first_id", "rows").join(label, F.col("node") == F.col("labelled"), "left").select("node", F.coalesce("class", "node").alias("class"), "first_id", "rows")
    classes = scratch.written(classes, "near-classes")
    sizes = classes.groupBy("class").agg(F.min("first_id").alias("class_id"), F.sum("rows").alias("class_size"), F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "node"))).alias("keep"))
    outcome = scratch.written(classes.join(sizes, "class").select("node", "class_id", "class_size", (F.coalesce(F.col("keep")["node"], F.col("class")) == F.col("node")).alias("own")), "near-outcome")
    # Of the kept node's rows, one with the class's id: a node's rows are many only if a text is repeated with one id.
    one = rows.join(outcome.filter("own"), "node").filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy("node").agg(F.min("row_id").alias("row"))
    one = scratch.written(one.select(F.col("node").alias("kept_node"), "row"), "near-kept")
    scratch.done(rows, outcome, one)
    out = rows.join(outcome, "node").join(one, (F.col("node") == F.col("kept_node")) & (F.col("row_id") == F.col("row")), "left")
    return out.select("doc_id", "row_id", "class_id", "class_size", F.col("row").isNotNull().alias("kept"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents with its near-duplicate class."""
    return near_classes(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "kept")
