"""Interpolated modified Kneser-Ney language model of word pairs, counted in Spark and memory-mapped by the workers.

Counting: each task reduces its tokens to sorted distinct keys with counts and sends them on as blocks, one for each
range of keys; the task that owns a range merges the blocks and writes a shard, sorted arrays in one file of the shared
folder. Words are keyed by a 64-bit hash; their places in the shards, one after the other, are their ids, and pairs are
keyed by two ids. The pairs of one word are in one shard, except for words so frequent that they would fill one: their
pairs are dealt out by hash and their sums added up. A shard is renamed to its name when it is whole, so tasks can be
run again, and twice at a time.

Scoring: workers map the shards and search them for the sorted keys of a batch. What is mapped at a time is bounded in
bytes and files, so that neither grows with the model. The order is two because the distinct
triples of a corpus are most of its tokens (see the README for figures); shards of triples would not fit the disk.

Probabilities: P(w|u) = max(c(uw) - D(c(uw)), 0) / c(u.) + g(u) P(w), and likewise P(w) from the numbers of distinct
words before w, above a uniform share for each of the V words and one unknown. Each order has its three discounts,
estimated from how many of its counts are 1 to 4.

Defined results: a null or empty text is the end token alone; a null id counts as the empty text for the fold; equal
rows each give a row; other columns are ignored; with no training rows all probabilities are uniform; an empty table
gives an empty table.
"""

from __future__ import annotations

import functools
import os
import re
import tempfile
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, map_batches, plus, read_table, scratch_path, slices, small_batches, texts_of
from .textbytes import words

END, BEGIN = xxhash.xxh3_64_intdigest(b""), xxhash.xxh3_64_intdigest(b"\n")
FOLDS, HELD_OUT = 5, 1
#: Bytes of training text for each range of keys, and tokens that a task holds before it reduces them.
RANGE_BYTES, HELD_TOKENS = 32 << 20, 2_000_000
UNKNOWN = np.uint64(0xFFFFFFFF)
#: Counts from here on are kept apart, in 64 bits.
MOST = 0xFFFFFFFF
#: Runs of ranges to which a task sends blocks: beyond as many ranges they are dealt in more than one step.
FAN = 256
#: Keys in a block, and in the blocks that are sent or cut at a time, about.
BLOCK_KEYS, SENT_KEYS = 500_000, 2_000_000
#: Bytes and files that a worker keeps mapped, and bytes of text that it scores at a time: a file may be mapped anew for each.
MAPPED_BYTES, MAPPED_FILES, SCORED_BYTES = 96 << 20, 256, 2 << 20


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the tokens of all texts, each text ended by END, and the number of tokens of each."""
    h, first = words(texts)
    n = np.diff(first)
    out = np.full(len(h) + len(texts), np.uint64(END))
    out[np.arange(len(h)) + np.repeat(np.arange(len(texts)), n)] = h
    return out, n + 1


def reduced(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys and the sums of their counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


class Tally:
    """Counts of keys in sorted pieces, as many tokens at a time as fit."""

    def __init__(self):
        self.raw: list[np.ndarray] = []
        self.done: list[tuple[np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, keys: np.ndarray) -> bool:
        self.raw.append(keys)
        self.held += len(keys)
        if self.held >= HELD_TOKENS:
            self.squeeze()
        return sum(len(k) for k, _ in self.done) > 4 * HELD_TOKENS

    def squeeze(self) -> None:
        if self.raw:
            self.done.append(np.unique(np.concatenate(self.raw), return_counts=True))
        self.raw, self.held = [], 0

    def take(self) -> tuple[np.ndarray, np.ndarray]:
        self.squeeze()
        out = reduced(np.concatenate([k for k, _ in self.done]), np.concatenate([c for _, c in self.done])) if self.done else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        self.done = []
        return out


def _small(values: np.ndarray) -> bytes:
    """A block of unsigned 32-bit values: a task sends counts on before they can outgrow them."""
    if len(values) and int(values.max()) > 0xFFFFFFFF:
        raise OverflowError("a count of one task is over 32 bits")
    return values.astype("<u4").tobytes()


def _blocks(kind: str, parts: np.ndarray, keys: np.ndarray, values: np.ndarray, step: int = 1) -> Iterator[pa.RecordBatch]:
    """Rows for each run of `step` parts, under the first of them, with its keys and values, in the order that they have, at most BLOCK_KEYS a row."""
    parts = parts // step * step
    order = np.argsort(parts, kind="stable")
    parts, keys, values = parts[order], keys[order], values[order]
    at, first = np.unique(parts, return_index=True)
    edges = [*first.tolist(), len(parts)]
    rows = [(p, a, min(a + BLOCK_KEYS, end)) for p, start, end in zip(at.tolist(), edges, edges[1:]) for a in range(start, end, BLOCK_KEYS)]
    i = 0
    while i < len(rows):
        j = i + 1
        while j < len(rows) and rows[j][2] - rows[i][1] <= SENT_KEYS:
            j += 1
        own = rows[i:j]
        yield pa.RecordBatch.from_arrays([pa.array([kind] * len(own)), pa.array([p for p, _, _ in own], pa.int32()), pa.array([keys[a:b].tobytes() for _, a, b in own], pa.binary()), pa.array([_small(values[a:b]) for _, a, b in own], pa.binary())], names=["kind", "part", "keys", "counts"])
        i = j


BLOCKS = "kind string, part int, keys binary, counts binary"


# Files of the shared folder


@functools.lru_cache(maxsize=4)
def _system(uri: str) -> tuple[fs.FileSystem, str]:
    """Arrow's file system for a folder that Hadoop's names, too: s3a and s3n are s3 to it."""
    uri = re.sub("^s3[an]:", "s3:", uri)
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _put(folder: str, name: str, *arrays: np.ndarray) -> None:
    """Writes arrays one after the other as a file that appears when it is whole."""
    system, path = _system(folder)
    system.create_dir(path)
    part = f"{path}/.{name}-{os.getpid()}-{os.urandom(4).hex()}"
    with system.open_output_stream(part) as out:
        for a in arrays:
            out.write(np.ascontiguousarray(a).tobytes())
    system.move(part, f"{path}/{name}")


@functools.lru_cache(maxsize=2)
def _copies(folder: str) -> tuple:
    """A file without a name for copies of the files of a folder, which goes with the worker, and where each copy is in it."""
    return tempfile.TemporaryFile(prefix="tidewater-"), {}


def _map(folder: str, name: str) -> np.ndarray:
    """The bytes of a file, memory-mapped. Those of a folder that isn't mounted are copied at first."""
    system, path = _system(folder)
    if isinstance(system, fs.LocalFileSystem):
        path = f"{path}/{name}"
        return np.memmap(path, np.uint8, "r") if os.path.getsize(path) else np.zeros(0, np.uint8)
    held, places = _copies(folder)
    if name not in places:
        start = -(-held.seek(0, os.SEEK_END) // 4096) * 4096
        held.seek(start)
        with system.open_input_stream(f"{path}/{name}") as stream:
            while block := stream.read(1 << 22):
                held.write(block)
        places[name] = start, held.tell() - start
        held.flush()
    start, size = places[name]
    return np.memmap(held, np.uint8, "r", start, (size,)) if size else np.zeros(0, np.uint8)


class Maps:
    """The mapped files of a worker. Those used last stay, MAPPED_BYTES and MAPPED_FILES at most: each holds a file descriptor, and its pages count as memory."""

    def __init__(self):
        self.held: OrderedDict[tuple[str, str], np.ndarray] = OrderedDict()
        self.size = 0

    def get(self, folder: str, name: str) -> np.ndarray:
        key = (folder, name)
        if key in self.held:
            self.held.move_to_end(key)
            return self.held[key]
        found = self.held[key] = _map(folder, name)
        self.size += len(found)
        while len(self.held) > 1 and (self.size > MAPPED_BYTES or len(self.held) > MAPPED_FILES):
            self.size -= len(self.held.popitem(last=False)[1])
        return found


_maps = Maps()


def _mapped(folder: str, name: str) -> np.ndarray:
    return _maps.get(folder, name)


def _find(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of sorted keys in a sorted array, and which are there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


@dataclass
class Model:
    """What workers need beside the shards: numbers of a fixed size, starts of the ranges, and the frequent words."""

    folder: str
    starts: np.ndarray  # ids at which the ranges of words begin, and the number of ids
    total: int = 0  # N
    vocabulary: int = 0  # V
    wide: np.ndarray = None  # sorted ids of the words whose pairs are dealt out
    pairs: int = 0
    discounts: tuple = ((0.5, 1.0, 1.5), (0.5, 1.0, 1.5))
    spread: float = 1.0  # weight of the uniform share

    @property
    def parts(self) -> int:
        return len(self.starts) - 1

    def part_of_hash(self, hashes: np.ndarray) -> np.ndarray:
        return ((hashes >> np.uint64(32)) * np.uint64(self.parts) >> np.uint64(32)).astype(np.int64)

    def column(self, kind: str, part: int, at: int, of: str, width: int = 1) -> np.ndarray:
        """An array of a shard: it begins at byte `at` for each entry of the shard."""
        n = int(self.starts[part + 1] - self.starts[part])
        raw = _mapped(self.folder, f"{kind}-{part}")
        size = np.dtype(of).itemsize * width
        out = raw[at * n : (at + size) * n].view(of)
        return out.reshape(n, width) if width > 1 else out

    def ids(self, hashes: np.ndarray) -> np.ndarray:
        """Ids of sorted distinct hashes; UNKNOWN for those that training hasn't seen."""
        out = np.full(len(hashes), UNKNOWN)
        edges = np.searchsorted(self.part_of_hash(hashes), np.arange(self.parts + 1))
        for part in np.flatnonzero(np.diff(edges)):
            a, b = edges[part], edges[part + 1]
            at, there = _find(self.column("words", part, 0, "<u8"), hashes[a:b])
            out[a:b][there] = (at[there] + self.starts[part]).astype(np.uint64)
        return out

    def gather(self, ids: np.ndarray, kind: str, at: int, of: str, width: int = 1) -> np.ndarray:
        """Values of sorted known ids from the shards."""
        out = np.zeros((len(ids), width) if width > 1 else len(ids), of)
        edges = np.searchsorted(ids.astype(np.int64), self.starts)
        for part in np.flatnonzero(np.diff(edges)):
            a, b = edges[part], edges[part + 1]
            out[a:b] = self.column(kind, part, at, of, width)[(ids[a:b].astype(np.int64) - self.starts[part])]
        return out

    def part_of_pair(self, keys: np.ndarray) -> np.ndarray:
        """The shard of a pair: the range of its first word, or by hash if that word is dealt out."""
        first = (keys >> np.uint64(32)).astype(np.int64)
        part = np.searchsorted(self.starts, first, "right") - 1
        if len(self.wide):
            _, there = _find(self.wide, first)
            mixed = keys[there] * np.uint64(0x9E3779B97F4A7C15)
            mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            part[there] = ((mixed >> np.uint64(32)) % np.uint64(self.parts)).astype(np.int64)
        return part

    def pair_counts(self, keys: np.ndarray) -> np.ndarray:
        """Counts of sorted distinct pairs."""
        out = np.zeros(len(keys), np.int64)
        part = self.part_of_pair(keys)
        order = np.argsort(part, kind="stable")
        edges = np.searchsorted(part[order], np.arange(self.parts + 1))
        for p in np.flatnonzero(np.diff(edges)):
            own = order[edges[p] : edges[p + 1]]
            raw = _mapped(self.folder, f"pairs-{p}")
            n = len(raw) // 12
            at, there = _find(raw[: 8 * n].view("<u8"), keys[own])
            counts = raw[8 * n :].view("<u4")[at[there]].astype(np.int64)
            if (large := np.flatnonzero(counts == MOST)).size:
                raw = _mapped(self.folder, f"large-{p}")
                n = len(raw) // 16
                counts[large] = raw[8 * n :].view("<i8")[_find(raw[: 8 * n].view("<u8"), keys[own[there][large]])[0]]
            out[own[there]] = counts
        return out


def discounts(n: np.ndarray) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many counts are 1, 2, 3 and 4."""
    n1, n2, n3, n4 = map(float, n)
    if not (n1 and n2 and n3):
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    return tuple(min(max(d, 0.0), k) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3)))


def _count_of_counts(counts: np.ndarray) -> np.ndarray:
    return np.array([np.count_nonzero(counts == k) for k in (1, 2, 3, 4)], np.int64)


def first_step(parts: int) -> int:
    """How many ranges a block is for at first, so that a task makes no more than FAN blocks."""
    step = 1
    while step * FAN < parts:
        step *= FAN
    return step


def _merged(blocks: DataFrame, parts: int, part_of, finish) -> DataFrame:
    """Sends all blocks of a part to one task, which calls finish(kind, part, keys, counts) for each; it gives record batches of BLOCKS or numbers.

    Blocks come by first_step(parts) ranges. While that is more than one, they are dealt among tasks that cut them by a
    FANth of it, with part_of(kind, keys). So the number of blocks grows with the corpus, and not with its square.
    """
    step = first_step(parts)
    while step > 1:
        step //= FAN
        blocks = blocks.withColumn("salt", F.spark_partition_id() % FAN).repartition("kind", "part", "salt").drop("salt").mapInArrow(_cut(part_of, step), BLOCKS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, keys, counts = None, [], []

        def done() -> Iterator[pa.RecordBatch]:
            if now is not None:
                yield from finish(*now, *reduced(np.concatenate(keys), np.concatenate(counts)))

        for batch in batches:
            for kind, part, k, c in zip(*(batch.column(i).to_pylist() for i in ("kind", "part", "keys", "counts"))):
                if (kind, part) != now:
                    yield from done()
                    now, keys, counts = (kind, part), [], []
                keys.append(np.frombuffer(k, "<u8"))
                counts.append(np.frombuffer(c, "<u4").astype(np.int64))
        yield from done()

    # By number and not by hash, which would give several ranges to one task and none to others.
    return blocks.repartitionById(max(1, parts), F.col("part")).sortWithinPartitions("kind", "part").mapInArrow(run, BLOCKS)


def _cut(part_of, step: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        size = 0

        def done() -> Iterator[pa.RecordBatch]:
            for kind, found in held.items():
                keys, counts = (np.concatenate(x) for x in zip(*found))
                yield from _blocks(kind, part_of(kind, keys), keys, counts, step)
            held.clear()

        for batch in batches:
            for kind, k, c in zip(*(batch.column(i).to_pylist() for i in ("kind", "keys", "counts"))):
                held.setdefault(kind, []).append((np.frombuffer(k, "<u8"), np.frombuffer(c, "<u4")))
                size += len(k) // 8
                if size >= SENT_KEYS:
                    yield from done()
                    size = 0
        yield from done()

    return run


def _numbers(kind: str, part: int, values: np.ndarray) -> pa.RecordBatch:
    """A row of numbers among the blocks."""
    return pa.RecordBatch.from_arrays([pa.array([kind]), pa.array([part], pa.int32()), pa.array([np.asarray(values, "<i8").tobytes()], pa.binary()), pa.array([b""], pa.binary())], names=["kind", "part", "keys", "counts"])


def train(docs: DataFrame, folder: str) -> Model:
    """Counts (doc_id, text) into shards below folder."""
    with small_batches(docs.sparkSession):
        return _train(docs, folder)


def _train(docs: DataFrame, folder: str) -> Model:
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // RANGE_BYTES))
    model = Model(folder, np.zeros(parts + 1, np.int64), wide=np.zeros(0, np.int64))
    step = first_step(parts)

    def part_of(kind: str, keys: np.ndarray) -> np.ndarray:
        if kind == "words":
            return model.part_of_hash(keys)
        if kind == "pairs":
            return model.part_of_pair(keys)
        return np.searchsorted(model.starts, (keys >> np.uint64(2) if kind == "sums" else keys).astype(np.int64), "right") - 1

    def word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = tally.take()
            keys, counts = reduced(np.append(keys, np.uint64(BEGIN)), np.append(counts, 0))
            return _blocks("words", part_of("words", keys), keys, counts, step)

        for batch in batches:
            for piece in slices(batch, "text"):
                if tally.add(tokens(piece.column("text"))[0]):
                    yield from flush()
        yield from flush()

    limit = max(1, size // (6 * 4 * parts))  # a quarter of what a range has of tokens, about

    def put_words(kind: str, part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        _put(folder, f"words-{part}", keys.astype("<u8"), counts.astype("<i8"))
        wide = np.flatnonzero(counts > limit)
        yield _numbers("size", part, [len(keys), int(counts.sum()), int(np.count_nonzero(counts)), *wide])

    # One row a range; the frequent words are at most four a range.
    found = {r.part: np.frombuffer(r["keys"], "<i8") for r in _merged(docs.select("text").mapInArrow(word_blocks, BLOCKS), parts, part_of, put_words).collect()}
    for part in range(parts):
        if part not in found:
            _put(folder, f"words-{part}")
    model.starts = np.concatenate([[0], np.cumsum([found[p][0] if p in found else 0 for p in range(parts)])]).astype(np.int64)
    model.total, model.vocabulary = (int(sum(x[i] for x in found.values())) for i in (1, 2))
    model.wide = np.sort(np.concatenate([np.zeros(0, np.int64), *(found[p][3:] + model.starts[p] for p in found)]))
    if model.starts[-1] >= int(UNKNOWN):
        raise OverflowError("more distinct words than 32 bits can number")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tally = Tally()

        def flush() -> Iterator[pa.RecordBatch]:
            keys, counts = tally.take()
            return _blocks("pairs", part_of("pairs", keys), keys, counts, step)

        for batch in batches:
            for piece in slices(batch, "text"):
                if tally.add(pair_keys(model, *tokens(piece.column("text")))[0]):
                    yield from flush()
        yield from flush()

    def put_pairs(kind: str, part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if (large := counts >= MOST).any():
            _put(folder, f"large-{part}", keys[large].astype("<u8"), counts[large].astype("<i8"))
        _put(folder, f"pairs-{part}", keys.astype("<u8"), np.minimum(counts, MOST).astype("<u4"))
        yield _numbers("pair-counts", part, [len(keys), *_count_of_counts(counts)])
        after, n = np.unique(keys & UNKNOWN, return_counts=True)
        yield from _blocks("before", part_of("before", after), after, n, step)
        if not len(keys):
            return
        # Sums of each first word: of its counts, and how many are 1, 2, and 3 or more; the key has which sum in its low bits.
        first, at = np.unique(keys >> np.uint64(32), return_index=True)
        for which, values in enumerate((counts, counts == 1, counts == 2, counts >= 3)):
            sums = np.add.reduceat(values.astype(np.int64), at)
            own = first << np.uint64(2) | np.uint64(which)
            while len(big := np.flatnonzero(sums > MOST)):  # in steps that 32 bits can hold
                yield from _blocks("sums", part_of("sums", own[big]), own[big], np.full(len(big), MOST), step)
                sums[big] -= MOST
            yield from _blocks("sums", part_of("sums", own), own, sums, step)

    def put_sums(kind: str, part: int, keys: np.ndarray, counts: np.ndarray) -> Iterator[pa.RecordBatch]:
        if kind == "pair-counts":
            return
        n = int(model.starts[part + 1] - model.starts[part])
        if kind == "before":
            out = np.zeros(n, np.int64)
            out[keys.astype(np.int64) - model.starts[part]] = counts
            _put(folder, f"before-{part}", out)
            yield _numbers("before-counts", part, [*_count_of_counts(out), np.count_nonzero(out >= 3)])
        else:
            out = np.zeros((n, 4), np.int64)
            out[(keys >> np.uint64(2)).astype(np.int64) - model.starts[part], (keys & np.uint64(3)).astype(np.int64)] = counts
            _put(folder, f"sums-{part}", out)

    counted = _merged(docs.select("text").mapInArrow(pairs, BLOCKS), parts, part_of, put_pairs)
    spark = docs.sparkSession
    # Written, since its tasks make shards: what follows reads their rows and runs none of them again.
    table = scratch_path(spark, "model-blocks")
    counted.write.parquet(table)
    counted = spark.read.schema(BLOCKS).parquet(table)
    counted._tidewater_path = table
    low = np.sum([np.frombuffer(r["keys"], "<i8") for r in counted.filter("kind = 'pair-counts'").collect()], axis=0) if parts else np.zeros(5)
    high = np.sum([np.zeros(5, np.int64), *(np.frombuffer(r["keys"], "<i8") for r in _merged(counted.filter("kind != 'pair-counts'"), parts, part_of, put_sums).collect())], axis=0)
    discard(counted)
    system, path = _system(folder)
    there = {os.path.basename(f.path) for f in system.get_file_info(fs.FileSelector(path))}
    for part in range(parts):
        n = int(model.starts[part + 1] - model.starts[part])
        for name, empty in ((f"pairs-{part}", np.zeros(0)), (f"before-{part}", np.zeros(n, np.int64)), (f"sums-{part}", np.zeros((n, 4), np.int64))):
            if name not in there:
                _put(folder, name, empty)
    low = np.zeros(5, np.int64) if np.ndim(low) == 0 else low
    model.pairs = int(low[0])
    model.discounts = (discounts(high[:4]), discounts(low[1:]))
    d = model.discounts[0]
    if model.pairs:
        model.spread = (d[0] * high[0] + d[1] * high[1] + d[2] * high[4]) / model.pairs
    return model


def pair_keys(model: Model, hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each token with the one before it, and the token's ids."""
    distinct, back = np.unique(np.append(hashes, np.uint64(BEGIN)), return_inverse=True)
    ids = model.ids(distinct)[back]
    ids, begin = ids[:-1], ids[-1]
    before = np.roll(ids, 1)
    before[np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)] = begin
    return before << np.uint64(32) | ids, ids


def _less(counts: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.maximum(counts - np.array([0.0, *d])[np.minimum(counts, 3)], 0)


def score_batch(model: Model, texts: pa.Array) -> dict[str, np.ndarray]:
    """Numbers of tokens and known tokens, and both scores, of each text."""
    hashes, n = tokens(texts)
    keys, ids = pair_keys(model, hashes, n)
    known = ids != UNKNOWN
    words, back = np.unique(ids[known], return_inverse=True)
    count, before = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    count[known] = model.gather(words, "words", 8, "<i8")[back]
    before[known] = model.gather(words, "before", 0, "<i8")[back]
    uniform = model.spread / (model.vocabulary + 1)
    p = _less(before, model.discounts[0]) / max(model.pairs, 1) + uniform
    # Pairs whose words are both known, and the sums of first words that are.
    context = keys >> np.uint64(32)
    with_context = context != UNKNOWN
    first, back = np.unique(context[with_context], return_inverse=True)
    sums = model.gather(first, "sums", 0, "<i8", 4)[back]
    pairs, back = np.unique(keys[with_context & known], return_inverse=True)
    both = np.zeros(len(ids), np.int64)
    both[with_context & known] = model.pair_counts(pairs)[back]
    total = np.maximum(sums[:, 0], 1)
    d = model.discounts[1]
    rest = np.where(sums[:, 0] > 0, (sums[:, 1:] @ np.array(d)) / total, 1.0)
    p[with_context] = _less(both[with_context], d) / total + rest * p[with_context]
    at = np.concatenate([[0], np.cumsum(n)[:-1]]).astype(np.int64)
    base = np.log10((count + 0.5) / (model.total + 0.5 * (model.vocabulary + 1)))
    return {"n_tokens": n, "n_known": np.add.reduceat((count > 0).astype(np.int64), at), "base_score": np.add.reduceat(base, at), "score": np.add.reduceat(np.log10(p), at)}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out) and the scores of (doc_id, held_out, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = score_batch(shared.value, batch.column("text"))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *map(pa.array, found.values())], names=["doc_id", "held_out", *found])

        return one

    schema = plus(docs.select("doc_id", "held_out"), "n_tokens long, n_known long, base_score double, score double")
    return map_batches(docs, make, schema, 2048, "text", SCORED_BYTES).withColumn("train_tokens", F.lit(model.total).cast("long"))


def op8_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents scored by a model of those outside the held-out fold."""
    docs = texts_of(read_table(spark, sf_dir, "documents"), "doc_id", "text")
    fold = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(FOLDS))
    docs = docs.select("doc_id", (fold == HELD_OUT).alias("held_out"), "text")
    model = train(docs.filter(~F.col("held_out")), scratch_path(spark, "model"))
    return score(docs, model).select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
