"""Packing of documents into sequences of a fixed window by non-negative least squares.

A document is its ids and an end id. Its full windows are sequences of their own. What is left of each document is a
length below the window, and the histogram of these lengths, of at most a window's bins at any size of the corpus, is
all the driver sees. It enumerates the combinations of two or three lengths that fill a window exactly, solves
min |A x - h| with x >= 0 for how often to repeat each, rounds, and lets no length be used more often than it occurs.
The documents beyond the rounded plan are packed greedily: the longest left is opened with, and the longest that still
fits is added until the sequence is full. Only what can't fill a sequence so is laid end to end and cut, so that the
very last sequence alone can have padding. plan() says how many documents each of these steps has placed.

Which document takes which place follows from its rank among those of its length. Ranks come from a window over
(length, bucket of the row), with as many buckets as the table needs, so that a length that a third of all documents
share, or a row that is repeated, is still dealt out; the bases of the buckets are summed apart.

Defined results: a null or empty text is the end id alone; a null doc_id stays null; equal rows are each packed; other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import map_batches, plus, read_table, texts_of, tokenizer_path, written
from .textbytes import raw
from .word_bpe import UnitCache, held, vocabulary

VOCABULARY = "word_bpe_49k.json"
#: Rows of the table for each bucket: one length has at most about so many rows in a bucket.
BUCKET_ROWS = 4_000
#: A combination is worth a place in the solution if its lengths lack so many repeats on the mean.
TOLERANCE = 0.5


def id_type(path: str, end_id: int) -> str:
    """How ids are stored: in 16 bits if all fit."""
    return "<u2" if max(vocabulary(path).tokenizer.get_vocab_size(with_added_tokens=True) - 1, end_id) < 1 << 16 else "<u4"


def token_table(df: DataFrame, id_col: str, text_col: str, path: str, end_id: int, window: int) -> DataFrame:
    """(doc_id, ids, n, r): ids with the end id as id_type() says, their number, and n mod window."""
    docs = texts_of(df, id_col, text_col)
    kind = np.dtype(id_type(path, end_id))

    def make():
        cache = held(UnitCache, path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids, at = cache.encode(batch.column("text"), end_id)
            blobs = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((at * kind.itemsize).astype(np.int32).tobytes()), pa.py_buffer(ids.astype(kind).tobytes())])
            n = np.diff(at)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), blobs, pa.array(n), pa.array((n % window).astype(np.int32))], names=["doc_id", "ids", "n", "r"])

        return one

    return map_batches(docs, make, plus(docs.select("doc_id"), "ids binary, n long, r int"), 512, "text")


def combinations(present: np.ndarray, window: int) -> np.ndarray:
    """All pairs and triples of the lengths present that fill a window; a pair has 0 as its third."""
    has = np.zeros(window + 1, bool)
    has[present] = True
    pairs = [(a, window - a, 0) for a in present.tolist() if a <= window - a and has[window - a]]
    found = [np.array(pairs, np.int32).reshape(-1, 3)]
    for a in present[present * 3 <= window].tolist():
        b = present[(present >= a) & (present * 2 <= window - a)]
        b = b[has[window - a - b]]
        found.append(np.stack([np.full(len(b), a), b, window - a - b], 1).astype(np.int32))
    return np.concatenate(found)


def solve_counts(h: np.ndarray, columns: np.ndarray, tolerance: float = TOLERANCE, rounds: int = 400, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray, bool]:
    """Non-negative least squares of columns against h by an active set: (active columns, repeats, whether they are optimal).

    Each round adds the columns that reduce the error most, no two of them with a length in common, and improves all
    active ones by accelerated projected gradient steps. The solution is optimal when no column's gradient, a mean of
    what its lengths lack, is over the tolerance, and that of no repeated one under it. Few columns stay active, which is
    what makes rounding harmless. It ends without that when the error no longer falls.
    """
    size = len(h)
    active, x = np.zeros(0, np.int64), np.zeros(0)
    if not len(columns):
        return columns, x, True
    deep = (columns > 0).sum(1)

    def lacking(of: np.ndarray, x: np.ndarray) -> np.ndarray:
        fill = np.zeros(size)
        for i in range(3):
            fill += np.bincount(of[:, i], x, size)
        fill[0] = 0
        return h - fill

    last = np.inf
    for turn in range(rounds):
        left = lacking(columns[active], x)
        left[0] = 0
        gain = left[columns].sum(1) / deep
        own = gain[active]
        gain[active] = 0
        more = np.flatnonzero(gain > tolerance)
        if not len(more) and np.all(np.where(x > 0, abs(own), own) <= tolerance):
            return columns[active], x, True
        error = float(left @ left)
        if turn % 8 == 7:
            if error > 0.999 * last:
                break
            last = error
        used = np.zeros(size, bool)
        new = []
        for j in more[np.argsort(-gain[more])][: 16 * size].tolist():
            a, b, c = columns[j].tolist()
            if not (used[a] or used[b] or used[c]):
                new.append(j)
                used[[a, b, c]] = True
                used[0] = False
        active, x = np.concatenate([active, new]).astype(np.int64), np.concatenate([x, np.zeros(len(new))])
        of = columns[active]
        often = sum(np.bincount(of[:, i], minlength=size) for i in range(3))
        often[0] = 0
        step = 1 / np.maximum(1, often[of].sum(1))
        y, momentum = x, 1.0
        for _ in range(sweeps):
            down = lacking(of, y)
            down[0] = 0
            ahead = np.maximum(0, y + step * down[of].sum(1))
            after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
            y, x, momentum = np.maximum(0, ahead + (momentum - 1) / after * (ahead - x)), ahead, after
        keep = x > 1e-3
        active, x = active[keep], x[keep]
    return columns[active], x, False


def best_fit(left: np.ndarray, window: int) -> list[tuple[list[int], int]]:
    """(lengths, times) of full sequences, greedily: the longest left, then the longest that fits. Takes them off left."""
    out = []
    tried = np.zeros(len(left), bool)
    while len(open_ := np.flatnonzero((left > 0) & ~tried)):
        parts = [int(open_[-1])]
        free = left.copy()
        free[parts[0]] -= 1
        room = window - parts[0]
        while room and len(fits := np.flatnonzero(free[1 : room + 1] > 0)):
            parts.append(int(fits[-1]) + 1)
            free[parts[-1]] -= 1
            room -= parts[-1]
        if room:
            tried[parts[0]] = True
            continue
        lengths, need = np.unique(parts, return_counts=True)
        times = int((left[lengths] // need).min())
        left[lengths] -= need * times
        out.append((parts, times))
    return out


def plan(h: np.ndarray, window: int) -> dict[str, np.ndarray]:
    """Places for the leftovers: for each length, by rank, its slots in sequences, and the start of the rest.

    slots: rows (length, first rank, sequence of that rank, offset), sorted; taken: ranks of a length that have slots;
    rest: where the others of a length begin in the strip that is cut into windows; n: sequences before that strip;
    placed: how many documents have their place by the solution, by the greedy step, and in the strip.
    """
    present = np.flatnonzero(h)
    columns, x, _ = solve_counts(h.astype(float), combinations(present, window))
    left, slots, taken, n = h.copy(), [], np.zeros(window, np.int64), 0

    def use(parts: list[int], times: int) -> None:
        nonlocal n
        offset = 0
        for part in parts:
            slots.append((part, taken[part], n, offset))
            taken[part] += times
            offset += part
        n += times

    for j in np.argsort(-x).tolist():
        parts = [p for p in columns[j].tolist() if p]
        lengths, need = np.unique(parts, return_counts=True)
        times = int(min(np.rint(x[j]), (left[lengths] // need).min()))
        if times > 0:
            left[lengths] -= need * times
            use(parts, times)
    solved = int(taken.sum())
    for parts, times in best_fit(left, window):
        use(parts, times)
    order = np.arange(window - 1, 0, -1)
    rest = np.zeros(window, np.int64)
    rest[order] = np.concatenate([[0], np.cumsum(left[order] * order)[:-1]])
    return {"slots": np.array(sorted(slots), np.int64).reshape(-1, 4), "taken": taken, "rest": rest, "n": np.int64(n), "placed": np.array([solved, taken.sum() - solved, left.sum()])}


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, unsigned 32-bit little-endian)."""
    spark = df.sparkSession
    path = path or tokenizer_path(VOCABULARY)
    # The row's number is written with it, so it stays the same whoever reads it again.
    tokens = written(token_table(df, id_col, text_col, path, end_id, window).withColumn("uid", F.monotonically_increasing_id()), "tokens", compression="zstd")
    buckets = max(1, -(-tokens.count() // BUCKET_ROWS))
    tokens = tokens.withColumn("bucket", F.pmod(F.xxhash64("uid"), F.lit(buckets)))
    sizes = tokens.groupBy("r", "bucket").agg(F.count("*").alias("rows"), F.sum(F.floor(F.col("n") / window)).alias("full"))
    h, full = np.zeros(window, np.int64), np.zeros(window, np.int64)
    for r, rows, f in sizes.groupBy("r").agg(F.sum("rows"), F.sum("full")).collect():  # at most `window` rows
        h[r], full[r] = rows, f
    h[0] = 0
    places = plan(h, window)
    places["full"] = np.concatenate([[0], np.cumsum(full)[:-1]])
    all_full = int(full.sum())
    shared = spark.sparkContext.broadcast(places)

    before = Window.partitionBy("r").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("r", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("base"), F.coalesce(F.sum("full").over(before), F.lit(0)).alias("base_full"))
    own = Window.partitionBy("r", "bucket").orderBy("uid")
    ranked = tokens.withColumn("rank", F.row_number().over(own) - 1)
    ranked = ranked.withColumn("full", F.sum(F.floor(F.col("n") / window)).over(own.rowsBetween(Window.unboundedPreceding, 0)) - F.floor(F.col("n") / window))
    placed = ranked.join(bases, ["r", "bucket"]).select("doc_id", "ids", "n", "r", (F.col("rank") + F.col("base")).alias("rank"), (F.col("full") + F.col("base_full")).alias("full"))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def make():
        to = shared.value
        kind = np.dtype(id_type(path, end_id))
        slots, first_of, taken, rest = to["slots"], np.searchsorted(to["slots"][:, 0], np.arange(window + 1)), to["taken"], to["rest"]

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            row, out, blobs = [], [], []
            data, edges = raw(batch.column("ids"))
            for i, (n, r, rank, at) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("n", "r", "rank", "full")))):
                ids = np.frombuffer(data[edges[i] : edges[i + 1]].tobytes(), kind).astype("<u4")
                pieces = [(k * window, window, int(to["full"][r]) + at + k, 0) for k in range(n // window)]
                start = n - r
                if r and rank < taken[r]:
                    low, high = first_of[r], first_of[r + 1]
                    s = low + np.searchsorted(slots[low:high, 1], rank, "right") - 1
                    pieces.append((start, r, all_full + int(slots[s, 2]) + rank - int(slots[s, 1]), int(slots[s, 3])))
                elif r:
                    at = int(rest[r]) + (rank - int(taken[r])) * r
                    fits = min(r, window - at % window)
                    for begin, length in ((0, fits), (fits, r - fits)):
                        if length:
                            pieces.append((start + begin, length, all_full + int(to["n"]) + (at + begin) // window, (at + begin) % window))
                for begin, length, sequence, offset in pieces:
                    blob = ids[begin : begin + length].tobytes()
                    row.append(i)
                    out.append((begin, length, zlib.crc32(blob), n, sequence, offset))
                    if with_ids:
                        blobs.append(blob)
            made = np.array(out, np.int64).reshape(-1, 6)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(made[:, i]) for i in range(6))]
            if with_ids:
                columns.append(pa.array(blobs, pa.binary()))
            return pa.RecordBatch.from_arrays(columns, names=names + ["ids"] * with_ids)

        return one

    fields = ", ".join(f"`{name}` long" for name in names[1:]) + ", ids binary" * with_ids
    return map_batches(placed, make, plus(placed.select("doc_id"), fields), 512, "ids")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048."""
    return pack(read_table(spark, sf_dir, "documents"))
