"""Aggregates over the rows of other keys than a row's own: of members of its set, or of a key that is fixed.

Rows that ask and rows that contribute go by time, not by member: to slices of a part of the window, and contributions to
all the slices that can ask for them. A slice's contributions are held as arrays ordered by (member, time), so what an event
asks for are ranges of them. Sets exist one event at a time, in the answer only; none is shuffled, and what an event asks
for isn't spread to a row for each member and put together again.

A window is the end of what lies before the slice, summed from its end, and the slice's own beginning, summed from its
beginning: nothing that has left it is subtracted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .partitions import ddl, dealt
from .windows import Span

#: Groups of keys that a slice of time is dealt to.
SLOTS = 64
#: Members of sets that a batch of answers holds before it is passed on.
HELD = 1 << 20
#: A time before all others.
NEVER = -(1 << 60)

TYPES = {"COUNT": "double", "SUM": "double", "SET": "array<string>", "COUNT_DISTINCT": "bigint"}


def hop_window(asking: DataFrame, adds: DataFrame, ons: tuple[list[Column], list[Column]], w: Span, op: str, name: str, members: str | None, parts: int) -> DataFrame:
    """asking with op over the adds of its members in the window of each row; null where there is no set of members.

    asking has __ms and an array of texts, members; adds have __ms, __member and __v; ons are the other keys of both. Without
    members, an event asks for all adds of its keys. All of the same millisecond are in the window. COUNT reads whole units
    of the window, the others are exact. An event without a time reads nothing.
    """
    out, size = asking.columns, max(w.ms // parts, 1)
    of_asking, of_adds = map(_text, ons)
    ms = F.col("__ms")
    slot = F.pmod(F.xxhash64("__on"), F.lit(SLOTS)).cast("int")
    # A contribution is read from its own time on for less than a window.
    reached = F.sequence(F.floor(ms / size), F.floor((ms + (w.ms - 1)) / size))
    adds = adds.filter(ms.isNotNull()).select("__ms", "__member", F.col("__v"), of_adds.alias("__on"), F.explode(reached).alias("__slice"), F.lit(False).alias("__asks"))
    asking = asking.withColumns({"__on": of_asking, "__slice": F.coalesce(F.floor(ms / size), F.lit(-1)), "__asks": F.lit(True)})
    adds, asking = adds.withColumns(_blanks(asking, adds)), asking.withColumns(_blanks(adds, asking))
    rows = asking.unionByName(adds).withColumn("__slot", slot)
    rows = dealt(rows, ["__slot", "__slice"], ["__asks", "__ms"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, found = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("__slot", "__slice", "__asks")], 1)
            turns = np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1
            for a, b in zip([0, *turns], [*turns, len(marks)]):
                group, asks = tuple(marks[a, :2]), marks[a, 2]
                if group != last:
                    last, held, found = group, [], None
                part = batch.slice(a, b - a)
                if not asks:
                    held.append(part.select(["__on", "__member", "__ms", "__v"]))
                    continue
                if found is None:
                    found = _Contributions(held, int(group[1]) * size, w, op, name, members)
                    held = []
                yield from found.answers(part, out)

    return rows.mapInArrow(run, f"{ddl(asking.select(*out))}, `{name}` {TYPES[op]}")


def _blanks(df: DataFrame, other: DataFrame) -> dict[str, Column]:
    """Columns of df that the other lacks. Texts and arrays are empty and not null: Arrow's writer takes the size of a batch
    after each row, and goes through the nulls at the end of a column each time."""

    def blank(kind: T.DataType) -> Column:
        if isinstance(kind, T.StructType):
            return F.struct(*(blank(f.dataType).alias(f.name) for f in kind.fields))
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.lit("").cast(kind)
        return (F.array() if isinstance(kind, T.ArrayType) else F.lit(None)).cast(kind)

    return {f.name: blank(f.dataType) for f in df.schema.fields if f.name not in other.columns}


def _text(keys: list[Column]) -> Column:
    """One text for the keys, another one for other keys."""
    return F.concat(*(F.coalesce(F.concat(F.length(k).cast("string"), F.lit(":"), k), F.lit("n")) for k in keys)) if keys else F.lit("")


class _Contributions:
    """What a slice's rows can ask for, ordered by key and time."""

    def __init__(self, held: list[pa.RecordBatch], start: int, w: Span, op: str, name: str, by: str | None):
        self.w, self.op, self.name, self.by = w, op, name, by
        self.empty = not held
        if self.empty:
            return
        rows = pa.Table.from_batches(held).combine_chunks()
        on, member = (rows.column(c).combine_chunks().dictionary_encode() for c in ("__on", "__member"))
        self.ons, self.members = on.dictionary, member.dictionary
        keys, key = np.unique(self._pair(on.indices.to_numpy(), member.indices.to_numpy()), return_inverse=True)
        ms = rows.column("__ms").to_numpy()
        order = np.lexsort((ms, key))
        self.keys, key, ms = keys, key[order], ms[order]
        # Places of (key, time) by ranks, which can't overflow.
        self.times, rank = np.unique(ms, return_inverse=True)
        self.places = key * (len(self.times) + 1) + rank
        value = rows.column("__v").combine_chunks()
        if op == "SUM":
            v = value.to_numpy(zero_copy_only=False)[order]
            begin = np.flatnonzero(np.diff(key, prepend=-1))
            # Of each key, from a row to the slice's start, and from the slice's start to a row, with the row.
            self.before, self.upto = np.zeros(len(v)), np.zeros(len(v))
            middle = self._place(np.arange(len(keys)), start, "left")
            for a, m, b in zip(begin, middle, [*begin[1:], len(v)]):
                self.before[a:m] = v[a:m][::-1].cumsum()[::-1]
                self.upto[m:b] = v[m:b].cumsum()
            self.middle = middle
        elif op in ("SET", "COUNT_DISTINCT"):
            coded = value.dictionary_encode()
            ranks = pc.sort_indices(coded.dictionary).to_numpy()
            self.values = coded.dictionary.take(pa.array(ranks))
            place = np.empty(len(ranks), np.int32)
            place[ranks] = np.arange(len(ranks), dtype=np.int32)
            self.codes = place[coded.indices.to_numpy()][order]

    def _pair(self, on: np.ndarray, member: np.ndarray) -> np.ndarray:
        return on.astype(np.int64) * len(self.members) + member

    def _place(self, key: np.ndarray, ms: np.ndarray | int, side: str) -> np.ndarray:
        return np.searchsorted(self.places, key * (len(self.times) + 1) + np.searchsorted(self.times, ms, side))

    def answers(self, asks: pa.RecordBatch, out: list[str]) -> Iterator[pa.RecordBatch]:
        sets = asks.column(self.by) if self.by else pa.ListArray.from_arrays(pa.array(np.arange(len(asks) + 1, dtype=np.int32)), pa.array([""] * len(asks)))
        none = sets.is_null()
        n = len(asks)
        size = pc.fill_null(pc.list_value_length(sets), 0).to_numpy().astype(np.int64)
        of = np.repeat(np.arange(n), size)
        low = high = key = np.zeros(0, np.int64)
        if not self.empty:
            on = pc.fill_null(pc.index_in(asks.column("__on"), self.ons), -1).to_numpy()[of]
            member = pc.fill_null(pc.index_in(sets.flatten(), self.members), -1).to_numpy()
            some = (on >= 0) & (member >= 0)
            of, pair = of[some], self._pair(on[some], member[some])
            key = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            some = self.keys[key] == pair
            of, key = of[some], key[some]
            ms = pc.fill_null(asks.column("__ms"), NEVER).to_numpy()[of]
            since = (ms // self.w.unit - self.w.n + 1) * self.w.unit if self.op == "COUNT" else ms - self.w.ms + 1
            low, high = self._place(key, since, "left"), self._place(key, ms, "right")
        else:
            of = of[:0]
        if self.op in ("COUNT", "SUM"):
            made = pa.array(np.bincount(of, self._each(key, low, high), n).astype(float), mask=none.to_numpy(zero_copy_only=False))
            yield self._with(asks, out, made)
            return
        yield from self._sets(asks, out, none, of, low, high)

    def _each(self, key: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        if self.op == "COUNT" or self.empty:
            return (high - low).astype(float)
        middle = self.middle[key]
        return np.where(low < middle, self.before[np.minimum(low, len(self.before) - 1)], 0.0) + np.where(high > middle, self.upto[high - 1], 0.0)

    def _sets(self, asks: pa.RecordBatch, out: list[str], none: pa.Array, of: np.ndarray, low: np.ndarray, high: np.ndarray) -> Iterator[pa.RecordBatch]:
        ends = np.searchsorted(of, np.arange(len(asks)), "right")
        known: dict[bytes, np.ndarray] = {}
        ranges = np.stack([low, high], 1)
        found, total, first, begin = [], 0, 0, 0
        nothing = np.zeros(0, np.int32)
        for i, end in enumerate(ends):
            if begin == end:
                codes = nothing
            else:
                # Events that ask for the same are answered once.
                ask = ranges[begin:end].tobytes()
                codes = known.get(ask)
                if codes is None:
                    codes = np.concatenate([self.codes[a:b] for a, b in ranges[begin:end]])
                    codes.sort()
                    codes = codes[np.diff(codes, prepend=-1) > 0] if len(codes) else codes
                    if self.op == "COUNT_DISTINCT":
                        codes = len(codes)
                    known[ask] = codes
            begin = end
            if self.op == "COUNT_DISTINCT":
                found.append(codes if codes is not nothing else 0)
                continue
            found.append(codes)
            total += len(codes)
            if total > HELD:
                yield self._with(asks.slice(first, i + 1 - first), out, self._lists(found, none[first : i + 1]))
                found, total, first = [], 0, i + 1
                known.clear()
        if first < len(asks):
            made = pa.array(found, pa.int64(), mask=none.to_numpy(zero_copy_only=False)) if self.op == "COUNT_DISTINCT" else self._lists(found, none[first:])
            yield self._with(asks.slice(first), out, made)

    def _lists(self, found: list[np.ndarray], none: pa.Array) -> pa.Array:
        at = np.cumsum([0, *map(len, found)]).astype(np.int32)
        offsets = pa.array(at, mask=np.append(none.to_numpy(zero_copy_only=False), False))
        if self.empty:
            return pa.ListArray.from_arrays(offsets, pa.array([], pa.string()))
        return pa.ListArray.from_arrays(offsets, self.values.take(pa.array(np.concatenate(found))))

    def _with(self, asks: pa.RecordBatch, out: list[str], made: pa.Array) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([*(asks.column(c) for c in out), made], [*out, self.name])
