"""Streaming histograms: bins (x, y) of a mean and a count, at most so many; the closest two become one."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .partitions import ddl, dealt
from .windows import Span, sliced

BINS = "array<struct<x:double,y:double>>"
#: Bins, or points of grids by bins, that are held at once.
HELD = 1 << 20


def insert(bins: list[list[float]], x: float, y: float, capacity: int) -> None:
    """Adds y at x. Of equally close neighbours the first two are merged."""
    at = bisect_left(bins, x, key=lambda b: b[0])
    if at < len(bins) and bins[at][0] == x:
        bins[at][1] += y
        return
    bins.insert(at, [x, y])
    if len(bins) > capacity:
        k = min(range(len(bins) - 1), key=lambda i: bins[i + 1][0] - bins[i][0])
        (x0, y0), (x1, y1) = bins[k], bins.pop(k + 1)
        bins[k] = [(x0 * y0 + x1 * y1) / (y0 + y1), y0 + y1]


def merged(parts: list[list[list[float]]], capacity: int) -> list[list[float]]:
    out: list[list[float]] = []
    for part in parts:
        for x, y in part:
            insert(out, x, y, capacity)
    return out


def quantiles(bins: list, precision: int) -> tuple[float, ...]:
    """min, q1, q2, q3, max, mode. A quartile is the point of an even grid whose share of the counts below is nearest to it.

    Half of a bin's count lies on each side of its value; between two values counts change linearly.
    """
    x, y = (np.array([b[i] for b in bins], float) for i in (0, 1))
    mode = float(x[y.argmax()])
    if len(x) == 1:
        return (float(x[0]),) * 5 + (mode,)
    step = (x[-1] - x[0]) / precision
    grid = x[0] + step / 2 + step * np.arange(precision)
    i = np.clip(np.searchsorted(x, grid, "right") - 1, 0, len(x) - 2)
    along = (grid - x[i]) / (x[i + 1] - x[i])
    at = y[i] + (y[i + 1] - y[i]) * along
    below = (np.cumsum(y) - y)[i] + y[i] / 2 + (y[i] + at) / 2 * along
    share = below / y.sum()
    q1, q2, q3 = (float(grid[np.abs(share - q).argmin()]) for q in (0.25, 0.5, 0.75))
    return float(x[0]), q1, q2, q3, float(x[-1]), mode


def quantile_rows(x: list[np.ndarray], y: list[np.ndarray], precision: int) -> np.ndarray:
    """quantiles() of many histograms at once, none of them empty: (rows, 6)."""
    n = np.array([len(v) for v in x])
    most = int(n.max(initial=1))
    inside = np.arange(most) < n[:, None]
    at, of = np.full(inside.shape, np.inf), np.zeros(inside.shape)
    at[inside], of[inside] = np.concatenate(x), np.concatenate(y)
    rows = np.arange(len(n))[:, None]
    low, high = at[:, 0], at[rows[:, 0], n - 1]
    step = (high - low) / precision
    grid = (low + step / 2)[:, None] + step[:, None] * np.arange(precision)
    i = np.clip((at[:, None, :] <= grid[:, :, None]).sum(2) - 1, 0, np.maximum(n - 2, 0)[:, None])
    after = np.minimum(i + 1, (n - 1)[:, None])
    with np.errstate(invalid="ignore", divide="ignore"):
        along = (grid - at[rows, i]) / (at[rows, after] - at[rows, i])
    height = of[rows, i] + (of[rows, after] - of[rows, i]) * along
    share = ((np.cumsum(of, 1) - of)[rows, i] + of[rows, i] / 2 + (of[rows, i] + height) / 2 * along) / of.sum(1)[:, None]
    quartiles = [grid[rows[:, 0], np.abs(share - q).argmin(1)] for q in (0.25, 0.5, 0.75)]
    mode = at[rows[:, 0], of.argmax(1)]
    return np.stack([low, *(np.where(n == 1, low, q) for q in quartiles), high, mode], 1)


def quantile_column(bins: Column, precision: int) -> Column:
    """A struct of the quantiles of each histogram; null where it is null or has no bins."""
    names = ["min", "q1", "q2", "q3", "max", "mode"]

    def of(x, y):
        out = np.full((len(x), 6), np.nan)
        some = np.array([i for i, v in enumerate(x) if v is not None and len(v)], np.int64)
        k = 0
        while k < len(some):
            # As many as have HELD points of grids by bins together, if each has as many bins as the largest.
            most = np.maximum.accumulate([len(x.iloc[i]) for i in some[k : k + 1024]])
            part = some[k : k + max(1, int((most * precision * np.arange(1, len(most) + 1) <= HELD).sum()))]
            k += len(part)
            out[part] = quantile_rows([np.asarray(x.iloc[i], float) for i in part], [np.asarray(y.iloc[i], float) for i in part], precision)
        return pd.DataFrame(out, columns=names)

    made = F.pandas_udf(of, ", ".join(f"{n} double" for n in names))(F.transform(bins, lambda b: b["x"]), F.transform(bins, lambda b: b["y"]))
    return F.when(F.size(bins) > 0, made)


def histogram_window(rows: DataFrame, keys: list[str], w: Span, value: Column, capacity: int, name: str) -> DataFrame:
    """The histogram of the bucket window of each row.

    A task goes through its rows in the order of keys, slice of time and time, and holds the bins of the last buckets of one
    key only, and up to HELD bins of answers: many small keys share a batch, and a large one isn't held.
    """
    out = rows.columns
    spread, own = sliced(rows, w)
    spread = spread.withColumns({"__own": own, "__in": value.cast("double"), "__first": F.col("__seq.seq"), "__then": F.col("__seq.asks")})
    group = [*keys, "__slice"]
    spread = dealt(spread, group, ["__ms", "__first", "__then"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, _Bins(w, capacity)
        for batch in batches:
            new, last = _turns(batch, group, last)
            ms, x, own = batch.column("__ms").to_numpy(), pc.fill_null(batch.column("__in"), np.nan).to_numpy(), batch.column("__own").to_numpy(zero_copy_only=False)
            xs, ys, ends, kept = [], [], [0], []
            for i, (turn, t, v, mine) in enumerate(zip(new.tolist(), ms.tolist(), x.tolist(), own.tolist())):
                if turn:
                    state = _Bins(w, capacity)
                bins = state.add(t, v)
                if not mine:
                    continue
                for b in bins:
                    xs.append(b[0])
                    ys.append(b[1])
                ends.append(len(xs))
                kept.append(i)
                if len(xs) > HELD:
                    yield _with(batch, out, kept, xs, ys, ends, name)
                    xs, ys, ends, kept = [], [], [0], []
            if kept:
                yield _with(batch, out, kept, xs, ys, ends, name)

    return spread.mapInArrow(run, f"{ddl(rows)}, `{name}` {BINS}")


def _turns(batch: pa.RecordBatch, group: list[str], last: list | None) -> tuple[np.ndarray, list]:
    """Which rows begin a group, after a row of the given group; and the last row's group."""
    new = np.zeros(len(batch), bool)
    for column in group:
        c = batch.column(column)
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        same = pc.or_(pc.fill_null(pc.equal(a, b), False), pc.and_(a.is_null(), b.is_null()))
        new[1:] |= ~same.to_numpy(zero_copy_only=False)
    of = [[batch.column(c)[i].as_py() for c in group] for i in (0, len(batch) - 1)]
    new[0] = of[0] != last
    return new, of[1]


def _with(batch: pa.RecordBatch, out: list[str], kept: list[int], xs: list[float], ys: list[float], ends: list[int], name: str) -> pa.RecordBatch:
    part = batch.select(out).take(pa.array(kept))
    bins = pa.StructArray.from_arrays([pa.array(xs, pa.float64()), pa.array(ys, pa.float64())], ["x", "y"])
    return pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), bins)], [*out, name])


class _Bins:
    """The bins of one key's buckets, as far as a window reaches; rows come in the order of time."""

    def __init__(self, w: Span, capacity: int):
        self.w, self.capacity = w, capacity
        self.buckets: dict[int, list] = {}
        self.now: int | None = None
        self.closed: list[list[float]] = []
        #: The window's bins, as long as nothing has had to be merged in it.
        self.whole: list[list[float]] | None = []

    def add(self, ms: int, x: float) -> list[list[float]]:
        b = ms // self.w.unit
        if b != self.now:
            # Earlier buckets don't change any more: they are merged once.
            self.buckets = {k: v for k, v in self.buckets.items() if k > b - self.w.n}
            self.now, self.closed = b, merged([self.buckets[k] for k in sorted(self.buckets)], self.capacity)
            self.whole = [list(c) for c in self.closed]
        if x == x:
            insert(self.buckets.setdefault(b, []), x, 1.0, self.capacity)
            if self.whole is not None:
                # Distinct values that all have a bin are the same in any order.
                self.whole = None if len(self.whole) >= self.capacity else self.whole
                if self.whole is not None:
                    insert(self.whole, x, 1.0, self.capacity)
        if self.whole is not None:
            return self.whole
        return merged([self.closed, self.buckets.get(b, [])], self.capacity)
