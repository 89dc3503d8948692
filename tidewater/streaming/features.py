"""Temporal features and patterns on streams. One stateful operator for each set of keys emits a row for each event.

With a delay, state goes by a watermark, the largest time seen less the delay: events older than it are dropped, what no
window that ends at it or later can reach is dropped from a key's state, and all of the state of a key that has fallen
silent. DIFF looks back by events and not by time; where a feature has it, a key's state stays. Without a delay no event
is dropped, and state is cut back only when its key has another event.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.windows import span
from ..plans.syntax import FeatureError, parse_call
from .state import FeatureState

#: The functions that streams have; all others are batch only.
OPS = {"COUNT", "SUM", "AVG", "MAX", "MIN", "VARIANCE", "DIFF", "COUNT_DISTINCT", "SET", "HIST"}
KINDS = {"COUNT_DISTINCT": "long", "SET": "array<string>", "HIST": "array<struct<x:double,y:double>>"}


@dataclass(frozen=True)
class StreamFeature:
    """A feature text whose keys are those of its operator, under a name."""

    name: str
    op: str
    window: str
    event_type: str
    target: str
    bins: int = 0

    @classmethod
    def of(cls, name: str, text: str) -> StreamFeature:
        call = parse_call(text)
        if call.op not in OPS:
            raise FeatureError(f"streams have no {call.op}: {text}")
        if len(call.args) < 3:
            raise FeatureError(f"a window, an event type and a target are needed: {text}")
        bins = int(call.args[3].value) if call.op == "HIST" else 0
        return cls(name, call.op, call.args[0].name, call.args[1].name, call.args[2].name, bins)

    def sees(self, event_type: str | None) -> bool:
        return self.event_type == "___ALL___" or (event_type or "").lower() == self.event_type.lower()


def _timed(df: DataFrame, ms: str, delay_ms: int | None) -> tuple[DataFrame, str]:
    """df with a watermark on its milliseconds, if there is a delay, and how state times out."""
    if delay_ms is None:
        return df, GroupStateTimeout.NoTimeout
    return df.withColumn("__ts", F.timestamp_millis(F.col(ms))).withWatermark("__ts", f"{delay_ms} milliseconds"), GroupStateTimeout.EventTimeTimeout


def _in_time(groups: Iterator[pd.DataFrame], state: GroupState, ms: str, seq: str, delay_ms: int | None) -> pd.DataFrame:
    """A key's new events in the order of time, without those behind the watermark. Spark drops them by that of the batch before."""
    rows = pd.concat(list(groups)).sort_values([ms, seq], kind="stable")
    return rows if delay_ms is None else rows[rows[ms] >= state.getCurrentWatermarkMs()]


def _keep(state: GroupState, held: tuple, until: int | None, delay_ms: int | None) -> None:
    """Keeps held as a key's state until the watermark reaches a time; None: for ever."""
    if delay_ms is None or until is None:
        state.update(held)
    elif until > state.getCurrentWatermarkMs():
        state.update(held)
        state.setTimeoutTimestamp(until)
    elif state.exists:
        state.remove()


def stream_features(df: DataFrame, keys: list[str], features: list[StreamFeature], seq: str = "event_id", ms: str = "c_timestamp", event_type: str = "event_type", delay_ms: int | None = None) -> DataFrame:
    """seq and a column for each feature, for each event of a stream; null on events that a feature doesn't see."""
    kinds = dict(df.dtypes)
    widest = None if any(f.op == "DIFF" for f in features) else max((span(f.window).ms for f in features), default=0)
    df, timeout = _timed(df, ms, delay_ms)
    out = f"`{seq}` {kinds[seq]}, " + ", ".join(f"`{f.name}` {KINDS.get(f.op, 'double')}" for f in features)

    def run(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held, last = pickle.loads(state.get[0]) if state.exists else ([FeatureState(f.op, span(f.window), f.bins) for f in features], 0)
        rows = _in_time(groups, state, ms, seq, delay_ms)
        made = []
        for row in rows.to_dict("records"):
            values = []
            for f, s in zip(features, held):
                if not f.sees(row[event_type]):
                    values.append(None)
                    continue
                value = row[f.target]
                s.update(row[ms], None if pd.isna(value) else value)
                read = s.read(row[ms])
                values.append([{"x": x, "y": y} for x, y in read] if f.op == "HIST" else read)
            made.append((row[seq], *values))
        last = max([last, *map(int, rows[ms])])
        for s in held:
            s.evict(last if delay_ms is None else state.getCurrentWatermarkMs())
        _keep(state, (pickle.dumps((held, last)),), None if widest is None else last + widest, delay_ms)
        yield pd.DataFrame(made, columns=[seq, *(f.name for f in features)])

    return df.groupBy(*keys).applyInPandasWithState(run, out, "held binary", "append", timeout)


def stream_alarms(df: DataFrame, key: str, ms: str, seq: str, value: str, above: float, within: int, delay_ms: int | None = None) -> DataFrame:
    """Of each two successive events of a key above a value and less than `within` apart, the hotter one, as it comes."""
    kinds = dict(df.dtypes)
    df, timeout = _timed(df, ms, delay_ms)

    def run(k: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        was = state.get if state.exists else None
        made = []
        for row in _in_time(groups, state, ms, seq, delay_ms).to_dict("records"):
            if not row[value] > above:
                continue
            now = (int(row[ms]), int(row[seq]), float(row[value]))
            if was is not None and now[0] - was[0] < within:
                hotter = now if int(now[2]) > int(was[2]) else was
                made.append((k[0], now[0], hotter[1], hotter[2]))
            was = now
        if was is not None:
            _keep(state, tuple(was), was[0] + within, delay_ms)
        yield pd.DataFrame(made, columns=[key, "at_ms", seq, value])

    return df.groupBy(key).applyInPandasWithState(run, f"`{key}` {kinds[key]}, at_ms long, `{seq}` long, `{value}` double", "ms long, seq long, value double", "append", timeout)
