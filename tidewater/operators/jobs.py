"""Operators beside the feature language: keyed histories and rules, routing, control sets, patterns, windows, layers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.windows import Span, sliced
from ..plans.history import parse_history
from ..plans.syntax import FeatureError

# Keyed histories and rules


def with_history(df: DataFrame, key: str, ms: str, order: list[str], fields: list[str], n: int = 100, name: str = "history") -> DataFrame:
    """df with the last n events of its key, this one included, as an array of structs (ms, fields)."""
    past = Window.partitionBy(key).orderBy(*order).rowsBetween(-(n - 1), 0)
    return df.withColumn(name, F.collect_list(F.struct(F.col(ms).alias("ms"), *fields)).over(past))


def recent(history: Column, w: int) -> Column:
    """What a history holds of the w milliseconds before its last event."""
    # Histories are in the order of time, so the last event is the latest.
    return F.filter(history, lambda h: h["ms"] > F.element_at(history, -1)["ms"] - w)


def recent_sum(history: Column, field: str, w: int) -> Column:
    return F.aggregate(recent(history, w), F.lit(0.0), lambda total, h: total + F.coalesce(h[field], F.lit(0.0)))


def recent_count(history: Column, w: int) -> Column:
    return F.size(recent(history, w)).cast("long")


def recent_distinct(history: Column, field: str, w: int) -> Column:
    return F.size(F.array_distinct(F.filter(F.transform(recent(history, w), lambda h: h[field]), lambda x: x.isNotNull()))).cast("long")


def history_value(history: Column, text: str, key: str) -> Column:
    """The value of a feature text such as sum(amount#user_id.history,1d), over a history by `key`."""
    feature = parse_history(text)
    if feature.on != key:
        raise FeatureError(f"the history is by {key}: {text!r}")
    if feature.op == "count":
        return recent_count(history, feature.window)
    make = recent_sum if feature.op == "sum" else recent_distinct
    return make(history, feature.target, feature.window)


def fork_join(events: DataFrame, event_id: str, ms: str, results: dict[str, DataFrame], timeout_ms: int) -> DataFrame:
    """events with the result of each branch: (event_id, at_ms, value), the first that is there within the timeout, else null.

    On streams, give events and results watermarks on the same clock: the joins are then outer joins in a range of time.
    """
    out = events
    for name, branch in results.items():
        own = branch.select(F.col(event_id).alias("__of"), F.struct("at_ms", "value").alias("__r"))
        first = own.join(events.select(F.col(event_id).alias("__id"), F.col(ms).alias("__ms")), F.col("__of") == F.col("__id"))
        first = first.filter(F.col("__r")["at_ms"].between(F.col("__ms"), F.col("__ms") + timeout_ms)).groupBy("__of").agg(F.min("__r")["value"].alias(name))
        out = out.join(first, F.col(event_id) == F.col("__of"), "left").drop("__of")
    return out


def fan_out(df: DataFrame, event_id: str, keys: dict[str, Column]) -> DataFrame:
    """A base row for each event and one for each of its keys that isn't null: key_name, key_value, event_id."""
    rows = [F.struct(F.lit("base").alias("key_name"), F.col(event_id).cast("string").alias("key_value"))]
    rows += [F.when(value.isNotNull(), F.struct(F.lit(name).alias("key_name"), value.cast("string").alias("key_value"))) for name, value in keys.items()]
    return df.select(F.col(event_id).alias("event_id"), F.explode(F.filter(F.array(*rows), lambda r: r.isNotNull())).alias("k")).select("event_id", "k.*")


def anomalous(count: Column, total: Column, distinct: Column, least_count: int = 5, least_total: float = 5000, most_distinct: int = 2) -> Column:
    return (count > least_count) & (total > least_total) & (distinct <= most_distinct)


# Routing


def switched(kind: Column, known: list[str], otherwise: str = "other") -> Column:
    """The topic of an event: its kind, if it is known."""
    return F.when(kind.isin(known), kind).otherwise(otherwise)


def routed(df: DataFrame, kind: str, routes: dict[str, list[str]]) -> DataFrame:
    """One row for each topic of an event's kind, numbered; events of an unknown, empty or null kind go."""
    table = F.create_map(*(x for name, topics in routes.items() for x in (F.lit(name), F.array(*map(F.lit, topics)))))
    return df.select("*", F.posexplode(F.element_at(table, F.col(kind))).alias("place", "topic"))


def checked(data: DataFrame, control: DataFrame, on: str, name: str = "message") -> DataFrame:
    """data with "invalid ..." where the control set has the value and "valid ..." where it hasn't. Spark broadcasts the set if it is small."""
    bad = control.select(F.col(on).alias("__bad")).filter(F.col("__bad").isNotNull()).distinct()
    joined = data.join(bad, data[on] == bad["__bad"], "left")
    return joined.withColumn(name, F.concat(F.when(F.col("__bad").isNotNull(), "invalid").otherwise("valid"), F.lit(" color ("), F.col(on), F.lit(")"))).drop("__bad")


# Patterns


def alarms(df: DataFrame, key: list[str], ms: str, order: list[str], value: str, above: float, within: int) -> DataFrame:
    """Of each two successive events above a value, less than `within` apart, the hotter one: by its whole part, then the earlier.

    In slices of time, with the end of each repeated in the next: neither a hot key nor the lack of a key makes one task.
    """
    event = F.struct(*df.columns)
    hot, own = sliced(df.filter(F.col(value) > above).withColumns({"__ms": F.col(ms), "__now": event}), Span(within, 1))
    by = Window.partitionBy(*key, "__slice").orderBy(ms, *order)
    pairs = hot.select("__now", F.lag("__now").over(by).alias("__was"), "__ms", F.lag("__ms").over(by).alias("__before"), own.alias("__own")).filter("__own").filter(F.col("__ms") - F.col("__before") < within)
    hotter = F.when(F.floor(F.col("__now")[value]) > F.floor(F.col("__was")[value]), F.col("__now")).otherwise(F.col("__was"))
    return pairs.select(F.col("__now")[ms].alias("at_ms"), hotter.alias("e")).select("at_ms", "e.*")


def escalations(found: DataFrame, key: list[str], value: str, within: int) -> DataFrame:
    """Of each two successive alarms less than `within` apart, the second, if it is hotter by its whole part."""
    spread, own = sliced(found.withColumn("__ms", F.col("at_ms")), Span(within, 1))
    by = Window.partitionBy(*key, "__slice").orderBy("at_ms")
    both = spread.withColumns({"__at": F.lag("at_ms").over(by), "__was": F.lag(value).over(by), "__own": own}).filter("__own")
    return both.filter((F.col("at_ms") - F.col("__at") < within) & (F.floor(F.col(value)) > F.floor(F.col("__was")))).drop("__at", "__was", "__own", "__ms", "__slice")


# Windows


def windowed(df: DataFrame, ts: str, length: str, slide: str | None, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates by tumbling or sliding window and keys: start_ms, end_ms, keys, aggregates."""
    w = F.window(F.col(ts), length, slide) if slide else F.window(F.col(ts), length)
    out = df.groupBy(w.alias("__w"), *keys).agg(*aggs)
    return out.select(F.unix_millis("__w.start").alias("start_ms"), F.unix_millis("__w.end").alias("end_ms"), *(c for c in out.columns if c != "__w"))


def sessions(df: DataFrame, ts: str, gap: str, keys: list[str], *aggs: Column) -> DataFrame:
    """Aggregates by session: events of a key that are at most the gap apart."""
    out = df.groupBy(F.session_window(F.col(ts), gap).alias("__w"), *keys).agg(*aggs)
    return out.select(F.unix_millis("__w.start").alias("start_ms"), F.unix_millis("__w.end").alias("end_ms"), *(c for c in out.columns if c != "__w"))


def window_join(left: DataFrame, right: DataFrame, key: str, ts: str, length: str) -> DataFrame:
    """Pairs of a key within one tumbling window; of columns that both have, the right one's value stays."""
    w = F.window(F.col(ts), length)
    a = left.select(F.col(key).alias("__k"), w.alias("__w"), F.struct(*left.columns).alias("__a"))
    b = right.select(F.col(key).alias("__k"), w.alias("__w"), F.struct(*right.columns).alias("__b"))
    both = a.join(b, ["__k", "__w"])
    return both.select(F.unix_millis("__w.start").alias("start_ms"), *(F.col("__a")[c].alias(c) for c in left.columns if c not in right.columns), *(F.col("__b")[c].alias(c) for c in right.columns))


def words(df: DataFrame, text: str, by: str = r"\s") -> DataFrame:
    """The non-empty words of each text, in a column word beside the others."""
    return df.select(*(c for c in df.columns if c != text), F.explode(F.split(text, by)).alias("word")).filter("word != ''")


# Layers


def layer(df: DataFrame, ts: str, product: str, layer_name: str, slide_ms: int, slides: int = 1) -> DataFrame:
    """Counts by window of `slides` slides and product, as rows of the serving table: id, start, end, product, v_count, layer."""
    length, slide = f"{slide_ms * slides} milliseconds", f"{slide_ms} milliseconds"
    panes = windowed(df, ts, length, slide if slides > 1 else None, [product], F.count("*").alias("v_count"))
    start, end = (F.floor(F.col(c) / slide_ms) for c in ("start_ms", "end_ms"))
    out = panes.select(start.alias("start"), end.alias("end"), F.col(product).alias("product"), "v_count", F.lit(layer_name).alias("layer"))
    return out.select(F.md5(F.concat_ws("&", "start", "end", "product", "layer")).alias("id"), *out.columns)


def serve(counts: DataFrame, t: int, slide_ms: int, slides: int, fast_ms: int) -> DataFrame:
    """The counts of each product up to t: the last whole batch window and the fast panes since then."""
    last = t // slide_ms
    batch = counts.filter((F.col("layer") == "batch") & (F.col("start") == last - slides) & (F.col("end") == last))
    fast = counts.filter((F.col("layer") == "fast") & (F.col("start") >= last * slide_ms // fast_ms) & (F.col("end") <= t // fast_ms))
    return batch.union(fast).distinct().groupBy("product").agg(F.sum("v_count").alias("v_count"))


# Online regression


def online_regression(df: DataFrame, key: str, order: str, value: str, lags: int = 10) -> DataFrame:
    """Each value predicted from the `lags` before it by least squares over what was seen so far; 0 until there is enough to learn from.

    Each series is one group, read once in order; the state is the normal equations and the last values.
    """

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order, kind="stable")
        y = group[value].to_numpy(float)
        a, b, out = np.zeros((lags + 1, lags + 1)), np.zeros(lags + 1), np.zeros(len(y))
        for i in range(lags, len(y)):
            x = np.concatenate([[1.0], y[i - lags : i]])
            if i > 2 * lags + 1:
                out[i] = x @ np.linalg.lstsq(a, b, rcond=None)[0]
            a += np.outer(x, x)
            b += x * y[i]
        return pd.DataFrame({key: group[key], order: group[order], "value": y, "predicted": out})

    kinds = dict(df.dtypes)
    return df.select(key, order, value).groupBy(key).applyInPandas(run, f"`{key}` {kinds[key]}, `{order}` {kinds[order]}, value double, predicted double")


