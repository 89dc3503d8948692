"""Windows of the feature language over tables of rows (key columns, __ms, __seq, and what a row contributes).

Two families. Exact windows hold (ms - W, ms]. Bucket windows round up to their unit: the current bucket as far as it
has come, and the whole n - 1 before it.

Neither leaves all rows of a key to one task. Exact windows are evaluated in slices of time, SLICES windows long; the
rows at the end of a slice are repeated in the next one, which needs them as its past. Sums are evaluated in panes one
window long: a window is the end of one pane, summed from its end, and the beginning of the next, summed from its
beginning. So the cost is linear however many rows a window holds, and nothing that has left it is subtracted, which a
large value would not survive. Bucket windows
aggregate each (key, bucket) first, combine the few earlier buckets in a window over those, and join them to the rows
of a bucket.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.syntax import FeatureError

#: Milliseconds of each unit: U, T, A to F are 1, 2, 5, 10, 15, 20, 25 and 30 seconds, M is 30 days.
UNITS = {"U": 1000, "T": 2000, "A": 5000, "B": 10_000, "C": 15_000, "D": 20_000, "E": 25_000, "F": 30_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "M": 2_592_000_000}
SLICES = 8


@dataclass(frozen=True)
class Span:
    n: int
    unit: int

    @property
    def ms(self) -> int:
        return self.n * self.unit


def span(text: str) -> Span:
    """7d as a Span."""
    m = re.fullmatch(r"([0-9]+)([mhdMUTABCDEF])", text)
    if not m or int(m[1]) == 0:
        raise FeatureError(f"not a window: {text!r}")
    return Span(int(m[1]), UNITS[m[2]])


def sliced(rows: DataFrame, w: Span) -> tuple[DataFrame, Column]:
    """rows with __slice, those within a window of a slice's end also in the next; and which of them are a slice's own."""
    size = SLICES * w.ms
    here = F.floor(F.col("__ms") / size)
    spread = F.when((here + 1) * size - F.col("__ms") < w.ms, F.array(here, here + 1)).otherwise(F.array(here))
    return rows.withColumn("__slice", F.explode(spread)), F.col("__slice") == here


def exact_sums(rows: DataFrame, keys: list[str], w: Span, sums: dict[str, Column]) -> DataFrame:
    """Sums over the exact window of each row. Contributions that are null add nothing; an empty sum is 0."""
    rows = rows.withColumns({f"__in_{name}": value for name, value in sums.items()})
    # Each row is in its own pane and, as its past, in the next one, at the same offset.
    spread = rows.withColumn("__pane", F.floor(F.col("__ms") / w.ms)).withColumn("__own", F.explode(F.array(F.lit(True), F.lit(False))))
    spread = spread.withColumns({"__pane": F.when(F.col("__own"), F.col("__pane")).otherwise(F.col("__pane") + 1), "__offset": F.pmod(F.col("__ms"), F.lit(w.ms))})
    pane = Window.partitionBy(*keys, "__pane")
    upto = pane.orderBy("__offset").rangeBetween(Window.unboundedPreceding, 0)
    after = pane.orderBy(F.col("__offset").desc()).rangeBetween(Window.unboundedPreceding, -1)
    own, past = F.col("__own"), ~F.col("__own")

    def total(name: str) -> Column:
        value = F.col(f"__in_{name}")
        return F.coalesce(F.sum(F.when(own, value)).over(upto), F.lit(0)) + F.coalesce(F.sum(F.when(past, value)).over(after), F.lit(0))

    return spread.withColumns({name: total(name) for name in sums}).filter("__own").drop("__pane", "__own", "__offset", *(f"__in_{name}" for name in sums))


def exact_set(rows: DataFrame, keys: list[str], w: Span, value: Column, name: str) -> DataFrame:
    """The sorted distinct values in the exact window of each row."""
    spread, own = sliced(rows, w)
    window = Window.partitionBy(*keys, "__slice").orderBy("__ms").rangeBetween(-(w.ms - 1), 0)
    return spread.withColumn("__in", value).withColumn(name, F.array_sort(F.collect_set("__in").over(window))).filter(own).drop("__slice", "__in")


def exact_distinct(rows: DataFrame, keys: list[str], w: Span, value: Column, name: str) -> DataFrame:
    """The number of distinct values in the exact window of each row, without holding any set.

    A value counts from when it is seen until it is seen again, or a window later. So each row opens an interval; running
    sums of beginnings less ends count those that are open. An interval that reaches into the next slice opens there anew.
    """
    size = SLICES * w.ms
    rows = rows.withColumn("__value", value)
    # Only what is seen again within a window matters, so a slice needs the first window of the next one.
    here = F.floor(F.col("__ms") / size)
    there = rows.filter(F.col("__value").isNotNull()).withColumn("__at", F.explode(F.when(F.col("__ms") - here * size < w.ms, F.array(here, here - 1)).otherwise(F.array(here))))
    again = Window.partitionBy(*keys, "__value", "__at").orderBy("__ms", "__seq")
    seen = there.select(*keys, "__ms", "__at", F.least(F.lead("__ms").over(again), F.col("__ms") + w.ms).alias("__end")).filter(F.col("__at") == here).drop("__at")
    first, last = F.floor(F.col("__ms") / size), F.floor((F.col("__end") - 1) / size)
    parts = seen.filter(F.col("__end") > F.col("__ms")).select(*keys, F.col("__ms").alias("__from"), "__end", F.explode(F.sequence(first, last)).alias("__slice"))
    start, end = F.greatest(F.col("__from"), F.col("__slice") * size), F.least(F.col("__end"), (F.col("__slice") + 1) * size)
    steps = parts.select(*keys, "__slice", F.explode(F.array(F.struct(start.alias("__ms"), F.lit(1).alias("step")), F.struct(end.alias("__ms"), F.lit(-1).alias("step")))).alias("s")).select(*keys, "__slice", "s.__ms", "s.step")
    steps = steps.groupBy(*keys, "__slice", "__ms").agg(F.sum("step").alias("__step"))
    asking = rows.drop("__value").withColumn("__slice", F.floor(F.col("__ms") / size)).withColumn("__step", F.lit(0).cast("long")).withColumn("__asks", F.lit(True))
    both = asking.unionByName(steps, allowMissingColumns=True)
    running = Window.partitionBy(*keys, "__slice").orderBy("__ms").rangeBetween(Window.unboundedPreceding, 0)
    return both.withColumn(name, F.sum("__step").over(running)).filter("__asks").drop("__slice", "__step", "__asks")


def bucketed(rows: DataFrame, keys: list[str], w: Span, parts: dict[str, tuple[str, Column]]) -> DataFrame:
    """Aggregates over the bucket window of each row: parts are name -> (sum, max or min; contribution); null if nothing contributes."""
    rows = rows.withColumn("__bucket", F.floor(F.col("__ms") / w.unit)).withColumns({f"__in_{name}": value for name, (_, value) in parts.items()})
    so_far = Window.partitionBy(*keys, "__bucket").orderBy("__ms", "__seq").rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({name: getattr(F, kind)(f"__in_{name}").over(so_far) for name, (kind, _) in parts.items()})
    if w.n > 1:
        held = rows.groupBy(*keys, "__bucket").agg(*(getattr(F, kind)(f"__in_{name}").alias(f"__b_{name}") for name, (kind, _) in parts.items()))
        past = Window.partitionBy(*keys).orderBy("__bucket").rangeBetween(-(w.n - 1), -1)
        held = held.select(*(F.col(k).alias(f"__k_{i}") for i, k in enumerate(keys)), F.col("__bucket").alias("__k_bucket"), *(getattr(F, kind)(f"__b_{name}").over(past).alias(f"__p_{name}") for name, (kind, _) in parts.items()))
        same = F.col("__bucket") == F.col("__k_bucket")
        for i, k in enumerate(keys):
            same &= F.col(k).eqNullSafe(F.col(f"__k_{i}"))
        out = out.join(held, same, "left")

        def both(name: str, kind: str) -> Column:
            a, b = F.col(name), F.col(f"__p_{name}")
            return F.coalesce(a + b, a, b) if kind == "sum" else F.greatest(a, b) if kind == "max" else F.least(a, b)

        out = out.withColumns({name: both(name, kind) for name, (kind, _) in parts.items()}).drop("__k_bucket", *(f"__k_{i}" for i in range(len(keys))), *(f"__p_{name}" for name in parts))
    return out.drop("__bucket", *(f"__in_{name}" for name in parts))


def last_difference(rows: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """The last contribution less the one before it, over all time: 0 while there are fewer than two.

    Two ordered passes over a key's rows that keep one value each; nothing is held.
    """
    past = Window.partitionBy(*keys).orderBy("__ms", "__seq")
    rows = rows.withColumn("__in", value)
    rows = rows.withColumn("__step", F.col("__in") - F.last("__in", ignorenulls=True).over(past.rowsBetween(Window.unboundedPreceding, -1)))
    latest = F.last("__step", ignorenulls=True).over(past.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn(name, F.coalesce(latest, F.lit(0.0))).drop("__in", "__step")
