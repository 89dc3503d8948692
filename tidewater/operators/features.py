"""Applications: fields, macros and features of the feature language, compiled to one DataFrame plan.

A temporal feature sees the events of its type; every one is also keyed by the application's default keys. A feature
that is updated and read gives its value, the current event included, on events of its type and null on others; one
that is only read gives its value on every event. Where a key is fixed by `field=value`, or is a member of a set, the
rows that ask are not those that contribute: both go through the same window together, so no range join is needed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import windows
from ..functions.histogram import histogram_window, quantile_column
from ..functions.hops import hop_window
from ..functions.scalar import SCALARS, number, scalar
from ..plans.planner import GET, UPGET, Feature, declare, fused, layers
from ..plans.syntax import Call, FeatureError, Field, Macros, parse_macro

ALL = "___ALL___"
SETS = ("SET", "FLAT_SET")
FLAT = ("FLAT_COUNT", "FLAT_COUNT_DISTINCT", "FLAT_SET", "FLAT_SUM")
#: Parts of a window that a slice of time is, where sets ask.
FLAT_PARTS = 2
#: The same where a key is fixed: more events ask, and few contribute.
FIXED_PARTS = 8
TEMPORAL = ("COUNT", "SUM", "AVG", "MAX", "MIN", "VARIANCE", "DIFF", "COUNT_DISTINCT", "SET", "HIST")


@dataclass
class FeatureApp:
    """An application's configuration. seq orders and names events: it is unique."""

    name: str
    on_default: list[str] = field(default_factory=lambda: ["application"])
    space: str | None = None
    seq: str = "event_id"
    ms: str = "c_timestamp"
    event_type: str = "event_type"
    payload: str | None = None
    fields: dict[str, dict[str, list[str]]] = field(default_factory=dict)
    macros: Macros = field(default_factory=Macros)
    features: list[Feature] = field(default_factory=list)
    active: FeatureApp | None = None
    source: DataFrame | None = None
    sink: object = None

    def add_field(self, event_type: str, name: str, *paths: str) -> FeatureApp:
        """A field of events of a type (or ___ALL___): the first of the paths that isn't null."""
        self.fields.setdefault(event_type, {})[name] = list(paths)
        return self

    def add_macro(self, head: str, body: str) -> FeatureApp:
        self.macros.add(parse_macro(head, body))
        return self

    def add_feature(self, text: str, event_type: str = ALL, mode: str = UPGET) -> FeatureApp:
        self.features = fused([*self.features, declare(text, self.macros, mode, event_type)])
        return self

    def list(self) -> list[str]:
        return [f.name for f in self.features]

    def activate(self) -> FeatureApp:
        """A copy that later changes don't reach."""
        self.active = replace(self, fields={k: dict(v) for k, v in self.fields.items()}, features=list(self.features), macros=Macros(dict(self.macros.known)), active=None)
        return self.active

    def set_source(self, events: DataFrame) -> FeatureApp:
        """The stream that start() reads."""
        self.source = events
        return self

    def set_sink(self, sink) -> FeatureApp:
        """sink(rows, batch) gets the answers of each batch of the stream."""
        self.sink = sink
        return self

    def start(self, folder: str, checkpoint: str, delay_ms: int = 0, drain: bool = False):
        """Runs the features on the source until it is stopped, or drained; what it holds is kept in the folder."""
        from ..streaming.whole import WholeStream

        if self.source is None or self.sink is None:
            raise FeatureError("set a source and a sink first")
        return WholeStream(self, folder, delay_ms, self.sink).start(self.source, checkpoint, drain)

    def bind(self, events: DataFrame) -> DataFrame:
        """events with the declared fields: from a JSON payload, or from columns of the same name."""
        out = events
        for name in dict.fromkeys(n for by in self.fields.values() for n in by):
            value = F.lit(None).cast("string")
            for event_type, by in self.fields.items():
                if name not in by:
                    continue
                found = F.coalesce(*(F.get_json_object(self.payload, p) if p.startswith("$") and self.payload else F.col(p) for p in by[name]))
                value = F.coalesce(value, found if event_type == ALL else F.when(self.matches(event_type), found))
            out = out.withColumn(name, value)
        return out

    def matches(self, event_type: str) -> Column:
        if event_type == ALL:
            return F.lit(True)
        return F.coalesce(F.lower(F.col(self.event_type)) == event_type.lower(), F.lit(False))

    def compute(self, events: DataFrame, names: dict[str, str] | None = None) -> DataFrame:
        """events with a column for each feature that is read, named by its text or as names says."""
        app = self.active or self
        run = _Compiler(app)
        df = app.bind(events).withColumns({"__ms": F.col(app.ms).cast("long"), "__seq": F.struct(F.col(app.seq).alias("seq"), F.lit(0).alias("asks"))})
        if app.space:
            df = df.withColumn("__space", F.col(app.space))
        for layer in layers(app.features):
            for call, mode in layer:
                df = run.add(df, call, mode)
        out = {(names or {}).get(f.name, f.name): F.when(app.matches(f.event_type), F.col(run.column(f.call, f.mode))) if f.event_type != ALL else F.col(run.column(f.call, f.mode)) for f in app.features if f.mode != "update"}
        return df.withColumns(out).drop("__ms", "__seq", "__space", *run.columns.values())


@dataclass
class _Compiler:
    app: FeatureApp
    columns: dict[tuple[Call, str], str] = field(default_factory=dict)

    def column(self, call: Call, mode: str) -> str:
        return self.columns[call, mode]

    def value(self, arg: Call | Field, mode: str) -> Column:
        return F.col(self.column(arg, mode)) if isinstance(arg, Call) else F.col(f"`{arg.name}`")

    def add(self, df: DataFrame, call: Call, mode: str) -> DataFrame:
        name = self.columns[call, mode] = f"__f{len(self.columns)}"
        if call.op in SCALARS:
            literal = [F.lit(a.value) if isinstance(a, Field) and a.value is not None else self.value(a, mode) for a in call.args]
            return df.withColumn(name, scalar(call.op, literal))
        if call.op == "F_GET":
            if len(call.args) != 1:
                raise FeatureError("F_GET takes one argument")
            return df.withColumn(name, self.value(call.args[0], mode))
        if call.op == "F_QUANTILE":
            return df.withColumn(name, self.quantile(call, mode))
        if call.op in FLAT:
            return self.flat(df, call, mode, name)
        if call.op in TEMPORAL:
            return self.temporal(df, call, mode, name)
        raise FeatureError(f"no such function: {call.op}")

    def quantile(self, call: Call, mode: str) -> Column:
        bins, precision = (*call.args, None, None)[:2]
        if len(call.args) != 2 or not isinstance(bins, Call) or bins.op != "HIST" or not isinstance(precision, Field) or not (precision.value or "").isdigit() or int(precision.value) == 0:
            raise FeatureError(f"F_QUANTILE takes a HIST and name=precision above 0: {call}")
        return quantile_column(self.value(bins, mode), int(precision.value))

    def keys(self, ons: list[Call | Field], mode: str) -> tuple[list[Column], list[Column]]:
        """Keys of the rows that contribute and of those that ask, with the default keys; in order of their names."""
        names = [str(a.name if isinstance(a, Field) else a) for a in ons]
        if len(set(names)) != len(names) or set(names) & set(self.app.on_default):
            raise FeatureError(f"a key is given twice, or is a default key: {names}")
        pairs = sorted(zip(names, ons), key=lambda p: p[0]) + [(k, Field(k)) for k in [*self.app.on_default, *(["__space"] if self.app.space else [])]]
        base = [self.value(a, mode).cast("string") for _, a in pairs]
        asks = [F.lit(a.value) if isinstance(a, Field) and a.value is not None else b for (_, a), b in zip(pairs, base)]
        return base, asks

    def start(self, call: Call, least: int) -> tuple[windows.Span, Column, list[Call | Field]]:
        if len(call.args) < least or not all(isinstance(a, Field) for a in call.args[:2]):
            raise FeatureError(f"{call.op} takes a window, an event type and at least {least - 2} more: {call}")
        return windows.span(call.args[0].name), self.app.matches(call.args[1].name), list(call.args[2:])

    def guard(self, match: Column, mode: str, name: str) -> Column:
        return F.when(match, F.col(name)) if mode == UPGET else F.col(name)

    def temporal(self, df: DataFrame, call: Call, mode: str, name: str) -> DataFrame:
        w, match, rest = self.start(call, 3)
        target, ons = rest[0], rest[1:]
        capacity = 0
        if call.op == "HIST":
            if not ons or not isinstance(ons[0], Field) or not (ons[0].value or "").isdigit() or int(ons[0].value) == 0:
                raise FeatureError(f"the first key of HIST is name=bins: {call}")
            capacity, ons = int(ons[0].value), ons[1:]
        value = self.value(target, mode)
        base, asks = self.keys([*([target] if call.op == "COUNT" else []), *ons], mode)
        plain = all(a is b for a, b in zip(base, asks))
        if call.op == "SUM" and not plain:
            return self.fixed_sum(df, match, value, base, asks, w, mode, name)
        keys = [f"__k{i}" for i in range(len(base))]
        given = F.when(match, value)
        df = df.withColumn("__match", match)
        if plain:
            rows = df.withColumns({**dict(zip(keys, base)), "__v": given})
            out = _aggregate(rows, call.op, keys, w, name, capacity)
            null_count = value.isNull() if call.op == "COUNT" else None
        else:
            adds = df.filter("__match").select("__ms", "__seq", *(b.alias(k) for k, b in zip(keys, base)), value.alias("__v"))
            asking = df.withColumns({**dict(zip(keys, asks)), "__seq": F.struct(F.col("__seq.seq").alias("seq"), F.lit(1).alias("asks")), "__asking": F.lit(True)})
            out = _aggregate(asking.unionByName(adds, allowMissingColumns=True), call.op, keys, w, name, capacity).filter("__asking").drop("__asking")
            out = out.withColumn("__seq", F.struct(F.col("__seq.seq").alias("seq"), F.lit(0).alias("asks")))
            null_count = value.isNull() if call.op == "COUNT" and target.value is None else None
        if null_count is not None:
            out = out.withColumn(name, F.when(null_count, 0.0).otherwise(F.col(name)))
        return out.withColumn(name, self.guard(F.col("__match"), mode, name)).drop("__match", "__v", *keys)

    def fixed_sum(self, df: DataFrame, match: Column, value: Column, base: list[Column], asks: list[Column], w: windows.Span, mode: str, name: str) -> DataFrame:
        """All events ask for one key, so they go to slices of time and not to the key; only what has the key contributes."""
        keys = [F.col(f"__k{i}") for i in range(len(base))]
        adds = df.filter(match).select("__ms", F.lit("").alias("__member"), number(value).alias("__v"), *(b.alias(f"__k{i}") for i, b in enumerate(base)))
        for k, a, b in zip(keys, asks, base):
            adds = adds if a is b else adds.filter(k == a)
        out = hop_window(df, adds.filter("__v IS NOT NULL"), (asks, keys), w, "SUM", name, None, FIXED_PARTS)
        return out.withColumn(name, self.guard(match, mode, name))

    def flat(self, df: DataFrame, call: Call, mode: str, name: str) -> DataFrame:
        """An event asks for the members of its set, in place of the field that the set is of."""
        counted = call.op == "FLAT_COUNT"
        w, match, rest = self.start(call, 3 if counted else 4)
        target = None if counted else rest.pop(0)
        members, ons = rest[0], rest[1:]
        if not isinstance(members, Call) or members.op not in SETS:
            raise FeatureError(f"{call.op} takes a SET or FLAT_SET: {call}")
        of = members.args[2]
        base, asks = self.keys(ons, mode)
        value = F.lit(1) if counted else number(self.value(target, mode)) if call.op == "FLAT_SUM" else self.value(target, mode).cast("string")
        adds = df.filter(match).select("__ms", self.value(of, mode).cast("string").alias("__member"), value.alias("__v"), *(b.alias(f"__k{i}") for i, b in enumerate(base))).dropna(subset=["__member", "__v"])
        inner = call.op.removeprefix("FLAT_")
        out = hop_window(df, adds, (asks, [F.col(f"__k{i}") for i in range(len(base))]), w, inner, name, self.column(members, mode), FLAT_PARTS)
        return out.withColumn(name, self.guard(match, mode, name))


def _aggregate(rows: DataFrame, op: str, keys: list[str], w: windows.Span, name: str, capacity: int) -> DataFrame:
    """rows with op over __v in the window of each row."""
    v = F.col("__v")
    if op == "COUNT":
        out = windows.bucketed(rows, keys, w, {name: ("sum", F.when(v.isNotNull(), 1))})
        return out.withColumn(name, F.coalesce(F.col(name).cast("double"), F.lit(0.0)))
    if op == "SUM":
        out = windows.exact_sums(rows, keys, w, {name: number(v), "__n": F.when(number(v).isNotNull(), 1)})
        return out.withColumn(name, F.when(F.col("__n") > 0, F.col(name)).otherwise(0.0)).drop("__n")
    if op in ("MAX", "MIN"):
        out = windows.bucketed(rows, keys, w, {name: (op.lower(), number(v))})
        return out.withColumn(name, F.coalesce(name, F.lit(0.0)))
    if op in ("AVG", "VARIANCE"):
        x = number(v)
        out = windows.bucketed(rows, keys, w, {"__n": ("sum", F.when(x.isNotNull(), 1)), "__s": ("sum", x), "__q": ("sum", x * x)})
        mean = F.col("__s") / F.col("__n")
        value = mean if op == "AVG" else F.col("__q") / F.col("__n") - mean * mean
        return out.withColumn(name, F.when(F.col("__n") > 0, value).otherwise(math.nan)).drop("__n", "__s", "__q")
    if op == "COUNT_DISTINCT":
        return windows.exact_distinct(rows, keys, w, v.cast("string"), name)
    if op == "SET":
        return windows.exact_set(rows, keys, w, v.cast("string"), name)
    if op == "DIFF":
        return windows.last_difference(rows, keys, number(v), name)
    return histogram_window(rows, keys, w, number(v), capacity, name)


__all__ = ["ALL", "GET", "FeatureApp"]
