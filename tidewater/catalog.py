"""The registered queries of the engine and the SQL that gives the same rows.

The demonstration data are mapped so: application is a literal, an account is user_id, a device is props.k, an amount is
value, and the sequence is event_id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import jobs
from .operators.features import ALL, FeatureApp
from .plans.planner import GET, UPGET
from .sources import sinks
from .sources.connectors import generated, with_header, without_header
from .sources.tables import decoded, events, millis, renamed_keys, table

FLAGSHIP = "feature_script"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Events as the SQL sees them.
E = "e AS (SELECT event_id, ts, epoch_us(ts) // 1000 AS ms, user_id, event_type, value, json_extract_string(props, '$.k') AS k FROM events)"
H, D = 3_600_000, 86_400_000


def register(name: str, sql: str | None = None):
    def put(query: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = query
        if sql:
            ORACLE_SQL[name] = sql
        return query

    return put


def app(*macros: tuple[str, str]) -> FeatureApp:
    made = FeatureApp("app001")
    for head, body in macros:
        made.add_macro(head, body)
    return made


def feature(name: str, text: str, sql: str, mode: str = UPGET, out: Callable = lambda c: c, macros: tuple = ()) -> None:
    """Registers one feature over all events: event_id and its value."""

    @register(name, sql)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = app(*macros).add_feature(text, mode=mode)
        done = made.compute(events(spark, sf_dir), {made.list()[0]: "feature"})
        return done.select("event_id", out(F.col("feature")).alias("feature"))


def rounded(c):
    return F.round(c, 4)


def off_ties(c):
    """Rounded a little off the decimal ties that means of a few values make, where engines differ in the last bit."""
    return F.round(c + 1e-7, 4)


def joined(c):
    return F.array_join(c, ",")


def bucket(agg: str, n: int, unit: int, key: str, when: str = "") -> str:
    """An aggregate over the bucket window of each event."""
    return f"WITH {E} SELECT event_id, {agg.replace('OVERW', f'OVER (PARTITION BY {key} ORDER BY ms RANGE BETWEEN (ms - (ms // {unit} - {n} + 1) * {unit}) PRECEDING AND CURRENT ROW)')} AS feature FROM e{when}"


def exact(agg: str, w: int, key: str) -> str:
    return f"WITH {E} SELECT event_id, {agg.replace('OVERW', f'OVER (PARTITION BY {key} ORDER BY ms RANGE BETWEEN {w - 1} PRECEDING AND CURRENT ROW)')} AS feature FROM e"


# Temporal aggregates

feature("feat_count", f"COUNT(1d, {ALL}, user_id)", bucket("CAST(count(*) OVERW AS DOUBLE)", 1, D, "user_id"))
feature("feat_count_buckets", f"COUNT(7d, {ALL}, user_id, device_id)", bucket("CAST(count(*) OVERW AS DOUBLE)", 7, D, "user_id, k"))
feature("feat_sum", "SUM(1h, purchase, amount, user_id)", exact("CASE WHEN event_type = 'purchase' THEN round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END) OVERW, 0), 4) END", H, "user_id"), out=rounded)
feature("feat_avg", f"AVG(3h, {ALL}, amount, user_id)", bucket("round(avg(value) OVERW + 1e-7, 4)", 3, H, "user_id"), out=off_ties)
feature("feat_max", f"MAX(7d, {ALL}, amount, user_id)", bucket("max(value) OVERW", 7, D, "user_id"))
feature("feat_min", f"MIN(2d, {ALL}, amount, device_id)", bucket("min(value) OVERW", 2, D, "k"))
feature("feat_variance", f"VARIANCE(1d, {ALL}, amount, user_id)", bucket("round(var_pop(value) OVERW + 1e-7, 4)", 1, D, "user_id"), out=off_ties)
feature("feat_diff", f"DIFF(1d, {ALL}, amount, user_id)", f"WITH {E} SELECT event_id, round(coalesce(value - lag(value) OVER (PARTITION BY user_id ORDER BY ms, event_id), 0), 4) AS feature FROM e", out=rounded)
feature("feat_count_distinct", f"COUNT_DISTINCT(7d, {ALL}, device_id, user_id)", exact("count(DISTINCT k) OVERW", 7 * D, "user_id"))
feature("feat_set", f"SET(12h, {ALL}, device_id, user_id)", exact("array_to_string(list_sort(list(DISTINCT k) OVERW), ',')", 12 * H, "user_id"), out=joined)


@register("feat_hist")
def feat_hist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Histograms of 16 bins over two days; SQL has no such histogram, so tests hold it against an interpreter."""
    made = app().add_feature(f"HIST(2d, {ALL}, amount, bins=16, user_id)")
    return made.compute(events(spark, sf_dir), {made.list()[0]: "feature"}).select("event_id", "feature")


@register("hist_totals", bucket("count(*) OVERW AS n, round(avg(value) OVERW + 1e-7, 4)", 2, D, "user_id").replace(" AS feature", " AS mean"))
def hist_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What merging keeps of a histogram whatever its bins: how many values it has, and their mean."""
    made = app().add_feature(f"HIST(2d, {ALL}, amount, bins=4, user_id)")
    done = made.compute(events(spark, sf_dir), {made.list()[0]: "h"})
    n = F.aggregate("h", F.lit(0.0), lambda total, b: total + b["y"])
    return done.select("event_id", n.cast("long").alias("n"), off_ties(F.aggregate("h", F.lit(0.0), lambda total, b: total + b["x"] * b["y"]) / n).alias("mean"))


# Two-hop aggregates: over the devices that the user had in the last six hours

MEMBERS = f"{E}, m AS (SELECT DISTINCT a.event_id, a.ms, b.k FROM e a JOIN e b ON a.user_id = b.user_id AND b.ms <= a.ms AND b.ms > a.ms - {6 * H})"
SET6 = f"SET(6h, {ALL}, device_id, user_id)"


def hop(agg: str, low: str) -> str:
    return f"WITH {MEMBERS} SELECT m.event_id, {agg} AS feature FROM m JOIN e c ON c.k = m.k AND c.ms <= m.ms AND c.ms {low} GROUP BY m.event_id"


feature("feat_flat_count", f"FLAT_COUNT(1d, {ALL}, {SET6})", hop("CAST(count(*) AS DOUBLE)", f">= m.ms // {D} * {D}"))
feature("feat_flat_sum", f"FLAT_SUM(1h, {ALL}, amount, {SET6})", hop("round(sum(c.value), 4)", f"> m.ms - {H}"), out=rounded)
feature("feat_flat_count_distinct", f"FLAT_COUNT_DISTINCT(6h, {ALL}, user_id, {SET6})", hop("count(DISTINCT c.user_id)", f"> m.ms - {6 * H}"))
feature("feat_flat_set", f"FLAT_SET(1h, {ALL}, user_id, {SET6})", hop("array_to_string(list_sort(list(DISTINCT CAST(c.user_id AS VARCHAR))), ',')", f"> m.ms - {H}"), out=joined)

# Scalars: what isn't a number counts as 0

for _name, _text, _sql in (
    ("fn_sum", "F_SUM(amount, user_id, device_id)", "value + user_id + CAST(k AS DOUBLE)"),
    ("fn_add", "F_ADD(amount, event_type)", "value + 0.0"),
    ("fn_minus", "F_MINUS(amount, n=50)", "value - 50"),
    ("fn_multiply", "F_MULTIPLY(amount, device_id)", "value * CAST(k AS DOUBLE)"),
    ("fn_divide", "F_DIVIDE(amount, F_MINUS(device_id, n=3))", "CASE WHEN CAST(k AS DOUBLE) = 3 THEN 'NaN'::DOUBLE ELSE value / (CAST(k AS DOUBLE) - 3) END"),
    ("fn_pow", "F_POW(device_id, n=2)", "pow(CAST(k AS DOUBLE), 2)"),
    ("fn_sqrt", "F_SQRT(F_MINUS(amount, n=20))", "CASE WHEN value < 20 THEN 'NaN'::DOUBLE ELSE sqrt(value - 20) END"),
    ("fn_exp", "F_EXP(F_DIVIDE(amount, n=100))", "exp(value / 100)"),
    ("fn_log", "F_LOG(F_MINUS(device_id, n=2))", "CASE WHEN CAST(k AS DOUBLE) > 2 THEN ln(CAST(k AS DOUBLE) - 2) WHEN CAST(k AS DOUBLE) = 2 THEN '-Infinity'::DOUBLE ELSE 'NaN'::DOUBLE END"),
    ("fn_abs", "F_ABS(F_MINUS(amount, n=50))", "abs(value - 50)"),
):
    feature(_name, _text, f"WITH {E} SELECT event_id, round({_sql} + 1e-7, 4) AS feature FROM e", out=off_ties)
feature("fn_get", "F_GET(device_id)", f"WITH {E} SELECT event_id, k AS feature FROM e")


@register("fn_quantile")
def fn_quantile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of a day's histogram; as for feat_hist, tests have the interpreter."""
    made = app().add_feature(f"F_QUANTILE(HIST(1d, {ALL}, amount, bins=32, user_id), precision=100)")
    return made.compute(events(spark, sf_dir), {made.list()[0]: "feature"}).select("event_id", *(F.round(f"feature.{c}", 6).alias(f"q_{c}") for c in ("min", "q1", "q2", "q3", "max", "mode")))


@register("quantile_range", f"WITH {E} SELECT event_id, min(value) OVER w AS low, max(value) OVER w AS high FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN (ms - ms // {D} * {D}) PRECEDING AND CURRENT ROW)")
def quantile_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The extremes by quantiles of a histogram that has a bin for every value."""
    made = app().add_feature(f"F_QUANTILE(HIST(1d, {ALL}, amount, bins=1000000, user_id), precision=10)")
    return made.compute(events(spark, sf_dir), {made.list()[0]: "q"}).select("event_id", F.col("q.min").alias("low"), F.col("q.max").alias("high"))


# Meta-operators

feature("feat_nested", f"F_DIVIDE(SUM(1h, {ALL}, amount, user_id), COUNT(1h, {ALL}, user_id))",
        f"WITH {E} SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {H - 1} PRECEDING AND CURRENT ROW) / count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN (ms - ms // {H} * {H}) PRECEDING AND CURRENT ROW) + 1e-7, 4) AS feature FROM e", out=off_ties)
feature("feat_macro", "M_DEVICES(device_id, user_id)", exact("count(DISTINCT k) OVERW", D, "user_id"), macros=(("M_DEVICES(device, user)", f"COUNT_DISTINCT(1d, {ALL}, device, user)"),))
feature("feat_condition", f"SUM(1d, {ALL}, amount, user_id=7)", f"WITH {E} SELECT event_id, round(coalesce((SELECT sum(b.value) FROM e b WHERE b.user_id = 7 AND b.ms <= a.ms AND b.ms > a.ms - {D}), 0), 4) AS feature FROM e a", out=rounded)
feature("feat_modes", "SUM(1d, purchase, amount, user_id)", exact("round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END) OVERW, 0), 4)", D, "user_id"), mode=GET, out=rounded)


@register(
    "feature_script",
    f"""WITH {E} SELECT event_id,
    CASE WHEN event_type = 'purchase' THEN CAST(sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, ms // {D} ORDER BY ms, event_id) AS DOUBLE) END AS n_day,
    CASE WHEN event_type = 'purchase' THEN count(DISTINCT CASE WHEN event_type = 'purchase' THEN k END) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {D - 1} PRECEDING AND CURRENT ROW) END AS devices_day,
    CASE WHEN event_type = 'purchase' THEN round(coalesce(sum(CASE WHEN event_type = 'purchase' THEN value END) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {H - 1} PRECEDING AND CURRENT ROW), 0), 4) END AS sum_hour FROM e""",
)
def feature_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three features of an application, one by way of a macro."""
    made = app(("M_DEVICE_ON_USER_ONE_DAY(device, user)", "COUNT_DISTINCT(1d, purchase, device, user)"))
    names = {"COUNT(1d,purchase,user_id)": "n_day", "M_DEVICE_ON_USER_ONE_DAY(device_id,user_id)": "devices_day", "SUM(1h,purchase,amount,user_id)": "sum_hour"}
    for text in names:
        made.add_feature(text, "purchase")
    return made.compute(events(spark, sf_dir), names).select("event_id", "n_day", "devices_day", F.round("sum_hour", 4).alias("sum_hour"))


# Sources, projections, routing


@register("json_decode", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, false AS broken FROM events")
def json_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decoded(table(spark, sf_dir, "events"), "props", "k bigint")
    return done.select("event_id", "event.k", F.col("event_error").isNotNull().alias("broken"))


@register("json_path", "SELECT event_id, json_extract_string(props, '$.k') AS k, 'none' AS missing FROM events")
def json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("missing"))


@register("json_rename", "SELECT event_id, replace(props, '\"k\"', '\"device\"') AS props FROM events")
def json_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", renamed_keys(F.col("props"), "k", "device").alias("props"))


def drawn(salt: str, size: int) -> str:
    """SQL: the number that a generator draws for an id."""
    return f"(CAST(('0x' || substr(md5(id || '/1/{salt}'), 1, 8)) AS BIGINT) % {size})"


GENERATED = "FROM (SELECT range AS id FROM range(1000))"


@register("gen_temperature", f"SELECT id, 1500000000000 + id * 1000 AS timestamp, {drawn('temperature', 200_000)} / 1000.0 AS temperature {GENERATED}")
def gen_temperature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, "temperature", 1000)


@register("gen_social", f"SELECT id, 'member_' || lpad(CAST({drawn('user', 10)} AS VARCHAR), 3, '0') AS user, array_to_string(list_transform(range(0, {drawn('friends', 8)} + 1), lambda i: 'member_' || lpad(CAST(CAST(('0x' || substr(md5(id || '/1/friends' || i), 1, 8)) AS BIGINT) % 10 AS VARCHAR), 3, '0')), ',') AS friends {GENERATED}")
def gen_social(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, "social", 1000).select("id", "user", joined(F.col("friends")).alias("friends"))


@register("gen_sale", f"SELECT id, 'item_' || {drawn('product', 5)} AS product, CAST({drawn('number', 5)} AS INTEGER) AS number {GENERATED}")
def gen_sale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, "sale", 1000).select("id", "product", "number")


@register("gen_word", f"SELECT id, list_extract(['river', 'harbor', 'tide', 'anchor', 'gull'], {drawn('word', 5)} + 1) AS word {GENERATED}")
def gen_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    return generated(spark, "word", 1000).select("id", "word")


@register("message_headers", "SELECT event_id, 'kind' AS name, event_type AS value FROM events")
def message_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers as a message carries them: two are set, one is removed."""
    e = table(spark, sf_dir, "events")
    rows = e.withColumn("headers", F.array().cast("array<struct<key:string,value:binary>>"))
    rows = without_header(with_header(with_header(rows, "kind", F.lit("none")), "trace", F.col("event_id")), "trace")
    rows = with_header(rows, "kind", F.col("event_type"))
    return rows.select("event_id", F.explode("headers").alias("h")).select("event_id", F.col("h.key").alias("name"), F.col("h.value").cast("string").alias("value"))


@register(
    "fork_join",
    f"WITH {E}, r AS (SELECT event_id, ms + (event_id % 5) * 100 AS at_ms, user_id * 2 AS v FROM e WHERE event_id % 3 > 0) SELECT e.event_id, r.v AS doubled, e.event_type AS same FROM e LEFT JOIN r ON r.event_id = e.event_id AND r.at_ms <= e.ms + 200",
)
def fork_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two branches' results for each event: one late or missing for some, one at once."""
    e = events(spark, sf_dir)
    late = e.filter("event_id % 3 > 0").select("event_id", (F.col("c_timestamp") + F.col("event_id") % 5 * 100).alias("at_ms"), (F.col("user_id") * 2).alias("value"))
    at_once = e.select("event_id", F.col("c_timestamp").alias("at_ms"), F.col("event_type").alias("value"))
    return jobs.fork_join(e.select("event_id", "c_timestamp"), "event_id", "c_timestamp", {"doubled": late, "same": at_once}, 200).select("event_id", "doubled", "same")


@register("field_projection", f"WITH {E} SELECT event_id, CASE WHEN event_type = 'purchase' THEN k ELSE event_type END AS subject FROM e")
def field_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = FeatureApp("app001", payload="props").add_field("purchase", "subject", "$.none", "$.k").add_field(ALL, "subject", "$.none", "event_type")
    return made.bind(table(spark, sf_dir, "events")).select("event_id", "subject")


@register("stream_filter", "SELECT event_id, value FROM events WHERE value > 100")
def stream_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").filter("value > 100").select("event_id", "value")


@register("stream_map", "SELECT event_id, value, value > 100 AS high FROM events")
def stream_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "value", (F.col("value") > 100).alias("high"))


@register("stream_flatmap", "SELECT DISTINCT c_custkey, 'customer' || c_custkey || '->' || w AS pair, w FROM (SELECT c_custkey, unnest(string_split(c_name, '#')) AS w FROM customer)")
def stream_flatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = table(spark, sf_dir, "customer").select("c_custkey", F.explode(F.array_distinct(F.split("c_name", "#"))).alias("w"))
    return each.select("c_custkey", F.format_string("customer%d->%s", "c_custkey", "w").alias("pair"), "w")


@register("hash_partition", "SELECT event_id, CAST(('0x' || substr(md5(CAST(user_id AS VARCHAR)), 1, 8)) AS BIGINT) % 16 AS part FROM events")
def hash_partition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", sinks.hash_partition(F.col("user_id"), 16).alias("part"))


@register("route_switch", "SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN event_type ELSE 'other' END AS topic FROM events")
def route_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jobs.switched(F.col("event_type"), ["click", "view"]).alias("topic"))


ROUTES = {"click": ["subsystem1", "subsystem2"], "view": ["subsystem1", "subsystem2", "subsystem3"], "purchase": ["subsystem2", "subsystem3"]}


@register("route_dynamic", "SELECT event_id, topic FROM events JOIN (VALUES ('click', 'subsystem1'), ('click', 'subsystem2'), ('view', 'subsystem1'), ('view', 'subsystem2'), ('view', 'subsystem3'), ('purchase', 'subsystem2'), ('purchase', 'subsystem3')) r(kind, topic) ON kind = event_type")
def route_dynamic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.routed(table(spark, sf_dir, "events"), "event_type", ROUTES).select("event_id", "topic")


@register("control_stream", "SELECT (CASE WHEN event_type IN ('error', 'signup') THEN 'invalid' ELSE 'valid' END) || ' color (' || event_type || ')' AS message, count(*) AS n FROM events GROUP BY 1")
def control_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    control = spark.createDataFrame([("error",), ("signup",)], "event_type string")
    return jobs.checked(table(spark, sf_dir, "events"), control, "event_type").groupBy("message").agg(F.count("*").alias("n"))


@register("fanout_keys", f"WITH {E} SELECT event_id, unnest(['base', 'user', 'device']) AS key_name, unnest([CAST(event_id AS VARCHAR), CAST(user_id AS VARCHAR), k]) AS key_value FROM e")
def fanout_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.fan_out(events(spark, sf_dir), "event_id", {"user": F.col("user_id"), "device": F.col("device_id")})


# Keyed histories and the rule

HISTORY = f"{E}, h AS (SELECT *, list({{'ms': ms, 'v': value, 'k': k}}) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS hist FROM e)"


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.with_history(events(spark, sf_dir), "user_id", "c_timestamp", ["c_timestamp", "event_id"], ["amount", "device_id"])


def history_sql(value: str, w: int) -> str:
    return f"WITH {HISTORY} SELECT event_id, {value} AS feature FROM (SELECT event_id, list_filter(hist, lambda x: x.ms > ms - {w}) AS l FROM h)"


@register("history_100", f"WITH {HISTORY} SELECT event_id, len(hist) AS n, hist[1].ms AS oldest FROM h")
def history_100(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("event_id", F.size("history").cast("long").alias("n"), F.col("history")[0]["ms"].alias("oldest"))


@register("risk_sum", history_sql("round(list_sum(list_transform(l, lambda x: x.v)), 4)", D))
def risk_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("event_id", F.round(jobs.history_value(F.col("history"), "sum(amount#user_id.history,1d)", "user_id"), 4).alias("feature"))


@register("risk_count", history_sql("CAST(len(l) AS BIGINT)", D))
def risk_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("event_id", jobs.history_value(F.col("history"), "count(user_id.history,1d)", "user_id").alias("feature"))


@register("risk_count_distinct", history_sql("CAST(len(list_distinct(list_transform(l, lambda x: x.k))) AS BIGINT)", D))
def risk_count_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history(spark, sf_dir).select("event_id", jobs.history_value(F.col("history"), "count_distinct(device_id#user_id.history,24h)", "user_id").alias("feature"))


@register("risk_rule", history_sql(f"len(l) > 2 AND list_sum(list_transform(l, lambda x: x.v)) > 100 AND len(list_distinct(list_transform(l, lambda x: x.k))) <= 4", D))
def risk_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = F.col("history")
    return history(spark, sf_dir).select("event_id", jobs.anomalous(jobs.recent_count(h, D), jobs.recent_sum(h, "amount", D), jobs.recent_distinct(h, "device_id", D), 2, 100, 4).alias("feature"))


# Windows


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.withColumn("ms", millis(F.col("ts"))).withColumn("ts", F.timestamp_millis("ms"))


def panes_sql(length: int, slide: int, keys: str, aggs: str) -> str:
    n = length // slide
    return f"WITH {E}, p AS (SELECT *, unnest(range(ms // {slide} - {n} + 1, ms // {slide} + 1)) AS s FROM e) SELECT s * {slide} AS start_ms, s * {slide} + {length} AS end_ms, {keys}{aggs} FROM p GROUP BY ALL"


@register("win_sliding_global", panes_sql(10_000, 1000, "", "count(*) AS n"))
def win_sliding_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.windowed(timed(spark, sf_dir), "ts", "10 seconds", "1 second", [], F.count("*").alias("n"))


@register("win_tumbling_sum", panes_sql(10_000, 10_000, "event_type, ", "round(sum(value), 4) AS total"))
def win_tumbling_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.windowed(timed(spark, sf_dir), "ts", "10 seconds", None, ["event_type"], F.round(F.sum("value"), 4).alias("total"))


@register("win_slots", panes_sql(15_000, 5000, "event_type, ", "array_to_string(list_sort(list(DISTINCT ms // 5000)), ',') AS slots, min(ms) AS first_ms"))
def win_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = F.array_join(F.array_sort(F.collect_set(F.floor(F.col("ms") / 5000))), ",").alias("slots")
    return jobs.windowed(timed(spark, sf_dir), "ts", "15 seconds", "5 seconds", ["event_type"], slots, F.min("ms").alias("first_ms"))


@register("win_join", f"WITH {E} SELECT a.ms // {D} * {D} AS start_ms, a.user_id, a.event_id AS click_id, b.event_id AS purchase_id, b.value FROM e a JOIN e b ON a.user_id = b.user_id AND a.ms // {D} = b.ms // {D} WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def win_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed(spark, sf_dir)
    clicks = e.filter("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    bought = e.filter("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase_id"), "value")
    return jobs.window_join(clicks, bought, "user_id", "ts", "1 day").select("start_ms", "user_id", "click_id", "purchase_id", "value")


@register("wordcount_sliding", panes_sql(5000, 1000, "event_type AS word, ", "count(*) AS n"))
def wordcount_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = jobs.words(timed(spark, sf_dir).select("ts", "event_type"), "event_type")
    return jobs.windowed(each, "ts", "5 seconds", "1 second", ["word"], F.count("*").alias("n"))


@register("wordcount_batch", panes_sql(1000, 1000, "event_type AS word, ", "count(*) AS n"))
def wordcount_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = jobs.words(timed(spark, sf_dir).select("ts", "event_type"), "event_type", " ")
    return jobs.windowed(each, "ts", "1 second", None, ["word"], F.count("*").alias("n"))


@register(
    "wordcount_session",
    f"""WITH {E}, g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY event_type ORDER BY ms) <= 300000 THEN 0 ELSE 1 END AS fresh FROM e),
    s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ms ROWS UNBOUNDED PRECEDING) AS session FROM g)
    SELECT min(ms) AS start_ms, max(ms) + 300000 AS end_ms, event_type AS word, count(*) AS n FROM s GROUP BY event_type, session""",
)
def wordcount_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    each = jobs.words(timed(spark, sf_dir).withColumn("ts", F.timestamp_millis("ms")).select("ts", "event_type"), "event_type", r"\W+")
    return jobs.sessions(each, "ts", "5 minutes", ["word"], F.count("*").alias("n"))


@register("wordcount_running", r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s')) AS word FROM documents) WHERE word != '' GROUP BY word")
def wordcount_running(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.words(table(spark, sf_dir, "documents").select("text"), "text").groupBy("word").agg(F.count("*").alias("n"))


# Patterns

ALARMS = f"{E}, hot AS (SELECT *, lag(event_id) OVER w AS e0, lag(ms) OVER w AS ms0, lag(value) OVER w AS v0 FROM e WHERE value > 100 WINDOW w AS (PARTITION BY user_id ORDER BY ms, event_id)), al AS (SELECT user_id, ms AS at_ms, CASE WHEN floor(value) > floor(v0) THEN event_id ELSE e0 END AS event_id, CASE WHEN floor(value) > floor(v0) THEN value ELSE v0 END AS value FROM hot WHERE ms - ms0 < {D * 2})"


def found_alarms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = events(spark, sf_dir).select("event_id", "c_timestamp", "user_id", F.col("amount").alias("value"))
    return jobs.alarms(e, ["user_id"], "c_timestamp", ["event_id"], "value", 100.0, 2 * D)


@register("cep_alarm", f"WITH {ALARMS} SELECT user_id, at_ms, event_id, value FROM al")
def cep_alarm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_alarms(spark, sf_dir).select("user_id", "at_ms", "event_id", "value")


@register("cep_critical", f"WITH {ALARMS}, c AS (SELECT *, lag(at_ms) OVER w AS at0, lag(value) OVER w AS v0 FROM al WINDOW w AS (PARTITION BY user_id ORDER BY at_ms)) SELECT user_id, at_ms, event_id, value FROM c WHERE at_ms - at0 < {4 * D} AND floor(value) > floor(v0)")
def cep_critical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.escalations(found_alarms(spark, sf_dir), ["user_id"], "value", 4 * D).select("user_id", "at_ms", "event_id", "value")


# Layers


def layer_sql(name: str, slide: int, slides: int, source: str = "e") -> str:
    n = slides
    return f"""SELECT md5(s || '&' || (s + {n}) || '&' || event_type || '&{name}') AS id, s AS start, s + {n} AS "end", event_type AS product, count(*) AS v_count, '{name}' AS layer
    FROM (SELECT event_type, unnest(range(ms // {slide} - {n} + 1, ms // {slide} + 1)) AS s FROM {source}) GROUP BY s, event_type"""


@register("layer_batch", f"WITH {E} {layer_sql('batch', 60_000, 3)}")
def layer_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.layer(timed(spark, sf_dir), "ts", "event_type", "batch", 60_000, 3)


@register("layer_fast", f"WITH {E} {layer_sql('fast', 15_000, 1)}")
def layer_fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jobs.layer(timed(spark, sf_dir), "ts", "event_type", "fast", 15_000)


@register("layer_upsert", f"WITH {E} {layer_sql('batch', H, 3)}")
def layer_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the events up to a moment, then of the windows that end after it: where a window has both, the later version stays."""
    e = timed(spark, sf_dir)
    early = jobs.layer(e.filter(F.col("ms") < SERVE_AT), "ts", "event_type", "batch", H, 3)
    late = jobs.layer(e.filter(F.col("ms") >= SERVE_AT - 3 * H), "ts", "event_type", "batch", H, 3).filter(F.col("end") * H > SERVE_AT)
    both = early.withColumn("version", F.lit(1)).unionByName(late.withColumn("version", F.lit(2)))
    return sinks.latest(both, ["id"], "version").drop("version")


#: A moment within the data, batch slides of six hours, four a window, and fast panes of 15 minutes.
SERVE_AT, BATCH_MS, BATCH_N, FAST_MS = 1_705_330_000_000, 6 * H, 4, 900_000


@register(
    "serving_merge",
    f"""WITH {E}, c AS ({layer_sql('batch', BATCH_MS, BATCH_N)} UNION ALL {layer_sql('fast', FAST_MS, 1)}) SELECT product, CAST(sum(v_count) AS BIGINT) AS v_count FROM (
    SELECT * FROM c WHERE layer = 'batch' AND start = {SERVE_AT // BATCH_MS - BATCH_N} AND "end" = {SERVE_AT // BATCH_MS} UNION SELECT * FROM c WHERE layer = 'fast' AND start >= {SERVE_AT // BATCH_MS * BATCH_MS // FAST_MS} AND "end" <= {SERVE_AT // FAST_MS}) GROUP BY product""",
)
def serving_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = timed(spark, sf_dir)
    counts = jobs.layer(e, "ts", "event_type", "batch", BATCH_MS, BATCH_N).union(jobs.layer(e, "ts", "event_type", "fast", FAST_MS))
    return jobs.serve(counts, SERVE_AT, BATCH_MS, BATCH_N, FAST_MS)


@register("online_trend", f"WITH {E}, p AS (SELECT event_id, user_id, value AS y, lag(value) OVER (PARTITION BY user_id ORDER BY event_id) AS x, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM e), r AS (SELECT *, regr_slope(y, x) OVER w AS a, regr_intercept(y, x) OVER w AS b FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) SELECT user_id, event_id, round(CASE WHEN i > 4 THEN b + a * x ELSE 0 END, 3) AS predicted FROM r")
def online_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same regression on one value before, which SQL has, too."""
    done = jobs.online_regression(events(spark, sf_dir), "user_id", "event_id", "amount", lags=1)
    return done.select("user_id", "event_id", F.round("predicted", 3).alias("predicted"))


@register("online_regression")
def online_regression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's amounts predicted from the ten before; iterative, so tests hold it against a loop."""
    done = jobs.online_regression(events(spark, sf_dir), "user_id", "event_id", "amount")
    return done.select("user_id", "event_id", "value", F.round("predicted", 3).alias("predicted"))
