"""The feature language: parsing, macros, modes, golden values and edge rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import histogram, scalar
from tidewater.functions.histogram import quantiles
from tidewater.functions.windows import Span, span
from tidewater.operators import jobs
from tidewater.operators.features import ALL, FeatureApp
from tidewater.plans.history import HistoryFeature, parse_history
from tidewater.plans.planner import GET, UPDATE, UPGET, declare, fused, layers
from tidewater.plans.syntax import FeatureError, Macros, parse_call, parse_macro
from tidewater.sources import connectors, sinks
from tidewater.sources.tables import decoded, renamed_keys


def test_parsing():
    assert str(parse_call(" SUM( 1h, transaction , F_ADD(a, n=2), user_id=u1 )")) == "SUM(1h,transaction,F_ADD(a,n=2),user_id=u1)"
    assert parse_call("A(B(C(x)),y)").depth == 3
    for bad in ("", "SUM", "SUM(1h", "SUM(1h,)x", "SUM(,)", "a=b", "SUM(1h) SUM(1h)"):
        with pytest.raises(FeatureError):
            parse_call(bad)


def test_windows():
    assert span("7d") == Span(7, 86_400_000) and span("3C").ms == 45_000 and span("1M").ms == 2_592_000_000
    for bad in ("", "d", "7", "0d", "7x", "-1d"):
        with pytest.raises(FeatureError):
            span(bad)


def test_macros():
    macros = Macros()
    macros.add(parse_macro("M_A(x, y)", "SUM(1h, t, x, y)"))
    macros.add(parse_macro("M_B(x)", "F_ADD(M_A(x, u), n=1)"))
    macros.add(parse_macro("M_LOOP(x)", "F_ABS(M_LOOP(x))"))
    assert str(macros.expand(parse_call("M_B(a)"))) == "F_ADD(SUM(1h,t,a,u),n=1)"
    for bad in ("M_LOOP(a)", "M_NONE(a)", "M_A(a)"):
        with pytest.raises(FeatureError):
            macros.expand(parse_call(bad))


def test_planning():
    none = Macros()
    made = fused([declare("SUM(1h,t,a,u)", none, UPDATE, ALL), declare("SUM(1h, t, a, u)", none, GET, ALL)])
    assert [f.mode for f in made] == [UPGET]
    found = layers([declare("F_ADD(SUM(1h,t,a,u),SUM(1h,t,a,u))", none, UPGET, ALL)])
    assert [len(layer) for layer in found] == [1, 1]


@pytest.fixture(scope="module")
def sample(spark):
    """Six transactions, one second apart."""
    rows = [(1, "user001", "device001", 100.0), (2, "user001", "device002", 100.0), (3, "user001", "device001", 50.0), (4, "user002", "device001", 50.0), (5, "user002", "device003", 100.0), (6, "user001", "device003", 100.0)]
    return spark.createDataFrame([(i, 1_529_661_240_000 + 1000 * i, "transaction", u, d, a, "app001") for i, u, d, a in rows], "event_id long, c_timestamp long, event_type string, user_id string, device_id string, amount double, application string")


def test_sample_script(sample):
    app = FeatureApp("app001").add_macro("M_DEVICE_ON_USER_ONE_DAY(device, user)", "COUNT_DISTINCT(1d, transaction, device, user)")
    for text in ("COUNT(1d, transaction, user_id)", "M_DEVICE_ON_USER_ONE_DAY(device_id, user_id)", "SUM(1h, transaction, amount, user_id)"):
        app.add_feature(text, "transaction")
    got = app.activate().compute(sample).orderBy("event_id").select(*(f"`{n}`" for n in app.list())).collect()
    assert list(map(tuple, got)) == [(1, 1, 100), (2, 2, 200), (3, 2, 250), (1, 1, 50), (2, 2, 150), (4, 3, 350)]


def value(app_text, df, **more):
    app = FeatureApp("app001").add_feature(app_text, **more)
    return [r[0] for r in app.compute(df, {app.list()[0]: "f"}).orderBy("event_id").select("f").collect()]


def events_of(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "event_id long, c_timestamp long, event_type string, user_id string, amount string").withColumn("application", F.lit("a"))


def test_edges_of_windows_and_values(spark):
    h = 3_600_000
    df = events_of(spark, [(0, "t", "u", "1"), (h - 1, "t", "u", "abc"), (h, "t", "u", "2"), (h, "T", "u", None), (2 * h - 1, "x", "u", "5d"), (2 * h, "t", None, "4"), (2 * h, "t", None, "null")])
    assert value("SUM(1h, t, amount, user_id)", df) == [1.0, 1.0, 2.0, 2.0, None, 4.0, 4.0]
    assert value("SUM(1h, t, amount, user_id)", df, mode=GET)[4] == 2.0
    assert value("AVG(1h, t, amount, user_id)", df)[2:4] == [2.0, 2.0] and value("MAX(2h, t, amount, user_id)", df)[3] == 2.0
    assert value("COUNT(1h, t, amount, user_id)", df) == [1.0, 1.0, 1.0, 0.0, None, 1.0, 1.0]
    assert value("COUNT_DISTINCT(1h, t, amount, user_id)", df) == [1, 2, 2, 2, None, 2, 2]
    assert value("DIFF(1h, t, amount, user_id)", df) == [0.0, 0.0, 1.0, 1.0, None, 0.0, 0.0]
    assert value("MAX(1h, none, amount, user_id)", df, mode=GET) == [0.0] * 7
    assert all(math.isnan(x) for x in value("AVG(1h, none, amount, user_id)", df, mode=GET))
    assert value("SUM(1h, t, amount, user_id=u)", df, mode=GET) == [1.0, 1.0, 2.0, 2.0, 2.0, 0.0, 0.0]
    for bad in ("SUM(1h, t)", "NOPE(1h, t, a)", "F_ABS(a, b)", "HIST(1d, t, amount, user_id)", "F_QUANTILE(HIST(1d, t, amount, b=4, user_id), p=0)", "SUM(1h, t, amount, application)", "FLAT_SUM(1h, t, amount, user_id)"):
        with pytest.raises(FeatureError):
            value(bad, df)


def test_two_hops_and_keys_with_underscores(spark):
    df = spark.createDataFrame([(0, 0, "t", "a_b", "c"), (1, 1, "t", "a", "b_c"), (2, 2, "t", "x", "c"), (3, 3, "t", "a_b", "d")], "event_id long, c_timestamp long, event_type string, user_id string, device_id string").withColumns({"application": F.lit("a"), "amount": F.lit(1.0)})
    assert value("SUM(1h, t, amount, user_id, device_id)", df) == [1.0] * 4
    assert value("FLAT_COUNT(1d, t, SET(1h, t, device_id, user_id))", df) == [1.0, 1.0, 2.0, 3.0]
    assert value("FLAT_SET(1h, t, user_id, SET(1h, t, device_id, user_id))", df)[3] == ["a_b", "x"]
    assert value("FLAT_COUNT_DISTINCT(1h, t, device_id, FLAT_SET(1h, t, user_id, SET(1h, t, device_id, user_id)))", df)[3] == 2


def test_quantiles():
    assert quantiles([(5.0, 3.0)], 10) == (5.0,) * 6
    low, q1, q2, q3, high, mode = quantiles([(float(i), 1.0 + (i == 7)) for i in range(11)], 1000)
    assert (low, high, mode) == (0.0, 10.0, 7.0) and abs(q2 - 5.5) < 0.6 and q1 < q2 < q3


def test_serving_merge_golden(spark):
    batch, fast = [30, 40, 30, 30, 50], [[2, 2, 4, 3, 4], [5, 1, 4, 3, 2], [1, 3, 1, 4, 5]]
    rows = [("batch", 26114503, 26114506, p, n) for p, n in enumerate(batch)] + [("fast", 104458024 + i, 104458025 + i, p, n) for i, f in enumerate(fast) for p, n in enumerate(f)]
    counts = spark.createDataFrame([(f"{r[:4]}", r[1], r[2], f"product_{r[3]}", r[4], r[0]) for r in rows], "id string, start long, `end` long, product string, v_count long, layer string")
    got = {r.product: r.v_count for r in jobs.serve(counts, 1_566_870_406_268, 60_000, 3, 15_000).collect()}
    assert got == {"product_0": 38, "product_1": 46, "product_2": 39, "product_3": 40, "product_4": 61}


def test_sources_and_sinks(spark):
    df = spark.createDataFrame([('{"a": 1, "b": {"a.x": "a"}}',), ("{broken",), (None,)], "p string")
    got = decoded(df, "p", "a int").select("event.a", "event_error").collect()
    assert list(map(tuple, got)) == [(1, None), (None, "{broken"), (None, None)]
    assert df.select(renamed_keys(F.col("p"), "a", "z").alias("q")).first().q == '{"z": 1, "b": {"z.x": "a"}}'
    assert connectors.generated(spark, "social", 5).collect() == connectors.generated(spark, "social", 5).collect()
    with pytest.raises(ValueError):
        connectors.read_stream(spark, "nothing")
    with pytest.raises(Exception):
        spark.createDataFrame([(None,)], "k string").select(sinks.hash_partition(F.col("k"), 4)).collect()
    top = sinks.ranked(spark.range(20).withColumn("k", F.col("id") % 3), ["k"], F.desc("id"), 2)
    assert sorted(r.id for r in top.collect()) == [14, 15, 16, 17, 18, 19]


def test_regression_and_control(spark):
    df = spark.createDataFrame([("s", i, float(3 * i + (i % 2))) for i in range(60)], "k string, i int, v double")
    got = jobs.online_regression(df, "k", "i", "v").orderBy("i").collect()
    assert all(r.predicted == 0 for r in got[:22]) and all(abs(r.predicted - r.value) < 1e-4 for r in got[30:])
    control, data = spark.createDataFrame([("BLUE",), ("YELLOW",), ("BLUE",)], "color string"), spark.createDataFrame([(c,) for c in ("BLUE", "WHITE", "YELLOW")], "color string")
    assert {r.message for r in jobs.checked(data, control, "color").collect()} == {"invalid color (BLUE)", "valid color (WHITE)", "invalid color (YELLOW)"}


def test_a_large_value_that_has_left_the_window(spark):
    """1e16 is gone from the window; a difference of running sums would have lost the small values with it."""
    rows = spark.createDataFrame([(1, 0, 1e16), (2, 1_800_000, 1.0), (3, 4_200_000, 2.0), (4, 7_200_000, 1.0), (5, 7_200_000, 0.25), (6, 3_600_000, 0.5)], "event_id long, c_timestamp long, amount double")
    rows = rows.selectExpr("*", "'x' AS event_type", "'app' AS application", "1 AS user_id")
    app = FeatureApp("app").add_feature(f"SUM(1h, {ALL}, amount, user_id)")
    got = {r.event_id: r.s for r in app.compute(rows, {app.list()[0]: "s"}).collect()}
    assert got == {1: 1e16, 2: 1e16 + 1, 6: 1.5, 3: 3.5, 4: 3.25, 5: 3.25}


def test_a_function_of_ones_own(spark):
    scalar.register_scalar("F_CLAMP", 3, 3, lambda x, low, high: F.greatest(low, F.least(high, x)))
    try:
        rows = spark.createDataFrame([(1, 0, 7.0), (2, 0, -1.0)], "event_id long, c_timestamp long, amount double").selectExpr("*", "'x' AS event_type", "'app' AS application")
        app = FeatureApp("app").add_feature("F_CLAMP(amount, low=0, high=5)")
        assert sorted(r.s for r in app.compute(rows, {app.list()[0]: "s"}).collect()) == [0.0, 5.0]
        with pytest.raises(FeatureError):
            scalar.register_scalar("F_CLAMP", 1, 1, F.abs)
    finally:
        del scalar.SCALARS["F_CLAMP"]


def test_texts_of_histories():
    assert parse_history("sum(amount#user_id.history,1d)") == HistoryFeature("sum", "amount", "user_id", 86_400_000)
    assert parse_history(" count( user_id.history , 2h ) ") == HistoryFeature("count", None, "user_id", 7_200_000)
    for bad in ("sum(user_id.history,1d)", "count(a#b.history,1d)", "sum(a#b.history,0d)", "sum(a#b.history,1m)", "avg(a#b.history,1d)", "sum(a#b,1d)"):
        with pytest.raises(FeatureError):
            parse_history(bad)


def test_quantiles_of_many_at_once():
    rng = np.random.default_rng(0)
    x = [np.sort(rng.choice(1000, n, replace=False)).astype(float) for n in (1, 2, 3, 8, 30)]
    y = [rng.integers(1, 9, len(v)).astype(float) for v in x]
    for row, a, b in zip(histogram.quantile_rows(x, y, 50), x, y):
        assert np.allclose(row, histogram.quantiles(list(zip(a, b)), 50))


def test_database_tables(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    rows = spark.createDataFrame([("a", 1), ("b", 2)], "id string, n int")
    rows.write.format("jdbc").options(url=url, dbtable="counts", createTableColumnTypes="id varchar(32)").save()
    connectors.insert_jdbc(spark.createDataFrame([("c", 3)], "id string, n int"), url, "counts")
    connectors.upsert_jdbc(spark.createDataFrame([("b", 20), ("d", 4)], "id string, n int"), url, "counts", ["id"], createTableColumnTypes="id varchar(32)")
    want = {("a", 1), ("b", 20), ("c", 3), ("d", 4)}
    assert {tuple(r) for r in connectors.read_jdbc(spark, url, 'SELECT "id", "n" FROM counts').collect()} == want
    assert {tuple(r) for r in connectors.read_jdbc(spark, url, 'SELECT "id", "n" FROM counts', split=('"n"', 0, 20, 3)).collect()} == want


def test_messages(spark):
    rows = spark.createDataFrame([(1, "x")], "id long, kind string")
    r = connectors.kafka_rows(rows, F.col("id"), "out", {"kind": F.col("kind")}).first()
    assert (r.key, r.value, r.topic, r.headers[0].key, bytes(r.headers[0].value)) == ("1", '{"id":1,"kind":"x"}', "out", "kind", b"x")
    assert connectors.kafka_options("h:1", "t", "g", True)["startingOffsets"] == "earliest"
    assert connectors.generated(spark, "word", 5, rate=3).isStreaming


def test_sets_ask_for_all_of_the_same_millisecond(spark):
    """Four users of one device at once: each event reads all of them, whatever the order of their numbers."""
    h = 3_600_000
    df = spark.createDataFrame([(i, 10 * h, "t", f"u{i}", "d") for i in range(4)] + [(4, 11 * h, "t", "u0", "e"), (5, 7 * h, "t", "u0", "d"), (6, 11 * h, "t", "u9", None)], "event_id long, c_timestamp long, event_type string, user_id string, device_id string").withColumns({"application": F.lit("a"), "amount": F.expr("if(event_id = 5, 1e16, event_id)")})
    members = "SET(6h, t, device_id, user_id)"
    assert value(f"FLAT_COUNT(1d, t, {members})", df) == [5.0, 5.0, 5.0, 5.0, 6.0, 1.0, 0.0]
    assert value(f"FLAT_SUM(3h, t, amount, {members})", df) == [6.0, 6.0, 6.0, 6.0, 10.0, 1e16, 0.0]
    assert value(f"FLAT_COUNT_DISTINCT(1h, t, user_id, {members})", df) == [4, 4, 4, 4, 1, 1, 0]
    assert value(f"FLAT_SET(2h, t, user_id, {members})", df) == [["u0", "u1", "u2", "u3"]] * 5 + [["u0"], []]
    assert value(f"FLAT_SET(2h, t, user_id, {members})", df.withColumn("event_type", F.expr("if(event_id = 3, 'x', 't')")))[3] is None
    assert value(f"FLAT_SUM(3h, t, amount, {members}, user_id)", df) == [0.0, 1.0, 2.0, 3.0, 4.0, 1e16, 0.0]


def test_histograms_go_through_many_keys_in_one_pass(spark):
    """Small keys, a large one and null; the same bins as by merging all buckets at each row, and no call for each key."""
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.integers(0, 40 * 3_600_000)), "t", None if i % 7 == 0 else f"u{min(int(rng.integers(0, 60)), 25)}", None if i % 11 == 0 else float(rng.integers(0, 30))) for i in range(900)]
    df = spark.createDataFrame(rows, "event_id long, c_timestamp long, event_type string, user_id string, amount double").withColumn("application", F.lit("a"))
    app = FeatureApp("app").add_feature("HIST(3h, t, amount, bins=5, user_id)")
    made = app.compute(df, {app.list()[0]: "h"})
    got = {r.event_id: [list(b) for b in r.h] for r in made.collect()}
    want, unit = {}, 3_600_000
    for key in {r[3] for r in rows}:
        buckets: dict[int, list] = {}
        for i, ms, _, _, x in sorted((r for r in rows if r[3] == key), key=lambda r: (r[1], r[0])):
            b = ms // unit
            if x is not None:
                histogram.insert(buckets.setdefault(b, []), x, 1.0, 5)
            closed = histogram.merged([buckets[k] for k in sorted(buckets) if b - 3 < k < b], 5)
            want[i] = histogram.merged([closed, buckets.get(b, [])], 5)
    assert got == want
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "FlatMapGroups" not in plan


def test_a_fixed_key_is_dealt_by_time(spark):
    """All rows ask for one key: they don't go to one task for it, and rows of other keys don't go along."""
    h = 3_600_000
    df = spark.range(400).selectExpr("id AS event_id", f"id * {h // 10} AS c_timestamp", "'t' AS event_type", "CAST(id % 9 AS STRING) AS user_id", "CAST(id AS DOUBLE) AS amount", "'a' AS application")
    df = df.unionByName(df.filter("event_id = 7").selectExpr("400L AS event_id", "CAST(NULL AS BIGINT) AS c_timestamp", "event_type", "user_id", "amount", "application"))
    text = "SUM(10h, t, amount, user_id=7)"
    assert value(text, df) == [float(sum(j for j in range(max(0, i - 99), i + 1) if j % 9 == 7)) for i in range(400)] + [0.0]
    app = FeatureApp("app").add_feature(text)
    plan = app.compute(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "__slice" in plan
