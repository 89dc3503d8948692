"""Tables, and events as the operators take them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp, with or without zone, cut off."""
    return F.unix_millis(ts.cast("timestamp"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, c_timestamp (ms), event_type, user_id, device_id, amount, application."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", millis(F.col("ts")).alias("c_timestamp"), "event_type", "user_id", F.get_json_object("props", "$.k").alias("device_id"), F.col("value").alias("amount"), F.lit("app001").alias("application"))


def decoded(df: DataFrame, payload: str, schema: str, into: str = "event") -> DataFrame:
    """df with a JSON payload decoded as `into`. What can't be decoded is null there and named in `into`_error."""
    raw = F.col(payload).cast("string")
    made = F.from_json(raw, schema)
    broken = raw.isNotNull() & F.try_parse_json(raw).isNull()
    return df.withColumn(into, F.when(~broken, made)).withColumn(f"{into}_error", F.when(broken, raw))


def renamed_keys(payload: Column, old: str, new: str) -> Column:
    """A JSON text with a part of every key replaced, at any depth; values stay."""
    quoted = r'"((?:[^"\\]|\\.)*)"(\s*:)'
    parts = F.regexp_extract_all(payload, F.lit(quoted), F.lit(0))
    between = F.split(payload, quoted, -1)
    return F.array_join(F.transform(F.arrays_zip(between.alias("gap"), parts.alias("key")), lambda x: F.concat(x["gap"], F.coalesce(F.replace(x["key"], F.lit(old), F.lit(new)), F.lit("")))), "")
