"""Where streams come from and go to, by name and options."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats that Spark itself has, and kafka, whose package a cluster has to add.
READERS = ("parquet", "json", "csv", "text", "socket", "rate", "kafka")
WRITERS = ("parquet", "json", "text", "console", "memory", "noop", "kafka")


def read_stream(spark: SparkSession, kind: str, path: str | None = None, schema: str | None = None, **options: str) -> DataFrame:
    """A stream. maxFilesPerTrigger and maxOffsetsPerTrigger bound what a batch takes."""
    if kind not in READERS:
        raise ValueError(f"no such source: {kind}")
    reader = spark.readStream.format(kind).options(**options)
    if schema:
        reader = reader.schema(schema)
    out = reader.load(path) if path else reader.load()
    return out.select(F.col("key").cast("string"), F.col("value").cast("string"), "topic", "timestamp") if kind == "kafka" else out


def write_stream(df: DataFrame, kind: str, checkpoint: str, path: str | None = None, mode: str = "append", drain: bool = False, **options: str):
    """Starts the query. drain: takes what there is and ends."""
    if kind not in WRITERS:
        raise ValueError(f"no such sink: {kind}")
    writer = df.writeStream.format(kind).outputMode(mode).options(**options)
    if kind != "memory":
        writer = writer.option("checkpointLocation", checkpoint)
    if drain:
        writer = writer.trigger(availableNow=True)
    return writer.start(path) if path else writer.start()


def kafka_options(servers: str, topic: str, group: str | None = None, earliest: bool = False, **more: str) -> dict[str, str]:
    """Options of a Kafka source: where to begin; a checkpoint holds the offsets, the group only names the reader."""
    return {"kafka.bootstrap.servers": servers, "subscribe": topic, "startingOffsets": "earliest" if earliest else "latest", **({"kafka.group.id": group} if group else {}), **more}


def kafka_rows(df: DataFrame, key: Column | None = None, topic: str | None = None, headers: dict[str, Column] | None = None) -> DataFrame:
    """df as a Kafka sink takes it: key, value (the row as JSON), topic, headers."""
    out = [F.to_json(F.struct(*df.columns)).alias("value")]
    if key is not None:
        out.append(key.cast("string").alias("key"))
    if topic:
        out.append(F.lit(topic).alias("topic"))
    if headers:
        out.append(F.array(*(F.struct(F.lit(k).alias("key"), v.cast("string").cast("binary").alias("value")) for k, v in headers.items())).alias("headers"))
    return df.select(*out)


def with_header(df: DataFrame, name: str, value: Column, column: str = "headers") -> DataFrame:
    """df with a header set, in place of one of that name."""
    own = F.struct(F.lit(name).alias("key"), value.cast("string").cast("binary").alias("value"))
    return df.withColumn(column, F.concat(F.filter(column, lambda h: h["key"] != name), F.array(own)))


def without_header(df: DataFrame, name: str, column: str = "headers") -> DataFrame:
    return df.withColumn(column, F.filter(column, lambda h: h["key"] != name))


def read_jdbc(spark: SparkSession, url: str, query: str, split: tuple[str, int, int, int] | None = None, **options: str) -> DataFrame:
    """The rows of a query; split (column, low, high, parts) reads it in parts at once."""
    reader = spark.read.format("jdbc").options(url=url, **options)
    if split:
        column, low, high, parts = split
        reader = reader.options(partitionColumn=column, lowerBound=str(low), upperBound=str(high), numPartitions=str(parts)).option("dbtable", f"({query}) q")
    else:
        reader = reader.option("query", query)
    return reader.load()


def insert_jdbc(df: DataFrame, url: str, table: str, **options: str) -> None:
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode("append").save()


def upsert_jdbc(df: DataFrame, url: str, table: str, keys: list[str], **options: str) -> None:
    """Rows with new keys are inserted, others updated: by way of a table beside it and one MERGE of the database."""
    spark, staging = df.sparkSession, f"{table}_staging"
    df.write.format("jdbc").options(url=url, dbtable=staging, truncate="true", **options).mode("overwrite").save()
    quoted = {c: f'"{c}"' for c in df.columns}
    on = " AND ".join(f"t.{quoted[k]} = s.{quoted[k]}" for k in keys)
    update = ", ".join(f"{quoted[c]} = s.{quoted[c]}" for c in df.columns if c not in keys)
    merge = f"MERGE INTO {table} t USING {staging} s ON {on}" + (f" WHEN MATCHED THEN UPDATE SET {update}" if update else "") + f" WHEN NOT MATCHED THEN INSERT ({', '.join(quoted.values())}) VALUES ({', '.join('s.' + q for q in quoted.values())})"
    connection = spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url)
    try:
        connection.createStatement().executeUpdate(merge)
    finally:
        connection.close()


#: Words of the demonstration source.
WORDS = ("river", "harbor", "tide", "anchor", "gull")


def generated(spark: SparkSession, kind: str, n: int, seed: int = 1, rate: int | None = None) -> DataFrame:
    """Rows of the demonstration sources, the same for the same seed: temperature, social, hobby, sale, word, loan.

    With a rate it is a stream of so many rows a second, without end; n is then not used.
    """
    def pick(salt: str, size: int):
        return F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(f"/{seed}/{salt}"))), 1, 8), 16, 10).cast("long") % size

    ids = spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("id")) if rate else spark.range(n)
    rows = ids.withColumn("timestamp", F.lit(1_500_000_000_000) + F.col("id") * 1000)

    def several(name: str, salt: str):
        drawn = [F.concat(F.lit(f"{name}_"), F.lpad(pick(f"{salt}{i}", 10).cast("string"), 3, "0")) for i in range(8)]
        return F.slice(F.array(*drawn), F.lit(1), (pick(salt, 8) + 1).cast("int"))

    user = F.concat(F.lit("member_"), F.lpad(pick("user", 10).cast("string"), 3, "0"))
    kinds = {
        "temperature": {"temperature": pick("temperature", 200_000) / 1000.0}, "social": {"user": user, "friends": several("member", "friends")}, "hobby": {"user": user, "hobbies": several("pastime", "hobbies")},
        "sale": {"product": F.concat(F.lit("item_"), pick("product", 5).cast("string")), "number": pick("number", 5).cast("int")}, "word": {"word": F.element_at(F.array(*map(F.lit, WORDS)), (pick("word", 5) + 1).cast("int"))},
        "loan": {"user_id": F.lit("member_000"), "event_type": F.lit("loan"), "amount": F.lit(1000)},
    }
    if kind not in kinds:
        raise ValueError(f"no such generator: {kind}")
    return rows.withColumns(kinds[kind])
