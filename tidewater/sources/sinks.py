"""Writing: partitioning by a key's hash, and tables that are updated by key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def hash_partition(key: Column, n: int) -> Column:
    """The partition of a key, the same on any engine: the first 32 bits of its MD5 modulo n. A null key is an error."""
    text = F.coalesce(key.cast("string"), F.raise_error(F.lit("a key is null")).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") % n


def latest(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row of the latest version of each key; max_by is combined before the shuffle, so no key's versions meet in one task."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("__row")).select(*keys, *(F.col("__row")[c].alias(c) for c in rest))


def upsert(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], version: str, batch_id: int) -> DataFrame:
    """Merges changes into the Parquet table at path and returns it. Each batch writes a new folder, so that one that is run again does no harm."""
    old = sorted((int(f.rsplit("=", 1)[1]) for f in _folders(spark, path)), reverse=True)
    before = next((b for b in old if b < batch_id), None)
    merged = changes if before is None else spark.read.parquet(f"{path}/batch={before}").unionByName(changes)
    latest(merged, keys, version).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
    return spark.read.parquet(f"{path}/batch={batch_id}")


def _folders(spark: SparkSession, path: str) -> list[str]:
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [str(s.getPath()) for s in system.listStatus(root) if "batch=" in str(s.getPath())] if system.exists(root) else []


def ranked(df: DataFrame, keys: list[str], order: Column, n: int) -> DataFrame:
    """The first n rows of each key. Spark keeps n rows of a key in each task before it shuffles."""
    return df.withColumn("__rank", F.row_number().over(Window.partitionBy(*keys).orderBy(order))).filter(F.col("__rank") <= n).drop("__rank")
