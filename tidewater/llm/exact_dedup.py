"""Exact deduplication by a log-structured merge index of digests.

Each task keeps a memtable, digest -> (smallest id, count), and flushes it as a sorted run whenever it is full. Runs are
Parquet files with Bloom filters on the digest. Compaction merges the runs of a digest, keeps the smallest id and adds
the counts; its output is sorted runs with filters again, one for each partition. Because each memtable holds a digest
once, the copies of one text meet as a few rows, however many they are. Documents then look their digest up. A hit on
a group of two or more is verified byte by byte against the text of the group's representative, in salted shares, so a
digest alone never drops a document; texts that only share a digest are grouped by the bytes themselves.

Two texts are equal when identical after each run of white space is replaced by one space.

Defined results: a null text counts as empty, and empty texts are equal. Rows without an id are kept only where no equal
row has one. Of rows equal in id and text one is kept. Other columns are ignored unless named as payload. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import filters
from .base import discard, plus, read_table, written

SPACES = r"[\x20\x09-\x0D]+"
#: A group with at least one in so many of all rows is hot; there can be no more than so many, 100 bytes each.
HOT_SHARE = 10_000
#: Members of one group that meet in one task when their bytes are compared.
SHARE = 2048
#: Entries of a memtable.
MEMTABLE = 200_000


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACES, " ")


def sha256_digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _filters(rows: int) -> dict[str, str]:
    return {"parquet.bloom.filter.enabled#digest": "true", "parquet.bloom.filter.expected.ndv#digest": str(max(1000, rows))}


def flush_runs(df: DataFrame, memtable: int = MEMTABLE) -> DataFrame:
    """(digest, keep_id, n) of (doc_id, digest): sorted runs, each from one memtable."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: dict[bytes, list] = {}
        kind = None

        def flush() -> pa.RecordBatch:
            keys = sorted(table)
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array([table[k][0] for k in keys], kind), pa.array([table[k][1] for k in keys], pa.int64())], names=["digest", "keep_id", "n"])
            table.clear()
            return out

        for batch in batches:
            kind = batch.column("doc_id").type
            for doc_id, digest in zip(batch.column("doc_id").to_pylist(), batch.column("digest").to_pylist()):
                entry = table.setdefault(digest, [doc_id, 0])
                entry[1] += 1
                if entry[0] is None or doc_id is not None and doc_id < entry[0]:
                    entry[0] = doc_id
            if len(table) >= memtable:
                yield flush()
        if table:
            yield flush()

    df = df.select("doc_id", "digest")
    schema = plus(df.select("digest", F.col("doc_id").alias("keep_id")), "n long")
    return df.mapInArrow(run, schema)


def compact(runs: DataFrame) -> DataFrame:
    """Runs merged: one entry for each digest, with the smallest id and the count of all; sorted within partitions."""
    return runs.groupBy("digest").agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n")).sortWithinPartitions("digest")


def _kept(rows: DataFrame) -> DataFrame:
    """Marks one row of each group (digest, other): the first of those that have the id to keep. rows has a unique uid."""
    first = rows.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "other").agg(F.min("uid").alias("uid"))
    return rows.join(first.select("uid", F.lit(True).alias("first")), "uid", "left").withColumn("kept", F.coalesce("first", F.lit(False)))


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", payload: list[str] | None = None, digest: Callable[[Column], Column] = sha256_digest, memtable: int = MEMTABLE) -> DataFrame:
    """One row for each row of df: doc_id, keep_id, group_size, kept, text_sha256, and `payload`, a struct of the columns named."""
    extra = [F.struct(*(df[c] for c in payload)).alias("payload")] if payload else []
    keep = ["payload"] if payload else []
    docs = df.select(F.col(id_col).alias("doc_id"), normalised(F.col(text_col)).alias("norm"), *extra)
    docs = docs.withColumn("text_sha256", F.sha2("norm", 256))
    docs = docs.withColumn("digest", F.unhex("text_sha256") if digest is sha256_digest else digest(F.col("norm")))

    runs = written(flush_runs(docs, memtable), "dedup-runs", **_filters(memtable))
    index = written(compact(runs), "dedup-index", **_filters(memtable))
    discard(runs)
    groups = index.filter("n > 1")
    total = index.agg(F.sum("n")).first()[0] or 0
    hot = F.col("n") * HOT_SHARE >= total
    bits = df.sparkSession.sparkContext.broadcast(filters.build(groups, "digest"))

    def may_hit(digests):
        import pandas as pd

        return pd.Series(filters.might_hold(bits.value, pa.array(digests, pa.binary())))

    sifted = docs.withColumn("may_hit", F.pandas_udf(may_hit, "boolean")("digest")).withColumn("norm", F.when(F.col("may_hit"), F.col("norm")))
    sifted = sifted.join(F.broadcast(groups.filter(hot)), "digest", "left").select("doc_id", "digest", "text_sha256", "keep_id", "n", "norm", "may_hit", *keep)
    sifted = written(sifted, "dedup-sifted", compression="zstd")
    rest = sifted.filter(F.col("may_hit") & F.col("n").isNull()).drop("keep_id", "n").join(groups.filter(~hot), "digest", "left")
    looked = written(rest.select("doc_id", "digest", "text_sha256", "keep_id", "n", "norm", *keep), "dedup-lookup", compression="zstd")
    looked = looked.unionByName(sifted.filter(F.col("n").isNotNull()).drop("may_hit"))

    single = looked.filter(F.col("n").isNull()).select("doc_id", "text_sha256", *keep).unionByName(sifted.filter(~F.col("may_hit")).select("doc_id", "text_sha256", *keep))
    single = single.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256", *keep)
    many = looked.filter(F.col("n").isNotNull())
    shares = F.ceil(F.col("n") / SHARE).cast("int")
    heads = many.filter(F.col("doc_id").eqNullSafe(F.col("keep_id"))).groupBy("digest", "n").agg(F.min("norm").alias("head"))
    heads = heads.select("digest", "head", F.explode(F.sequence(F.lit(0), shares - 1)).alias("share"))
    members = many.withColumn("share", F.pmod(F.xxhash64("doc_id", F.monotonically_increasing_id()), shares).cast("int"))
    same = F.col("norm") == F.col("head")
    compared = members.join(heads, ["digest", "share"]).select("doc_id", "digest", "text_sha256", "keep_id", "n", same.alias("same"), F.when(~same, F.col("norm")).alias("other"), *keep)
    verified = written(compared.withColumn("uid", F.monotonically_increasing_id()), "dedup-verified", compression="zstd")

    different = verified.filter(~F.col("same"))
    if not different.isEmpty():
        # Texts that share a digest and differ: grouped by their bytes, and taken off the size of the group they were in.
        own = different.groupBy("digest", "other").agg(F.min("doc_id").alias("own_id"), F.count("*").alias("own_n")).withColumnRenamed("digest", "own_digest").withColumnRenamed("other", "own_text")
        less = different.groupBy("digest").agg(F.count("*").alias("less"))
        verified = verified.join(own, (F.col("digest") == F.col("own_digest")) & (F.col("other") == F.col("own_text")), "left").join(less, "digest", "left")
        verified = verified.withColumn("keep_id", F.when(F.col("same"), F.col("keep_id")).otherwise(F.col("own_id"))).withColumn("n", F.when(F.col("same"), F.col("n") - F.coalesce("less", F.lit(0))).otherwise(F.col("own_n")))
    copies = _kept(verified).select("doc_id", "keep_id", F.col("n").alias("group_size"), "kept", "text_sha256", *keep)
    return single.unionByName(copies)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outcome of every row of documents."""
    return exact_dedup(read_table(spark, sf_dir, "documents"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS norm FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""
