"""What the operators of this subpackage share: inputs, scratch tables, bounded batches."""

from __future__ import annotations

import contextlib
import functools
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

_own: dict[str, str] = {}
BATCH_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir. Only a session of one machine may go without it."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if shared:
        return shared.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share: intermediate tables go there")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = "file://" + tempfile.mkdtemp(prefix="tidewater-")
    return _own[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What is planned within sends Arrow batches of at most BATCH_BYTES to Python workers, so that neither side holds more."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    with small_batches(spark):
        df.write.options(**options).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._tidewater_path = path
    return back


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def discard(*tables: DataFrame) -> None:
    """Delete tables made by written() that nothing will read again."""
    for df in tables:
        delete_path(df.sparkSession, df._tidewater_path)


class Scratch:
    """The tables that one call writes: done() deletes all but those that its result still reads."""

    def __init__(self):
        self.tables: list[DataFrame] = []

    def written(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.tables.append(written(df, name, **options))
        return self.tables[-1]

    def done(self, *keep: DataFrame) -> None:
        kept = {t._tidewater_path for t in keep}
        discard(*(t for t in self.tables if t._tidewater_path not in kept))
        self.tables = []


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def texts_of(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text) alone, so that other columns can't clash; a null text counts as empty, a null id stays null."""
    return df.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def plus(df: DataFrame, fields: str) -> StructType:
    """The schema of df, nullable, with more fields, given as DDL."""
    return StructType([*(StructField(f.name, f.dataType) for f in df.schema.fields), *StructType.fromDDL(fields).fields])


def slices(batch: pa.RecordBatch, column: str | None = None, rows: int = 512, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """batch in slices of at most `rows` rows and, by the values of a text or binary column, about `size` bytes, but at least one row."""
    n = batch.num_rows
    ends = None
    if column is not None and n:
        values = batch.column(column)
        wide = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
        ends = np.frombuffer(values.buffers()[1], np.int64 if wide else np.int32)[values.offset : values.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        stop = min(n, at + rows)
        if ends is not None:
            stop = min(stop, max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1))
        yield batch.slice(at, stop - at)
        at = stop


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: StructType, rows: int = 512, column: str | None = None, size: int = 1 << 20) -> DataFrame:
    """mapInArrow with batches cut by slices(). make() runs once a task and returns the function for each batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        for batch in batches:
            for part in slices(batch, column, rows, size):
                yield one(part)

    return df.mapInArrow(run, schema)


@functools.lru_cache(maxsize=4)
def word_tokenizer(path: str):
    """The tokenizers library's tokenizer of a .json file, once a process, on one thread."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def tokenizer_path(name: str) -> str:
    """Where the installed public vocabulary files are; every operator takes the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)
