"""Rows dealt to tasks by keys, each task's rows in order."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Bytes of the files read for each task, so that a task stays small however large the input is.
TASK_BYTES = 2 << 20
MOST_TASKS = 2000


def ddl(df: DataFrame) -> str:
    return ", ".join(f"`{c}` {t}" for c, t in df.dtypes)


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions, more for large files."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    # The same files read twice count twice, as their rows do. Rows without files have no known size.
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    return max(least, min(MOST_TASKS, sum(s for s in sizes if s < 1 << 60) // TASK_BYTES))


def dealt(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """df with the rows of the same keys in one task, one after the other and in order."""
    return df.repartition(tasks(df), *keys).sortWithinPartitions(*keys, *order)
