"""The whole feature language on streams, by micro-batches of the batch engine.

Each batch adds its events to those that are held, in a Parquet folder, and answers the ones that the watermark has
passed: the largest time seen less the delay. They are answered by the same plan as in batch, over what is held, so
files may come in any order within the delay and the answers are those of the batch engine. Events older than the
watermark are too late and dropped. Held are events that wait, and those that a later window can still reach: no more
than the longest chain of windows of the features. A batch that runs again writes the same folder and gives the same rows.

DIFF looks back by events and not by time; where a feature has it, all events stay.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.windows import span
from ..operators.features import FLAT, TEMPORAL, FeatureApp
from ..plans.syntax import Call


def reach(call: Call) -> int | None:
    """How far back in time a call looks, in milliseconds; None without bound."""
    inner = [reach(a) for a in call.args if isinstance(a, Call)]
    if call.op == "DIFF" or None in inner:
        return None
    own = span(call.args[0].name).ms if call.op in TEMPORAL + FLAT else 0
    return own + max(inner, default=0)


@dataclass
class WholeStream:
    """Features of an app over a stream; sink(rows, batch) gets the answers of each batch, and the same ones if it runs again."""

    app: FeatureApp
    folder: str
    delay_ms: int
    sink: Callable[[DataFrame, int], None]

    def start(self, events: DataFrame, checkpoint: str, drain: bool = False) -> StreamingQuery:
        self.active = self.app.activate()
        every = [reach(f.call) for f in self.active.features]
        self.reach = None if None in every else max(every, default=0)
        writer = events.writeStream.foreachBatch(self._batch).option("checkpointLocation", checkpoint)
        return (writer.trigger(availableNow=True) if drain else writer).start()

    def _batch(self, new: DataFrame, batch: int) -> None:
        spark, ms = new.sparkSession, F.col(self.active.ms).cast("long")
        before = max((b for b in self._batches(spark) if b < batch), default=None)
        rows = new.withColumn("__answered", F.lit(False))
        mark = None
        if before is not None:
            held = spark.read.parquet(f"{self.folder}/batch={before}/held")
            mark = spark.read.parquet(f"{self.folder}/batch={before}/mark").first()["mark"]
            rows = held.unionByName(rows.filter(ms > mark) if mark is not None else rows)
        seen = new.agg(F.max(ms)).first()[0]
        now = mark if seen is None else seen - self.delay_ms if mark is None else max(mark, seen - self.delay_ms)
        path = f"{self.folder}/batch={batch}"
        if now is not None:
            passed = rows.filter(ms <= now)
            answers = self.active.compute(passed).filter(~F.col("__answered")).drop("__answered")
            self.sink(answers, batch)
            keep = F.lit(True) if self.reach is None else ms > now - self.reach
            rows = rows.withColumn("__answered", F.col("__answered") | (ms <= now)).filter(keep | ~F.col("__answered"))
        rows.write.mode("overwrite").parquet(f"{path}/held")
        spark.createDataFrame([(now,)], "mark long").write.mode("overwrite").parquet(f"{path}/mark")
        # The one before is kept, as this batch may run again.
        for old in self._batches(spark):
            if before is not None and old < before:
                self._system(spark).delete(self._path(spark, f"{self.folder}/batch={old}"), True)

    def _path(self, spark, path: str):
        return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)

    def _system(self, spark):
        return self._path(spark, self.folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _batches(self, spark) -> list[int]:
        """The batches whose folders are whole: the mark is written last."""
        system, root = self._system(spark), self._path(spark, self.folder)
        found = [str(f.getPath()) for f in system.listStatus(root)] if system.exists(root) else []
        return sorted(int(f.rsplit("=", 1)[1]) for f in found if "batch=" in f and system.exists(self._path(spark, f"{f}/mark/_SUCCESS")))
