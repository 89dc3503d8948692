"""A training corpus from documents: five stages, each with one operator, each written and read again as the next one's input.

Defined results of all stages: a null text counts as empty and stays null until it is packed; a null doc_id stays null;
columns besides doc_id, text and n_chars go along unread, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, near_dedup, packing, pii, quality
from tidewater.llm.base import read_table, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier, fitted on the labels of these documents, scores below its threshold.

    Equal texts have equal scores, empty ones too; without any labels all rows stay.
    """
    labels = read_table(spark, sf_dir, "labels")
    model = quality.fit(quality.features(quality.labelled(docs, labels)), labels)
    return quality.scored(docs, model, score_col="__score").filter(F.col("__score") >= quality.THRESHOLD).select(docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts, the one with the smallest doc_id; one of rows alike in both, one without an id if none has one."""
    done = exact_dedup.exact_dedup(docs, payload=docs.columns)
    return done.filter("kept").select(*(F.col(f"payload.`{c}`").alias(c) for c in docs.columns))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each near-duplicate class, the one with the smallest doc_id; one of rows alike in it, one without an id if none has one."""
    rows = docs.withColumn("__row", F.monotonically_increasing_id())
    kept = near_dedup.near_classes(rows, row_col="__row").filter("kept").select(F.col("row_id").alias("__kept"))
    return rows.join(kept, F.col("__row") == F.col("__kept"), "left_semi").select(docs.columns)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by surrogates; n_chars, where there is one that isn't null, follows the new text. No row goes."""
    done = pii.replace(docs, found_col="__found").drop("__found")
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)))
    return done.select(docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048; an empty text is its end id alone."""
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [("quality", quality_stage), ("exact_dedup", exact_stage), ("near_dedup", near_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: A classifier, consistent sampling and a tokenizer are among the stages, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder before the next begins."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
