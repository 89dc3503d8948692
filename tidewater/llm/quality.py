"""Quality classifier: a regularised quadratic discriminant over statistics of whole texts.

Statistics are transformed to be near normal: logarithms of lengths, square roots of shares. Each class has a mean and
a covariance, shrunk to the pooled one and then to its diagonal. The covariances are factored once, and the workers
hold the factors; the score is the logistic of the difference of the classes' log densities, from Mahalanobis distances
by way of these factors, and their log priors, divided by a temperature.

What is learned comes from sums over all labelled rows of the training folds, added up in Spark; no row is sampled. How
far the covariances are shrunk, and the temperature, is learned too: for each choice of CHOICES a model is made without
one of the training folds, in turn, and the choice with the least log loss on the folds left out is taken.
Neither labels nor language, source or id are among the statistics.

Defined results: a null text counts as empty and is scored like any; a null id belongs to the held-out fold; equal rows
each get the same score; labels that are null or contradict each other teach nothing; where only one class has
examples, every score is that class; where none has, every score is 1. Other columns are kept by scored(), ignored by
the query. An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import discard, map_batches, plus, read_table, texts_of, written

#: Frequent function words of the languages of the corpus.
FUNCTION_WORDS = frozenset("the of and to in is that it for on with as by this be are at from or an not a le la les de des du et en un une que qui pour dans est pas par sur au avec ce il elle der die das und von zu mit den dem ist im auf für nicht ein eine sich el los las y del se por con una su para al es lo como".split())
FEATURES = ["bytes", "words", "upper", "digits", "symbols", "punctuation", "distinct", "repeats", "function", "capitals", "alphabetic", "lines", "same_lines", "word_mean", "word_spread", "stops", "entropy", "word_most"]
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.3
#: Shrinkage to the pooled covariance and to the diagonal; the first is used where folds can't be left out.
CHOICES = [(a, b) for a in (0.3, 0.1, 0.6, 0.9) for b in (0.05, 0.2, 0.5)]
TEMPERATURES = (4.0, 1.0, 2.0, 8.0)
#: Labels that go along with every task, 8 bytes each; more are joined by a shuffle.
BROADCAST_LABELS = 1_000_000

_CLASS = np.full(256, 7)
for _kind, _chars in ((1, "abcdefghijklmnopqrstuvwxyz"), (2, "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), (3, "0123456789"), (4, " \t\r\x0b\x0c"), (5, "\n"), (6, ".,;:'\"?-()")):
    _CLASS[[ord(c) for c in _chars]] = _kind
_CLASS[128:] = 1


def statistics(text: str) -> list[float]:
    """The transformed statistics of a text, in the order of FEATURES."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(b)
    count = np.bincount(b, minlength=256)
    kind = np.bincount(_CLASS, count, minlength=8)
    words = text.split()
    m = len(words)
    lines = [line for line in text.split("\n") if line and not line.isspace()]
    length = np.fromiter(map(len, words), np.int64, m) if m else np.zeros(1, np.int64)
    share = count[count > 0] / max(n, 1)

    def root(part: float, whole: float) -> float:
        return (part / (whole + 1)) ** 0.5

    return [
        np.log1p(n), np.log1p(m), root(kind[2], kind[1] + kind[2]), root(kind[3], n), root(kind[7], n), root(kind[6], n), np.log((len(set(words)) + 1) / (m + 1) ** 0.75),
        root(sum(map(str.__eq__, words[1:], words)), m), root(sum(map(FUNCTION_WORDS.__contains__, map(str.lower, words))), m), root(sum(map(str.isupper, words)), m), root(sum(map(str.isalpha, words)), m),
        np.log((len(lines) + 1) / (m + 1)), root(len(lines) - len(set(lines)), len(lines)), np.log1p(length.mean()), np.log1p(length.std()), root(count[ord(".")], m), float(-(share * np.log2(share)).sum()), np.log1p(length.max()),
    ]


@dataclass(frozen=True)
class Discriminant:
    """For class 0 and 1: mean, inverse of the covariance's Cholesky factor, log of its root determinant less log prior. None: no examples."""

    classes: tuple
    temperature: float = TEMPERATURES[0]

    def against(self, x: np.ndarray) -> np.ndarray:
        """The log odds of class 0, before the temperature."""
        bad, good = ([-0.5 * (((x - mean) @ inverse.T) ** 2).sum(1) - rest for mean, inverse, rest in self.classes])
        return bad - good

    def scores(self, x: np.ndarray) -> np.ndarray:
        bad, good = self.classes
        if bad is None or good is None:
            return np.full(len(x), 0.0 if good is None and bad is not None else 1.0)
        return 1 / (1 + np.exp(np.clip(self.against(x) / self.temperature, -500, 500)))


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))), F.lit(FOLDS))


def features(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, x): the statistics of each whole text."""
    docs = texts_of(df, id_col, text_col)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            x = [statistics(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(x, pa.list_(pa.float64()))], names=["doc_id", "x"])

        return one

    return map_batches(docs, make, plus(docs.select("doc_id"), "x array<double>"))


def usable(labels: DataFrame) -> DataFrame:
    """(doc_id, label) of the training folds, where labels don't contradict each other."""
    own = labels.select("doc_id", F.col("quality").cast("int").alias("label")).filter("label in (0, 1)")
    return own.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("most")).filter("label = most").drop("most").filter(fold(F.col("doc_id")) != HELD_OUT)


def labelled(df: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The rows of df that fit() can learn from, so that nothing is computed of the others."""
    ids = usable(labels).select(F.col("doc_id").alias("__labelled"))
    few = ids.limit(BROADCAST_LABELS + 1).count() <= BROADCAST_LABELS
    return df.join(F.broadcast(ids) if few else ids, F.col(id_col) == F.col("__labelled"), "left_semi")


def discriminant(total: np.ndarray, to_pooled: float, to_diagonal: float, temperature: float = TEMPERATURES[0]) -> Discriminant:
    """A model from the numbers, sums and sums of products of both classes: (2, 1 + d + d * d)."""
    d = len(FEATURES)
    n, mean, cross = total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d)
    mean = mean / np.maximum(n, 1)[:, None]
    covariance = [cross[k] / max(n[k], 1) - np.outer(mean[k], mean[k]) for k in (0, 1)]
    pooled = (n[0] * covariance[0] + n[1] * covariance[1]) / max(n.sum(), 1)
    classes = []
    for k in (0, 1):
        if not n[k]:
            classes.append(None)
            continue
        c = (1 - to_pooled) * covariance[k] + to_pooled * pooled
        c = (1 - to_diagonal) * c + to_diagonal * np.diag(np.diag(pooled)) + 1e-6 * np.eye(d)
        factor = np.linalg.cholesky(c)
        classes.append((mean[k], np.linalg.inv(factor), np.log(np.diag(factor)).sum() - np.log(n[k] / n.sum())))
    return Discriminant(tuple(classes), temperature)


def fit(x: DataFrame, labels: DataFrame) -> Discriminant:
    """Learns from (doc_id, x) and (doc_id, quality), without the held-out fold."""
    rows = x.withColumn("fold", fold(F.col("doc_id")).cast("int")).filter(F.col("fold") != HELD_OUT).join(usable(labels), "doc_id").select("fold", "label", "x")
    rows = written(rows, "quality-labelled")
    d = len(FEATURES)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((FOLDS, 2, 1 + d + d * d))
        for batch in batches:
            of, label = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("fold", "label"))
            z = np.array(batch.column("x").to_pylist()).reshape(-1, d)
            for f, k in set(zip(of.tolist(), label.tolist())):
                own = z[(of == f) & (label == k)]
                total[f, k] += np.concatenate([[len(own)], own.sum(0), (own.T @ own).ravel()])
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel()[at])], names=["at", "value"])

    def added(made: DataFrame, size: int) -> np.ndarray:
        out = np.zeros(size)
        for at, value in made.groupBy("at").agg(F.sum("value")).collect():  # at most `size` rows, whatever the number of labels
            out[at] = value
        return out

    total = added(rows.mapInArrow(sums, "at long, value double"), FOLDS * 2 * (1 + d + d * d)).reshape(FOLDS, 2, -1)
    whole = total.sum(0)
    train = [f for f in range(FOLDS) if f != HELD_OUT]
    without = {f: whole - total[f] for f in train}
    choice, temperature = CHOICES[0], TEMPERATURES[0]
    if all(without[f][:, 0].min() > 0 for f in train):
        shared = x.sparkSession.sparkContext.broadcast({f: [discriminant(without[f], *c) for c in CHOICES] for f in train})

        def losses(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            loss = np.zeros((len(CHOICES), len(TEMPERATURES)))
            for batch in batches:
                of, label = (np.array(batch.column(c).to_pylist(), np.int64) for c in ("fold", "label"))
                z = np.array(batch.column("x").to_pylist()).reshape(-1, d)
                for f in np.unique(of).tolist():
                    sign = np.where(label[of == f] == 1, 1, -1)
                    for i, model in enumerate(shared.value[f]):
                        odds = model.against(z[of == f]) * sign
                        for j, t in enumerate(TEMPERATURES):
                            loss[i, j] += np.logaddexp(0, odds / t).sum()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(loss.size)), pa.array(loss.ravel())], names=["at", "value"])

        loss = added(rows.mapInArrow(losses, "at long, value double"), len(CHOICES) * len(TEMPERATURES))
        i, j = divmod(int(loss.argmin()), len(TEMPERATURES))
        choice, temperature = CHOICES[i], TEMPERATURES[j]
    discard(rows)
    return discriminant(whole, *choice, temperature)


def scored(df: DataFrame, model: Discriminant, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """df with the score of each text; all other columns stay."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def score(texts):
        import pandas as pd

        return pd.Series(shared.value.scores(np.array([statistics(t or "") for t in texts]).reshape(-1, len(FEATURES))))

    return df.withColumn(score_col, F.pandas_udf(score, "double")(F.col(text_col)))


def classify(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row."""
    x = written(features(df, id_col, text_col), "quality-features")
    shared = df.sparkSession.sparkContext.broadcast(fit(x, labels))

    def score(batch):
        import pandas as pd

        return pd.Series(shared.value.scores(np.array(batch.tolist()).reshape(-1, len(FEATURES))))

    done = x.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), F.pandas_udf(score, "double")("x").alias("score"))
    return done.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of documents scored."""
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
