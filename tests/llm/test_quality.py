import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.llm import quality

SF = "/root/testdata/sf0.01"


def test_query_on_whole_table(spark):
    got = {r.doc_id: r for r in quality.op5_quality(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()
    assert got.keys() == {r.doc_id for r in docs}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for i, r in got.items())
    held = [(got[r.doc_id].predicted, r.quality) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if got[r.doc_id].held_out]
    assert np.mean([a == b for a, b in held]) > 0.93


def test_moments_are_those_of_all_training_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.fit(quality.features(docs), labels)
    text = {r.doc_id: r.text for r in docs.collect()}
    train = [(r.quality, quality.statistics(text[r.doc_id])) for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5]
    for k in (0, 1):
        assert np.allclose(model.classes[k][0], np.mean([x for q, x in train if q == k], 0))


def dense(train, choice, temperature, x):
    """The same scores from numpy's own covariances, solves and determinants."""
    n = len(train)
    groups = [np.array([z for q, z in train if q == k]) for k in (0, 1)]
    covariance = [np.cov(g, rowvar=False, bias=True) for g in groups]
    pooled = sum(len(g) * c for g, c in zip(groups, covariance)) / n
    density = []
    for g, c in zip(groups, covariance):
        c = (1 - choice[0]) * c + choice[0] * pooled
        c = (1 - choice[1]) * c + choice[1] * np.diag(np.diag(pooled)) + 1e-6 * np.eye(len(c))
        off = x - g.mean(0)
        density.append(-0.5 * np.einsum("ij,ij->i", off, np.linalg.solve(c, off.T).T) - 0.5 * np.linalg.slogdet(c)[1] + np.log(len(g) / n))
    return 1 / (1 + np.exp(np.clip((density[0] - density[1]) / temperature, -500, 500)))


def test_like_a_dense_discriminant_with_its_own_cross_validation(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    text = {r.doc_id: r.text for r in docs.collect()}
    of = {i: zlib.crc32(str(i).encode()) % 5 for i in text}
    x = {i: quality.statistics(t) for i, t in text.items()}
    rows = [(r.doc_id, r.quality) for r in labels.collect() if of[r.doc_id]]
    loss = {}
    for c in quality.CHOICES:
        for t in quality.TEMPERATURES:
            for f in range(1, 5):
                own = [(i, q) for i, q in rows if of[i] == f]
                p = dense([(q, x[i]) for i, q in rows if of[i] != f], c, t, np.array([x[i] for i, _ in own]))
                loss[c, t] = loss.get((c, t), 0) - sum(np.log(max(v if q else 1 - v, 1e-300)) for v, (_, q) in zip(p, own))
    choice, temperature = min(loss, key=loss.get)
    got = {r.doc_id: r.score for r in quality.op5_quality(spark, SF).collect()}
    ids = sorted(got)
    assert np.allclose(dense([(q, x[i]) for i, q in rows], choice, temperature, np.array([x[i] for i in ids])), [got[i] for i in ids], atol=1e-6)
    held = [(got[r.doc_id], r.quality) for r in labels.collect() if not of[r.doc_id]]
    good, bad = ([s for s, q in held if q == k] for k in (1, 0))
    assert np.mean([(a > b) + 0.5 * (a == b) for a in good for b in bad]) > 0.95  # the area under the curve


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_only_what_has_a_label_is_read_for_learning(spark, monkeypatch, most):
    monkeypatch.setattr(quality, "BROADCAST_LABELS", most)
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    some = quality.labelled(docs, labels)
    assert {r.doc_id for r in some.collect()} == {r.doc_id for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5}
    assert np.allclose(quality.fit(quality.features(some), labels).classes[1][1], quality.fit(quality.features(docs), labels).classes[1][1])


def test_edges(spark, edges, empty):
    labels = spark.createDataFrame([(1, 1), (4, 0), (6, 1), (10, None), (11, 0), (11, 1), (9, 0), (12, 1), (13, 1), (13, 1)], "doc_id long, quality int")
    got = quality.classify(edges, labels).collect()
    assert len(got) == edges.count() and all(0 <= r.score <= 1 for r in got)
    assert quality.classify(empty, labels).count() == 0
    assert {r.score for r in quality.classify(edges, labels.limit(0)).collect()} == {1.0}
    assert {r.score for r in quality.classify(edges, labels.filter("quality = 0 and doc_id = 9")).collect()} <= {0.0, 1.0}
    kept = quality.scored(edges, quality.fit(quality.features(edges), labels), score_col="s2")
    assert kept.columns == [*edges.columns, "s2"] and kept.filter(F.col("s2").isNull()).count() == 0
