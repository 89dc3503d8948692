"""Each stage by itself, on odd rows and against brute force, and all of them in a row."""

import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tidewater.llm import packing, quality  # noqa: E402

from .conftest import SF  # noqa: E402
from .test_near_dedup import all_pairs, classes_of  # noqa: E402
from .test_packing import check  # noqa: E402

STAGES = dict(corpus_pipeline.STAGES)
CLASHING = "doc_id long, text string, n_chars long, kept boolean, class_id string, row_id long, digest binary, payload string, score double, node string"


@pytest.fixture(scope="module")
def rows(spark, edges):
    """Odd rows with columns whose names the stages use within, ties, repeated rows and near copies."""
    words = [f"w{i}" for i in range(120)]
    texts = [(r.doc_id, r.text) for r in edges.select("doc_id", "text").collect()]
    texts += [(50, " ".join(words)), (49, " ".join([*words[:-1], "other"])), (48, " ".join(["x", *words])), (51, "mail a.b@c.org or 10.1.2.3"), (52, "mail a.b@c.org or 10.1.2.3"), (None, None), (None, "lost")]
    return spark.createDataFrame([(i, t, None if t is None else len(t), i == 5, "c", 7, b"d", "p", 0.1, "n") for i, t in texts], CLASHING)


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    """Tables of which the labels are for these rows."""
    path = tmp_path_factory.mktemp("sf")
    labels = [(1, 1, 0), (4, 0, 0), (6, 1, 0), (9, 0, 0), (10, None, 0), (12, 0, 0), (13, 0, 1), (48, 1, 0), (49, 1, 0), (50, 1, 0), (51, 1, 0)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def key(r):
    return (r.doc_id, r.text)


def test_the_stages_and_their_order():
    assert list(STAGES) == ["quality", "exact_dedup", "near_dedup", "pii", "packing"]


@pytest.mark.parametrize("name", ["quality", "exact_dedup", "near_dedup", "pii"])
def test_columns_stay_and_an_empty_table_gives_one(spark, rows, sf, name):
    out = STAGES[name](spark, rows, sf)
    assert out.columns == rows.columns and dict(out.dtypes) == dict(rows.dtypes)
    whole = Counter(map(tuple, rows.drop("text", "n_chars").collect()))
    assert not Counter(map(tuple, out.drop("text", "n_chars").collect())) - whole
    assert STAGES[name](spark, rows.limit(0), sf).collect() == []


def test_quality_drops_what_scores_low(spark, rows, sf):
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    model = quality.fit(quality.features(rows), labels)
    score = dict(zip([t or "" for (t,) in rows.select("text").collect()], [r.s for r in quality.scored(rows, model, score_col="s").select("s").collect()]))
    want = Counter(key(r) for r in rows.collect() if score[r.text or ""] >= quality.THRESHOLD)
    assert Counter(map(key, STAGES["quality"](spark, rows, sf).collect())) == want and 0 < want.total() < rows.count()


def test_exact_keeps_the_smallest_id(spark, rows, sf):
    groups = defaultdict(list)
    for r in rows.collect():
        groups[re.sub("[\x20\x09-\x0d]+", " ", r.text or "")].append(r.doc_id)
    got = [(r.doc_id, re.sub("[\x20\x09-\x0d]+", " ", r.text or "")) for r in STAGES["exact_dedup"](spark, rows, sf).collect()]
    assert Counter(got) == Counter((min((i for i in ids if i is not None), default=None), t) for t, ids in groups.items())


def test_near_keeps_one_of_each_class(spark, rows, sf):
    all_rows = rows.collect()
    texts = [r.text or "" for r in all_rows]
    classes = defaultdict(list)
    for r, c in zip(all_rows, classes_of(len(texts), [p for p, x in all_pairs(texts).items() if x >= 0.8])):
        classes[c].append(r)
    got = STAGES["near_dedup"](spark, rows, sf).collect()
    want = Counter(min((r.doc_id for r in c if r.doc_id is not None), default=None) for c in classes.values())
    assert Counter(r.doc_id for r in got) == want and not {49, 50} & {r.doc_id for r in got} and 48 in {r.doc_id for r in got}


def test_pii_replaces_and_counts_again(spark, rows, sf):
    got = STAGES["pii"](spark, rows, sf).collect()
    assert len(got) == rows.count() and all((r.text is None) == (r.n_chars is None) and (r.text is None or r.n_chars == len(r.text)) for r in got)
    a, b = (next(r.text for r in got if r.doc_id == i) for i in (51, 52))
    assert a == b and re.fullmatch(r"mail [a-z]+\.[a-z]+@[a-z]+\.org or \d+\.\d+\.\d+\.\d+", a) and "a.b@c.org" not in a and "10.1.2.3" not in a
    assert Counter(r.text for r in got if r.doc_id not in (51, 52)) == Counter(r.text for r in rows.collect() if r.doc_id not in (51, 52))


def test_packing_packs_every_row(spark, rows, sf):
    check(STAGES["packing"](spark, rows, sf).collect(), rows.collect())


def test_all_stages_in_a_row(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    left = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        left = spark.createDataFrame(stage(spark, left, SF).collect(), docs.schema)
        assert 0 < left.count() <= docs.count()
    got = corpus_pipeline.run(spark, SF).collect()
    check(got, left.collect())
    pieces = lambda found: Counter((p.doc_id, p.start + p.length) for p in found if p.start + p.length == p.doc_tokens)
    assert pieces(got) == pieces(packing.pack(left).collect())
    assert left.filter(F.col("n_chars") != F.length("text")).isEmpty()
