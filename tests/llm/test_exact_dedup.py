import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidewater.llm import exact_dedup, filters

from .conftest import SF


def brute(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[re.sub("[\x20\x09-\x0d]+", " ", r.text or "")].append(r.doc_id)
    out = []
    for text, ids in groups.items():
        there = [i for i in ids if i is not None]
        keep, kept = min(there) if there else None, False
        for i in ids:
            out.append((i, keep, len(ids), i == keep and not kept, hashlib.sha256(text.encode()).hexdigest()))
            kept |= i == keep
    return Counter(out)


@pytest.mark.parametrize("digest", [exact_dedup.sha256_digest, lambda text: F.substring(F.unhex(F.sha2(text, 256)), 1, 1), lambda text: F.lit(b"x")])
@pytest.mark.parametrize("memtable", [3, 10_000])
def test_like_brute_force_even_if_digests_collide(spark, docs, edges, digest, memtable):
    rows = docs.select("doc_id", "text").limit(150).unionByName(edges.select("doc_id", "text"))
    rows = rows.unionByName(rows.limit(60).withColumn("doc_id", F.col("doc_id") + 500)).unionByName(rows.limit(20).withColumn("doc_id", F.lit(None).cast("long")))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = exact_dedup.exact_dedup(rows, digest=digest, memtable=memtable).collect()
    assert Counter(map(tuple, got)) == brute(rows.collect())


def test_shuffled_groups_and_small_shares(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 1)
    monkeypatch.setattr(exact_dedup, "SHARE", 2)
    rows = spark.createDataFrame([(i, ["same", "b  c", "b c", f"own {i}"][i % 4]) for i in range(60)], "doc_id long, text string")
    assert Counter(map(tuple, exact_dedup.exact_dedup(rows).collect())) == brute(rows.collect())


def test_filters(spark):
    rng = np.random.default_rng(0)
    some = [rng.bytes(32) for _ in range(3000)]
    bits = filters.build(spark.createDataFrame([(x,) for x in some], "digest binary"), "digest")
    assert filters.might_hold(bits, pa.array(some, pa.binary())).all()
    assert filters.might_hold(bits, pa.array([rng.bytes(32) for _ in range(5000)], pa.binary())).mean() < 0.01


def test_what_the_filter_denies_is_single(spark, monkeypatch):
    """The filter decides what is looked up: if it denied everything, nothing would be found."""
    rows = spark.createDataFrame([(i, f"text {i % 7}") for i in range(60)], "doc_id long, text string")
    assert exact_dedup.exact_dedup(rows).filter("kept").count() == 7
    monkeypatch.setattr(exact_dedup, "HOT_SHARE", 1)
    monkeypatch.setattr(filters, "build", lambda df, column: np.zeros((filters.SEGMENTS, filters.SEGMENT_BITS // 8), np.uint8))
    assert exact_dedup.exact_dedup(rows).filter("kept").count() == 60


def test_query_sql_payload_and_empty(spark, docs, edges, empty):
    got = exact_dedup.op4_exact_dedup(spark, SF)
    with duckdb.connect() as db:
        db.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
        want = db.sql(f"SELECT doc_id, keep_id, group_size, kept, text_sha256 FROM ({exact_dedup.OP4_SQL})").fetchall()
    assert Counter(map(tuple, got.select("doc_id", "keep_id", "group_size", "kept", "text_sha256").collect())) == Counter(want)
    rows = exact_dedup.exact_dedup(edges, payload=edges.columns)
    assert Counter(r.payload.text for r in rows.collect()) == Counter(r.text for r in edges.collect())
    assert exact_dedup.exact_dedup(empty).count() == 0
