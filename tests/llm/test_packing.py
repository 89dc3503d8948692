import struct
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tidewater.llm import packing
from tidewater.llm.base import tokenizer_path, word_tokenizer

from .conftest import SF


def ids_of(text):
    library = word_tokenizer(tokenizer_path(packing.VOCABULARY))
    return [*library.encode(text or "", add_special_tokens=False).ids, 1]


def check(pieces, rows, window=2048):
    want = defaultdict(list)
    for r in rows:
        want[r.doc_id].append(ids_of(r.text))
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_sequence[p.sequence_id].append(p)
    assert by_doc.keys() == want.keys()
    for doc, texts in want.items():
        spans = sorted((p.start, p.length, p.ids_crc32, p.doc_tokens) for p in by_doc[doc])
        full = sum(map(len, texts))
        assert sum(s[1] for s in spans) == full
        if len(texts) == 1:
            at = 0
            for start, length, crc, n in spans:
                assert start == at and n == full
                assert crc == zlib.crc32(struct.pack(f"<{length}I", *texts[0][start : start + length]))
                at += length
    padding = 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at and p.length > 0
            at += p.length
        assert at <= window
        padding += window - at
    assert padding < window


def test_edges(edges, empty):
    check(packing.pack(edges).collect(), edges.collect())
    assert packing.pack(empty).count() == 0


def test_query_on_whole_table(spark, docs):
    check(packing.op10_packing(spark, SF).collect(), docs.collect())


def test_one_length_in_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 7)
    rows = spark.createDataFrame([(i, "the cat sat on the mat") for i in range(400)] + [(400 + i, "dog " * (i % 90)) for i in range(300)], "doc_id long, text string")
    check(packing.pack(rows, window=64).collect(), rows.collect(), 64)


def test_plan_uses_no_length_more_often_than_it_occurs():
    rng = np.random.default_rng(1)
    h = rng.poisson(40, 256)
    h[0], h[100] = 0, 5000
    to = packing.plan(h, 256)
    assert (to["taken"] <= h).all() and to["n"] > 2000
    assert to["placed"].sum() == h.sum() and to["placed"][0] > 0.5 * (h.sum() - 5000)
    columns, x, _ = packing.solve_counts(h.astype(float), packing.combinations(np.flatnonzero(h), 256))
    assert (columns.sum(1) == 256).all() and (x >= 0).all()


def brute_nnls(a, b):
    """Lawson and Hanson's algorithm."""
    n = a.shape[1]
    x, passive = np.zeros(n), np.zeros(n, bool)
    while True:
        w = a.T @ (b - a @ x)
        w[passive] = 0
        if w.max(initial=0) < 1e-9:
            return x
        passive[w.argmax()] = True
        while True:
            z = np.zeros(n)
            z[passive] = np.linalg.lstsq(a[:, passive], b, rcond=None)[0]
            bad = passive & (z <= 1e-12)
            if not bad.any():
                break
            x += min(x[bad] / (x[bad] - z[bad])) * (z - x)
            passive &= x > 1e-12
            x[~passive] = 0
        x = z


@pytest.mark.parametrize("seed", range(6))
def test_solution_is_as_good_as_brute_force(seed):
    rng = np.random.default_rng(seed)
    window = 24 + 4 * seed
    h = (rng.poisson(30, window) * (rng.random(window) < 0.6)).astype(float)
    h[0] = 0
    columns = packing.combinations(np.flatnonzero(h), window)
    a = np.stack([np.bincount(c, minlength=window) for c in columns], 1).astype(float)
    a[0] = 0
    best = np.linalg.norm(a @ brute_nnls(a, h) - h)
    some, x, optimal = packing.solve_counts(h, columns, tolerance=0.01)
    fill = sum(np.bincount(some[:, i], x, window) for i in range(3))
    fill[0] = 0
    assert optimal and np.linalg.norm(fill - h) <= best + 0.2


def test_best_fit_fills_sequences():
    left = np.zeros(64, np.int64)
    left[[40, 20, 4, 3, 30]] = 5, 7, 4, 9, 4
    before = left.copy()
    found = packing.best_fit(left, 64)
    used = np.zeros(64, np.int64)
    for parts, times in found:
        assert sum(parts) == 64 and times > 0
        np.add.at(used, parts, times)
    assert (used + left == before).all() and used[40] == 4


def test_ids_beyond_16_bits(edges, monkeypatch):
    want = sorted(map(tuple, packing.pack(edges, with_ids=True).drop("ids").fillna(-1).collect()))
    monkeypatch.setattr(packing, "id_type", lambda path, end_id: "<u4")
    assert sorted(map(tuple, packing.pack(edges, with_ids=True).drop("ids").fillna(-1).collect())) == want


def test_a_row_repeated_many_times(spark, monkeypatch):
    monkeypatch.setattr(packing, "BUCKET_ROWS", 50)
    rows = spark.createDataFrame([(1, "the cat sat on the mat")] * 700, "doc_id long, text string")
    check(packing.pack(rows, window=64).collect(), rows.collect(), 64)
