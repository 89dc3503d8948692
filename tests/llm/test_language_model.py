import math
import os
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyarrow import fs

from tidewater.llm import language_model as lm
from tidewater.llm.base import scratch_path, texts_of

from .conftest import SF


def words(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), ""]


class Brute:
    """The same model from dictionaries."""

    def __init__(self, texts):
        self.count, pair = Counter(), Counter()
        for t in texts:
            w = words(t)
            self.count.update(w)
            pair.update(zip(["\n", *w], w))
        self.n, self.v, self.pair = sum(self.count.values()), len(self.count), pair
        self.before = Counter(w for _, w in pair)
        self.total, self.seen = Counter(), defaultdict(Counter)
        for (u, _), c in pair.items():
            self.total[u] += c
            self.seen[u][min(c, 3)] += 1
        cc = lambda values: lm.discounts(np.array([sum(c == k for c in values) for k in (1, 2, 3, 4)]))
        self.d1, self.d2 = cc(self.before.values()), cc(pair.values())
        self.spread = sum(self.d1[min(c, 3) - 1] for c in self.before.values()) / len(pair) if pair else 1.0

    def p(self, w, u):
        less = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0.0
        low = less(self.before[w], self.d1) / max(len(self.pair), 1) + self.spread / (self.v + 1)
        if not self.total[u]:
            return low
        rest = sum(self.d2[k - 1] * n for k, n in self.seen[u].items())
        return (less(self.pair[u, w], self.d2) + rest * low) / self.total[u]

    def score(self, t):
        w = words(t)
        base = sum(math.log10((self.count[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in w)
        return len(w), sum(self.count[x] > 0 for x in w), base, sum(math.log10(self.p(x, u)) for u, x in zip(["\n", *w], w))


def same(got, rows):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    brute = Brute([r.text for r in rows if not held(r.doc_id)])
    key = lambda x: (x[0] is not None, x[0] or 0, x[3])
    want = sorted(((r.doc_id, held(r.doc_id), *brute.score(r.text)) for r in rows), key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.base_score, r.score) for r in got), key=lambda x: (x[0] is not None, x[0] or 0, x[2]))
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert a[:4] == b[:4] and math.isclose(a[4], b[4], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(a[5], b[5], rel_tol=1e-9, abs_tol=1e-9)
    return brute


@pytest.mark.parametrize("range_bytes,fan", [(32 << 20, 256), (20_000, 256), (20_000, 2)])
def test_query_like_dictionaries(spark, docs, edges, table_dir, monkeypatch, range_bytes, fan):
    monkeypatch.setattr(lm, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(lm, "FAN", fan)
    rows = docs.select("doc_id", "text").limit(120).unionByName(edges.select("doc_id", "text"))
    sf = table_dir(documents=rows)
    got = lm.op8_language_model(spark, sf).collect()
    brute = same(got, rows.collect())
    assert {r.train_tokens for r in got} == {brute.n}
    # Probabilities of all words and the unknown one add up to 1 in any context.
    for u in ("\n", "the", "word", "never seen"):
        assert math.isclose(sum(brute.p(w, u) for w in [*brute.count, "unknown!"]), 1, rel_tol=1e-9)


def test_frequent_words_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_BYTES", 500)
    rows = spark.createDataFrame([(i, " ".join(f"the w{(i * j) % 97}" for j in range(30))) for i in range(60)], "doc_id long, text string")
    model = lm.train(texts_of(rows, "doc_id", "text"), scratch_path(spark, "model"))
    assert len(model.wide) >= 1 and model.parts > 5
    brute = Brute([r.text for r in rows.collect()])
    text = "the w3 w5 the the zzz w3"
    got = lm.score_batch(model, pa.array([text, ""]))
    assert np.allclose([got["score"][0], got["score"][1]], [brute.score(text)[3], brute.score("")[3]])


def test_no_training_rows_and_empty(spark, empty, table_dir):
    model = lm.train(texts_of(empty, "doc_id", "text"), scratch_path(spark, "model"))
    got = lm.score_batch(model, pa.array(["a b", ""]))
    assert got["score"].tolist() == [0, 0] and got["n_tokens"].tolist() == [3, 1] and got["base_score"].tolist() == [0, 0]
    assert lm.op8_language_model(spark, table_dir(documents=empty)).count() == 0


def test_counts_that_32_bits_cannot_hold(spark, monkeypatch):
    """With a smaller most, so that a few repeats are over it: they are read from 64 bits."""
    monkeypatch.setattr(lm, "MOST", 5)
    rows = spark.createDataFrame([(i, "a b c " * 20) for i in range(40)], "doc_id long, text string")
    model = lm.train(texts_of(rows, "doc_id", "text"), scratch_path(spark, "model"))
    brute = Brute([r.text for r in rows.collect()])
    got = lm.score_batch(model, pa.array(["a b c a b x"]))
    assert np.isclose(got["score"][0], brute.score("a b c a b x")[3])


def test_tokens_like_words():
    texts = ["", " a", "A b\tC", "x" * 9000 + " É é", "a\x1cb \u3000 c"]
    h, n = lm.tokens(pa.array(["q"] + texts)[1:])
    of, at = {}, 0
    for t, k in zip(texts, n.tolist()):
        assert k == len(words(t))
        for w, x in zip(words(t), h[at : at + k].tolist()):
            assert of.setdefault(w, x) == x
        at += k
    assert at == len(h) and len(set(of.values())) == len(of)


def test_folders_that_hadoop_names():
    system, path = lm._system("s3a://key:secret@bucket/folder?region=us-east-1")
    assert system.type_name == "s3" and path == "bucket/folder"


@pytest.mark.parametrize("mounted", [True, False])
def test_open_files_do_not_grow_with_the_number_of_shards(tmp_path, monkeypatch, mounted):
    """A map holds a file descriptor: at four files a range the usual limit of 1024 was met at about 6 GB of input."""
    for i in range(700):
        lm._put(str(tmp_path), f"words-{i}", np.arange(i, dtype="<u8"))
    if not mounted:
        monkeypatch.setattr(lm, "_system", lambda uri: (fs.SubTreeFileSystem(uri, fs.LocalFileSystem()), ""))
    before = len(os.listdir("/proc/self/fd"))
    for _ in range(2):
        for i in range(700):
            assert np.array_equal(lm._mapped(str(tmp_path), f"words-{i}").view("<u8"), np.arange(i))
    assert len(os.listdir("/proc/self/fd")) - before < 300
    if not mounted:  # copied once, though mapped again
        for i in range(700):
            os.remove(tmp_path / f"words-{i}")
        assert np.array_equal(lm._mapped(str(tmp_path), "words-3").view("<u8"), np.arange(3))


def test_mapped_bytes_are_bounded(tmp_path):
    for i in range(20):
        lm._put(str(tmp_path), f"pairs-{i}", np.full(2 << 20, i, "<u8"))
    for i in range(20):
        assert lm._mapped(str(tmp_path), f"pairs-{i}").view("<u8")[-1] == i
    with open("/proc/self/maps") as maps:
        held = {line.split()[-1] for line in maps if str(tmp_path) in line}
    assert 0 < len(held) <= 8


def test_scores_while_few_files_are_mapped(spark, monkeypatch):
    monkeypatch.setattr(lm, "RANGE_BYTES", 500)
    rows = spark.createDataFrame([(i, " ".join(f"the w{(i * j) % 97}" for j in range(30))) for i in range(60)], "doc_id long, text string")
    model = lm.train(texts_of(rows, "doc_id", "text"), scratch_path(spark, "model"))
    brute = Brute([r.text for r in rows.collect()])
    texts = ["the w3 w5 the the zzz w3", "", "w1 w2"]
    for files in (1, 2, 5):
        monkeypatch.setattr(lm, "MAPPED_FILES", files)
        assert np.allclose(lm.score_batch(model, pa.array(texts))["score"], [brute.score(t)[3] for t in texts])


def test_blocks_are_bounded():
    """Blocks that hold many ranges are cut a bounded number of keys at a time, and none is lost."""
    keys = np.arange(400_000, dtype="<u8")
    rows = [((keys + np.uint64(i * len(keys))).tobytes(), np.full(len(keys), i + 1, "<u4").tobytes()) for i in range(8)]
    batch = pa.RecordBatch.from_arrays([pa.array(["words"] * 8), pa.array([0] * 8, pa.int32()), *(pa.array(list(x), pa.binary()) for x in zip(*rows))], names=["kind", "part", "keys", "counts"])
    got = list(lm._cut(lambda kind, k: (k % np.uint64(2)).astype(np.int64), 1)(iter([batch])))
    blocks = [(r["part"], np.frombuffer(r["keys"], "<u8"), np.frombuffer(r["counts"], "<u4")) for b in got for r in b.to_pylist()]
    assert max(len(k) for _, k, _ in blocks) <= 500_000
    assert all((k % 2 == p).all() and (c == k // 400_000 + 1).all() for p, k, c in blocks)
    assert np.array_equal(np.sort(np.concatenate([k for _, k, _ in blocks])), np.arange(3_200_000))
