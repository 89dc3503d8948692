import random
from collections import Counter

import numpy as np
import pyarrow as pa

from tidewater.llm import token_counts, word_bpe
from tidewater.llm.base import tokenizer_path, word_tokenizer

from .conftest import SF


def expected(rows):
    library = word_tokenizer(tokenizer_path(token_counts.VOCABULARY))
    return Counter((r.doc_id, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in rows)


def test_edges(edges, empty):
    assert Counter(map(tuple, token_counts.count_tokens(edges).collect())) == expected(edges.collect())
    assert token_counts.count_tokens(empty).count() == 0


def test_query_on_whole_table(spark, docs):
    got = token_counts.op7_token_counts(spark, SF).collect()
    assert all(r.over_limit == (r.n_tokens > 2048) for r in got)
    assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == expected(docs.collect())


def odd_texts(n):
    rnd = random.Random(1)
    parts = ["'", "s", "t", "re", "ve", "ll", "m", "d", "S", "LL", " ", "  ", "\n", "1", "23", ",", ".", "!", "a", "bc", "X", "-", "é", "É", "漢", "\u3000", "\x1c", "<|", "|>", "\xa0", "İ", "Σ", "ς", "\u0301", "<|endoftext|>", "\x85", "ß", "²", "×", "÷", "À", "Þ", "ÿ", "Ã", "ñ"]
    return ["", word_bpe.PROBE, "x" * 9000, "x" * 9000 + " y"] + ["".join(rnd.choice(parts) for _ in range(rnd.randrange(60))) for _ in range(n)]


def test_units_and_both_tiers_like_the_library():
    path = tokenizer_path(token_counts.VOCABULARY)
    of, texts = word_bpe.vocabulary(path), odd_texts(3000)
    want = of.ids(texts)
    assert of.cuts and of.lower
    # A cache that is cleared again and again, and one that isn't.
    for bits in (8, 20):
        cache = word_bpe.UnitCache(path, bits)
        for i in range(0, len(texts), 500):
            ids, at = cache.encode(pa.array(texts)[i : i + 500], 1)
            assert all(ids[at[k] : at[k + 1]].tolist() == [*want[i + k], 1] for k in range(len(at) - 1))
    table = token_counts.frequent_lengths(path)
    assert table.size > 20_000
    assert token_counts.LengthCache(path).counts(pa.array(texts), table).tolist() == [len(w) for w in want]
    # Whatever the first tier says is used: the second only sees what it lacks.
    for values in table.values:
        values += 100
    assert token_counts.LengthCache(path).counts(pa.array(["the Cat"]), table).tolist() == [202]


def test_a_tokenizer_that_cannot_be_cut():
    cache = word_bpe.UnitCache(tokenizer_path(token_counts.VOCABULARY))
    texts = pa.array(odd_texts(50))
    want = cache.encode(texts)[0].tolist()
    cache.of.cuts = False
    try:
        assert cache.encode(texts)[0].tolist() == want
    finally:
        cache.of.cuts = True


def test_hash_table():
    keys = np.unique(np.random.default_rng(0).integers(1, 2**63, 3000).astype(np.uint64))
    table = word_bpe.HashTable(12)
    table.add(keys, np.arange(len(keys), dtype=np.int32))
    found = table.find(keys)
    assert set(found[found >= 0] - np.flatnonzero(found >= 0)) == {0} and (found >= 0).mean() > 0.9
    assert (table.find(keys + np.uint64(1)) < 0).all()
