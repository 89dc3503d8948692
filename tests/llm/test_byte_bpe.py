import base64
import hashlib
import struct
from collections import Counter

import pytest
import tiktoken

import public_tokenizers as P
from tidewater.llm import byte_bpe

from .conftest import SF


@pytest.fixture(scope="module")
def library():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path(byte_bpe.RANKS), "rb"))}
    return tiktoken.Encoding("plain", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def expected(library, doc_id, text):
    ids = library.encode_ordinary(text or "")
    return (doc_id, len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest())


@pytest.mark.parametrize("chunk,overlap", [(1 << 15, 1 << 10), (64, 16), (97, 40), (1000, 8)])
def test_any_chunks_give_the_ids_of_the_whole_text(spark, docs, edges, library, chunk, overlap):
    rows = docs.select("doc_id", "text").limit(40).unionByName(edges.select("doc_id", "text"))
    rows = spark.createDataFrame(rows.collect(), rows.schema)
    got = byte_bpe.digests(byte_bpe.encode(rows, chunk_chars=chunk, overlap=overlap)).collect()
    assert Counter(map(tuple, got)) == Counter(expected(library, *r) for r in rows.collect())


@pytest.mark.parametrize("overlap", [0, 8])
def test_a_very_long_text_in_many_pieces(spark, library, overlap):
    """1,500,000 characters of one to four bytes, in 750 chunks, and a run of one character without any seam."""
    rows = [(1, "Straße 12 \U0001f600 naïve, tide's\n\n  " * 48_000), (2, "x" * 20_000), (None, "Straße 12 \U0001f600 naïve, tide's\n\n  " * 300)]
    got = byte_bpe.digests(byte_bpe.encode(spark.createDataFrame(rows, "doc_id long, text string"), chunk_chars=2000, overlap=overlap)).collect()
    assert Counter(map(tuple, got)) == Counter(expected(library, *r) for r in rows)


def test_query_on_whole_table(spark, docs, library):
    got = byte_bpe.op3_byte_bpe(spark, SF).collect()
    assert Counter(map(tuple, got)) == Counter(expected(library, r.doc_id, r.text) for r in docs.collect())


def test_round_trip_and_empty(spark, edges, empty):
    back = byte_bpe.decode(byte_bpe.encode(edges, chunk_chars=500, overlap=50))
    assert Counter((r.doc_id, bytes(r.content).decode()) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in edges.collect())
    assert byte_bpe.encode(empty).count() == 0
