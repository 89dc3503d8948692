"""Byte-level BPE encoding and decoding by overlapping chunks.

A text longer than `chunk_chars` is cut into chunks that overlap by `overlap` characters. Chunks are pre-tokenised in
parallel, each from its own start, which need not be a pre-token boundary. Matching always goes on from the end of the
last match, so once two chunks share a boundary they agree from there on. The first boundary that both chunks have in
their overlap is the seam; the pieces between seams are encoded in parallel and their ids put together in order. Where
two chunks share none, the pieces run together, so the result is always that of the whole text. Decoding concatenates
the raw bytes of the ids. Cutting a text, joining its ids and hashing are linear in its length.

Defined results: a null or empty text has no ids; a null doc_id stays null; equal rows each give a row; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import map_batches, plus, read_table, slices, texts_of, tokenizer_path

RANKS = "byte_bpe_50k.tiktoken"
#: White space in the sense of Unicode's White_Space, which is what the pattern's \s means.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: A match that ends closer than this to the end of a chunk might end elsewhere in the whole text.
GUARD = 4
#: Parts of a text that leave a worker at once, and ids that are decoded at once.
PARTS, DECODED = 32, 1 << 16


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """The tiktoken encoding of a rank file and the bytes of each id, once a process."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    raw: list[bytes] = [b""] * (max(ranks.values()) + 1)
    for piece, rank in ranks.items():
        raw[rank] = piece
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), raw


@functools.lru_cache(maxsize=1)
def pre_token_pattern():
    import public_tokenizers
    import regex

    return regex.compile(public_tokenizers.PATTERN)


def decode_ids(ids: list[int], path: str) -> bytes:
    """The raw bytes of the ids, one after the other."""
    return b"".join(map(encoder(path)[1].__getitem__, ids))


def boundaries(chunk: str, last: bool) -> list[int]:
    """Where pre-tokens end in a chunk, without those that the text after it might move."""
    ends = [m.end() for m in pre_token_pattern().finditer(chunk)]
    return ends if last else [e for e in ends if e <= len(chunk) - GUARD]


def _blob(ids: list[int]) -> bytes:
    return np.asarray(ids, dtype="<u4").tobytes()


def _encode_batches(df: DataFrame, keep: list[str], path: str) -> DataFrame:
    """keep columns and `ids` (binary, unsigned 32-bit little-endian) of each row's text."""
    schema = plus(df.select(*keep), "ids binary")

    def make():
        encode = encoder(path)[0].encode_ordinary

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            ids = pa.array([_blob(encode(t)) for t in batch.column("text").to_pylist()], pa.binary())
            return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), ids], names=[*keep, "ids"])

        return one

    return map_batches(df.select(*keep, "text"), make, schema)


def _cut(df: DataFrame, keep: list[str]) -> DataFrame:
    """keep columns, k and text: the part of each row's text from the k-th of its starts to the k-th of its stops.

    In Python, where a slice doesn't count from the start of the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in slices(batch, rows=1):
                text, starts, stops = (row.column(c)[0].as_py() for c in ("text", "starts", "stops"))
                for first in range(0, len(starts), PARTS):
                    some = range(first, min(first + PARTS, len(starts)))
                    same = pa.array(np.zeros(len(some), np.int64))
                    parts = pa.array([text[starts[k] : stops[k]] for k in some], pa.string())
                    yield pa.RecordBatch.from_arrays([*(row.column(c).take(same) for c in keep), pa.array(some, pa.int32()), parts], names=[*keep, "k", "text"])

    return df.select(*keep, "text", "starts", "stops").mapInArrow(run, plus(df.select(*keep), "k int, text string"))


def _seams(long: DataFrame, chunk_chars: int, overlap: int) -> DataFrame:
    """(doc_id, sha, cuts): the positions where the text of each long document can be cut."""
    chunks = long.select("doc_id", "sha", "text", F.length("text").alias("n"))
    chunks = chunks.withColumn("starts", F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk_chars))).withColumn("stops", F.transform("starts", lambda at: at + chunk_chars + overlap))
    chunks = _cut(chunks, ["doc_id", "sha", "n"]).withColumn("last", (F.col("k") + 1).cast("long") * chunk_chars >= F.col("n")).drop("n")
    spread = chunks.repartition("doc_id", "sha", "k")

    def make():
        import regex

        junction = regex.compile(f"[^{SPACE}] ")

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            heads, tails, synced = [], [], []
            for k, last, text in zip(batch.column("k").to_pylist(), batch.column("last").to_pylist(), batch.column("text").to_pylist()):
                ends = boundaries(text, last)
                at = k * chunk_chars
                heads.append([at, *(at + e for e in ends if e < overlap)])
                tails.append([at + e for e in ends if e >= chunk_chars])
                # A space after something else is a boundary wherever matching began.
                found = junction.search(text)
                synced.append(k == 0 or (found is not None and found.end() < chunk_chars))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("sha"), batch.column("k"), pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32())), pa.array(synced)], names=["doc_id", "sha", "k", "head", "tail", "synced"])

        return one

    schema = plus(long.select("doc_id", "sha"), "k int, head array<int>, tail array<int>, synced boolean")
    marks = map_batches(spread, make, schema)
    by = Window.partitionBy("doc_id", "sha").orderBy("k")
    marks = marks.withColumn("cut", F.array_min(F.array_intersect(F.lag("tail").over(by), "head")))
    # A chunk is in step with the whole text if, since the last chunk that is so by itself, each seam was found.
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("lost", F.coalesce(F.max(F.when(F.col("cut").isNull() & (F.col("k") > 0), F.col("k"))).over(so_far), F.lit(-1)))
    marks = marks.withColumn("found", F.coalesce(F.max(F.when(F.col("synced"), F.col("k"))).over(so_far), F.lit(-1)))
    marks = marks.withColumn("in_step", F.lag(F.col("found") >= F.col("lost")).over(by))
    cut = F.when(F.col("in_step"), F.col("cut"))
    return marks.groupBy("doc_id", "sha").agg(F.array_sort(F.array_distinct(F.collect_list(cut))).alias("cuts"))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ranks_path: str | None = None, chunk_chars: int = 1 << 15, overlap: int = 1 << 10) -> DataFrame:
    """(doc_id, ids): the ids of each whole text as unsigned 32-bit little-endian integers."""
    path = ranks_path or tokenizer_path(RANKS)
    docs = texts_of(df, id_col, text_col)
    short = _encode_batches(docs.filter(F.length("text") <= chunk_chars), ["doc_id"], path)
    # Rows alike in id and text go through once; `copies` brings them back.
    long = docs.filter(F.length("text") > chunk_chars).withColumn("sha", F.sha2("text", 256)).groupBy("doc_id", "sha").agg(F.count("*").alias("copies"), F.first("text").alias("text"))
    seams = _seams(long, chunk_chars, overlap).withColumnsRenamed({"doc_id": "seam_id", "sha": "seam_sha"})
    joined = long.join(seams, F.col("doc_id").eqNullSafe(F.col("seam_id")) & (F.col("sha") == F.col("seam_sha")))
    edges = joined.withColumn("starts", F.concat(F.array(F.lit(0)), "cuts")).withColumn("stops", F.concat("cuts", F.array(F.length("text"))))
    pieces = _cut(edges, ["doc_id", "sha", "copies"])
    coded = _encode_batches(pieces.repartition("doc_id", "sha", "k"), ["doc_id", "sha", "copies", "k"], path)
    whole = coded.groupBy("doc_id", "sha", "copies").agg(F.array_sort(F.collect_list(F.struct("k", "ids"))).alias("parts"))
    # To concatenate binaries one by one would copy all that is there for each piece; joining texts copies once.
    ids = F.unhex(F.array_join(F.transform("parts", lambda part: F.hex(part["ids"])), ""))
    long_ids = whole.select("doc_id", ids.alias("ids"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return short.unionByName(long_ids)


def decode(coded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, ids, content): the bytes that the ids stand for."""
    path = ranks_path or tokenizer_path(RANKS)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            content = [decode_ids(np.frombuffer(x, "<u4").tolist(), path) for x in batch.column("ids").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("ids"), pa.array(content, pa.binary())], names=["doc_id", "ids", "content"])

        return one

    coded = coded.select("doc_id", "ids")
    return map_batches(coded, make, plus(coded, "content binary"))


def digests(coded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): decodes the ids where they are and returns digests alone."""
    path = ranks_path or tokenizer_path(RANKS)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n, ids_sha, sha = [], [], []
            for blob in batch.column("ids").to_pylist():
                ids = np.frombuffer(blob, "<u4")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(blob).hexdigest())
                content = hashlib.sha256()
                for at in range(0, len(ids), DECODED):
                    content.update(decode_ids(ids[at : at + DECODED].tolist(), path))
                sha.append(content.hexdigest())
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

        return one

    coded = coded.select("doc_id", "ids")
    return map_batches(coded, make, plus(coded.select("doc_id"), "n_tokens long, ids_sha256 string, decoded_sha256 string"))


def op3_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents encoded and decoded again."""
    return digests(encode(read_table(spark, sf_dir, "documents")))
