"""Token counts by a two-tier lookup on the map side.

The first tier is a compact hash table, broadcast once: 64-bit hashes and lengths in tokens of the frequent pre-tokens.
These are the vocabulary's own whole words: a vocabulary is made of what was frequent, its size bounds the table, and
to take the corpus's own would need the shuffle of pre-tokens that this method avoids. A batch's pre-tokens are looked up
there all at once. What the table lacks is encoded by the tokenizer and kept in the second tier, a cache of the worker
with a bounded number of entries. So pre-tokens are never shuffled, and the only result is a number a row.

Defined results: a null or empty text has 0 tokens; a null doc_id stays null; equal rows each give a row; other columns
are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_batches, plus, read_table, texts_of, tokenizer_path
from .textbytes import raw
from .word_bpe import HashTable, UnitCache, held, units, vocabulary

VOCABULARY = "word_bpe_49k.json"


def frequent_lengths(path: str) -> HashTable:
    """Hashes of the vocabulary's whole words, the most frequent first, and how many tokens the tokenizer makes of each."""
    of = vocabulary(path)
    words = of.whole_words() if of.cuts else []
    data, at = raw(pa.array(words, pa.string()))
    keys, first = np.unique(of.hashes(data, at[:-1], at[1:]), return_index=True)
    order = np.argsort(first)
    keys, first = keys[order], first[order]
    table = HashTable(max(8, int(len(keys)).bit_length() + 1))
    table.add(keys, np.array([len(i) for i in of.ids([words[i] for i in first.tolist()])], np.int32))
    return table


class LengthCache(UnitCache):
    """The second tier: units that the table lacks."""

    def counts(self, texts: pa.Array, table: HashTable) -> np.ndarray:
        """Tokens of each text."""
        apart = self.of.set_apart(texts)
        out = np.zeros(len(texts), np.int64)
        if apart.any():
            out[apart] = [len(i) for i in self.of.ids(texts.filter(pa.array(apart)).to_pylist())]
            out[~apart] = self.counts(texts.filter(pa.array(~apart)), table) if not apart.all() else []
            return out
        data, at = raw(texts)
        begins, ends, first = units(data, at)
        keys = self.of.hashes(data, begins, ends)
        lengths = table.find(keys).astype(np.int64)
        missing = np.flatnonzero(lengths < 0)
        if len(missing):
            place = self.places(data, begins[missing], ends[missing], keys[missing])
            lengths[missing] = self.length[place]
        return np.diff(np.concatenate([[0], np.cumsum(lengths)])[first])


def count_tokens(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of each whole text."""
    path = path or tokenizer_path(VOCABULARY)
    docs = texts_of(df, id_col, text_col)
    table = df.sparkSession.sparkContext.broadcast(frequent_lengths(path))

    def make():
        cache = held(LengthCache, path)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = cache.counts(batch.column("text"), table.value)
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

        return one

    docs = docs.withColumn("n_bytes", F.octet_length("text").cast("long"))
    return map_batches(docs, make, plus(docs.select("doc_id", "n_bytes"), "n_tokens long"), 512, "text")


def op7_token_counts(spark: SparkSession, sf_dir: str, limit: int = 2048) -> DataFrame:
    """The tokens of every whole text of documents, and whether they are more than the limit."""
    return count_tokens(read_table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > limit)
