"""Media columns: what a binary value really is, by its bytes.

One Aho-Corasick automaton holds the magic bytes of all formats and finds every place where one of them stands, in one
pass over the bytes. A validator for the format then reads the structure from there and says how long the item is, or
that it is none. An item at the start gives the true type, which corrects the declared one; items further in are
embedded media, carved by offset and length.

Defined results: a null value counts as empty and is of type application/octet-stream, as is one whose bytes no
validator accepts; a null declared type counts as wrong; equal values give equal results; an empty table gives an empty
table.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import map_batches, plus, read_table, texts_of

UNKNOWN = "application/octet-stream"
UNIT = 192
PAD = b" "
#: Each byte with its bits the other way round.
_MIRROR = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))


def _riff(b: bytes, at: int) -> tuple[str, int] | None:
    if len(b) < at + 12:
        return None
    (size,) = struct.unpack_from("<I", b, at + 4)
    kind = {b"WAVE": "audio/wav", b"AVI ": "video/avi", b"WEBP": "image/webp"}.get(b[at + 8 : at + 12])
    end = at + 8 + size
    if not kind or size < 4 or end > len(b):
        return None
    p, seen = at + 12, set()
    while p + 8 <= end:
        name, (n,) = b[p : p + 4], struct.unpack_from("<I", b, p + 4)
        if p + 8 + n > end:
            return None
        seen.add(name)
        p += 8 + n + n % 2
    needs = {"audio/wav": {b"fmt ", b"data"}, "video/avi": {b"LIST"}, "image/webp": set()}[kind]
    return (kind, end - at) if needs <= seen else None


def _png(b: bytes, at: int) -> tuple[str, int] | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, p)
        name = b[p + 4 : p + 8]
        if p + 12 + n > len(b) or (first and name != b"IHDR") or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if name == b"IEND":
            return "image/png", p - at
    return None


def _jpeg(b: bytes, at: int) -> tuple[str, int] | None:
    p = at + 2
    while p + 2 <= len(b):
        if b[p] != 0xFF:
            return None
        marker = b[p + 1]
        if marker == 0xD9:
            return "image/jpeg", p + 2 - at
        if p + 4 > len(b):
            return None
        (n,) = struct.unpack_from(">H", b, p + 2)
        if n < 2 or marker < 0xC0:
            return None
        p += 2 + n
        if marker == 0xDA:  # entropy-coded data up to a marker that is no restart
            while True:
                p = b.find(b"\xff", p)
                if p < 0 or p + 1 >= len(b):
                    return None
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                    continue
                break
    return None


def _gif(b: bytes, at: int) -> tuple[str, int] | None:
    if len(b) < at + 13 or b[at + 4] not in b"79" or b[at + 5] != ord("a"):
        return None
    flags = b[at + 10]
    p = at + 13 + (3 << ((flags & 7) + 1) if flags & 0x80 else 0)

    def blocks(p: int) -> int:
        while p < len(b) and b[p]:
            p += 1 + b[p]
        return p + 1

    while p < len(b):
        if b[p] == 0x3B:
            return "image/gif", p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 < len(b):
            local = b[p + 9]
            p = blocks(p + 11 + (3 << ((local & 7) + 1) if local & 0x80 else 0))
        else:
            return None
    return None


def _bmp(b: bytes, at: int) -> tuple[str, int] | None:
    if len(b) < at + 30:
        return None
    size, _, start, header, width, height, planes, bits = struct.unpack_from("<IIIIiiHH", b, at + 2)
    if header not in (12, 40, 52, 56, 108, 124) or planes != 1 or bits not in (1, 4, 8, 16, 24, 32) or not 14 + header <= start <= size or at + size > len(b) or width <= 0 or not height:
        return None
    return "image/bmp", size


def _gzip(b: bytes, at: int) -> tuple[str, int] | None:
    if b[at + 2 : at + 3] != b"\x08":
        return None
    reader, view, p = zlib.decompressobj(31), memoryview(b), at
    try:
        # In pieces whose output is thrown away, so that no bomb fills the memory.
        while p < len(b) and not reader.eof:
            piece = view[p : p + (1 << 16)]
            p += len(piece)
            while len(piece) and not reader.eof:
                reader.decompress(piece, 1 << 16)
                piece = reader.unconsumed_tail
    except zlib.error:
        return None
    return ("application/gzip", p - at - len(reader.unused_data)) if reader.eof else None


@functools.lru_cache(maxsize=1)
def _marks(b: bytes, mark: bytes) -> list[int]:
    """Where a mark stands in a value: found once, however many items ask."""
    return [m.start() for m in re.finditer(re.escape(mark), b)]


@functools.lru_cache(maxsize=1)
def _pdf_marks(b: bytes) -> tuple[list[int], list[int], list[int]]:
    return tuple([m.start() for m in re.finditer(mark, b)] for mark in (b"%PDF-", b"startxref", b"%%EOF"))


def _pdf(b: bytes, at: int) -> tuple[str, int] | None:
    """To the last end before another document begins, as each update of a document adds one."""
    heads, tables, ends = _pdf_marks(b)
    i = bisect.bisect_right(heads, at)
    k = bisect.bisect_left(ends, heads[i] if i < len(heads) else len(b)) - 1
    t = bisect.bisect_right(tables, at)
    return ("application/pdf", ends[k] + 5 - at) if k >= 0 and ends[k] > at and t < len(tables) and tables[t] < ends[k] else None


@functools.lru_cache(maxsize=1)
def _zip_ends(b: bytes) -> dict[int, int]:
    """Of each archive that ends in a value: where it begins, by its directory's place and size, and its first end."""
    out: dict[int, int] = {}
    for end in _marks(b, b"PK\x05\x06"):
        if end + 22 <= len(b):
            size, offset, comment = struct.unpack_from("<IIH", b, end + 12)
            if end + 22 + comment <= len(b):
                out.setdefault(end - size - offset, end + 22 + comment)
    return out


def _zip(b: bytes, at: int) -> tuple[str, int] | None:
    end = _zip_ends(b).get(at)
    return ("application/zip", end - at) if end else None


def _flac(b: bytes, at: int) -> tuple[str, int] | None:
    # The stream's end isn't marked: a stream is taken to go on to the end of the value.
    return ("audio/flac", len(b) - at) if b[at + 4 : at + 8] in (b"\x00\x00\x00\x22", b"\x80\x00\x00\x22") and len(b) >= at + 42 else None


def _ogg(b: bytes, at: int) -> tuple[str, int] | None:
    p = at
    while b[p : p + 5] == b"OggS\x00" and p + 27 <= len(b):
        n = b[p + 26]
        end = p + 27 + n + sum(b[p + 27 : p + 27 + n])
        # A page's checksum is over the page with zeros in its place; zlib's has its bits the other way round.
        page = b[p : p + 22] + b"\0\0\0\0" + b[p + 26 : end]
        found = int(f"{zlib.crc32(page.translate(_MIRROR), 0xFFFFFFFF) ^ 0xFFFFFFFF:032b}"[::-1], 2) if end <= len(b) else -1
        if found != struct.unpack_from("<I", b, p + 22)[0]:
            break
        p = end
    return ("audio/ogg", p - at) if p > at else None


def _mp4(b: bytes, at: int) -> tuple[str, int] | None:
    p, seen = at - 4, set()
    while p >= 0 and p + 8 <= len(b):
        (n,) = struct.unpack_from(">I", b, p)
        name = b[p + 4 : p + 8]
        if n < 8 or p + n > len(b) or not (name.isalnum() and name.isascii()):
            break
        seen.add(name)
        p += n
    return ("video/mp4", p - (at - 4)) if {b"ftyp", b"moov"} <= seen else None


#: Magic bytes, how far into the item they stand, and the validator.
FORMATS = [(b"RIFF", 0, _riff), (b"\x89PNG\r\n\x1a\n", 0, _png), (b"\xff\xd8\xff", 0, _jpeg), (b"GIF8", 0, _gif), (b"BM", 0, _bmp), (b"\x1f\x8b", 0, _gzip), (b"%PDF-", 0, _pdf), (b"PK\x03\x04", 0, _zip), (b"fLaC", 0, _flac), (b"OggS", 0, _ogg), (b"ftyp", 4, _mp4)]


@functools.lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    for magic, into, validate in FORMATS:
        found.add_word(magic.decode("latin-1"), (len(magic), into, validate))
    found.make_automaton()
    return found


def items(b: bytes) -> Iterator[tuple[str, int, int]]:
    """(type, offset, length) of each valid item. Within a valid item the search goes on, for what is embedded in it."""
    for last, (n, into, validate) in automaton().iter(b.decode("latin-1")):
        at = last - n + 1
        if at >= into and (valid := validate(b, at)):
            yield valid[0], at - into, valid[1]


def true_type(b: bytes) -> tuple[str, int, list[tuple[str, int, int]]]:
    """The type and length of the item at a value's start, and the items that are embedded in the value."""
    found = list(items(b))
    kind, _, length = next((x for x in found if x[1] == 0), (UNKNOWN, 0, len(b)))
    return kind, length, [x for x in found if x[1] > 0]


def to_wav(payload: bytes, rate: int = 8000) -> bytes:
    """A WAV file whose 8-bit samples, on one channel, are the payload."""
    pad = b"\0" * (len(payload) % 2)
    body = b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload + pad
    return b"RIFF" + struct.pack("<I", len(body)) + body


def wav_samples(b: bytes) -> bytes:
    """The bytes of the data chunk."""
    p = 12
    while p + 8 <= len(b):
        (n,) = struct.unpack_from("<I", b, p + 4)
        if b[p : p + 4] == b"data":
            return b[p + 8 : p + 8 + n]
        p += 8 + n + n % 2
    raise ValueError("no data chunk")


def sample_features(samples: bytes) -> str:
    """Sums over the samples as signed 8-bit values: number, sum, sum of squares, changes of sign, most and least."""
    x = np.frombuffer(samples, np.uint8)
    count = np.bincount(x, minlength=256)
    level = np.arange(256) - 128
    high = x >= 128
    there = np.flatnonzero(count)
    return f"frames={len(x)};sum={int(count @ level)};squares={int(count @ level**2)};crossings={int(np.count_nonzero(high[1:] != high[:-1]))};low={int(level[there[0]])};high={int(level[there[-1]])}"


def payload_of(text: str) -> tuple[int, bytes]:
    """Bytes of the text, and the payload: they and spaces up to a positive multiple of UNIT."""
    raw = text.encode("utf-8", "surrogatepass")
    return len(raw), raw + PAD * (max(1, -(-len(raw) // UNIT)) * UNIT - len(raw))


def store(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, declared, content): each whole text as a WAV file, under the type it came as."""
    docs = texts_of(df, id_col, text_col)

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [payload_of(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array(["text/plain"] * len(made)), pa.array([to_wav(p) for _, p in made], pa.binary())], names=["doc_id", "n_bytes", "declared", "content"])

        return one

    return map_batches(docs, make, plus(docs.select("doc_id"), "n_bytes long, declared string, content binary"), rows=256)


ITEMS = "array<struct<type:string,offset:bigint,length:bigint>>"


def sniff(df: DataFrame, content_col: str = "content", declared_col: str = "declared") -> DataFrame:
    """df with `media` (true type, whether the declared one was wrong, length of the item, embedded items)."""

    @F.pandas_udf(f"struct<type:string,corrected:boolean,length:bigint,embedded:{ITEMS}>")
    def look(content, declared):
        import pandas as pd

        out = []
        for b, said in zip(content, declared):
            kind, length, inner = true_type(b or b"")
            out.append((kind, kind != said, length, [dict(zip(("type", "offset", "length"), x)) for x in inner]))
        return pd.DataFrame(out, columns=["type", "corrected", "length", "embedded"])

    look.__annotations__ = {}
    return df.withColumn("media", look(F.col(content_col), F.col(declared_col)))


def carve(df: DataFrame, content_col: str = "content") -> DataFrame:
    """One row for each embedded item of a table that sniff() has seen, with its bytes."""
    inner = df.withColumn("item", F.explode("media.embedded"))
    return inner.select("*", F.substring(F.col(content_col), (F.col("item.offset") + 1).cast("int"), F.col("item.length").cast("int")).alias("carved"))


def describe(stored: DataFrame) -> DataFrame:
    """What store() has made: sniffed, its samples read back from the true item, digests and features of both."""
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for declared, b in zip(batch.column("declared").to_pylist(), batch.column("content").to_pylist()):
                kind, length, found = true_type(b)
                samples = wav_samples(b[:length])
                inner = ",".join(f"{k}@{at}+{n}" for k, at, n in found)
                out.append((len(samples), hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), len(b), hashlib.sha256(b).hexdigest(), f"type={kind};corrected={kind != declared};{sample_features(samples)};embedded={inner}"))
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array(list(c)) for c in zip(*out))], names=["doc_id", "n_bytes", *names])

        return one

    fields = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return map_batches(stored, make, plus(stored.select("doc_id", "n_bytes"), fields), rows=256)


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents stored as a sound file, sniffed, read back and described."""
    return describe(store(read_table(spark, sf_dir, "documents")))
