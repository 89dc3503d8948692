import gzip
import hashlib
import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from tidewater.llm import media

from .conftest import SF


def png():
    def chunk(name, data):
        return struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))

    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 1, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"\0\0")) + chunk(b"IEND", b"")


def bmp():
    return b"BM" + struct.pack("<IIIIiiHHIIiiII", 58, 0, 54, 40, 1, 1, 1, 24, 0, 4, 0, 0, 0, 0) + b"\0\0\0\0"


def test_validators():
    gif = b"GIF89a" + struct.pack("<HHBBB", 1, 1, 0x80, 0, 0) + b"\0" * 6 + b"\x2c" + struct.pack("<HHHHB", 0, 0, 1, 1, 0) + b"\x02\x02\x44\x01\x00\x3b"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02\x11\xff\x00\x22\xff\xd9"
    mp4 = struct.pack(">I", 16) + b"ftypisom\0\0\0\0" + struct.pack(">I", 8) + b"moov"
    for kind, item in (("image/png", png()), ("image/bmp", bmp()), ("image/gif", gif), ("image/jpeg", jpeg), ("video/mp4", mp4), ("application/gzip", gzip.compress(b"hi")), ("audio/wav", media.to_wav(b"abcd"))):
        assert (kind, 0, len(item)) in list(media.items(item)), kind
        assert (kind, 3, len(item)) in list(media.items(b"xyz" + item + b"rest")), kind
        assert not [x for x in media.items(item[:-1]) if x[0] == kind], kind


def ogg(data):
    """One page; the checksum bit by bit."""
    page = b"OggS\0\x02" + bytes(16) + b"\0\0\0\0" + bytes([1, len(data)]) + data
    crc = 0
    for byte in page:
        crc ^= byte << 24
        for _ in range(8):
            crc = (crc << 1 ^ 0x04C11DB7 if crc & 0x80000000 else crc << 1) & 0xFFFFFFFF
    return page[:22] + struct.pack("<I", crc) + page[26:]


def test_ends_of_items():
    pdf = b"%PDF-1.4 a startxref 1 %%EOF b startxref 2 %%EOF"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("a", "b" * 100)
    archive, sound = held.getvalue(), ogg(b"abc")
    bomb = gzip.compress(bytes(30 << 20))
    for kind, item in (("application/pdf", pdf), ("application/zip", archive), ("audio/ogg", sound), ("application/gzip", bomb)):
        both = list(media.items(b"xx" + item + b"--" + item + b"rest"))
        assert {(kind, 2, len(item)), (kind, 4 + len(item), len(item))} <= set(both), kind
    assert not [x for x in media.items(sound[:-1] + b"z") if x[0] == "audio/ogg"]


def test_features_of_a_text(spark):
    row = media.describe(media.store(spark.createDataFrame([(1, "AB" * 10 + "\u00e9")], "doc_id long, text string"))).first()
    level = [x - 128 for x in ("AB" * 10 + "\u00e9").encode() + b" " * 170]
    crossings = sum((a >= 0) != (b >= 0) for a, b in zip(level, level[1:]))
    assert row.feature == f"type=audio/wav;corrected=True;frames=192;sum={sum(level)};squares={sum(x * x for x in level)};crossings={crossings};low={min(level)};high={max(level)};embedded="


def test_sniff_and_carve(spark):
    rows = [(1, "image/gif", png() + b"junk" + bmp()), (2, "image/bmp", bmp()), (3, None, b"BMplain text"), (4, "text/plain", None), (5, None, b"")]
    seen = media.sniff(spark.createDataFrame(rows, "id long, declared string, content binary"))
    got = {r.id: r.media for r in seen.collect()}
    assert (got[1].type, got[1].corrected, got[1].length) == ("image/png", True, len(png()))
    assert (got[2].type, got[2].corrected) == ("image/bmp", False)
    assert got[3].type == got[4].type == got[5].type == media.UNKNOWN and got[3].corrected
    assert [(r.id, r.item.type, bytes(r.carved)) for r in media.carve(seen).collect()] == [(1, "image/bmp", bmp())]


def test_query_reads_back_what_it_stored(spark, docs, edges, empty, table_dir):
    for rows, sf in ((docs, SF), (edges, table_dir(documents=edges))):
        got = sorted(tuple(r)[:7] for r in media.op2_media(spark, sf).select(F.coalesce("doc_id", F.lit(-1)), "*").drop("doc_id").collect())
        want = []
        for r in rows.collect():
            raw = (r.text or "").encode()
            payload = raw + b" " * (max(1, -(-len(raw) // 192)) * 192 - len(raw))
            wav = media.to_wav(payload)
            want.append((-1 if r.doc_id is None else r.doc_id, len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(wav), hashlib.sha256(wav).hexdigest()))
        assert got == sorted(want)
    assert media.describe(media.store(empty)).count() == 0
