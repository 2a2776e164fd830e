"""Media columns by signature: one Aho-Corasick pass finds magic bytes, validators walk the format's structure.

A match counts only if its validator can follow the format's own lengths and checksums to its end. The object at the
start of a column's bytes gives the type, whatever was declared; valid objects further inside are carved. Bytes are
scanned whole, as Latin-1 characters, which stand for one byte each.
"""

from __future__ import annotations

import re
import struct
import sys
import zlib

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

RATE = 8000
BLOCK = 64


def _png(b: bytes, at: int) -> int | None:
    i = at + 8
    first = True
    while i + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, i)
        kind, end = b[i + 4 : i + 8], i + 12 + n
        if end > len(b) or (first and (kind != b"IHDR" or n != 13)) or zlib.crc32(b[i + 4 : i + 8 + n]) != struct.unpack_from(">I", b, i + 8 + n)[0]:
            return None
        if kind == b"IEND":
            return end - at
        i, first = end, False
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    flags = b[at + 10]
    i = at + 13 + (3 << ((flags & 7) + 1) if flags & 128 else 0)

    def blocks(i: int) -> int:
        while i < len(b) and b[i]:
            i += b[i] + 1
        return i + 1

    while i < len(b):
        if b[i] == 0x3B:
            return i + 1 - at
        if b[i] == 0x21:
            i = blocks(i + 2)
        elif b[i] == 0x2C and i + 10 <= len(b):
            f = b[i + 9]
            i = blocks(i + 11 + (3 << ((f & 7) + 1) if f & 128 else 0))
        else:
            return None
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    i, scan = at + 2, False
    while i + 4 <= len(b):
        if b[i] != 0xFF:
            return None
        m = b[i + 1]
        if m == 0xD9:
            return i + 2 - at if scan else None
        if m == 0xFF:
            i += 1
            continue
        n = struct.unpack_from(">H", b, i + 2)[0]
        if m < 0xC0 or n < 2 or i + 2 + n > len(b):
            return None
        i += 2 + n
        if m == 0xDA:
            scan = True
            while (i := b.find(b"\xff", i)) >= 0 and i + 1 < len(b) and (b[i + 1] == 0 or 0xD0 <= b[i + 1] <= 0xD7):
                i += 2
            if i < 0:
                return None
    return i + 2 - at if scan and b[i : i + 2] == b"\xff\xd9" else None


def _bmp(b: bytes, at: int) -> int | None:
    if at + 26 > len(b):
        return None
    size, zero, data, dib = struct.unpack_from("<IIII", b, at + 2)
    return size if zero == 0 and dib in (12, 40, 52, 56, 64, 108, 124) and 14 + dib <= data < size and at + size <= len(b) else None


def _riff(form: bytes):  # noqa: ANN202
    def walk(b: bytes, at: int) -> int | None:
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        if end > len(b):
            return None
        i = at + 12
        while i + 8 <= end:
            i += 8 + (n := struct.unpack_from("<I", b, i + 4)[0]) + n % 2
        return end - at if i == end and end > at + 12 else None

    return walk


def _crc_table(poly: int, bits: int) -> list[int]:
    top, out = 1 << (bits - 1), []
    for i in range(256):
        c = i << (bits - 8)
        for _ in range(8):
            c = (c << 1) ^ (poly if c & top else 0)
        out.append(c & ((1 << bits) - 1))
    return out


_CRC8, _CRC16, _CRC32 = _crc_table(0x07, 8), _crc_table(0x8005, 16), _crc_table(0x04C11DB7, 32)


def _flac_frame(b: bytes, i: int) -> tuple[int, int] | None:
    """(bytes of the header, samples) of a frame whose header's checksum holds."""
    if i + 6 > len(b) or b[i] != 0xFF or b[i + 1] & 0xFE != 0xF8 or b[i + 3] & 1:
        return None
    size, rate, n = b[i + 2] >> 4, b[i + 2] & 15, i + 4
    if not size or rate == 15:
        return None
    lead = b[n]
    n += 1 if lead < 0x80 else next((k for k in range(2, 8) if not lead & (0x80 >> k)), 8) if lead >= 0xC0 else 99
    extra = {6: 1, 7: 2}.get(size, 0)
    samples = 192 if size == 1 else 576 << (size - 2) if size <= 5 else int.from_bytes(b[n : n + extra], "big") + 1 if extra else 256 << (size - 8)
    n += extra + {12: 1, 13: 2, 14: 2}.get(rate, 0)
    if n >= len(b):
        return None
    c = 0
    for x in b[i:n]:
        c = _CRC8[c ^ x]
    return (n + 1 - i, samples) if c == b[n] else None


def _flac(b: bytes, at: int) -> int | None:
    """Metadata blocks by their lengths, then frames by both checksums, until all samples are there (or no frame follows, if the
    header does not say how many there are)."""
    i, first, total = at + 4, True, 0
    while i + 4 <= len(b):
        kind, n, last = b[i] & 127, int.from_bytes(b[i + 1 : i + 4], "big"), b[i] & 128
        if i + 4 + n > len(b) or (first and (kind != 0 or n != 34)):
            return None
        if first:
            total = int.from_bytes(b[i + 4 + 13 : i + 4 + 18], "big") & ((1 << 36) - 1)
        i, first = i + 4 + n, False
        if last:
            break
    else:
        return None
    got = 0
    while not total or got < total:
        head = _flac_frame(b, i)
        if not head:
            break
        c, end = 0, None
        for j in range(i, len(b)):
            c = ((c << 8) ^ _CRC16[(c >> 8) ^ b[j]]) & 0xFFFF
            # the checksum over a frame and its own checksum is zero
            if not c and j + 1 - i > head[0] + 2 and (got + head[1] == total or j + 1 == len(b) or _flac_frame(b, j + 1)):
                end = j + 1
                break
        if end is None:
            return None
        got, i = got + head[1], end
    return i - at if got and got >= total else None


def _ogg(b: bytes, at: int) -> int | None:
    """Pages by their lengths and checksums, from one that begins a stream up to the one that ends it."""
    i, pages = at, 0
    if b[at + 5 : at + 6] < b"\2" or not b[at + 5] & 2:
        return None
    while b[i : i + 4] == b"OggS" and i + 27 <= len(b) and b[i + 4] == 0:
        n = b[i + 26]
        end = i + 27 + n + sum(b[i + 27 : i + 27 + n])
        if i + 27 + n > len(b) or end > len(b):
            return None
        c = 0
        for x in b[i : i + 22] + b"\0\0\0\0" + b[i + 26 : end]:
            c = ((c << 8) & 0xFFFFFFFF) ^ _CRC32[(c >> 24) ^ x]
        if c != struct.unpack_from("<I", b, i + 22)[0]:
            return None
        last, i, pages = b[i + 5] & 4, end, pages + 1
        if last:
            break
    return i - at if pages else None


def _mp4(b: bytes, at: int) -> int | None:
    """Boxes by their lengths, of 32 or 64 bits; one of length 0 runs to the end."""
    i, kinds = at, set()
    while i + 8 <= len(b):
        n, kind, head = struct.unpack_from(">I", b, i)[0], b[i + 4 : i + 8], 8
        if n == 1 and i + 16 <= len(b):
            n, head = struct.unpack_from(">Q", b, i + 8)[0], 16
        elif n == 0:
            n = len(b) - i
        if n < head or i + n > len(b) or not kind.isalnum():
            break
        kinds.add(kind)
        i += n
    return i - at if b"ftyp" in kinds and kinds & {b"moov", b"mdat"} else None


def _pdf(b: bytes, at: int) -> int | None:
    """Up to the last end mark before another file's start, whose startxref names the place of a cross-reference."""
    limit = b.find(b"%PDF-", at + 5)
    limit = len(b) if limit < 0 else limit
    while (end := b.rfind(b"%%EOF", at, limit)) > 0:
        named = re.search(rb"startxref\s+(\d+)\s*$", b[max(at, end - 64) : end])
        to = at + int(named[1]) if named else end
        if to < end and re.match(rb"xref|\d+ \d+ obj", b[to : to + 32]):
            return end + 5 - at
        limit = end
    return None


# Magic bytes, where the object begins before them, type, validator.
SIGNATURES = (
    (b"\x89PNG\r\n\x1a\n", 0, "image/png", _png),
    (b"GIF87a", 0, "image/gif", _gif),
    (b"GIF89a", 0, "image/gif", _gif),
    (b"\xff\xd8\xff", 0, "image/jpeg", _jpeg),
    (b"BM", 0, "image/bmp", _bmp),
    (b"WAVE", 8, "audio/wav", _riff(b"WAVE")),
    (b"WEBP", 8, "image/webp", _riff(b"WEBP")),
    (b"AVI ", 8, "video/avi", _riff(b"AVI ")),
    (b"fLaC", 0, "audio/flac", _flac),
    (b"OggS", 0, "audio/ogg", _ogg),
    (b"ftyp", 4, "video/mp4", _mp4),
    (b"%PDF-", 0, "application/pdf", _pdf),
)


def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    for k, (magic, *_) in enumerate(SIGNATURES):
        a.add_word(magic.decode("latin-1"), k)
    a.make_automaton()
    return a


def objects(b: bytes, a) -> list[tuple[int, int, str]]:  # noqa: ANN001
    """(offset, length, type) of valid objects, those within an earlier one left out unless that one is at 0."""
    found, last = [], -1
    for end, k in a.iter(b.decode("latin-1")):
        magic, before, kind, walk = SIGNATURES[k]
        at = end + 1 - len(magic) - before
        if at < 0 or at < last or (before == 8 and b[at : at + 4] != b"RIFF"):
            continue
        n = walk(b, at)
        if n:
            found.append((at, n, kind))
            last = at + n if at else 0
    return sorted(set(found))


def samples(b: bytes) -> bytes | None:
    """The payload of a valid 8-bit mono WAV."""
    i, sound = 12, None
    while i + 8 <= len(b):
        kind, n = b[i : i + 4], struct.unpack_from("<I", b, i + 4)[0]
        if kind == b"fmt " and struct.unpack_from("<HHIIHH", b, i + 8)[::5] == (1, 8):
            sound = True
        if kind == b"data" and sound:
            return b[i + 8 : i + 8 + n]
        i += 8 + n + n % 2
    return None


MEDIA = T.StructType(
    [
        T.StructField("type", T.StringType()),
        T.StructField("length", T.LongType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField("embedded", T.ArrayType(T.StructType([T.StructField("offset", T.LongType()), T.StructField("length", T.LongType()), T.StructField("type", T.StringType())]))),
        T.StructField("payload", T.BinaryType()),
        T.StructField("feature", T.StringType()),
    ]
)


def sniff_media(rows: DataFrame, content: str = "content", declared: str = "declared") -> DataFrame:
    """``rows`` with a struct ``media``: type and length of the valid object at the start (null if there is none), corrected
    (the declared type is another), embedded (offset, length and type of the valid objects inside), payload and
    feature (of 8-bit PCM sound: the samples as stored, and their mean and range).

    Null content has a null type and no objects; empty content too; a null declared type is corrected if there is a type; rows that repeat
    are judged each, whole contents of any length; a column called ``media`` is replaced; an empty table gives an
    empty one.
    """
    rows = rows.drop("media")
    schema = T.StructType([*rows.schema.fields, T.StructField("media", MEDIA)])
    kind = pa.struct([("type", pa.string()), ("length", pa.int64()), ("corrected", pa.bool_()), ("embedded", pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64()), ("type", pa.string())]))), ("payload", pa.binary()), ("feature", pa.string())])

    def look(b: bytes | None, said: str | None, a) -> dict:  # noqa: ANN001
        got = objects(b, a) if b else []
        head = next((x for x in got if x[0] == 0), None)
        inside = [{"offset": o, "length": n, "type": t} for o, n, t in got if o]
        out = {"type": head and head[2], "length": head and head[1], "corrected": bool(head) and head[2] != said, "embedded": inside, "payload": None, "feature": None}
        if head and head[2] == "audio/wav" and (p := samples(b)):
            x = np.frombuffer(p, np.uint8)
            out |= {"payload": p, "feature": f"pcm8 n={len(p)} mean={int(x.sum(dtype=np.int64)) / len(p):.4f} min={x.min()} max={x.max()} embedded={len(inside)}"}
        return out

    def run(batches):  # noqa: ANN001
        a = automaton()
        for batch in batches:
            step = max(1, batch.num_rows * (8 << 20) // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                piece = batch.slice(i, step)
                said = piece.column(declared).to_pylist() if declared in piece.schema.names else [None] * piece.num_rows
                media = pa.array([look(b, s, a) for b, s in zip(piece.column(content).to_pylist(), said)], kind)
                yield pa.RecordBatch.from_arrays([*piece.columns, media], schema=pa.schema([*piece.schema, pa.field("media", kind)]))

    return rows.mapInArrow(run, schema)


def _le32(n: Column) -> Column:
    h = F.lpad(F.hex(n), 8, "0")
    return F.unhex(F.concat(*(F.substring(h, i, 2) for i in (7, 5, 3, 1))))


def as_wav(text: Column) -> Column:
    """A text's UTF-8 bytes, padded with zeros to a positive multiple of BLOCK, as an 8-bit mono WAV file."""
    raw = F.coalesce(text, F.lit("")).cast("binary")
    size = (F.greatest(F.ceil(F.octet_length(raw) / BLOCK), F.lit(1)) * BLOCK).cast("int")
    fmt = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8)
    return F.concat(F.lit(b"RIFF"), _le32(size + 36), F.lit(b"WAVE" + fmt + b"data"), _le32(size), F.rpad(raw, size, F.lit(b"\x00")))


def op3_media_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), as_wav(F.col("text")).alias("content"))
    m = sniff_media(docs.withColumn("declared", F.lit("text/plain")))
    payload = F.col("media.payload")
    return m.select(
        "doc_id",
        "n_bytes",
        F.octet_length(payload).cast("long").alias("payload_bytes"),
        F.sha2(payload, 256).alias("payload_sha256"),
        F.crc32(F.substring(payload, -BLOCK, BLOCK)).alias("tail_crc32"),
        F.octet_length("content").cast("long").alias("media_bytes"),
        F.sha2("content", 256).alias("media_sha256"),
        F.concat_ws(" ", "media.type", "media.feature").alias("feature"),
    )
