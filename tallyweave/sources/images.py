"""The frames of picture files, by their headers alone: every frame is a page, and a picture that is to be turned has its sides
changed over. Reading the words of a frame is left to a reader of the caller's."""

from __future__ import annotations

import struct
import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.functions.predicates import file_kind

cloudpickle.register_pickle_by_value(sys.modules[__name__])

FRAMES = "doc_id string, page_no int, width int, height int, orientation int, error string"
_WIDTH, _HEIGHT, _TURN = 256, 257, 274


def _directories(b: bytes) -> Iterator[dict[int, int]]:
    """The whole-number tags of each image directory of a TIFF stream; a chain that comes back to itself ends."""
    order = {b"II": "<", b"MM": ">"}[b[:2]]
    (at,), seen = struct.unpack_from(order + "I", b, 4), set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", b, at)
        tags = {}
        for i in range(n):
            tag, kind, _ = struct.unpack_from(order + "HHI", b, at + 2 + 12 * i)
            if kind in (3, 4):
                (tags[tag],) = struct.unpack_from(order + ("H" if kind == 3 else "I"), b, at + 10 + 12 * i)
        yield tags
        (at,) = struct.unpack_from(order + "I", b, at + 2 + 12 * n)


def _gif(b: bytes) -> list[tuple[int, int, int]]:
    w, h, flags = struct.unpack_from("<HHB", b, 6)
    at, n = 13 + (3 << (flags & 7) + 1 if flags & 128 else 0), 0
    while at < len(b) and b[at] != 0x3B:
        if b[at] == 0x2C:
            n += 1
            at += 11 + (3 << (b[at + 9] & 7) + 1 if b[at + 9] & 128 else 0)
        else:
            at += 2
        while b[at]:
            at += b[at] + 1
        at += 1
    return [(w, h, 1)] * n


def _jpeg(b: bytes) -> list[tuple[int, int, int]]:
    at, turn = 2, 1
    while b[at] == 0xFF:
        mark, size = struct.unpack_from(">BH", b, at + 1)
        if mark == 0xE1 and b[at + 4 : at + 10] == b"Exif\0\0":
            turn = next(_directories(b[at + 10 : at + 2 + size]), {}).get(_TURN, 1)
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC):
            h, w = struct.unpack_from(">HH", b, at + 5)
            return [(w, h, turn)]
        at += 2 + size
    raise ValueError("no frame header")


def frames(b: bytes) -> list[tuple[int, int, int]]:
    """(width, height, orientation) of each frame, as stored; raises on what is no picture of a known kind."""
    if b[:4] in (b"II*\0", b"MM\0*"):
        return [(t[_WIDTH], t[_HEIGHT], t.get(_TURN, 1)) for t in _directories(b)]
    if b[:6] in (b"GIF87a", b"GIF89a"):
        return _gif(b)
    if b[:8] == b"\x89PNG\r\n\x1a\n":
        return [(*struct.unpack_from(">II", b, 16), 1)]
    if b[:3] == b"\xff\xd8\xff":
        return _jpeg(b)
    if b[:2] == b"BM":
        w, h = struct.unpack_from("<ii", b, 18)
        return [(w, abs(h), 1)]
    raise ValueError("cannot identify image file")


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        rows = []
        for path, ext, content in zip(batch["path"], batch["ext"], batch["content"]):
            try:
                if ext in (".heic", ".heif"):
                    raise ValueError(V.NO_HEIC)
                for n, (w, h, turn) in enumerate(frames(bytes(content))):
                    w, h = (h, w) if turn >= 5 else (w, h)
                    rows.append((path, n, w, h, turn, None))
            except Exception as e:  # a picture that cannot be read is a row that says so
                rows.append((path, None, None, None, None, str(e) or type(e).__name__))
        yield pd.DataFrame(rows, columns=["doc_id", "page_no", "width", "height", "orientation", "error"]).astype({c: "Int32" for c in ("page_no", "width", "height", "orientation")})


def image_frames(files: DataFrame) -> DataFrame:
    """The upright frames of the pictures of ``files(path, content)``, a page each; files of other kinds are left out, one that cannot be
    read (HEIC, which needs a decoder, or damaged) is a row with an error."""
    kind = file_kind(F.col("path"))
    return files.withColumn("ext", kind["ext"]).where(kind["route"] == "image").select("path", "ext", "content").mapInPandas(_read, FRAMES)
