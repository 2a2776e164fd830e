"""Results as files: each document's bytes are made where its rows are; writing them out is a separate step."""

from __future__ import annotations

import csv
import io
import re
import struct
import sys
import zipfile
from collections.abc import Callable, Iterator, Sequence
from xml.sax.saxutils import escape
from zlib import crc32

import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.functions.money import parse_money

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: A kind that ends in _error has no file: its content is what went wrong with an optional one.
FILES = "doc_id string, kind string, content binary"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
_CONTROL = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\ufffe\uffff]")
_FILL, _RED = "FFF4CCCC", "FF0000"


#: The beginnings of archives, by their fixed parts: bytes, directory entries, number of entries.
_BEGUN: dict[tuple[str, ...], tuple[bytes, bytes, int]] = {}
#: Bytes of result files that a task holds before it hands them on.
_HELD = 8 << 20


def _entry(name: str, data: bytes, at: int) -> tuple[bytes, bytes]:
    """A stored part of an archive, and its entry in the directory; all parts are of the first of January 1980."""
    n = name.encode()
    known = struct.pack("<HHHHLLLHH", 0, 0, 0, 33, crc32(data), len(data), len(data), len(n), 0)
    local = b"PK\3\4\x14\0" + known + n + data
    return local, b"PK\1\2\x14\3\x14\0" + known + struct.pack("<HHHLL", 0, 0, 0, 0o600 << 16, at) + n


def _zip(parts: dict[str, str]) -> bytes:
    """An archive of stored parts. All but the last are the same in many files, and made once."""
    *fixed, (name, text) = parts.items()
    data = text.encode()
    if len(data) > 1 << 30:  # what the short form has no room for
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for part in parts:
                z.writestr(zipfile.ZipInfo(part, (1980, 1, 1, 0, 0, 0)), parts[part])
        return out.getvalue()
    key = tuple(t for part in fixed for t in part)
    if key not in _BEGUN:
        body, entries = b"", b""
        for part, t in fixed:
            local, entry = _entry(part, t.encode(), len(body))
            body, entries = body + local, entries + entry
        if len(_BEGUN) >= 64:
            _BEGUN.clear()
        _BEGUN[key] = body, entries, len(fixed)
    body, entries, n = _BEGUN[key]
    local, entry = _entry(name, data, len(body))
    size, at = len(entries) + len(entry), len(body) + len(local)
    return b"".join((body, local, entries, entry, b"PK\5\6", struct.pack("<HHHHLLH", 0, 0, n + 1, n + 1, size, at, 0)))


def _csv(rows: list[list[str]]) -> bytes:
    out = io.StringIO(newline="")
    csv.writer(out).writerows(rows)
    return b"\xef\xbb\xbf" + out.getvalue().encode()


def _printable(*texts: str) -> None:
    """XML holds no control characters."""
    if _CONTROL.search("".join(texts)):
        raise ValueError("a cell or line has control characters, which this kind of file cannot hold")


def _tried(kind: str, write: Callable[[], bytes]) -> tuple[str, bytes]:
    """An optional file, or why there is none: the main one ships in any case."""
    try:
        return kind, write()
    except Exception as e:  # whatever a writer cannot do is told beside the files that it could
        return f"{kind}_error", str(e).encode()


def _by_document(rows: DataFrame, make: Callable[[list[tuple]], Iterator[tuple[str, bytes]]]) -> DataFrame:
    """(doc_id, kind, content) of what ``make`` gives for each document's rows, in order, without doc_id and row_no.

    A window numbers the rows of each document, so that they come side by side and the first is known; a task holds one
    document's rows and some files.
    """
    fields = [c for c in rows.columns if c not in ("doc_id", "row_no")]
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("row_no"))

    def batch(files: list[tuple]) -> pa.RecordBatch:
        columns = zip(*files) if files else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary()))], ["doc_id", "kind", "content"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, held, files, size = None, [], [], 0
        for b in batches:
            doc_ids, first, *values = (c.to_pylist() for c in b.columns)
            for d, n, row in zip(doc_ids, first, zip(*values)):
                if n == 1:
                    if held:
                        made = [(doc, *f) for f in make(held)]
                        files += made
                        size += sum(len(f[2]) for f in made)
                        if size > _HELD:
                            yield batch(files)
                            files, size = [], 0
                    doc, held = d, []
                held.append(row)
        if held:
            files += [(doc, *f) for f in make(held)]
        yield batch(files)

    return rows.withColumn("_nth", nth).select("doc_id", "_nth", *fields).mapInArrow(run, FILES)


def _name(i: int) -> str:
    s = ""
    while i >= 0:
        s, i = chr(65 + i % 26) + s, i // 26 - 1
    return s


def xlsx(title: str, rows: list[list[tuple[str, str | None]]], least: int, bold: bool, flagged: set[int]) -> bytes:
    """A workbook of one sheet; a cell is (text, number or None), flagged rows are filled, columns as wide as their text."""
    _printable(*(text for row in rows for text, _ in row))
    width: dict[int, int] = {}
    names = [_name(c) for c in range(max(map(len, rows), default=0))]
    body = []
    for r, row in enumerate(rows):
        style = 1 if bold and r == 0 else 2 if r in flagged else 0
        at = f'{r + 1}" s="{style}"'
        cells = []
        for c, (text, number) in enumerate(row):
            if len(text) > width.get(c, -1):
                width[c] = len(text)
            cells.append(f'<c r="{names[c]}{at}><v>{number}</v></c>' if number is not None else f'<c r="{names[c]}{at} t="inlineStr"><is><t xml:space="preserve">{escape(text) if text else ""}</t></is></c>')
        body.append(f'<row r="{r + 1}">{"".join(cells)}</row>')
    cols = "".join(f'<col min="{c + 1}" max="{c + 1}" width="{min(60, max(least, w + 2))}" customWidth="1"/>' for c, w in sorted(width.items()))
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    return _zip(
        {
            "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/worksheets/sheet1.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/></Types>',
            "_rels/.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
            "xl/workbook.xml": f'{_HEAD}<workbook {ns} xmlns:r="{rel}"><sheets><sheet name="{escape(title)}" sheetId="1" r:id="rId1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{rel}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{rel}/styles" Target="styles.xml"/></Relationships>',
            "xl/styles.xml": f'{_HEAD}<styleSheet {ns}><fonts count="2"><font/><font><b/></font></fonts><fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="{_FILL}"/></patternFill></fill></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3"><xf/><xf fontId="1" applyFont="1"/><xf fillId="2" applyFill="1"/></cellXfs></styleSheet>',
            "xl/worksheets/sheet1.xml": f"{_HEAD}<worksheet {ns}>{f'<cols>{cols}</cols>' if cols else ''}<sheetData>{''.join(body)}</sheetData></worksheet>",
        }
    )


def _docx(body: str) -> bytes:
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    return _zip(
        {
            "[Content_Types].xml": f'{_HEAD}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>',
            "_rels/.rels": f'{_HEAD}<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>',
            "word/document.xml": f"{_HEAD}<w:document {ns}><w:body>{body}</w:body></w:document>",
        }
    )


def _run(text: str, style: str = "") -> str:
    _printable(text)
    parts = "<w:br/>".join(f'<w:t xml:space="preserve">{escape(t)}</w:t>' for t in text.split("\n"))
    return f"<w:r>{f'<w:rPr>{style}</w:rPr>' if style else ''}{parts}</w:r>"


def docx_ledger(rows: list[list[str]], flag_at: int) -> bytes:
    out = ['<w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr>' + _run("Transactions", "<w:b/>") + "</w:p><w:tbl>"]
    for r, row in enumerate(rows):
        flagged = r > 0 and bool(row[flag_at])
        shade = '<w:tcPr><w:shd w:val="clear" w:fill="F4CCCC"/></w:tcPr>' if flagged else ""
        cells = (f"<w:tc>{shade}<w:p>{_run(t, '<w:b/>' if r == 0 else f'<w:color w:val="{_RED}"/>' if flagged and c == flag_at else '')}</w:p></w:tc>" for c, t in enumerate(row))
        out.append(f"<w:tr>{''.join(cells)}</w:tr>")
    return _docx("".join(out) + "</w:tbl>")


def docx_text(text: str) -> bytes:
    paragraphs = [p for p in text.split("\n\n") if p] or text.splitlines()
    return _docx("".join(f"<w:p>{_run(p)}</w:p>" for p in paragraphs))


def ledger_files(rows: DataFrame, kinds: Sequence[str] = ("csv", "xlsx", "docx")) -> DataFrame:
    """(doc_id, kind, content): csv, xlsx and docx of each document's audited rows, or those of them that are asked for; optional
    columns only if a row has them."""
    every, money, optional = V.EXPORT_COLUMNS, V.MONEY_COLUMNS, V.OPTIONAL_COLUMNS
    numbers = [F.col(f"_{c}").cast("string").alias(f"n_{c}") for c in money]
    text = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in every]
    flag, n = every.index("flag"), len(every)

    def make(doc: list[tuple]) -> Iterator[tuple[str, bytes]]:
        used = [i for i, c in enumerate(every) if c not in optional or any(r[i] != "" for r in doc)]
        cols = [every[i] for i in used]
        plain = [cols, *([r[i] for i in used] for r in doc)]
        if "csv" in kinds:
            yield "csv", _csv(plain)
        if "xlsx" in kinds:
            where = [(i, n + money.index(every[i]) if every[i] in money else None) for i in used]
            cells = [[(c, None) for c in cols], *([(r[i], r[k] if k is not None else None) for i, k in where] for r in doc)]
            yield _tried("xlsx", lambda: xlsx("Transactions", cells, 8, True, {i + 1 for i, r in enumerate(doc) if r[flag]}))
        if "docx" in kinds:
            yield _tried("docx", lambda: docx_ledger(plain, cols.index("flag")))

    return _by_document(rows.select("doc_id", "row_no", *text, *numbers), make)


def grid_files(grid: DataFrame) -> DataFrame:
    """csv (without a header) and xlsx of each document's grid; a cell that reads as money is a number in the xlsx."""
    g = grid.select("doc_id", "row_no", "cells", F.transform("cells", lambda c: parse_money(c).cast("string")).alias("numbers"))

    def make(doc: list[tuple]) -> Iterator[tuple[str, bytes]]:
        yield "csv", _csv([r for r, _ in doc])
        yield _tried("xlsx", lambda: xlsx("Table", [list(zip(r, n)) for r, n in doc], 10, False, set()))

    return _by_document(g, make)


def text_files(docs: DataFrame, kinds: Sequence[str] = ("txt", "docx")) -> DataFrame:
    """txt and docx of ``docs(doc_id, text)``, or the one of them that is asked for."""

    @F.pandas_udf("kind string, content binary")
    def word(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([_tried("docx", lambda t=t: docx_text(t or "")) for t in texts], columns=["kind", "content"])

    plain = F.struct(F.lit("txt").alias("kind"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    made = {"txt": plain, "docx": F.col("w")}
    d = docs.select("doc_id", "text", *([word(F.col("text")).alias("w")] if "docx" in kinds else []))
    return d.select("doc_id", F.inline(F.array(*(made[k] for k in kinds))))


def json_lines(summary: DataFrame) -> DataFrame:
    """(doc_id, json): one object a document, without the columns that begin with an underscore."""
    return summary.select("doc_id", F.to_json(F.struct(*(c for c in summary.columns if c[0] != "_"))).alias("json"))


def save(files: DataFrame, folder: str) -> None:
    """Write ``files(doc_id, kind, content)`` as folder/doc_id.kind, on a folder that every executor mounts."""

    def put(rows) -> None:  # noqa: ANN001
        from pathlib import Path
        from urllib.parse import quote

        Path(folder).mkdir(parents=True, exist_ok=True)
        for r in rows:
            Path(folder, f"{quote(r.doc_id, safe='')}.{r.kind}").write_bytes(bytes(r.content))

    files.foreachPartition(put)
