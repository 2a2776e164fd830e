"""Files in, result files out: each document's files by its shape, one JSON object a document, errors as rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.functions.predicates import file_kind
from tallyweave.operators.pipeline import MODES, export_columns, process_grids, process_words
from tallyweave.operators.readings import resolve_engine
from tallyweave.sources.office import parse_grids
from tallyweave.sources.sinks import grid_files, ledger_files, text_files

#: Of a document's summary, what its result shows.
SUMMARY = ("rows", "rows_with_balance", "sign_convention", "balance_checked", "balance_mismatches", "sources", "document_shape")
ERROR = "doc_id string, error string"


def tables(out: dict[str, DataFrame]) -> DataFrame:
    """(doc_id, row_no, cells) of the documents that are tables: their grid, or their pairs under a header of two columns."""
    row = lambda n, *c: F.struct(n.cast("long").alias("row_no"), F.array(*c).alias("cells"))
    body = row(F.col("pos") + 1, F.col("field"), F.col("value"))
    head = row(F.lit(0), F.lit("field"), F.lit("value"))
    pairs = out["pairs"].select("doc_id", F.inline(F.when(F.col("pos") == 0, F.array(head, body)).otherwise(F.array(body))))
    return out["grid"].select("doc_id", "row_no", "cells").unionByName(pairs)


def result_files(out: dict[str, DataFrame], stem: str | None = None) -> DataFrame:
    """(doc_id, kind, name, content) by shape: a ledger as csv, xlsx and docx, a table as csv, xlsx and text, a text as text and docx.

    A name is the document's own, or ``stem``, with the kind's ending. An optional file that cannot be written is a row of the
    kind ``<kind>_error`` without a name, whose content says why; a document with an error has no files.
    """
    s = out["summary"]
    s = s if "text" in s.columns else s.join(out["texts"], "doc_id", "left")
    texts = lambda shape, *kinds: text_files(s.where(F.col("document_shape") == shape).select("doc_id", "text"), kinds)
    files = ledger_files(out["ledger"]).unionByName(grid_files(tables(out))).unionByName(texts("table", "txt")).unionByName(texts("text", "txt", "docx"))
    base = F.regexp_replace(F.regexp_extract("doc_id", r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "") if stem is None else F.lit(stem)
    name = F.when(~F.col("kind").endswith("_error"), F.concat_ws(".", base, "kind"))
    return files.select("doc_id", F.when(F.col("kind") == "txt", "text").otherwise(F.col("kind")).alias("kind"), name.alias("name"), "content")


def results(out: dict[str, DataFrame], files: DataFrame, content: bool = False) -> DataFrame:
    """(doc_id, ok, json): a document's shape, summary, rows, grid and the names of its files, with the files themselves as base64 if
    ``content`` is asked for; of one that failed, the error alone. Columns that begin with an underscore are left out."""
    row = F.struct("row_no", F.struct(*V.EXPORT_COLUMNS).alias("r"))
    in_order = lambda df, x, name: df.groupBy("doc_id").agg(F.array_sort(F.collect_list(x)).alias(name))
    ledger = in_order(export_columns(out["ledger"]), row, "ledger")
    grid = in_order(tables(out), F.struct("row_no", "cells"), "grid")
    is_file = F.col("name").isNotNull()
    entry = F.struct("kind", F.when(is_file, F.col("name")).otherwise(F.decode("content", "UTF-8")))
    f = files.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("outputs"), *([F.map_from_entries(F.array_sort(F.collect_list(F.when(is_file, F.struct(F.concat("kind", F.lit("_b64")), F.base64("content")))))).alias("b64")] if content else []))
    d = out["summary"].join(ledger, "doc_id", "left").join(grid, "doc_id", "left").join(f, "doc_id", "left")
    empty = lambda c, x: F.coalesce(F.transform(c, x), F.array())
    fields = (F.lit(True).alias("ok"), "document_shape", F.struct(*SUMMARY).alias("summary"), empty("ledger", lambda x: x["r"]).alias("rows"), empty("grid", lambda x: x["cells"]).alias("grid"), "outputs", "text_preview", "message")
    json = F.to_json(F.struct(*fields))
    if content:
        json = F.concat(F.expr("left(j, length(j) - 1)"), F.lit(","), F.substring(F.to_json("b64"), 2, 2**31 - 1))
        d = d.withColumn("j", F.to_json(F.struct(*fields)))
    return d.select("doc_id", "ok", F.when(F.col("ok"), json).otherwise(F.to_json(F.struct("ok", "error"))).alias("json"))


def failures(spark: SparkSession, rows: DataFrame) -> DataFrame:
    """Summary rows of ``rows(doc_id, error)``: documents of which nothing but the error is known."""
    return rows.select("doc_id", F.lit(False).alias("ok"), "error")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def process(spark: SparkSession, paths: Sequence[str], mode: str = "auto", engine: str = "auto", available: Sequence[str] = (), reader: Callable[[DataFrame], tuple[DataFrame, DataFrame]] | None = None) -> dict[str, DataFrame]:
    """All results of the files at ``paths``, as ``process_words`` and ``process_grids`` give them; whatever goes wrong with a file is a
    summary row with ``ok`` false. A path that is named twice is one document.

    ``reader`` turns ``files(path, content)`` of PDFs and pictures into words and pages; without one, or with no engine for it,
    such files are errors. Paths are given by name, so their list is the caller's; what is in the files stays on the executors.
    """
    paths = list(dict.fromkeys(paths))
    if mode not in MODES:
        return _only(spark, [(p, f"unknown mode '{mode}' (expected {', '.join(MODES)})") for p in paths])
    there = [p for p in paths if _is_file(spark, p)]
    gone = spark.createDataFrame([(p, f"file not found: {p}") for p in paths if p not in set(there)], ERROR)
    if not there:
        return _only(spark, gone)
    # a loaded path carries its file system; the document keeps the name that it was asked for by
    names = spark.createDataFrame([(p, _loaded(spark, p)) for p in there], "path string, loaded string")
    files = spark.read.format("binaryFile").load(there).select(F.col("path").alias("loaded"), "content").join(F.broadcast(names), "loaded").drop("loaded")
    out = process_grids(parse_grids(files), mode)
    pixels = names.where(file_kind(F.col("path"))["route"] != "grid").select("path")
    engines = resolve_engine(F.lit(engine), available)
    heic = file_kind(F.col("path"))["ext"].isin(".heic", ".heif")
    checked = pixels.select(F.col("path").alias("doc_id"), F.coalesce(F.when(heic, F.lit(V.NO_HEIC)), engines["error"], F.lit(V.NO_ENGINE if reader is None else None)).alias("error"))
    failed = gone.unionByName(checked.where("error IS NOT NULL"))
    if reader is not None:
        own = checked.where("error IS NULL").select(F.col("doc_id").alias("path"))
        words, pages = reader(files.join(F.broadcast(own), "path", "left_semi"))
        more = process_words(words, pages, mode)
        out = {k: out[k].unionByName(more[k], allowMissingColumns=True) for k in out}
    out["summary"] = out["summary"].unionByName(failures(spark, failed), allowMissingColumns=True)
    return out


def _loaded(spark: SparkSession, path: str) -> str:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).getPath().toString()


def _only(spark: SparkSession, rows: DataFrame | list[tuple[str, str]]) -> dict[str, DataFrame]:
    """Results that are errors and nothing else, with the columns of any others."""
    none = process_grids(spark.createDataFrame([], "doc_id string, grid_no int, row_no int, cells array<string>, error string"))
    rows = spark.createDataFrame(rows, ERROR) if isinstance(rows, list) else rows
    return none | {"summary": none["summary"].unionByName(failures(spark, rows), allowMissingColumns=True)}
