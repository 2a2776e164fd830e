"""From words, grids and candidate readings to results: arbitration, shapes, summaries; errors are rows."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.functions.predicates import filled
from tallyweave.operators.grid import document_grid, grid_from_ruled, grid_from_words, records_from_grid
from tallyweave.operators.layout import rows_from_words, shared_rows, visual_rows
from tallyweave.operators.pairs import pairs_from_text
from tallyweave.operators.reconcile import normalize_rows, reconcile, summarize

MODES = ("auto", "table", "text")


def arbitrate(candidates: DataFrame) -> DataFrame:
    """The winning reading of each document of ``candidates(doc_id, source, priority, rows, verified, parsed, all_text_layer)``.

    Readings are tried by priority until one verifies all of its rows or is all text layer; of those tried, the most verified rows
    win, then the most parsed cells, then the first.
    """
    done = ((F.col("rows") > 0) & (F.col("verified") == F.col("rows"))) | F.col("all_text_layer")
    c = candidates.withColumn("stop", F.min(F.when(done, F.col("priority"))).over(Window.partitionBy("doc_id")))
    c = c.where(F.col("stop").isNull() | (F.col("priority") <= F.col("stop")))
    best = F.max_by(F.struct("source", "priority", "rows", "verified", "parsed"), F.struct("verified", "parsed", -F.col("priority")))
    return c.groupBy("doc_id").agg(best.alias("b")).select("doc_id", "b.*")


def decide_shape(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, rows, balance_checked, ruled, office, grid_rows, pairs, mode)`` with ``document_shape``: a ledger, unless it is a
    ruled sheet whose balances cannot be checked; else a table from a grid or pairs; else text."""
    kept = (F.col("rows") > 0) & ~(F.col("ruled") & ~F.col("balance_checked") & ~F.col("office")) & (F.col("mode") != "text")
    table = (((F.col("grid_rows") > 0) & ~F.col("office")) | (F.col("pairs") > 0)) & (F.col("mode") != "text")
    return docs.withColumn("document_shape", F.when(kept, "ledger").when(table, "table").otherwise("text"))


def said(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, document_shape, mode, text, error)`` with ok, and for all but ledgers the preview and the message; one with an
    error has neither shape nor text."""
    failed = F.col("error").isNotNull()
    plain = ~failed & (F.col("document_shape") != "ledger")
    message = F.when(F.col("mode") == "text", V.SAID_TEXT).when(F.col("document_shape") == "table", V.SAID_TABLE).otherwise(V.SAID_NOTHING)
    d = docs.withColumns({"ok": ~failed, "text_preview": F.when(plain, F.substring(F.coalesce("text", F.lit("")), 1, V.PREVIEW_CHARS)), "message": F.when(plain, message)})
    return d.withColumn("document_shape", F.when(~failed, F.col("document_shape")))


def page_texts(words: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, text): words in reading order, a line a visual row, pages one after the other."""
    r = (visual_rows(words) if rows is None else rows).select("doc_id", F.struct("page_no", "row_no", F.expr("array_join(transform(ws, w -> w.text), ' ')").alias("t")).alias("x"))
    return r.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), "\n").alias("text"))


def process_words(words: DataFrame, pages: DataFrame, mode: str = "auto") -> dict[str, DataFrame]:
    """All results of documents given as words: ``ledger`` rows, ``grid`` rows, ``pairs`` and a ``summary`` row a document.

    ``pages(doc_id, page_no, width, source, vlines)``; ``vlines`` may be null.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode '{mode}' (expected {', '.join(MODES)})")
    rows = shared_rows(words)
    audited = reconcile(normalize_rows(rows_from_words(words, pages, rows)))
    per = summarize(audited)
    ruled = pages.where("size(vlines) > 0").select("doc_id", "page_no", "vlines")
    plain = rows.join(ruled.select("doc_id", "page_no"), ["doc_id", "page_no"], "left_anti")
    grids = grid_from_ruled(words, ruled, rows).unionByName(grid_from_words(words, pages, rows=plain))
    grid = document_grid(grids)
    texts = page_texts(words, rows)
    pairs = pairs_from_text(texts)
    d = pages.groupBy("doc_id").agg(F.array_sort(F.collect_set("source")).alias("sources"), F.max(F.coalesce(F.size("vlines") > 0, F.lit(False))).alias("ruled"))
    d = d.join(per, "doc_id", "left").join(grid.groupBy("doc_id").agg(F.count("*").alias("grid_rows")), "doc_id", "left").join(pairs.groupBy("doc_id").agg(F.count("*").alias("pairs")), "doc_id", "left").join(texts, "doc_id", "left")
    d = d.na.fill(0, ["rows", "rows_with_balance", "verified", "parsed", "grid_rows", "pairs"]).na.fill(False, ["balance_checked"]).na.fill("unknown", ["sign_convention"])
    s = decide_shape(d.withColumn("office", F.lit(False)).withColumn("mode", F.lit(mode)))
    s = said(s.withColumn("error", F.lit(None).cast("string")))
    shaped = lambda df, shape: df.join(s.where(F.col("document_shape") == shape).select("doc_id"), "doc_id", "left_semi")
    return {"ledger": shaped(audited, "ledger"), "grid": shaped(grid, "table"), "pairs": shaped(pairs, "table").join(s.where("grid_rows > 0").select("doc_id"), "doc_id", "left_anti"), "summary": s, "texts": texts}


def process_grids(grids: DataFrame, mode: str = "auto") -> dict[str, DataFrame]:
    """The results of office files given as ``grids(doc_id, grid_no, row_no, cells)``: all sheets of a file are one ledger. A row with an
    ``error`` stands for a file that could not be read, whose result says so; a file without cells has an empty text.

    The audited rows, the pairs and the summary, which several results read, are made once and held (memory, then disk) until
    ``spark.catalog.clearCache()``."""
    hold = lambda df: df.persist(StorageLevel.MEMORY_AND_DISK)
    if mode not in MODES:
        raise ValueError(f"unknown mode '{mode}' (expected {', '.join(MODES)})")
    error = F.max("error") if "error" in grids.columns else F.lit(None).cast("string")
    audited = hold(reconcile(normalize_rows(records_from_grid(grids.where(F.lit(mode != "text") & F.col("cells").isNotNull())))))
    line = F.struct("grid_no", "row_no", F.expr("array_join(filter(cells, c -> c <> ''), ' ')").alias("t"))
    lines = F.array_sort(F.collect_list(F.when(F.col("x.t") != "", F.col("x"))))
    files = hold(grids.withColumn("x", line).groupBy("doc_id").agg(error.alias("error"), F.array_join(F.transform(lines, lambda x: x["t"]), "\n").alias("text")))
    texts = files.select("doc_id", "text")
    pairs = hold(pairs_from_text(texts))
    d = files.join(summarize(audited), "doc_id", "left").join(pairs.groupBy("doc_id").agg(F.count("*").alias("pairs")), "doc_id", "left")
    d = d.na.fill(0, ["rows", "rows_with_balance", "verified", "parsed", "pairs"]).na.fill(False, ["balance_checked"]).na.fill("unknown", ["sign_convention"])
    s = decide_shape(d.withColumns({"office": F.lit(True), "ruled": F.lit(False), "grid_rows": F.lit(0).cast("long"), "mode": F.lit(mode), "sources": F.array(F.lit("grid"))}))
    s = hold(said(s))
    shaped = lambda df, shape: df.join(s.where(F.col("document_shape") == shape).select("doc_id"), "doc_id", "left_semi")
    no_grid = grids.sparkSession.createDataFrame([], "doc_id string, row_no long, cells array<string>")
    return {"ledger": shaped(audited, "ledger"), "grid": no_grid, "pairs": shaped(pairs, "table"), "summary": s, "texts": texts}


def export_columns(rows: DataFrame) -> DataFrame:
    """Ledger rows as they are exported: text, nulls empty, in the fixed order."""
    have = set(rows.columns)
    return rows.select("doc_id", "row_no", *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in have else F.lit("").alias(c) for c in V.EXPORT_COLUMNS))


def used_columns(rows: DataFrame) -> DataFrame:
    """(doc_id, columns): the exported columns of each document; optional ones only if a row has them."""
    flags = rows.groupBy("doc_id").agg(*(F.max(filled(F.col(c))).alias(c) for c in V.OPTIONAL_COLUMNS))
    cols = F.array(*(F.when(F.col(c), F.lit(c)) if c in V.OPTIONAL_COLUMNS else F.lit(c) for c in V.EXPORT_COLUMNS))
    return flags.select("doc_id", F.array_join(F.array_compact(cols), ",").alias("columns"))
