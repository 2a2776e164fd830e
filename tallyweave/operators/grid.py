"""Generic tables: cells from drawn rulings, from white gaps, and records from cell grids."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.functions import vocabulary as V
from tallyweave.functions.money import fix_ocr_digits
from tallyweave.functions.predicates import header_canon
from tallyweave.operators.layout import char_widths, computed, shared_rows, visual_rows

cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: Pages whose bins a task counts at once.
_GAPS = 1000


def grid_from_ruled(words: DataFrame, rulings: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, row_no, cells): a word is in the cell between the rulings around its centre; text that runs over a
    ruling that is not drawn on its row stays in the cell where it began."""
    r = (visual_rows(words) if rows is None else rows).join(rulings, ["doc_id", "page_no"])
    r = computed(r, y=F.expr("aggregate(ws, 0D, (a, w) -> a + (w.top + w.bottom) / 2) / size(ws)"))
    r = computed(r, drawn=F.expr("transform(vlines, v -> exists(v.spans, s -> s.top <= y AND y <= s.bottom))"))
    at = "size(filter(vlines, v -> v.x <= (w.x0 + w.x1) / 2))"
    fold = f"""aggregate(ws, named_struct('prev', cast(null as int), 'cols', cast(array() as array<int>)),
      (s, w) -> CASE WHEN s.prev IS NOT NULL AND {at} > s.prev AND NOT exists(slice(drawn, s.prev + 1, {at} - s.prev), d -> d)
        THEN named_struct('prev', s.prev, 'cols', concat(s.cols, array(s.prev))) ELSE named_struct('prev', {at}, 'cols', concat(s.cols, array({at}))) END).cols"""
    r = computed(r, cols=F.expr(fold))
    cells = "transform(sequence(0, size(vlines)), c -> array_join(transform(filter(zip_with(ws, cols, (w, k) -> named_struct('w', w, 'k', k)), z -> z.k = c), z -> z.w.text), ' '))"
    return r.select("doc_id", "page_no", "row_no", F.expr(cells).alias("cells"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Separators of ``_GAPS`` pages at a time. Ink and spans are counted over bins by where they begin and end."""
    for whole in batches:
        for at in range(0, whole.num_rows, _GAPS):
            b = whole.slice(at, _GAPS)
            width = b["bins"].to_numpy(zero_copy_only=False).astype(np.int64)
            base = np.concatenate(([0], np.cumsum(width + 1)))

            def parts(c: str, b: pa.RecordBatch = b) -> tuple[np.ndarray, np.ndarray]:
                """The page of each element of the lists, and the elements."""
                sizes = pc.list_value_length(b[c]).to_numpy(zero_copy_only=False)
                return np.repeat(np.arange(b.num_rows), sizes), b[c].flatten().to_numpy(zero_copy_only=False)

            def count(lo: str, hi: str, width: np.ndarray = width, base: np.ndarray = base) -> np.ndarray:
                (page, first), (_, last) = parts(lo), parts(hi)
                first, last = np.maximum(first.astype(np.int64), 0), np.minimum(last.astype(np.int64), width[page] - 1)
                there = last >= first
                at = base[page[there]]
                return np.cumsum(np.bincount(at + first[there], minlength=base[-1]) - np.bincount(at + last[there] + 1, minlength=base[-1]))

            spanning, inked = count("lo", "hi"), count("x0", "x1")
            white = np.concatenate(([0], ((spanning >= 2) & (4 * inked <= spanning)).astype(np.int8), [0]))
            turns = np.diff(white)
            first, after = np.flatnonzero(turns == 1), np.flatnonzero(turns == -1)
            page, sizes = np.searchsorted(base, first, "right") - 1, np.bincount(parts("cw")[0], minlength=b.num_rows)
            of, cw = parts("cw")
            cw = cw[np.lexsort((cw, of))]
            some = sizes > 0
            gap = np.full(b.num_rows, np.inf)
            gap[some] = 3 * cw[(np.cumsum(sizes) - sizes + sizes // 2)[some]]
            wide = after - first >= gap[page]
            page = page[wide]
            sep = (first[wide] + after[wide]) / 2 - base[page]
            yield pa.RecordBatch.from_arrays([*(b[c].take(pa.array(page)) for c in b.schema.names[:-6]), pa.array(sep)], [*b.schema.names[:-6], "sep"])


def page_separators(pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, sep) of ``pages(doc_id, page_no, width, rows)``, rows sorted from left to right: middles of the runs of 1-point bins, at least three
    characters wide, at which no more than a quarter of the rows that span them, two at least, have ink."""
    key = ["doc_id", "page_no"]
    p = computed(pages.select(*key, (F.floor("width") + 1).cast("int").alias("bins"), "rows"), ws=F.flatten("rows"))
    each = lambda ws, x: f"transform({ws}, w -> {x})"
    row = {"lo": "int(get(ws, 0).x0)", "hi": f"int(array_max({each('ws', 'w.x1')}))"}
    lists = [F.expr(f"transform(rows, ws -> {x})").alias(c) for c, x in row.items()] + [F.expr(each("ws", f"int(w.{c})")).alias(c) for c in ("x0", "x1")]
    p = p.select(*key, "bins", *lists, F.expr(char_widths("ws")).alias("cw"))
    schema = T.StructType([p.schema[c] for c in key] + [T.StructField("sep", T.DoubleType())])
    return p.mapInArrow(_runs, schema)


def white_gap_separators(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, sep) of visual rows and ``pages(doc_id, page_no, width)``, as ``page_separators`` finds them."""
    key = ["doc_id", "page_no"]
    return page_separators(rows.groupBy(*key).agg(F.collect_list("ws").alias("rows")).join(pages.select(*key, "width"), key))


def grid_from_words(words: DataFrame, pages: DataFrame, min_rows: int = 3, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, page_no, row_no, cells) of the pages that look like tables: ``min_rows`` rows with two filled cells at least."""
    rows = shared_rows(words) if rows is None else rows
    seps = white_gap_separators(rows, pages).groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list("sep")).alias("seps"))
    cells = "transform(sequence(0, size(seps)), c -> array_join(transform(filter(ws, w -> size(filter(seps, s -> (w.x0 + w.x1) / 2 > s)) = c), w -> w.text), ' '))"
    g = computed(rows.join(seps, ["doc_id", "page_no"]), cells=F.expr(cells)).select("doc_id", "page_no", "row_no", "cells")
    full = F.count(F.when(F.expr("size(filter(cells, c -> c <> '')) >= 2"), 1)).over(Window.partitionBy("doc_id", "page_no"))
    return g.withColumn("full", full).where(F.col("full") >= min_rows).drop("full")


def document_grid(grids: DataFrame) -> DataFrame:
    """(doc_id, row_no, cells): the pages' grids as one. Rows that repeat the first page's top rows are kept once, rows are filled
    up to the widest, columns that are never used go, and numbers are cleaned of look-alike letters."""
    nth = Window.partitionBy("doc_id", "page_no").orderBy("row_no")
    g = grids.withColumn("i", F.row_number().over(nth)).withColumn("first_page", F.min("page_no").over(Window.partitionBy("doc_id")))
    first = g.where("page_no = first_page").select("doc_id", "i", F.col("cells").alias("top"))
    g = g.join(first, ["doc_id", "i"], "left")
    same = F.col("cells") == F.col("top")
    differs = F.min(F.when(~F.coalesce(same, F.lit(False)), F.col("i"))).over(Window.partitionBy("doc_id", "page_no"))
    g = g.withColumn("from", differs).where("page_no = first_page OR i >= `from`")
    g = g.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "i")))
    wide = Window.partitionBy("doc_id")
    g = g.withColumn("wide", F.max(F.size("cells")).over(wide))
    used = g.select("doc_id", F.posexplode("cells").alias("c", "v")).where("v <> ''").groupBy("doc_id").agg(F.array_sort(F.collect_set("c")).alias("used"))
    g = g.join(used, "doc_id", "left")
    cell = F.transform(F.coalesce("used", F.array().cast("array<int>")), lambda c: fix_ocr_digits(F.coalesce(F.get("cells", c), F.lit(""))))
    return g.select("doc_id", F.col("n").cast("long").alias("row_no"), cell.alias("cells"))


def records_from_grid(grids: DataFrame) -> DataFrame:
    """(doc_id, row_no, ledger columns) of cell grids ``(doc_id, grid_no, row_no, cells)``. The header is the first of the top ten rows
    with two named cells; of columns with one name the last filled one counts; grids follow each other in order."""
    # numbered by document first, so that rows meet once, by document, and all else keeps that order
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy("grid_no", "row_no"))
    grid = Window.partitionBy("doc_id", "grid_no")
    g = grids.select("doc_id", "grid_no", "row_no", "cells", n.alias("n")).withColumns({"start": F.min("n").over(grid), "rows": F.count("*").over(grid)})
    names = F.when(F.col("n") - F.col("start") < V.HEADER_ROWS, F.transform("cells", lambda c: header_canon(F.coalesce(c, F.lit("")))))
    g = computed(g, names=names).withColumn("header", F.expr("size(filter(names, n -> n IS NOT NULL)) >= 2"))
    # for each ledger column the places of the cells with its name
    places = F.array(*(F.expr(f"filter(sequence(0, size(names) - 1), i -> get(names, i) = '{c}')") for c in V.COLUMNS))
    g = g.withColumn("places", F.when(F.col("header"), places))
    r = g.withColumns({"hi": F.min(F.when(F.col("header"), F.col("n"))).over(grid), "at": F.min_by("places", F.when(F.col("header"), F.col("n"))).over(grid)})
    r = r.where("n > hi AND rows >= 2").select("doc_id", "n", "cells", *(F.get("at", F.lit(k)).alias(f"at_{c}") for k, c in enumerate(V.COLUMNS)))
    value = """CASE size(at_{0}) WHEN 0 THEN NULL WHEN 1 THEN replace(nullif(trim(get(cells, get(at_{0}, 0))), ''), '\n', ' ')
      ELSE replace(try_element_at(filter(transform(at_{0}, i -> trim(get(cells, i))), c -> c <> ''), -1), '\n', ' ') END"""
    r = computed(r, **{c: F.expr(value.format(c)) for c in V.COLUMNS})
    r = r.where(F.coalesce(*V.COLUMNS).isNotNull())
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("n"))
    return r.select("doc_id", number.cast("long").alias("row_no"), *V.COLUMNS)
