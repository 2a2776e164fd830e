"""Readings of pages, before any table is looked for: which pages have a text layer, which engine reads the others, and whether a
second reading takes the place of the first."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.operators.layout import accept_reread, page_skew

PAGE = ["doc_id", "page_no"]


def text_layer(text: Column) -> Column:
    """Whether a page's own text is enough to be read; a page with less, or none, is a scan."""
    return F.coalesce(F.length(text) >= V.TEXT_LAYER_CHARS, F.lit(False))


def resolve_engine(engine: Column, available: Sequence[str] = (), needed: Column | None = None) -> Column:
    """(source, error) of the engine asked for: ``auto`` is the first available one; a name that is not known, or ``auto`` with none
    available, is an error. Where no page needs an engine (``needed`` is false), any name is fine and nothing is resolved."""
    unknown = F.concat(F.lit("unknown engine '"), engine, F.lit(f"' (expected auto, {', '.join(V.ENGINES)})"))
    first = F.lit(available[0] if available else None).cast("string")
    source = F.when(engine == "auto", first).when(engine.isin(*V.ENGINES), engine)
    error = F.when((engine == "auto") & first.isNull(), V.NO_ENGINE).when((engine != "auto") & ~engine.isin(*V.ENGINES), unknown)
    use = F.lit(True) if needed is None else needed
    return F.struct(F.when(use, source).alias("source"), F.when(use, error).alias("error"))


def reread(first: DataFrame, second: DataFrame, unit: float = 1.0) -> DataFrame:
    """The words of each page, in page units: those of the ``second`` reading, made of the levelled and enlarged picture, where the first
    one leans or is small and the second has kept most of its words; else those of the ``first``.

    Both are (doc_id, page_no, line, word_no, text, x0, x1, top, bottom) in pixels; ``unit`` is pixels a page unit. Pages that the
    first reading finds empty stay empty.
    """
    skew = page_skew(first)
    n1 = first.groupBy(*PAGE).agg(F.count("*").alias("n1"))
    n2 = second.groupBy(*PAGE).agg(F.count("*").alias("n2"))
    due = skew.where("reread").join(n1, PAGE).join(n2, PAGE).where(accept_reread(F.col("n1"), F.col("n2"))).select(*PAGE, "zoom")

    def scaled(df: DataFrame, by: Column) -> DataFrame:
        return df.withColumns({c: F.col(c) / by for c in ("x0", "x1", "top", "bottom")})

    kept = scaled(first.join(due, PAGE, "left_anti"), F.lit(unit))
    return kept.unionByName(scaled(second.join(due, PAGE), F.lit(unit) * F.col("zoom")).drop("zoom"), allowMissingColumns=True)


def second_chance(first: dict[str, DataFrame], ocr: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The results of ``process_words`` over the pages' own text and over their pictures, as one: a document whose text layer gave no
    ledger rows takes the results of its pictures if those have some."""
    none = first["summary"].where(F.col("rows") == 0).where(F.array_contains("sources", "pdf-text")).select("doc_id")
    taken = ocr["summary"].where(F.col("rows") > 0).select("doc_id").join(none, "doc_id", "left_semi")
    one = lambda k: first[k].join(taken, "doc_id", "left_anti").unionByName(ocr[k].join(taken, "doc_id", "left_semi"))
    return {k: one(k) for k in first}
