"""Predicates and labels of ledger rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.functions.money import let


#: What a label that names a column must hold: a word that is an entry, or begins one.
_NAMED = r"(?<![a-z0-9])(?:" + "|".join(sorted({s.split()[0] for _, entries in V.HEADER_WORDS for s in entries})) + r")(?![a-z0-9])"


def header_canon(label: Column) -> Column:
    """The ledger column that a header label names, by whole words, or null; the first in the vocabulary's order wins."""

    def named(words: Column) -> Column:
        hit = lambda s: reduce(lambda a, b: a & b, (F.array_contains(words, w) for w in s.split()))
        out = F.lit(None).cast("string")
        for name, entries in reversed(V.HEADER_WORDS):
            single = [s for s in entries if " " not in s]
            test = F.arrays_overlap(words, F.array(*map(F.lit, single)))
            for s in entries:
                if " " in s:
                    test = test | hit(s)
            out = F.when(test, name).otherwise(out)
        return out

    return F.when(F.lower(label).rlike(_NAMED), let(F.regexp_extract_all(F.lower(label), F.lit("[a-z0-9]+"), F.lit(0)), named))


def date_like(c: Column) -> Column:
    return F.coalesce(c.rlike(V.DATE_LIKE), F.lit(False))


def filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def is_total(date: Column, *texts: Column) -> Column:
    """A subtotal line: no date, and one of the texts begins with 'total'."""
    return ~date_like(date) & reduce(lambda a, b: a | b, (F.coalesce(F.lower(t).startswith("total"), F.lit(False)) for t in texts))


def is_opening(balance: Column, date: Column, *moves: Column) -> Column:
    """A dateless line with a balance whose movement cells are empty as written: the running balance starts over."""
    return balance.isNotNull() & ~date_like(date) & ~reduce(lambda a, b: a | b, map(filled, moves))


def file_kind(path: Column) -> Column:
    """(ext, route): grid, image or pdf, by the lower-cased extension."""
    ext = F.lower(F.regexp_extract(path, r"[^./\\](\.[^./\\]*)$", 1))
    return F.struct(ext.alias("ext"), F.when(ext.isin(*V.GRID_KINDS), "grid").when(ext.isin(*V.IMAGE_KINDS), "image").otherwise("pdf").alias("route"))


def version_parts(tag: Column) -> Column:
    """The first three numbers of a version tag, compared as numbers; [0] if there is none."""
    parts = F.transform(F.slice(F.regexp_extract_all(tag, F.lit(r"\d+"), F.lit(0)), 1, 3), lambda x: x.cast("int"))
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(F.lit(0)))

