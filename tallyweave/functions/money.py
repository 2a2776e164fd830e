"""Money strings to exact decimals, as one Column expression."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V

MONEY = "decimal(28,6)"
# Full-width forms, no-break and wide spaces: what compatibility folding does to the signs of a money cell.
_WIDE = "０１２３４５６７８９．，－＋（）＄   　"
_PLAIN = "0123456789.,-+()$    "
# Cells that say what they are: plain numbers, and cells without anything that could be a digit, or dates, which are no money.
_EASY = r"\A-?(?:\d+|\d{1,3}(?:,\d{3})*\.\d\d|\d+\.\d\d)\z"
_NEVER = r"\A(?:(?!(?s:.*)[oO][.,．，][oO])[^\d０-９]*|\d+-\d+-\d+)\z"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def fix_ocr_digits(c: Column) -> Column:
    """Letters read for digits, within tokens that are numbers otherwise; runs of white space become one space."""
    return F.array_join(F.transform(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " "), lambda x: F.when(x.rlike(V.OCR_NUMBER), F.translate(x, "OoIl|", "00111")).otherwise(x)), " ")


def _number(t: Column) -> Column:
    """The plain decimal string of digits and separators, null where the grouping does not hold."""
    bare = F.regexp_replace(t, "[.,]", "")
    return (
        F.when(t.rlike(r"^\d+$"), t)
        .when(t.rlike(r"^\d{1,3}(?:,\d{3})+\.\d*$"), F.replace(t, F.lit(","), F.lit("")))
        .when(t.rlike(r"^\d{1,3}(?:\.\d{3})+,\d*$"), F.translate(t, ",.", "."))
        .when(t.rlike(r"^\d{1,3}(?:,\d{3}){2,}$|^\d{1,3}(?:\.\d{3}){2,}$|^\d{1,3}[.,]\d{3}$"), bare)
        .when(t.rlike(r"^\d*[.,]\d*$") & t.rlike(r"\d"), F.translate(t, ",", "."))
    )


def parse_money(c: Column) -> Column:
    """DECIMAL(28,6) of a money cell, or null: an unreadable cell is never guessed.

    US, European and spaced thousands; parentheses, leading and trailing minus, DR and DB negative; currency signs
    and codes dropped; letters within a number, words and several numbers are rejected. More than six decimals are rounded,
    more than 22 integer digits give null. Digits are ASCII or full-width.
    """

    def parsed(t: Column) -> Column:
        return let(F.translate(t, "−–—", "---"), unwrapped)

    def unwrapped(t: Column) -> Column:
        wrapped = F.startswith(t, F.lit("(")) & F.endswith(t, F.lit(")")) & (F.length(t) > 1)
        inner = F.when(wrapped, F.substring(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        return let(F.struct(wrapped.alias("neg"), fix_ocr_digits(inner).alias("t")), judged)

    def judged(s: Column) -> Column:
        t = s["t"]
        reject = t.rlike(r"[\d.,][A-Za-z]+\d|^(?![A-Z]{3}\d)[A-Za-z]+\d|[A-Za-z]{4,}")
        neg = s["neg"] | F.upper(t).rlike(r"\bDR\b|DR$|DB$")
        core = F.trim(F.regexp_replace(t, r"[^\d.,\s\-]", ""))
        return F.when(~reject, let(F.struct(neg.alias("neg"), core.alias("t")), signed))

    def signed(s: Column) -> Column:
        grouped = ~s["t"].rlike(r"\s") | s["t"].rlike(r"^-*\d{1,3}(?:\s+\d{3})*\s+\d{3}(?:[.,]\d+)?$")
        return F.when(grouped, let(F.struct(s["neg"].alias("neg"), F.regexp_replace(s["t"], r"\s", "").alias("t")), valued))

    def valued(s: Column) -> Column:
        neg = s["neg"] | s["t"].rlike("^-|-$")
        body = F.regexp_replace(F.regexp_replace(s["t"], "-$", ""), "^-", "")
        v = let(body, lambda b: _number(b).try_cast(MONEY))
        return F.when(neg, -v).otherwise(v).cast(MONEY)

    t = F.trim(F.translate(c, _WIDE, _PLAIN))
    easy = F.replace(c, F.lit(","), F.lit("")).try_cast(MONEY)
    return F.when(c.rlike(_EASY), easy).when(c.rlike(_NEVER), None).when(c.isNotNull(), let(t, lambda x: F.when(~x.isin("", "-", "—", "N/A", "n/a", "NA"), parsed(x)))).cast(MONEY)
