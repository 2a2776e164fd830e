"""The running-balance audit as windows over a document's rows.

All windows are by document and by segment of a document, so the audit costs one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.functions.money import parse_money
from tallyweave.functions.predicates import date_like, is_opening, is_total

PARSED = {f"_{c}": c for c in V.MONEY_COLUMNS}


def complete(rows: DataFrame) -> DataFrame:
    """``rows`` with all ledger columns; those that are not there are null."""
    return rows.select("*", *(F.lit(None).cast("string").alias(c) for c in V.COLUMNS if c not in rows.columns))


def normalize_rows(rows: DataFrame) -> DataFrame:
    """Attach parsed money; drop rows with neither a date nor any money."""
    r = complete(rows)
    r = r.withColumns({p: parse_money(F.col(c)) for p, c in PARSED.items()})
    return r.where(date_like(F.col("date")) | F.coalesce(*(F.col(p) for p in PARSED)).isNotNull())


def _delta(sign: int) -> Column:
    """The balance's change on a row if debits raise (1) or lower (-1) it; null without a movement."""
    zero = F.lit(0).cast("decimal(28,6)")
    d, c, a = F.col("_debit"), F.col("_credit"), F.col("_amount")
    d0, c0 = F.coalesce(d, zero), F.coalesce(c, zero)
    move = F.when(d.isNull() & c.isNull(), a if sign > 0 else -a).otherwise(d0 - c0 if sign > 0 else c0 - d0)
    return move.cast("decimal(28,6)")


def reconcile(rows: DataFrame, doc: str = "doc_id", order: str = "row_no") -> DataFrame:
    """Normalized rows with ``flag`` (null, or what was expected and printed) and the document's ``sign_convention``,
    ``rows_with_balance``, ``balance_checked`` and ``balance_mismatches`` on each row.

    Printed balances vote on the sign; the audit then runs from the first balance, or the last opening line, by the rows'
    own movements, so that one bad balance is flagged once.
    """
    tol = F.lit(V.TOLERANCE).cast("decimal(4,2)")
    whole = Window.partitionBy(doc)
    r = rows.withColumn("_total", is_total(F.col("date"), F.col("type"), F.col("date"), F.col("description")))
    r = r.withColumn("_voter", F.col("_balance").isNotNull() & ~F.col("_total"))
    # the previous printed balance: of rows that have one and are no totals
    before = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    prev = F.last(F.when(F.col("_voter"), F.col("_balance")), ignorenulls=True).over(before)
    vote = lambda s: F.count(F.when(F.col("_voter") & (F.abs(F.col("_prev") + _delta(s) - F.col("_balance")) <= tol), 1)).over(whole)
    some = lambda c: F.max(F.coalesce(c, F.lit(False))).over(whole)
    r = r.withColumn("_prev", prev).withColumns(
        {
            "_pos": vote(1),
            "_neg": vote(-1),
            "_dc": some(F.col("_debit").isNotNull() | F.col("_credit").isNotNull()),
            "_am": some(F.col("_voter") & F.col("_amount").isNotNull()),
            "rows_with_balance": F.count(F.when(F.col("_voter"), 1)).over(whole),
        }
    )
    alone = ~F.col("_dc") & F.col("_am")
    unknown = (F.greatest("_pos", "_neg") < 2) | (F.col("_pos") == F.col("_neg"))
    sign = F.when(alone, F.when(F.col("_pos") >= F.col("_neg"), 1).otherwise(-1)).when(unknown, 0).when(F.col("_pos") > F.col("_neg"), 1).otherwise(-1)
    convention = F.when(alone, "single_amount_column").when(unknown, "unknown").when(F.col("_pos") > F.col("_neg"), "debit_raises_balance").otherwise("debit_lowers_balance")
    r = r.withColumns({"_sign": sign, "sign_convention": convention})
    opening = ~F.col("_total") & is_opening(F.col("_balance"), F.col("date"), F.col("debit"), F.col("credit"), F.col("amount"))
    anchor = F.coalesce(opening | (F.col("_voter") & F.col("_prev").isNull()), F.lit(False))
    upto = Window.partitionBy(doc).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_anchor", anchor).withColumn("_seg", F.sum(F.col("_anchor").cast("int")).over(upto))
    zero = F.lit(0).cast("decimal(28,6)")
    delta = F.when(F.col("_sign") == 1, _delta(1)).when(F.col("_sign") == -1, _delta(-1))
    step = F.when(F.col("_anchor"), F.col("_balance")).when(F.col("_total"), zero).otherwise(F.coalesce(delta, zero))
    along = Window.partitionBy(doc, "_seg").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    r = r.withColumn("_expected", F.sum(step).over(along))
    compared = (F.col("_sign") != 0) & (F.col("_seg") > 0) & ~F.col("_anchor") & F.col("_voter")
    off = compared & (F.abs(F.col("_expected") - F.col("_balance")) > tol)
    cents = lambda c: F.bround(c, 2).cast("decimal(38,2)").cast("string")
    flag = F.when(off, F.concat(F.lit("balance mismatch: expected "), cents(F.col("_expected")), F.lit(", got "), cents(F.col("_balance"))))
    r = r.withColumn("flag", flag).withColumn("balance_checked", F.count(F.when(compared, 1)).over(whole) > 0)
    r = r.withColumn("balance_mismatches", F.when(F.col("balance_checked"), F.count("flag").over(whole)))
    return r.drop("_total", "_voter", "_prev", "_pos", "_neg", "_dc", "_am", "_sign", "_anchor", "_seg", "_expected")


def summarize(audited: DataFrame, doc: str = "doc_id") -> DataFrame:
    """One row a document: rows, rows_with_balance, sign_convention, balance_checked, balance_mismatches, verified, parsed."""
    parsed = sum((F.col(p).isNotNull().cast("int") for p in PARSED), F.lit(0))
    return audited.groupBy(doc).agg(
        F.count("*").alias("rows"),
        F.max("rows_with_balance").alias("rows_with_balance"),
        F.max("sign_convention").alias("sign_convention"),
        F.max("balance_checked").alias("balance_checked"),
        F.max("balance_mismatches").alias("balance_mismatches"),
        F.count(F.when(F.col("_balance").isNotNull() & F.col("flag").isNull(), 1)).alias("verified"),
        F.sum(parsed).cast("long").alias("parsed"),
    )
