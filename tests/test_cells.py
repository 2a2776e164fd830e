from decimal import Decimal

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyweave.functions.money import fix_ocr_digits, parse_money
from tallyweave.functions.predicates import date_like, header_canon, version_parts

MONEY = [
    # separators, signs and marks of a debit
    ("7,041.38", "7041.38"), ("£ 310.05", "310.05"), ("(6.70)", "-6.7"), ("-903.11", "-903.11"), ("58.02 DR", "-58.02"), ("9,310.40 CR", "9310.4"), ("77.19-", "-77.19"), ("–4,400.10", "-4400.1"), ("631DB", "-631"), ("(-8)", "-8"),
    # thousands or decimals
    ("8,300", "8300"), ("47,119", "47119"), ("6,002,915", "6002915"), ("3.870", "3870"), ("9.004.112", "9004112"), ("2.718,28", "2718.28"), ("4 669,20", "4669.2"), ("3 141 592", "3141592"), ("9021,7", "9021.7"), ("0.375", "375"),
    # letters read for digits, codes, wide digits
    ("730.oO", "730"), ("O.oo", "0"), ("4l.8", "41.8"), ("EUR62", "62"), ("４０７．２０", "407.2"), ("03/17/2031", "3172031"),
    # nothing, words, several numbers, broken groups
    ("", None), (None, None), ("n/a", None), ("-", None), ("see note overleaf", None), ("Sheet 4", None), ("881 20.00", None), ("61.30 (b) 2", None), ("9.x4", None), ("B7.20", None), ("--9", None), ("8,12,907.5", None), ("31.08.19", None),
]


def test_money_cells(spark):
    df = spark.createDataFrame(MONEY, "s string, e string")
    for r in df.select("s", F.col("e").cast("decimal(28,6)").alias("e"), parse_money(F.col("s")).alias("g")).collect():
        assert r.e == r.g, r


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(0, 10**11), min_size=1, max_size=40))
def test_money_comes_back_from_any_format(spark, cents):
    forms = []
    for c in cents:
        v = Decimal(c) / 100
        us = f"{v:,.2f}"
        eu = us.translate(str.maketrans(",.", ".,"))
        forms += [(us, v), (eu, v), (us.replace(",", " "), v), (f"({us})", -v), (f"{us}-", -v), (f"{us} DR", -v), (f"€ {eu}", v)]
    df = spark.createDataFrame([(a, b) for a, b in forms], "s string, v decimal(28,6)")
    assert df.where(~parse_money(F.col("s")).eqNullSafe(F.col("v"))).count() == 0


@pytest.mark.parametrize("label,canon", [("PARTICULARS of entry", "description"), ("Funds in (EUR)", "credit"), ("out money", "debit"), ("Remarks", None), ("DR amount", "debit"), ("value date", "date"), ("Payee / account", "description"), ("Closing balance", "balance"), ("", None)])
def test_header_labels(spark, label, canon):
    assert spark.range(1).select(header_canon(F.lit(label)).alias("c")).first().c == canon


def test_small_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("c")).first().c
    assert one(fix_ocr_digits(F.lit("Rest  3O.lO paid"))) == "Rest 30.10 paid"
    assert one(date_like(F.lit("Ledger 7 of nine"))) is True
    assert one(date_like(F.lit(None).cast("string"))) is False
    assert one(version_parts(F.lit("r1.12")) > version_parts(F.lit("1.9.4 beta"))) is True
