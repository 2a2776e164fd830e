from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.operators.pipeline import arbitrate
from tallyweave.operators.reconcile import complete, normalize_rows, reconcile, summarize
from tallyweave.operators.score import score
from tallyweave.sources.office import parse_grids
from tallyweave.sources.sinks import grid_files, ledger_files, save, text_files


def ledger(spark, rows):
    schema = "doc_id string, row_no long, " + ", ".join(f"{c} string" for c in V.COLUMNS)
    return spark.createDataFrame([("d", i, *(r.get(c) for c in V.COLUMNS)) for i, r in enumerate(rows)], schema)


def audit(spark, rows):
    a = reconcile(normalize_rows(ledger(spark, rows)))
    return a, summarize(a).first()


def test_accounts_start_over_and_totals_are_skipped(spark):
    _, s = audit(spark, [
        {"type": "Till north", "balance": "310.00"}, {"date": "2031-05-02", "debit": "42.50", "balance": "352.50"}, {"date": "2031-05-09", "debit": "7.50", "balance": "360.00"}, {"date": "2031-05-11", "credit": "60.00", "balance": "300.00"},
        {"type": "Total till north", "debit": "50.00", "credit": "60.00", "balance": "999.00"}, {"description": "Till south", "balance": "88.00"}, {"date": "2031-05-12", "credit": "8.00", "balance": "80.00"}, {"date": "2031-05-13", "debit": "1.25", "balance": "81.25"},
        {"description": "total of both", "debit": "51.25", "credit": "68.00", "balance": "-1.00"},
    ])
    assert (s.sign_convention, s.balance_mismatches, s.rows) == ("debit_raises_balance", 0, 9)


def test_single_amount_column(spark):
    moves = [("2031-06-01", "75.20", "75.20"), ("2031-06-03", "-15.20", "60.00"), ("2031-06-04", "12.00", "27.00"), ("2031-06-08", "-2.00", "70.00"), ("2031-06-09", "30.00", "100.00")]
    a, s = audit(spark, [{"date": d, "amount": m, "balance": b} for d, m, b in moves])
    assert (s.sign_convention, s.balance_checked, s.balance_mismatches) == ("single_amount_column", True, 1)
    assert [(r.date, r.flag) for r in a.where("flag is not null").collect()] == [("2031-06-04", "balance mismatch: expected 72.00, got 27.00")]


def test_without_balances_nothing_is_checked(spark):
    _, s = audit(spark, [{"date": "2031-07-01", "amount": "4.40"}, {"description": "carried to next sheet"}, {"date": "2031-07-05", "amount": "-9.90"}, {"description": "signed twice"}])
    assert (s.rows, s.balance_checked, s.balance_mismatches) == (2, False, None)


def test_arbitration_stops_early_and_keeps_the_first_of_equals(spark):
    c = [("a", "x", 1, 3, 3, 9, False), ("a", "y", 2, 9, 9, 99, False), ("b", "x", 1, 3, 2, 9, False), ("b", "y", 2, 4, 2, 9, False), ("b", "z", 3, 4, 3, 1, False), ("c", "x", 1, 0, 0, 0, True), ("c", "y", 2, 5, 5, 5, False)]
    df = spark.createDataFrame(c, "doc_id string, source string, priority int, rows long, verified long, parsed long, all_text_layer boolean")
    assert {r.doc_id: r.source for r in arbitrate(df).collect()} == {"a": "x", "b": "z", "c": "x"}


def test_score_counts_fields_and_caught_balances(spark):
    t = ledger(spark, [{"date": "1/1/20", "debit": "5.00", "balance": "10.00"}, {"date": "1/2/20", "credit": "5.00", "balance": "15.00"}, {"date": "1/3/20", "amount": "7.00"}]).withColumn("flag", F.when(F.col("row_no") == 1, "balance mismatch"))
    p = ledger(spark, [{"date": "1/1/20", "debit": "5.00", "balance": "10"}, {"date": "1/2/20", "credit": "5.00", "balance": "15.00"}, {"date": "9/9/20", "debit": "1.00"}]).withColumn("flag", F.when(F.col("row_no") == 1, "x"))
    s = score(t, p).first()
    assert (s.tp, s.fp, s.fn, s.matched, s.bad_balances, s.bad_caught, s.f1) == (5, 3, 2, 2, 1, 1, "0.667")


def test_files_come_back(spark, tmp_path):
    a, _ = audit(spark, [{"date": "2026-01-02", "description": "Fee & <b>", "debit": "5.00", "balance": "95.00"}, {"date": "2026-01-03", "description": "Pay", "credit": "1,000.50", "balance": "1,095.50"}])
    f = {r.kind: bytes(r.content) for r in ledger_files(a).collect()}
    assert f["csv"].startswith(b"\xef\xbb\xbfdate,description,debit") and f["csv"].count(b"\r\n") == 3
    files = spark.createDataFrame([("a/x.xlsx", f["xlsx"]), ("a/y.DOCX", f["docx"]), ("bad.xlsx", b"no zip"), ("z.pdf", b"")], "path string, content binary")
    got = parse_grids(files).collect()
    grid = lambda p: [r.cells for r in sorted((r for r in got if r.doc_id == p and r.grid_no == 0), key=lambda r: r.row_no)]
    assert grid("a/x.xlsx")[1][:4] == ["2026-01-02", "Fee & <b>", "5.000000", ""] or grid("a/x.xlsx")[1][:4] == ["2026-01-02", "Fee & <b>", "5", ""]
    assert grid("a/y.DOCX")[2][:4] == ["2026-01-03", "Pay", "", "1,000.50"]
    assert [r.error is not None for r in got if r.doc_id == "bad.xlsx"] == [True]
    g = spark.createDataFrame([("g", 1, ["Box", "1,5"]), ("g", 2, ["x", "y"])], "doc_id string, row_no long, cells array<string>")
    save(grid_files(g).unionByName(text_files(spark.createDataFrame([("t", "one\n\ntwo")], "doc_id string, text string"))), str(tmp_path))
    assert sorted(x.name for x in tmp_path.iterdir()) == ["g.csv", "g.xlsx", "t.docx", "t.txt"]
    assert (tmp_path / "t.txt").read_text() == "one\n\ntwo"


def test_stream_equals_batch(spark, tmp_path):
    from tallyweave.streaming.audit import audit_stream

    rows = complete(ledger(spark, [{"date": f"2026-01-0{i}", "debit": "1.00", "balance": f"{100 - i}.00"} for i in range(1, 7)]))
    for n, part in enumerate(("row_no < 3", "row_no >= 3")):
        rows.where(part).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        audit_stream(spark, str(tmp_path / "in"), rows.schema, str(tmp_path / "store"), str(tmp_path / "ck")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "store/summaries/batch=1")).first()
    assert last.asDict() == summarize(reconcile(normalize_rows(rows))).first().asDict()
