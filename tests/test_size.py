"""Work that grows with the input is done once and in the cheap place: plans, and results that the cheap way could miss."""

import io
import random
import zipfile
from decimal import Decimal

from pyspark.sql import functions as F

from tallyweave.functions.money import parse_money
from tallyweave.operators import grid as G
from tallyweave.operators import layout as L
from tallyweave.plans.queries import QUERIES
from tallyweave.sources import office
from tallyweave.sources.office import parse_grids, xlsx_grids
from tallyweave.sources.sinks import _zip, grid_files, ledger_files, text_files, xlsx
from tests.helpers import SF

NS = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_files_are_made_by_partition_and_what_they_share_is_made_once(spark):
    spark.catalog.clearCache()
    plan = _plan(QUERIES["files_by_shape"](spark, SF))
    assert "FlatMapGroupsInPandas" not in plan and plan.count("MapInArrow") == 2
    # the summary, the rows and the pairs are read where they are held, not made anew for each kind of file
    assert "InMemoryRelation" in plan
    spark.catalog.clearCache()


def test_files_of_documents_of_any_length(spark):
    long = [("long", i, [str(i), "x"]) for i in range(25_000)]
    short = [(f"s{d}", i, [f"{d}", f"{i}.50"]) for d in range(300) for i in (2, 0, 1)]
    g = spark.createDataFrame(long + short, "doc_id string, row_no long, cells array<string>").repartition(7)
    got = {(r.doc_id, r.kind): bytes(r.content) for r in grid_files(g).collect()}
    assert len(got) == 602 and got["long", "csv"].decode("utf-8-sig").split() == [f"{i},x" for i in range(25_000)]
    assert all(xlsx_grids(got[f"s{d}", "xlsx"]) == [[[str(d), f"{i}.500000"] for i in range(3)]] for d in range(300))


def test_only_the_files_that_are_asked_for(spark):
    rows = spark.createDataFrame([("d", 1, "2031-01-02", "5.00")], "doc_id string, row_no long, date string, amount string")
    rows = rows.select("*", *(F.lit(None).cast("decimal(28,6)").alias(f"_{c}") for c in ("debit", "credit", "amount", "balance")))
    assert {r.kind for r in ledger_files(rows, ("docx",)).collect()} == {"docx"} and {r.kind for r in ledger_files(rows).collect()} == {"csv", "xlsx", "docx"}
    docs = spark.createDataFrame([("t", "a")], "doc_id string, text string")
    assert {r.kind for r in text_files(docs, ("txt",)).collect()} == {"txt"} and "ArrowEvalPython" not in _plan(text_files(docs, ("txt",)))


def test_an_archive_is_the_one_that_zipfile_writes():
    for parts in ({"a.xml": "<a/>", "b/c.xml": "é", "d.xml": "<d>ö</d>"}, {"a.xml": "<a/>", "b/c.xml": "é", "d.xml": ""}, {"one.xml": "1"}):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for name, text in parts.items():
                z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text)
        assert _zip(parts) == out.getvalue()


def test_cells_that_are_judged_at_once(spark):
    want = {"1,234.50": "1234.50", "-7": "-7", "007": "7", "12\n": "12", "1.234": "1234", "O.OO": "0", "o，oo": "0", "\n O.OO": "0", "１２": "12", "1995-01-02": None, "1-2": None, "sum": None, "": None, "-": None, "1,23.40": None, "9" * 23: None, "9" * 22: "9" * 22, "(4.10)": "-4.10", "$ 4.10": "4.10", "1,234": "1234", "12,34": "12.34"}
    d = spark.createDataFrame([(k,) for k in want], "s string")
    got = {r.s: r.v for r in d.select("s", parse_money(F.col("s")).alias("v")).collect()}
    assert got == {k: None if v is None else Decimal(v) for k, v in want.items()}


def test_a_round_trip_makes_one_kind_of_file_and_meets_each_row_by_document(spark):
    for name in ("docx_roundtrip", "xlsx_roundtrip"):
        plan = _plan(QUERIES[name](spark, SF))
        # one writer and one reader by batches, and no second pass over what was read for the header
        assert plan.count("MapInArrow") == 2 and "FlatMapGroupsInPandas" not in plan and "Join" not in plan


def test_files_are_read_whole_whatever_comes_between(spark, monkeypatch):
    monkeypatch.setattr(office, "_HELD", 100)
    sheet = lambda n: xlsx("S", [[(f"r{i}", None), (f"a & {i}", None)] for i in range(n)], 8, False, set())
    files = [(f"f{i}.xlsx", b"no zip" if i % 7 == 0 else sheet(i)) for i in range(60)]
    got = parse_grids(spark.createDataFrame(files, "path string, content binary").repartition(2)).collect()
    assert {r.doc_id for r in got if r.error} == {f"f{i}.xlsx" for i in range(0, 60, 7)}
    assert sorted((r.doc_id, r.grid_no, r.row_no, *r.cells) for r in got if not r.error) == sorted((f"f{n}.xlsx", 0, i, f"r{i}", f"a & {i}") for n in range(60) if n % 7 for i in range(n))


def test_files_that_differ_in_a_shared_part_are_told_apart():
    def book(style, rid, *cells):
        parts = {"xl/workbook.xml": f'<workbook xmlns="{NS}" xmlns:r="{REL}"><sheets><sheet name="s" sheetId="1" r:id="{rid}"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": f'<r><x Id="{rid}" Target="a.xml"/></r>', "xl/styles.xml": f'<styleSheet xmlns="{NS}"><cellXfs><xf numFmtId="{style}"/></cellXfs></styleSheet>', "xl/a.xml": f'<worksheet xmlns="{NS}"><sheetData><row r="2">{"".join(cells)}</row></sheetData></worksheet>'}
        return _zip(parts)

    for style, want in ((14, "2000-01-01"), (0, "36526"), (14, "2000-01-01")):
        assert xlsx_grids(book(style, f"rId{style}", '<c r="B2" s="0"><v>36526</v></c>', '<c t="b"><v>1</v></c>', '<c r="AA2" t="str"><v>x</v></c>')) == [[[""] * 27, ["", want, "True", *[""] * 23, "x"]]]


def test_the_header_of_each_grid_and_the_last_filled_cell_of_a_name(spark):
    grids = {0: [["note", "Date"], ["Date", "Details", "Memo", "Balance"], ["d1", "a", "", "1"], ["d2", "a", " b\nc ", None]], 3: [["Date", "Amount"]], 5: [[], ["Amount", "x", "Date"], ["7"], None, ["8", "", "d3", "over"]]}
    rows = [("d", g, 10 * i, c) for g, grid in grids.items() for i, c in enumerate(grid)] + [("e", 0, i, ["x", "y"]) for i in range(3)]
    late = [("late", 0, i, ["x"]) for i in range(10)] + [("late", 0, 10, ["Date", "Amount"]), ("late", 0, 11, ["d", "1"])]
    got = G.records_from_grid(spark.createDataFrame(rows + late, "doc_id string, grid_no int, row_no int, cells array<string>")).orderBy("doc_id", "row_no").collect()
    assert [(r.doc_id, r.row_no, r.date, r.description, r.amount, r.balance) for r in got] == [("d", 1, "d1", "a", None, "1"), ("d", 2, "d2", "b c", None, None), ("d", 3, None, None, "7", None), ("d", 4, "d3", None, "8", None)]


def test_white_gaps_need_no_bin_a_row(spark):
    df = QUERIES["prose_white_gaps"](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    # pages are laid out and judged where their document is
    assert "Exchange" not in plan and plan.count("MapInArrow") == 1 and "Join" not in plan


def test_white_gaps_by_the_definition_bin_by_bin(spark, monkeypatch):
    monkeypatch.setattr(G, "_GAPS", 7)
    rng, pages, words, want = random.Random(11), [], [], set()
    for n in range(60):
        width, made = rng.choice([80.0, 120.5, 10.0]), []
        for top in range(rng.randint(1, 9)):
            for _ in range(rng.randint(1, 5)):
                x = rng.choice([rng.uniform(-20, 140), rng.choice([0.0, 40.0, 90.0])])
                made.append((rng.choice(["", "a", "word"]), x, x + rng.choice([0.0, 5.0, 17.5, 30.25]), 20.0 * top, 20.0 * top + 10))
        pages.append((str(n % 3), n, width))
        words += [(str(n % 3), n, i, *w) for i, w in enumerate(made)]
        rows = {}
        for w in made:
            rows.setdefault(w[3], []).append(w)
        cw = sorted((w[2] - w[1]) / max(1, len(w[0])) for w in made)
        inside = lambda a, b, x: max(0, int(a)) <= x <= min(int(width), int(b))
        run = []
        for x in range(int(width) + 2):
            spans = sum(inside(min(w[1] for w in r), max(w[2] for w in r), x) for r in rows.values())
            if x <= width and spans >= 2 and sum(inside(w[1], w[2], x) for w in made) <= 0.25 * spans:
                run.append(x)
            elif run:
                if len(run) >= 3 * cw[len(cw) // 2]:
                    want.add((str(n % 3), n, (run[0] + run[-1] + 1) / 2))
                run = []
    boxes = spark.createDataFrame(words, "doc_id string, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double")
    got = [tuple(r) for r in G.white_gap_separators(L.visual_rows(boxes), spark.createDataFrame(pages, "doc_id string, page_no int, width double")).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20


def test_rows_that_come_in_several_runs(spark):
    # tops that round alike come by their left edge, so that two rows take turns
    boxes = [("d", 0, i, f"w{i}", 10.0 * i, 10.0 * i + 5, top, top + 4) for i, top in enumerate([5.04, 5.0, 5.04, 7.03, 7.049, 7.0, 7.045, 5.02])]
    got = L.visual_rows(spark.createDataFrame(boxes, "doc_id string, page_no int, word_no int, text string, x0 double, x1 double, top double, bottom double")).orderBy("row_no").collect()
    assert [(r.row_no, [w.text for w in r.ws]) for r in got] == [(0, ["w0", "w1", "w2", "w3", "w5", "w7"]), (1, ["w4", "w6"])]


def test_text_of_cells_however_it_is_nested():
    cells = ("<is><t>a</t></is>", "<is><t/></is>", "<is><r><t>b</t></r><r><t> c</t></r></is>", "<is><t>d</t><r><t>e</t></r></is>", "<is/>", "", "<is><r><t>f</t></r></is>")
    sheet = f'<worksheet xmlns="{NS}"><sheetData><row>{"".join(f"<c t=\'inlineStr\'>{c}</c>" for c in cells)}</row></sheetData></worksheet>'
    book = {"xl/workbook.xml": f'<workbook xmlns="{NS}" xmlns:r="{REL}"><sheets><sheet name="s" sheetId="1" r:id="r"/></sheets></workbook>', "xl/_rels/workbook.xml.rels": '<r><x Id="r" Target="a.xml"/></r>', "xl/a.xml": sheet}
    assert xlsx_grids(_zip(book)) == [[["a", "", "b c", "de", "", "", "f"]]]
