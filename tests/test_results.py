import json
import random
import struct

from pyspark.sql import functions as F

from tallyweave.__main__ import health, main
from tallyweave.functions import vocabulary as V
from tallyweave.operators.readings import reread, resolve_engine, second_chance, text_layer
from tallyweave.operators.score import match_rows
from tallyweave.sources.images import image_frames
from tallyweave.sources.results import process, result_files, results
from tallyweave.sources.sinks import grid_files, text_files, xlsx


def greedy(truth, predicted):
    """By the definition: truth rows in order, each takes the first row left with its date and its kind of key."""
    left, out = list(range(len(predicted))), {}
    for i, t in enumerate(truth):
        kind = ["balance"] if t["balance"] else ["amount"] if t["amount"] else ["debit", "credit"]
        for j in left:
            if predicted[j]["date"] == t["date"] and all(predicted[j][c] == t[c] for c in kind):
                out[i] = j
                left.remove(j)
                break
    return out


def test_rows_with_mixed_keys_compete_in_order(spark):
    rng, cols = random.Random(5), ("date", "debit", "credit", "amount", "balance")
    made, want = {"t": [], "p": []}, {}
    for doc in range(40):
        row = lambda: {"date": rng.choice(["d1", "d2", None]) or "", **{c: rng.choice([None, "1.00", "2.00"]) for c in cols[1:]}}
        t, p = [row() for _ in range(rng.randint(0, 7))], [row() for _ in range(rng.randint(0, 7))]
        for k, rows in (("t", t), ("p", p)):
            made[k] += [(str(doc), i, *(r[c] for c in cols)) for i, r in enumerate(rows)]
        want |= {(str(doc), i): j for i, j in greedy(t, p).items()}
    schema = "doc_id string, row_no long, " + ", ".join(f"{c} string" for c in cols)
    got = match_rows(spark.createDataFrame(made["t"], schema), spark.createDataFrame(made["p"], schema)).collect()
    assert {(r.doc_id, r.t): r.p for r in got if r.t is not None and r.p is not None} == want
    assert len(got) == len(made["t"]) + len(made["p"]) - len(want)


def test_pages_and_engines(spark):
    d = spark.createDataFrame([("x" * 39,), ("é" * 40,), (None,), ("",)], "t string")
    assert [r[0] for r in d.select(text_layer(F.col("t"))).collect()] == [False, True, False, False]
    e = spark.createDataFrame([("auto", True), ("tesseract", True), ("paper", True), ("paper", False)], "e string, n boolean")
    got = lambda have: [tuple(r.x) for r in e.select(resolve_engine(F.col("e"), have, F.col("n")).alias("x")).collect()]
    unknown = "unknown engine 'paper' (expected auto, winocr, tesseract)"
    assert got(["tesseract"]) == [("tesseract", None), ("tesseract", None), (None, unknown), (None, None)]
    assert got([])[0] == (None, V.NO_ENGINE)


def _page(doc, n, height):
    return [(doc, 0, i // 5, i, f"w{i}", 10.0 * (i % 5), 10.0 * (i % 5) + 8, 40.0 * (i // 5), 40.0 * (i // 5) + height) for i in range(n)]


def test_a_second_reading_must_keep_most_words(spark):
    schema = "doc_id string, page_no int, line int, word_no int, text string, x0 double, x1 double, top double, bottom double"
    first = spark.createDataFrame(_page("small", 10, 14.0) + _page("lossy", 10, 14.0) + _page("tall", 10, 30.0), schema)
    second = spark.createDataFrame(_page("small", 8, 28.0) + _page("lossy", 7, 28.0) + _page("tall", 10, 28.0), schema)
    got = reread(first, second, 2.0).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.col("bottom") - F.col("top")).alias("h")).collect()
    assert {r.doc_id: (r.n, r.h) for r in got} == {"small": (8, 7.0), "lossy": (10, 7.0), "tall": (10, 15.0)}


def test_pictures_take_over_where_the_text_layer_has_no_rows(spark):
    def out(rows):
        return {"summary": spark.createDataFrame(rows, "doc_id string, rows long, sources array<string>"), "texts": spark.createDataFrame([(r[0], r[2][0]) for r in rows], "doc_id string, text string")}

    both = second_chance(out([("a", 0, ["pdf-text"]), ("b", 3, ["pdf-text"]), ("c", 0, ["o"]), ("d", 0, ["pdf-text"])]), out([("a", 2, ["o"]), ("b", 9, ["o"]), ("c", 9, ["p"]), ("d", 0, ["o"])]))
    assert {r.doc_id: (r.rows, r.sources[0]) for r in both["summary"].collect()} == {"a": (2, "o"), "b": (3, "pdf-text"), "c": (0, "o"), "d": (0, "pdf-text")}
    assert {r.doc_id: r.text for r in both["texts"].collect()} == {"a": "o", "b": "pdf-text", "c": "o", "d": "pdf-text"}


def _tiff(*sizes, order="<"):
    b = (b"II*\0" if order == "<" else b"MM\0*") + struct.pack(order + "I", 8)
    for n, (w, h, turn) in enumerate(sizes):
        b += struct.pack(order + "H", 3)
        for tag, v in ((256, w), (257, h), (274, turn)):
            b += struct.pack(order + "HHIHH", tag, 3, 1, v, 0)
        b += struct.pack(order + "I", len(b) + 4 if n + 1 < len(sizes) else 0)
    return b


def test_every_frame_is_an_upright_page(spark):
    gif = b"GIF89a" + struct.pack("<HHBBB", 7, 5, 0, 0, 0) + (b"," + bytes(8) + b"\0\2\1x\0") * 2 + b"!\xfe\1c\0;"
    exif = b"Exif\0\0" + _tiff((1, 1, 6))
    jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(exif) + 2) + exif + b"\xff\xc0" + struct.pack(">HBHH", 9, 8, 30, 40) + b"\0\0"
    png = b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + struct.pack(">II", 3, 4)
    loop = _tiff((9, 8, 1))[:-4] + struct.pack("<I", 8)
    files = [("a.tif", _tiff((100, 50, 1), (60, 80, 8))), ("m.TIFF", _tiff((5, 6, 1), order=">")), ("b.gif", gif), ("c.jpg", jpeg), ("d.png", png), ("e.heic", b""), ("f.png", b""), ("g.pdf", b""), ("h.tif", loop)]
    got = image_frames(spark.createDataFrame(files, "path string, content binary")).collect()
    assert {(r.doc_id, r.page_no, r.width, r.height) for r in got if r.error is None} == {("a.tif", 0, 100, 50), ("a.tif", 1, 80, 60), ("m.TIFF", 0, 5, 6), ("b.gif", 0, 7, 5), ("b.gif", 1, 7, 5), ("c.jpg", 0, 30, 40), ("d.png", 0, 3, 4), ("h.tif", 0, 9, 8)}
    assert {r.doc_id: r.error for r in got if r.error} == {"e.heic": V.NO_HEIC, "f.png": "cannot identify image file"}


def test_an_optional_file_that_fails_leaves_the_others(spark):
    g = spark.createDataFrame([("g", 1, ["a\x01b", "2"])], "doc_id string, row_no long, cells array<string>")
    t = spark.createDataFrame([("t", "bell \x07"), ("n", None)], "doc_id string, text string")
    got = {(r.doc_id, r.kind): bytes(r.content) for r in grid_files(g).unionByName(text_files(t)).collect()}
    assert set(got) == {("g", "csv"), ("g", "xlsx_error"), ("t", "txt"), ("t", "docx_error"), ("n", "txt"), ("n", "docx")}
    assert b"control characters" in got["g", "xlsx_error"] and got["n", "txt"] == b""


def _sheet(path, *rows):
    path.write_bytes(xlsx("S", [[(c, None) for c in r] for r in rows], 8, False, set()))
    return str(path)


def _made(tmp_path):
    ledger = _sheet(tmp_path / "till book.xlsx", ["Date", "Details", "Debit", "Credit", "Balance"], ["2032-02-01", "Opening", "", "", "50.00"], ["2032-02-03", "Wool", "20.00", "", "30.00"], ["2032-02-04", "Sale", "", "5.50", "35.50"], ["2032-02-05", "Sale", "", "1.00", "99.00"])
    form = _sheet(tmp_path / "form.xlsx", ["Shop: Corner"], ["Clerk: Ada"], ["Till: seven"], ["Sum: 12"])
    note = _sheet(tmp_path / "note.xlsx", ["Nothing to count here"])
    (tmp_path / "broken.docx").write_bytes(b"no zip")
    (tmp_path / "scan.png").write_bytes(b"")
    return [ledger, form, note, str(tmp_path / "broken.docx"), str(tmp_path / "scan.png"), str(tmp_path / "away.xlsx")]


def test_files_in_result_files_out(spark, tmp_path):
    paths = _made(tmp_path)
    out = process(spark, paths)
    files = result_files(out, "result")
    kinds = {}
    for r in files.collect():
        kinds.setdefault(r.doc_id, set()).add((r.kind, r.name))
    assert kinds == {
        paths[0]: {("csv", "result.csv"), ("xlsx", "result.xlsx"), ("docx", "result.docx")},
        paths[1]: {("csv", "result.csv"), ("xlsx", "result.xlsx"), ("text", "result.txt")},
        paths[2]: {("text", "result.txt"), ("docx", "result.docx")},
    }
    got = {r.doc_id: json.loads(r.json) for r in results(out, files, content=True).collect()}
    one, two, three = (got[p] for p in paths[:3])
    assert (one["document_shape"], len(one["rows"]), one["summary"]["balance_mismatches"], one["outputs"]["csv"]) == ("ledger", 4, 1, "result.csv")
    assert {"csv_b64", "xlsx_b64", "docx_b64"} <= set(one) and "message" not in one and not any(k[0] == "_" for r in one["rows"] for k in r)
    assert two["grid"] == [["field", "value"], ["Shop", "Corner"], ["Clerk", "Ada"], ["Till", "seven"], ["Sum", "12"]] and two["message"] == V.SAID_TABLE
    assert (three["message"], three["text_preview"]) == (V.SAID_NOTHING, "Nothing to count here")
    assert [got[p]["ok"] for p in paths] == [True] * 3 + [False] * 3
    assert got[paths[4]] == {"ok": False, "error": V.NO_ENGINE} and got[paths[5]]["error"] == f"file not found: {paths[5]}"
    plain = {r.doc_id: r for r in process(spark, paths[:2], "text")["summary"].collect()}
    assert {r.document_shape for r in plain.values()} == {"text"} and plain[paths[0]].message == V.SAID_TEXT
    assert [r.error for r in process(spark, paths[:1], "odd")["summary"].collect()] == ["unknown mode 'odd' (expected auto, table, text)"]


def test_command_line(spark, tmp_path, capsys):
    paths = _made(tmp_path)
    assert main([paths[0], paths[1], "--out", str(tmp_path / "o")], spark) == 0
    said = capsys.readouterr().out.splitlines()
    assert said[0] == f"{paths[0]}: 4 rows, 1 flagged [grid] -> till book.csv, till book.docx, till book.xlsx" and said[1].startswith(f"{paths[1]}: table, 5 rows [grid] -> ")
    assert sorted(p.name for p in (tmp_path / "o").iterdir()) == ["form.csv", "form.txt", "form.xlsx", "till book.csv", "till book.docx", "till book.xlsx"]
    assert main([paths[5], paths[2], "--json", "--out", str(tmp_path / "o")], spark) == 1
    found = [json.loads(x) for x in capsys.readouterr().out.splitlines()]
    assert [x["ok"] for x in found] == [False, True] and found[0]["error"].startswith("file not found")
    assert main(["--health"]) == 0 and set(json.loads(capsys.readouterr().out)) == set(health())


def test_a_reader_gives_words_of_other_files(spark, tmp_path):
    (tmp_path / "slip.pdf").write_bytes(b"x")
    paths = [str(tmp_path / "slip.pdf"), _sheet(tmp_path / "note.xlsx", ["Nothing to count here"])]

    def reader(files):
        said = F.split(F.lit("Plain words alone"), " ")
        w = files.select(F.col("path").alias("doc_id"), F.lit(0).alias("page_no"), F.posexplode(said).alias("word_no", "text"))
        w = w.select("*", (F.col("word_no") * 50.0).alias("x0"), (F.col("word_no") * 50.0 + 40).alias("x1"), F.lit(10.0).alias("top"), F.lit(20.0).alias("bottom"))
        none = F.lit(None).cast("array<struct<x:double,spans:array<struct<top:double,bottom:double>>>>")
        return w, files.select(F.col("path").alias("doc_id"), F.lit(0).alias("page_no"), F.lit(600.0).alias("width"), F.lit("tesseract").alias("source"), none.alias("vlines"))

    out = process(spark, paths, available=["tesseract"], reader=reader)
    got = {r.doc_id: (r.document_shape, list(r.sources), r.text_preview) for r in out["summary"].collect()}
    assert got == {paths[0]: ("text", ["tesseract"], "Plain words alone"), paths[1]: ("text", ["grid"], "Nothing to count here")}
    assert {(r.doc_id, r.name) for r in result_files(out).collect()} == {(paths[0], "slip.txt"), (paths[0], "slip.docx"), (paths[1], "note.txt"), (paths[1], "note.docx")}
