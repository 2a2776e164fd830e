"""Ledger rows from positioned words.

Words of a page meet once, by (doc_id, page_no); all later steps of a page keep that partitioning, and the carry
of columns from page to page needs one more exchange of a row a page. Steps that depend on earlier decisions (visual
rows, phrases that run on) are folds over a page's or row's sorted words, in the JVM.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V
from tallyweave.functions.predicates import header_canon

_MONEY = "(" + ", ".join(f"'{c}'" for c in V.MONEY_COLUMNS) + ")"
_TEXTS = "(" + ", ".join(f"'{c}'" for c in V.TEXT_COLUMNS) + ")"
_q = lambda s: "r'" + s.replace("'", "\\'") + "'"
BOUND = "struct<canon:string,lo:double,hi:double,hx0:double>"


def computed(df: DataFrame, **cols: Column) -> DataFrame:
    """``df`` with columns that are computed once: filters above do not repeat their expressions below."""
    return df.select(*(c for c in df.columns if c not in cols), F.inline(F.array(F.struct(*(v.alias(k) for k, v in cols.items())))))


def upper_median(values: str) -> str:
    """SQL for the upper median of an array, without interpolation."""
    return f"get(array_sort({values}), int(size({values}) div 2))"


def char_widths(ws: str) -> str:
    return f"transform({ws}, w -> (w.x1 - w.x0) / greatest(1, length(w.text)))"


def visual_pages(pages: DataFrame) -> DataFrame:
    """``pages`` with ``rows``, an array of rows of words, instead of ``words``, an array of (word_no, text, x0, x1, top, bottom):
    words clustered into rows by their top, each row sorted from left to right.

    Words come by rounded top, then left edge; one joins the first row whose first word's top is within the tolerance.
    In that order only the last two rows can still be within it. Words that follow each other with one top are of one row, and
    are judged once.
    """
    item = "sort_array(transform(words, w -> named_struct('key', CASE WHEN w.top = floor(w.top) THEN w.top ELSE bround(w.top, 1) END, 'x0', w.x0, 'word_no', w.word_no, 'text', w.text, 'x1', w.x1, 'top', w.top, 'bottom', w.bottom)))"
    p = computed(pages, p=F.expr(item)).drop("words")
    # sort_array compares natively, array_sort by an interpreted function
    tol = F.expr("greatest(2D, 0.4D * get(sort_array(transform(p, w -> w.bottom - w.top)), int(size(p) div 2)))")
    starts = F.expr("filter(sequence(0, size(p) - 1), i -> i = 0 OR get(p, i).top <> get(p, i - 1).top)")
    p = computed(p, tol=tol, starts=starts, ws=F.expr("transform(p, (w, i) -> named_struct('x0', w.x0, 'pos', i, 'text', w.text, 'x1', w.x1, 'top', w.top, 'bottom', w.bottom))"))
    fold = """aggregate(transform(starts, i -> get(p, i).top), named_struct('n', 0, 'a', cast(null as double), 'b', cast(null as double), 'rows', cast(array() as array<int>)),
     (s, t) -> CASE WHEN s.a IS NOT NULL AND abs(s.a - t) <= tol THEN named_struct('n', s.n, 'a', s.a, 'b', s.b, 'rows', concat(s.rows, array(s.n - 2)))
      WHEN s.b IS NOT NULL AND abs(s.b - t) <= tol THEN named_struct('n', s.n, 'a', s.a, 'b', s.b, 'rows', concat(s.rows, array(s.n - 1)))
      ELSE named_struct('n', s.n + 1, 'a', s.b, 'b', t, 'rows', concat(s.rows, array(s.n))) END).rows"""
    p = computed(p, at=F.expr(fold))
    # runs of words are rows one by one, unless a row takes several runs
    run = "slice(ws, get(starts, k) + 1, coalesce(get(starts, k + 1), size(ws)) - get(starts, k))"
    each = f"transform(at, (r, k) -> sort_array({run}))"
    some = f"transform(sequence(0, array_max(at)), n -> sort_array(flatten(transform(filter(transform(at, (r, k) -> named_struct('r', r, 'k', k)), z -> z.r = n), z -> {run.replace('k)', 'z.k)').replace('k + 1', 'z.k + 1')}))))"
    return computed(p, rows=F.expr(f"CASE WHEN array_max(at) = size(at) - 1 THEN {each} ELSE {some} END")).drop("p", "tol", "starts", "ws", "at")


def visual_rows(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, ws): words clustered into rows as ``visual_pages`` does, a row each."""
    pages = words.groupBy("doc_id", "page_no").agg(F.collect_list(F.struct("word_no", "text", "x0", "x1", "top", "bottom")).alias("words"))
    return visual_pages(pages).select("doc_id", "page_no", F.posexplode("rows").alias("row_no", "ws"))


def headers(rows: DataFrame) -> DataFrame:
    """(doc_id, page_no, hdr_row, items): the row that names the most columns (a date counts for three), and its columns
    (cx, i, canon, x0, x1) by their centres. A page without two named columns in a row is not there."""
    r = rows.withColumn("cw", F.expr(upper_median(char_widths("ws"))))
    phrases = """aggregate(ws, cast(array() as array<struct<text:string,x0:double,x1:double>>),
     (a, w) -> CASE WHEN size(a) > 0 AND w.x0 - element_at(a, -1).x1 <= 1.5D * cw
      THEN concat(slice(a, 1, size(a) - 1), array(named_struct('text', concat(element_at(a, -1).text, ' ', w.text), 'x0', element_at(a, -1).x0, 'x1', w.x1)))
      ELSE concat(a, array(named_struct('text', w.text, 'x0', w.x0, 'x1', w.x1))) END)"""
    r = computed(r, ph=F.expr(phrases))
    named = F.filter(F.transform("ph", lambda p, i: F.struct(((p["x0"] + p["x1"]) / 2).alias("cx"), i.alias("i"), header_canon(p["text"]).alias("canon"), p["x0"].alias("x0"), p["x1"].alias("x1"))), lambda p: p["canon"].isNotNull())
    r = computed(r, named=named)
    first = F.expr("filter(named, (p, i) -> array_position(transform(named, q -> q.canon), p.canon) = i + 1)")
    r = computed(r, items=F.array_sort(first)).where("size(items) >= 2")
    score = F.size("items") + F.when(F.expr("exists(items, p -> p.canon = 'date')"), 2).otherwise(0)
    best = F.max_by(F.struct("row_no", "items"), F.struct(score, -F.col("row_no")))
    return r.groupBy("doc_id", "page_no").agg(best.alias("h")).select("doc_id", "page_no", F.col("h.row_no").alias("hdr_row"), "h.items")


def column_bounds(rows: DataFrame, heads: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, page_no, hdr_row, width, bounds) of every page: its own columns, or the last ones found on an earlier page.

    Edges are midway between header centres; a text column starts where most of its words do (the smallest such place if
    several tie).
    """
    body = rows.join(heads, ["doc_id", "page_no"], "left")
    # words that vote on where a column starts: after a gap or a date, and no date themselves
    page_cw = rows.groupBy("doc_id", "page_no").agg(F.expr(upper_median("flatten(collect_list(" + char_widths("ws") + "))")).alias("pcw"))
    votes = f"""filter(transform(ws, (w, i) -> CASE WHEN NOT w.text RLIKE {_q(V.DATE_WORD)} AND (i = 0 OR w.x0 - ws[i - 1].x1 > 2 * pcw OR ws[i - 1].text RLIKE {_q(V.DATE_PIECE)}) THEN bround(w.x0, 0) END), x -> x IS NOT NULL)"""
    votes = votes.replace("ws[i - 1]", "get(ws, i - 1)")
    v = body.where("hdr_row IS NOT NULL").join(page_cw, ["doc_id", "page_no"]).withColumn("v", F.when(F.col("row_no") > F.col("hdr_row"), F.expr(votes)))
    v = v.groupBy("doc_id", "page_no").agg(F.flatten(F.collect_list("v")).alias("xs"), F.first("hdr_row").alias("hdr_row"), F.first("items").alias("items"), F.first("pcw").alias("pcw"))
    p = pages.select("doc_id", "page_no", "width").join(v, ["doc_id", "page_no"], "left")
    mid = """transform(items, (t, i) -> named_struct('canon', t.canon, 'x0', t.x0,
      'lo', CASE WHEN i = 0 THEN 0D ELSE (get(items, i - 1).cx + t.cx) / 2 END, 'hi', CASE WHEN i = size(items) - 1 THEN width ELSE (get(items, i + 1).cx + t.cx) / 2 END,
      'votes', CASE WHEN i > 0 AND NOT t.canon IN %s THEN filter(xs, x -> x > get(items, i - 1).cx AND x <= t.x0 + pcw) END))""" % _MONEY
    start = "transform(m, t -> CASE WHEN size(t.votes) > 0 THEN -array_max(transform(array_distinct(t.votes), x -> named_struct('n', size(filter(t.votes, y -> y = x)), 'neg', -x))).neg - pcw / 2 END)"
    p = computed(computed(p, m=F.expr(mid)), st=F.expr(start))
    own = "transform(m, (t, i) -> named_struct('canon', t.canon, 'lo', coalesce(get(st, i), t.lo), 'hi', coalesce(get(st, i + 1), t.hi), 'hx0', t.x0))"
    p = p.withColumn("own", F.expr(own).cast(f"array<{BOUND}>"))
    carry = Window.partitionBy("doc_id").orderBy("page_no").rowsBetween(Window.unboundedPreceding, 0)
    return p.select("doc_id", "page_no", "hdr_row", "width", F.last("own", ignorenulls=True).over(carry).alias("bounds"))


def _assign() -> str:
    """The column of each word of a row: where it stands, and on from the previous word's for a phrase that runs on."""
    mid = "(w.x0 + w.x1) / 2"
    x = f"CASE WHEN {mid} >= money_lo THEN {mid} ELSE w.x0 END"
    at = f"get(filter(bounds, b -> b.lo <= {x} AND {x} < b.hi), 0).canon"
    money = "coalesce(try_element_at(filter(money, b -> b.hx0 <= w.x1), -1), get(money, 0)).canon"
    placed = f"transform(ws, w -> CASE WHEN {at} IN {_MONEY} THEN {money} ELSE {at} END)"
    keep = f"""s.c IS NOT NULL AND z.c IS NOT NULL AND s.c <> z.c AND NOT s.c IN {_MONEY} AND z.w.x0 - s.x1 <= cw
      AND (NOT z.c IN {_MONEY} OR (z.w.text RLIKE {_q(V.WORDY)} AND NOT z.w.text RLIKE {_q(V.MARKER)}))"""
    return f"""aggregate(zip_with(ws, {placed}, (w, c) -> named_struct('w', w, 'c', c)), named_struct('c', cast(null as string), 'x1', cast(null as double), 'out', cast(array() as array<string>)),
      (s, z) -> named_struct('c', CASE WHEN {keep} THEN s.c ELSE z.c END, 'x1', z.w.x1, 'out', concat(s.out, array(CASE WHEN {keep} THEN s.c ELSE z.c END)))).out"""


def _where(canon: str) -> str:
    return f"filter(sequence(0, size(ws) - 1), i -> get(cs, i) = '{canon}')"


def row_cells(rows: DataFrame, bounds: DataFrame) -> DataFrame:
    """(doc_id, page_no, row_no, the ledger columns): the cells of each data row, absent cells null; empty rows are left out."""
    b = bounds.where("bounds IS NOT NULL").withColumn("money", F.expr(f"filter(bounds, b -> b.canon IN {_MONEY})"))
    b = b.withColumn("money_lo", F.expr("coalesce(array_min(transform(money, b -> b.lo)), width)"))
    names = "transform(bounds, b -> b.canon)"
    after = f"get({names}, int(array_position({names}, 'date')))"
    b = b.withColumn("spill_to", F.expr(f"CASE WHEN array_contains({names}, 'date') AND {after} IN {_TEXTS} THEN {after} ELSE 'description' END"))
    r = rows.join(b, ["doc_id", "page_no"]).where("hdr_row IS NULL OR row_no > hdr_row")
    r = computed(computed(r, cw=F.expr(upper_median(char_widths("ws")))), cs=F.expr(_assign()))
    # what follows the pieces of a date in its cell goes on to the next column
    r = computed(r, dp=F.expr(_where("date")))
    cut = f"""array_min(filter(sequence(0, size(dp)), k -> k = size(dp) OR NOT get(ws, get(dp, k)).text RLIKE {_q(V.DATE_PIECE)} OR (k > 0 AND get(ws, get(dp, k - 1)).text RLIKE {_q(V.FULL_DATE)})))"""
    r = computed(r, k=F.expr(f"CASE WHEN size(dp) = 0 THEN 0 ELSE {cut} END"))
    r = computed(r, cs=F.expr("CASE WHEN k > 0 AND k < size(dp) THEN transform(cs, (c, i) -> CASE WHEN array_contains(slice(dp, k + 1, size(dp)), i) THEN spill_to ELSE c END) ELSE cs END"))
    # left of the last wide gap, a money cell's words are description
    for m in V.MONEY_COLUMNS:
        r = computed(r, mp=F.expr(_where(m)))
        gap = "array_max(filter(sequence(1, size(mp) - 1), j -> get(ws, get(mp, j)).x0 - get(ws, get(mp, j - 1)).x1 > 3 * cw))"
        r = computed(r, g=F.expr(f"CASE WHEN size(mp) > 1 THEN {gap} END"))
        r = computed(r, cs=F.expr("CASE WHEN g IS NOT NULL THEN transform(cs, (c, i) -> CASE WHEN array_contains(slice(mp, 1, g), i) THEN 'description' ELSE c END) ELSE cs END"))
    cell = lambda c: F.expr(f"nullif(trim(array_join(transform(filter(zip_with(ws, cs, (w, c) -> named_struct('w', w, 'c', c)), z -> z.c = '{c}'), z -> z.w.text), ' ')), '')")
    out = computed(r.select("doc_id", "page_no", "row_no", "ws", "cs"), **{c: cell(c) for c in V.COLUMNS}).drop("ws", "cs")
    return out.where(F.coalesce(*V.COLUMNS).isNotNull())


def merge_wrapped(cells: DataFrame) -> DataFrame:
    """(doc_id, row_no, columns): a line with a description and neither date nor money goes on the record before it on its page;
    records are numbered through the document."""
    some_money = F.coalesce(*V.MONEY_COLUMNS).isNotNull()
    by_page = Window.partitionBy("doc_id", "page_no").orderBy("row_no")
    wraps = F.col("date").isNull() & ~some_money & F.col("description").isNotNull() & (F.row_number().over(by_page) > 1)
    c = cells.withColumn("new", (~wraps).cast("int")).withColumn("rec", F.sum("new").over(by_page.rowsBetween(Window.unboundedPreceding, 0)))
    others = [c for c in V.COLUMNS if c != "description"]
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row_no", "description"))), lambda x: x["description"]), " ")
    r = c.groupBy("doc_id", "page_no", "rec").agg(F.min_by(F.struct(*others), "row_no").alias("o"), F.nullif(text, F.lit("")).alias("description"))
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "rec"))
    return r.select("doc_id", number.cast("long").alias("row_no"), *(F.col("description") if c == "description" else F.col(f"o.{c}").alias(c) for c in V.COLUMNS))


def shared_rows(words: DataFrame) -> DataFrame:
    """``visual_rows`` that several steps read: the folds run once. They are held in memory as far as it goes, and on disk; a
    lost part is computed anew. ``spark.catalog.clearCache()`` lets them go when results are written."""
    return visual_rows(words).persist(StorageLevel.MEMORY_AND_DISK)


def rows_from_words(words: DataFrame, pages: DataFrame, rows: DataFrame | None = None) -> DataFrame:
    """Raw ledger rows of all documents: ``words(doc_id, page_no, word_no, text, x0, x1, top, bottom)`` and ``pages(doc_id, page_no,
    width)`` to (doc_id, row_no, columns). A page without a header uses the columns of an earlier one; before any
    header there are no rows. ``rows`` are the words' visual rows, if they are there already."""
    rows = shared_rows(words) if rows is None else rows
    return merge_wrapped(row_cells(rows, column_bounds(rows, headers(rows), pages)))


def page_skew(words: DataFrame) -> DataFrame:
    """(doc_id, page_no, angle, height, zoom, reread): by lines of at least three words that run over ten times their height, the median
    slope in degrees (0 with fewer than three such lines), the median word height, and whether a second reading is due."""
    g = words.groupBy("doc_id", "page_no", "line").agg(F.count("*").alias("n"), F.min_by(F.struct("x0", "x1", "top", "bottom"), F.struct("x0", "word_no")).alias("a"), F.max_by(F.struct("x0", "x1", "top", "bottom"), F.struct(F.col("x0"), -F.col("word_no"))).alias("b"))
    run = (F.col("b.x0") + F.col("b.x1") - F.col("a.x0") - F.col("a.x1")) / 2
    slope = F.when((F.col("n") >= 3) & (run > 10 * (F.col("a.bottom") - F.col("a.top"))), (F.col("b.top") + F.col("b.bottom") - F.col("a.top") - F.col("a.bottom")) / 2 / run)
    s = g.select("doc_id", "page_no", slope.alias("s")).groupBy("doc_id", "page_no").agg(F.median("s").alias("m"), F.count("s").alias("n"))
    h = words.groupBy("doc_id", "page_no").agg(F.median(F.col("bottom") - F.col("top")).alias("height"))
    angle = F.when(F.col("n") >= 3, F.degrees(F.atan("m"))).otherwise(F.lit(0.0))
    zoom = F.when(F.col("height") < V.LEAST_HEIGHT, F.least(F.lit(V.MOST_ZOOM), V.TEXT_HEIGHT / F.col("height"))).otherwise(F.lit(1.0))
    return s.join(h, ["doc_id", "page_no"]).select("doc_id", "page_no", angle.alias("angle"), "height", zoom.alias("zoom")).withColumn("reread", (F.abs("angle") > V.SKEW_DEGREES) | (F.col("zoom") > 1))


def accept_reread(first: Column, second: Column) -> Column:
    """Whether a second reading's word count keeps up with the first."""
    return second >= 0.8 * first


def join_touching(words: DataFrame) -> DataFrame:
    """Words that touch the one before (less than 0.1 apart, tops within 1 of the merged word's) become one."""
    w = words.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "text", "x0", "x1", "top", "bottom"))).alias("p"))
    fold = """aggregate(p, cast(array() as array<struct<word_no:int,text:string,x0:double,x1:double,top:double,bottom:double>>),
     (a, w) -> CASE WHEN size(a) > 0 AND abs(element_at(a, -1).top - w.top) < 1 AND abs(w.x0 - element_at(a, -1).x1) < 0.1D
      THEN concat(slice(a, 1, size(a) - 1), array(named_struct('word_no', element_at(a, -1).word_no, 'text', concat(element_at(a, -1).text, w.text), 'x0', element_at(a, -1).x0, 'x1', w.x1, 'top', element_at(a, -1).top, 'bottom', greatest(element_at(a, -1).bottom, w.bottom))))
      ELSE concat(a, array(named_struct('word_no', int(w.word_no), 'text', w.text, 'x0', w.x0, 'x1', w.x1, 'top', w.top, 'bottom', w.bottom))) END)"""
    return w.select("doc_id", "page_no", F.inline(F.expr(fold)))


def visible_glyphs(glyphs: DataFrame) -> DataFrame:
    """Glyphs without those that stand where a fully transparent one does (same character, rounded place)."""
    at = lambda c: F.bround(c, 0)
    hidden = glyphs.where("alpha = 0").select("doc_id", "page_no", F.col("char").alias("h"), at("x").alias("hx"), at("y").alias("hy")).distinct()
    g = glyphs.withColumns({"hx": at("x"), "hy": at("y"), "h": F.col("char")})
    return g.join(hidden, ["doc_id", "page_no", "h", "hx", "hy"], "left_anti").drop("h", "hx", "hy")


def vertical_rulings(segments: DataFrame) -> DataFrame:
    """(doc_id, page_no, vlines): segments within 1 of a ruling's first x are one; rulings of at least three segments count."""
    s = segments.groupBy("doc_id", "page_no").agg(F.array_sort(F.collect_list(F.struct("x", "top", "bottom"))).alias("p"))
    fold = """aggregate(p, cast(array() as array<struct<x:double,spans:array<struct<top:double,bottom:double>>>>),
     (a, s) -> CASE WHEN size(a) > 0 AND s.x - element_at(a, -1).x <= 1
      THEN concat(slice(a, 1, size(a) - 1), array(named_struct('x', element_at(a, -1).x, 'spans', concat(element_at(a, -1).spans, array(named_struct('top', s.top, 'bottom', s.bottom))))))
      ELSE concat(a, array(named_struct('x', s.x, 'spans', array(named_struct('top', s.top, 'bottom', s.bottom))))) END)"""
    return s.select("doc_id", "page_no", F.filter(F.expr(fold), lambda v: F.size(v["spans"]) >= 3).alias("vlines"))
