"""Inputs of the queries, made from the relational tables by deterministic SQL: the same statements run in both engines
where an oracle needs them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ledgers of customers: a debit for finished orders, else a credit; printed balances run, some with 100 too much.
LEDGER = """SELECT CAST(o_custkey AS VARCHAR(20)) AS doc_id, n AS row_no, o_orderkey AS k, o_orderdate AS dt, d, c,
 CAST(run + CASE WHEN o_orderkey % 97 = 0 THEN 100 ELSE 0 END AS DECIMAL(18,2)) AS b FROM (
 SELECT *, CAST(sum(coalesce(c, 0) - coalesce(d, 0)) OVER (PARTITION BY o_custkey ORDER BY n) AS DECIMAL(18,2)) AS run FROM (
  SELECT o_custkey, o_orderkey, o_orderdate, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS n,
   CASE WHEN o_orderstatus = 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS d, CASE WHEN o_orderstatus <> 'F' THEN CAST(o_totalprice AS DECIMAL(18,2)) END AS c FROM orders) x) y"""

#: General ledgers of orders: an opening line, a movement a line item, a total line, and a new account from line 3 on.
GENERAL = """SELECT CAST(l_orderkey AS VARCHAR(20)) AS doc_id, CAST(p AS BIGINT) AS row_no, l_orderkey AS k, kind, v, CAST(CASE WHEN kind = 'move' AND l_orderkey % 53 = 0 AND ln = 2 THEN b + 5 ELSE b END AS DECIMAL(18,2)) AS b FROM (
 SELECT l_orderkey, ln * 10 AS p, ln, 'move' AS kind, v, CAST(CASE WHEN ln >= 3 THEN 5000 ELSE 1000 END + sum(v) OVER (PARTITION BY l_orderkey, ln >= 3 ORDER BY ln) AS DECIMAL(18,2)) AS b FROM (
  SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ln, CAST(l_extendedprice AS DECIMAL(18,2)) AS v FROM lineitem) a
 UNION ALL SELECT DISTINCT l_orderkey, 1, 0, 'open', CAST(NULL AS DECIMAL(18,2)), CAST(1000 AS DECIMAL(18,2)) FROM lineitem
 UNION ALL SELECT l_orderkey, 25, 0, 'total', CAST(NULL AS DECIMAL(18,2)), CAST(7 AS DECIMAL(18,2)) FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3
 UNION ALL SELECT l_orderkey, 26, 0, 'open', CAST(NULL AS DECIMAL(18,2)), CAST(5000 AS DECIMAL(18,2)) FROM lineitem GROUP BY l_orderkey HAVING count(*) >= 3) z"""


def views(spark: SparkSession, sf_dir: str, *names: str) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names}


def over(spark: SparkSession, sf_dir: str, sql: str, *names: str) -> DataFrame:
    """``sql`` over tables that it names."""
    for n in names:
        sql = sql.replace(f"FROM {n}", f"FROM {{{n}}}")
    return spark.sql(sql, **views(spark, sf_dir, *names))


def us(c: Column) -> Column:
    return F.format_number(c, 2)


def eu(c: Column) -> Column:
    return F.translate(us(c), ",.", ".,")


def ledger_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The customers' ledgers as printed."""
    r = over(spark, sf_dir, LEDGER, "orders")
    return r.select("doc_id", "row_no", "k", F.date_format("dt", "yyyy-MM-dd").alias("date"), F.concat(F.lit("Order "), F.col("k").cast("string")).alias("description"), us(F.col("d")).alias("debit"), us(F.col("c")).alias("credit"), us(F.col("b")).alias("balance"))


def boxes(cells: DataFrame) -> DataFrame:
    """Word boxes of ``cells(doc_id, page_no, line, text, x)``: six points a character, ten high, twenty from line to line."""
    w = cells.where("text IS NOT NULL").select("doc_id", "page_no", "line", "x", F.posexplode(F.split("text", " ")).alias("i", "word"), F.split("text", " ").alias("ws"))
    ahead = F.expr("aggregate(slice(ws, 1, i), 0, (a, s) -> a + length(s) + 1)")
    w = w.withColumn("x0", F.col("x") + 6.0 * ahead).withColumn("top", F.col("line") * 20.0)
    return w.select("doc_id", "page_no", (F.col("line") * 10000 + F.col("x0")).cast("int").alias("word_no"), F.col("word").alias("text"), "x0", (F.col("x0") + 6.0 * F.length("word")).alias("x1"), "top", (F.col("top") + 10.0).alias("bottom"))


def cells_of(df: DataFrame, **at: float) -> DataFrame:
    """(doc_id, page_no, line, text, x) of the named columns, each at its place."""
    return df.select("doc_id", "page_no", "line", F.inline(F.array(*(F.struct(F.col(c).cast("string").alias("text"), F.lit(float(x)).alias("x")) for c, x in at.items()))))


PLACES = {"date": 10, "description": 100, "debit": 300, "credit": 400, "balance": 500}


def ledger_words(spark: SparkSession, sf_dir: str, per_page: int = 40) -> tuple[DataFrame, DataFrame]:
    """The customers' ledgers as word boxes: forty rows a page, a header on the first page only."""
    r = ledger_rows(spark, sf_dir).withColumn("page_no", F.floor((F.col("row_no") - 1) / per_page).cast("int")).withColumn("line", ((F.col("row_no") - 1) % per_page + 1).cast("int"))
    head = r.where("row_no = 1").select("doc_id", "page_no", F.lit(0).alias("line"), *(F.lit(c.capitalize()).alias(c) for c in PLACES))
    words = boxes(cells_of(r, **PLACES).unionByName(cells_of(head, **PLACES)))
    pages = r.select("doc_id", "page_no").distinct().withColumn("width", F.lit(600.0))
    return words, pages


def audit_sql(base: str) -> str:
    """The audit in SQL, from numbers: ``base`` gives doc_id, row_no, total, opening, d, c, a, b."""
    return f"""
WITH base AS ({base}),
p AS (SELECT *, b IS NOT NULL AND NOT total AS voter, CASE WHEN d IS NULL AND c IS NULL THEN a ELSE coalesce(d, 0) - coalesce(c, 0) END AS delta,
 last_value(CASE WHEN b IS NOT NULL AND NOT total THEN b END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM base),
v AS (SELECT *, count(*) FILTER (WHERE voter AND abs(prev + delta - b) <= 0.02) OVER w AS pos, count(*) FILTER (WHERE voter AND abs(prev - delta - b) <= 0.02) OVER w AS neg,
 bool_or(d IS NOT NULL OR c IS NOT NULL) OVER w AS dc, bool_or(voter AND a IS NOT NULL) OVER w AS am, count(*) FILTER (WHERE voter) OVER w AS with_balance FROM p WINDOW w AS (PARTITION BY doc_id)),
s AS (SELECT *, CASE WHEN NOT dc AND am THEN 'single_amount_column' WHEN greatest(pos, neg) < 2 OR pos = neg THEN 'unknown' WHEN pos > neg THEN 'debit_raises_balance' ELSE 'debit_lowers_balance' END AS convention,
 CASE WHEN NOT dc AND am THEN CASE WHEN pos >= neg THEN 1 ELSE -1 END WHEN greatest(pos, neg) < 2 OR pos = neg THEN 0 WHEN pos > neg THEN 1 ELSE -1 END AS sign,
 NOT total AND coalesce(opening, false) OR (voter AND prev IS NULL) AS anchor FROM v),
g AS (SELECT *, sum(anchor::INT) OVER (PARTITION BY doc_id ORDER BY row_no) AS seg FROM s),
e AS (SELECT *, sum(CASE WHEN anchor THEN b WHEN total THEN 0 ELSE coalesce(sign * delta, 0) END) OVER (PARTITION BY doc_id, seg ORDER BY row_no) AS expected,
 sign <> 0 AND seg > 0 AND NOT anchor AND voter AS compared FROM g),
f AS (SELECT *, CASE WHEN compared AND abs(expected - b) > 0.02 THEN 'balance mismatch: expected ' || CAST(CAST(expected AS DECIMAL(38,2)) AS VARCHAR) || ', got ' || CAST(CAST(b AS DECIMAL(38,2)) AS VARCHAR) END AS flag FROM e),
sums AS (SELECT doc_id, count(*) AS "rows", max(with_balance) AS rows_with_balance, max(convention) AS sign_convention, bool_or(compared) AS balance_checked,
 CASE WHEN bool_or(compared) THEN count(flag) END AS balance_mismatches, count(*) FILTER (WHERE b IS NOT NULL AND flag IS NULL) AS verified,
 CAST(sum((d IS NOT NULL)::INT + (c IS NOT NULL)::INT + (a IS NOT NULL)::INT + (b IS NOT NULL)::INT) AS BIGINT) AS parsed FROM f GROUP BY doc_id)
"""
