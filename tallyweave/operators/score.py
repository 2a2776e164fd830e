"""Scoring predicted rows against the truth."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyweave.functions.money import parse_money

FIELDS = ("date", "debit", "credit", "balance")


#: What a truth row is looked for by, beside its date: its balance, else its amount, else its debit and credit.
KEYS = (("m_balance",), ("m_amount",), ("m_debit", "m_credit"))

#: Truth rows in order, each with the first predicted row that is left and fits its kind of key.
_FOLD = """aggregate(ts, named_struct('used', cast(array() as array<bigint>), 'm', cast(array() as array<struct<t:bigint,p:bigint>>)),
 (s, t) -> transform(array(try_element_at(filter(ps, p -> p.k[t.kind] = t.k[t.kind] AND NOT array_contains(s.used, p.p)), 1)),
  p -> if(p IS NULL, s, named_struct('used', concat(s.used, array(p.p)), 'm', concat(s.m, array(named_struct('t', t.t, 'p', p.p))))))[0]).m"""


def match_rows(truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """(doc_id, t, p): which predicted row each truth row takes, one to one and in order; t or p is null on rows that stay alone.

    A truth row looks for its date and balance, else date and amount, else date, debit and credit, and takes the first row that no
    earlier one took. Where the truth rows of a date have one kind of key, rows pair off by their number within the key, in one
    join; where the kinds differ, they compete for the same rows, and the rows of that date are folded in order.
    """
    money = ("debit", "credit", "amount", "balance")

    def keyed(df: DataFrame, n: str) -> DataFrame:
        m = [parse_money(F.col(c)).alias(f"m_{c}") for c in money]
        k = F.array(*(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in cols)) for cols in KEYS))
        kind = F.when(F.col("m_balance").isNotNull(), 0).when(F.col("m_amount").isNotNull(), 1).otherwise(2)
        df = df.select("doc_id", F.col("row_no").cast("long").alias(n), F.trim(F.coalesce("date", F.lit(""))).alias("d"), *m)
        return df.select("doc_id", n, "d", kind.alias("kind"), k.alias("k"))

    t, p = keyed(truth, "t"), keyed(predicted, "p")
    day = Window.partitionBy("doc_id", "d")
    t = t.withColumn("mixed", F.min("kind").over(day) != F.max("kind").over(day))
    nth = lambda n: F.row_number().over(Window.partitionBy("doc_id", "d", "kind", "key").orderBy(n)).alias("n")
    own = t.where("NOT mixed").select("doc_id", "d", "kind", F.get("k", F.col("kind")).alias("key"), "t").select("*", nth("t"))
    offered = p.select("doc_id", "d", "p", F.posexplode("k").alias("kind", "key")).select("*", nth("p"))
    out = own.join(offered, ["doc_id", "d", "kind", "key", "n"]).select("doc_id", "t", "p")
    ts = t.where("mixed").groupBy("doc_id", "d").agg(F.array_sort(F.collect_list(F.struct("t", "kind", "k"))).alias("ts"))
    ps = p.join(ts.select("doc_id", "d"), ["doc_id", "d"], "left_semi").groupBy("doc_id", "d").agg(F.array_sort(F.collect_list(F.struct("p", "k"))).alias("ps"))
    out = out.unionByName(ts.join(ps, ["doc_id", "d"]).select("doc_id", F.inline(F.expr(_FOLD))))
    both = truth.select("doc_id", F.col("row_no").cast("long").alias("t")).join(out, ["doc_id", "t"], "left")
    alone = predicted.select("doc_id", F.col("row_no").cast("long").alias("p")).join(out.select("doc_id", "p"), ["doc_id", "p"], "left_anti")
    return both.unionByName(alone.withColumn("t", F.lit(None).cast("long")).select("doc_id", "t", "p"))


def score(truth: DataFrame, predicted: DataFrame, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, matched, rows of both, f1 as text, bad balances in the truth and how many of their matches are flagged;
    overall, or by the columns ``by`` (of ``doc_id``)."""
    named = lambda df, n, s: df.select("doc_id", F.col("row_no").alias(n), *(F.trim(F.coalesce(F.col(f), F.lit(""))).alias(f"{s}_{f}") for f in FIELDS), F.coalesce(F.col("flag"), F.lit("")).alias(f"{s}_flag"))
    m = match_rows(truth, predicted).join(named(truth, "t", "t"), ["doc_id", "t"], "left").join(named(predicted, "p", "p"), ["doc_id", "p"], "left")
    tv = lambda f: F.coalesce(F.col(f"t_{f}"), F.lit(""))
    pv = lambda f: F.coalesce(F.col(f"p_{f}"), F.lit(""))
    add = lambda test: sum((test(f).cast("int") for f in FIELDS), F.lit(0))
    tp = add(lambda f: (tv(f) != "") & (tv(f) == pv(f)))
    fn = add(lambda f: (tv(f) != "") & (tv(f) != pv(f)))
    fp = add(lambda f: (pv(f) != "") & (tv(f) != pv(f)))
    bad = F.contains(F.coalesce("t_flag", F.lit("")), F.lit("balance"))
    g = m.groupBy(*(by or [])).agg(
        F.sum(tp).alias("tp"), F.sum(fp).alias("fp"), F.sum(fn).alias("fn"),
        F.count(F.when(F.col("t").isNotNull() & F.col("p").isNotNull(), 1)).alias("matched"),
        F.count("t").alias("truth_rows"), F.count("p").alias("predicted_rows"),
        F.count(F.when(bad, 1)).alias("bad_balances"), F.count(F.when(bad & (F.trim(F.coalesce("p_flag", F.lit(""))) != ""), 1)).alias("bad_caught"),
    )
    f1 = F.when(F.col("tp") == 0, "0.000").otherwise(F.format_string("%.3f", 2.0 * F.col("tp") / (2 * F.col("tp") + F.col("fp") + F.col("fn"))))
    return g.withColumn("f1", f1)
