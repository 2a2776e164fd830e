"""Label and value pairs of free text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyweave.functions import vocabulary as V


def pairs_from_text(docs: DataFrame, min_pairs: int = 3, text: str = "text") -> DataFrame:
    """(doc_id, pos, field, value) of documents with ``min_pairs`` pairs at least; a colon between digits makes none."""
    strip = lambda c, marks: F.regexp_replace(c, rf"^[{marks}]+|[{marks}]+$", "")
    lines = docs.select("doc_id", F.posexplode(F.split(text, r"\r\n|\r|\n")).alias("line", "t")).withColumn("t", F.trim("t")).where(F.col("t").rlike("[:•]"))
    each = lambda g: F.regexp_extract_all("t", F.lit(V.PAIR), F.lit(g))
    found = lines.select("doc_id", "line", F.posexplode(F.arrays_zip(each(1).alias("f"), each(2).alias("v"))).alias("n", "p"))
    p = found.select("doc_id", "line", "n", strip(F.col("p.f"), r" .\-").alias("field"), strip(F.col("p.v"), r" .:•\-").alias("value")).where("field <> '' AND value <> ''")
    d = p.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line", "n", "field", "value"))).alias("a")).where(F.size("a") >= min_pairs)
    return d.select("doc_id", F.posexplode("a").alias("pos", "x")).select("doc_id", "pos", "x.field", "x.value")
