"""Mixing sources to target weights by systematic sampling, in built-in functions only.

Every document of a source expects target / source size copies. The prefix sum of the expected copies runs through
the source in blocks: a block's rows are ranked within it, the ranks before it are the counts of the blocks before
it. One offset a source shifts the sums, and a document goes out once for each integer that its part of the sum
crosses. No task holds more than a block, however large the source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyweave.llm.common import table

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
#: Rows of all sources together for one block of each source.
BLOCK_ROWS = 10_000
SEED = "mix-1"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _hash(c: Column) -> Column:
    """28 bits of a string's md5, on which SQL engines agree."""
    return F.conv(F.substring(F.md5(c), 1, 7), 16, 10).cast("long")


def _name(c: Column) -> Column:
    """A source as a key that is never null and sorts by code point, null last."""
    return F.when(c.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), c))


def source_targets(sizes: DataFrame, weights: tuple = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """(skey, source_size, target) from (skey, source_size), a row a source.

    Shares are in proportion to the weights, dealt by ``skey``'s order, but none is above ``most`` times its source's
    size: in the rising order of that bound by weight, sources stop at their bound until the level at which the
    rest share what is left is below the next bound.
    """
    arr = F.array(*(F.lit(w).cast("long") for w in weights))
    whole = Window.partitionBy()
    rising = Window.orderBy("full_at", "skey")
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    t = sizes.withColumn("w", F.get(arr, (F.row_number().over(Window.orderBy("skey")) - 1) % len(weights)))
    t = t.withColumn("cap", F.col("source_size") * most).withColumn("full_at", F.col("cap") / F.col("w"))
    left = F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    left_w = F.sum("w").over(whole) - F.coalesce(F.sum("w").over(before), F.lit(0))
    t = t.withColumn("level", left / left_w).withColumn("nth", F.row_number().over(rising))
    t = t.withColumn("level", F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("nth", "level"))).over(whole)["level"])
    return t.select("skey", "source_size", F.least(F.col("cap").cast("double"), F.col("w") * F.col("level")).alias("target"))


def mix_plan(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """(doc, size, source_size, target, copies): ``docs``' rows as structs ``doc``, so that no name of theirs can clash.

    A null text has size 0; null is a source like others; rows that repeat count each; a source without words gets no
    copies; an empty table gives an empty one; rows without a key are dealt to blocks by their text. Within a block rows are ordered by
    size, so that what is taken keeps near the target for short and long documents alike, then by key and text. The same rows give the
    same copies, whatever their partitions. What one task orders at once is a block of a source, or the sources themselves.
    """
    blocks = max(1, -(-docs.count() // BLOCK_ROWS))
    tie = F.xxhash64(text)
    name = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("t"), F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))))
    d = docs.select(F.struct("*").alias("doc"), word_count(F.col(text)).alias("size"), F.col(key).alias("key"), tie.alias("tie"), _name(F.col(source)).alias("skey"), (_hash(F.concat(F.lit(seed), name)) % blocks).alias("block"))
    counts = d.groupBy("skey", "block").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    ahead = Window.partitionBy("skey").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0))).select("skey", "block", "ahead")
    sizes = counts.groupBy("skey").agg(F.sum("words").alias("source_size"))
    info = offsets.join(source_targets(sizes), "skey")
    rank = F.row_number().over(Window.partitionBy("skey", "block").orderBy("size", "key", "tie"))
    x = d.withColumn("nth", rank).join(info, ["skey", "block"])
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shift = _hash(F.concat(F.lit(seed), F.col("skey"))) / float(1 << 28)
    upto = lambda k: F.floor(rate * k + shift)
    last = F.col("ahead") + F.col("nth")
    x = x.withColumn("copies", F.least(upto(last) - upto(last - 1), F.lit(MOST_COPIES)).cast("long"))
    return x.select("doc", "size", "source_size", "target", "copies")


def mix_sources(docs: DataFrame, text: str = "text", source: str = "source", key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """The mix itself: each row as often as the plan takes it, with all columns of ``docs`` whatever their names. Nulls, ties,
    repeated rows and empty tables as in ``mix_plan``."""
    planned = mix_plan(docs, text, source, key, seed).where("copies > 0")
    return planned.select("doc", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("doc.*")


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mix_plan(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return plan.select("doc.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = rf"""
WITH n AS (SELECT greatest(1, CAST(ceil(count(*) / {BLOCK_ROWS}.0) AS BIGINT)) AS blocks FROM documents),
d AS (SELECT doc_id, CASE WHEN source IS NULL THEN '1' ELSE '0' || source END AS skey,
 CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
 CAST('0x' || substr(md5('{SEED}' || coalesce(CAST(doc_id AS VARCHAR), 't' || md5(coalesce(text, '')))), 1, 7) AS BIGINT) % (SELECT blocks FROM n) AS block FROM documents),
s AS (SELECT skey, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, CASE (row_number() OVER (ORDER BY skey) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
c AS (SELECT *, source_size * 3 AS cap, CAST(source_size * 3 AS DOUBLE) / w AS full_at FROM w),
l AS (SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER r, 0) AS DOUBLE) / CAST(sum(w) OVER () - coalesce(sum(w) OVER r, 0) AS DOUBLE) AS level,
 row_number() OVER (ORDER BY full_at, skey) AS nth FROM c WINDOW r AS (ORDER BY full_at, skey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT skey, source_size, least(CAST(cap AS DOUBLE), w * (SELECT arg_min(level, nth) FROM l WHERE level <= full_at)) AS target FROM l),
o AS (SELECT skey, block, sum(count(*)) OVER (PARTITION BY skey ORDER BY block) - count(*) AS ahead FROM d GROUP BY 1, 2),
k AS (SELECT d.*, ahead + row_number() OVER (PARTITION BY d.skey, d.block ORDER BY size, doc_id) AS nth FROM d JOIN o ON d.skey = o.skey AND d.block = o.block),
r AS (SELECT k.*, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
 CAST('0x' || substr(md5('{SEED}' || k.skey), 1, 7) AS BIGINT) / 268435456.0::DOUBLE AS shift FROM k JOIN t ON k.skey = t.skey)
SELECT doc_id, size, source_size, target,
 CAST(least(floor(rate * CAST(nth AS DOUBLE) + shift) - floor(rate * CAST(nth - 1 AS DOUBLE) + shift), 3) AS BIGINT) * size AS taken FROM r
"""
