"""Shared pieces: written tables in the cluster's shared folder, components of a link graph."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side with rows of a few dozen bytes is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share, as the session names it."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), "tallyweave-shared")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


#: Stashed tables of this process that are still there.
_LIVE: set[str] = set()


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends at replicated files, so a lost
    executor costs a re-read and not a re-computation."""
    spark = df.sparkSession
    path = new_path(spark, label)
    _LIVE.add(path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stash_path = path
    return out


def unstash(*dfs: DataFrame) -> None:
    """Delete stashed tables that no later plan reads."""
    for df in dfs:
        remove(df.sparkSession, df._stash_path)
        _LIVE.discard(df._stash_path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Delete at the end all that was stashed within, but for the tables in the list that is given."""
    before, kept = set(_LIVE), []
    try:
        yield kept
    finally:
        own = {df._stash_path for df in kept}
        for path in _LIVE - before - own:
            remove(spark, path)
        _LIVE.intersection_update(before | own)


def clean_up(spark: SparkSession) -> None:
    """Delete all that this process has stashed, once the results that read it are done with."""
    for path in list(_LIVE):
        remove(spark, path)
    _LIVE.clear()


def hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove(spark: SparkSession, path: str) -> None:
    fs, p = hadoop(spark, path)
    fs.delete(p, True)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if its counted rows are within ``limit``; else as it is, to be shuffled."""
    return F.broadcast(df) if rows <= limit else df


def skew_join(left: DataFrame, right: DataFrame, key: str, most: int = 50_000) -> DataFrame:
    """Left join of ``left`` with the one row that ``right`` has for a key, whatever a key's share of ``left``: keys with more than one of
    ``most`` rows, of which there are less than ``most``, are broadcast, the others shuffled."""
    counts = left.groupBy(key).count()
    total = left.count()
    hot = stash(counts.where(F.col("count") * most > total).select(key), "hot-keys")
    few = F.broadcast(right.join(F.broadcast(hot), key, "left_semi"))
    return left.join(F.broadcast(hot), key, "left_semi").join(few, key, "left").unionByName(left.join(F.broadcast(hot), key, "left_anti").join(right, key, "left"))


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def components(links: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """(id, component) for every id in ``links(a, b)``; component is the smallest id reachable.

    Alternating large-star and small-star steps: every node hangs its neighbours under the smallest one, which
    keeps the edges at most linear in the links and ends in a number of rounds near the logarithm of the longest
    chain. Groups are reduced by ``min`` with map-side combining; no group is collected.
    """
    spark = links.sparkSession
    edges = stash(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), label)
    for _ in range(rounds):
        # large star: neighbours larger than u go under u's smallest neighbour (or u itself)
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: u and its smaller neighbours go under the smallest of them
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = stash(small, label)
        same = new.join(edges, ["u", "v"], "left_anti").isEmpty() and edges.join(new, ["u", "v"], "left_anti").isEmpty()
        unstash(edges)
        edges = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
