"""From raw documents to training shards: five stages, each written as Parquet and read again by the next.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of ``documents``. ``labels`` and ``benchmark`` come from ``sf_dir``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm.common import maybe_broadcast, scratch, stash, table, unstash
from tallyweave.llm.decontaminate import find_leaks
from tallyweave.llm.mix_sources import mix_sources
from tallyweave.llm.near_dedup import near_components
from tallyweave.llm.shard_compaction import shard_documents
from tallyweave.llm.toxicity import fit, score_toxicity


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with its columns of these names called otherwise, and their own names by the other ones."""
    back = {f"_own_{c}": c for c in docs.columns if c in names}
    return docs.withColumnsRenamed({c: n for n, c in back.items()}), back


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below the threshold; null and empty texts have the score of no evidence and stay. Rows that repeat
    are scored each; an empty table of documents or labels drops nothing; columns of any names stay as they are."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    own, back = _aside(docs, "score", "predicted")
    return score_toxicity(own, model).where("predicted = 0").select(*own.columns).withColumnsRenamed(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, 0.8), the one with the smallest id; of rows with one id and
    one text, one. Texts without words, and rows without an id, have no duplicates; an empty table stays empty; columns of any names
    stay as they are."""
    found = stash(near_components(docs), "pipeline-groups")
    gone = found.where("not kept").select("doc_id").distinct()
    out = docs.join(maybe_broadcast(gone, gone.count()), "doc_id", "left_anti")
    many = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    n = many.count()
    if n:
        twice = out.join(maybe_broadcast(many, n), "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
        out = out.join(maybe_broadcast(many, n), "doc_id", "left_anti").unionByName(twice)
    return out.select(*docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that the test set has too; one of nothing but such passages goes. Texts without
    a hit, null ones too, stay as they are; rows that repeat are cut each; an empty table of documents or test items changes nothing;
    columns of any names stay, with n_chars of the cut text."""
    own, back = _aside(docs, "leak")
    found = find_leaks(own, table(spark, sf_dir, "benchmark"), rewrite=True).where("leak.n_hit = 0 or leak.n_hit < leak.n_words")
    hit = F.col("leak.n_hit") > 0
    text = F.when(hit, F.col("leak.clean_text")).otherwise(F.col("text"))
    chars = F.when(hit, F.length("leak.clean_text").cast("long")).otherwise(F.col("n_chars"))
    return found.withColumns({"text": text, "n_chars": chars}).select(*own.columns).withColumnsRenamed(back)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as their source's target takes them, up to three times. A null source is a source; null and empty texts have
    no words, and a source of nothing else gives none; rows that repeat, or are of one size, count each; an empty table stays empty;
    columns of any names stay as they are."""
    return mix_sources(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, repeated ones, nulls and empty texts too, with the shard that holds each, after compaction; an empty table has no
    shard. Of the columns, those called shard, shard_rows, shard_bytes or version are replaced."""
    return shard_documents(docs)


STAGES = [("toxicity", drop_toxic), ("near_duplicates", drop_near_duplicates), ("decontamination", drop_benchmark_passages), ("mix", mix), ("shards", shard)]

#: A trained score and cut texts are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. Each stage's output is written and read by the next, and deleted with all that the stage wrote for itself
    once that has been done; what stays is the result and the store of its shards."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        with scratch(spark) as kept:
            done = stash(stage(spark, docs, sf_dir), f"pipeline-{name}")
            kept.append(done)
        if last is not None:
            unstash(last)
        docs = last = done
    return docs
