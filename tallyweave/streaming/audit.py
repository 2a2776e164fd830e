"""Ledger rows that arrive as files: each batch is audited by the functions of the batch engine.

The reference semantics are those of a whole document, so a batch re-audits the documents that it touches, over all of their
rows so far.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tallyweave.operators.reconcile import normalize_rows, reconcile, summarize


def audit_stream(spark: SparkSession, source: str, schema: StructType, store: str, checkpoint: str, partitions: int = 32) -> StreamingQuery:
    """Read ``source`` as a stream of Parquet files of raw rows; keep rows under ``store``/rows, by a hash of the document, and a
    summary of the documents of each batch under ``store``/summaries/batch=N. A batch that is run again overwrites what it wrote."""
    def batch(df: DataFrame, n: int) -> None:
        part = F.pmod(F.xxhash64("doc_id"), F.lit(partitions)).cast("int")
        df.withColumn("part", part).write.mode("overwrite").partitionBy("part").parquet(f"{store}/rows/batch={n}")
        touched = df.select("doc_id", part.alias("part")).distinct()
        rows = spark.read.option("basePath", f"{store}/rows").parquet(f"{store}/rows")
        own = rows.join(touched, ["doc_id", "part"], "left_semi").drop("part", "batch")
        summarize(reconcile(normalize_rows(own))).write.mode("overwrite").parquet(f"{store}/summaries/batch={n}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
