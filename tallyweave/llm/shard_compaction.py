"""Sharding by size-tiered compaction, in built-in functions only.

Arrivals are appended as small immutable Parquet shards. Compaction takes the small shards of the last manifest in waves, by tier
(shards of like size), lays them end to end by a prefix sum of their uncompressed bytes, and merges each stretch of about
the target size into one file; a wave reads the files that it merges and no others. A manifest names the shards that
count and is committed by renaming a finished folder to the next version, which fails if another writer was first; the
change is then made again on that writer's version. Readers see one version or another, old versions stay readable
until ``vacuum`` is told to drop them, and files of a job that died are never seen. The store needs a file system whose rename
without overwriting is atomic.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import hadoop, maybe_broadcast, new_path, remove, stash, table, unstash

#: Rows of an arriving shard at most; uncompressed bytes of a merged one, and the growth from tier to tier.
ARRIVAL_ROWS = 2_000
TARGET_BYTES = 128 << 20
TIER = 4
#: Shards that one wave merges at most; the next wave takes on from there.
WAVE_FILES = 10_000
#: Paths are below the store's data folder; raw is the uncompressed size of the rows.
MANIFEST = "path string, rows long, bytes long, raw long, tier int"


def versions(spark: SparkSession, base: str) -> list[int]:
    fs, p = hadoop(spark, f"{base}/manifest")
    if not fs.exists(p):
        return []
    return sorted(int(s.getPath().getName()[1:]) for s in fs.listStatus(p) if s.getPath().getName().startswith("v"))


def manifest(spark: SparkSession, base: str, version: int | None = None) -> DataFrame:
    """The shards of a version, the last if none is given; none before the first."""
    version = next(reversed(versions(spark, base)), 0) if version is None else version
    if not version:
        return spark.range(0).selectExpr("'' AS path", "id AS rows", "id AS bytes", "id AS raw", "0 AS tier")
    return spark.read.schema(MANIFEST).json(f"{base}/manifest/v{version:06d}")


def _rename(spark: SparkSession, made: str, to: str) -> bool:
    """Whether ``made`` became ``to``; false if that was there already."""
    jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
    options = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    none = gateway.new_array(options, 1)
    none[0] = options.valueOf("NONE")
    path = jvm.org.apache.hadoop.fs.Path
    files = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path(to).toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        files.rename(path(made), path(to), none)
    except Py4JJavaError as e:
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def commit(spark: SparkSession, base: str, change: Callable[[DataFrame], DataFrame | None], tries: int = 50) -> int | None:
    """Make ``change`` of the last version's shards the next version, and again if another writer was first. The version; none if
    ``change`` gives none, because the version that it would follow leaves nothing to change."""
    for _ in range(tries):
        after = next(reversed(versions(spark, base)), 0)
        entries = change(manifest(spark, base, after))
        if entries is None:
            return None
        made = f"{base}/making-{uuid.uuid4().hex}"
        entries.select("path", "rows", "bytes", "raw", "tier").write.json(made)
        fs, p = hadoop(spark, f"{base}/manifest")
        fs.mkdirs(p)
        if _rename(spark, made, f"{base}/manifest/v{after + 1:06d}"):
            return after + 1
        remove(spark, made)
    raise RuntimeError(f"other writers were first {tries} times")


def row_bytes(schema: T.StructType) -> Column:
    """About the bytes of a row, uncompressed."""
    def one(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(c), F.lit(0))
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(c))), F.lit(0))
        return F.lit(8)

    return sum((one(f) for f in schema.fields), F.lit(4)).cast("long")


def _files(d: DataFrame) -> tuple[Column, Column]:
    """Path below the data folder, and size, of the file that a row of ``d`` comes from."""
    meta = d.metadataColumn("_metadata")
    return F.regexp_replace(meta["file_path"], "^.*/data/", "").alias("path"), meta["file_size"].alias("bytes")


def _read(spark: SparkSession, base: str, paths: list[str], schema: T.StructType) -> DataFrame:
    """The rows of these files only."""
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*(f"{base}/data/{p}" for p in paths))


def _tiered(e: DataFrame) -> DataFrame:
    return e.withColumn("tier", F.floor(F.log(F.greatest("raw", F.lit(1)).cast("double")) / F.log(F.lit(float(TIER)))).cast("int"))


def append(docs: DataFrame, base: str, rows: int = ARRIVAL_ROWS) -> int:
    """Write ``docs`` as small shards, without a shuffle, and commit them after those that are there. The version."""
    spark, folder = docs.sparkSession, uuid.uuid4().hex
    docs.write.option("maxRecordsPerFile", rows).option("compression", "zstd").parquet(f"{base}/data/{folder}")
    d = _read(spark, base, [folder], docs.schema)
    new = stash(_tiered(d.select(*_files(d), row_bytes(docs.schema).alias("raw")).groupBy("path", "bytes").agg(F.count("*").alias("rows"), F.sum("raw").alias("raw"))), "shard-entries")
    version = commit(spark, base, lambda now: now.unionByName(new))
    unstash(new)
    return version


def compaction_plan(entries: DataFrame, target: int = TARGET_BYTES, files: int = WAVE_FILES) -> DataFrame:
    """(path, rows, raw, run): which shards the next wave merges. Shards below half the target, the smallest tiers first, are laid end
    to end within their tier: each stretch of ``target`` bytes is a run, if it holds two shards at least. As a stretch holds
    two shards or more, but for the last of a tier, a wave always has a run while one is left."""
    small = entries.where(F.col("raw") * 2 < target).orderBy("tier", "path").limit(files)
    ahead = Window.partitionBy("tier").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    stretch = F.floor(F.coalesce(F.sum("raw").over(ahead), F.lit(0)) / target)
    runs = small.withColumn("stretch", stretch).withColumn("n", F.count("*").over(Window.partitionBy("tier", "stretch"))).where("n > 1")
    return runs.select("path", "rows", "raw", F.dense_rank().over(Window.orderBy("tier", "stretch")).alias("run"))


def compact(spark: SparkSession, base: str, schema: T.StructType, target: int = TARGET_BYTES, files: int = WAVE_FILES) -> bool:
    """Merge one wave and commit it; false if there is nothing to merge. If another writer has merged one of the shards meanwhile, what
    this wave made is thrown away."""
    plan = stash(compaction_plan(manifest(spark, base), target, files), "shard-plan")
    paths = [r[0] for r in plan.select("path").collect()]  # of one wave
    if paths:
        runs, folder, name = plan.agg(F.max("run")).first()[0], uuid.uuid4().hex, "_run"
        while name in {c.lower() for c in schema.names}:
            name += "_"
        d = _read(spark, base, paths, schema)
        d = d.select(F.struct("*").alias("doc"), _files(d)[0]).join(F.broadcast(plan.select("path", "run")), "path")
        d.select("doc.*", F.col("run").alias(name)).repartitionById(runs, F.col(name) - 1).write.partitionBy(name).option("compression", "zstd").parquet(f"{base}/data/{folder}")
        done = _read(spark, base, [folder], schema)
        made = done.select(*_files(done)).groupBy("path", "bytes").agg(F.count("*").alias("rows")).withColumn("run", F.regexp_extract("path", f"/{name}=([0-9]+)/", 1).cast("int"))
        of = plan.groupBy("run").agg(F.sum("raw").alias("of_raw"), F.sum("rows").alias("of_rows"))
        new = stash(_tiered(made.join(F.broadcast(of), "run").withColumn("raw", (F.col("of_raw") * F.col("rows") / F.col("of_rows")).cast("long"))).select("path", "rows", "bytes", "raw", "tier"), "shard-entries")

        def change(now: DataFrame) -> DataFrame | None:
            if not plan.join(now.select("path"), "path", "left_anti").isEmpty():
                return None
            return now.join(F.broadcast(plan.select("path")), "path", "left_anti").unionByName(new)

        if commit(spark, base, change) is None:
            remove(spark, f"{base}/data/{folder}")
        unstash(new)
    unstash(plan)
    return bool(paths)


def vacuum(spark: SparkSession, base: str, keep: int = 10, older_than: float = 7 * 86400.0) -> None:
    """Delete manifests before the last ``keep`` versions, and data folders that none of those names a shard of. What is younger than
    ``older_than`` seconds stays: another writer may be about to commit it, or a reader be at it."""
    have = versions(spark, base)
    kept = have[-keep:]
    named = None
    for v in kept:
        m = manifest(spark, base, v).select(F.substring_index("path", "/", 1).alias("f")).distinct()
        named = m if named is None else named.unionByName(m)
    # a folder an append or a wave
    used = {r[0] for r in named.distinct().collect()} if named is not None else set()
    now = time.time() * 1000
    for folder, stays in ((f"{base}/data", lambda n: n in used), (f"{base}/manifest", lambda n: int(n[1:]) in kept)):
        fs, p = hadoop(spark, folder)
        for s in fs.listStatus(p) if fs.exists(p) else ():
            if not stays(s.getPath().getName()) and now - s.getModificationTime() >= older_than * 1000:
                fs.delete(s.getPath(), True)


def shards(spark: SparkSession, base: str, schema: T.StructType, version: int | None = None) -> DataFrame:
    """The rows of a version with ``shard`` (its path in the store), ``shard_rows``, ``shard_bytes`` and ``version``. The driver holds a
    version's paths, as it does for any table that Spark reads."""
    v = next(reversed(versions(spark, base)), 0) if version is None else version
    m = manifest(spark, base, v)
    paths = [r[0] for r in m.select("path").collect()]
    d = _read(spark, base, paths, schema)
    e = m.select("path", F.col("rows").alias("shard_rows"), F.col("bytes").alias("shard_bytes"))
    d = d.select(F.struct("*").alias("doc"), _files(d)[0]) if paths else d.select(F.struct("*").alias("doc"), F.lit("").alias("path"))
    d = d.join(maybe_broadcast(e, len(paths)), "path")
    return d.select("doc.*", F.col("path").alias("shard"), "shard_rows", "shard_bytes", F.lit(v).cast("long").alias("version"))


def shard_documents(docs: DataFrame, base: str | None = None, target: int = TARGET_BYTES, rows: int = ARRIVAL_ROWS) -> DataFrame:
    """Append ``docs`` to the store at ``base`` (a new one in the shared folder if not given), compact until no run is left, and return
    its rows with ``shard``, ``shard_rows``, ``shard_bytes`` and ``version``.

    Every row is in one shard with all its columns, nulls, repeated rows and empty texts as they are; columns of the four names
    are dropped, all others stay; an empty table makes a version without shards. A shard that grows out of its tier merges on in a
    later wave, so a row is written a number of times that grows with the logarithm of target to arrival size. Shards that a
    new store has merged are deleted, as nobody else can know them; a given store keeps its versions.
    """
    spark = docs.sparkSession
    docs = docs.drop("shard", "shard_rows", "shard_bytes", "version")
    own = base or new_path(spark, "shards")
    append(docs, own, rows)
    while compact(spark, own, docs.schema, target):
        pass
    if base is None:
        vacuum(spark, own, keep=1, older_than=0)
    return shards(spark, own, docs.schema)


def op10_shard_compaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as read back from their shards, and whether each shard holds what its manifest says and none is left to merge. The
    shards' own names and sizes are new in every run."""
    docs = table(spark, sf_dir, "documents")
    base = new_path(spark, "shards")
    done = shard_documents(docs, base)
    vacuum(spark, base, keep=1, older_than=0)
    small = manifest(spark, base).where(F.col("raw") * 2 < TARGET_BYTES).groupBy("tier").count().where("count > 1").count()
    held = done.groupBy("shard").agg(F.count("*").alias("held"))
    out = done.join(F.broadcast(held), "shard") if len(versions(spark, base)) else done.withColumn("held", F.lit(0))
    return out.select("doc_id", "n_chars", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), (F.col("held") == F.col("shard_rows")).alias("shard_whole"), F.lit(small == 0).alias("compacted"))


SQL = "SELECT doc_id, n_chars, sha256(coalesce(text, '')) AS text_sha256, true AS shard_whole, true AS compacted FROM documents"
