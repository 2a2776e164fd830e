"""Toxicity by class-conditional Kneser-Ney models of words as letters.

A word is a sequence of letters with an end mark; the models give each letter's chance after up to ORDER - 1 letters of the
word. Counts of all labelled training texts make one table of grams with a count for each class. The pooled
counts give a Kneser-Ney model of all orders; each class has its own counts at the highest order only and backs off to
that shared model, so that expressions which a class has hardly seen weigh the same in both. A text's score
compares its log-likelihoods by length: the mean log ratio of a letter, and how far its words' log ratios go beyond CLEAR
by the word and in all (the mix of languages moves the mean of all letters, the few words that are said in one class
only do not move with it). Three weights bring these to a probability, on labelled rows that no count has seen.

Counts and models are DataFrames of any size. While its counted rows are within TABLE_ROWS, the executors get the table of all
counted grams and contexts with their log ratios, sorted, 12 bytes each; beyond that, the corpus's distinct words meet the
table in a join, and the texts their words. Both give the same scores. An unseen gram has its context's ratio of backing
off (the shared model is the same in both classes), 0 after an unseen context: just what the models give.
"""

from __future__ import annotations

import sys
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import maybe_broadcast, skew_join, stash, table, unstash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

ORDER = 6
BITS = 10
DISCOUNT = 0.75
#: Pseudo-count with which a class's own counts lean on the shared model.
LEAN = 8.0
#: Log ratio from which a word speaks for the toxic model by itself.
CLEAR = 2.5
#: Labelled rows kept from counting, that fit the weights and the bias: at most one of so many, and about this number.
FOLD = 5
CALIBRATION_ROWS = 20_000
#: Rows of the table of log ratios up to which it is sent to the executors, 96 MB.
TABLE_ROWS = 8_000_000
THRESHOLD = 0.7
PIECE_CHARS = 1 << 18


def letter_codes() -> np.ndarray:
    """Code of each code point: 0 ends a word, digits are one, letters from 896 on share 128 codes."""
    n = 0x110000
    out = np.zeros(n, np.int64)
    alnum = np.array([chr(i).isalnum() for i in range(0x30000)])
    at = np.flatnonzero(alnum)
    out[at] = np.where(at < 896, at, 896 + at % 128)
    out[48:58] = 48
    return out


def grams(texts: list[str | None], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed grams of all texts in order, and how many each text has."""
    joined = " ".join((t or "").lower() for t in texts) + " "
    raw = np.frombuffer(joined.encode("utf-32-le", "replace"), np.uint32)
    lengths = np.array([len((t or "").lower()) + 1 for t in texts], np.int64)
    c = codes[raw]
    word = c > 0
    # a word's letters and the first place after it, as its end
    keep = word.copy()
    keep[1:] |= word[:-1]
    at = np.flatnonzero(keep)
    c, word = c[at], word[at]
    c[~word] = 1
    start = np.ones(len(at), bool)
    start[1:] = ~word[:-1]
    since = np.arange(len(at)) - np.maximum.accumulate(np.where(start, np.arange(len(at)), 0))
    g = c.copy()
    for k in range(1, ORDER):
        g[k:] |= np.where(since[k:] >= k, c[:-k], 0) << (BITS * k)
    return g, np.diff(np.searchsorted(at, np.cumsum(lengths), side="left"), prepend=0)


def _pieces(batches):  # noqa: ANN001
    for batch in batches:
        step = max(1, batch.num_rows * PIECE_CHARS // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def count_grams(labelled: DataFrame) -> DataFrame:
    """(g, t, o): counts of each gram in toxic and ordinary texts of ``labelled(text, toxic)``."""
    schema = T.StructType([T.StructField(x, T.LongType()) for x in ("g", "t", "o")])

    def run(batches):  # noqa: ANN001
        codes, held, size = letter_codes(), [], 0

        def merged():
            g, t, o = (np.concatenate([h[k] for h in held]) for k in range(3))
            own, back = np.unique(g, return_inverse=True)
            return own, np.bincount(back, t, len(own)).astype(np.int64), np.bincount(back, o, len(own)).astype(np.int64)

        for batch in _pieces(batches):
            g, n = grams(batch.column("text").to_pylist(), codes)
            toxic = np.repeat(batch.column("toxic").to_numpy(zero_copy_only=False) == 1, n)
            for mask, k in ((toxic, 1), (~toxic, 2)):
                own, c = np.unique(g[mask], return_counts=True)
                zero = np.zeros(len(own), np.int64)
                held.append((own, c if k == 1 else zero, c if k == 2 else zero))
                size += len(own)
            if size > 1_000_000:
                held = [merged()]
                size = len(held[0][0])
                if size > 700_000:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[0]], names=["g", "t", "o"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in merged()], names=["g", "t", "o"])

    return labelled.mapInArrow(run, schema).groupBy("g").agg(F.sum("t").alias("t"), F.sum("o").alias("o"))


def log_ratios(counts: DataFrame) -> DataFrame:
    """(g, llr): log P(toxic) - log P(ordinary) of each gram's last letter; with 0 as last letter, of one not seen there."""
    top = counts.withColumn("v", F.col("t") + F.col("o"))
    # levels from the highest order down: how many letters precede a gram, or, at a word's start, how often it stands
    levels = [top.select("g", "v")]
    for k in range(ORDER - 1, 0, -1):
        oldest = F.expr(f"shiftright(g, {BITS * k})")
        levels.append(levels[-1].groupBy(F.expr(f"g & {(1 << BITS * k) - 1}").alias("g2")).agg(F.sum(F.when(oldest == 0, F.col("v")).otherwise(1)).alias("v")).withColumnRenamed("g2", "g"))
    p = None
    for k, level in zip(range(1, ORDER + 1), reversed(levels)):
        ctx = Window.partitionBy(F.expr(f"shiftright(g, {BITS})"))
        total, kinds = F.sum("v").over(ctx), F.count("*").over(ctx)
        d = level.withColumn("total", total).withColumn("kinds", kinds)
        if p is None:
            lower = F.lit(1.0) / F.col("kinds")
        else:
            d = d.join(p, F.expr(f"g & {(1 << BITS * (k - 1)) - 1}") == F.col("pg"), "left")
            lower = F.col("pp")
        p = d.select(F.col("g").alias("pg"), ((F.greatest(F.col("v") - DISCOUNT, F.lit(0.0)) + DISCOUNT * F.col("kinds") * lower) / F.col("total")).alias("pp"))
    ctx = Window.partitionBy(F.expr(f"shiftright(g, {BITS})"))
    d = top.join(p, F.col("g") == F.col("pg"))

    def own(c: str) -> Column:
        lean = DISCOUNT * F.sum(F.when(F.col(c) > 0, 1).otherwise(0)).over(ctx) + LEAN
        return (F.greatest(F.col(c) - DISCOUNT, F.lit(0.0)) + lean * F.col("pp")) / (F.sum(c).over(ctx) + LEAN)

    def back(c: str) -> Column:
        return (DISCOUNT * F.sum(F.when(F.col(c) > 0, 1).otherwise(0)) + LEAN) / (F.sum(c) + LEAN)

    seen = d.select("g", (F.log(own("t")) - F.log(own("o"))).alias("llr"))
    other = top.groupBy(F.expr(f"shiftleft(shiftright(g, {BITS}), {BITS})").alias("g")).agg((F.log(back("t")) - F.log(back("o"))).alias("llr"))
    return seen.unionByName(other)


def look_up(g: np.ndarray, keys: np.ndarray, llr: np.ndarray) -> np.ndarray:
    """The log ratio of each of ``g`` in the table of sorted ``keys``."""
    own, back = np.unique(g, return_inverse=True)
    out = np.zeros(len(own))
    if len(keys):
        for k in (own >> BITS << BITS, own):
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1)
            hit = keys[at] == k
            out[hit] = llr[at[hit]]
    return out[back]


@dataclass
class Model:
    #: The broadcast table (keys, log ratios), or a DataFrame (g, llr).
    table: object
    weights: tuple[float, ...] | None
    share: float


FEATURES = ("n_grams", "llr_sum", "words", "excess")


def score_features(docs: DataFrame, ratios, text: str = "text") -> DataFrame:  # noqa: ANN001
    """(doc, n_grams, llr_sum, words, excess): ``docs``' rows as structs, and the words' log ratios, in all and beyond CLEAR."""
    whole = docs.select(F.struct("*").alias("doc"))
    if isinstance(ratios, DataFrame):
        return _features_by_join(whole, ratios, text)
    schema = T.StructType([*whole.schema.fields, T.StructField("n_grams", T.LongType()), T.StructField("llr_sum", T.DoubleType()), T.StructField("words", T.LongType()), T.StructField("excess", T.DoubleType())])

    def run(batches):  # noqa: ANN001
        codes, (keys, own) = letter_codes(), ratios.value
        for batch in _pieces(batches):
            g, n = grams(batch.column("doc").field(text).to_pylist(), codes)
            llr, ends = look_up(g, keys, own), np.cumsum(n)
            last = g & ((1 << BITS) - 1) == 1
            nth = np.concatenate([[0], np.cumsum(last)])
            total = np.concatenate([[0.0], np.cumsum(llr)])
            at = np.concatenate([[0], np.flatnonzero(last) + 1])
            over = np.concatenate([[0.0], np.cumsum(np.maximum(np.diff(total[at]) - CLEAR, 0))])
            first, end = nth[ends - n], nth[ends]
            new = [n.astype(np.int64), total[ends] - total[ends - n], (end - first).astype(np.int64), over[end] - over[first]]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), *map(pa.array, new)], names=["doc", *FEATURES])

    return whole.mapInArrow(run, schema)


def _features_by_join(whole: DataFrame, ratios: DataFrame, text: str) -> DataFrame:
    """The same by joins: a text's distinct words with their counts, the words' grams once for the whole corpus."""
    kept = stash(whole.withColumn("row", F.monotonically_increasing_id()), "toxic-rows")

    def run(batches):  # noqa: ANN001
        codes = letter_codes()
        for batch in _pieces(batches):
            for row, t in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist()):
                g, _ = grams([t], codes)
                ends = np.flatnonzero(g & ((1 << BITS) - 1) == 1) + 1
                counted = Counter(tuple(g[i:j].tolist()) for i, j in zip(np.concatenate([[0], ends[:-1]]), ends))
                if counted:
                    yield pa.RecordBatch.from_arrays([pa.array([row] * len(counted), pa.int64()), pa.array(list(map(list, counted)), pa.list_(pa.int64())), pa.array(list(counted.values()), pa.int64())], names=["row", "w", "c"])

    said = stash(kept.select("row", F.col("doc")[text].alias("text")).mapInArrow(run, "row long, w array<bigint>, c long"), "toxic-words")
    flat = said.select("w").distinct().select("w", F.explode("w").alias("g"))
    flat = skew_join(flat, ratios, "g").withColumn("g", F.expr(f"shiftleft(shiftright(g, {BITS}), {BITS})"))
    flat = skew_join(flat, ratios.withColumnRenamed("llr", "back"), "g")
    per_word = stash(flat.groupBy("w").agg(F.sum(F.coalesce("llr", "back", F.lit(0.0)).cast("double")).alias("llr")), "toxic-vocabulary")
    met = skew_join(said, per_word, "w")
    per = met.groupBy("row").agg(F.sum(F.col("c") * F.size("w")).alias("n_grams"), F.sum(F.col("c") * F.col("llr")).alias("llr_sum"), F.sum("c").alias("words"), F.sum(F.col("c") * F.greatest(F.col("llr") - CLEAR, F.lit(0.0))).alias("excess"))
    zero = {"n_grams": 0, "llr_sum": 0.0, "words": 0, "excess": 0.0}
    return kept.join(per, "row", "left").select("doc", *(F.coalesce(f, F.lit(zero[f])).alias(f) for f in FEATURES))


def fit_weights(x: np.ndarray, y: np.ndarray, ridge: float = 0.1) -> tuple[float, ...]:
    """Logistic weights of the features and a bias, by Newton steps on a slightly penalised likelihood."""
    a = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(a.shape[1]), np.append(np.full(x.shape[1], ridge), 1e-6)
    loss = lambda w: np.sum(np.logaddexp(0, a @ w) - y * (a @ w)) + np.sum(penalty * w * w) / 2
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        hess = (a * (p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(hess, a.T @ (p - y) + penalty * w)
        before, size = loss(w), 1.0
        while size > 1e-6 and not loss(w - size * step) < before:
            size /= 2
        if size <= 1e-6:
            break
        w = w - size * step
    return tuple(w.tolist())


def features() -> list[Column]:
    """What the classes' log-likelihoods say for a letter, for a word, and, as a few toxic words make a long text toxic, beyond CLEAR in all."""
    most = lambda c: F.greatest(F.col(c), F.lit(1)).cast("double")
    return [F.col("llr_sum") / most("n_grams") * 10, F.log1p(F.col("excess") / most("words") * 100), F.log1p("excess")]


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> Model:
    """Learn from labelled rows of ``docs`` whose key is not held out. Rows without a label or with a null key teach nothing; a key with
    several labels counts as toxic if one says so."""
    spark = docs.sparkSession
    own = labels.where("toxic is not null").groupBy(F.col(key).alias("_k")).agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("_k")))
    size = own.agg(F.count("*"), F.avg("toxic")).first()
    share = min(1 / FOLD, CALIBRATION_ROWS / max(1, size[0]))
    own = own.withColumn("_calibrates", F.pmod(F.xxhash64("_k"), F.lit(1 << 30)) < int(share * (1 << 30)))
    slim = docs.select(F.col(key).alias("_k"), F.col(text).alias("text"))
    labelled = slim.join(maybe_broadcast(own, size[0]), "_k")
    counts = stash(count_grams(labelled.where("not _calibrates").select("text", F.col("toxic").cast("long").alias("toxic"))), "toxic-grams")
    ratios = stash(log_ratios(counts).select("g", F.col("llr").cast("float").alias("llr")), "toxic-ratios")
    unstash(counts)
    if ratios.count() <= TABLE_ROWS:
        got = ratios.toArrow()
        unstash(ratios)
        keys, llr = got.column("g").to_numpy(), got.column("llr").to_numpy()
        order = np.argsort(keys)
        ratios = spark.sparkContext.broadcast((keys[order], llr[order]))
    sample = score_features(labelled.where("_calibrates").select("_k", "text", "toxic"), ratios)
    fs = [f.alias(f"f{i}") for i, f in enumerate(features())]
    # a hash's share is near the number, the limit keeps what the driver takes at it
    got = sample.select(F.xxhash64("doc._k").alias("h"), *fs, F.col("doc.toxic").cast("long").alias("toxic")).orderBy("h").limit(CALIBRATION_ROWS).toArrow()
    y = got.column("toxic").to_numpy().astype(float)
    weights = fit_weights(np.column_stack([got.column(f"f{i}").to_numpy() for i in range(len(fs))]), y) if len(set(y)) == 2 else None
    return Model(ratios, weights, float(size[1] or 0.0))


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` and ``predicted``; columns of these names are replaced, all others stay.

    Whole texts of any length are scored; a null, empty or letterless text has the score of a mean of zero. Equal texts have equal
    scores. If the labels hold only one class, the score is their share of toxic rows.
    """
    own = [c for c in docs.columns if c not in ("score", "predicted")]
    scored = score_features(docs.select(*(F.col(f"`{c}`") for c in own)), model.table, text)
    if model.weights is None:
        score = F.lit(model.share)
    else:
        *weights, bias = model.weights
        score = 1 / (1 + F.exp(-sum((f * w for f, w in zip(features(), weights)), F.lit(bias))))
    out = scored.select(F.col("doc"), score.alias("score"))
    return out.select(*(F.col("doc")[c].alias(c) for c in own), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
