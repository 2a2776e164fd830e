"""Near-duplicates by MinHash with tensored banding.

Two collections of SIDE tuples of two minhashes each are computed, 32 minhashes in all; a table's key pairs a tuple of
the first collection with one of the second, which gives SIDE * SIDE = 64 tables for the price of 2 * SIDE. Texts with
equal shingle sets are one representative, and representatives that share no tuple of one collection with
another are left out before the keys are paired. In each table's bucket a representative is compared with the smallest
one and with its neighbours in the order of the signatures, never with all. Candidates are confirmed on full sets,
the most likely partner of each first; later rounds take only those whose ends are still apart. Members of buckets
with more members than neighbours, and of more than one component by then, are joined exactly: by the rare end of
their full sets. Keys with more than HOT rows are dealt over tasks by salt, in neighbours' order and in that join.
"""

from __future__ import annotations

import math
import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import BROADCAST_ROWS, components, maybe_broadcast, scratch, stash, table, unstash

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SIDE = 8
#: The lowest threshold that the number of tables is made for: there, one link in 400 shares none.
LEAST_SIMILARITY = 0.75
#: Odds with which a link has fewer equal minhashes than a candidate needs to be confirmed.
LOST = 5e-5
#: Rows of one key that one task takes.
HOT = 2_000
#: Neighbours in a bucket's order of signatures with which a document is compared.
NEIGHBOURS = 5
PAIRS_A_ROUND = (1, 1 << 30)
PIECE_BYTES = 1 << 20

_LOWER = bytes(b + 32 if 65 <= b <= 90 else 32 if 9 <= b <= 13 else b for b in range(256))
_ALL = (1 << 64) - 1
_MULT = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(int(_MULT), -1, 1 << 64)
    p, q = np.full(n + 1, _MULT, np.uint64), np.full(n + 1, np.uint64(inv), np.uint64)
    p[0] = q[0] = 1
    return np.cumprod(p, dtype=np.uint64), np.cumprod(q, dtype=np.uint64)


def word_hashes(texts: list[bytes], powers: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of the texts, and each text's number of words. A word's hash is that of its bytes and its
    length, wherever it stands: a prefix sum of byte times power, shifted back by the word's place."""
    flat = b" ".join(t.translate(_LOWER) for t in texts) + b" "
    raw = np.frombuffer(flat, np.uint8)
    up, down = powers if len(powers[0]) > len(raw) else _powers(len(raw))
    black = raw != 32
    edge = np.flatnonzero(np.diff(black.view(np.int8), prepend=np.int8(0)))
    start, end = edge[::2], edge[1::2]
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_SALTS[raw] * up[: len(raw)], out=sums[1:])
    h = (sums[end] - sums[start]) * down[start]
    h = _mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(start, ends, side="left"), prepend=0)


_SALTS = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))


def shingle_sets(texts: list[str | None], width: int, powers: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text; a text of fewer words than ``width`` has one, of all of them."""
    h, counts = word_hashes([(t or "").encode() for t in texts], powers)
    n = len(h)
    s = np.zeros(n, np.uint64)
    for k in range(width):
        part = h[k:] if k else h
        s[: n - k] += _mix(part + np.uint64((k + 1) * 0xE7037ED1A0B428DB & _ALL)) * np.uint64(2 * k + 3)
    s = _mix(s)
    out, at = [], 0
    for c in counts.tolist():
        if c >= width:
            out.append(np.unique(s[at : at + c - width + 1]))
        elif c:
            one = np.full(1, c, np.uint64)
            for i in range(at, at + c):
                one = _mix(one * _MULT + h[i : i + 1])
            out.append(one)
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out


def signatures(sets: list[np.ndarray], seed: int = 7) -> np.ndarray:
    """4 * SIDE minhashes of 32 bits of each set; a set without shingles has zeros."""
    rng = np.random.default_rng(seed)
    a = rng.integers(1, 1 << 32, 4 * SIDE, np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, 4 * SIDE, np.uint32)
    out = np.zeros((len(sets), 4 * SIDE), np.uint32)
    full = [i for i, s in enumerate(sets) if len(s)]
    if not full:
        return out
    size = np.array([len(sets[i]) for i in full])
    flat = np.concatenate([sets[i] for i in full])
    low, high = flat.astype(np.uint32), (flat >> np.uint64(32)).astype(np.uint32)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    for k in range(4 * SIDE):
        x = low * a[k] + b[k]
        x ^= x >> np.uint32(15)
        x += high
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        out[full, k] = np.minimum.reduceat(x, first)
    return out


def _chunks(batches, text: str):  # noqa: ANN001
    """Pieces of Arrow batches of about PIECE_BYTES, so that a batch of long texts needs no more memory."""
    for batch in batches:
        step = max(1, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes))
        for i in range(0, batch.num_rows, step):
            yield batch.slice(i, step)


def sketch(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, n, set_hi, set_lo, left, right, sig): set size, 128 bits of the set, keys of both collections, and a byte
    of each minhash."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("set_hi", T.LongType()), T.StructField("set_lo", T.LongType()), T.StructField("left", T.ArrayType(T.LongType())), T.StructField("right", T.ArrayType(T.LongType())), T.StructField("sig", T.BinaryType())])

    def run(batches):  # noqa: ANN001
        powers = _powers(PIECE_BYTES * 2)
        for batch in _chunks(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), width, powers)
            m = signatures(sets)
            pair = _mix((m[:, ::2].astype(np.uint64) << np.uint64(32)) | m[:, 1::2].astype(np.uint64)).view(np.int64)
            hi = np.array([np.add.reduce(_mix(s), dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            lo = np.array([np.add.reduce(_mix(s * _MULT + np.uint64(1)), dtype=np.uint64) if len(s) else 0 for s in sets], np.uint64).view(np.int64)
            flat = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, SIDE * len(sets) + 1, SIDE), pa.int32()), pa.array(np.ascontiguousarray(x).reshape(-1)))
            sig = np.ascontiguousarray((m & 255).astype(np.uint8)).tobytes()
            size = 4 * SIDE
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi), pa.array(lo), flat(pair[:, :SIDE]), flat(pair[:, SIDE:]), pa.array([sig[i : i + size] for i in range(0, len(sig), size)], pa.binary())],
                names=schema.fieldNames(),
            )

    return docs.mapInArrow(run, schema)


def full_sets(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, shingles) with all distinct shingle hashes."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches):  # noqa: ANN001
        powers = _powers(PIECE_BYTES * 2)
        for batch in _chunks(batches, "text"):
            sets = shingle_sets(batch.column("text").to_pylist(), width, powers)
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
            values = np.concatenate(sets).view(np.int64) if len(sets) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))], names=schema.fieldNames())

    return docs.mapInArrow(run, schema)


def _equal(a, b):  # noqa: ANN001
    """Minhash bytes that two signatures share."""
    return F.expr(f"aggregate(sequence(1, {4 * SIDE}), 0, (n, i) -> n + if(substring({a}, i, 1) = substring({b}, i, 1), 1, 0))")


def least_equal(num: int, den: int) -> int:
    """The most equal minhashes, of all, that a pair at the threshold falls below with odds of LOST at most."""
    n, p, below = 4 * SIDE, num / den, 0.0
    for k in range(n):
        below += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if below > LOST:
            return k
    return n


def _shared(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of ``rows`` whose keys another row has. Only shared keys are kept; a frequent one needs no task of its own."""
    counts = stash(rows.groupBy(*keys).count().where("count > 1"), "near-shared")
    n = counts.count()
    if n <= BROADCAST_ROWS:
        return rows.join(F.broadcast(counts.select(*keys)), keys, "left_semi")
    hot = counts.where(F.col("count") > HOT).select(*keys)
    hot = maybe_broadcast(hot, hot.count())
    return rows.join(hot, keys, "left_semi").unionByName(rows.join(hot, keys, "left_anti").join(counts.select(*keys), keys, "left_semi"))


def buckets(reps: DataFrame) -> DataFrame:
    """(doc_id, sig, key, turn): the tables' keys of all representatives that may share one."""
    both = reps.select("doc_id", F.posexplode(F.concat("left", "right")).alias("p", "v"))
    shared = _shared(both, ["p", "v"])
    # a document can share a table only over a shared tuple of each collection
    live = shared.groupBy("doc_id").agg(F.expr("bit_or(shiftleft(1, p))").alias("m")).select("doc_id", F.expr(f"m & {(1 << SIDE) - 1}").alias("l"), F.expr(f"shiftright(m, {SIDE})").alias("r")).where("l <> 0 and r <> 0")
    rows = reps.join(live, "doc_id").select("doc_id", "sig", F.explode(_bits("left", "l")).alias("a"), "right", "r").select("doc_id", "sig", "a", F.explode(_bits("right", "r")).alias("b"))
    return rows.select("doc_id", "sig", F.xxhash64("a.i", "a.v", "b.i", "b.v").alias("key"), (F.col("a.i") * 4 % (4 * SIDE) + F.col("b.i")).alias("turn"))


def candidates(keyed: DataFrame, least: int) -> DataFrame:
    """(x, y, equal) with x > y: pairs that meet in a table's bucket as smallest and other, or as neighbours by signature. A bucket of more
    than HOT members is ordered in parts; all of its members meet the bucket's smallest one."""
    hot = stash(keyed.groupBy("key").agg(F.count("*").alias("members"), F.min(F.struct("doc_id", "sig")).alias("smallest")).where(F.col("members") > HOT), "near-hot")
    keyed = keyed.join(maybe_broadcast(hot, hot.count()), "key", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("doc_id"), F.ceil(F.col("members") / HOT)), F.lit(0)))
    # neighbours by the signature, turned by another amount in each table
    keyed = keyed.withColumn("order", F.concat(F.expr("substring(sig, turn % 32 + 1, 32)"), F.expr("substring(sig, 1, turn % 32)")))
    w = Window.partitionBy("key", "salt").orderBy("order", "doc_id")
    hub = F.coalesce("smallest", F.min(F.struct("doc_id", "sig")).over(Window.partitionBy("key", "salt")))
    near = [F.lag(F.struct("doc_id", "sig"), n).over(w).alias(f"near{n}") for n in range(1, NEIGHBOURS + 1)]
    met = keyed.select("doc_id", "sig", hub.alias("hub"), *near)
    others = F.array_compact(F.array("hub", *(f"near{n}" for n in range(1, NEIGHBOURS + 1))))
    pairs = met.select("doc_id", "sig", F.explode(F.filter(others, lambda o: o["doc_id"] != F.col("doc_id"))).alias("o"))
    pairs = pairs.select(F.greatest("doc_id", "o.doc_id").alias("x"), F.least("doc_id", "o.doc_id").alias("y"), F.when(F.col("doc_id") > F.col("o.doc_id"), F.col("sig")).otherwise(F.col("o.sig")).alias("s"), F.when(F.col("doc_id") > F.col("o.doc_id"), F.col("o.sig")).otherwise(F.col("sig")).alias("u"))
    return pairs.groupBy("x", "y").agg(F.first("s").alias("s"), F.first("u").alias("u")).select("x", "y", _equal("s", "u").alias("equal")).where(F.col("equal") >= least)


def _bits(array: str, mask: str):
    """The (place, tuple) of ``array`` whose place is set in ``mask``."""
    return F.expr(f"filter(transform({array}, (v, i) -> struct(i as i, v as v)), p -> shiftright({mask}, p.i) & 1 = 1)")


def crowded(keyed: DataFrame, comp: DataFrame | None) -> DataFrame:
    """(doc_id, c): members, with their component, of the buckets that have members which were not compared and are apart."""
    full = stash(keyed.groupBy("key").count().where(F.col("count") > NEIGHBOURS + 1).select("key"), "near-full")
    own = keyed.select("key", "doc_id").join(maybe_broadcast(full, full.count()), "key", "left_semi")
    if comp is None:
        own = own.withColumn("c", F.col("doc_id"))
    else:
        own = own.join(comp.select(F.col("id").alias("doc_id"), "component"), "doc_id", "left").select("key", "doc_id", F.coalesce("component", "doc_id").alias("c"))
    own = stash(own, "near-members")
    mixed = stash(own.groupBy("key").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("key"), "near-mixed")
    return own.join(maybe_broadcast(mixed, mixed.count()), "key", "left_semi").select("doc_id", "c").distinct()


def crowded_pairs(ids: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """(x, y) with x > y: all pairs of ``ids(doc_id, c)`` of different components that can be links, none left out.

    Shingles are put in one order: those of a single component first, then the rare before the frequent. The first
    common shingle of a link has at least num / den of either set at or behind it, so only shingles as far from the end as that
    are posted, and two postings meet only if what is at or behind them suffices. In a shingle's
    postings those of the largest component meet the others, never one another. Both sides of a shingle with more than HOT
    postings are dealt over a grid of tasks, and meet only where their sets are of like size, as a link's are.
    """
    rows = sets.join(ids, "doc_id").select("doc_id", "c", F.size("shingles").cast("long").alias("n"), F.explode("shingles").alias("g"))
    across = stash(rows.groupBy("g").agg(F.count("*").alias("f"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("lo <> hi").select("g", "f"), "near-across")
    from_end = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("f"), "g"))
    posts = rows.join(maybe_broadcast(across, across.count()), "g").withColumn("r", from_end.cast("long")).where(F.col("r") * den >= F.col("n") * num).select("g", "doc_id", "c", "n", "r")
    posts = stash(posts, "near-posts")
    main = posts.groupBy("g", "c").count().groupBy("g").agg(F.max_by("c", F.struct("count", "c")).alias("main"), F.sum("count").alias("f"), F.max("count").alias("most"))
    main = stash(main.where("f > most"), "near-main")
    hot = main.where(F.col("f") > HOT).select("g", "main", F.ceil((F.col("f") - F.col("most")) / HOT).cast("int").alias("across"), F.ceil(F.col("f") / HOT).cast("int").alias("down"))
    n_hot = hot.count()
    hot = maybe_broadcast(hot, n_hot)
    other = ("doc_id", "c", "n", "r")
    renamed = lambda df: df.withColumnsRenamed({k: f"{k}2" for k in other})
    cold = posts.join(hot, "g", "left_anti").join(main.select("g", "main"), "g") if n_hot else posts.join(main.select("g", "main"), "g")
    met = cold.where("c <> main").select("g", *other).join(renamed(cold.select("g", *other)), "g")
    if n_hot:
        h = posts.join(hot, "g").withColumn("like", F.floor(F.log(F.col("n").cast("double")) / math.log(den / num)) if num < den else F.col("n"))
        at = lambda c: F.pmod(F.xxhash64("doc_id"), F.col(c)).cast("int")
        all_of = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        few = h.where("c <> main").withColumn("a", at("across")).withColumn("b", all_of("down")).withColumn("like", F.explode(F.sequence(F.col("like") - 1, F.col("like") + 1)))
        every = h.withColumn("b", at("down")).withColumn("a", all_of("across"))
        grid = ["g", "a", "b", "like"]
        met = met.unionByName(few.select(*grid, *other).join(renamed(every.select(*grid, *other)), grid).select(*met.columns))
    met = met.where((F.col("c") != F.col("c2")) & (F.least("r", "r2") * (den + num) >= (F.col("n") + F.col("n2")) * num))
    out = stash(met.select(F.greatest("doc_id", "doc_id2").alias("x"), F.least("doc_id", "doc_id2").alias("y")).distinct(), "near-crowded")
    unstash(posts, main, across)
    return out


def sets_of(ids: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """The full sets of the documents of ``ids``, written."""
    return stash(full_sets(docs.join(maybe_broadcast(ids, ids.count()), "doc_id", "left_semi"), width).dropDuplicates(["doc_id"]), "near-sets")


def confirm(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (x, y) whose full sets have den * intersection >= num * union."""
    out = pairs.join(sets.select(F.col("doc_id").alias("x"), F.col("shingles").alias("sx")), "x").join(sets.select(F.col("doc_id").alias("y"), F.col("shingles").alias("sy")), "y")
    inter = F.size(F.array_intersect("sx", "sy"))
    return stash(out.select("x", "y", inter.alias("i"), (F.size("sx") + F.size("sy") - inter).alias("u")).where(F.col("i") * den >= F.col("u") * num).select("x", "y"), "near-links")


def near_components(docs: DataFrame, text: str = "text", key: str = "doc_id", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs``.

    Texts are linked with den * intersection >= num * union of their shingle sets (``width`` words, whole texts); the component is the
    smallest id reachable. A text without words, or null, has an empty set and no link; one with fewer words than
    ``width`` has its whole sequence as shingle. Equal sets are linked without comparison. Ids that repeat are one
    document with several rows: each row gets the smallest component of the id's rows. A null id is a component of its own (null, kept).
    Of the other columns none is used, whatever their names; an empty table gives an empty one. Thresholds below LEAST_SIMILARITY are
    refused. What is written for the result is all that stays in the shared folder.
    """
    if num < LEAST_SIMILARITY * den:
        raise ValueError(f"the tables are made for similarities of {LEAST_SIMILARITY} and more")
    with scratch(docs.sparkSession) as kept:
        out = stash(_near_components(docs, text, key, width, num, den), "near-result")
        kept.append(out)
    return out


def _near_components(docs: DataFrame, text: str, key: str, width: int, num: int, den: int) -> DataFrame:
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text"))
    sk = stash(sketch(slim, width), "near-sketch")
    classes = sk.where("n > 0 and doc_id is not null").groupBy("set_hi", "set_lo", "n").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.min_by(F.struct("left", "right", "sig"), "doc_id").alias("s"))
    reps = classes.select(F.col("rep").alias("doc_id"), "s.left", "s.right", "s.sig").dropDuplicates(["doc_id"])
    keyed = stash(buckets(reps), "near-keys")
    pairs = stash(candidates(keyed, least_equal(num, den)), "near-pairs")
    links, comp, tried = None, None, None
    for most in PAIRS_A_ROUND:
        todo = pairs if comp is None else _apart(pairs, comp).join(tried, ["x", "y"], "left_anti")
        nth = F.row_number().over(Window.partitionBy("x").orderBy(F.desc("equal"), "y"))
        todo = stash(todo.withColumn("nth", nth).where(F.col("nth") <= most).select("x", "y"), "near-round")
        if todo.isEmpty():
            break
        ids = stash(todo.select(F.col("x").alias("doc_id")).distinct().unionByName(todo.select(F.col("y").alias("doc_id")).distinct()).distinct(), "near-ids")
        sets = sets_of(ids, slim, width)
        found = confirm(todo, sets, num, den)
        unstash(ids, sets)
        tried = todo
        links = found if links is None else links.unionByName(found)
        comp = components(links.toDF("a", "b"), "near-comp")
    ids = stash(crowded(keyed, comp), "near-ids")
    if not ids.isEmpty():
        sets = sets_of(ids, slim, width)
        found = confirm(crowded_pairs(ids, sets, num, den), sets, num, den)
        unstash(sets)
        if not found.isEmpty():
            links = found if links is None else links.unionByName(found)
            comp = components(links.toDF("a", "b"), "near-comp")
    unstash(ids, keyed)
    # members of a set's class hang under its representative, representatives under their component; large classes are broadcast
    own = ["set_hi", "set_lo", "n"]
    label = classes.select(*own, "copies", F.col("rep").alias("component"))
    if comp is not None:
        label = classes.join(comp.withColumnRenamed("id", "rep"), "rep", "left").select(*own, "copies", F.coalesce("component", "rep").alias("component"))
    label = stash(label, "near-labels")
    hot = label.where(F.col("copies") > HOT).drop("copies")
    hot = maybe_broadcast(hot, hot.count())
    rows = sk.where("n > 0 and doc_id is not null").select("doc_id", *own)
    member = rows.join(hot, own).unionByName(rows.join(hot.select(*own), own, "left_anti").join(label.where(F.col("copies") <= HOT).drop("copies"), own)).select("doc_id", "component")
    member = member.groupBy("doc_id").agg(F.min("component").alias("component"))
    out = sk.select("doc_id", F.col("n").alias("n_shingles")).join(member, "doc_id", "left")
    out = out.withColumn("component_id", F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def _apart(pairs: DataFrame, comp: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components."""
    c = lambda n: comp.select(F.col("id").alias(n), F.col("component").alias(f"c{n}"))
    p = pairs.join(c("x"), "x", "left").join(c("y"), "y", "left")
    return p.where(F.coalesce("cx", "x") != F.coalesce("cy", "y")).select(*pairs.columns)


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(table(spark, sf_dir, "documents").select("doc_id", "text"), width=3, num=85)


_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2]) WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
r AS (SELECT doc_id AS x, doc_id AS y FROM d UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
c AS (SELECT x, min(y) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept FROM d LEFT JOIN n USING (doc_id) JOIN c ON c.x = d.doc_id
"""
