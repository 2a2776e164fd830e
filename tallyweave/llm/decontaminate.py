"""Benchmark decontamination over one FM-index per training shard.

A shard is about half a million words of consecutive documents of one partition. Words that no test phrase holds are
boundaries: a phrase cannot cross them, so they are left out of the index and only their places are remembered.
The rest is sorted by suffix (boundaries are distinct and order by place), its Burrows-Wheeler transform is kept in a
wavelet matrix, all phrases are searched backwards together by ranks, and occurrences are found by walking to
sampled suffix positions. Shards are built where their rows are: the corpus is read once and never shuffled. The test set
goes out in blocks of bounded size, each a broadcast of plain arrays; a task holds one block at a time.
"""

from __future__ import annotations

import re
import sys
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyweave.llm.common import ascii_lower, table

cloudpickle.register_pickle_by_value(sys.modules[__name__])

WINDOW = 10
SHARD_WORDS = 1 << 19
SAMPLE_EVERY = 16
#: Bytes of test text in one block of phrases, about; at most some 60 MB of arrays.
BLOCK_BYTES = 4 << 20
#: Words of a piece of a long item.
PIECE_WORDS = 1 << 15

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Byte by byte: A-Z lower-cased, every other ASCII byte that is no digit or letter a space. UTF-8's other bytes stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_TABLE).split()


class Phrases:
    """The windows of all items: words numbered from 1, windows grouped by length, items by window."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        self.names = sorted({x for x, _ in items if x is not None})
        nth = {x: k for k, x in enumerate(self.names)} | {None: -1}
        found: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for item, text in items:
            w = np.array([self.ids.setdefault(x, len(self.ids) + 1) for x in words_of(text)], np.int32)
            if len(w):
                rows = np.lib.stride_tricks.sliding_window_view(w, min(window, len(w)))
                found.setdefault(rows.shape[1], []).append((rows, np.full(len(rows), nth[item], np.int64)))
        self.by_length: list[tuple[int, np.ndarray, np.ndarray]] = []
        lengths, first, flat, n = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)], [np.zeros(0, np.int64)], 0
        for size, parts in sorted(found.items()):
            rows, item = np.ascontiguousarray(np.concatenate([r for r, _ in parts])), np.concatenate([i for _, i in parts])
            _, at, back = np.unique(rows.view(np.dtype((np.void, rows.itemsize * size))).ravel(), return_index=True, return_inverse=True)
            pairs = np.unique(back[item >= 0] * (len(self.names) + 1) + item[item >= 0])
            first.append(np.cumsum(np.bincount(pairs // (len(self.names) + 1), minlength=len(at))) + first[-1][-1])
            flat.append(pairs % (len(self.names) + 1))
            lengths.append(np.full(len(at), size, np.int64))
            self.by_length.append((size, rows[at], np.arange(n, n + len(at))))
            n += len(at)
        self.lengths, self.first, self.flat = np.concatenate(lengths), np.concatenate(first), np.concatenate(flat)
        self.bits = max(1, len(self.ids).bit_length())

    def packed(self) -> dict:
        """Plain data, which an executor can read without this package."""
        return {**{k: v for k, v in vars(self).items() if k != "ids"}, "ids": b" ".join(self.ids)}

    @classmethod
    def unpack(cls, packed: dict) -> Phrases:
        out = cls.__new__(cls)
        vars(out).update(packed, ids={w: k + 1 for k, w in enumerate(packed["ids"].split())})
        return out


def suffix_array(s: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes of ``s`` in order; zeros are boundaries, all distinct and ordered by place."""
    n = len(s)
    assert n < 1 << 21, "a group and two places must fit into 63 bits"
    place_bits = max(1, int(n).bit_length())
    depth = max(1, (63 - place_bits) // bits)
    place = np.arange(n, dtype=np.int64)
    key, open_ = np.zeros(n, np.int64), np.ones(n, bool)
    padded = np.concatenate([s, np.zeros(depth, s.dtype)])
    for k in range(depth):
        sym = padded[k : k + n] * open_
        key = (key << bits) | sym
        open_ &= sym != 0
    order = np.sort((key << place_bits) | place)
    sa, key = order & ((1 << place_bits) - 1), order >> place_bits
    rank = np.empty(n + 1, np.int64)
    rank[n] = 0
    rank[sa] = place
    # groups of equal keys without a boundary are still tied
    new = np.ones(n, bool)
    new[1:] = key[1:] != key[:-1]
    tied = open_[sa] & ~(new & np.append(new[1:], True))
    idx = np.flatnonzero(tied)
    group = np.maximum.accumulate(np.where(new, place, 0))[idx]
    rank[sa[idx]] = group
    h = depth
    while len(idx):
        at = sa[idx]
        second = rank[np.minimum(at + h, n)]
        order = np.sort(((group << place_bits | second) << place_bits) | at)
        at, pair = order & ((1 << place_bits) - 1), order >> place_bits
        sa[idx] = at
        new = np.ones(len(idx), bool)
        new[1:] = pair[1:] != pair[:-1]
        group = idx[np.maximum.accumulate(np.where(new, np.arange(len(idx)), 0))]
        rank[at] = group
        tied = ~(new & np.append(new[1:], True))
        idx, group = idx[tied], group[tied]
        h *= 2
    return sa


class Wavelet:
    """Wavelet matrix: ranks of symbols before a place, and the symbol at a place, in one step a bit."""

    def __init__(self, s: np.ndarray, bits: int):
        self.levels, self.bits = [], bits
        for b in range(bits - 1, -1, -1):
            bit = (s >> b) & 1
            ones = np.zeros(len(s) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((b, ones, len(s) - int(ones[-1])))
            mask = bit.astype(bool)
            s = np.concatenate([s[~mask], s[mask]])
        self.start = self._down(np.arange(1 << bits), np.zeros(1 << bits, np.int64))

    def _down(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for b, ones, zeros in self.levels:
            o = ones[i]
            i = np.where((c >> b) & 1, zeros + o, i - o)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        return self._down(c, i) - self.start[c]

    def back(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at ``i`` and how many of it stand before."""
        c = np.zeros(len(i), np.int64)
        for _, ones, zeros in self.levels:
            o = ones[i]
            bit = ones[i + 1] - o
            c = c << 1 | bit
            i = np.where(bit, zeros + o, i - o)
        return c, i - self.start[c]


class FMIndex:
    def __init__(self, s: np.ndarray, bits: int, every: int = SAMPLE_EVERY):
        sa = suffix_array(s, bits)
        bwt = np.where(sa > 0, s[sa - 1], 0)
        self.n, self.wavelet = len(s), Wavelet(bwt, bits)
        self.before = np.concatenate([[0], np.cumsum(np.bincount(s, minlength=1 << bits))])
        self.kept = (sa % every == 0) | (bwt == 0)
        self.nth = np.cumsum(self.kept)
        self.sample = sa[self.kept]

    def search(self, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the rows of ``w`` that occur: their numbers, and the range of suffixes that begin with each."""
        q, lo, hi = np.arange(len(w)), np.zeros(len(w), np.int64), np.full(len(w), self.n, np.int64)
        for j in range(w.shape[1] - 1, -1, -1):
            c = w[q, j]
            lo, hi = self.before[c] + self.wavelet.rank(c, lo), self.before[c] + self.wavelet.rank(c, hi)
            live = hi > lo
            q, lo, hi = q[live], lo[live], hi[live]
        return q, lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        out, todo, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        while len(todo):
            hit = self.kept[rows]
            out[todo[hit]] = self.sample[self.nth[rows[hit]] - 1] + steps
            todo, rows = todo[~hit], rows[~hit]
            if len(todo):
                c, before = self.wavelet.back(rows)
                rows = self.before[c] + before
            steps += 1
        return out


def scan(texts: list[str | None], phrases: Phrases, most: int = SHARD_WORDS) -> tuple[np.ndarray, list[tuple[int, np.ndarray, list]]]:
    """Words of each text, and for each text with an occurrence: its number, hit words (mask), items.

    Texts that follow each other share an index as long as they have no more than ``most`` words together.
    """
    get, n_words, out, held, size = phrases.ids.get, [], [], [], 0
    for t in texts:
        w = words_of(t)
        if held and size + len(w) > most:
            out += _scan(held, len(n_words) - len(held), phrases)
            held, size = [], 0
        held.append(np.fromiter((get(x, 0) for x in w), np.int64, len(w)))
        size += len(w)
        n_words.append(len(w))
    return np.array(n_words, np.int64), out + _scan(held, len(n_words) - len(held), phrases)


def _scan(parts: list[np.ndarray], number: int, phrases: Phrases) -> list[tuple[int, np.ndarray, list]]:
    """The occurrences in one index over the word codes of texts, numbered from ``number`` on."""
    ends = np.cumsum([len(c) for c in parts]).tolist()
    total = ends[-1] if ends else 0
    if not total or not len(phrases.lengths):
        return []
    code = np.concatenate(parts)
    starts = np.array([0, *ends[:-1]], np.int64)
    brk = code == 0
    first = np.zeros(total + 1, bool)
    first[starts] = True
    first = first[:total]
    keep = np.flatnonzero(~brk)
    if not len(keep):
        return []
    # a boundary before a kept word that begins a text or follows a word left out
    gap = np.ones(len(keep), bool)
    gap[1:] = keep[1:] != keep[:-1] + 1
    gap |= first[keep]
    shift = np.cumsum(gap)
    s = np.zeros(len(keep) + int(shift[-1]) + 1, np.int64)
    at = np.arange(len(keep)) + shift
    s[at] = code[keep]
    word_at = np.full(len(s), -1, np.int64)
    word_at[at] = keep
    index = FMIndex(s, phrases.bits)
    where, which = [], []
    for _, rows, numbers in phrases.by_length:
        q, lo, hi = index.search(rows)
        if len(q):
            size = hi - lo
            flat = np.repeat(lo - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(int(size.sum()))
            where.append(word_at[index.locate(flat)])
            which.append(np.repeat(numbers[q], size))
    if not where:
        return []
    where, which = np.concatenate(where), np.concatenate(which)
    diff = np.bincount(where, minlength=total + 1) - np.bincount(where + phrases.lengths[which], minlength=total + 1)
    hit = np.cumsum(diff)[:total] > 0
    doc = np.searchsorted(np.array(ends), where, side="right")
    pairs = np.unique(doc * len(phrases.lengths) + which)
    doc, which = pairs // len(phrases.lengths), pairs % len(phrases.lengths)
    out, cut = [], np.flatnonzero(np.diff(doc, prepend=-1))
    for i, j in zip(cut, [*cut[1:], len(doc)]):
        d = int(doc[i])
        own = {int(k) for x in which[i:j] for k in phrases.flat[phrases.first[x] : phrases.first[x + 1]]}
        out.append((number + d, hit[starts[d] : ends[d]], [phrases.names[k] for k in sorted(own)]))
    return out


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """Half-open runs of true words: overlapping and adjoining occurrences as one."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``spans``; a line end stands where a span was."""
    place = [m.span() for m in _WORD.finditer(text.translate(_UPPER))]
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : place[a][0]])
        last = place[b - 1][1]
    return "\n".join([*out, text[last:]])


RESULT = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()), T.StructField("items", T.ArrayType(T.LongType())), T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))), T.StructField("clean_text", T.StringType())])


def _pieces(text: str | None, most: int, window: int) -> list[tuple[int, str | None]]:
    """A text of more than ``most`` words as overlapping pieces, so that no shard outgrows its bound."""
    if text is None or len(text) <= most:
        return [(0, text)]
    w = _WORD.findall(text.translate(_UPPER))
    return [(i, " ".join(w[i : i + most])) for i in range(0, max(1, len(w) - window + 1), most - window + 1)]


def leaks(texts: list[str | None], blocks: Iterable[Phrases], window: int = WINDOW, most: int = SHARD_WORDS) -> list[tuple[int, int, list, list]]:
    """(words, hit words, items, spans) of each text, over all blocks of phrases."""
    pieces = [(k, i, t) for k, text in enumerate(texts) for i, t in _pieces(text, most, window)]
    n, masks, items = [0] * len(texts), {}, {}
    for phrases in blocks:
        n_words, found = scan([t for _, _, t in pieces], phrases, most)
        for (k, i, _), w in zip(pieces, n_words.tolist()):
            n[k] = max(n[k], i + w)
        for p, mask, own in found:
            k, i, _ = pieces[p]
            m = masks.setdefault(k, np.zeros(n[k], bool))
            m[i : i + len(mask)] |= mask
            items.setdefault(k, set()).update(own)
    return [(n[k], int(masks[k].sum()), sorted(items[k]), runs(masks[k])) if k in masks else (n[k], 0, [], []) for k in range(len(texts))]


def rewritten(texts: list[str | None], spans: list[list], blocks: Iterable[Phrases], window: int = WINDOW, most: int = SHARD_WORDS) -> list[str | None]:
    """The texts without their spans, cut until no block finds anything: words that a cut brings together may form a phrase
    anew. Texts that are clean leave the rounds."""
    out, todo = list(texts), [(k, s) for k, s in enumerate(spans) if s]
    while todo:
        for k, s in todo:
            out[k] = cut(out[k], s)
        again = leaks([out[k] for k, _ in todo], blocks, window, most)
        todo = [(k, s) for (k, _), (_, _, _, s) in zip(todo, again) if s]
    return out


def item_pieces(benchmark: DataFrame, window: int, words: int = PIECE_WORDS) -> DataFrame:
    """(item_id, text) with long items cut into pieces that overlap by all but one word of a window: the same windows."""
    w = F.regexp_extract_all(ascii_lower(F.col("text")), F.lit(_WORD.pattern), F.lit(0))
    b = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), w.alias("w"))
    starts = F.sequence(F.lit(0), F.greatest(F.size("w") - window, F.lit(0)), F.lit(words))
    piece = F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, F.lit(words + window - 1)), " "))
    return b.select("item_id", F.explode(piece).alias("text"))


def phrase_blocks(benchmark: DataFrame, window: int = WINDOW, block_bytes: int | None = None) -> list:
    """Broadcasts of all windows of ``benchmark(item_id, text)``, in blocks: the driver holds one at a time."""
    context = benchmark.sparkSession.sparkContext
    out, held, size = [], [], 0
    for r in item_pieces(benchmark, window).toLocalIterator():
        held.append((r[0], r[1]))
        size += len(r[1].encode())
        if size >= (block_bytes or BLOCK_BYTES):
            out.append(context.broadcast(Phrases(held, window).packed()))
            held, size = [], 0
    return [*out, context.broadcast(Phrases(held, window).packed())] if held or not out else out


class Blocks:
    """The broadcast blocks, each read anew from the executor's copy where there are several, so that one is held at a time."""

    def __init__(self, sent: list):
        self.sent = sent

    def __iter__(self):  # noqa: ANN204
        if len(self.sent) == 1 and hasattr(self, "only"):
            yield self.only
            return
        for b in self.sent:
            p = Phrases.unpack(b.value)
            if len(self.sent) == 1:
                self.only = p
            else:
                b.__dict__.pop("_value", None)
            yield p


def find_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text", window: int = WINDOW, rewrite: bool = False, keep_text: bool = True) -> DataFrame:
    """``docs`` with a struct column ``leak``: n_words, n_hit, items (ids of items with an occurring window, sorted),
    spans ([first word, one past the last], merged) and, with ``rewrite``, clean_text (the text without the spans).

    A null or wordless text has no words and no hit; a null item text no windows; an item without an id marks words
    but is not listed; rows that repeat are judged each; a column called ``leak`` is replaced, all others stay as they are; an empty
    table gives an empty table. Texts and test sets of any size are taken whole: long texts in overlapping pieces, test sets in blocks,
    all in one pass over the corpus without a shuffle.
    """
    docs = docs.drop("leak")
    sent = phrase_blocks(benchmark.select("item_id", "text"), window)
    kept = [c for c in docs.columns if keep_text or c != text]
    schema = T.StructType([*(docs.schema[c] for c in kept), T.StructField("leak", RESULT)])
    leak_type = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", pa.list_(pa.list_(pa.int64()))), ("clean_text", pa.string())])

    def run(batches):  # noqa: ANN001
        blocks, held, size = Blocks(sent), [], 0

        def flush():
            t = pa.Table.from_batches(held).combine_chunks()
            texts = t.column(text).to_pylist()
            found = leaks(texts, blocks, window)
            clean = rewritten(texts, [s for *_, s in found], blocks, window) if rewrite else [None] * len(texts)
            rows = [{"n_words": n, "n_hit": h, "items": items, "spans": spans, "clean_text": c} for (n, h, items, spans), c in zip(found, clean)]
            yield from t.select(kept).append_column("leak", pa.array(rows, leak_type)).to_batches()

        for batch in batches:
            step = max(1, batch.num_rows * (SHARD_WORDS * 5) // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                piece = batch.slice(i, step)
                held.append(piece)
                size += piece.nbytes
                if size >= SHARD_WORDS * 5:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return docs.mapInArrow(run, schema)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"), keep_text=False)
    names = F.array_sort(F.transform("leak.items", lambda x: x.cast("string")))
    return found.select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        F.col("leak.n_hit").alias("n_hit"),
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (F.col("leak.n_hit") > 0).alias("contaminated"),
    )


_W = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_W}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '{_W}') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, w[i:i + least({WINDOW}, len(w)) - 1] AS g FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - {WINDOW - 1}) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT len(g) AS n FROM win),
dw AS (SELECT doc_id, i, n, w[i:i + n - 1] AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
occ AS (SELECT doc_id, i, n, item_id FROM dw JOIN win USING (g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM occ) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM occ) GROUP BY 1)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
 sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
