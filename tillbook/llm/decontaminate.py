"""Benchmark decontamination by winnowing.

Of the hashes of all ``GRAM``-word sequences, the least in each run of ``WINDOW - GRAM + 1`` consecutive ones is
kept, in documents and items alike, so any ``WINDOW`` words that both share hold a gram kept on both sides. The
kept grams are joined; around each hit the words are compared outwards, which gives the shared span, and spans
of ``WINDOW`` words or more count. An item of fewer words is one window of its own: all sequences of its length
are looked up. Words are compared as text, so hash collisions have no effect.

Before the join a fixed-size sieve of the items' gram hashes drops nearly all document grams; what passes is one
row per distinct gram with its surroundings and document, and the join is made between the distinct surroundings
of both sides, so a passage that many documents share meets the items once.

NULL and empty texts have no words: no hits, not contaminated. An item without words has no windows. Rows that
agree in id and text are one document and get one result each; items that share an id are one item. An empty
benchmark contaminates nothing. Extra columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import cut, doc_key, in_sieve, mix, per_batch, sieve, utf8

WINDOW = 13
GRAM = 9
SIDE = WINDOW - GRAM
#: A document is contaminated if at least one word in so many is hit.
SHARE = 20

#: Lower case for A-Z; 0 for bytes that are no part of a word (words: digits, letters, all beyond ASCII).
_BYTE = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)):
    _BYTE[_b] = _b
for _b in range(0x41, 0x5B):
    _BYTE[_b] = _b + 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_LONG_WORD = 48


class Words:
    """The words of a batch of texts: byte ranges, row numbers and 64-bit hashes."""

    def __init__(self, col: pa.Array):
        raw, off = utf8(col)
        self.data = _BYTE[raw]
        inside = self.data != 0
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        firsts, lasts = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
        begins[firsts], ends[lasts] = inside[firsts], inside[lasts]  # words end where texts do
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.row = np.searchsorted(off, self.start, "right") - 1
        self.hash = self.hashes()
        self.first = np.searchsorted(self.row, np.arange(len(col) + 1))  # of each row's words

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word's bytes, all words a byte further at a time."""
        sizes = self.end - self.start
        out = sizes.astype(np.uint64)
        live = np.arange(len(sizes))
        for j in range(_LONG_WORD):
            live = live[sizes[live] > j]
            if not len(live):
                break
            out[live] = out[live] * _BASE + self.data[self.start[live] + j]
        for i in np.flatnonzero(sizes > _LONG_WORD).tolist():
            out[i] = xxhash.xxh64_intdigest(self.data[self.start[i]: self.end[i]].tobytes())
        return mix(out)

    def grams(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the ``size`` words that begin at each word, and whether they are of one row."""
        n = max(0, len(self.start) - size + 1)
        out = np.full(n, size, np.uint64)
        for j in range(size):
            out = out * _BASE + self.hash[j: j + n]
        return mix(out), self.row[:n] == self.row[size - 1: size - 1 + n]

    def text(self, a: int, b: int) -> str:
        return " ".join(bytes(self.data[s:e]).decode() for s, e in zip(self.start[a:b], self.end[a:b], strict=True))


def winnow(words: Words, gram: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(position, hash) of the kept grams: the least of each run (the last of equals), runs within one row."""
    hashes, whole = words.grams(gram)
    run = window - gram + 1
    n = max(0, len(hashes) - run + 1)
    at = np.arange(n)
    best, low = at.copy(), hashes[:n].copy()
    for j in range(1, run):
        here = hashes[j: j + n]
        less = here <= low
        best[less], low[less] = at[less] + j, here[less]
    whole = words.row[:n] == words.row[window - 1: window - 1 + n]
    kept = np.unique(best[whole])
    return kept, hashes[kept]


def contexts(words: Words, pos: np.ndarray, hashes: np.ndarray, size: int, need: int) -> list[tuple]:
    """(row, need, hash, left words, gram, right words, word numbers in the row): one per distinct gram in context.

    ``need``: the words a span must have. The gram has ``size`` of them, up to ``need - size`` stand on each side.
    """
    found: dict[tuple, list[int]] = {}
    side = need - size
    for p, h in zip(pos.tolist(), hashes.view(np.int64).tolist(), strict=True):
        row = int(words.row[p])
        a, b = int(words.first[row]), int(words.first[row + 1])
        left, right = words.text(max(a, p - side), p), words.text(p + size, min(b, p + size + side))
        found.setdefault((row, need, h, left, words.text(p, p + size), right), []).append(p - a)
    return [(*k, v) for k, v in found.items()]


_CONTEXT = ["need", "h", "l", "gram", "r"]
_KINDS = "need int, h long, l string, gram string, r string"


def item_contexts(items: DataFrame) -> DataFrame:
    """(item_id, need, h, l, gram, r): the kept grams of long items, and short items whole."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words, ids = Words(batch.column("text")), batch.column("item_id").to_pylist()
        out = contexts(words, *winnow(words), GRAM, WINDOW)
        for i in range(len(ids)):
            a, n = int(words.first[i]), int(words.first[i + 1] - words.first[i])
            if 0 < n < WINDOW:
                out += contexts(words, np.array([a]), words.grams(n)[0][a: a + 1], n, n)
        cols = list(zip(*out, strict=True)) or [()] * 7
        return pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in cols[0]], pa.string()), pa.array(cols[1], pa.int32()),
             pa.array(cols[2], pa.int64()), *(pa.array(c, pa.string()) for c in cols[3:6])], ["item_id", *_CONTEXT])

    return per_batch(items, fn, f"item_id string, {_KINDS}").distinct()


def doc_contexts(docs: DataFrame, bits: np.ndarray, short: list[int]) -> DataFrame:
    """One row per document (h NULL, n_words) and one per kept gram in its context that the sieve lets pass."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = Words(batch.column("text"))
        pos, hashes = winnow(words)
        keep = in_sieve(shared.value, hashes)
        out = contexts(words, pos[keep], hashes[keep], GRAM, WINDOW)
        for size in short:
            hashes, whole = words.grams(size)
            pos = np.flatnonzero(whole & in_sieve(shared.value, hashes))
            out += contexts(words, pos, hashes[pos], size, size)
        n = batch.num_rows
        cols = list(zip(*out, strict=True)) or [()] * 7
        rows = pa.array([*range(n), *cols[0]], pa.int64())
        none = [None] * n
        return pa.RecordBatch.from_arrays(
            [batch.column("k").take(rows), batch.column("doc_id").take(rows),
             pa.array([*np.diff(words.first).tolist(), *[None] * len(out)], pa.int64()),
             pa.array([*none, *cols[1]], pa.int32()), pa.array([*none, *cols[2]], pa.int64()),
             *(pa.array([*none, *c], pa.string()) for c in cols[3:6]),
             pa.array([*none, *cols[6]], pa.list_(pa.int32()))], ["k", "doc_id", "n_words", *_CONTEXT, "pos"])

    return per_batch(docs, fn, f"k string, doc_id long, n_words long, {_KINDS}, pos array<int>")


def shared_words(a: str, b: str, backwards: bool) -> Column:
    """How many words two strings of words share, from their beginning or from their end."""
    def words(name: str) -> Column:
        out = F.filter(F.split(F.col(name), " "), lambda w: w != "")
        return F.reverse(out) if backwards else out

    same = [(F.size(words(a)) >= i) & (F.size(words(b)) >= i) & (F.slice(words(a), 1, i) == F.slice(words(b), 1, i))
            for i in range(1, SIDE + 1)]
    return F.greatest(F.lit(0), *(F.when(c, F.lit(i + 1)).otherwise(0) for i, c in enumerate(same)))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per input row: k (see ``doc_key``), doc_id, n_words, n_hit, spans, items, contaminated.

    spans: (first, last) word numbers from 0, last exclusive, that hold windows of items, in order, they may
    overlap; n_hit: the words in them; items: the ids, as sorted strings, of the items with windows there.
    """
    bench = cut(item_contexts(items.select(F.col(item_col).cast("string").alias("item_id"),
                                           F.col(item_text_col).alias("text"))), "benchmark-grams")
    short = [r.need for r in bench.where(F.col("need") < WINDOW).select("need").distinct().collect()]  # 12 at most
    found = cut(doc_contexts(docs.select(
        doc_key(F.col(id_col), F.col(text_col)).alias("k"), F.col(id_col).cast("long").alias("doc_id"),
        F.col(text_col).alias("text")), sieve(bench, "h"), sorted(short)), "document-grams")
    hits = found.where("h is not null").select("k", *_CONTEXT, "pos")

    theirs = bench.select("need", "h", "gram", F.col("l").alias("bl"), F.col("r").alias("br"))
    long = F.col("need") == WINDOW
    size = F.when(long, F.lit(GRAM)).otherwise(F.col("need"))
    # the join is between distinct surroundings; then each side's meaning is joined to the pairs that count
    pairs = (hits.select(*_CONTEXT).distinct().join(theirs.distinct(), ["need", "h", "gram"])
             .withColumn("a", F.when(long, shared_words("l", "bl", True)).otherwise(0))
             .withColumn("b", size + F.when(long, shared_words("r", "br", False)).otherwise(0))
             .where(F.col("a") + F.col("b") >= F.col("need")))
    meant = (pairs.join(bench.select("item_id", "need", "h", "gram", F.col("l").alias("bl"), F.col("r").alias("br")),
                        ["need", "h", "gram", "bl", "br"])
             .groupBy(*_CONTEXT).agg(F.collect_set(F.struct("a", "b")).alias("reach"),
                                     F.collect_set("item_id").alias("ids")))
    spans = F.flatten(F.transform("pos", lambda p: F.transform(
        "reach", lambda x: F.struct((p - x.a).alias("first"), (p + x.b).alias("last")))))
    each = (hits.join(meant, _CONTEXT).select("k", spans.alias("spans"), "ids")
            .groupBy("k").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("spans")))).alias("spans"),
                              F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items")))
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda acc, x: F.struct((acc.n + F.greatest(F.lit(0), x.last - F.greatest(x.first, acc.upto))).alias("n"),
                                F.greatest(acc.upto, x.last).alias("upto")), lambda acc: acc.n.cast("long"))
    out = (found.where("h is null").select("k", "doc_id", "n_words").join(each, "k", "left")
           .withColumn("n_hit", F.coalesce(covered, F.lit(0).cast("long"))))
    empty = F.array().cast("array<string>")
    return out.select("k", "doc_id", "n_words", "n_hit", "spans", F.coalesce("items", empty).alias("items"),
                      ((F.col("n_hit") > 0) & (SHARE * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"))
