"""Exact substring deduplication with a logarithmic family of sparse suffix arrays.

Every ``LENGTH``-byte string that starts in two places is removed in both. Suffixes are sampled: of the hashes of
all ``GRAM``-byte strings the least in each ``LENGTH`` bytes is an anchor, so equal strings of that length have the
same anchor in the same place, and only suffixes at anchors need be indexed.

The index is a family of levels. A batch of documents gets a suffix array: its anchored suffixes, sorted by their
first two bytes and then by a hash of the first ``GRAM``. It is merge-scanned against each level for suffixes that
begin alike, and before the next batch levels of equal size merge, so a suffix is rewritten a logarithmic number
of times. ``SuffixFamily`` can be given further batches.

The suffixes that matched are then compared whole. The windows that share an anchor make a *stretch* of text;
a stretch that occurs twice is repeated throughout. Where different stretches have the same gram (at the edges of
a repeat), up to ``GROUP`` of them are compared with one another around their anchors; the windows of more are each
looked up by a 128-bit digest, so such a group is never gathered. Stretches are counted before they are shuffled
and compared once however often they occur.

NULL and empty texts have no strings. Rows that agree in id and text are two places. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import cut, doc_key, in_sieve, mix, per_batch, sieve, utf8

LENGTH = 200
GRAM = 40
REACH = LENGTH - GRAM + 1
BATCHES = 4
#: Bytes of text handled at once: the hashes and minima of each position take some 60 times as much.
PIECE = 1 << 19
#: Different stretches of one key that are compared with one another in a task.
GROUP = 4096
_BASE = 0x9E3779B97F4A7C15
_UPPER = np.uint64(0xFFFFFFFF00000000)
_BYTE = np.frombuffer(hashlib.shake_128(b"bytes").digest(2048), "<u8").copy()


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """Hash of the ``GRAM`` bytes from each position, by joining strings of half the length."""
    def join(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
        return left[: len(right)] * np.uint64(pow(_BASE, size, 1 << 64)) + right

    need, have, out, size, h = GRAM, 0, None, 1, _BYTE[data]
    while True:
        if need & size:
            out = h if out is None else join(h, out[size:], have) if len(out) > size else out[:0]
            have += size
        if have == need or len(h) <= size:
            return mix(out) if have == need else np.zeros(0, np.uint64)
        h, size = join(h, h[size:], size), 2 * size


def least_in_reach(x: np.ndarray) -> np.ndarray:
    """The least of ``REACH`` consecutive values from each position."""
    size = 1
    while 2 * size <= REACH:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    rest = REACH - size
    return np.minimum(x[:-rest], x[rest:]) if rest else x


def stretches(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first and last window start, anchor, key) of each anchor's run of windows; positions in ``data``.

    key: the first two bytes at the anchor, then 48 bits of the gram's hash.
    """
    n = len(data) - LENGTH + 1
    inside = np.ones(max(n, 0), bool)
    for end in off[1:].tolist():
        inside[max(0, end - LENGTH + 1): end] = False
    p = np.flatnonzero(inside)
    if not len(p):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    hashes = gram_hashes(data)
    least = least_in_reach((hashes & _UPPER) | np.arange(len(hashes), dtype=np.uint64))
    at = (least[p] & ~_UPPER).astype(np.int64)
    turn = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = np.concatenate([[0], turn]), np.concatenate([turn - 1, [len(p) - 1]])
    at = at[first]
    head = (data[at].astype(np.uint64) << np.uint64(56)) | (data[at + 1].astype(np.uint64) << np.uint64(48))
    key = (head | (hashes[at] >> np.uint64(16))).view(np.int64)
    return np.searchsorted(off, p[first], "right") - 1, p[first], p[last], at, key


def digest(data: bytes) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit digest."""
    return tuple(np.frombuffer(hashlib.blake2b(data, digest_size=16).digest(), np.int64).tolist())


def _told(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(x, y, doc_id, text): x and y identify a document by id and text."""
    k = doc_key(F.col(id_col), F.col(text_col))
    return docs.select(F.xxhash64(k).alias("x"), F.xxhash64(F.lit(1), k).alias("y"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))


def suffix_keys(told: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(batch, g): the key of each anchored suffix."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        row, _, _, _, key = stretches(*utf8(batch.column("text")))
        return pa.RecordBatch.from_arrays([batch.column("batch").take(pa.array(row)), pa.array(key)], ["batch", "g"])

    rows = told.select(F.pmod("x", F.lit(batches)).cast("int").alias("batch"), "text")
    return per_batch(rows, fn, "batch int, g long", PIECE)


class SuffixFamily:
    """Levels of suffix arrays (g, n): each suffix key with its number of places, in order."""

    def __init__(self):
        self.levels: list[tuple[int, DataFrame]] = []

    def add(self, batch: DataFrame) -> list[DataFrame]:
        """Takes in a batch (g, n) of distinct keys; returns tables (g) of the keys that now have two places."""
        while len(self.levels) > 1 and self.levels[-1][0] == self.levels[-2][0]:
            (size, a), (_, b) = self.levels.pop(), self.levels.pop()
            both = a.select("g", "n").unionAll(b.select("g", "n")).groupBy("g").agg(F.sum("n").alias("n"))
            self.levels.append((2 * size, cut(both.sortWithinPartitions("g"), "suffix-level")))
        found = [batch.where("n > 1").select("g")]
        found += [batch.select("g").join(level.select("g"), "g") for _, level in self.levels]
        self.levels.append((1, batch))
        return found


def matched_keys(told: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(g): the suffix keys that occur in two places or more, found by adding the batches to a family."""
    arrays = cut(suffix_keys(told, batches).groupBy("batch", "g").agg(F.count("*").alias("n"))
                 .sortWithinPartitions("batch", "g"), "suffix-arrays")
    family, found = SuffixFamily(), []
    for b in range(batches):
        found += family.add(arrays.where(F.col("batch") == b).select("g", "n"))
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return cut(out.distinct(), "suffix-matches")


def matched_stretches(told: DataFrame, bits: np.ndarray) -> DataFrame:
    """(x, y, g, s, first, windows): stretches whose key the sieve lets pass; s: half a digest of the text.

    A stretch is identified by g and s, 128 bits together.
    """
    shared = told.sparkSession.sparkContext.broadcast(bits)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = utf8(batch.column("text"))
        row, first, last, _, key = stretches(data, off)
        keep = np.flatnonzero(in_sieve(shared.value, key.view(np.uint64)))
        row, first, last, key = row[keep], first[keep], last[keep], key[keep]
        raw = data.tobytes()
        s = [digest(raw[a: b + LENGTH])[0] for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        take = pa.array(row)
        return pa.RecordBatch.from_arrays(
            [batch.column("x").take(take), batch.column("y").take(take), pa.array(key), pa.array(s, pa.int64()),
             pa.array((first - off[row]).astype(np.int32)), pa.array((last - first + 1).astype(np.int32))],
            ["x", "y", "g", "s", "first", "windows"])

    return per_batch(told.select("x", "y", "text"), fn, "x long, y long, g long, s long, first int, windows int", PIECE)


def stretch_texts(told: DataFrame, bits: np.ndarray) -> DataFrame:
    """(g, at, stretch): the distinct stretches whose key the sieve lets pass, by batch; at: where the anchor is."""
    shared = told.sparkSession.sparkContext.broadcast(bits)

    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, off = utf8(batch.column("text"))
        _, first, last, at, key = stretches(data, off)
        keep = np.flatnonzero(in_sieve(shared.value, key.view(np.uint64)))
        raw = data.tobytes()
        found = {(g, p - a, raw[a: b + LENGTH]) for g, p, a, b in zip(
            key[keep].tolist(), at[keep].tolist(), first[keep].tolist(), last[keep].tolist(), strict=True)}
        g, at, text = zip(*found, strict=True) if found else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(at, pa.int32()), pa.array(text, pa.binary())],
                                          ["g", "at", "stretch"])

    return per_batch(told.select("text"), fn, "g long, at int, stretch binary", PIECE)


def byte_grid(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The texts as rows of one array, filled up, and their lengths."""
    width = max(1, *map(len, texts))
    grid = np.frombuffer(b"".join(t.ljust(width, b"\0") for t in texts), np.uint8).reshape(len(texts), width)
    return grid, np.array([len(t) for t in texts])


def shared_length(grid: np.ndarray, size: np.ndarray, i: int) -> np.ndarray:
    """How many bytes text ``i`` shares with each text from its beginning."""
    differ = grid != grid[i]
    first = np.where(differ.any(1), differ.argmax(1), grid.shape[1])
    return np.minimum(first, np.minimum(size, size[i]))


def runs_in_group(group: list[tuple[int, bytes]]) -> Iterator[list[tuple[int, int]]]:
    """For each of the stretches (anchor, text) of one key: the runs of its windows that another one has too."""
    right = byte_grid([t[a:] for a, t in group])
    left = byte_grid([t[:a][::-1] for a, t in group])
    for i, (a, _) in enumerate(group):
        back_most = np.minimum(shared_length(*left, i), a)
        back_least = np.maximum(0, LENGTH - shared_length(*right, i))
        good = back_most >= back_least
        good[i] = False
        yield sorted(set(zip((a - back_most[good]).tolist(), (a - back_least[good]).tolist(), strict=True)))


def contested_runs(told: DataFrame, contested: DataFrame) -> DataFrame:
    """(g, s, runs): windows that different stretches of one key have in common, for keys of ``GROUP`` stretches or
    fewer by comparing them with one another around their anchors."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in batches:
            g, s, runs = [], [], []
            for key, group in zip(batch.column("g").to_pylist(), batch.column("group").to_pylist(), strict=True):
                group = [(x["at"], x["stretch"]) for x in group]
                for (_, text), found in zip(group, runs_in_group(group), strict=True):
                    if found:
                        g.append(key)
                        s.append(digest(text)[0])
                        runs.append([{"first": a, "last": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([pa.array(g, pa.int64()), pa.array(s, pa.int64()), pa.array(runs, kind)], ["g", "s", "runs"])

    few = contested.where(F.col("kinds") <= GROUP).select("g")
    groups = (stretch_texts(told, sieve(few, "g")).join(few, "g", "left_semi")
              .groupBy("g").agg(F.collect_set(F.struct("at", "stretch")).alias("group")))
    return groups.mapInArrow(run, "g long, s long, runs array<struct<first int, last int>>")


def contested_windows(told: DataFrame, contested: DataFrame) -> DataFrame | None:
    """The same for keys of more stretches, which are never gathered: each window is looked up by its digest. None without any."""
    many = contested.where(F.col("kinds") > GROUP).select("g")
    if many.isEmpty():
        return None

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 200):
                rows = []
                for g, t in zip(*(batch.column(c).slice(part, 200).to_pylist() for c in ("g", "stretch")), strict=True):
                    mine = digest(t)[0]
                    rows += [(g, mine, i, *digest(t[i: i + LENGTH])) for i in range(len(t) - LENGTH + 1)]
                a = np.array(rows, np.int64).reshape(len(rows), 5)
                yield pa.RecordBatch.from_arrays([pa.array(a[:, i]) if i != 2 else pa.array(a[:, 2].astype(np.int32)) for i in range(5)],
                                                 ["g", "s", "at", "w1", "w2"])

    texts = stretch_texts(told, sieve(many, "g")).join(many, "g", "left_semi").select("g", "stretch").distinct()
    each = cut(texts.mapInArrow(windows, "g long, s long, at int, w1 long, w2 long"), "windows")
    twice = each.groupBy("w1", "w2").agg(F.count("*").alias("n")).where("n > 1").select("w1", "w2")
    return (each.join(twice, ["w1", "w2"]).groupBy("g", "s").agg(F.sort_array(F.collect_list("at")).alias("at"))
            .select("g", "s", runs_of("at").alias("runs")))


def runs_of(numbers: str) -> Column:
    """(first, last) of each run of consecutive numbers in a sorted array."""
    def extend(runs: Column, i: Column) -> Column:
        end = F.element_at(runs, -1)
        longer = F.concat(F.slice(runs, 1, F.size(runs) - 1), F.array(F.struct(end["first"].alias("first"), i.alias("last"))))
        another = F.concat(runs, F.array(F.struct(i.alias("first"), i.alias("last"))))
        return F.when((F.size(runs) > 0) & (end["last"] == i - 1), longer).otherwise(another)

    return F.aggregate(numbers, F.array().cast("array<struct<first int, last int>>"), extend)


def repeated_windows(told: DataFrame, batches: int = BATCHES) -> DataFrame:
    """(x, y, runs): of each document the runs (first, last) of window starts whose window occurs elsewhere too."""
    found = cut(matched_stretches(told, sieve(matched_keys(told, batches), "g")), "stretches")
    kinds = cut(found.groupBy("g", "s").agg(F.count("*").alias("n"), F.max("windows").alias("windows")), "stretch-kinds")
    contested = cut(kinds.groupBy("g").agg(F.count("*").alias("kinds")).where("kinds > 1"), "contested-keys")
    # a stretch that occurs twice is repeated throughout; of the others the windows that another stretch has
    whole = F.array(F.struct(F.lit(0).alias("first"), (F.col("windows") - 1).alias("last")))
    runs = kinds.where("n > 1").select("g", "s", whole.alias("runs")).unionAll(contested_runs(told, contested))
    windows = contested_windows(told, contested)
    runs = runs if windows is None else runs.unionAll(windows)
    shifted = F.transform("runs", lambda r: F.struct((F.col("first") + r["first"]).alias("first"),
                                                     (F.col("first") + r["last"]).alias("last")))
    return (found.join(runs, ["g", "s"]).select("x", "y", shifted.alias("runs")).groupBy("x", "y")
            .agg(F.array_sort(F.flatten(F.collect_set("runs"))).alias("runs")))


def removed(runs: list[dict]) -> list[tuple[int, int]]:
    """The maximal byte ranges that the windows cover."""
    out: list[tuple[int, int]] = []
    for r in runs:
        a, b = r["first"], r["last"] + LENGTH
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES) -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_removed, n_spans (runs removed), kept (the bytes left)."""
    told = _told(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, runs in zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(), strict=True):
                data, gone = (text or "").encode(), removed(runs or [])
                left = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in gone)], [*(a for a, _ in gone), len(data)],
                                                          strict=True))
                out.append((len(data), len(data) - len(left), len(gone), left))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True))],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    rows = told.join(repeated_windows(told, batches), ["x", "y"], "left").select("doc_id", "text", "runs")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
