"""Substring deduplication by content-defined chunking.

A gear hash rolls over the UTF-8 bytes: shifted by one bit a byte, so it depends on the last ``REACH`` bytes only.
A chunk ends where its upper bits are zero, at the start of a character, no sooner than ``SHORTEST`` and no later
than ``LONGEST`` bytes after its beginning. An insertion moves the chunks near it; later ones fall in step again.

Chunks are deduplicated by a 128-bit digest. The document with the least id keeps a chunk, at its first place;
elsewhere it is a repeat. Repeats in a row that come to ``LEAST_RUN`` bytes or more are cut out of the text;
shorter ones stay, as some words in common are no copied passage.

The digests are counted with partial sums before the shuffle, and joined back as a skewed join key would be, so a
chunk that a third of the documents share is never gathered.

NULL and empty texts have no chunks. Rows that agree in id and text are one document; NULL ids are larger than all
others. Different documents that share an id, or have none, are in the order of a hash of ``doc_key``. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import cut, doc_key, pieces, utf8

REACH = 16
#: Upper bits of the hash that are zero at a cut: one byte in 32.
MASK = np.uint16(0xF800)
SHORTEST = 24
LONGEST = 256
LEAST_RUN = 96
LAST_ID = (1 << 63) - 1


def gear_table(seed: int = 7) -> np.ndarray:
    """A fixed random 16-bit value for each byte."""
    return np.frombuffer(hashlib.shake_128(seed.to_bytes(4, "little")).digest(512), "<u2").copy()


GEAR = gear_table()


def candidates(data: np.ndarray) -> np.ndarray:
    """Positions where a chunk may end (the next one would begin there), over bytes laid end to end."""
    h = GEAR[data]
    step = 1
    while step < REACH:  # sums of 1, 2, 4, ... bytes, each byte shifted by its distance
        h[step:] += h[:-step].copy() << np.uint16(step)
        step *= 2
    at = np.flatnonzero((h & MASK) == 0) + 1
    at = at[at < len(data)]
    return at[(data[at] & 0xC0) != 0x80]


def bounds(data: np.ndarray, cand: np.ndarray) -> list[int]:
    """Beginnings of a document's chunks and its end; ``cand`` are candidates counted from its beginning."""
    n = len(data)
    out, begin, i, cand = [0], 0, 0, cand.tolist()
    while n - begin > SHORTEST:
        while i < len(cand) and cand[i] < begin + SHORTEST:
            i += 1
        end = min(cand[i] if i < len(cand) else n, begin + LONGEST, n)
        while end < n and data[end] & 0xC0 == 0x80:  # a forced end goes back to the start of a character
            end -= 1
        out.append(end)
        begin = end
    if begin < n:
        out.append(n)
    return out


def chunk_documents(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(u, k, id, bounds, digests, firsts): one row per non-empty document; u is unique.

    digests: 16 bytes a chunk, of the chunks that are the first of their kind in the document; firsts: their numbers.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = TaskContext.get().partitionId() << 33
        for batch in batches:
            for piece in pieces(batch):
                data, off = utf8(piece.column("text"))
                at = candidates(data)
                raw = data.tobytes()
                rows, ends, digests, firsts = [], [], [], []
                for i in range(piece.num_rows):
                    a, b = int(off[i]), int(off[i + 1])
                    if a == b:
                        continue
                    here = at[np.searchsorted(at, a + REACH): np.searchsorted(at, b)] - a
                    edge = bounds(data[a:b], here)
                    seen: dict[bytes, int] = {}
                    for j in range(len(edge) - 1):
                        seen.setdefault(hashlib.blake2b(raw[a + edge[j]: a + edge[j + 1]], digest_size=16).digest(), j)
                    rows.append(i)
                    ends.append(edge)
                    digests.append(b"".join(seen))
                    firsts.append(list(seen.values()))
                take = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(range(u, u + len(rows)), pa.int64()), piece.column("k").take(take), piece.column("id").take(take),
                     pa.array(ends, pa.list_(pa.int32())), pa.array(digests, pa.binary()), pa.array(firsts, pa.list_(pa.int32()))],
                    ["u", "k", "id", "bounds", "digests", "firsts"])
                u += len(rows)

    text = F.col(text_col)
    rows = docs.select(doc_key(F.col(id_col), text).alias("k"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("id"),
                       text.alias("text"))
    return rows.mapInArrow(run, "u long, k string, id long, bounds array<int>, digests binary, firsts array<int>")


def repeats(chunked: DataFrame) -> DataFrame:
    """(u, elsewhere): the numbers of a document's chunks that a lesser document holds, by (id, hash of ``doc_key``).

    The hash is carried for documents of a shared id only.
    """
    def half(first: int):
        digest = F.substring("digests", F.col("i") * 16 + first, F.lit(8))
        return F.conv(F.hex(digest), 16, -10).cast("long")

    def chunks(rows: DataFrame, *more: str) -> DataFrame:
        return (rows.select("u", "id", *more, "digests", F.posexplode("firsts").alias("i", "chunk"))
                .select("u", "id", *more, "chunk", half(1).alias("d1"), half(9).alias("d2")))

    each = chunks(chunked)
    held = each.groupBy("d1", "d2").agg(F.min("id").alias("least"), F.max("id").alias("most")).where("least < most")
    found = each.join(held.select("d1", "d2", "least"), ["d1", "d2"]).where("id > least").select("u", "chunk")
    docs = chunked.withColumn("tie", F.xxhash64("k"))
    shared = cut(docs.groupBy("id").agg(F.min("tie").alias("a"), F.max("tie").alias("b")).where("a < b").select("id"), "shared-ids")
    tied = chunks(docs.join(shared, "id"), "tie")
    first = tied.groupBy("d1", "d2", "id").agg(F.min("tie").alias("least"), F.max("tie").alias("most")).where("least < most")
    more = tied.join(first.select("d1", "d2", "id", "least"), ["d1", "d2", "id"]).where("tie > least").select("u", "chunk")
    return found.union(more).groupBy("u").agg(F.collect_list("chunk").alias("elsewhere"))


def removed_runs(edge: np.ndarray, firsts: np.ndarray, elsewhere: np.ndarray) -> list[tuple[int, int]]:
    """Byte ranges to cut out: runs of repeated chunks of ``LEAST_RUN`` bytes or more."""
    n = len(edge) - 1
    again = np.ones(n + 2, bool)
    again[0] = again[-1] = False
    again[firsts + 1] = False
    again[elsewhere + 1] = True
    turn = np.flatnonzero(again[1:] != again[:-1])
    runs = [(int(edge[a]), int(edge[b])) for a, b in zip(turn[::2], turn[1::2], strict=True)]
    return [(a, b) for a, b in runs if b - a >= LEAST_RUN]


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_bytes, n_chunks, n_removed, n_spans (ranges cut out), kept (the text left)."""
    chunked = cut(chunk_documents(docs, id_col, text_col), "chunks")
    found = (chunked.select("u", "k", "bounds", "firsts").join(repeats(chunked), "u", "left").drop("u")
             .dropDuplicates(["k"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            cols = [batch.column(c) for c in ("text", "bounds", "firsts", "elsewhere")]
            for i, text in enumerate(cols[0].to_pylist()):
                data = (text or "").encode()
                if not data:
                    out.append((0, 0, 0, 0, text))
                    continue
                edge, firsts, elsewhere = (c[i].values.to_numpy().astype(np.int64) if c[i].is_valid else np.zeros(0, np.int64)
                                           for c in cols[1:])
                runs = removed_runs(edge, firsts, elsewhere)
                left = b"".join(data[a:b] for a, b in zip([0, *(r[1] for r in runs)], [*(r[0] for r in runs), len(data)],
                                                          strict=True))
                out.append((len(data), len(edge) - 1, len(data) - len(left), len(runs), left.decode()))
            arrays = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), [pa.int64()] * 4 + [pa.string()], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays],
                                             ["doc_id", "n_bytes", "n_chunks", "n_removed", "n_spans", "kept"])

    rows = docs.select(doc_key(F.col(id_col), F.col(text_col)).alias("k"), F.col(id_col).cast("long").alias("doc_id"),
                       F.col(text_col).alias("text"))
    return rows.join(found, "k", "left").mapInArrow(
        run, "doc_id long, n_bytes long, n_chunks long, n_removed long, n_spans long, kept string")
