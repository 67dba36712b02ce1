"""SimHash near-duplicates by tiled exact comparison.

Distinct fingerprints are laid into tiles by the population counts of their four 16-bit quarters; a large tile is
split by hash. Two fingerprints within ``RADIUS`` bits have counts that differ by ``RADIUS`` in sum at most, so
tile pairs beyond that are never formed. The others are compared whole, by exclusive-or and bit counts, in strips.
Of the links in a tile pair only as many are handed on as it takes to connect what they connect, so a large group
of near copies doesn't give all its pairs. Components are then found by joins over the distinct fingerprints.

A text of fewer words than a shingle is one shingle; NULL and empty texts have fingerprint 0 and link like others.
Repeated rows get equal results. ``component_id`` is the least id in the component, NULL if all its ids are NULL.
Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import cut, doc_key, per_batch
from tillbook.llm.components import components, labels

SHINGLE = 3
RADIUS = 2
SEED = 42
QUARTERS = 4
#: Fingerprints in a tile: two make a comparison of 4 million pairs.
TILE = 2048
#: Pairs compared at once.
STRIP = 1 << 18


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The signed 64-bit integer with the fingerprint's bits."""
    words = (text or "").encode().lower().split()  # both for ASCII only
    if not words:
        return 0
    joined = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else [
        b" ".join(words)]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, joined, repeat(SEED)), np.uint64)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
    return int(np.packbits(2 * bits.sum(0, dtype=np.int64) > len(hashes)).view(np.int64)[0])


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(k, doc_id, fp), one row per input row."""
    def fn(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = [fingerprint(t, shingle) for t in batch.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("k"), batch.column("doc_id"), pa.array(fps, pa.int64())],
                                          ["k", "doc_id", "fp"])

    return per_batch(docs.select(doc_key(F.col(id_col), F.col(text_col)).alias("k"),
                                 F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")),
                     fn, "k string, doc_id long, fp long")


def tiles(fps: DataFrame) -> DataFrame:
    """(c0, ..., part, fps): distinct fingerprints by the counts of their quarters, about ``TILE`` in each."""
    counts = [F.bit_count(F.shiftright("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).alias(f"c{i}") for i in range(QUARTERS)]
    by = [f"c{i}" for i in range(QUARTERS)]
    placed = fps.select("fp", *counts)
    sizes = placed.groupBy(*by).agg(F.ceil(F.count("*") / TILE).alias("parts"))  # 17**4 rows at most
    return (placed.join(sizes, by).withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")))
            .groupBy(*by, "part").agg(F.collect_list("fp").alias("fps")))


def near_tiles(grid: DataFrame, radius: int) -> DataFrame:
    """Pairs of tiles (a, b: their fingerprints) whose counts differ by ``radius`` in sum at most, each pair once."""
    steps = [d for d in product(range(-radius, radius + 1), repeat=QUARTERS)
             if sum(map(abs, d)) <= radius and d >= (0,) * QUARTERS]
    step = F.explode(F.array(*(F.array(*map(F.lit, d)) for d in steps)))
    same = F.lit(True)
    for i in range(QUARTERS):
        same = same & (F.col("d")[i] == 0)
    left = grid.select(*(f"c{i}" for i in range(QUARTERS)), F.col("part").alias("pa"), F.col("fps").alias("a"), step.alias("d"))
    left = left.select(*((F.col(f"c{i}") + F.col("d")[i]).alias(f"c{i}") for i in range(QUARTERS)), "pa", "a", same.alias("own"))
    right = grid.select(*(f"c{i}" for i in range(QUARTERS)), F.col("part").alias("pb"), F.col("fps").alias("b"))
    return left.join(right, [f"c{i}" for i in range(QUARTERS)]).where("not own or pa <= pb").select("a", "b")


def compare(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within ``radius`` bits connect: each fingerprint with its group's first."""
    both = np.concatenate([a, b])
    label = np.arange(len(both))
    rows = max(1, STRIP // len(b))
    for at in range(0, len(a), rows):
        differing = np.bitwise_count((a[at: at + rows, None] ^ b[None, :]).view(np.uint64))  # signed: of the absolute value
        i, j = np.nonzero(differing <= radius)
        label = labels(len(both), i + at, j + len(a), label)
    moved = np.flatnonzero(label != np.arange(len(both)))
    return both[moved], both[label[moved]]


def near_links(grid: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): pairs of fingerprints that connect all that lie within ``radius`` bits of one another."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("a"), batch.column("b")
            found = [compare(left[i].values.to_numpy(), right[i].values.to_numpy(), radius) for i in range(batch.num_rows)]
            if found:
                a, b = (np.concatenate(x) for x in zip(*found, strict=True))
                apart = a != b
                yield pa.RecordBatch.from_arrays([pa.array(a[apart]), pa.array(b[apart])], ["a", "b"])

    return near_tiles(grid, radius).mapInArrow(run, "a long, b long")


def simhash_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                   radius: int = RADIUS) -> DataFrame:
    """One row per input row: k (see ``doc_key``), doc_id, fp (signed 64-bit), root (the component's least), component_id."""
    found = cut(fingerprints(docs, id_col, text_col, shingle), "fingerprints")
    distinct = found.groupBy("fp").agg(F.min("doc_id").alias("least"))
    grid = cut(tiles(distinct.select("fp")), "tiles")
    roots = components(near_links(grid, radius)).withColumnRenamed("node", "fp")
    placed = distinct.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = placed.join(least, "root").select("fp", "root", "component_id")
    return found.join(groups, "fp").select("k", "doc_id", "fp", "root", "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                radius: int = RADIUS) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the least id (a NULL id is the largest).

    Of rows that agree in id and text one stays. They are brought down to one in each task first.
    """
    found = simhash_groups(docs, id_col, text_col, shingle, radius)
    stay = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "k")).alias("x")).select("x.k")
    rows = docs.select(doc_key(F.col(id_col), F.col(text_col)).alias("k"), F.struct(*docs.columns).alias("row"))
    return rows.dropDuplicates(["k"]).join(stay, "k", "left_semi").select("row.*")


def hex_digits(fp: Column) -> Column:
    """16 lower-case hexadecimal digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
