"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

Targets: the sources in code point order (NULL last) weigh 1, 2, 3, 1, ... and share all words. A target stops at
``MOST`` times its source's words; what is over goes to the others by weight until none is above (``targets``).

Drawing: the documents of a source lie on a tape in an order permuted by digest, and the tape is read from its start
until the target is reached, as often as it takes: whole passes, then the part of one whose documents lie with their
middle before the end. So a source's words miss its target by half a document at most, and no document is taken more
than ``MOST`` times.

Output shards: each tape is cut into blocks of equal words, and its block quota is split among the shards by a tree:
the quotas of a node are a population of blocks, the left half of its shards draws its share of them without
replacement (a multivariate hypergeometric draw), the right half gets the rest. A shard takes its quota of each tape
as disjoint blocks, in an order of the blocks permuted once more, and its draws are shuffled by digest.

The quotas on the driver are bounded: ``TAPES`` tapes at most (neighbouring sources share one if there are more
sources), ``BLOCKS`` + ``TAPES`` blocks, and they come back as a table of ``TAPES`` rows. All else is DataFrame work:
the order is one range sort, prefix sums are taken in ranges, so a source with most of the rows is split over tasks.

NULL text: size 0. Documents without words are never over a target and are drawn with their passes, adding nothing. Repeated
rows are documents of their own, interchangeable in the draw. Nothing depends on partitioning: reruns agree. An empty
table gives no rows; without any word all targets are 0. Extra columns are not read.
"""

from __future__ import annotations

import random
from collections import Counter
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import cut
from tillbook.llm.sharding import block_offsets, in_order

SHARDS = 24
WEIGHTS = (1, 2, 3)
#: No target is more than so many times its source.
MOST = 3
BLOCKS = 1 << 14
TAPES = 1 << 10
WORD = r"[^\x20\x09-\x0D]+"
SEED = 12
#: Factor of the block permutation: prime and above any quota, so no two blocks meet.
PRIME = 1_000_003


def n_words(text: Column) -> Column:
    """Number of words. NULL has none."""
    return F.coalesce(F.octet_length(F.translate(F.regexp_replace(text, WORD, "x"), " \t\n\x0b\f\r", "")), F.lit(0)).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with ``nth`` (from 0, by code point, NULL last), ``weight`` and ``target``.

    A source is capped if its cap lies under weight * share, where share is the uncapped words for a unit of weight. The
    share rises from round to round as more sources are capped, until it stands; each round sends two numbers.
    """
    rows = in_order(sizes, [F.col("source").asc_nulls_last()], "sources")
    rows = rows.join(block_offsets(rows, before=F.count("*")), "block").withColumn(
        "nth", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    rows = cut(rows.select("source", "source_size", "nth", F.element_at(F.array(*map(F.lit, WEIGHTS)), (
        F.col("nth") % len(WEIGHTS) + 1).cast("int")).alias("weight")), "weighed")
    cap = F.col("source_size") * MOST
    share, free = 0.0, None
    while True:
        total, capped, weights = rows.agg(*(F.coalesce(F.sum(x), F.lit(0)) for x in (
            F.col("source_size"), F.when(cap <= F.col("weight") * share, cap), F.when(cap > F.col("weight") * share, F.col("weight"))))).first()
        if not weights or weights == free:
            break
        share, free = (total - capped) / weights, weights
    return rows.withColumn("target", F.when(cap <= F.col("weight") * share, cap.cast("double")).otherwise(F.col("weight") * F.lit(share)))


def split(quotas: list[int], shards: int, seed: int = SEED) -> list[list[int]]:
    """The tree: quotas of each shard (rows sum to near equal shares, columns to ``quotas``), by draws without replacement."""
    if shards == 1:
        return [quotas]
    left = shards // 2
    total = sum(quotas)
    # the draw depends on the node only through its seed, which names its place in the tree
    drawn = Counter(random.Random(seed).sample(range(len(quotas)), total * left // shards, counts=quotas)) if total else {}
    first = [drawn.get(i, 0) for i in range(len(quotas))]
    rest = [q - d for q, d in zip(quotas, first, strict=True)]
    return split(first, left, 2 * seed) + split(rest, shards - left, 2 * seed + 1)


def shard_plan(quotas: dict[int, int], shards: int) -> list[tuple[int, int, int, list[int]]]:
    """For each tape: its quota, where its permuted blocks begin, and the number of them up to each shard's end."""
    tapes = sorted(quotas)
    leaves = split([quotas[t] for t in tapes], shards)
    return [(t, quotas[t], random.Random(f"{SEED}:{t}").randrange(quotas[t]), list(accumulate(leaf[i] for leaf in leaves)))
            for i, t in enumerate(tapes)]


def mix(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
        ) -> tuple[DataFrame, DataFrame]:
    """The documents and their draws.

    Documents, one per input row: row (a number), doc_id, source, size, source_size, target. Draws, one for each time a
    document is taken: row, copy (from 0), shard, slot (gapless from 0 in each shard).
    """
    text = F.col(text_col)
    digest = F.md5(F.concat_ws(":", F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("-")),
                               F.coalesce(F.md5(text.cast("binary")), F.lit("-"))).cast("binary"))
    base = cut(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"),
                           n_words(text).alias("size"), digest.alias("digest")), "documents")
    wanted = cut(targets(base.groupBy("source").agg(F.sum("size").alias("source_size"))), "targets")
    n_sources, total = wanted.agg(F.count("*"), F.coalesce(F.sum("source_size"), F.lit(0))).first()

    # blocks of equal words on each tape, and the quotas of each shard
    step = max(1.0, total / BLOCKS)
    per_tape = max(1, -(-n_sources // TAPES))
    before = Window.partitionBy("tape").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    wanted = wanted.withColumn("tape", F.floor(F.col("nth") / per_tape)).withColumn("begin", F.coalesce(F.sum("target").over(before), F.lit(0.0)))
    quota = F.greatest(F.lit(1), F.ceil(F.max(F.col("begin") + F.col("target")) / step)).alias("q")
    quotas = {r.tape: r.q for r in wanted.groupBy("tape").agg(quota).collect()}  # TAPES rows at most
    plan = docs.sparkSession.createDataFrame(shard_plan(quotas, shards), "tape long, q long, turn long, ends array<long>")

    # the order of all tapes: by source, then permuted; upto: the words of the source that lie before
    sources = wanted.select(F.col("source").alias("s"), "nth", "source_size", "target", "tape", "begin")
    ranked = in_order(base.join(sources, F.col("source").eqNullSafe(F.col("s"))).drop("s"), [F.col("nth"), F.col("digest")], "tapes")
    so_far = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.join(block_offsets(ranked, before=F.sum("size")), "block").withColumn(
        "upto", F.col("before") + F.coalesce(F.sum("size").over(so_far), F.lit(0)))
    starts = ranked.groupBy("nth").agg(F.min("upto").alias("start"))
    ranked = cut(ranked.join(starts, "nth").withColumn("upto", F.col("upto") - F.col("start"))
                 .withColumnRenamed("at", "row").drop("block", "before", "digest", "start"), "rows")

    # whole passes, and of the last one the documents whose middle lies before its end
    whole = F.floor(F.col("target") / F.col("source_size"))
    rest = F.col("target") - whole * F.col("source_size")
    times = F.least(F.lit(MOST), whole + F.when(2 * F.col("upto") + F.col("size") <= 2 * rest, 1).otherwise(0)).cast("int")
    draws = (ranked.where("source_size > 0").withColumn("times", times).where("times > 0")
             .withColumn("copy", F.explode(F.sequence(F.lit(0), F.col("times") - 1))))
    block = F.floor((F.col("begin") + F.col("copy") * F.col("source_size") + F.col("upto")) / step)
    draws = draws.join(F.broadcast(plan), "tape")
    block = (F.least(block, F.col("q") - 1) * PRIME + F.col("turn")) % F.col("q")
    shard = F.size(F.filter("ends", lambda e: e <= F.col("b"))).alias("shard")
    draws = draws.withColumn("b", block).select("row", "copy", shard, F.xxhash64("nth", "upto", "copy").alias("h"))
    order = in_order(draws, [F.col(c) for c in ("shard", "h", "row", "copy")], "draws")
    order = order.join(block_offsets(order, before=F.count("*")), "block").withColumn(
        "place", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    first = order.groupBy("shard").agg(F.min("place").alias("first"))
    draws = order.join(F.broadcast(first), "shard").select("row", "copy", "shard", (F.col("place") - F.col("first")).alias("slot"))
    return ranked.select("row", "doc_id", "source", "size", "source_size", "target"), draws
