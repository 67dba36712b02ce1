"""Sharding by minimax contiguous partition.

Documents of equal text form atomic groups. The groups stand in one order, and each shard is a run of them. The
smallest capacity with which a greedy pass needs no more than the given number of shards is found by binary
search, and no shard gets more than that. Within it the cuts fall where the shards come out most even.

Order: groups larger than a shard's mean share first (largest first; no partition can level them), then by least
id, then by digest. Prefix sums of the group sizes are taken in two steps (within ranges of the order, then over
the ranges) and stay distributed. The driver gets ``BINS`` of them at most, one per equal step of bytes, which
brackets the capacity and every cut, and then those inside the brackets. If these are over ``FETCH``, single
look-ups narrow the brackets first. What the driver holds does not depend on the number of documents.

NULL text: size 8, check sum 0, a group of its own (not that of the empty text). Repeated rows each get a slot.
Fewer groups than shards: the last shards stay empty. An empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.llm.common import cut

SHARDS = 24
BINS = 1 << 16
FETCH = 1 << 13
#: Capacities tried at once when brackets are narrowed by look-ups.
TRIED = 63


def in_order(df: DataFrame, by: list[Column], name: str) -> DataFrame:
    """``df`` range-partitioned and sorted, written, with ``block`` and ``at`` (ascending in the order)."""
    out = df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("at", F.monotonically_increasing_id())
    return cut(out, name).withColumn("block", F.shiftright("at", 33))


def block_offsets(rows: DataFrame, **sums: Column) -> DataFrame:
    """(block, sums of all blocks before): one row per partition of the order, so few that one window serves."""
    own = rows.groupBy("block").agg(*(c.alias(k) for k, c in sums.items()))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return own.select("block", *(F.coalesce(F.sum(k).over(before), F.lit(0)).alias(k) for k in sums))


class Prefixes:
    """Prefix sums of the ordered group sizes: a few known on the driver, the rest in ``sums`` (column upto)."""

    def __init__(self, sums: DataFrame, total: int):
        self.sums, self.total = sums, total
        self.step = max(1, -(-total // BINS))
        rows = sums.groupBy(F.floor((F.col("upto") - 1) / self.step).alias("bin")).agg(F.max("upto").alias("upto")).collect()
        self.known = sorted({0, total, *(r.upto for r in rows)})
        self.filled = {(r.upto - 1) // self.step for r in rows}

    def low(self, x: int) -> int:
        """The largest known sum up to ``x``."""
        return self.known[bisect_right(self.known, x) - 1]

    def high(self, x: int) -> int:
        """No sum up to ``x`` is larger than this."""
        x = min(x, self.total)
        low = self.low(x)
        after = bisect_right(self.known, x)
        # the largest sum of each bin is known: beyond it, there is none in the bin
        return low if after == len(self.known) or (x - 1) // self.step != (self.known[after] - 1) // self.step else x

    def learn(self, ranges: list[tuple[int, int]]) -> bool:
        """All sums in the ranges become known, if they are ``FETCH`` at most."""
        cond = F.lit(False)
        for a, b in ranges:
            cond = cond | ((F.col("upto") > a) & (F.col("upto") <= b))
        inside = self.sums.where(cond)
        if inside.count() > FETCH:
            return False
        self.known = sorted({*self.known, *(r.upto for r in inside.select("upto").collect())})
        return True

    def exact(self, xs: list[int]) -> list[int]:
        """The largest sum up to each x, looked up in the table."""
        cond = F.lit(False)
        for x in xs:
            cond = cond | ((F.col("upto") > self.low(x)) & (F.col("upto") <= x))
        got = self.sums.where(cond).agg(*(F.max(F.when(F.col("upto") <= x, F.col("upto"))) for x in xs)).first()
        out = [max(self.low(x), y or 0) for x, y in zip(xs, got, strict=True)]
        self.known = sorted({*self.known, *out})
        return out


def greedy(at, total: int, capacity: int, shards: int) -> list[int]:
    """Ends of the shards when each is filled up; ``at(x)`` gives the largest prefix sum up to x."""
    ends, end = [], 0
    for _ in range(shards):
        end = at(min(total, end + capacity))
        ends.append(end)
    return ends


def least_capacity(low: int, high: int, enough) -> int:
    """Binary search: the least capacity in low..high that is enough (``high`` is)."""
    while low < high:
        mid = (low + high) // 2
        if enough(mid):
            high = mid
        else:
            low = mid + 1
    return high


def cuts(sums: DataFrame, total: int, largest: int, shards: int) -> list[int]:
    """End of each shard, as a prefix sum."""
    p = Prefixes(sums, total)
    low, high = max(largest, -(-total // shards)), -(-total // shards) + largest
    while True:
        high = least_capacity(low, high, lambda c: greedy(p.low, total, c, shards)[-1] == total)
        low = least_capacity(low, high, lambda c: greedy(p.high, total, c, shards)[-1] == total)
        if low == high:
            break
        if p.learn(list(zip(greedy(p.low, total, low, shards), greedy(p.high, total, high, shards), strict=True))):
            high = low = least_capacity(low, high, lambda c: greedy(p.low, total, c, shards)[-1] == total)
            break
        tried = sorted({low + (high - low) * i // (TRIED + 1) for i in range(TRIED + 1)})
        ends = [0] * len(tried)
        for _ in range(shards):
            ends = p.exact([min(total, e + c) for e, c in zip(ends, tried, strict=True)])
        good = [c for c, e in zip(tried, ends, strict=True) if e == total]
        high = good[0] if good else high
        low = max([low, *(c + 1 for c, e in zip(tried, ends, strict=True) if e < total)])
        if low >= high:
            break
    return level(p.known, total, high, shards)


def level(known: list[int], total: int, capacity: int, shards: int) -> list[int]:
    """Cuts at known sums, none farther apart than the capacity, each as near as can be to an even share."""
    least = [total]  # from the end: where a shard must have begun for the rest to fit
    for _ in range(shards - 1):
        least.append(known[bisect_left(known, max(0, least[-1] - capacity))])
    least.reverse()
    ends, end = [], 0
    for i in range(shards):
        first, last = max(bisect_left(known, least[i]), min(bisect_right(known, end), len(known) - 1)), bisect_right(
            known, end + capacity) - 1
        goal = end + (total - end) / (shards - i)
        at = min(max(bisect_left(known, goal), first), last)
        if at > first and goal - known[at - 1] <= known[at] - goal:
            at -= 1
        end = known[at]
        ends.append(end)
    return ends


def shard_documents(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, size, text_crc32, law, shard, slot (gapless from 0 in each shard)."""
    text = F.col(text_col)
    base = cut(docs.select(
        F.col(id_col).cast("long").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).alias("text_crc32"),
        F.coalesce(F.unhex(F.sha2(text.cast("binary"), 256)), F.lit(b"")).alias("g")), "documents")
    groups = base.groupBy("g").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), F.min("doc_id").alias("first"))
    total, largest = groups.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.coalesce(F.max("bytes"), F.lit(0))).first()

    large = F.when(F.col("bytes") * shards > total, -F.col("bytes")).otherwise(0)
    ranked = in_order(groups.withColumn("large", large), [F.col("large"), F.col("first"), F.col("g")], "groups")
    so_far = Window.partitionBy("block").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    sums = ranked.join(block_offsets(ranked, before=F.sum("bytes")), "block").select(
        "g", F.col("at").alias("place"), "bytes", (F.col("before") + F.sum("bytes").over(so_far)).alias("upto"))
    sums = cut(sums.sortWithinPartitions("upto"), "prefix-sums")
    ends = cuts(sums, total, largest, shards) if total else []

    shard = F.size(F.filter(F.array(*map(F.lit, [-1, *ends])), lambda e: e <= F.col("upto") - F.col("bytes"))) - 1
    placed = sums.select("g", "place", shard.cast("int").alias("shard"))
    rows = base.withColumn("tie", F.monotonically_increasing_id()).join(placed, "g").drop("g")
    ranked = in_order(rows, [F.col("place"), F.col("doc_id"), F.col("tie")], "order")
    rank = ranked.join(block_offsets(ranked, before=F.count("*")), "block").withColumn(
        "rank", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    first = rank.groupBy("shard").agg(F.min("rank").alias("first"))
    return rank.join(F.broadcast(first), "shard").select(  # a row per shard
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("rank") - F.col("first")).alias("slot"))
