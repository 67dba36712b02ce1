"""New ids without gaps.

The rows are range-partitioned and sorted, the partitions are counted, and a row's id is the sum of the counts before its
partition and its place there. Only the counts, a row a partition, meet in one task. The numbered rows are checkpointed
first, so a lost executor changes no id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.session import checkpoint_dir

_PLACE_BITS = 33  # of monotonically_increasing_id: the place in the partition


def allocate_ids(rows: DataFrame, table: DataFrame, *order: str, out: str = "id") -> DataFrame:
    """``rows`` with new ids as ``out``: gapless after the largest ``id`` of ``table`` (0: empty), ascending in ``order``.

    ``order`` should tell all rows apart; rows that tie in it get neighbouring ids in any order.
    """
    checkpoint_dir(rows.sparkSession)
    rows = rows.drop(out)
    at = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(
        "_at", F.monotonically_increasing_id()).checkpoint(eager=True)
    at = at.withColumn("_part", F.shiftright("_at", _PLACE_BITS))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    before = at.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    top = table.select(F.coalesce(F.max("id"), F.lit(0)).cast("bigint")).scalar()
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return at.join(before, "_part").select(*rows.columns, (top + F.col("_before") + place + 1).cast("bigint").alias(out))
