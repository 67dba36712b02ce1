"""Stored indexes for the list operators: contains-search by 3-grams, and pages by position.

Both are written once beside the tables (``root``: a folder in shared storage) and hold for the table as it was then.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from tillbook.functions.exprs import contains_any

GRAM = 3
#: Letters of the texts (a posting each at most) that one task takes.
TASK_GRAMS = 1 << 20
#: So many tasks' postings are made in one.
MAKE_PARTS = 4
#: Up to so many candidates their ids are a filter of the scan (min/max statistics of files and row groups skip the rest).
ID_LIST = 10_000


class GramIndex:
    """Inverted index of the 3-grams of a table's text columns, for case-insensitive contains-search.

    ``postings``: a row for each (gram, id), once, range-partitioned in parts of bounded size and sorted by both, so a frequent gram spreads over files and a lookup reads
    the row groups of one gram; ``grams``: how many ids each has. A search reads the postings of its rarest gram and checks the term on the rows
    themselves, so it finds what a scan finds. Terms whose parts between wildcards are all under 3 letters are scanned for. Rows
    without an id are always checked.
    """

    def __init__(self, spark: SparkSession, root: str, columns: tuple[str, ...], id_col: str = "id"):
        self.spark, self.root, self.columns, self.id_col = spark, root.rstrip("/"), tuple(columns), id_col

    @classmethod
    def build(cls, table: DataFrame, root: str, columns: tuple[str, ...], id_col: str = "id") -> GramIndex:
        self = cls(table.sparkSession, root, columns, id_col)
        every = F.lit(f"(?s)(?=({'.' * GRAM}))")
        grams = F.array_distinct(F.flatten(F.array(*[
            F.coalesce(F.regexp_extract_all(F.lower(F.col(c)), every, F.lit(1)), F.array().cast("array<string>")) for c in columns])))
        texts = table.select(id_col, *columns)
        letters = texts.agg(F.sum(reduce(Column.__add__, [F.coalesce(F.length(c), F.lit(0)) for c in columns])).cast("long")).first()[0] or 0
        parts = max(1, -(-letters // TASK_GRAMS))
        if parts > MAKE_PARTS:
            texts = texts.repartition(-(-parts // MAKE_PARTS), *texts.columns)
        rows = texts.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.explode(grams).alias("gram"))
        rows = rows.repartitionByRange(parts, "gram", "id").dropDuplicates()  # equal rows are in one partition
        rows.sortWithinPartitions("gram", "id").write.mode("overwrite").parquet(f"{self.root}/postings")
        n = self._postings().groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        n.repartitionByRange("gram").sortWithinPartitions("gram").write.mode("overwrite").parquet(f"{self.root}/grams")
        return self

    def _postings(self) -> DataFrame:
        return self.spark.read.schema("id long, gram string").parquet(f"{self.root}/postings")

    def rarest(self, term: str) -> tuple[str, int] | None:
        """The gram of ``term`` that fewest ids have, and how many; None: the term has no gram."""
        low = self.spark.range(1).select(F.lower(F.lit(term)).alias("t")).first().t  # as Spark lowers the texts
        grams = sorted({part[i:i + GRAM] for part in re.split("[%_]", low) for i in range(len(part) - GRAM + 1)})
        if not grams:
            return None
        counts = self.spark.read.schema("gram string, n long").parquet(f"{self.root}/grams").filter(F.col("gram").isin(grams))
        found = {r.gram: r.n for r in counts.collect()}
        return min(((g, found.get(g, 0)) for g in grams), key=lambda x: (x[1], x[0]))

    def candidates(self, table: DataFrame, term: str) -> DataFrame:
        """The rows of ``table`` that have the rarest gram of ``term`` (all rows if it has none), and those without an id."""
        best = self.rarest(term)
        if best is None:
            return table
        ids = self._postings().filter(F.col("gram") == best[0]).select("id")
        if best[1] <= ID_LIST:
            return table.filter(F.col(self.id_col).isin([r.id for r in ids.collect()]) | F.col(self.id_col).isNull())
        hit = table.join(ids.withColumnRenamed("id", "_hit"), F.col(self.id_col) == F.col("_hit"), "left_semi")
        return hit.unionByName(table.filter(F.col(self.id_col).isNull()))

    def matching(self, table: DataFrame, term: str) -> DataFrame:
        """The rows of ``table`` with ``term`` in one of the indexed columns, as ``contains_any`` finds them."""
        return self.candidates(table, term).filter(contains_any(term, *self.columns))


class PageIndex:
    """A table in the order of its pages, in blocks of some ``block_rows`` rows whose first positions are known.

    A page reads the blocks that it lies in, wherever it is; OFFSET would pass over all rows before it. ``order``: (column, descending)
    pairs that tell all rows apart; NULLs come first ascending, last descending.
    """

    def __init__(self, spark: SparkSession, root: str, order: tuple[tuple[str, bool], ...]):
        self.spark, self.root = spark, root.rstrip("/")
        self.order: list[Column] = [F.col(c).desc_nulls_last() if down else F.col(c).asc_nulls_first() for c, down in order]

    @classmethod
    def build(cls, table: DataFrame, root: str, order: tuple[tuple[str, bool], ...], block_rows: int = 1 << 16) -> PageIndex:
        self = cls(table.sparkSession, root, order)
        blocks = max(1, math.ceil(table.count() / block_rows))
        rows = table.repartitionByRange(blocks, *self.order).withColumn("block", F.spark_partition_id())
        rows.write.mode("overwrite").partitionBy("block").parquet(f"{self.root}/rows")
        earlier = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # a row a block
        sizes = self._rows(table).groupBy("block").agg(F.count(F.lit(1)).alias("n")).select(
            "block", "n", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
        sizes.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/blocks")
        return self

    def _rows(self, table: DataFrame) -> DataFrame:
        return self.spark.read.schema(StructType([*table.schema.fields, StructField("block", IntegerType())])).parquet(f"{self.root}/rows")

    def page(self, table: DataFrame, page: int, limit: int) -> DataFrame:
        """Rows ``(page - 1) * limit`` to ``page * limit`` in the index's order; ``table``: the indexed table, for its columns."""
        first = (page - 1) * limit
        blocks = self.spark.read.schema("block int, n long, before long").parquet(f"{self.root}/blocks").filter(
            (F.col("before") < first + limit) & (F.col("before") + F.col("n") > first)).collect()  # at most a row a row of the page
        start = min((b.before for b in blocks), default=first)
        rows = self._rows(table).filter(F.col("block").isin([b.block for b in blocks])).drop("block")
        return rows.orderBy(*self.order).offset(first - start).limit(limit)
