"""Connected components of a link table, by joins."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.llm.common import cut


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node in ``links`` (a, b; longs): root is the least node of the component.

    Alternates two steps until nothing changes, a logarithmic number of times: link each node's larger
    neighbours to the least one, then its smaller neighbours and itself. Minima are taken before the shuffle and
    joined back, so a node with very many neighbours is split like any skewed join key. Each round is written.
    """
    links = cut(links.where("a <> b").select("a", "b").distinct(), "links")
    state = None
    while True:
        both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
                 .unionAll(least.select("a", F.col("m").alias("b"))))
        links = cut(small.where("a <> b").distinct(), "links")
        now = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(
        links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def labels(n: int, i: np.ndarray, j: np.ndarray, label: np.ndarray | None = None) -> np.ndarray:
    """The least member of each of ``n`` nodes' component, given links i-j and, if any, the labels so far."""
    label = np.arange(n) if label is None else label
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return label
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label = further
