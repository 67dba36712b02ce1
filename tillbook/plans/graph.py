"""Graphs in tables: connected components, and ancestors along parent links by path doubling.

Both go in rounds whose number is logarithmic in the longest path, and checkpoint what a round makes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.session import checkpoint_dir


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for the ends of ``edges`` (columns ``a`` and ``b``, one type): root is the component's least node.

    Each round a node takes the least label among its own and its neighbours', the nodes of one label take the least
    that any of them found, and labels are followed one step (so the distance they come from doubles).
    """
    checkpoint_dir(edges.sparkSession)
    pairs = edges.select(F.col(a).alias("node"), F.col(b).alias("other"))
    pairs = pairs.unionAll(pairs.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct().checkpoint(eager=True)
    label = pairs.groupBy("node").agg(F.min("other").alias("_m")).select("node", F.least("node", "_m").alias("root")).checkpoint(eager=True)
    while True:
        near = (pairs.join(label.select(F.col("node").alias("other"), F.col("root").alias("_r")), "other")
                .groupBy("node").agg(F.min("_r").alias("_near")))
        seen = label.join(near, "node").select("node", "root", F.least("root", "_near").alias("_near"))
        best = seen.groupBy("root").agg(F.min("_near").alias("_best"))
        to = seen.join(best, "root").select("node", F.col("root").alias("_old"), F.least("_near", "_best").alias("root"))
        onward = to.select(F.col("node").alias("root"), F.col("root").alias("_next"))
        label = to.join(onward, "root").select("node", "_old", F.col("_next").alias("root")).checkpoint(eager=True)
        if label.filter("root <> _old").isEmpty():
            return label.select("node", "root")
        label = label.select("node", "root")


def rings(links: DataFrame, extra: str) -> DataFrame:
    """(id, extra) for the nodes of ``links`` (id, parent, extra) on a cycle of parents, with the cycle's largest ``extra``.

    Every node's pointer is followed twice as far each round, until all have ended at a root or have gone as far as there
    are nodes. What the pointers that are left rest on are the nodes of the cycles.
    """
    checkpoint_dir(links.sparkSession)
    ptr = links.select("id", F.col("parent").alias("to")).filter("to is not null").checkpoint(eager=True)
    n, far = ptr.count(), 1
    while far <= n and not ptr.isEmpty():
        nxt = ptr.select(F.col("id").alias("to"), F.col("to").alias("_next"))
        ptr = ptr.join(nxt, "to").select("id", F.col("_next").alias("to")).checkpoint(eager=True)
        far *= 2
    on = links.join(ptr.select(F.col("to").alias("id")).distinct(), "id", "left_semi")
    ring = components(on, "id", "parent")
    most = on.join(ring, on["id"] == ring["node"]).groupBy("root").agg(F.max(extra).alias(extra))
    return ring.join(most, "root").select(F.col("node").alias("id"), extra)


def lineage(nodes: DataFrame) -> DataFrame:
    """``nodes`` (id, parent, name) with ``top`` (the last ancestor), depth below it, names from it down, and ``ended``: 1 if the
    top has no parent, 0 if its parent is not a node. Nodes that lead to a cycle are left out.

    Each node holds a window of its line, at first itself, and takes over the window of its top's parent each round.
    """
    checkpoint_dir(nodes.sparkSession)
    part = nodes.select("id", F.col("parent").alias("to"), F.col("id").alias("top"), F.lit(0).alias("depth"), F.array("name").alias("names"),
                        F.col("parent").isNull().cast("int").alias("ended")).checkpoint(eager=True)
    n, far = part.count(), 1
    while far <= n and not part.filter("to is not null").isEmpty():
        up = part.select(F.col("id").alias("_id"), F.col("to").alias("_to"), F.col("top").alias("_top"), F.col("depth").alias("_depth"),
                         F.col("names").alias("_names"), F.col("ended").alias("_ended"))
        found = F.col("_id").isNotNull()
        part = part.join(up, F.col("to") == F.col("_id"), "left").select(
            "id", F.col("_to").alias("to"), F.when(found, F.col("_top")).otherwise(F.col("top")).alias("top"),
            F.when(found, F.col("depth") + F.col("_depth") + 1).otherwise(F.col("depth")).alias("depth"),
            F.when(found, F.concat("_names", "names")).otherwise(F.col("names")).alias("names"),
            F.when(found, F.col("_ended")).otherwise(F.col("ended")).alias("ended")).checkpoint(eager=True)
        far *= 2
    return part.filter("to is null").drop("to")


def lifted(starts: DataFrame, links: DataFrame) -> DataFrame:
    """``starts`` (node, up, ...) with ``node`` moved ``up`` parents along ``links`` (id, parent): by powers of two, a join each."""
    checkpoint_dir(starts.sparkSession)
    ptr = links.select(F.col("id").alias("_of"), F.col("parent").alias("_to")).filter("_to is not null").checkpoint(eager=True)
    most = starts.agg(F.max("up")).first()[0] or 0
    out, bit = starts, 0
    while most >> bit:
        moves = F.shiftright("up", bit).bitwiseAND(F.lit(1).cast("bigint")) == 1
        x = out.join(ptr, (F.col("node") == F.col("_of")) & moves, "left")
        out = x.select(F.when(moves, F.col("_to")).otherwise(F.col("node")).alias("node"), *[c for c in starts.columns if c != "node"]).checkpoint(eager=True)
        onward = ptr.select(F.col("_of").alias("_to"), F.col("_to").alias("_next"))
        ptr = ptr.join(onward, "_to").select("_of", F.col("_next").alias("_to")).checkpoint(eager=True)
        bit += 1
    return out
