"""Skew-safe running aggregates per key (two-level scan).

A plain ``Window.partitionBy(key).orderBy(seq)`` puts every row of a key into one
window partition — for a key holding a third of the data that is one task buffering
a third of the table. Here the ordered rows of a key are cut into chunks of a global
sequence range (``seq // chunk_width``):

1. the running value inside each (key, chunk) is an ordinary window — bounded size;
2. each (key, chunk) is reduced to one row by a partial aggregation;
3. the carry-in of a chunk is a running aggregate over the *chunk* table, which is
   ``chunk_width`` times smaller for a dense (hot) key;
4. carry-in and local value are combined on a join by (key, chunk).

Exact for associative aggregates: sum, min, max, last non-null.

The input is read by two branches (window and chunk aggregate); feed these scans a
table or a checkpoint, not an expensive uncached plan (``RetailTables.ledger`` is
checkpointed for that reason).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Sequence units per chunk. Local windows hold at most this many rows of a key; the chunk
# table holds rows(key) / width rows for a dense key (a third of 10^12 rows -> ~5M).
DEFAULT_CHUNK_WIDTH = 1 << 16

_AGG = {
    "sum": lambda c: F.sum(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count": lambda c: F.count(c),
}


def keyed_scan(df: DataFrame, keys: list[str], order: str | list[str], value: str | Column, kind: str, out: str,
               exclusive: bool = False, chunk_width: int = DEFAULT_CHUNK_WIDTH) -> DataFrame:
    """Add column ``out`` = running ``kind`` of ``value`` over each key ordered by ``order``.

    ``order`` must be a non-null LONG, unique within a key. ``keys`` must be non-null
    (map nullable keys to a sentinel first). ``exclusive`` leaves the current row out.
    ``kind`` ∈ sum, min, max, count, last (last non-null value).
    """
    return keyed_scans(df, keys, order, [(value, kind, out, exclusive)], chunk_width)


def keyed_scans(df: DataFrame, keys: list[str], order: str | list[str],
                specs: list[tuple[str | Column, str, str, bool]],
                chunk_width: int = DEFAULT_CHUNK_WIDTH) -> DataFrame:
    """Several running aggregates ``(value, kind, out, exclusive)`` in one chunked pass:
    one sort for the local windows, one chunk aggregate, one carry window, one join.

    ``order`` may be a list of columns (a composite order); chunks are ranges of its
    first column, which must be a non-null LONG, and rows are ordered by the whole list
    inside a chunk.
    """
    cols = [order] if isinstance(order, str) else list(order)
    d = df.withColumn("_chunk", F.floor(F.col(cols[0]) / F.lit(chunk_width)).cast("bigint"))
    d = d.select("*", *[(F.col(v) if isinstance(v, str) else v).alias(f"_v{i}") for i, (v, _k, _o, _e) in
                        enumerate(specs)])
    w_base = Window.partitionBy(*keys, "_chunk").orderBy(*cols)
    w_chunks = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    locals_, tots, carries, combine = [], [], [], []
    for i, (_v, kind, out, exclusive) in enumerate(specs):
        v = f"_v{i}"
        w_local = w_base.rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)
        if kind == "last":
            locals_.append(F.last(v, ignorenulls=True).over(w_local).alias(f"_l{i}"))
            tots.append(F.max_by(F.col(v), F.when(F.col(v).isNotNull(), F.struct(*cols))).alias(f"_t{i}"))
            carries.append(F.last(f"_t{i}", ignorenulls=True).over(w_chunks).alias(f"_c{i}"))
        elif kind in _AGG:
            locals_.append(_AGG[kind](v).over(w_local).alias(f"_l{i}"))
            tots.append(_AGG[kind](v).alias(f"_t{i}"))
            carries.append((_AGG["sum"] if kind == "count" else _AGG[kind])(f"_t{i}").over(w_chunks).alias(f"_c{i}"))
        else:
            raise ValueError(f"unknown scan kind {kind!r}")
        loc, car = F.col(f"_l{i}"), F.col(f"_c{i}")
        if kind in ("sum", "count"):
            res = F.coalesce(car, F.lit(0)) + F.coalesce(loc, F.lit(0))
            if kind == "sum":
                res = F.when(loc.isNull() & car.isNull(), F.lit(None)).otherwise(res)
        elif kind == "min":
            res = F.least(car, loc)
        elif kind == "max":
            res = F.greatest(car, loc)
        else:
            res = F.coalesce(loc, car)
        combine.append(res.alias(out))
    chunk_tab = d.groupBy(*keys, "_chunk").agg(*tots)
    carry_tab = chunk_tab.select(*keys, "_chunk", *carries)
    j = d.select("*", *locals_).join(carry_tab, [*keys, "_chunk"], "left")
    return j.select(*df.columns, *combine)


def number_lines(df: DataFrame, key: str, order: list[str], chunk_width: int = DEFAULT_CHUNK_WIDTH) -> DataFrame:
    """``line_no`` = 1, 2, … inside each ``key`` in ``order`` (like ``row_number()``), through the chunked count
    scan, so one huge sale is not a single window partition. ``order[0]`` must be a LONG."""
    return (keyed_scan(df, [key], order, F.lit(1), "count", "line_no", chunk_width=chunk_width)
            .withColumn("line_no", F.col("line_no").cast("int")))


def keyed_walk(df: DataFrame, keys: list[str], order: str, delta: str, base: str,
               chunk_width: int = DEFAULT_CHUNK_WIDTH) -> DataFrame:
    """Clamp-at-zero walk per key: ``q_i = max(0, q_{i-1} + delta_i)``, ``q_0 = base``.

    Closed form: with ``P_i = base + Σ_{j≤i} delta_j``, ``q_i = P_i − least(0, min_{k≤i} P_k)``.
    Adds ``_q_after`` and ``_q_before``. One chunked pass: inside a (key, chunk) the
    local prefix sum and its running minimum are chained windows on one sort; per chunk
    the total and the minimum prefix feed a carry (offset, running minimum) computed on
    the chunk table; one join by (key, chunk) combines them. ``base`` must be constant
    per key where given (it may be NULL on all but one row of the key — e.g. only on a
    segment's opening row; the key's base is the maximum non-NULL value) and ``delta``
    non-null.
    """
    d = df.withColumn("_chunk", F.floor(F.col(order) / F.lit(chunk_width)).cast("bigint"))
    wl = Window.partitionBy(*keys, "_chunk").orderBy(order)
    d = d.withColumn("_p", F.sum(delta).over(wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    run = wl.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    excl = wl.rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("*", F.min("_p").over(run).alias("_m"), F.min("_p").over(excl).alias("_mx"))
    chunks = d.groupBy(*keys, "_chunk").agg(F.sum(delta).alias("_T"), F.min("_p").alias("_mc"),
                                            F.max(base).alias("_base"))
    wc = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    key_base = F.max("_base").over(Window.partitionBy(*keys))
    chunks = chunks.withColumn("_off", key_base + F.coalesce(F.sum("_T").over(wc), F.lit(0)))
    chunks = chunks.select(*keys, "_chunk", "_off", F.min(F.col("_off") + F.col("_mc")).over(wc).alias("_cm"))
    j = d.join(chunks, [*keys, "_chunk"], "left")
    p = F.col("_off") + F.col("_p")
    m = F.least(F.col("_cm"), F.col("_off") + F.col("_m"))
    mx = F.least(F.col("_cm"), F.col("_off") + F.col("_mx"))
    after = p - F.least(F.lit(0), m)
    before = (p - F.col(delta)) - F.least(F.lit(0), F.coalesce(mx, F.lit(0)))
    return j.select(*[c for c in df.columns], after.alias("_q_after"), before.alias("_q_before"))
