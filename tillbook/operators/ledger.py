"""Stock ledger: the reference's write procedures re-aimed as batch jobs over op tables.

Input ops (``stock_ops`` shape): seq, product_id, variant_id, op, n, created_by,
created_at — ``op`` ∈ in, out, adjustment, sale, return. Per (product, variant), in
``seq`` order, starting from an opening quantity (default 0):

    in n          q + n
    out n         max(0, q − n)
    adjustment n  q := n
    return n      q + n
    sale n        q − n when q ≥ n, otherwise the sale is rejected and q is unchanged

Plans
-----
* ``stock_ledger`` (L1): the sale rule makes the fold non-associative, so it runs as a
  sequential fold in ``mapInPandas``, partitioned by (product, variant). An ``adjustment``
  resets the state, so the ops of a product with very many are cut into segments at
  adjustments (segment id = running count of adjustments, a two-level scan) and partitioned
  by (product, variant, segment, chunk): a hot product spreads over tasks. Inside a task rows stream through Arrow
  batches sorted by (key, segment, seq); the state is two integers, so memory does
  not grow with a key's size. Each adjustment of a hot product is fed twice — a probe copy closing the
  previous segment (it knows the quantity before the adjustment; its result is the set
  value) and a reset copy opening its own — so segments never wait for each other and
  the fold runs exactly once (no self-join of its output).
* ``stock_ledger_adjust_only`` (L1w): without sales the fold is a reflected walk,
  ``after = P − least(0, running min P)`` with P the running sum inside a segment —
  pure two-level scans, no Python.
* ``low_stock_alert_events`` (L3): the alert state after a row is the last non-null
  signal (1 = at/below minimum, 0 = above, for ops that may resolve) — a two-level
  ``last`` scan; raise / resolve are emitted where the state flips.
"""

from __future__ import annotations

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillbook.functions import folds
from tillbook.plans.scans import DEFAULT_CHUNK_WIDTH, keyed_scan, keyed_walk
from tillbook.session import checkpoint_dir
from tillbook.sources.views import RetailTables

cloudpickle.register_pickle_by_value(folds)  # executors need no installed copy

KEYS = ["product_id", "_vk"]  # _vk = variant_id with NULL mapped to -1 (non-null key for shuffles)
NO_VARIANT = -1
#: A (product, variant) with more ops than this is folded in chunks.
HOT_OPS = 1 << 18

LEDGER_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("product_id", T.LongType()),
    T.StructField("variant_id", T.LongType()), T.StructField("_vk", T.LongType()),
    T.StructField("seg", T.LongType()), T.StructField("op", T.StringType()), T.StructField("n", T.IntegerType()),
    T.StructField("q_before", T.LongType()), T.StructField("q_after", T.LongType()),
    T.StructField("accepted", T.IntegerType()), T.StructField("created_by", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("opening", T.LongType()),
])


def _keyed(ops: DataFrame) -> DataFrame:
    return ops.withColumn("_vk", F.coalesce(F.col("variant_id"), F.lit(NO_VARIANT).cast("bigint")))


def _with_opening(ops: DataFrame, opening: DataFrame | None) -> DataFrame:
    """Attach the opening quantity per (product, variant); missing → 0."""
    if opening is None:
        return ops.withColumn("opening", F.lit(0))
    o = _keyed(opening.select("product_id", "variant_id", F.col("quantity").cast("int").alias("opening"))
               ).drop("variant_id")
    return ops.join(o, KEYS, "left").withColumn("opening", F.coalesce(F.col("opening"), F.lit(0)))


def _segments(ops: DataFrame, chunk_width: int) -> DataFrame:
    is_adj = F.when(F.col("op") == "adjustment", F.lit(1)).otherwise(F.lit(0))
    return keyed_scan(ops, KEYS, "seq", is_adj, "sum", "seg", chunk_width=chunk_width)


def _split_adjustments(x: DataFrame) -> DataFrame:
    """Give every adjustment a probe copy at the end of the previous segment and a reset copy
    starting its own (``_role`` 1 / 2; other rows 0)."""
    adj = F.col("op") == "adjustment"
    copies = F.when(adj, F.array(F.struct((F.col("seg") - 1).alias("s"), F.lit(folds.PROBE).alias("r")),
                                 F.struct(F.col("seg").alias("s"), F.lit(folds.RESET).alias("r"))))
    copies = copies.otherwise(F.array(F.struct(F.col("seg").alias("s"), F.lit(0).alias("r"))))
    return (x.withColumn("_c", F.explode(copies))
            .withColumn("seg", F.col("_c.s")).withColumn("_role", F.col("_c.r")).drop("_c"))


def _finish(led: DataFrame) -> DataFrame:
    # quantities are 64-bit in the fold; the stock table's are 32-bit
    return led.select("seq", "product_id", "variant_id", "op", "n", F.col("q_before").cast("int").alias("q_before"),
                      F.col("q_after").cast("int").alias("q_after"), (F.col("q_after") - F.col("q_before")).cast("int").alias("q_change"), "accepted",
                      "created_by", "created_at")


def stock_ledger(t: RetailTables, ops: DataFrame | None = None, opening: DataFrame | None = None,
                 chunk_width: int = DEFAULT_CHUNK_WIDTH, has_adjustments: bool = True) -> DataFrame:
    """L1: every op with before / after / change and an ``accepted`` flag (rejected sales: 0).

    ``has_adjustments=False`` declares that ``ops`` holds no ``adjustment`` rows (e.g. a
    sale replay): the whole key is one segment and the segment scan is skipped.
    Whether a sale is refused depends on all before it, so the ops of one (product, variant) are folded one after
    the other, as a stream; those of a (product, variant) with more than ``HOT_OPS`` ops are cut at adjustments
    and folded in chunks side by side (``_folded_in_chunks``).
    """
    ops = _keyed(t.stock_ops if ops is None else ops)
    hot = ops.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > HOT_OPS).select(*KEYS)
    some = not hot.isEmpty()

    def rows(ops: DataFrame, cut: bool = False) -> DataFrame:
        x = _with_opening(ops, opening)
        if cut:
            x = _split_adjustments(_segments(x, chunk_width))
        else:
            x = x.withColumn("seg", F.lit(0).cast("bigint")).withColumn("_role", F.lit(0))
        return x.select("seq", "product_id", "variant_id", "_vk", "seg", "_role", "op", "n", "created_by", "created_at", "opening")

    # hash by key (no fixed count: AQE sizes the partitions from the shuffle statistics)
    led = (rows(ops.join(hot, KEYS, "left_anti") if some else ops).repartition(*KEYS)
           .sortWithinPartitions(*KEYS, "seq").mapInPandas(folds.fold_sorted_batches, LEDGER_SCHEMA))
    if some:
        led = led.unionByName(_folded_in_chunks(rows(ops.join(hot, KEYS, "left_semi"), cut=has_adjustments), chunk_width))
    return _finish(led)


def _folded_in_chunks(x: DataFrame, chunk_width: int) -> DataFrame:
    """The fold of keys with very many ops, their chunks (ranges of ``seq``) side by side.

    Every chunk is folded from a guess of the quantity before it, which gives the interval of quantities from which all turns out the
    same, and what becomes of them. Along the chunks (a row each, read as a stream) the true quantities follow as long as they
    stay in the intervals. Chunks they leave are folded again from there; each round settles one more chunk of a segment at
    least, in general all whose quantity was guessed by then. The last pass folds all chunks from what is known.
    """
    checkpoint_dir(x.sparkSession)
    group = [*KEYS, "seg", "chunk"]
    x = x.withColumn("chunk", F.floor(F.col("seq") / F.lit(chunk_width)).cast("bigint")).checkpoint(eager=True)
    sign = F.when(F.col("op").isin("in", "return"), 1).when(F.col("op").isin("out", "sale"), -1).otherwise(0)
    chunks = x.groupBy(*group).agg(F.sum(F.when(F.col("_role") == 0, sign * F.col("n")).otherwise(0)).alias("_t"),
                                   F.max(F.when(F.col("_role") == folds.RESET, F.col("n"))).alias("_set"), F.max("opening").alias("_open"))
    segment = Window.partitionBy(*KEYS, "seg")
    base = F.coalesce(F.max("_set").over(segment), F.col("_open")).cast("bigint")
    before = F.coalesce(F.sum("_t").over(segment.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    known = chunks.select(*group, F.greatest(F.lit(0), base + before).cast("bigint").alias("start"))
    known = known.withColumn("redo", F.lit(1)).checkpoint(eager=True)
    done = None
    kinds = "product_id long, _vk long, seg long, chunk long"
    while True:
        rows = x.join(known.filter("redo = 1").select(*group, "start"), group).repartition(*group).sortWithinPartitions(*group, "seq")
        new = rows.mapInPandas(folds.fold_chunks, f"{kinds}, lo long, hi long, fixed long, value long").checkpoint(eager=True)
        done = new if done is None else done.join(new, group, "left_anti").unionByName(new)
        along = known.select(*group, "start").join(done, group).repartition(*KEYS, "seg").sortWithinPartitions(*group)
        known = along.mapInPandas(folds.chain_chunks, f"{kinds}, start long, redo long").checkpoint(eager=True)
        if known.filter("redo = 1").isEmpty():
            break
    rows = x.drop("opening").join(known.select(*group, F.col("start").alias("opening")), group)
    return (rows.repartition(*group).sortWithinPartitions(*group, "seq").mapInPandas(folds.fold_sorted_batches, LEDGER_SCHEMA))


def stock_ledger_adjust_only(t: RetailTables, ops: DataFrame | None = None, opening: DataFrame | None = None,
                             chunk_width: int = DEFAULT_CHUNK_WIDTH) -> DataFrame:
    """L1w: the ledger of in / out / adjustment / return ops in pure window form (sales rejected up front)."""
    ops = t.stock_ops if ops is None else ops
    if "op" in ops.columns:
        ops = ops.filter(F.col("op") != "sale")
    x = _with_opening(_keyed(ops), opening)
    x = _split_adjustments(_segments(x, chunk_width))
    d = (F.when(F.col("_role") != 0, F.lit(0)).when(F.col("op").isin("in", "return"), F.col("n"))
         .when(F.col("op") == "out", -F.col("n")).otherwise(F.lit(0))).cast("bigint")
    skeys = [*KEYS, "seg"]
    # walk base: the opening for segment 0, the reset copy's value for later segments (given on
    # that row only; the walk takes the segment's maximum, so no join is needed)
    base = F.when(F.col("_role") == folds.RESET, F.col("n")).when(F.col("seg") == 0, F.col("opening"))
    x = x.select("*", d.alias("_d"), base.cast("bigint").alias("_b"))
    x = keyed_walk(x, skeys, "seq", "_d", "_b", chunk_width=chunk_width)
    x = x.filter(F.col("_role") != folds.RESET).select(
        "*", F.when(F.col("_role") == folds.PROBE, F.col("n")).otherwise(F.col("_q_after")).cast("int").alias("q_after"),
        F.col("_q_before").cast("int").alias("q_before"), F.lit(1).alias("accepted"))
    return _finish(x)


def movements_from_ledger(ledger: DataFrame) -> DataFrame:
    """Accepted ledger rows in the ``stock_movements`` shape (id = seq)."""
    ref_type = F.when(F.col("op") == "sale", F.lit("sale")).when(F.col("op") == "return", F.lit("refund"))
    return ledger.filter(F.col("accepted") == 1).select(
        F.col("seq").alias("id"), "product_id", "variant_id", F.col("op").alias("movement_type"),
        F.col("q_change").alias("quantity_change"), F.col("q_before").alias("quantity_before"),
        F.col("q_after").alias("quantity_after"), F.lit(None).cast("bigint").alias("reference_id"),
        ref_type.alias("reference_type"), F.lit(None).cast("string").alias("notes"), "created_by", "created_at")


def stock_on_hand(ledger: DataFrame, stock: DataFrame | None = None) -> DataFrame:
    """L2: current quantity per (product, variant) = ``after`` of its last op.

    With ``stock`` given, keys without ops keep their stock quantity (the merged table).
    """
    last = ledger.groupBy("product_id", "variant_id").agg(F.max_by("q_after", "seq").alias("quantity"),
                                                           F.max("created_at").alias("last_updated"))
    if stock is None:
        return last
    s = _keyed(stock)
    lk = _keyed(last).select(*KEYS, F.col("quantity").alias("_q"), F.col("last_updated").alias("_lu"))
    j = s.join(lk, KEYS, "left")
    return j.select("id", "product_id", "variant_id",
                    F.coalesce(F.col("_q"), F.col("quantity")).cast("int").alias("quantity"), "reserved_quantity",
                    F.coalesce(F.col("_lu"), F.col("last_updated")).alias("last_updated"), "updated_by")


def _alert_signal(t: RetailTables, ledger: DataFrame, min_level: int | None) -> DataFrame:
    if min_level is None:
        p = t.products.select(F.col("id").alias("product_id"), F.col("min_stock_level").alias("min_level"))
        led = ledger.join(p, "product_id", "left")
    else:
        led = ledger.withColumn("min_level", F.lit(int(min_level)))
    low = F.col("q_after") <= F.col("min_level")
    signal = (F.when(F.col("min_level").isNull(), F.lit(None))
              .when(F.col("op").isin("in", "out", "adjustment"), F.when(low, F.lit(1)).otherwise(F.lit(0)))
              .when((F.col("op") == "sale") & (F.col("accepted") == 1) & low, F.lit(1)))
    return led.withColumn("signal", signal.cast("int"))


def low_stock_alert_events(t: RetailTables, ledger: DataFrame | None = None, min_level: int | None = None,
                           initially_active: DataFrame | None = None,
                           chunk_width: int = DEFAULT_CHUNK_WIDTH) -> DataFrame:
    """L3: ledger rows where an alert is raised or resolved (``event`` column).

    Transition table (from the reference's three write paths): in/out/adjustment raise
    when at/below minimum and no alert is active, resolve when above and one is;
    accepted sales only raise; returns and rejected sales never touch alerts.
    ``initially_active``: (product_id, variant_id) keys that start with an active alert.
    """
    ledger = t.ledger if ledger is None else ledger
    x = _keyed(_alert_signal(t, ledger, min_level))
    x = keyed_scan(x, KEYS, "seq", "signal", "last", "state_before", exclusive=True, chunk_width=chunk_width)
    init = F.lit(0)
    if initially_active is not None:
        ia = _keyed(initially_active.select("product_id", "variant_id")).select(*KEYS, F.lit(1).alias("_init"))
        x = x.join(ia, KEYS, "left")
        init = F.coalesce(F.col("_init"), F.lit(0))
    sb = F.coalesce(F.col("state_before"), init)
    event = (F.when((F.col("signal") == 1) & (sb == 0), F.lit("raise"))
             .when((F.col("signal") == 0) & (sb == 1), F.lit("resolve")))
    x = x.withColumn("event", event).filter(F.col("event").isNotNull())
    return x.select("seq", "product_id", "variant_id", "op", "q_after", "min_level", "event", "created_by",
                    "created_at")


def alerts_table(events: DataFrame) -> DataFrame:
    """Alert rows in the ``low_stock_alerts`` shape: one per raise; resolved when a later event exists.

    Raise and resolve alternate per key, so an alert is still active exactly when its
    raise is the key's last event (an aggregate, not a window over the key).
    """
    e = _keyed(events)
    last = e.groupBy(*KEYS).agg(F.max("seq").alias("_last"))
    r = e.filter(F.col("event") == "raise").join(last, KEYS, "inner")
    return r.select(
        F.col("seq").alias("id"), "product_id", "variant_id", F.col("q_after").alias("current_stock"),
        F.col("min_level").alias("min_stock_level"),
        F.when(F.col("seq") == F.col("_last"), F.lit("active")).otherwise(F.lit("resolved")).alias("alert_status"),
        F.lit(None).cast("bigint").alias("acknowledged_by"), F.lit(None).cast("timestamp_ntz").alias("acknowledged_at"),
        "created_at")


def ledger_consistency(ledger_rows: DataFrame, chunk_width: int = DEFAULT_CHUNK_WIDTH, stock: DataFrame | None = None) -> DataFrame:
    """L4: violations of before + change = after, of after(i) = before(i+1) per key, and (with ``stock``) of
    last after = the stock's quantity, per key that has both.

    ``ledger_rows`` in ``stock_movements`` shape. The successor of a row is found by
    its rank within the key (a two-level count scan) and an equi-join on (key, rank).
    Returns one row per check with the number of violating rows.
    """
    m = _keyed(ledger_rows)
    arith = m.filter(F.col("quantity_before") + F.col("quantity_change") != F.col("quantity_after"))
    ranked = keyed_scan(m, KEYS, "id", F.lit(1), "count", "_rk", chunk_width=chunk_width)
    nxt = ranked.select(*KEYS, (F.col("_rk") - 1).alias("_rk"), F.col("quantity_before").alias("_next_before"))
    chain = ranked.join(nxt, [*KEYS, "_rk"], "inner").filter(F.col("quantity_after") != F.col("_next_before"))
    a = arith.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("before_plus_change").alias("check"), "violations")
    c = chain.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("after_equals_next_before").alias("check"),
                                                                 "violations")
    if stock is None:
        return a.unionByName(c)
    last = m.groupBy(*KEYS).agg(F.max_by("quantity_after", "id").alias("_last"))
    off = last.join(_keyed(stock).select(*KEYS, "quantity"), KEYS).filter(F.col("_last") != F.col("quantity"))
    s = off.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("last_after_equals_stock").alias("check"), "violations")
    return a.unionByName(c).unionByName(s)
