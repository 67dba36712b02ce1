"""State-changing procedures as batch jobs: stock adjustments, alert acknowledgement,
sale replay and refunds.

Each job takes request frames and the current tables and returns new frames (per-request
outcomes, ledger rows, updated state). Per-row failures are reported in a ``reason``
column instead of aborting, like the reference's bulk endpoint; validation is joins
(left / semi / anti), sequencing is the ledger fold.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions import folds
from tillbook.operators.ledger import KEYS, _keyed, alerts_table, low_stock_alert_events, stock_ledger, stock_ledger_adjust_only
from tillbook.plans.graph import components
from tillbook.plans.scans import keyed_scan
from tillbook.session import checkpoint_dir
from tillbook.sources.views import RetailTables

ADJUST_TYPES = ("in", "out", "adjustment")
#: Rows (carts times keys) of one component settled in one task.
GROUP_ROWS = 1 << 20
#: Open rows of a key that one window partition holds; those of a key with more are scanned in chunks.
WINDOW_ROWS = 1 << 18
#: Components are looked for once when the open rows are this many times ``GROUP_ROWS``, and where so many rounds of the bounds leave more
#: than this share of the open rows. A round of the bounds costs far less.
GRAPH_GROUPS, SLOW_ROUNDS, SLOW_SHARE = 1.25, 3, 0.9
#: Lines in ``GROUP_ROWS`` above which carts that do not fit the stock at the start are left out before the rounds.
FIT_GROUPS = 4


def _validate_stock_requests(t: RetailTables, reqs: DataFrame) -> DataFrame:
    """Attach ``reason``: product missing/inactive, or no stock row for (product, variant)."""
    p = t.products.filter(F.col("is_active") == 1).select(F.col("id").alias("product_id"),
                                                          F.col("name").alias("product_name"))
    s = _keyed(t.stock).select(*KEYS, F.lit(1).alias("_has_stock"))
    j = _keyed(reqs).join(p, "product_id", "left").join(s, KEYS, "left")
    reason = (F.when(F.col("product_name").isNull(), F.lit("Product not found"))
              .when(F.col("_has_stock").isNull(), F.lit("Stock record not found")))
    return j.withColumn("reason", reason).drop("_has_stock", "_vk")


def adjust_results(t: RetailTables, adjustments: DataFrame, min_quantity: int = 0) -> DataFrame:
    """K6 / K7: apply adjustments in ``seq`` order; one outcome row per request.

    ``adjustments``: seq, product_id, variant_id, op, n, created_by, created_at.
    Invalid rows (type, quantity below ``min_quantity``: 1 for the single endpoint, 0 for
    bulk), unknown/inactive products and missing stock rows fail; the rest are folded
    (window form, no sales) from the current stock.
    """
    v = _validate_stock_requests(t, adjustments)
    bad_input = ~F.col("op").isin(*ADJUST_TYPES) | F.col("n").isNull() | (F.col("n") < min_quantity)
    v = v.withColumn("reason", F.when(bad_input, F.lit("Validation failed")).otherwise(F.col("reason")))
    ok = v.filter(F.col("reason").isNull()).select("seq", "product_id", "variant_id", "op", "n", "created_by",
                                                   "created_at")
    opening = t.stock.select("product_id", "variant_id", "quantity")
    led = stock_ledger_adjust_only(t, ops=ok, opening=opening)
    led = led.select("seq", F.col("q_change").alias("quantity_change"), F.col("q_before").alias("previous_quantity"),
                     F.col("q_after").alias("new_quantity"))
    out = v.join(led, "seq", "left")
    return out.select("seq", "product_id", "variant_id", "product_name", F.col("op").alias("adjustment_type"),
                      F.when(F.col("reason").isNull(), F.lit("success")).otherwise(F.lit("failed")).alias("status"),
                      F.col("reason").alias("error"), "quantity_change", "previous_quantity", "new_quantity")


def adjust_movements(adjustments: DataFrame, results: DataFrame) -> DataFrame:
    """K6 / K7 output: the ledger rows of the successful adjustments (``seq`` orders and identifies them)."""
    who = adjustments.select("seq", "created_by", "created_at")
    return results.filter(F.col("status") == "success").join(who, "seq").select(
        "seq", "product_id", "variant_id", F.col("adjustment_type").alias("movement_type"), "quantity_change",
        F.col("previous_quantity").alias("quantity_before"), F.col("new_quantity").alias("quantity_after"), "created_by", "created_at")


def adjust_alert_events(t: RetailTables, movements: DataFrame) -> DataFrame:
    """K6 / K7 output: adjustments that raise an alert (at or below the minimum, none active) or resolve the active one (above)."""
    led = movements.select("seq", "product_id", "variant_id", F.col("movement_type").alias("op"), F.col("quantity_after").alias("q_after"),
                           F.lit(1).alias("accepted"), "created_by", "created_at")
    active = t.low_stock_alerts.filter(F.col("alert_status") == "active").select("product_id", "variant_id").distinct()
    return low_stock_alert_events(t, led, initially_active=active)


def alerts_after_adjust(t: RetailTables, events: DataFrame) -> DataFrame:
    """K6 / K7 output: the alert table after the adjustments; ``raised_by``: the adjustment that raised a new one (NULL: an old alert)."""
    resolved = _keyed(events.filter(F.col("event") == "resolve")).select(*KEYS, F.lit(1).alias("_done")).distinct()
    cols = ["id", "product_id", "variant_id", "current_stock", "min_stock_level", "alert_status"]
    old = _keyed(t.low_stock_alerts).join(resolved, KEYS, "left").withColumn(
        "alert_status", F.when((F.col("alert_status") == "active") & (F.col("_done") == 1), "resolved").otherwise(F.col("alert_status")))
    new = alerts_table(events).withColumn("raised_by", F.col("id")).withColumn("id", F.lit(None).cast("bigint"))
    return old.select(*cols, F.lit(None).cast("bigint").alias("raised_by")).unionByName(new.select(*cols, "raised_by"))


def adjust_summary(results: DataFrame) -> DataFrame:
    """K7 summary: total / successful / failed."""
    return results.agg(F.count(F.lit(1)).alias("total"),
                       F.count(F.when(F.col("status") == "success", 1)).alias("successful"),
                       F.count(F.when(F.col("status") == "failed", 1)).alias("failed"))


def acknowledge_alerts(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """K9: active alerts named in ``acks`` (alert_id, user_id, ack_at) become acknowledged.

    The earliest ack of an alert wins; acknowledged/resolved/unknown alerts are unchanged.
    """
    first = (acks.groupBy("alert_id").agg(F.min(F.struct("ack_at", "user_id")).alias("_a"))
             .select(F.col("alert_id").alias("id"), F.col("_a.user_id").alias("_by"), F.col("_a.ack_at").alias("_at")))
    j = alerts.join(first, "id", "left")
    hit = F.col("_by").isNotNull() & (F.col("alert_status") == "active")
    return j.select("id", "product_id", "variant_id", "current_stock", "min_stock_level",
                    F.when(hit, F.lit("acknowledged")).otherwise(F.col("alert_status")).alias("alert_status"),
                    F.when(hit, F.col("_by")).otherwise(F.col("acknowledged_by")).alias("acknowledged_by"),
                    F.when(hit, F.col("_at")).otherwise(F.col("acknowledged_at")).alias("acknowledged_at"),
                    "created_at")


def ack_outcomes(alerts: DataFrame, acks: DataFrame) -> DataFrame:
    """K9 per-ack result: ``acknowledged`` or ``not found or already acknowledged``."""
    acks = _in_sequence(acks.select("alert_id", "user_id", "ack_at"), "alert_id", "ack_at", "user_id")  # tells equal acks apart
    first = acks.groupBy("alert_id").agg(F.min(F.struct("ack_at", "user_id", "seq")).alias("_a"))
    a = alerts.select(F.col("id").alias("alert_id"), "alert_status")
    j = acks.join(a, "alert_id", "left").join(first, "alert_id", "left")
    won = (F.col("alert_status") == "active") & (F.col("_a.seq") == F.col("seq"))
    return j.select("alert_id", "user_id", "ack_at", F.when(won, F.lit("acknowledged"))
                    .otherwise(F.lit("not found or already acknowledged")).alias("result"))


def _in_sequence(df: DataFrame, *order: str) -> DataFrame:
    """``seq``: unique longs that ascend in ``order`` (a range partition's number, then the place in it)."""
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return ranged.withColumn("seq", F.monotonically_increasing_id()).checkpoint(eager=True)


def apply_sales(t: RetailTables, lines: DataFrame) -> DataFrame:
    """Replay cart lines one by one: each line is a sale of its own, in the order of cart and line.

    An extra beside the reference's rule (``post_sales``: all lines of a cart or none).
    ``lines``: cart_id, line_no, product_id, variant_id, quantity, unit_price, created_by, created_at. Returns one
    outcome row per line; a line is refused when the stock is short at its turn.
    """
    v = _in_sequence(_validate_stock_requests(t, lines), "cart_id", "line_no")
    ops = v.filter(F.col("reason").isNull()).select(
        "seq", "product_id", "variant_id", F.lit("sale").alias("op"), F.col("quantity").alias("n"),
        "created_by", "created_at")
    opening = t.stock.select("product_id", "variant_id", "quantity")
    led = stock_ledger(t, ops=ops, opening=opening, has_adjustments=False).select(
        "seq", "accepted", F.col("q_before").alias("stock_before"), F.col("q_after").alias("stock_after"))
    j = v.join(led, "seq", "left")
    reason = F.coalesce(F.col("reason"), F.when(F.col("accepted") == 0, F.lit("Insufficient stock")))
    return j.select("cart_id", "line_no", "product_id", "variant_id", "quantity", "unit_price",
                    reason.alias("reason"), F.when(reason.isNull(), F.lit(1)).otherwise(F.lit(0)).alias("line_ok"),
                    "stock_before", "stock_after")


def apply_sales_carts(line_results: DataFrame) -> DataFrame:
    """S13 per cart: accepted / rejected lines, accepted subtotal, outcome label."""
    a = line_results.groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("line_ok").cast("bigint").alias("accepted_lines"),
        F.sum(F.when(F.col("line_ok") == 1, F.col("quantity") * F.col("unit_price"))).alias("_sub"))
    status = (F.when(F.col("accepted_lines") == F.col("lines"), F.lit("completed"))
              .when(F.col("accepted_lines") == 0, F.lit("rejected")).otherwise(F.lit("partial")))
    return a.select("cart_id", "lines", "accepted_lines", (F.col("lines") - F.col("accepted_lines")).alias("rejected_lines"),
                    F.coalesce(F.col("_sub"), F.lit(0)).cast("double").alias("accepted_subtotal"), status.alias("outcome"))


def sale_replay_rows(line_results: DataFrame, headers: DataFrame) -> DataFrame:
    """S13 output: one ``sales`` row per cart with at least one accepted line.

    ``headers``: cart_id, sale_number, payment_method, cashier_id, customer_name,
    discount_amount, tax_amount, notes, created_at. Total = Σ accepted quantity × unit
    price − discount + tax (line mode: rejected lines are left out).
    """
    acc = line_results.filter(F.col("line_ok") == 1).groupBy("cart_id").agg(
        F.sum(F.col("quantity") * F.col("unit_price")).alias("_sub"))
    h = headers.join(acc, "cart_id", "inner")
    disc = F.coalesce(F.col("discount_amount"), F.lit(0))
    tax = F.coalesce(F.col("tax_amount"), F.lit(0))
    return h.select(F.col("cart_id").alias("id"), "sale_number",
                    (F.col("_sub") - disc + tax).cast("decimal(12,2)").alias("total_amount"),
                    tax.cast("decimal(12,2)").alias("tax_amount"), disc.cast("decimal(12,2)").alias("discount_amount"),
                    F.coalesce(F.col("payment_method"), F.lit("cash")).alias("payment_method"),
                    F.lit("completed").alias("status"), "cashier_id", "customer_name", "notes", "created_at")


def sale_replay_items(line_results: DataFrame) -> DataFrame:
    """S13 output: ``sale_items`` rows of the accepted lines (total = quantity × unit price)."""
    ok = line_results.filter(F.col("line_ok") == 1)
    return ok.select(F.col("cart_id").alias("sale_id"), "line_no", "product_id", "variant_id", "quantity",
                     "unit_price", (F.col("quantity") * F.col("unit_price")).cast("decimal(12,2)").alias("total_price"),
                     F.lit(0).cast("decimal(12,2)").alias("discount_amount"))


def sale_replay_movements(line_results: DataFrame, headers: DataFrame) -> DataFrame:
    """S13 output: ledger rows (``sale``, −quantity, before/after) of the accepted lines.

    A row is identified by its sale and line (``reference_id``, ``line_no``), which also order the rows.
    """
    ok = line_results.filter(F.col("line_ok") == 1)
    h = headers.select("cart_id", "sale_number", F.col("cashier_id").alias("created_by"), "created_at")
    j = ok.join(h, "cart_id", "left")
    return j.select("product_id", "variant_id", F.lit("sale").alias("movement_type"),
                    (-F.col("quantity")).alias("quantity_change"), F.col("stock_before").alias("quantity_before"),
                    F.col("stock_after").alias("quantity_after"), F.col("cart_id").alias("reference_id"), "line_no",
                    F.lit("sale").alias("reference_type"), F.concat(F.lit("Sale "), F.col("sale_number")).alias("notes"),
                    "created_by", "created_at")


def refund_outcomes(t: RetailTables, items: DataFrame, requests: DataFrame, request_lines: DataFrame) -> DataFrame:
    """One outcome row per refund request.

    ``items``: sale_id, line_no, product_id, variant_id, quantity. ``requests``:
    request_id (processing order), sale_id, reason. ``request_lines``: request_id,
    line_no — the items to refund; a request without lines refunds the whole sale (the
    reference's empty list). A request needs a completed sale; a full refund turns the
    sale to ``refunded`` so later requests for it fail; partial refunds leave it
    completed and may repeat (as in the reference). Unknown line numbers are ignored.
    Lines stay rows (no per-request arrays), so a large request is never one record.
    """
    sales = t.sales.select(F.col("id").alias("sale_id"), F.col("status").alias("status_before"), "notes")
    totals = items.groupBy("sale_id").agg(F.count(F.lit(1)).alias("total_items"))
    listed = request_lines.select("request_id", "line_no").distinct()
    n_listed = listed.groupBy("request_id").agg(F.count(F.lit(1)).alias("_asked"))
    matched = (listed.join(requests.select("request_id", "sale_id"), "request_id", "inner")
               .join(items.select("sale_id", "line_no"), ["sale_id", "line_no"], "left_semi")
               .groupBy("request_id").agg(F.count(F.lit(1)).alias("_n")))
    r = (requests.join(sales, "sale_id", "left").join(totals, "sale_id", "left")
         .join(n_listed, "request_id", "left").join(matched, "request_id", "left"))
    r = r.withColumn("total_items", F.coalesce(F.col("total_items"), F.lit(0).cast("bigint")))
    refunded = F.when(F.col("_asked").isNotNull(), F.coalesce(F.col("_n"), F.lit(0).cast("bigint"))
                      ).otherwise(F.col("total_items"))
    r = r.withColumn("refunded_items", refunded)
    r = r.withColumn("is_full", F.col("refunded_items") == F.col("total_items"))
    eligible = F.coalesce(F.col("status_before") == "completed", F.lit(False))
    first_full = (r.filter(eligible & F.col("is_full")).groupBy("sale_id")
                  .agg(F.min("request_id").alias("_first_full")))
    r = r.join(first_full, "sale_id", "left")
    accepted = eligible & (F.col("_first_full").isNull() | (F.col("request_id") <= F.col("_first_full")))
    return r.select(
        "request_id", "sale_id", accepted.cast("int").alias("accepted"),
        F.when(~eligible, F.lit("Sale not found or already refunded"))
         .when(~accepted, F.lit("Sale already refunded")).alias("error"),
        F.when(accepted, F.when(F.col("is_full"), F.lit("full")).otherwise(F.lit("partial"))).alias("refund_type"),
        F.when(accepted, F.col("refunded_items")).alias("refunded_items"), "total_items",
        F.when(accepted, F.concat(F.coalesce(F.col("notes"), F.lit("")), F.lit("\nRefund: "),
                                  F.coalesce(F.col("reason"), F.lit("No reason provided")))).alias("note_appended"),
        F.coalesce(F.col("reason"), F.lit("No reason provided")).alias("reason_text"))


def refund_return_ops(t: RetailTables, items: DataFrame, requests: DataFrame, request_lines: DataFrame,
                      outcomes: DataFrame) -> DataFrame:
    """``return`` ops for the items of accepted refunds that have a stock row (input to the ledger)."""
    acc = outcomes.filter(F.col("accepted") == 1).select("request_id", "sale_id")
    items = items.select("sale_id", "line_no", "product_id", "variant_id", "quantity")
    req = requests.select("request_id", "created_by", "created_at").join(acc, "request_id", "inner")
    has_lines = request_lines.select("request_id").distinct()
    whole = req.join(has_lines, "request_id", "left_anti").join(items, "sale_id", "inner")
    part = (req.join(request_lines.select("request_id", "line_no").distinct(), "request_id", "inner")
            .join(items, ["sale_id", "line_no"], "inner"))
    cols = ["request_id", "sale_id", "line_no", "product_id", "variant_id", "quantity", "created_by", "created_at"]
    both = whole.select(*cols).unionByName(part.select(*cols))
    stock_keys = _keyed(t.stock).select(*KEYS)
    both = _keyed(both).join(stock_keys, KEYS, "left_semi").drop("_vk")
    return _in_sequence(both, "request_id", "line_no").select(
        "seq", "request_id", "sale_id", "line_no", "product_id", "variant_id", F.lit("return").alias("op"),
        F.col("quantity").alias("n"), "created_by", "created_at")


def refund_movements(t: RetailTables, return_ops: DataFrame) -> DataFrame:
    """S14 output: the ledger rows of refunded lines; stock goes up, line by line in the order of the requests."""
    x = _keyed(return_ops).join(_keyed(t.stock).select(*KEYS, F.col("quantity").cast("bigint").alias("_open")), KEYS)
    x = keyed_scan(x, KEYS, "seq", F.col("n").cast("bigint"), "sum", "_so_far")
    after = F.col("_open") + F.col("_so_far")
    return x.select("request_id", F.col("sale_id").alias("reference_id"), "line_no", "product_id", "variant_id",
                    F.lit("return").alias("movement_type"), F.col("n").alias("quantity_change"),
                    (after - F.col("n")).alias("quantity_before"), after.alias("quantity_after"),
                    F.lit("refund").alias("reference_type"), "created_by", "created_at")


def sales_after_refunds(t: RetailTables, outcomes: DataFrame) -> DataFrame:
    """S14 output: the sales that accepted refunds touch: status, and the notes of all of them in order."""
    done = outcomes.filter(F.col("accepted") == 1)
    each = done.groupBy("sale_id").agg(
        F.max((F.col("refund_type") == "full").cast("int")).alias("full"),
        F.array_sort(F.collect_list(F.struct("request_id", "reason_text"))).alias("_notes"))
    s = t.sales.select("id", "sale_number", "status", "notes")
    j = each.join(s, each.sale_id == s.id)
    notes = F.concat(F.coalesce("notes", F.lit("")), F.array_join(F.transform(
        "_notes", lambda x: F.concat(F.lit("\nRefund: "), x["reason_text"])), ""))
    return j.select("id", "sale_number", F.when(F.col("full") == 1, "refunded").otherwise(F.col("status")).alias("status"),
                    notes.alias("notes"))


def stock_after_results(t: RetailTables, results: DataFrame) -> DataFrame:
    """Stock table after successful adjustments: last ``new_quantity`` per (product, variant) (L2 merge)."""
    last = (results.filter(F.col("status") == "success").groupBy("product_id", "variant_id")
            .agg(F.max_by("new_quantity", "seq").alias("_q")))
    s = _keyed(t.stock)
    j = s.join(_keyed(last).drop("variant_id"), KEYS, "left")
    return j.select("id", "product_id", "variant_id", F.coalesce(F.col("_q"), F.col("quantity")).alias("quantity"),
                    "reserved_quantity", "last_updated", "updated_by")


def _known_stocks(t: RetailTables) -> DataFrame:
    """The stocks that a line can be sold from: (KEYS, _times, _least), one row each.

    ``_times``: how often a line of that key comes out of its look-ups (once, unless products or stocks stand there more than once);
    ``_least``: the quantity at the start.
    """
    p = t.products.filter(F.col("is_active") == 1).groupBy(F.col("id").alias("product_id")).agg(
        F.count(F.lit(1)).alias("_p"), F.count("name").alias("_named")).filter("_named = _p")
    s = _keyed(t.stock).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_s"), F.min(F.col("quantity").cast("bigint")).alias("_least"))
    return s.join(p, "product_id").select(*KEYS, (F.col("_p") * F.col("_s")).alias("_times"), "_least")


def _needs(t: RetailTables, lines: DataFrame, known: DataFrame, fitting: bool) -> DataFrame:
    """What the carts without a refused line need: (cart_id, KEYS, _need, _open, _sold), _open the stock at the start.

    ``fitting``: without the carts that need more of a stock than it has at the start. A line is looked up by its key, then the lines go
    by carts; nothing else of them is read. Most such carts have a line that tells by itself; they are out before lines are added up.
    """
    x = _keyed(lines.filter(F.col("cart_id").isNotNull())).select("cart_id", *KEYS, "quantity").join(known.hint("shuffle_hash"), KEYS, "left")
    x = x.select("cart_id", *KEYS, (F.col("quantity") * F.col("_times")).alias("_need"), F.col("_times").isNull().alias("_refused"), "_least")
    if fitting:
        alone = F.when(F.col("_refused"), 2).when(F.col("_need") > F.col("_least"), 1).otherwise(0)
        told = x.select("cart_id", alone.alias("_alone"), "_need").filter("_alone > 0 or _need < 0").groupBy("cart_id").agg(
            F.max("_alone").alias("_alone"), F.min("_need").alias("_lowest"))
        # where a quantity is negative, a cart may need less than one of its lines
        told = told.filter("_alone = 2 or (_alone = 1 and _lowest >= 0)").select("cart_id")
        x = x.join(told.hint("shuffle_hash"), "cart_id", "left_anti")
    else:
        x = x.repartition("cart_id")
    need = x.groupBy("cart_id", *KEYS).agg(
        F.sum("_need").alias("_need"), F.max("_refused").alias("_refused"), F.min("_least").alias("_least"))
    out = F.col("_refused") | F.coalesce(F.col("_need") > F.col("_least"), F.lit(False)) if fitting else F.col("_refused")
    kept = need.withColumn("_out", F.max(out).over(Window.partitionBy("cart_id"))).filter(~F.col("_out"))
    stock = _keyed(t.stock).select(*KEYS, F.col("quantity").cast("bigint").alias("_open"))
    return kept.select("cart_id", *KEYS, "_need").join(stock, KEYS).withColumn("_sold", F.lit(0))


def _long_keys(rows: DataFrame) -> DataFrame | None:
    """The keys of more than ``WINDOW_ROWS`` rows, if there are any."""
    keys = rows.groupBy(*KEYS).count().filter(F.col("count") > WINDOW_ROWS).select(*KEYS).checkpoint(eager=True)
    return None if keys.isEmpty() else keys


def _running_sum(rows: DataFrame, long_keys: DataFrame | None, order: list[str], value: str, out: str, exclusive: bool = False) -> DataFrame:
    """``out``: the sum of ``value`` over a key's rows in ``order``. The rows of ``long_keys`` are scanned in chunks, others in a window."""
    so_far = Window.partitionBy(*KEYS).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if exclusive else Window.currentRow)

    def each(x: DataFrame) -> DataFrame:
        return x.withColumn(out, F.sum(value).over(so_far))
    if long_keys is None:
        return each(rows)
    return each(rows.join(long_keys, KEYS, "left_anti")).unionByName(
        keyed_scan(rows.join(long_keys, KEYS, "left_semi"), KEYS, order, value, "sum", out, exclusive=exclusive))


def _by_bounds(rows: DataFrame, long_keys: DataFrame | None) -> DataFrame:
    """The rows with what the bounds of the stock at their turn say: ``_fail`` (needs too much), ``_fit`` (fits in any case).

    Upper bound: ``_open``, what the carts accepted so far have left; lower bound: less the needs of all earlier ones that are open.
    Carts sold already are not judged.
    """
    x = _running_sum(rows, long_keys, ["cart_id"], "_need", "_before", exclusive=True)
    lower = F.col("_open") - F.coalesce(F.col("_before"), F.lit(0))
    judged = F.col("_sold") == 0
    return x.select(*rows.columns, F.when(judged, (F.col("_need") > F.col("_open")).cast("int")).alias("_fail"),
                    F.when(judged, (F.col("_need") <= lower).cast("int")).alias("_fit"))


def _decided(rows: DataFrame, long_keys: DataFrame | None) -> DataFrame:
    """One round: the rows with the ``status`` of their cart (rejected, accepted, or NULL: open)."""
    cart = Window.partitionBy("cart_id")
    x = _by_bounds(rows, long_keys).withColumns({"_fail": F.max("_fail").over(cart), "_fit": F.min("_fit").over(cart)})
    return x.select(*rows.columns, F.when(F.col("_fail") == 1, "rejected").when(F.col("_fit") == 1, "accepted").alias("status"))


def _left_open(done: DataFrame, long_keys: DataFrame | None) -> DataFrame:
    """The rows of ``_decided`` that go into the next round, with their keys' stock less what the carts accepted in this round take.

    An accepted cart fits even after all earlier open ones, so these fit its keys either way: its needs may come off the stock
    of earlier and later carts alike. Sold needs without a quantity stay as rows: from there on the key's stock is unknown.
    The rows stay with their keys in the order of the next round's prefix sums: one shuffle and one sort do for both.
    """
    x, takes = done.filter("status is null or status = 'accepted'"), F.when(F.col("status") == "accepted", F.col("_need"))
    if long_keys is None:
        key = Window.partitionBy(*KEYS).orderBy("cart_id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        x = x.withColumn("_taken", F.sum(takes).over(key))
    else:
        x = x.join(x.groupBy(*KEYS).agg(F.sum(takes).alias("_taken")), KEYS, "left")
    x = x.filter("status is null or _need is null").withColumns({
        "_open": F.col("_open") - F.coalesce("_taken", F.lit(0)), "_sold": F.when(F.col("status") == "accepted", 1).otherwise(F.col("_sold"))})
    x = x.drop("status", "_taken")
    return x if long_keys is None else x.checkpoint(eager=True)


def _one_by_one(rows: DataFrame, group: Column) -> DataFrame:
    """The open carts of ``rows``, each group's in order in one task: (cart_id, status)."""
    x = rows.select(group.alias("grp"), "cart_id", F.concat_ws(":", *KEYS).alias("k"), F.col("_need").alias("need"),
                    F.col("_open").alias("open"), F.col("_sold").alias("sold"))
    return x.repartition("grp").sortWithinPartitions("grp", "cart_id").mapInPandas(folds.settle_carts, "cart_id long, status string")


def _accepted_one_by_one(rows: DataFrame, group: Column) -> DataFrame:
    return _one_by_one(rows, group).filter("status = 'accepted'").select("cart_id").checkpoint(eager=True)


def _sizes(rows: DataFrame) -> tuple[int, int, int]:
    """How many rows there are, how many of them have no ``_need``, and how many the key with the most has."""
    keys = rows.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("_n"), F.count("_need").alias("_told"))
    n, told, longest = keys.agg(F.sum("_n"), F.sum("_told"), F.max("_n")).first()
    return n or 0, (n or 0) - (told or 0), longest or 0


def _sold_carts(t: RetailTables, lines: DataFrame, known: DataFrame) -> DataFrame:
    """(cart_id) of the accepted carts, each once; see ``apply_sales_exact``."""
    many = lines.count() > FIT_GROUPS * GROUP_ROWS
    rows = _needs(t, lines, known, fitting=many).checkpoint(eager=True)
    n, unknown, longest = _sizes(rows)
    if many and unknown:  # what becomes of a cart with a need that is not known hangs on all others'
        rows = _needs(t, lines, known, fitting=False).checkpoint(eager=True)
        n, unknown, longest = _sizes(rows)
    decided, long_keys = [], _long_keys(rows) if longest > WINDOW_ROWS else None
    left, split = [n], False
    while True:
        done = _decided(rows, long_keys).checkpoint(eager=True)
        decided.append(done.filter("status = 'accepted'").select("cart_id"))
        left.append(done.filter("status is null and _sold = 0").count())
        rows = _left_open(done, long_keys)
        if left[-1] <= GROUP_ROWS:
            if left[-1]:
                decided.append(_accepted_one_by_one(rows, F.lit(0)))
            return reduce(DataFrame.unionByName, decided).distinct().checkpoint(eager=True)
        slow = len(left) > SLOW_ROUNDS and left[-1] > left[-1 - SLOW_ROUNDS] * SLOW_SHARE
        if not slow and (split or left[-1] > GRAPH_GROUPS * GROUP_ROWS):
            continue
        split, rows = True, rows.checkpoint(eager=True)
        # what one cart does to another goes through the keys they share: the components are independent
        key = F.concat_ws(":", F.lit("k"), *KEYS)
        links = rows.filter("_sold = 0").select(F.concat_ws(":", F.lit("c"), "cart_id").alias("a"), key.alias("b"))
        groups = components(links, "a", "b").filter(F.col("node").startswith("k:"))
        rows = rows.join(groups.select(F.col("node").alias("_key"), F.col("root").alias("_group")), key == F.col("_key")).drop("_key")
        size = rows.groupBy("_group").agg(F.count(F.lit(1)).alias("_size"))
        rows = rows.join(size, "_group").checkpoint(eager=True)
        decided.append(_accepted_one_by_one(rows.filter(F.col("_size") <= GROUP_ROWS), F.col("_group")))
        rows = rows.filter(F.col("_size") > GROUP_ROWS).drop("_group", "_size").checkpoint(eager=True)
        left = [rows.filter("_sold = 0").count()]


def apply_sales_exact(t: RetailTables, lines: DataFrame) -> DataFrame:
    """S13, which carts are sold: a cart is all-or-nothing, carts are processed in the order of their ids.

    A cart fits when, for each (product, variant), its total quantity ``need`` is at most the stock at its turn. Static
    failures (unknown/inactive product, no stock row) reject a cart up front, and in large jobs so do needs above the stock at the start. Only
    sales are involved, so bounds of that stock (``_by_bounds``: prefix sums over the carts, no Python) decide most
    carts at once, and more each round (``_decided``), as they know more. Decided carts leave the rows (``_left_open``). When up to ``GROUP_ROWS`` rows are open, these carts are settled in order
    (``_one_by_one``). Where the rounds decide little, or hardly more rows are open than that, the open carts and the keys they contest are taken as a graph: its components do
    not touch each other and are settled at the same time, each one in order; a component of more than ``GROUP_ROWS`` rows goes
    through the bounds again and falls apart; the earliest open cart is always decided. Returns cart_id, status (accepted / rejected).
    """
    carts = lines.filter(F.col("cart_id").isNotNull()).select("cart_id").distinct()
    checkpoint_dir(t.spark)
    sold = _sold_carts(t, lines, _known_stocks(t)).withColumn("status", F.lit("accepted"))
    return carts.join(sold, "cart_id", "left").select("cart_id", F.coalesce("status", F.lit("rejected")).alias("status"))


def post_sales(t: RetailTables, lines: DataFrame, lines_of: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One row per line with its cart's outcome and, for sold carts, the stock before and after the line.

    ``lines`` as for ``apply_sales``; cashier and time are not read. ``lines_of``: gives the ``lines`` of some carts (cart_id, each once) for less than it
    takes to make all. Feeds ``sale_replay_rows`` / ``_items`` / ``_movements``, ``stock_after_sales`` and
    ``alerts_after_sales``; a refused cart leaves nothing in any of them.
    """
    checkpoint_dir(t.spark)
    known = _known_stocks(t).checkpoint(eager=True)
    carts = _sold_carts(t, lines, known)
    sold = _keyed(lines_of(carts) if lines_of else lines.join(carts, "cart_id", "left_semi")).join(known.select(*KEYS, "_times"), KEYS)
    sold = sold.withColumns({"_copy": F.explode(F.sequence(F.lit(1), "_times")), "_n": F.col("quantity").cast("bigint")}).checkpoint(eager=True)
    sold = _running_sum(sold, _long_keys(sold), ["cart_id", "line_no"], "_n", "_so_far")
    stock = _keyed(t.stock).select(*KEYS, F.col("quantity").cast("bigint").alias("_open"))
    after = F.col("_open") - F.col("_so_far")
    sold = sold.join(stock, KEYS).select(
        "cart_id", "line_no", "product_id", "variant_id", "quantity", "unit_price", F.lit(None).cast("string").alias("reason"),
        F.lit(1).alias("line_ok"), (after + F.col("quantity")).alias("stock_before"), after.alias("stock_after")).checkpoint(eager=True)
    none = F.lit(None).cast("bigint")
    refused = _validate_stock_requests(t, lines.filter(F.col("cart_id").isNotNull()).join(carts, "cart_id", "left_anti")).select(
        "cart_id", "line_no", "product_id", "variant_id", "quantity", "unit_price",
        F.coalesce("reason", F.lit("Cart refused")).alias("reason"), F.lit(0).alias("line_ok"), none.alias("stock_before"),
        none.alias("stock_after"))
    return sold.unionByName(refused)


def stock_after_sales(t: RetailTables, posted: DataFrame) -> DataFrame:
    """S13 output: the stock table after the sold lines."""
    less = _keyed(posted.filter(F.col("line_ok") == 1)).groupBy(*KEYS).agg(F.sum("quantity").alias("_less"))
    j = _keyed(t.stock).join(less, KEYS, "left")
    return j.select("id", "product_id", "variant_id", (F.col("quantity") - F.coalesce("_less", F.lit(0))).alias("quantity"),
                    "reserved_quantity")


def active_alert_keys(t: RetailTables) -> DataFrame:
    """The stocks with an active alert."""
    return _keyed(t.low_stock_alerts.filter(F.col("alert_status") == "active")).select(*KEYS)


def alerts_after_sales(t: RetailTables, posted: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """S13 output: alerts the sold lines raise: the first line that leaves a stock at or below its product's
    minimum, for stocks without an active alert (``active``: those of ``active_alert_keys``). Stock only falls here, so there is one
    at most."""
    p = t.products.select(F.col("id").alias("product_id"), "min_stock_level")
    low = _keyed(posted.filter(F.col("line_ok") == 1).join(p, "product_id")).filter(F.col("stock_after") <= F.col("min_stock_level"))
    first = low.groupBy(*KEYS, "variant_id", "min_stock_level").agg(
        F.min(F.struct("cart_id", "line_no", "stock_after")).alias("x"))
    active = active_alert_keys(t) if active is None else active
    return first.join(active, KEYS, "left_anti").select(
        "product_id", "variant_id", F.col("x.stock_after").alias("current_stock"), "min_stock_level",
        F.lit("active").alias("alert_status"), F.col("x.cart_id").alias("sale_id"), F.col("x.line_no").alias("line_no"))
