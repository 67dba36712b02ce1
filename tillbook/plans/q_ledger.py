"""Registered ledger queries (L1–L4) and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.operators import ledger as L
from tillbook.oracle.ledger_sql import ALERTS_CTES, LEDGER_CTES, MOVEMENTS_CTES, ledger_ctes
from tillbook.oracle.views_sql import with_views
from tillbook.plans.registry import register

LEDGER_COLS = ("seq, product_id, variant_id, op, n, q_before, q_after, CAST(q_after - q_before AS INTEGER) AS q_change, "
               "accepted, created_by, created_at")

register("stock_ledger", lambda t: L.stock_ledger(t), with_views(f"SELECT {LEDGER_COLS} FROM ledger", "stock_ops",
                                                                 extra=LEDGER_CTES),
         "L1: every stock op folded per product (opening 0), rejected sales flagged")


def _adjust_only(t):
    return L.stock_ledger_adjust_only(t, ops=t.stock_ops.filter(F.col("op") != "sale"))


register("stock_ledger_adjust_only", _adjust_only, with_views(
    f"SELECT {LEDGER_COLS} FROM ledger", "stock_ops",
    extra={"ops_adj": "SELECT * FROM stock_ops WHERE op <> 'sale'", **ledger_ctes("ops_adj")}),
    "L1w: the same fold without sales, in window form")
register("stock_movements", lambda t: L.movements_from_ledger(t.ledger), with_views("SELECT * FROM stock_movements", "stock_ops",
                                                                    extra=MOVEMENTS_CTES),
         "accepted ledger rows as the movements table")
register("stock_on_hand", lambda t: L.stock_on_hand(t.ledger), with_views("""
    SELECT product_id, variant_id, arg_max(q_after, seq) AS quantity, MAX(created_at) AS last_updated
    FROM ledger GROUP BY product_id, variant_id""", "stock_ops", extra=LEDGER_CTES), "L2")
register("low_stock_alerts", lambda t: L.alerts_table(L.low_stock_alert_events(t)), with_views("SELECT * FROM low_stock_alerts",
                                                                      "stock_ops", "products", extra=ALERTS_CTES),
         "L3: alerts raised/resolved along the ledger, minimum from the product")
register("ledger_consistency", lambda t: L.ledger_consistency(t.stock_movements, stock=t.stock), with_views("""
    SELECT 'before_plus_change' AS "check", COUNT(*) AS violations FROM stock_movements
    WHERE quantity_before + quantity_change <> quantity_after
    UNION ALL
    SELECT 'after_equals_next_before', COUNT(*) FROM (
        SELECT quantity_after, LEAD(quantity_before) OVER (PARTITION BY product_id, variant_id ORDER BY id) AS nb
        FROM stock_movements) WHERE nb IS NOT NULL AND nb <> quantity_after
    UNION ALL
    SELECT 'last_after_equals_stock', COUNT(*) FROM (
        SELECT product_id, variant_id, arg_max(quantity_after, id) AS q FROM stock_movements GROUP BY product_id, variant_id) l
    JOIN stock s ON s.product_id = l.product_id AND s.variant_id IS NOT DISTINCT FROM l.variant_id WHERE s.quantity <> l.q""",
    "stock", "stock_ops", extra=MOVEMENTS_CTES), "L4")

# Streaming twins: for events in sequence order the stream equals the batch fold, so the
# batch oracle applies.
from tillbook.oracle.ledger_sql import ALERTS_CTES as _AC  # noqa: E402
from tillbook.streaming import ledger_stream as LS  # noqa: E402

register("stream_stock_ledger", lambda t: LS.stream_stock_ledger(t),
         with_views(f"SELECT {LEDGER_COLS} FROM ledger", "stock_ops", extra=LEDGER_CTES),
         "L1 as Structured Streaming (applyInPandasWithState, availableNow)")
register("stream_low_stock_alerts", lambda t: LS.stream_low_stock_alerts(t),
         with_views("""SELECT seq, product_id, variant_id, op, q_after, min_level, event, created_by, created_at
                       FROM alert_ev WHERE event IS NOT NULL""", "stock_ops", "products", extra=_AC),
         "L3 as Structured Streaming")
register("stream_alert_table", lambda t: LS.stream_alert_table(t), with_views("SELECT * FROM low_stock_alerts", "stock_ops", "products", extra=_AC),
         "L3: the alert table kept by the stream (foreachBatch merges into snapshots)")
register("stream_reordered_ledger", lambda t: LS.stream_reordered_ledger(t),
         with_views(f"SELECT {LEDGER_COLS} FROM ledger", "stock_ops", extra=LEDGER_CTES),
         "L1 from a log whose files come in the wrong order (transformWithState: rows wait in state until they are due)")
