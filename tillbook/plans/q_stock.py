"""Registered stock queries and change jobs (K1–K10, S13, S14) with oracle SQL."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor

from pyspark.util import inheritable_thread_target

from tillbook.operators import changes as X
from tillbook.operators import stock as K
from tillbook.oracle.carts_sql import carts_ctes
from tillbook.oracle.ledger_sql import ALERTS_CTES, MOVEMENTS_CTES, ledger_ctes
from tillbook.oracle.views_sql import with_views
from tillbook.plans.registry import register
from tillbook.session import checkpoint_dir
from tillbook.sources import standins as SI



def _levels_sql(where: str, limit: int, offset: int) -> str:
    """Each active product's label first, then the rows whose place in the order falls on the page."""
    return with_views(f"""
        SELECT * EXCLUDE (place, barcode, label),
               CASE label WHEN 0 THEN 'out_of_stock' WHEN 1 THEN 'low_stock' ELSE 'in_stock' END AS stock_status
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY is_low_stock DESC, quantity ASC NULLS FIRST, name ASC NULLS FIRST, id) AS place
              FROM labelled WHERE {where})
        WHERE place > {offset} AND place <= {offset + limit}""", "products", "categories", "stock", extra={
            "held": """SELECT p.id, p.sku, p.name, p.barcode, CAST(p.price AS DOUBLE) AS price, p.min_stock_level, p.unit_size,
                              (SELECT c.name FROM categories c WHERE c.id = p.category_id) AS category_name,
                              b.quantity, b.reserved_quantity, b.quantity - b.reserved_quantity AS available_quantity,
                              b.last_updated
                       FROM products p LEFT JOIN (SELECT * FROM stock WHERE variant_id IS NULL) b ON b.product_id = p.id
                       WHERE p.is_active = 1""",
            "labelled": """SELECT *, if(label < 2, 1, 0) AS is_low_stock
                           FROM (SELECT *, if(quantity = 0, 0, if(quantity <= min_stock_level, 1, 2)) AS label FROM held)"""})


LEVEL_FILTER_SQL = "label < 2 AND contains(lower(concat_ws(chr(10), name, sku, barcode)), 'ring')"
register("stock_levels", lambda t: K.stock_levels(t), _levels_sql("TRUE", 50, 0), "K1 first page")
register("stock_levels_filtered", lambda t: K.stock_levels(t, low_stock_only=True, search="RING", page=2, limit=10),
         _levels_sql(LEVEL_FILTER_SQL, 10, 10), "K1 low-stock search, second page")
register("stock_levels_count", lambda t: K.stock_levels_count(t, low_stock_only=True, search="RING", limit=10),
         with_views(f"""
    SELECT COUNT(*) AS total, 10 AS per_page, CAST(ceil(COUNT(*) / 10.0) AS BIGINT) AS total_pages
    FROM products p, stock s
    WHERE p.id = s.product_id AND s.variant_id IS NULL AND p.is_active = 1 AND s.quantity <= p.min_stock_level
      AND contains(lower(concat_ws(chr(10), p.name, p.sku, p.barcode)), 'ring')""", "products", "stock"), "K2")


def _movements_sql(where: str, limit: int, offset: int) -> str:
    return with_views(f"""
        SELECT m.*, p.name AS product_name, p.sku, pv.variant_name, pv.variant_value,
               u.first_name || ' ' || u.last_name AS created_by_name
        FROM (SELECT * FROM stock_movements WHERE {where} ORDER BY created_at DESC, id DESC
              LIMIT {limit} OFFSET {offset}) m
        LEFT JOIN products p ON m.product_id = p.id LEFT JOIN product_variants pv ON m.variant_id = pv.id
        LEFT JOIN users u ON m.created_by = u.id""",
        "products", "product_variants", "users", "stock_ops", extra=MOVEMENTS_CTES)


MOVE_FILTER = dict(movement_type="sale", date_from="2024-01-10", date_to="2024-01-20")
MOVE_FILTER_SQL = ("movement_type = 'sale' AND created_at >= TIMESTAMP '2024-01-10 00:00:00' "
                   "AND created_at < TIMESTAMP '2024-01-21 00:00:00'")
register("movement_history", lambda t: K.movement_history(t), _movements_sql("TRUE", 50, 0), "K4 first page")
register("movement_history_filtered", lambda t: K.movement_history(t, page=2, limit=20, **MOVE_FILTER),
         _movements_sql(MOVE_FILTER_SQL, 20, 20), "K4 sales of 10–20 Jan, second page")
register("movement_count", lambda t: K.movement_count(t, limit=20, **MOVE_FILTER), with_views(f"""
    SELECT COUNT(*) AS total, 20 AS per_page, CAST(ceil(COUNT(*) / 20.0) AS BIGINT) AS total_pages
    FROM stock_movements WHERE {MOVE_FILTER_SQL}""", "stock_ops", extra=MOVEMENTS_CTES), "K5")


def _alerts_sql(status: str, table: str = "low_stock_alerts", extra=None) -> str:
    return with_views(f"""
        SELECT a.*, p.* EXCLUDE (pid), v.* EXCLUDE (vid),
               (SELECT concat_ws(' ', first_name, last_name) FROM users WHERE id = a.acknowledged_by) AS acknowledged_by_name
        FROM (FROM {table} WHERE alert_status = '{status}') a
        JOIN (SELECT id AS pid, name AS product_name, sku, unit_size,
                     (SELECT c.name FROM categories c WHERE c.id = category_id) AS category_name
              FROM products WHERE is_active = 1) p ON p.pid = a.product_id
        LEFT JOIN (SELECT id AS vid, variant_name, variant_value FROM product_variants) v ON v.vid = a.variant_id""",
        "products", "categories", "product_variants", "users", "stock_ops", extra=extra or ALERTS_CTES)


register("alerts_by_status", lambda t: K.alerts_by_status(t, "active"), _alerts_sql("active"), "K8 active")
register("alerts_resolved", lambda t: K.alerts_by_status(t, "resolved"), _alerts_sql("resolved"), "K8 resolved")

ACKS_SQL = ("SELECT id AS alert_id, product_id % 25 AS user_id, created_at + INTERVAL 1 HOUR AS ack_at "
            "FROM low_stock_alerts")
ACKED_SQL = """
    SELECT a.id, a.product_id, a.variant_id, a.current_stock, a.min_stock_level,
           CASE WHEN f.alert_id IS NOT NULL AND a.alert_status = 'active' THEN 'acknowledged' ELSE a.alert_status END
             AS alert_status,
           CASE WHEN f.alert_id IS NOT NULL AND a.alert_status = 'active' THEN f.user_id ELSE a.acknowledged_by END
             AS acknowledged_by,
           CASE WHEN f.alert_id IS NOT NULL AND a.alert_status = 'active' THEN f.ack_at ELSE a.acknowledged_at END
             AS acknowledged_at,
           a.created_at
    FROM low_stock_alerts a LEFT JOIN (
        SELECT alert_id, first(user_id ORDER BY ack_at, user_id) AS user_id, MIN(ack_at) AS ack_at FROM acks GROUP BY alert_id
    ) f ON f.alert_id = a.id"""


def _acked(t):
    return X.acknowledge_alerts(t.low_stock_alerts, SI.alert_acks(t))


register("acknowledge_alerts", _acked, with_views("SELECT * FROM acked", "products", "stock_ops",
                                                  extra={**ALERTS_CTES, "acks": ACKS_SQL, "acked": ACKED_SQL}),
         "K9: one ack per alert; only active ones change")
register("alerts_acknowledged", lambda t: K.alerts_by_status(t, "acknowledged", alerts=_acked(t)),
         _alerts_sql("acknowledged", "acked", {**ALERTS_CTES, "acks": ACKS_SQL, "acked": ACKED_SQL}),
         "K8 over the acknowledged alerts")

ADJ_VALIDATE = """
    SELECT r.*, p.name AS product_name,
           CASE WHEN r.op NOT IN ('in', 'out', 'adjustment') OR r.n IS NULL OR r.n < {minq} THEN 'Validation failed'
                WHEN p.id IS NULL THEN 'Product not found'
                WHEN s.id IS NULL THEN 'Stock record not found' END AS reason
    FROM (SELECT * FROM stock_ops WHERE op IN ('in', 'out', 'adjustment')) r
    LEFT JOIN products p ON p.id = r.product_id AND p.is_active = 1
    LEFT JOIN stock s ON s.product_id = r.product_id AND s.variant_id IS NOT DISTINCT FROM r.variant_id"""


def _adjust_ctes(minq: int) -> dict[str, str]:
    return {"adj_val": ADJ_VALIDATE.format(minq=minq),
            "adj_ok": "SELECT seq, product_id, variant_id, op, n, created_by, created_at FROM adj_val WHERE reason IS NULL",
            **ledger_ctes("adj_ok", opening="stock")}


ADJ_RESULTS = """
    SELECT v.seq, v.product_id, v.variant_id, v.product_name, v.op AS adjustment_type,
           CASE WHEN v.reason IS NULL THEN 'success' ELSE 'failed' END AS status, v.reason AS error,
           CAST(l.q_after - l.q_before AS INTEGER) AS quantity_change, l.q_before AS previous_quantity,
           l.q_after AS new_quantity
    FROM adj_val v LEFT JOIN ledger l ON l.seq = v.seq"""

register("stock_adjust", lambda t: X.adjust_results(t, SI.adjustment_requests(t), min_quantity=1),
         with_views(ADJ_RESULTS, "products", "stock", "stock_ops", extra=_adjust_ctes(1)),
         "K6: every in/out/adjustment op as a single adjust request (quantity ≥ 1)")
register("bulk_adjust", lambda t: X.adjust_summary(X.adjust_results(t, SI.adjustment_requests(t))),
         with_views("""SELECT COUNT(*) AS total, COUNT(CASE WHEN reason IS NULL THEN 1 END) AS successful,
                              COUNT(CASE WHEN reason IS NOT NULL THEN 1 END) AS failed FROM adj_val""",
                    "products", "stock", "stock_ops", extra=_adjust_ctes(0)), "K7 summary")


def _after_adjust(t):
    res = X.adjust_results(t, SI.adjustment_requests(t))
    return K.stock_after_adjust(t, X.stock_after_results(t, res))


register("stock_after_adjust", _after_adjust, with_views("""
    SELECT s.product_id, s.variant_id, p.name AS product_name, p.sku, COALESCE(h.q, s.quantity) AS quantity,
           s.reserved_quantity, COALESCE(h.q, s.quantity) - s.reserved_quantity AS available_quantity,
           CASE WHEN COALESCE(h.q, s.quantity) <= p.min_stock_level THEN 1 ELSE 0 END AS is_low_stock
    FROM stock s JOIN products p ON s.product_id = p.id
    LEFT JOIN (SELECT product_id, variant_id, arg_max(q_after, seq) AS q FROM ledger GROUP BY product_id, variant_id) h
      ON h.product_id = s.product_id AND h.variant_id IS NOT DISTINCT FROM s.variant_id""",
    "products", "stock", "stock_ops", extra=_adjust_ctes(0)), "K10 after the bulk adjustment (L2 merge)")


def _adjusted(t, least, make):
    reqs = SI.adjustment_requests(t)
    return make(X.adjust_movements(reqs, X.adjust_results(t, reqs, min_quantity=least)))


def _adjusted_ctes(least: int) -> dict[str, str]:
    """The adjustments' ledger as ``adj_ledger`` and their alert events as ``adj_ev``, beside the alerts there were."""
    own = _adjust_ctes(least)
    return {**ALERTS_CTES, "adj_val": own["adj_val"], "adj_ok": own["adj_ok"], "adj_n": own["ops_n"],
            "adj_ledger": own["ledger"].replace("ops_n", "adj_n"),
            "adj_ev": """
                SELECT *, CASE WHEN low = 1 AND before = 0 THEN 'raise' WHEN low = 0 AND before = 1 THEN 'resolve' END AS event
                FROM (SELECT *, COALESCE(LAG(low) OVER (PARTITION BY product_id, variant_id ORDER BY seq), was) AS before
                      FROM (SELECT l.*, p.min_stock_level AS min_level, CAST(l.q_after <= p.min_stock_level AS INTEGER) AS low,
                                   CAST(EXISTS (SELECT 1 FROM low_stock_alerts a WHERE a.alert_status = 'active'
                                                AND a.product_id = l.product_id AND a.variant_id IS NOT DISTINCT FROM l.variant_id) AS INTEGER) AS was
                            FROM adj_ledger l JOIN products p ON p.id = l.product_id))"""}


ADJUST_VIEWS = ("products", "stock", "stock_ops")
for _least, _name in ((1, "stock_adjust"), (0, "bulk_adjust")):
    _row = "K6" if _least else "K7"
    register(f"{_name}_movements", lambda t, n=_least: _adjusted(t, n, lambda m: m), with_views("""
        SELECT seq, product_id, variant_id, op AS movement_type, CAST(q_after - q_before AS INTEGER) AS quantity_change,
               q_before AS quantity_before, q_after AS quantity_after, created_by, created_at FROM adj_ledger""",
        *ADJUST_VIEWS, extra=_adjusted_ctes(_least)), f"{_row}: the ledger rows of the adjustments")
    register(f"{_name}_alert_events", lambda t, n=_least: _adjusted(t, n, lambda m: X.adjust_alert_events(t, m)), with_views("""
        SELECT seq, product_id, variant_id, op, q_after, min_level, event, created_by, created_at FROM adj_ev WHERE event IS NOT NULL""",
        *ADJUST_VIEWS, extra=_adjusted_ctes(_least)), f"{_row}: alerts the adjustments raise and resolve")
    register(f"{_name}_alerts", lambda t, n=_least: _adjusted(t, n, lambda m: X.alerts_after_adjust(t, X.adjust_alert_events(t, m))), with_views("""
        SELECT a.id, a.product_id, a.variant_id, a.current_stock, a.min_stock_level,
               CASE WHEN a.alert_status = 'active' AND EXISTS (
                        SELECT 1 FROM adj_ev e WHERE e.event = 'resolve' AND e.product_id = a.product_id
                        AND e.variant_id IS NOT DISTINCT FROM a.variant_id) THEN 'resolved' ELSE a.alert_status END AS alert_status,
               CAST(NULL AS BIGINT) AS raised_by
        FROM low_stock_alerts a
        UNION ALL
        SELECT NULL, e.product_id, e.variant_id, e.q_after, e.min_level,
               CASE WHEN e.seq = MAX(e.seq) OVER (PARTITION BY e.product_id, e.variant_id) THEN 'active' ELSE 'resolved' END AS alert_status, e.seq
        FROM adj_ev e WHERE e.event IS NOT NULL QUALIFY e.event = 'raise'""",
        *ADJUST_VIEWS, extra=_adjusted_ctes(_least)), f"{_row}: the alert table after the adjustments")

ITEMS_SQL = """
    SELECT l_orderkey AS sale_id, CAST(ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity,
                                       l_extendedprice, l_returnflag, l_shipdate) AS INTEGER) AS line_no,
           l_partkey AS product_id, CAST(NULL AS BIGINT) AS variant_id, CAST(floor(l_quantity) AS INTEGER) AS quantity,
           CAST(CAST((CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) * 2 + CAST(floor(l_quantity) AS INTEGER))
                // (2 * CAST(floor(l_quantity) AS INTEGER)) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(12,2))
             AS unit_price, l_returnflag, l_shipdate
    FROM lineitem"""
CART_LINES_SQL = f"""
    SELECT i.sale_id AS cart_id, i.line_no, ROW_NUMBER() OVER (ORDER BY i.sale_id, i.line_no) AS seq, i.product_id, i.variant_id,
           i.quantity, i.unit_price, s.cashier_id AS created_by, s.created_at
    FROM ({ITEMS_SQL}) i LEFT JOIN sales s ON s.id = i.sale_id"""
CART_VAL = """
    SELECT l.*, CASE WHEN p.id IS NULL THEN 'Product not found' WHEN st.id IS NULL THEN 'Stock record not found' END
             AS reason
    FROM cart_lines l LEFT JOIN products p ON p.id = l.product_id AND p.is_active = 1
    LEFT JOIN stock st ON st.product_id = l.product_id AND st.variant_id IS NOT DISTINCT FROM l.variant_id"""
register("apply_sales", lambda t: X.apply_sales_carts(X.apply_sales(t, SI.cart_lines(t))), with_views("""
    SELECT cart_id, COUNT(*) AS lines, CAST(SUM(line_ok) AS BIGINT) AS accepted_lines,
           COUNT(*) - CAST(SUM(line_ok) AS BIGINT) AS rejected_lines,
           CAST(COALESCE(SUM(CASE WHEN line_ok = 1 THEN quantity * unit_price END), 0) AS DOUBLE) AS accepted_subtotal,
           CASE WHEN SUM(line_ok) = COUNT(*) THEN 'completed' WHEN SUM(line_ok) = 0 THEN 'rejected' ELSE 'partial' END
             AS outcome
    FROM (SELECT v.*, CASE WHEN COALESCE(v.reason, CASE WHEN l.accepted = 0 THEN 'Insufficient stock' END) IS NULL
                           THEN 1 ELSE 0 END AS line_ok
          FROM cart_val v LEFT JOIN ledger l ON l.seq = v.seq)
    GROUP BY cart_id""", "sale_items", "sales", "products", "stock", extra={
    "cart_lines": CART_LINES_SQL, "cart_val": CART_VAL,
    "sale_ops": "SELECT seq, product_id, variant_id, 'sale' AS op, quantity AS n, created_by, created_at "
                "FROM cart_val WHERE reason IS NULL",
    **ledger_ctes("sale_ops", opening="stock")}),
    "S13: every sale's lines replayed against the stock table in sale-id order (line mode)")


def _replay_movements(t):
    lines = X.apply_sales(t, SI.cart_lines(t))
    return X.sale_replay_movements(lines, SI.cart_headers(t))


register("apply_sales_movements", _replay_movements, with_views("""
    SELECT v.product_id, v.variant_id, 'sale' AS movement_type, -v.quantity AS quantity_change,
           l.q_before AS quantity_before, l.q_after AS quantity_after, v.cart_id AS reference_id, v.line_no,
           'sale' AS reference_type, 'Sale ' || s.sale_number AS notes, s.cashier_id AS created_by, s.created_at
    FROM cart_val v JOIN ledger l ON l.seq = v.seq AND l.accepted = 1 LEFT JOIN sales s ON s.id = v.cart_id
    WHERE v.reason IS NULL""", "sale_items", "sales", "products", "stock", extra={
    "cart_lines": CART_LINES_SQL, "cart_val": CART_VAL,
    "sale_ops": "SELECT seq, product_id, variant_id, 'sale' AS op, quantity AS n, created_by, created_at "
                "FROM cart_val WHERE reason IS NULL",
    **ledger_ctes("sale_ops", opening="stock")}), "S13 ledger rows of the accepted replayed lines")


def _refunds(t):
    req, req_lines = SI.refund_requests(t)
    return X.refund_outcomes(t, t.sale_lines, req, req_lines)


REFUND_CTES = {
    "items_l": ITEMS_SQL,
    "requests": """SELECT sale_id AS request_id, sale_id, 'returned items' AS reason, MAX(l_shipdate) AS created_at
                   FROM items_l WHERE l_returnflag = 'R' GROUP BY sale_id""",
    "rlines": "SELECT DISTINCT sale_id AS request_id, line_no FROM items_l WHERE l_returnflag = 'R'",
    "r1": """SELECT q.*, s.status AS status_before, s.notes, COALESCE(tt.total_items, 0) AS total_items,
                    COALESCE(s.status = 'completed', FALSE) AS eligible
             FROM requests q LEFT JOIN sales s ON s.id = q.sale_id
             LEFT JOIN (SELECT sale_id, COUNT(*) AS total_items FROM items_l GROUP BY sale_id) tt ON tt.sale_id = q.sale_id""",
    "na": "SELECT request_id, COUNT(*) AS asked FROM rlines GROUP BY request_id",
    "nl": """SELECT x.request_id, COUNT(*) AS n
             FROM rlines x JOIN requests q ON q.request_id = x.request_id
             WHERE EXISTS (SELECT 1 FROM items_l i WHERE i.sale_id = q.sale_id AND i.line_no = x.line_no)
             GROUP BY x.request_id""",
    "r3": """SELECT r1.*, CASE WHEN na.asked IS NOT NULL THEN COALESCE(nl.n, 0) ELSE total_items END AS refunded_items,
                    (CASE WHEN na.asked IS NOT NULL THEN COALESCE(nl.n, 0) ELSE total_items END) = total_items AS is_full
             FROM r1 LEFT JOIN na ON na.request_id = r1.request_id LEFT JOIN nl ON nl.request_id = r1.request_id""",
    "ff": "SELECT sale_id, MIN(request_id) AS first_full FROM r3 WHERE eligible AND is_full GROUP BY sale_id",
    "fin": """SELECT r3.*, eligible AND (ff.first_full IS NULL OR r3.request_id <= ff.first_full) AS acc
              FROM r3 LEFT JOIN ff ON ff.sale_id = r3.sale_id"""}
register("apply_refunds", _refunds, with_views("""
    SELECT request_id, sale_id, CAST(acc AS INTEGER) AS accepted,
           CASE WHEN NOT eligible THEN 'Sale not found or already refunded'
                WHEN NOT acc THEN 'Sale already refunded' END AS error,
           CASE WHEN acc THEN CASE WHEN is_full THEN 'full' ELSE 'partial' END END AS refund_type,
           CASE WHEN acc THEN refunded_items END AS refunded_items, total_items,
           CASE WHEN acc THEN COALESCE(notes, '') || chr(10) || 'Refund: ' || COALESCE(reason, 'No reason provided') END
             AS note_appended, COALESCE(reason, 'No reason provided') AS reason_text
    FROM fin""", "sales", extra=REFUND_CTES), "S14: one refund request per order with returned (R) line items")


def _refund_movements(t):
    req, req_lines = SI.refund_requests(t)
    out = X.refund_outcomes(t, t.sale_lines, req, req_lines)
    return X.refund_movements(t, X.refund_return_ops(t, t.sale_lines, req, req_lines, out))


register("refund_movements", _refund_movements, with_views("""
    SELECT request_id, sale_id AS reference_id, line_no, product_id, variant_id, 'return' AS movement_type,
           quantity AS quantity_change, upto - quantity AS quantity_before, upto AS quantity_after,
           'refund' AS reference_type, CAST(NULL AS BIGINT) AS created_by, created_at
    FROM (SELECT f.request_id, i.*, q.created_at,
                 st.quantity + CAST(SUM(i.quantity) OVER (PARTITION BY i.product_id ORDER BY f.request_id, i.line_no) AS BIGINT) AS upto
          FROM fin f JOIN items_l i ON i.sale_id = f.sale_id JOIN rlines x ON x.request_id = f.request_id AND x.line_no = i.line_no
          JOIN requests q ON q.request_id = f.request_id
          JOIN stock st ON st.product_id = i.product_id AND st.variant_id IS NULL
          WHERE f.acc)""", "stock", "sales", extra=REFUND_CTES), "S14: the ledger rows of the refunded lines")
register("refunded_sales", lambda t: X.sales_after_refunds(t, _refunds(t)), with_views("""
    SELECT s.id, s.sale_number, CASE WHEN bool_or(f.is_full) THEN 'refunded' ELSE any_value(s.status) END AS status,
           COALESCE(any_value(s.notes), '') || string_agg(chr(10) || 'Refund: ' || f.reason, '' ORDER BY f.request_id) AS notes
    FROM fin f JOIN sales s ON s.id = f.sale_id WHERE f.acc GROUP BY s.id, s.sale_number""", "sales", extra=REFUND_CTES),
    "S14: status and notes of the sales that refunds touch")

_CARTS = {"cart_lines": CART_LINES_SQL, "cart_val": CART_VAL, **carts_ctes()}


def _carts_sql(select, **more):
    return with_views(select, "sale_items", "sales", "products", "stock", *more.pop("views", ()), extra={**_CARTS, **more})


register("apply_sales_exact", lambda t: X.apply_sales_exact(t, SI.cart_line_reader(t)()), _carts_sql("""
    SELECT b.cart_id, CASE WHEN w.ok THEN 'accepted' ELSE 'rejected' END AS status
    FROM cart_bad b LEFT JOIN cart_needs n ON n.cart_id = b.cart_id LEFT JOIN cart_walk w ON w.c = n.c"""),
         "S13: every sale replayed all-or-nothing against the stock table; the outcome of each cart")


def _posted(t, make):
    read = SI.cart_line_reader(t)
    return make(X.post_sales(t, read(), read))


register("post_sales", lambda t: _posted(t, lambda p: X.sale_replay_rows(p, SI.cart_headers(t))), _carts_sql("""
    SELECT s.id, s.sale_number, CAST(x.subtotal - s.discount_amount + s.tax_amount AS DECIMAL(12,2)) AS total_amount,
           CAST(s.tax_amount AS DECIMAL(12,2)) AS tax_amount, CAST(s.discount_amount AS DECIMAL(12,2)) AS discount_amount,
           s.payment_method, 'completed' AS status, s.cashier_id, s.customer_name, s.notes, s.created_at
    FROM sales s JOIN (SELECT cart_id, SUM(quantity * unit_price) AS subtotal FROM cart_sold GROUP BY cart_id) x
      ON x.cart_id = s.id"""), "S13: the sales rows of the carts sold")
register("post_sales_items", lambda t: _posted(t, X.sale_replay_items), _carts_sql("""
    SELECT cart_id AS sale_id, line_no, product_id, variant_id, quantity, unit_price,
           CAST(quantity * unit_price AS DECIMAL(12,2)) AS total_price, CAST(0 AS DECIMAL(12,2)) AS discount_amount
    FROM cart_sold"""), "S13: their items")
register("post_sales_movements", lambda t: _posted(t, lambda p: X.sale_replay_movements(p, SI.cart_headers(t))), _carts_sql("""
    SELECT x.product_id, x.variant_id, 'sale' AS movement_type, -x.quantity AS quantity_change,
           x.after + x.quantity AS quantity_before, x.after AS quantity_after, x.cart_id AS reference_id, x.line_no,
           'sale' AS reference_type, 'Sale ' || s.sale_number AS notes, s.cashier_id AS created_by, s.created_at
    FROM cart_sold x LEFT JOIN sales s ON s.id = x.cart_id"""), "S13: their ledger rows")
register("post_sales_stock", lambda t: _posted(t, lambda p: X.stock_after_sales(t, p)), _carts_sql("""
    SELECT st.id, st.product_id, st.variant_id, st.quantity - COALESCE(x.less, 0) AS quantity, st.reserved_quantity
    FROM stock st LEFT JOIN (SELECT product_id, variant_id, CAST(SUM(quantity) AS BIGINT) AS less FROM cart_sold
                             GROUP BY product_id, variant_id) x
      ON x.product_id = st.product_id AND x.variant_id IS NOT DISTINCT FROM st.variant_id"""), "S13: the stock after them")


def _posted_alerts(t):
    """The ledger that tells the active alerts and the sales job need nothing of each other: their Spark jobs run side by side."""
    checkpoint_dir(t.spark)
    with ThreadPoolExecutor(1) as pool:
        active = pool.submit(inheritable_thread_target(t.spark)(lambda: X.active_alert_keys(t).checkpoint(eager=True)))
        return _posted(t, lambda p: X.alerts_after_sales(t, p, active.result()))


register("post_sales_alerts", _posted_alerts, _carts_sql("""
    SELECT product_id, variant_id, after AS current_stock, min_stock_level, 'active' AS alert_status, cart_id AS sale_id, line_no
    FROM (SELECT x.*, p.min_stock_level, ROW_NUMBER() OVER (PARTITION BY x.product_id, x.variant_id
                                                            ORDER BY x.cart_id, x.line_no) AS nth
          FROM cart_sold x JOIN products p ON p.id = x.product_id
          WHERE x.after <= p.min_stock_level AND NOT EXISTS (
              SELECT 1 FROM low_stock_alerts a WHERE a.alert_status = 'active' AND a.product_id = x.product_id
              AND a.variant_id IS NOT DISTINCT FROM x.variant_id))
    WHERE nth = 1""", views=("stock_ops",), **ALERTS_CTES), "S13: the alerts they raise")
