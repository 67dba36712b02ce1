"""Registered dashboard queries (D1–D14) and their oracle SQL."""

from __future__ import annotations

from tillbook.functions.periods import AS_OF, sql_in_period
from tillbook.operators import dashboard as D
from tillbook.oracle.ledger_sql import ALERTS_CTES, MOVEMENTS_CTES
from tillbook.oracle.views_sql import with_views
from tillbook.plans.registry import register

TODAY = sql_in_period("created_at", "today", AS_OF)
WEEK = sql_in_period("created_at", "week", AS_OF)
MONTH = sql_in_period("created_at", "month", AS_OF)
YEAR = sql_in_period("created_at", "year", AS_OF)

PSC_FROM = "products p LEFT JOIN stock s ON p.id = s.product_id AND s.variant_id IS NULL"

register("sales_overview", lambda t: D.sales_overview(t), with_views(f"""
    SELECT COUNT(CASE WHEN {TODAY} THEN 1 END) AS today_count,
           COALESCE(CAST(SUM(CASE WHEN {TODAY} AND status = 'completed' THEN total_amount END) AS DOUBLE), 0.0) AS today_revenue,
           COALESCE(CAST(SUM(CASE WHEN {TODAY} AND status = 'completed' THEN total_amount END) AS DOUBLE)
                    / NULLIF(COUNT(CASE WHEN {TODAY} AND status = 'completed' THEN total_amount END), 0), 0.0) AS today_average,
           COUNT(CASE WHEN {WEEK} THEN 1 END) AS week_count,
           COALESCE(CAST(SUM(CASE WHEN {WEEK} AND status = 'completed' THEN total_amount END) AS DOUBLE), 0.0) AS week_revenue,
           COUNT(*) AS month_count,
           COALESCE(CAST(SUM(CASE WHEN status = 'completed' THEN total_amount END) AS DOUBLE), 0.0) AS month_revenue
    FROM sales WHERE {MONTH}""", "sales"), "D1")
register("low_stock_count", lambda t: D.low_stock_count(t), with_views(f"""
    SELECT COUNT(*) AS count FROM {PSC_FROM} WHERE p.is_active = 1 AND s.quantity <= p.min_stock_level""",
    "products", "stock"), "D2 / K3")
register("out_of_stock_count", lambda t: D.out_of_stock_count(t), with_views(f"""
    SELECT COUNT(*) AS count FROM {PSC_FROM} WHERE p.is_active = 1 AND s.quantity = 0""",
    "products", "stock"), "D3")
register("entity_counts", lambda t: D.entity_counts(t), with_views("""
    SELECT (SELECT COUNT(*) FROM products WHERE is_active = 1) AS total_products,
           (SELECT COUNT(*) FROM categories WHERE is_active = 1) AS total_categories,
           (SELECT COUNT(*) FROM users WHERE is_active = 1) AS active_users,
           (SELECT COUNT(*) FROM low_stock_alerts WHERE alert_status = 'active') AS pending_alerts""",
    "products", "categories", "users", "stock_ops", extra=ALERTS_CTES), "D4")
register("activity_sales", lambda t: D.activity_sales(t), with_views("""
    SELECT s.id, s.sale_number, CAST(s.total_amount AS DOUBLE) AS total_amount, s.status, s.created_at,
           u.first_name || ' ' || u.last_name AS cashier_name
    FROM (SELECT * FROM sales ORDER BY created_at DESC, id DESC LIMIT 5) s LEFT JOIN users u ON s.cashier_id = u.id""",
    "sales", "users"), "D5")
register("activity_movements", lambda t: D.activity_movements(t), with_views("""
    SELECT m.id, m.movement_type, m.quantity_change, m.created_at, p.name AS product_name, p.sku,
           u.first_name || ' ' || u.last_name AS created_by_name
    FROM (SELECT * FROM stock_movements ORDER BY created_at DESC, id DESC LIMIT 5) m
    LEFT JOIN products p ON m.product_id = p.id LEFT JOIN users u ON m.created_by = u.id""",
    "products", "users", "stock_ops", extra=MOVEMENTS_CTES), "D6")
register("activity_alerts", lambda t: D.activity_alerts(t), with_views("""
    SELECT a.id, a.current_stock, a.min_stock_level, a.created_at, p.name AS product_name, p.sku
    FROM low_stock_alerts a JOIN products p ON a.product_id = p.id
    WHERE a.alert_status = 'active' ORDER BY a.created_at DESC, a.id DESC LIMIT 5""",
    "products", "stock_ops", extra=ALERTS_CTES), "D7")


def _top_products_sql(period_pred: str) -> str:
    """Per sale and product first; then products ranked by what they sold; names come last."""
    return with_views("""
        SELECT r.product_id AS id, p.name, p.sku, CAST(p.price AS DOUBLE) AS price,
               (SELECT c.name FROM categories c WHERE c.id = p.category_id) AS category_name,
               r.sold AS total_sold, CAST(r.money AS DOUBLE) AS total_revenue, r.sales AS sale_count
        FROM ranked r, products p WHERE p.id = r.product_id AND r.place <= 10""",
        "sale_items", "sales", "products", "categories", extra={
            "done": f"SELECT id AS sale_id FROM sales WHERE status = 'completed' AND {period_pred}",
            "sold": """SELECT sale_id, product_id, SUM(quantity) AS q, SUM(total_price) AS m
                       FROM sale_items SEMI JOIN done USING (sale_id) GROUP BY ALL""",
            "known": """SELECT product_id, CAST(SUM(q) AS BIGINT) AS sold, SUM(m) AS money, COUNT(*) AS sales
                        FROM sold WHERE product_id IN (SELECT id FROM products) GROUP BY product_id""",
            "ranked": "SELECT *, ROW_NUMBER() OVER (ORDER BY sold DESC, product_id) AS place FROM known"})


register("top_products", lambda t: D.top_products(t, period="all"), _top_products_sql("TRUE"),
         "D8 flagship, all time")
register("top_products_year", lambda t: D.top_products(t, period="year"),
         _top_products_sql(YEAR), "D8, last 365 days")


def _chart_sql(period: str) -> str:
    if period == "today":
        slots = "SELECT printf('%02d:00', h) AS label FROM range(24) r(h)"
        fmt, pred = "%H:00", TODAY
    else:
        n = 7 if period == "week" else 30
        slots = (f"SELECT strftime(DATE '{AS_OF.isoformat()}' - INTERVAL {n - 1} DAY + d * INTERVAL 1 DAY, '%Y-%m-%d') "
                 f"AS label FROM range({n}) r(d)")
        fmt, pred = "%Y-%m-%d", WEEK if period == "week" else MONTH
    return with_views(f"""
        SELECT sl.label, COALESCE(g.n, 0) AS sales, COALESCE(CAST(g.rev AS DOUBLE), 0.0) AS revenue
        FROM ({slots}) sl LEFT JOIN (
            SELECT strftime(created_at, '{fmt}') AS label, COUNT(*) AS n,
                   SUM(CASE WHEN status = 'completed' THEN total_amount ELSE 0 END) AS rev
            FROM sales WHERE {pred} GROUP BY 1) g ON sl.label = g.label""", "sales")


register("sales_chart", lambda t: D.sales_chart(t, period="month"), _chart_sql("month"), "D9, 30 days")
register("sales_chart_week", lambda t: D.sales_chart(t, period="week"), _chart_sql("week"), "D9, 7 days")
register("sales_chart_today", lambda t: D.sales_chart(t, period="today"), _chart_sql("today"), "D9, 24 hours")
# an active product with its base stock quantity (NULL without a stock row)
HELD = {"held": """SELECT p.*, b.quantity AS q FROM (SELECT * FROM products WHERE is_active = 1) p
                   LEFT JOIN (SELECT product_id, quantity FROM stock WHERE variant_id IS NULL) b ON b.product_id = p.id"""}
register("inventory_by_category", lambda t: D.inventory_by_category(t), with_views("""
    SELECT r.name AS category_name, COALESCE(x.n, 0) AS total_products, COALESCE(x.low, 0) AS low_stock_count,
           COALESCE(x.nil, 0) AS out_of_stock_count, x.units AS total_quantity, CAST(x.worth AS DOUBLE) AS total_value
    FROM (SELECT id, name FROM categories WHERE parent_id IS NULL AND is_active = 1) r LEFT JOIN (
        SELECT category_id, COUNT(*) AS n, COUNT(*) FILTER (q <= min_stock_level) AS low, COUNT(*) FILTER (q = 0) AS nil,
               CAST(SUM(q) AS BIGINT) AS units, SUM(q * price) AS worth
        FROM held GROUP BY category_id) x ON x.category_id = r.id""",
    "categories", "products", "stock", extra=HELD), "D10")
register("stock_distribution", lambda t: D.stock_distribution(t), with_views("""
    SELECT COUNT(*) FILTER (label = 'out') AS out_of_stock, COUNT(*) FILTER (label = 'low') AS low_stock,
           COUNT(*) FILTER (label = 'in') AS in_stock
    FROM (SELECT if(q = 0, 'out', if(q > min_stock_level, 'in', if(q > 0, 'low', NULL))) AS label
          FROM held WHERE q IS NOT NULL)""", "products", "stock", extra=HELD), "D11")
register("inventory_value", lambda t: D.inventory_value(t), with_views("""
    SELECT CAST(SUM(q * cost) AS DOUBLE) AS total_cost_value, CAST(SUM(q * price) AS DOUBLE) AS total_retail_value, COUNT(*) AS total_products
    FROM held""", "products", "stock", extra=HELD), "D12")
register("low_stock_products", lambda t: D.low_stock_products(t), with_views("""
    SELECT id, name, sku, min_stock_level, q AS quantity, (SELECT c.name FROM categories c WHERE c.id = held.category_id) AS category_name,
           if(q = 0, 'out_of_stock', 'low_stock') AS stock_status
    FROM held WHERE q <= min_stock_level ORDER BY quantity, name NULLS FIRST, id LIMIT 10""",
    "products", "stock", "categories", extra=HELD), "D13")
register("cashier_performance", lambda t: D.cashier_performance(t, period="year"), with_views("""
    SELECT id, concat_ws(' ', first_name, last_name) AS name, role, COALESCE(made, 0) AS total_sales,
           COALESCE(CAST(taken AS DOUBLE), 0.0) AS total_revenue,
           CASE WHEN done > 0 THEN CAST(taken AS DOUBLE) / done END AS average_sale, COALESCE(undone, 0) AS refunded_sales
    FROM (SELECT * FROM users WHERE is_active = 1 AND role IN ('cashier', 'admin')) staff
    LEFT JOIN by_cashier ON by_cashier.cashier_id = staff.id""", "users", "sales", extra={
        "by_cashier": f"""SELECT cashier_id, COUNT(*) AS made, SUM(total_amount) FILTER (status = 'completed') AS taken,
                                 COUNT(*) FILTER (status = 'completed') AS done, COUNT(*) FILTER (status = 'refunded') AS undone
                          FROM sales WHERE cashier_id IS NOT NULL AND {YEAR} GROUP BY cashier_id"""}), "D14, period year")
