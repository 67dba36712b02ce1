"""Registered JSON documents (S5), with oracle SQL."""

from __future__ import annotations

from tillbook.operators import sales as S
from tillbook.oracle.views_sql import with_views
from tillbook.plans.q_stock import ITEMS_SQL
from tillbook.plans.registry import register

PART = 3  # small, so that sales of the supplied tables come in parts
register("sale_documents", lambda t: S.sale_documents(t, part_items=PART), with_views(f"""
    SELECT s.id AS sale_id, COALESCE(i.part, 0) AS part,
           CAST(to_json({{'id': s.id, 'sale_number': s.sale_number, 'status': s.status, 'payment_method': s.payment_method,
                          'total_amount': CAST(s.total_amount AS VARCHAR), 'cashier_name': u.first_name || ' ' || u.last_name,
                          'items': COALESCE(i.items, [])}}) AS VARCHAR) AS document
    FROM sales s LEFT JOIN users u ON u.id = s.cashier_id LEFT JOIN (
        SELECT l.sale_id, CAST((l.line_no - 1) // {PART} AS INTEGER) AS part,
               list({{'line_no': l.line_no, 'product_id': l.product_id, 'product_name': p.name, 'sku': p.sku, 'variant_id': l.variant_id,
                      'quantity': l.quantity, 'unit_price': CAST(l.unit_price AS VARCHAR), 'total_price': CAST(l.total_price AS VARCHAR)}}
                    ORDER BY l.line_no) AS items
        FROM lines l JOIN products p ON p.id = l.product_id GROUP BY ALL) i ON i.sale_id = s.id""", "sales", "users", "products", extra={
        "lines": ITEMS_SQL.replace("AS unit_price, l_returnflag, l_shipdate", "AS unit_price, CAST(l_extendedprice AS DECIMAL(12,2)) AS total_price")}),
    "S5: every sale as JSON documents of three items each")
