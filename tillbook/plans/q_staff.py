"""Registered staff queries (U1, U2, U6–U8) with oracle SQL."""

from __future__ import annotations

from tillbook.operators import staff as U
from tillbook.oracle.ledger_sql import MOVEMENTS_CTES
from tillbook.oracle.views_sql import with_views
from tillbook.plans.registry import register

USER_SEL = "id, username, email, role, first_name, last_name, is_active, created_at, updated_at"

register("users_list", lambda t: U.users_list(t), with_views(f"SELECT {USER_SEL} FROM users", "users"), "U1")
register("user_by_id", lambda t: U.user_by_id(t), with_views(f"SELECT {USER_SEL} FROM users", "users"),
         "U2 for every user")
register("user_sales_stats", lambda t: U.user_sales_stats(t), with_views("""
    SELECT id, username, first_name, last_name, role, COALESCE(made, 0) AS total_sales, CAST(COALESCE(taken, 0) AS DOUBLE) AS total_revenue,
           CASE WHEN done > 0 THEN CAST(taken AS DOUBLE) / done END AS average_sale, first_sale, last_sale
    FROM users LEFT JOIN (
        SELECT cashier_id AS id, COUNT(*) AS made, SUM(if(status = 'completed', total_amount, 0)) AS taken,
               COUNT(*) FILTER (status = 'completed') AS done, MIN(created_at) AS first_sale, MAX(created_at) AS last_sale
        FROM sales GROUP BY cashier_id) USING (id)""", "users", "sales"), "U6 for every user")
register("user_recent_sales", lambda t: U.user_recent_sales(t), with_views("""
    SELECT cashier_id, rank, id, sale_number, CAST(total_amount AS DOUBLE) AS total_amount, status, created_at
    FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY cashier_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank
          FROM sales WHERE cashier_id IS NOT NULL) WHERE rank <= 10""", "sales"), "U7 for every cashier")
register("user_movement_stats", lambda t: U.user_movement_stats(t), with_views("""
    SELECT u.id, u.username, COUNT(m.id) AS total_movements, MIN(m.created_at) AS first_movement,
           MAX(m.created_at) AS last_movement
    FROM users u LEFT JOIN stock_movements m ON m.created_by = u.id GROUP BY u.id, u.username""",
    "users", "stock_ops", extra=MOVEMENTS_CTES), "U8 for every user")
