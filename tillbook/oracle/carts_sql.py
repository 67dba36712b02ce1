"""All-or-nothing carts in DuckDB: walked one by one in a recursive CTE, the stock carried as a LIST.

Sequential by construction: no bounds, no components.
"""

from __future__ import annotations


def carts_ctes() -> dict[str, str]:
    """CTEs over ``cart_val`` (cart lines with their static ``reason``): ``cart_walk`` (c, ok) in cart order, and ``cart_sold``,
    the lines of the sold carts with the stock ``after`` each."""
    return {
        "cart_bad": "SELECT cart_id, BOOL_OR(reason IS NOT NULL) AS bad FROM cart_val GROUP BY cart_id",
        "cart_need": """
            SELECT *, DENSE_RANK() OVER (ORDER BY cart_id) AS c, DENSE_RANK() OVER (ORDER BY product_id, variant_id) AS k
            FROM (SELECT v.cart_id, v.product_id, v.variant_id, CAST(SUM(v.quantity) AS BIGINT) AS n
                  FROM cart_val v JOIN cart_bad b ON b.cart_id = v.cart_id AND NOT b.bad
                  GROUP BY v.cart_id, v.product_id, v.variant_id)""",
        "cart_needs": "SELECT c, cart_id, list({'k': k, 'n': n}) AS need FROM cart_need GROUP BY c, cart_id",
        "cart_open": """
            SELECT list(CAST(s.quantity AS BIGINT) ORDER BY n.k) AS q
            FROM (SELECT DISTINCT k, product_id, variant_id FROM cart_need) n
            JOIN stock s ON s.product_id = n.product_id AND s.variant_id IS NOT DISTINCT FROM n.variant_id""",
        "cart_walk": """
            WITH RECURSIVE w(c, q, ok) AS (
                SELECT CAST(0 AS BIGINT), (SELECT q FROM cart_open), TRUE
                UNION ALL
                SELECT x.c,
                       CASE WHEN list_bool_and(list_transform(x.need, lambda e: w.q[e.k] >= e.n))
                            THEN list_transform(w.q, lambda v, i: v - COALESCE(list_sum(list_transform(
                                     list_filter(x.need, lambda e: e.k = i), lambda e: e.n)), 0))
                            ELSE w.q END,
                       list_bool_and(list_transform(x.need, lambda e: w.q[e.k] >= e.n))
                FROM w JOIN cart_needs x ON x.c = w.c + 1
            ) SELECT c, ok FROM w WHERE c > 0""",
        "cart_sold": """
            SELECT v.*, CAST(s.quantity - SUM(v.quantity) OVER (PARTITION BY v.product_id, v.variant_id
                                                               ORDER BY v.cart_id, v.line_no) AS BIGINT) AS after
            FROM cart_val v JOIN cart_needs n ON n.cart_id = v.cart_id JOIN cart_walk w ON w.c = n.c AND w.ok
            JOIN stock s ON s.product_id = v.product_id AND s.variant_id IS NOT DISTINCT FROM v.variant_id""",
    }
