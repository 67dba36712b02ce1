"""The canonical retail tables as DuckDB CTEs over the supplied base tables.

Same derivation rules as ``tillbook.sources.views`` (FIXTURES.md §B), written in SQL so
the correctness oracle builds its inputs independently of Spark.
"""

from __future__ import annotations

ROOT_CASE = ("CAST(CASE p_type WHEN 'ECONOMY' THEN 1 WHEN 'LARGE' THEN 2 WHEN 'MEDIUM' THEN 3 "
             "WHEN 'PROMO' THEN 4 WHEN 'SMALL' THEN 5 ELSE 6 END AS BIGINT)")
BNO = "CAST(substr(p_brand, 7) AS INTEGER)"
EPOCH = "TIMESTAMP '2000-01-01 00:00:00'"

VIEW_SQL: dict[str, str] = {
    "categories": f"""
        SELECT id, name, CAST(NULL AS VARCHAR) AS description, parent_id, is_active,
               {EPOCH} AS created_at, {EPOCH} AS updated_at
        FROM (
            SELECT DISTINCT {ROOT_CASE} AS id, p_type AS name, CAST(NULL AS BIGINT) AS parent_id, 1 AS is_active
            FROM part
            UNION
            SELECT DISTINCT {ROOT_CASE} * 100 + {BNO}, p_brand, {ROOT_CASE},
                   CASE WHEN {BNO} % 13 = 0 THEN 0 ELSE 1 END
            FROM part
        )""",
    "products": f"""
        SELECT p_partkey AS id,
               printf('SKU%06d', p_partkey) AS sku,
               CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(1000000000000 + p_partkey AS VARCHAR) END AS barcode,
               p_name AS name,
               CAST(NULL AS VARCHAR) AS description,
               CASE WHEN p_partkey % 37 = 0 THEN NULL WHEN p_partkey % 10 = 0 THEN {ROOT_CASE}
                    ELSE {ROOT_CASE} * 100 + {BNO} END AS category_id,
               p_brand AS brand,
               'pcs' AS unit_size,
               CAST(p_retailprice AS DECIMAL(10,2)) AS price,
               CASE WHEN p_partkey % 23 = 0 THEN NULL
                    ELSE CAST(CAST(p_retailprice AS DECIMAL(10,2)) * CAST(0.6 AS DECIMAL(2,1)) AS DECIMAL(10,2)) END AS cost,
               p_size AS min_stock_level,
               CAST(NULL AS VARCHAR) AS image_url,
               CASE WHEN p_partkey % 17 = 0 THEN 0 ELSE 1 END AS is_active,
               {EPOCH} + to_seconds(p_partkey % 86400) AS created_at,
               {EPOCH} + to_seconds(p_partkey % 86400) AS updated_at
        FROM part""",
    "product_variants": f"""
        SELECT p_partkey * 10 + v.k AS id, p_partkey AS product_id, 'size' AS variant_name,
               v.val AS variant_value, '-' || v.val AS sku_suffix, v.adj AS price_adjustment,
               1 AS is_active, {EPOCH} AS created_at
        FROM part, (VALUES (1, 'S', CAST(0.00 AS DECIMAL(10,2))), (2, 'L', CAST(1.50 AS DECIMAL(10,2)))) v(k, val, adj)
        WHERE p_partkey % 4 = 0""",
    "stock": f"""
        SELECT id, product_id, variant_id, quantity, quantity % 5 AS reserved_quantity,
               {EPOCH} AS last_updated, CAST(NULL AS BIGINT) AS updated_by
        FROM (
            SELECT p_partkey * 10 AS id, p_partkey AS product_id, CAST(NULL AS BIGINT) AS variant_id,
                   CAST((p_partkey * 7919) % 120 AS INTEGER) AS quantity
            FROM part WHERE p_partkey % 29 <> 0
            UNION ALL
            SELECT p_partkey * 10 + 1, p_partkey, p_partkey * 10 + 1, CAST((p_partkey * 31) % 40 AS INTEGER)
            FROM part WHERE p_partkey % 4 = 0
            UNION ALL
            SELECT p_partkey * 10 + 2, p_partkey, p_partkey * 10 + 2, CAST((p_partkey * 17) % 40 AS INTEGER)
            FROM part WHERE p_partkey % 4 = 0
        )""",
    "users": f"""
        SELECT CAST(n_nationkey AS BIGINT) AS id,
               lower(replace(n_name, ' ', '_')) AS username,
               lower(replace(n_name, ' ', '_')) || '@example.com' AS email,
               CASE WHEN n_nationkey % 5 = 0 THEN 'admin' ELSE 'cashier' END AS role,
               n_name AS first_name, r_name AS last_name,
               CASE WHEN n_nationkey % 7 = 6 THEN 0 ELSE 1 END AS is_active,
               {EPOCH} + to_seconds(CAST(n_nationkey AS BIGINT) * 86400) AS created_at,
               {EPOCH} + to_seconds(CAST(n_nationkey AS BIGINT) * 86400) AS updated_at
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "sales": """
        SELECT o_orderkey AS id,
               printf('SALE-%08d', o_orderkey) AS sale_number,
               CAST(o_totalprice AS DECIMAL(12,2)) AS total_amount,
               CAST(0 AS DECIMAL(12,2)) AS tax_amount,
               CAST(0 AS DECIMAL(12,2)) AS discount_amount,
               substr(o_orderpriority, 3) AS payment_method,
               CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'pending' ELSE 'cancelled' END
                    WHEN o_orderkey % 10 = 0 THEN 'refunded' ELSE 'completed' END AS status,
               CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE CAST(c_nationkey AS BIGINT) END AS cashier_id,
               c_name AS customer_name,
               CAST(NULL AS VARCHAR) AS notes,
               o_orderdate + to_seconds((o_orderkey * 37) % 86400) AS created_at
        FROM orders LEFT JOIN customer ON o_custkey = c_custkey""",
    "sale_items": """
        SELECT l_orderkey AS sale_id, l_partkey AS product_id, CAST(NULL AS BIGINT) AS variant_id,
               CAST(floor(l_quantity) AS INTEGER) AS quantity,
               CAST(CAST((CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * 100 AS BIGINT) * 2 + CAST(floor(l_quantity) AS INTEGER))
                    // (2 * CAST(floor(l_quantity) AS INTEGER)) AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(2,2)) AS DECIMAL(12,2)) AS unit_price,
               CAST(l_extendedprice AS DECIMAL(12,2)) AS total_price,
               CAST(0 AS DECIMAL(12,2)) AS discount_amount,
               l_shipdate AS created_at
        FROM lineitem""",
    "stock_ops": """
        SELECT event_id AS seq, user_id AS product_id, CAST(NULL AS BIGINT) AS variant_id,
               CASE event_type WHEN 'signup' THEN 'in' WHEN 'click' THEN 'out' WHEN 'error' THEN 'adjustment'
                    WHEN 'purchase' THEN 'sale' WHEN 'view' THEN 'return' END AS op,
               CAST(CAST(floor(value) AS BIGINT) % 50 + 1 AS INTEGER) AS n,
               user_id % 25 AS created_by,
               ts AS created_at
        FROM events""",
}

VIEW_ORDER = ("categories", "products", "product_variants", "stock", "users", "sales", "sale_items", "stock_ops")


def with_views(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the CTEs it needs (views first, then ``extra`` CTEs in order)."""
    ctes = [f"{n} AS ({VIEW_SQL[n]})" for n in VIEW_ORDER if n in names]
    for n, q in (extra or {}).items():
        ctes.append(f"{n} AS ({q})")
    if not ctes:
        return body
    return "WITH " + ",\n".join(ctes) + "\n" + body
