"""Registered data-quality queries (Q1–Q5) with oracle SQL (generated from the same rule lists)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.operators import quality as Q
from tillbook.oracle.ledger_sql import ALERTS_CTES, MOVEMENTS_CTES
from tillbook.oracle.views_sql import with_views
from tillbook.plans.registry import register

ALL_VIEWS = ("categories", "products", "product_variants", "stock", "users", "sales", "sale_items", "stock_ops")
LEDGER_EXTRA = {**ALERTS_CTES, "stock_movements": MOVEMENTS_CTES["stock_movements"]}


def _enum_sql() -> str:
    parts = []
    for table, cols in Q.NOT_NULL.items():
        for c in cols:
            parts.append(f"SELECT '{table}' AS table_name, '{c}' AS column_name, 'not_null' AS rule, "
                         f"COUNT(*) FILTER (WHERE {c} IS NULL) AS violations FROM {table}")
        for tb, c, vals in Q.ENUMS:
            if tb == table:
                lst = ", ".join(f"'{v}'" for v in vals)
                parts.append(f"SELECT '{table}', '{c}', 'in_set', COUNT(*) FILTER (WHERE {c} IS NOT NULL AND {c} NOT IN ({lst})) "
                             f"FROM {table}")
    return with_views("\nUNION ALL\n".join(parts), *ALL_VIEWS, extra=LEDGER_EXTRA)


def _fk_sql() -> str:
    parts = [f"SELECT '{ch}' AS table_name, '{col}' AS column_name, '{par}' AS parent_table, COUNT(*) AS violations "
             f"FROM {ch} c WHERE c.{col} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {par} p WHERE p.id = c.{col})"
             for ch, col, par, _r in Q.FOREIGN_KEYS]
    return with_views("\nUNION ALL\n".join(parts), *ALL_VIEWS, extra=LEDGER_EXTRA)


def _unique_sql() -> str:
    parts = []
    for table, cols in Q.UNIQUE_KEYS:
        g = ", ".join(cols)
        parts.append(f"SELECT '{table}' AS table_name, '{','.join(cols)}' AS key_columns, COUNT(*) AS duplicate_keys, "
                     f"CAST(COALESCE(SUM(n), 0) AS BIGINT) AS duplicate_rows "
                     f"FROM (SELECT COUNT(*) AS n FROM {table} GROUP BY {g} HAVING COUNT(*) > 1)")
    return with_views("\nUNION ALL\n".join(parts), *ALL_VIEWS)


def _delete_effects(t):
    deleted = {"categories": t.categories.filter(F.col("is_active") == 0),
               "products": t.products.filter(F.col("is_active") == 0)}
    return Q.fk_delete_effects(t, deleted)


def _delete_sql() -> str:
    parts = [f"SELECT '{ch}' AS table_name, '{col}' AS column_name, '{par}' AS parent_table, '{rule}' AS rule, "
             f"COUNT(*) AS affected_rows FROM {ch} WHERE {col} IN (SELECT id FROM {par} WHERE is_active = 0)"
             for ch, col, par, rule in Q.FOREIGN_KEYS if par in ("categories", "products")]
    return with_views("\nUNION ALL\n".join(parts), *ALL_VIEWS, extra=LEDGER_EXTRA)


def _vals(rows) -> str:
    def lit(v):
        return "NULL" if v is None else ("'" + str(v).replace("'", "''") + "'" if isinstance(v, str) else str(v))
    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


def _seed_sql() -> str:
    roots = [(i, n) for i, (n, _d, p) in enumerate(Q.SEED_CATEGORIES) if p is None]
    kids = [(i, n, p) for i, (n, _d, p) in enumerate(Q.SEED_CATEGORIES) if p is not None]
    prods = [(i, s, c) for i, (s, _b, _n, c, *_r) in enumerate(Q.SEED_PRODUCTS)]
    users = [(i, u, e) for i, (u, e, *_r) in enumerate(Q.SEED_USERS)]
    return with_views("""
        SELECT * FROM cat_rows
        UNION ALL
        SELECT 'products', p.sku, CASE WHEN p.eid IS NULL THEN 'insert' ELSE 'exists' END,
               CAST(COALESCE(p.eid, (SELECT COALESCE(MAX(id), 0) FROM products) + 1 + p.ord) AS BIGINT), an.cid
        FROM (SELECT sp.*, (SELECT MIN(id) FROM products x WHERE x.sku = sp.sku) AS eid FROM seed_products sp) p
        LEFT JOIN all_names an ON an.name = p.category
        UNION ALL
        SELECT 'users', su.username,
               CASE WHEN e.eid IS NULL THEN 'insert' ELSE 'exists' END,
               CAST(COALESCE(e.eid, (SELECT COALESCE(MAX(id), 0) FROM users) + 1 + su.ord) AS BIGINT), CAST(NULL AS BIGINT)
        FROM seed_users su LEFT JOIN (
            SELECT su2.ord, MIN(x.id) AS eid FROM seed_users su2 JOIN users x
              ON x.username = su2.username OR x.email = su2.email GROUP BY su2.ord) e ON e.ord = su.ord""",
        "categories", "products", "users", extra={
            "seed_roots": f"SELECT * FROM (VALUES {_vals(roots)}) v(ord, name)",
            "seed_kids": f"SELECT * FROM (VALUES {_vals(kids)}) v(ord, name, parent_name)",
            "seed_products": f"SELECT * FROM (VALUES {_vals(prods)}) v(ord, sku, category)",
            "seed_users": f"SELECT * FROM (VALUES {_vals(users)}) v(ord, username, email)",
            "cm": "SELECT COALESCE(MAX(id), 0) AS m FROM categories",
            "rn": """SELECT r.ord, r.name, (SELECT MIN(id) FROM categories c WHERE c.parent_id IS NULL AND c.name = r.name)
                            AS eid FROM seed_roots r""",
            "rn2": "SELECT ord, name, eid, CAST(COALESCE(eid, (SELECT m FROM cm) + 1 + ord) AS BIGINT) AS id FROM rn",
            "kp": """SELECT k.ord, k.name, COALESCE((SELECT MIN(id) FROM categories c WHERE c.name = k.parent_name),
                                                   (SELECT id FROM rn2 WHERE rn2.name = k.parent_name)) AS parent_id
                     FROM seed_kids k""",
            "kn": """SELECT kp.*, (SELECT MIN(id) FROM categories c WHERE c.name = kp.name AND c.parent_id = kp.parent_id)
                            AS eid FROM kp""",
            "cat_rows": """
                SELECT 'categories' AS table_name, name AS natural_key,
                       CASE WHEN eid IS NULL THEN 'insert' ELSE 'exists' END AS action, id, CAST(NULL AS BIGINT) AS ref_id
                FROM rn2
                UNION ALL
                SELECT 'categories', name, CASE WHEN eid IS NULL THEN 'insert' ELSE 'exists' END,
                       CAST(COALESCE(eid, (SELECT m FROM cm) + 1 + ord) AS BIGINT), parent_id FROM kn""",
            "all_names": """SELECT name, MIN(cid) AS cid FROM (SELECT name, id AS cid FROM categories
                                                            UNION ALL SELECT natural_key, id FROM cat_rows) GROUP BY name""",
        })


register("enum_violations", lambda t: Q.enum_violations(t), _enum_sql(), "Q1 over every table")
register("fk_violations", lambda t: Q.fk_violations(t), _fk_sql(), "Q2 every foreign key")
register("unique_violations", lambda t: Q.unique_violations(t), _unique_sql(), "Q3 every unique key")
register("fk_delete_effects", _delete_effects, _delete_sql(),
         "Q4: effects of physically deleting the inactive categories and products")
register("seed_insert_if_absent", lambda t: Q.seed_plan(t), _seed_sql(),
         "Q5: the reference's seed merged into the current tables (insert if absent, names → ids)")


def _closure(t):
    return Q.DeleteClosure(t, {"categories": t.categories.filter(F.col("is_active") == 0),
                               "products": t.products.filter(F.col("is_active") == 0), "sales": t.sales.filter(F.col("id") % 3 == 0)})


# A sold product can go only with all the sales that hold it; categories and sales always can.
GONE = {
    "gone_sales": "SELECT id FROM sales WHERE id % 3 = 0",
    "gone_categories": "SELECT id FROM categories WHERE is_active = 0",
    "sold": """SELECT COALESCE(v.product_id, si.product_id) AS product_id FROM sale_items si LEFT JOIN product_variants v ON v.id = si.variant_id
               WHERE si.sale_id NOT IN (SELECT id FROM gone_sales)
               UNION SELECT product_id FROM sale_items WHERE sale_id NOT IN (SELECT id FROM gone_sales)""",
    "gone_products": "SELECT id FROM products WHERE is_active = 0 AND id NOT IN (SELECT product_id FROM sold)",
    "gone_variants": "SELECT id FROM product_variants WHERE product_id IN (SELECT id FROM gone_products)",
}
_LEFT = {"users": "TRUE", "categories": "id NOT IN (SELECT id FROM gone_categories)", "products": "id NOT IN (SELECT id FROM gone_products)",
         "sales": "id NOT IN (SELECT id FROM gone_sales)", "sale_items": "sale_id NOT IN (SELECT id FROM gone_sales)",
         **dict.fromkeys(("product_variants", "stock", "stock_movements", "low_stock_alerts"), "product_id NOT IN (SELECT id FROM gone_products)")}
register("fk_delete_outcomes", lambda t: _closure(t).outcomes(), with_views("""
    SELECT 'categories' AS table_name, id, 1 AS ok FROM gone_categories
    UNION ALL SELECT 'sales', id, 1 FROM gone_sales
    UNION ALL SELECT 'products', id, CAST(id IN (SELECT id FROM gone_products) AS INTEGER) FROM products WHERE is_active = 0""",
    *ALL_VIEWS, extra=GONE), "Q4: which of the inactive categories and products and a third of the sales can be deleted")
register("fk_tables_after_delete", lambda t: _closure(t).sizes(), with_views("\nUNION ALL\n".join(
    f"SELECT '{name}' AS table_name, COUNT(*) FILTER (WHERE {cond}) AS rows_left, COUNT(*) FILTER (WHERE NOT ({cond})) AS rows_deleted FROM {name}"
    for name, cond in _LEFT.items()), *ALL_VIEWS, extra={**LEDGER_EXTRA, **GONE}), "Q4: all tables after these deletes and what follows from them")
register("fk_products_after_delete", lambda t: _closure(t).after("products").select("id", "sku", "category_id"), with_views("""
    SELECT id, sku, CASE WHEN category_id NOT IN (SELECT id FROM gone_categories) THEN category_id END AS category_id
    FROM products WHERE id NOT IN (SELECT id FROM gone_products)""", *ALL_VIEWS, extra=GONE), "Q4: the products left, their keys cleared")
register("fk_categories_after_delete", lambda t: _closure(t).after("categories").select("id", "name", "parent_id"), with_views("""
    SELECT id, name, CASE WHEN parent_id NOT IN (SELECT id FROM gone_categories) THEN parent_id END AS parent_id
    FROM categories WHERE id NOT IN (SELECT id FROM gone_categories)""", *ALL_VIEWS, extra=GONE), "Q4: the categories left, their keys cleared")
