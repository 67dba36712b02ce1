"""Registered inserts, updates and the seed merge (C5, C6, U3, U4, P8, Q5): the tables after them, with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.operators import checks as C
from tillbook.operators import inserts as N
from tillbook.operators.quality import SEED_CATEGORIES, SEED_PRODUCTS, SEED_USERS
from tillbook.oracle.views_sql import with_views
from tillbook.plans import q_changes as B
from tillbook.plans.registry import QUERIES, register
from tillbook.sources import standins as SI

STAMP = f"TIMESTAMP '{B.NOW}'"


def _after(name: str) -> dict[str, str]:
    """The SQL of a registered check as CTE ``checked_rows``."""
    return {"checked_rows": QUERIES[name].sql}


def _c5(t):
    req = SI.category_insert_requests(t)
    return N.categories_after_insert(t, req, C.category_insert_check(t, req), B.NOW)


register("category_insert", _c5, with_views(f"""
    SELECT * FROM categories
    UNION ALL
    SELECT (SELECT MAX(id) FROM categories) + ROW_NUMBER() OVER (ORDER BY k.req_id), k.name, c.description, k.parent_id, 1, {STAMP}, {STAMP}
    FROM checked_rows k JOIN categories c ON c.id = k.req_id WHERE k.ok = 1""", "categories", extra=_after("category_insert_check")),
    "C5: the categories after every one is submitted again")


def _c6(t):
    req = SI.category_reparent_requests(t)
    return N.categories_after_update(t, req, C.category_reparent_check(t, req), B.NOW)


register("category_update", _c6, with_views(f"""
    SELECT c.id, COALESCE(k.name, c.name) AS name, c.description, CASE WHEN k.id IS NULL THEN c.parent_id ELSE k.parent_id END AS parent_id,
           c.is_active, c.created_at, CASE WHEN k.id IS NULL THEN c.updated_at ELSE {STAMP} END AS updated_at
    FROM categories c LEFT JOIN (SELECT id, name, parent_id FROM checked_rows WHERE ok = 1) k ON k.id = c.id""",
    "categories", extra=_after("category_reparent_check")), "C6: the categories after the moves")


def _u3(t):
    req = SI.new_user_requests(t)
    return N.users_after_insert(t, req, C.user_insert_check(t, req), B.NOW)


register("user_insert", _u3, with_views(f"""
    SELECT * FROM users
    UNION ALL
    SELECT (SELECT MAX(id) FROM users) + ROW_NUMBER() OVER (ORDER BY id), username || '_2', 'new.' || email, role, first_name, last_name, 1,
           {STAMP}, {STAMP}
    FROM users""", "users"), "U3: the users after two namesakes of each, of one e-mail, are submitted")


def _u4(t):
    patches = SI.user_deactivation_patches(t)
    return N.users_after_update(t, patches, C.user_partial_update(t, patches), B.NOW)


register("user_update", _u4, with_views(f"""
    SELECT * REPLACE (CASE WHEN id = 0 THEN is_active ELSE 0 END AS is_active, CASE WHEN id = 0 THEN updated_at ELSE {STAMP} END AS updated_at)
    FROM users""", "users"), "U4: the users after user 0 deactivates every user")


def _p8(t):
    inc, checked = B._check(t, "insert")
    return C.catalog_insert(t, inc, checked, B.NOW)[1]


register("catalog_insert_stock", _p8, with_views(f"""
    SELECT (SELECT MAX(id) FROM stock) + ROW_NUMBER() OVER (ORDER BY id) AS id, id AS product_id, CAST(NULL AS BIGINT) AS variant_id, 0 AS quantity,
           0 AS reserved_quantity, {STAMP} AS last_updated, CAST(NULL AS BIGINT) AS updated_by
    FROM checked WHERE ok = 1""", "products", "categories", "stock", extra=B._catalog_check_ctes("insert")),
    "P8: the stock rows of the accepted products")


# ---------------------------------------------------------------------- Q5
def _values(rows) -> str:
    def lit(v):
        return "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return ", ".join(f"({i}, {', '.join(map(lit, r))})" for i, r in enumerate(rows))


MERGE = {
    "seed_u": f"""
        SELECT * FROM (VALUES {_values(SEED_USERS)}) v(ord, username, email, role, first_name, last_name)
        UNION ALL SELECT 1000 + id * 10, username, 'x.' || email, role, first_name, last_name FROM users
        UNION ALL SELECT 1001 + id * 10, username || '_i', 'i.' || email, role, first_name, last_name FROM users
        UNION ALL SELECT 1002 + id * 10, username || '_j', 'i.' || email, role, first_name, last_name FROM users""",
    "seed_c": f"""
        SELECT * FROM (VALUES {_values(SEED_CATEGORIES)}) v(ord, name, description, parent_name)
        UNION ALL SELECT 1000 + c.id * 10, c.name, c.description, p.name FROM categories c LEFT JOIN categories p ON p.id = c.parent_id
        UNION ALL SELECT 1001 + id * 10, 'Import ' || name, NULL, NULL FROM categories
        UNION ALL SELECT 1002 + c.id * 10, c.name, 'imported', 'Import ' || p.name FROM categories c LEFT JOIN categories p ON p.id = c.parent_id""",
    "seed_p": f"""
        SELECT ord, sku, barcode, name, category, brand, CAST(price AS DECIMAL(10,2)) AS price, CAST(cost AS DECIMAL(10,2)) AS cost, lowest, quantity
        FROM (VALUES {_values(SEED_PRODUCTS)}) v(ord, sku, barcode, name, category, brand, price, cost, lowest, quantity)
        UNION ALL
        SELECT 1000 + p.id * 10 + n, CASE n WHEN 0 THEN p.sku ELSE 'IMP' || p.id % 1000 * 2 END, p.barcode, p.name, 'Import ' || c.name, p.brand,
               p.price, p.cost, p.min_stock_level, CASE n WHEN 0 THEN 1 WHEN 1 THEN p.id % 90 ELSE 7 END
        FROM products p LEFT JOIN categories c ON c.id = p.category_id, range(3) r(n)""",
    "roots_in": """
        SELECT (SELECT MAX(id) FROM categories) + ROW_NUMBER() OVER (ORDER BY ord) AS id, name, description
        FROM (SELECT name, MIN(ord) AS ord, arg_min(COALESCE(description, chr(0)), ord) AS description FROM seed_c
              WHERE parent_name IS NULL AND name NOT IN (SELECT name FROM categories WHERE parent_id IS NULL) GROUP BY name)""",
    "level_1": """
        SELECT id, name, description, parent_id, is_active, created_at, updated_at FROM categories
        UNION ALL SELECT id, name, NULLIF(description, chr(0)), NULL, 1, now_, now_ FROM roots_in, at_""",
    "kids_in": """
        SELECT (SELECT MAX(id) FROM level_1) + ROW_NUMBER() OVER (ORDER BY ord) AS id, name, description, parent_id
        FROM (SELECT s.name, u.parent_id, MIN(s.ord) AS ord, arg_min(COALESCE(s.description, chr(0)), s.ord) AS description
              FROM seed_c s JOIN (SELECT name, MIN(id) AS parent_id FROM level_1 GROUP BY name) u ON u.name = s.parent_name
              GROUP BY s.name, u.parent_id) x
        WHERE NOT EXISTS (SELECT 1 FROM level_1 l WHERE l.name = x.name AND l.parent_id = x.parent_id)""",
    "level_2": """
        FROM level_1 UNION ALL SELECT id, name, NULLIF(description, chr(0)), parent_id, 1, now_, now_ FROM kids_in, at_""",
    "products_in": """
        SELECT (SELECT MAX(id) FROM products) + ROW_NUMBER() OVER (ORDER BY s.ord) AS id, s.*,
               (SELECT MIN(id) FROM level_2 l WHERE l.name = s.category) AS category_id
        FROM (SELECT * FROM seed_p QUALIFY ROW_NUMBER() OVER (PARTITION BY sku ORDER BY ord) = 1) s
        WHERE s.sku NOT IN (SELECT sku FROM products)""",
}


def _merge_sql(body: str, *views: str) -> str:
    names = ("users", "categories", "products", *views)
    return with_views(body, *names, extra={"at_": f"SELECT {STAMP} AS now_", **MERGE})


def _merge(t):
    return N.SeedMerge(t, N.combined(N.seed_frames(t.spark), SI.import_rows(t)), B.NOW)


def _products(t):
    merge = _merge(t)
    return merge.products_and_stock(merge.categories())


register("seed_merge_users", lambda t: _merge(t).users(), _merge_sql("""
    SELECT * FROM users
    UNION ALL
    SELECT (SELECT MAX(id) FROM users) + ROW_NUMBER() OVER (ORDER BY ord), username, email, role, first_name, last_name, 1, now_, now_
    FROM at_, (SELECT * FROM seed_u WHERE username NOT IN (SELECT username FROM users)
               QUALIFY ROW_NUMBER() OVER (PARTITION BY email ORDER BY ord) = 1)"""), "Q5: the users after the seed and an import")
register("seed_merge_categories", lambda t: _merge(t).categories(), _merge_sql("SELECT * FROM level_2"),
         "Q5: the categories after the seed and an import")
register("seed_merge_products", lambda t: _products(t)[0].withColumns({c: F.col(c).cast("double") for c in ("price", "cost")}), _merge_sql("""
    SELECT * REPLACE (CAST(price AS DOUBLE) AS price, CAST(cost AS DOUBLE) AS cost) FROM products
    UNION ALL
    SELECT id, sku, barcode, name, NULL, category_id, brand, 'pcs', CAST(price AS DOUBLE), CAST(cost AS DOUBLE), lowest, NULL, 1, now_, now_
    FROM products_in, at_"""), "Q5: the products after the seed and an import")
register("seed_merge_stock", lambda t: _products(t)[1], _merge_sql("""
    SELECT * FROM stock
    UNION ALL
    SELECT (SELECT MAX(id) FROM stock) + ROW_NUMBER() OVER (ORDER BY id), id, NULL, CAST(quantity AS INTEGER), 0, now_, NULL
    FROM products_in, at_ WHERE id NOT IN (SELECT product_id FROM stock WHERE variant_id IS NULL)""", "stock"),
    "Q5: the stock after the seed and an import")
