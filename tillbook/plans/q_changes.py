"""Registered change checks and apply jobs (P7–P10, C5–C7, U3–U5) with oracle SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tillbook.functions.periods import AS_OF
from tillbook.operators import checks as C
from tillbook.oracle.batch_sql import batch_walk
from tillbook.oracle.views_sql import with_views
from tillbook.plans.registry import register
from tillbook.sources import standins as SI

NOW = f"{AS_OF.isoformat()} 00:00:00"
REQ_COLS = "sku, name, price, category_id, brand, unit_size, cost, min_stock_level, barcode, description"
RELIST_SQL = f"""SELECT p.id AS req_id, p.id + (SELECT MAX(id) + 1 FROM products) AS id, {REQ_COLS}
                 FROM products p WHERE p.is_active = 0"""
UPDATE_REQ_SQL = f"""SELECT p.id AS req_id, p.id, {REQ_COLS.replace('sku', 'p.sku', 1).replace('barcode', 'p.barcode')} FROM (
    SELECT p.* REPLACE (CASE WHEN p.id % 7 = 3 THEN n.sku WHEN p.id % 7 = 4 THEN 'N-' || p.sku WHEN p.id % 7 = 5 THEN b.sku ELSE p.sku END AS sku,
                        CASE WHEN p.id % 11 = 2 THEN n.barcode ELSE p.barcode END AS barcode)
    FROM products p LEFT JOIN products n ON n.id = p.id + 1 LEFT JOIN products b ON b.id = p.id - 1) p"""


def _catalog_check_ctes(mode: str) -> dict[str, str]:
    other = "AND a.id IS DISTINCT FROM i.id" if mode == "update" else ""
    not_found = ("WHEN NOT EXISTS (SELECT 1 FROM products a WHERE a.is_active = 1 AND a.id = i.id) "
                 "THEN 'Product not found'") if mode == "update" else ""
    return {
        "inc": RELIST_SQL if mode == "insert" else UPDATE_REQ_SQL,
        "cx": f"""
            SELECT i.req_id, i.id, trim(i.sku) AS sku, NULLIF(trim(i.barcode), '') AS bar,
                   CASE WHEN trim(i.sku) IS NULL OR trim(i.sku) = '' OR trim(i.name) IS NULL OR trim(i.name) = ''
                             OR i.price IS NULL OR i.price < 0 OR i.cost < 0 OR i.min_stock_level < 0
                        THEN 'Validation failed'
                        {not_found} END AS pre,
                   CASE WHEN i.category_id IS NOT NULL AND i.category_id <> 0 AND NOT EXISTS (
                             SELECT 1 FROM categories c WHERE c.is_active = 1 AND c.id = i.category_id)
                        THEN 'Category not found' END AS post,
                   EXISTS (SELECT 1 FROM products a WHERE a.is_active = 1 AND a.sku = trim(i.sku) {other}) AS sa,
                   EXISTS (SELECT 1 FROM products a WHERE a.sku = trim(i.sku) {other}) AS sx
            FROM inc i""",
        "holders": "SELECT id, sku AS k0, barcode AS k1 FROM products WHERE is_active = 1",
        "claims": "SELECT req_id, id, pre IS NULL AS alive, post IS NOT NULL AS late, sku AS k0, bar AS k1 FROM cx",
        **batch_walk(2, new_rows=mode == "insert"),
        "cd": """
            SELECT cx.*, COALESCE(pre, CASE w.clash WHEN 0 THEN 'Product with this SKU already exists'
                                                    WHEN 1 THEN 'Product with this barcode already exists' END, post) AS reason
            FROM cx JOIN walk w ON w.req_id = cx.req_id""",
        "checked": """
            SELECT req_id, id, sku, reason, CAST(reason IS NULL AS INTEGER) AS ok,
                   CASE WHEN reason IS NULL AND NOT sa AND sx THEN 'SKU is used by an inactive product' END AS warning
            FROM cd""",
    }


def _check(t, mode):
    inc = SI.catalog_relist_requests(t) if mode == "insert" else SI.catalog_update_requests(t)
    return inc, C.catalog_check(t, inc, mode)


register("catalog_upsert_check", lambda t: _check(t, "insert")[1],
         with_views("SELECT * FROM checked", "products", "categories", extra=_catalog_check_ctes("insert")),
         "P7 create form: every inactive product listed again under a new id")
register("catalog_update_check", lambda t: _check(t, "update")[1],
         with_views("SELECT * FROM checked", "products", "categories", extra=_catalog_check_ctes("update")),
         "P7 update form: every product re-submitted, some under the SKU or barcode of a neighbour")

PRODUCT_ROW_SQL = f"""
    SELECT i.id, trim(i.sku) AS sku, NULLIF(trim(i.barcode), '') AS barcode, trim(i.name) AS name,
           NULLIF(trim(i.description), '') AS description,
           CASE WHEN i.category_id IS NOT NULL AND i.category_id <> 0 THEN i.category_id END AS category_id,
           NULLIF(trim(i.brand), '') AS brand, COALESCE(NULLIF(trim(i.unit_size), ''), 'pcs') AS unit_size,
           CAST(CAST(i.price AS DECIMAL(10,2)) AS DOUBLE) AS price,
           CAST(NULLIF(CAST(i.cost AS DECIMAL(10,2)), 0) AS DOUBLE) AS cost,
           CAST(COALESCE(i.min_stock_level, 0) AS INTEGER) AS min_stock_level"""


def _money_cols(df):
    return df.withColumn("price", F.col("price").cast("double")).withColumn("cost", F.col("cost").cast("double"))


def _insert(t):
    inc, chk = _check(t, "insert")
    return _money_cols(C.catalog_insert(t, inc, chk, NOW)[0])


register("catalog_insert", _insert, with_views(f"""
    {PRODUCT_ROW_SQL}, CAST(NULL AS VARCHAR) AS image_url, 1 AS is_active,
           TIMESTAMP '{NOW}' AS created_at, TIMESTAMP '{NOW}' AS updated_at
    FROM inc i JOIN checked k ON k.req_id = i.req_id AND k.ok = 1""", "products", "categories",
    extra=_catalog_check_ctes("insert")), "P8: accepted relisted products as new rows")


def _update(t):
    inc, chk = _check(t, "update")
    return _money_cols(C.catalog_update(t, inc, chk, NOW))


register("catalog_update", _update, with_views(f"""
    SELECT id, sku, barcode, name, description, category_id, brand, unit_size, CAST(price AS DOUBLE) AS price,
           CAST(cost AS DOUBLE) AS cost, min_stock_level, image_url, is_active, created_at, updated_at
    FROM products WHERE id NOT IN (SELECT i.id FROM inc i JOIN checked k ON k.req_id = i.req_id AND k.ok = 1)
    UNION ALL
    {PRODUCT_ROW_SQL}, p.image_url, p.is_active, p.created_at, TIMESTAMP '{NOW}' AS updated_at
    FROM inc i JOIN checked k ON k.req_id = i.req_id AND k.ok = 1 JOIN products p ON p.id = i.id""",
    "products", "categories", extra=_catalog_check_ctes("update")), "P9: the products table after the updates")

register("product_soft_delete", lambda t: C.product_soft_delete(t, SI.product_delete_requests(t)), with_views("""
    SELECT req_id, product_id, reason, CAST(reason IS NULL AS INTEGER) AS ok FROM (
        SELECT p.id AS req_id, p.id AS product_id,
               CASE WHEN p.is_active <> 1 THEN 'Product not found'
                    WHEN EXISTS (SELECT 1 FROM sale_items si WHERE si.product_id = p.id)
                    THEN 'Cannot delete product that has been sold. You can only deactivate it.' END AS reason
        FROM products p)""", "products", "sale_items"), "P10: a delete request for every product")

register("category_insert_check", lambda t: C.category_insert_check(t, SI.category_insert_requests(t)), with_views("""
    SELECT req_id, name, parent_id, reason, CAST(reason IS NULL AS INTEGER) AS ok FROM (
        SELECT *, COALESCE(pre, CASE WHEN req_id > MIN(CASE WHEN pre IS NULL THEN req_id END)
                                     OVER (PARTITION BY name, COALESCE(parent_id, -1))
                                THEN 'Category with this name already exists at this level' END) AS reason
        FROM (
            SELECT i.req_id, trim(i.name) AS name, i.parent_id,
                   CASE WHEN trim(i.name) IS NULL OR trim(i.name) = '' THEN 'Validation failed'
                        WHEN i.parent_id IS NOT NULL AND NOT EXISTS (
                             SELECT 1 FROM categories c WHERE c.is_active = 1 AND c.id = i.parent_id)
                        THEN 'Parent category not found'
                        WHEN EXISTS (SELECT 1 FROM categories c WHERE c.is_active = 1 AND c.name = trim(i.name)
                                     AND c.parent_id IS NOT DISTINCT FROM i.parent_id)
                        THEN 'Category with this name already exists at this level' END AS pre
            FROM (SELECT id AS req_id, name, description,
                         CASE WHEN parent_id IS NOT NULL AND parent_id <> 0 THEN parent_id END AS parent_id
                  FROM categories) i))""", "categories"), "C5: every category submitted again")

CLOSURE_SQL = """
    WITH RECURSIVE r(ancestor_id, descendant_id, path) AS (
        SELECT c.parent_id, c.id, [c.parent_id, c.id] FROM categories c
        WHERE c.is_active = 1 AND c.parent_id IS NOT NULL
        UNION ALL
        SELECT r.ancestor_id, c.id, list_append(r.path, c.id)
        FROM r JOIN categories c ON c.parent_id = r.descendant_id AND c.is_active = 1
        WHERE NOT list_contains(r.path, c.id)
    ) SELECT ancestor_id, descendant_id FROM r"""
register("category_reparent_check", lambda t: C.category_reparent_check(t, SI.category_reparent_requests(t)),
         with_views("""
    SELECT s.req_id, id, name, parent_id, COALESCE(pre, CASE WHEN w.clash = 0 THEN 'Category with this name already exists at this level' END)
             AS reason, CAST(pre IS NULL AND w.clash IS NULL AS INTEGER) AS ok
    FROM submitted s JOIN walk w ON w.req_id = s.req_id""",
    "categories", extra={"clo": CLOSURE_SQL, "submitted": """
        SELECT i.*,
               CASE WHEN i.name IS NULL OR i.name = '' THEN 'Validation failed'
                    WHEN NOT EXISTS (SELECT 1 FROM categories c WHERE c.is_active = 1 AND c.id = i.id)
                    THEN 'Category not found'
                    WHEN i.parent_id = i.id THEN 'Category cannot be its own parent'
                    WHEN i.parent_id IS NOT NULL AND NOT EXISTS (
                         SELECT 1 FROM categories c WHERE c.is_active = 1 AND c.id = i.parent_id)
                    THEN 'Parent category not found'
                    WHEN EXISTS (SELECT 1 FROM clo WHERE clo.ancestor_id = i.id AND clo.descendant_id = i.parent_id)
                    THEN 'Cannot create circular reference' END AS pre
        FROM (SELECT c.id AS req_id, c.id, trim(c.name) AS name,
                     CASE WHEN c.parent_id IS NULL THEN k.lowest ELSE c.parent_id % 6 + 1 END AS parent_id
              FROM categories c LEFT JOIN (SELECT parent_id, MIN(id) AS lowest FROM categories
                                           WHERE parent_id IS NOT NULL GROUP BY parent_id) k ON k.parent_id = c.id) i""",
        "holders": "SELECT id, concat_ws(':', COALESCE(parent_id, -1), name) AS k0 FROM categories WHERE is_active = 1",
        "claims": """SELECT req_id, id, pre IS NULL AS alive, FALSE AS late, concat_ws(':', COALESCE(parent_id, -1), name) AS k0
                     FROM submitted""", **batch_walk(1)}), "C6: roots under their own child, children to the next root")

register("category_soft_delete", lambda t: C.category_soft_delete(t, SI.category_delete_requests(t)), with_views("""
    SELECT req_id, id, reason, CAST(reason IS NULL AS INTEGER) AS ok FROM (
        SELECT c.id AS req_id, c.id,
               CASE WHEN c.is_active <> 1 THEN 'Category not found'
                    WHEN np.n > 0 THEN printf('Cannot delete category. It has %d products assigned to it.', np.n)
                    WHEN nk.n > 0 THEN printf('Cannot delete category. It has %d subcategories.', nk.n) END AS reason
        FROM categories c
        LEFT JOIN (SELECT category_id, COUNT(*) AS n FROM products WHERE is_active = 1 GROUP BY category_id) np
          ON np.category_id = c.id
        LEFT JOIN (SELECT parent_id, COUNT(*) AS n FROM categories WHERE is_active = 1 AND parent_id IS NOT NULL
                   GROUP BY parent_id) nk ON nk.parent_id = c.id)""", "categories", "products"),
    "C7: a delete request for every category")

register("user_insert_check", lambda t: C.user_insert_check(t, SI.user_insert_requests(t)), with_views(f"""
    SELECT req_id, username, email, reason, CAST(reason IS NULL AS INTEGER) AS ok FROM (
        SELECT *, COALESCE(pre,
            CASE WHEN req_id > MIN(CASE WHEN pre IS NULL THEN req_id END) OVER (PARTITION BY username)
                 THEN 'Username already exists'
                 WHEN req_id > MIN(CASE WHEN pre IS NULL THEN req_id END) OVER (PARTITION BY email)
                 THEN 'Email already exists' END) AS reason
        FROM (
            SELECT i.req_id, i.username, i.email,
                   CASE WHEN i.username IS NULL OR i.username = '' OR length(i.username) < 3
                             OR NOT COALESCE(regexp_matches(i.email, '{C.EMAIL_PATTERN}'), FALSE)
                             OR i.password IS NULL OR length(i.password) < 6
                             OR i.role IS NULL OR i.role NOT IN ('admin', 'cashier')
                             OR trim(i.first_name) IS NULL OR trim(i.first_name) = ''
                             OR trim(i.last_name) IS NULL OR trim(i.last_name) = '' THEN 'Validation failed'
                        WHEN EXISTS (SELECT 1 FROM users u WHERE u.username = i.username) THEN 'Username already exists'
                        WHEN EXISTS (SELECT 1 FROM users u WHERE lower(u.email) = i.email) THEN 'Email already exists'
                   END AS pre
            FROM (SELECT id AS req_id, trim(username) AS username, lower(trim(email)) AS email, username AS password,
                         role, first_name, last_name FROM users) i))""", "users"),
    "U3: every user submitted again (password = username)")

register("user_partial_update", lambda t: C.user_partial_update(t, SI.user_deactivation_patches(t)), with_views("""
    SELECT u.id AS req_id, u.id,
           CASE WHEN u.id = 0 THEN 'You cannot deactivate your own account' END AS reason,
           CAST(u.id <> 0 AS INTEGER) AS ok, u.username, u.email, u.role, u.first_name, u.last_name,
           CASE WHEN u.id = 0 THEN u.is_active ELSE 0 END AS is_active
    FROM users u""", "users"), "U4: user 0 deactivates every user (only is_active supplied)")

register("user_soft_delete", lambda t: C.user_soft_delete(t, SI.user_delete_requests(t)), with_views("""
    SELECT req_id, id, reason, CAST(reason IS NULL AS INTEGER) AS ok FROM (
        SELECT u.id AS req_id, u.id,
               CASE WHEN u.id = 0 THEN 'You cannot delete your own account'
                    WHEN n.n > 0 THEN printf('Cannot delete user. They have %d sales records. '
                                             || 'You can deactivate the user instead.', n.n) END AS reason
        FROM users u LEFT JOIN (SELECT cashier_id, COUNT(*) AS n FROM sales WHERE cashier_id IS NOT NULL
                                GROUP BY cashier_id) n ON n.cashier_id = u.id)""", "users", "sales"),
    "U5: user 0 deletes every user")


register("products_after_soft_delete", lambda t: C.products_after_delete(t, C.product_soft_delete(t, SI.product_delete_requests(t)))[0].select(
    "id", "sku", "is_active"), with_views("""
    SELECT id, sku, CASE WHEN id IN (SELECT product_id FROM sale_items) THEN is_active ELSE 0 END AS is_active FROM products""",
    "products", "sale_items"), "P10: the products after the deletions")
register("variants_after_soft_delete", lambda t: C.products_after_delete(t, C.product_soft_delete(t, SI.product_delete_requests(t)))[1].select(
    "id", "product_id", "is_active"), with_views("""
    SELECT v.id, v.product_id, CASE WHEN p.is_active = 1 AND p.id NOT IN (SELECT product_id FROM sale_items) THEN 0 ELSE v.is_active END AS is_active
    FROM product_variants v LEFT JOIN products p ON p.id = v.product_id""", "products", "product_variants", "sale_items"),
    "P10: the variants after the deletions")
register("categories_after_soft_delete", lambda t: C.deactivated(t.categories, C.category_soft_delete(t, SI.category_delete_requests(t))).select(
    "id", "name", "is_active"), with_views("""
    SELECT c.id, c.name, CASE WHEN EXISTS (SELECT 1 FROM products p WHERE p.is_active = 1 AND p.category_id = c.id)
                                OR EXISTS (SELECT 1 FROM categories k WHERE k.is_active = 1 AND k.parent_id = c.id)
                              THEN c.is_active ELSE 0 END AS is_active FROM categories c""", "categories", "products"),
    "C7: the categories after the deletions")
register("users_after_soft_delete", lambda t: C.deactivated(t.users, C.user_soft_delete(t, SI.user_delete_requests(t))).select(
    "id", "username", "is_active"), with_views("""
    SELECT u.id, u.username, CASE WHEN u.id = 0 OR u.id IN (SELECT cashier_id FROM sales WHERE cashier_id IS NOT NULL)
                                  THEN u.is_active ELSE 0 END AS is_active FROM users u""", "users", "sales"),
    "U5: the users after the deletions")
