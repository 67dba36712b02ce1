"""Registered catalogue and category queries (P1–P6, C1–C4, C8) with oracle SQL."""

from __future__ import annotations

from tillbook.operators import catalog as P
from tillbook.oracle.ledger_sql import MOVEMENTS_CTES
from tillbook.oracle.views_sql import with_views
from tillbook.plans.registry import register

PROD_SEL = ("p.id, p.sku, p.barcode, p.name, p.description, p.category_id, p.brand, p.unit_size, "
            "CAST(p.price AS DOUBLE) AS price, CAST(p.cost AS DOUBLE) AS cost, p.min_stock_level, p.image_url, "
            "p.is_active, p.created_at, p.updated_at")
# an active product beside its category's name and its base stock row, each looked up on its own
SHELF = {
    "base_stock": "SELECT product_id, quantity, reserved_quantity FROM stock WHERE variant_id IS NULL",
    "shelf": """SELECT p.*, b.quantity, b.reserved_quantity, (SELECT c.name FROM categories c WHERE c.id = p.category_id)
                       AS category_name
                FROM (SELECT * FROM products WHERE is_active = 1) p LEFT JOIN base_stock b ON b.product_id = p.id"""}
STOCK_SEL = ("p.category_name, p.quantity, p.reserved_quantity, p.quantity - p.reserved_quantity AS available_quantity, "
             "if(p.quantity <= p.min_stock_level, 1, 0) AS is_low_stock")
SEARCH_SQL = ("(p.name ILIKE '%{t}%' OR p.sku ILIKE '%{t}%' OR p.barcode ILIKE '%{t}%' OR p.brand ILIKE '%{t}%')")


def _list_sql(where: str, order: str, limit: int, offset: int) -> str:
    """The rows whose place in the order falls on the page."""
    return with_views(f"""
        SELECT {PROD_SEL}, {STOCK_SEL}
        FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY {order}) AS place FROM shelf p WHERE {where}) p
        WHERE p.place > {offset} AND p.place <= {offset + limit}""", "products", "categories", "stock", extra=SHELF)


register("products_list", lambda t: P.products_list(t),
         _list_sql("TRUE", "p.name ASC NULLS FIRST, p.id ASC", 20, 0), "P1 first page by name")
register("products_list_sorted",
         lambda t: P.products_list(t, search="Brand#1", sort_by="price", sort_order="desc", page=2, limit=10),
         _list_sql(SEARCH_SQL.format(t="Brand#1"), "p.price DESC NULLS LAST, p.id DESC", 10, 10),
         "P1 brand search by price desc, second page")
register("products_count", lambda t: P.products_count(t, search="Brand#1", limit=10), with_views(f"""
    SELECT COUNT(*) AS total, 10 AS per_page, CAST(ceil(COUNT(*) / 10.0) AS BIGINT) AS total_pages
    FROM products p LEFT JOIN stock s ON p.id = s.product_id AND s.variant_id IS NULL
    WHERE p.is_active = 1 AND {SEARCH_SQL.format(t='Brand#1')}""", "products", "stock"), "P2")
register("product_detail", lambda t: P.product_detail(t), with_views(
    f"SELECT {PROD_SEL}, {STOCK_SEL} FROM shelf p", "products", "categories", "stock", extra=SHELF),
    "P3 for every active product")
register("product_variants_stock", lambda t: P.product_variants_stock(t), with_views("""
    SELECT * EXCLUDE (price_adjustment), CAST(price_adjustment AS DOUBLE) AS price_adjustment,
           quantity - reserved_quantity AS available_quantity
    FROM (SELECT * FROM product_variants WHERE is_active = 1) LEFT JOIN (
        SELECT variant_id AS id, quantity, reserved_quantity FROM stock WHERE variant_id IS NOT NULL) USING (id)""",
    "product_variants", "stock"), "P4")
register("recent_movements_per_product", lambda t: P.recent_movements_per_product(t), with_views("""
    SELECT m.*, u.first_name || ' ' || u.last_name AS created_by_name
    FROM (SELECT *, CAST(ROW_NUMBER() OVER (PARTITION BY product_id ORDER BY created_at DESC, id DESC) AS INTEGER) AS rank
          FROM stock_movements) m LEFT JOIN users u ON m.created_by = u.id
    WHERE m.rank <= 10""", "users", "stock_ops", extra=MOVEMENTS_CTES), "P5")
register("product_search", lambda t: P.product_search(t, "gear"), with_views("""
    SELECT id, sku, barcode, name, CAST(price AS DOUBLE) AS price, unit_size, category_name, quantity, reserved_quantity,
           quantity - reserved_quantity AS available_quantity
    FROM shelf WHERE contains(lower(concat_ws(chr(10), sku, barcode, name)), 'gear')
    QUALIFY ROW_NUMBER() OVER (ORDER BY name ASC NULLS FIRST, id) <= 10""",
    "products", "categories", "stock", extra=SHELF), "P6")

CAT_ROWS = """
    SELECT c.id, c.name, c.description, c.parent_id, c.is_active, c.created_at, c.updated_at,
           pc.name AS parent_name, COALESCE(n.cnt, 0) AS product_count
    FROM categories c LEFT JOIN categories pc ON c.parent_id = pc.id
    LEFT JOIN (SELECT category_id, COUNT(*) AS cnt FROM products WHERE is_active = 1 GROUP BY category_id) n
      ON n.category_id = c.id
    WHERE c.is_active = 1"""
CLOSURE = """
    WITH RECURSIVE r(ancestor_id, descendant_id, depth, path, path_names) AS (
        SELECT c.parent_id, c.id, 1, [c.parent_id, c.id], [pc.name, c.name]
        FROM categories c LEFT JOIN categories pc ON pc.id = c.parent_id
        WHERE c.is_active = 1 AND c.parent_id IS NOT NULL
        UNION ALL
        SELECT r.ancestor_id, c.id, r.depth + 1, list_append(r.path, c.id), list_append(r.path_names, c.name)
        FROM r JOIN categories c ON c.parent_id = r.descendant_id AND c.is_active = 1
        WHERE NOT list_contains(r.path, c.id)
    ) SELECT * FROM r"""

register("category_detail", lambda t: P.category_detail(t), with_views("SELECT * FROM cat_rows", "categories",
                                                                       "products", extra={"cat_rows": CAT_ROWS}), "C3")
register("category_tree", lambda t: P.category_tree(t), with_views("""
    SELECT cr.*, CAST(rt.root_id IS NOT NULL AS INTEGER) AS in_tree, rt.root_id, rt.depth, rt.path
    FROM cat_rows cr LEFT JOIN (
        SELECT descendant_id AS id, ancestor_id AS root_id, depth, array_to_string(path_names, ' > ') AS path
        FROM clo WHERE ancestor_id IN (SELECT id FROM categories WHERE is_active = 1 AND parent_id IS NULL)
        UNION ALL
        SELECT id, id, 0, name FROM categories WHERE is_active = 1 AND parent_id IS NULL
    ) rt ON rt.id = cr.id""", "categories", "products", extra={"cat_rows": CAT_ROWS, "clo": CLOSURE}), "C1")
register("categories_flat", lambda t: P.categories_flat(t), with_views("""
    SELECT c.id, c.name, c.parent_id, pc.name AS parent_name,
           CASE WHEN c.parent_id IS NOT NULL THEN pc.name || ' > ' || c.name ELSE c.name END AS display_name
    FROM categories c LEFT JOIN categories pc ON c.parent_id = pc.id WHERE c.is_active = 1""", "categories"), "C2")
register("subcategories", lambda t: P.subcategories(t), with_views("""
    SELECT parent_id, id, name, description, created_at FROM categories
    WHERE is_active = 1 AND parent_id IS NOT NULL""", "categories"), "C4 for every parent")
register("category_descendants",
         lambda t: P.category_descendants(t).select("ancestor_id", "descendant_id", "depth"),
         with_views("SELECT ancestor_id, descendant_id, depth FROM clo", "categories", extra={"clo": CLOSURE}),
         "C8 closure")
