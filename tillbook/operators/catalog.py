"""Catalogue and category read operators."""

from __future__ import annotations


from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.exprs import all_of, contains_any, full_name, is_low, money
from tillbook.operators.dashboard import products_with_stock
from tillbook.plans.graph import lineage
from tillbook.session import checkpoint_dir
from tillbook.sources.views import RetailTables

PRODUCT_COLS = ("id", "sku", "barcode", "name", "description", "category_id", "brand", "unit_size", "price", "cost",
                "min_stock_level", "image_url", "is_active", "created_at", "updated_at")
# Fixed value of the reference: the sortable fields of the product list.
SORT_FIELDS = ("name", "sku", "price", "quantity", "created_at", "brand")


def _product_out(df: DataFrame, *extra) -> DataFrame:
    cols = [money(c).alias(c) if c in ("price", "cost") else F.col(c) for c in PRODUCT_COLS]
    return df.select(*cols, *extra)


def _psc(t: RetailTables, active_only: bool = True) -> DataFrame:
    ps = products_with_stock(t, active_only)
    c = t.categories.select(F.col("id").alias("c_id"), F.col("name").alias("category_name"))
    return ps.join(c, ps.category_id == c.c_id, "left").drop("c_id")


def _stock_cols():
    return ("category_name", "quantity", "reserved_quantity",
            (F.col("quantity") - F.col("reserved_quantity")).alias("available_quantity"),
            is_low().alias("is_low_stock"))


def _list_filter(search, category_id, low_stock) -> F.Column:
    preds = []
    if search:
        preds.append(contains_any(search, "name", "sku", "barcode", "brand"))
    if category_id is not None and category_id != "":
        preds.append(F.col("category_id") == F.lit(int(category_id)))
    if low_stock:
        preds.append(F.col("quantity") <= F.col("min_stock_level"))
    return all_of(*preds)


def products_list(t: RetailTables, search=None, category_id=None, sort_by: str = "name", sort_order: str = "ASC",
                  low_stock: bool = False, page: int = 1, limit: int = 20) -> DataFrame:
    """Page of active products with category and stock; allow-listed sort, id as tie-break."""
    field = sort_by if sort_by in SORT_FIELDS else "name"
    desc = str(sort_order).upper() == "DESC"
    key = F.col(field).desc_nulls_last() if desc else F.col(field).asc_nulls_first()
    ps = products_with_stock(t).filter(_list_filter(search, category_id, low_stock))
    order = [key, F.col("id").desc() if desc else F.col("id").asc()]
    top = ps.orderBy(*order).offset((page - 1) * limit).limit(limit)
    c = t.categories.select(F.col("id").alias("c_id"), F.col("name").alias("category_name"))
    j = top.join(c, top.category_id == c.c_id, "left")
    return _product_out(j.orderBy(*order), *_stock_cols())


def products_count(t: RetailTables, search=None, category_id=None, low_stock: bool = False,
                   limit: int = 20) -> DataFrame:
    """Rows and pages under the list filters (no category join; no stock join unless filtered on stock)."""
    ps = products_with_stock(t) if low_stock else t.products.filter(F.col("is_active") == 1)
    ps = ps.filter(_list_filter(search, category_id, low_stock))
    return ps.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(limit).alias("per_page"), F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("total_pages"))


def product_detail(t: RetailTables, ids: DataFrame | None = None) -> DataFrame:
    """Active products (all, or the ``id`` column of ``ids``) with category and stock.

    Variants (P4) and recent movements (P5) are separate keyed frames; join them by
    product id when a document is wanted.
    """
    ps = _psc(t)
    if ids is not None:
        ps = ps.join(ids.select("id"), "id", "left_semi")
    return _product_out(ps, *_stock_cols())


def product_variants_stock(t: RetailTables) -> DataFrame:
    """Active variants with their stock row (matched on variant id)."""
    v = t.product_variants.filter(F.col("is_active") == 1)
    s = t.stock.filter(F.col("variant_id").isNotNull()).select(
        F.col("variant_id").alias("s_vid"), "quantity", "reserved_quantity")
    j = v.join(s, v.id == s.s_vid, "left")
    return j.select("id", "product_id", "variant_name", "variant_value", "sku_suffix",
                    money("price_adjustment").alias("price_adjustment"), "is_active", "created_at", "quantity",
                    "reserved_quantity", (F.col("quantity") - F.col("reserved_quantity")).alias("available_quantity")).orderBy(
        "product_id", "variant_name", "variant_value", "id")


def recent_movements_per_product(t: RetailTables, n: int = 10) -> DataFrame:
    """P5: the last ``n`` movements of every product, with the actor's name.

    ``row_number() <= n`` over (product ORDER BY created_at DESC, id DESC): Spark plans a
    WindowGroupLimit before the shuffle, so at most ``n`` rows per product and map
    partition travel, however hot the product.
    """
    m = t.stock_movements
    w = Window.partitionBy("product_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    top = m.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    u = t.users.select(F.col("id").alias("u_id"), full_name("first_name", "last_name").alias("created_by_name"))
    return top.join(u, top.created_by == u.u_id, "left").drop("u_id")


def product_search(t: RetailTables, term: str, limit: int = 10) -> DataFrame:
    """POS lookup: active products whose sku, barcode or name contains ``term``; first 10 by name."""
    ps = products_with_stock(t).filter(contains_any(term, "sku", "barcode", "name"))
    top = ps.orderBy(F.col("name").asc_nulls_first(), F.col("id").asc()).limit(limit)
    c = t.categories.select(F.col("id").alias("c_id"), F.col("name").alias("category_name"))
    j = top.join(c, top.category_id == c.c_id, "left")
    return j.select("id", "sku", "barcode", "name", money("price").alias("price"), "unit_size", "category_name",
                    "quantity", "reserved_quantity",
                    (F.col("quantity") - F.col("reserved_quantity")).alias("available_quantity")).orderBy(
        F.col("name").asc_nulls_first(), F.col("id").asc())


def _category_rows(t: RetailTables) -> DataFrame:
    """Active categories with parent name and active-product count (count pre-aggregated)."""
    c = t.categories.filter(F.col("is_active") == 1)
    par = t.categories.select(F.col("id").alias("p_id"), F.col("name").alias("parent_name"))
    cnt = (t.products.filter((F.col("is_active") == 1) & F.col("category_id").isNotNull())
           .groupBy("category_id").agg(F.count(F.lit(1)).alias("product_count")))
    j = c.join(par, c.parent_id == par.p_id, "left").join(cnt, c.id == cnt.category_id, "left")
    return j.select("id", "name", "description", "parent_id", "is_active", "created_at", "updated_at", "parent_name",
                    F.coalesce(F.col("product_count"), F.lit(0).cast("bigint")).alias("product_count"))


def category_detail(t: RetailTables, ids: DataFrame | None = None) -> DataFrame:
    """Active categories (all, or those in ``ids``) with parent name and product count."""
    rows = _category_rows(t)
    return rows if ids is None else rows.join(ids.select("id"), "id", "left_semi")


def category_tree(t: RetailTables) -> DataFrame:
    """The tree as flat rows: C3 columns + ``in_tree``, depth, root id and path of names.

    A category is in the tree when every ancestor is active and the chain ends at a
    root (the reference's builder drops children whose parent is missing from the
    active set, H29). Depth and path come from path doubling (``lineage``); the
    nested ``children`` arrays of the reference are not materialised (unbounded groups).
    """
    rows = _category_rows(t)
    act = t.categories.filter(F.col("is_active") == 1)
    reach = lineage(act.select("id", F.col("parent_id").alias("parent"), "name")).filter("ended = 1").select(
        "id", F.col("top").alias("root_id"), "depth", "names")
    j = rows.join(reach, "id", "left")
    return j.select(*rows.columns, F.col("root_id").isNotNull().cast("int").alias("in_tree"), "root_id", "depth",
                    F.array_join("names", " > ").alias("path"))


def categories_flat(t: RetailTables) -> DataFrame:
    """Active categories with ``parent > child`` display names."""
    c = t.categories.filter(F.col("is_active") == 1)
    par = t.categories.select(F.col("id").alias("p_id"), F.col("name").alias("parent_name"))
    j = c.join(par, c.parent_id == par.p_id, "left")
    disp = F.when(F.col("parent_id").isNotNull(), F.concat(F.col("parent_name"), F.lit(" > "), F.col("name"))
                  ).otherwise(F.col("name"))
    return j.select("id", "name", "parent_id", "parent_name", disp.alias("display_name")).orderBy("display_name", "id")


def subcategories(t: RetailTables) -> DataFrame:
    """C4: active children of every category (parent_id, id, name, description, created_at)."""
    c = t.categories.filter((F.col("is_active") == 1) & F.col("parent_id").isNotNull())
    return c.select("parent_id", "id", "name", "description", "created_at").orderBy("parent_id", "name", "id")


def category_descendants(t: RetailTables, include_self: bool = False) -> DataFrame:
    """Every (ancestor, active descendant) pair with depth and the path of names.

    Descent follows active children only (as the reference's breadth-first helper), twice as far
    from round to round; a cycle in the data stops where it meets its own path. ``include_self`` adds
    (id, id, 0) for every active category.
    """
    c = t.categories
    act = c.filter(F.col("is_active") == 1)
    kids = act.filter(F.col("parent_id").isNotNull()).select(F.col("parent_id").alias("_up"), F.col("id").alias("_kid"),
                                                           F.col("name").alias("_name"))
    names = c.select(F.col("id").alias("_up"), F.col("name").alias("_up_name"))
    first = kids.join(names, "_up", "left").select(
        F.col("_up").alias("ancestor_id"), F.col("_kid").alias("descendant_id"), F.lit(1).alias("depth"),
        F.array("_up", "_kid").alias("path"), F.array("_up_name", "_name").alias("path_names"))
    checkpoint_dir(t.spark)
    pairs, edge, reach = first.checkpoint(eager=True), None, 1
    edge = pairs
    while not edge.isEmpty():
        # paths of ``reach`` links, each followed by one of up to as many
        on = pairs.select(F.col("ancestor_id").alias("_up"), F.col("descendant_id").alias("_kid"), F.col("depth").alias("_depth"),
                          F.col("path").alias("_path"), F.col("path_names").alias("_names"))
        new = edge.join(on, F.col("descendant_id") == F.col("_up")).select(
            "ancestor_id", F.col("_kid").alias("descendant_id"), (F.col("depth") + F.col("_depth")).alias("depth"),
            F.concat("path", F.slice("_path", 2, F.size("_path"))).alias("path"),
            F.concat("path_names", F.slice("_names", 2, F.size("_names"))).alias("path_names"))
        new = new.filter(F.size(F.array_distinct("path")) == F.size("path")).checkpoint(eager=True)
        reach *= 2
        pairs, edge = pairs.unionByName(new), new.filter(F.col("depth") == reach)
    if not include_self:
        return pairs
    return pairs.unionByName(act.select(F.col("id").alias("ancestor_id"), F.col("id").alias("descendant_id"), F.lit(0).alias("depth"),
                                        F.array("id").alias("path"), F.array("name").alias("path_names")))
