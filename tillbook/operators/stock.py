"""Stock read operators (levels, movement history, alerts, post-adjust rows)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.exprs import all_of, contains_any, full_name, is_low, money, stock_status
from tillbook.functions.periods import day_range
from tillbook.operators.dashboard import products_with_stock
from tillbook.sources.views import RetailTables


def _stock_filter(low_stock_only: bool, category_id, search) -> F.Column:
    preds = []
    if low_stock_only:
        preds.append(F.col("quantity") <= F.col("min_stock_level"))
    if category_id is not None and category_id != "":
        preds.append(F.col("category_id") == F.lit(int(category_id)))
    if search:
        preds.append(contains_any(search, "name", "sku", "barcode"))
    return all_of(*preds)


def stock_levels(t: RetailTables, low_stock_only: bool = False, category_id=None, search=None,
                 page: int = 1, limit: int = 50) -> DataFrame:
    """K1: page of active products with stock, low flag and status; low first, then quantity, name."""
    ps = products_with_stock(t).filter(_stock_filter(low_stock_only, category_id, search))
    ps = ps.withColumn("is_low_stock", is_low())
    top = (ps.orderBy(F.col("is_low_stock").desc(), F.col("quantity").asc_nulls_first(),
                      F.col("name").asc_nulls_first(), F.col("id").asc())
           .offset((page - 1) * limit).limit(limit))
    c = t.categories.select(F.col("id").alias("c_id"), F.col("name").alias("category_name"))
    j = top.join(c, top.category_id == c.c_id, "left")
    return j.select("id", "sku", "name", money("price").alias("price"), "min_stock_level", "unit_size",
                    "category_name", "quantity", "reserved_quantity",
                    (F.col("quantity") - F.col("reserved_quantity")).alias("available_quantity"), "last_updated",
                    "is_low_stock", stock_status().alias("stock_status")).orderBy(
        F.col("is_low_stock").desc(), F.col("quantity").asc_nulls_first(), F.col("name").asc_nulls_first(), F.col("id").asc())


def stock_levels_count(t: RetailTables, low_stock_only: bool = False, category_id=None, search=None,
                       limit: int = 50) -> DataFrame:
    """K2: rows and pages under the same filters (the stock join only when filtering on stock)."""
    ps = products_with_stock(t) if low_stock_only else t.products.filter(F.col("is_active") == 1)
    ps = ps.filter(_stock_filter(low_stock_only, category_id, search))
    return ps.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(limit).alias("per_page"), F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("total_pages"))


def _movement_filter(product_id, movement_type, date_from, date_to) -> F.Column:
    preds = [day_range("created_at", date_from, date_to)]
    if product_id is not None and product_id != "":
        preds.append(F.col("product_id") == F.lit(int(product_id)))
    if movement_type:
        preds.append(F.col("movement_type") == F.lit(movement_type))
    return all_of(*preds)


def movement_history(t: RetailTables, product_id=None, movement_type=None, date_from=None, date_to=None,
                     page: int = 1, limit: int = 50) -> DataFrame:
    """K4: page of the ledger, newest first, with product, variant and actor (top-N before joins)."""
    m = t.stock_movements.filter(_movement_filter(product_id, movement_type, date_from, date_to))
    top = m.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset((page - 1) * limit).limit(limit)
    p = t.products.select(F.col("id").alias("p_id"), F.col("name").alias("product_name"), "sku")
    v = t.product_variants.select(F.col("id").alias("v_id"), "variant_name", "variant_value")
    u = t.users.select(F.col("id").alias("u_id"), full_name("first_name", "last_name").alias("created_by_name"))
    j = (top.join(p, top.product_id == p.p_id, "left").join(v, top.variant_id == v.v_id, "left")
         .join(u, top.created_by == u.u_id, "left"))
    return j.drop("p_id", "v_id", "u_id").orderBy(F.col("created_at").desc(), F.col("id").desc())


def movement_count(t: RetailTables, product_id=None, movement_type=None, date_from=None, date_to=None,
                   limit: int = 50) -> DataFrame:
    """K5: rows and pages under the movement filters, no joins."""
    m = t.stock_movements.filter(_movement_filter(product_id, movement_type, date_from, date_to))
    return m.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(limit).alias("per_page"), F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("total_pages"))


def alerts_by_status(t: RetailTables, status: str = "active", alerts: DataFrame | None = None) -> DataFrame:
    """K8: alerts of one status for active products, with category, variant and acknowledger."""
    a = (t.low_stock_alerts if alerts is None else alerts).filter(F.col("alert_status") == status)
    p = t.products.filter(F.col("is_active") == 1).select(
        F.col("id").alias("p_id"), F.col("name").alias("product_name"), "sku", "unit_size", "category_id")
    c = t.categories.select(F.col("id").alias("c_id"), F.col("name").alias("category_name"))
    v = t.product_variants.select(F.col("id").alias("v_id"), "variant_name", "variant_value")
    u = t.users.select(F.col("id").alias("u_id"), full_name("first_name", "last_name").alias("acknowledged_by_name"))
    j = (a.join(p, a.product_id == p.p_id, "inner").join(c, F.col("category_id") == c.c_id, "left")
         .join(v, a.variant_id == v.v_id, "left").join(u, a.acknowledged_by == u.u_id, "left"))
    return j.drop("p_id", "c_id", "v_id", "u_id", "category_id").orderBy(F.col("created_at").desc(), F.col("id").desc())


def stock_after_adjust(t: RetailTables, stock: DataFrame | None = None) -> DataFrame:
    """Stock rows (default: the current table) with product, availability and low flag."""
    s = t.stock if stock is None else stock
    p = t.products.select(F.col("id").alias("p_id"), F.col("name").alias("product_name"), "sku", "min_stock_level")
    j = s.join(p, s.product_id == p.p_id, "inner")
    return j.select("product_id", "variant_id", "product_name", "sku", "quantity", "reserved_quantity",
                    (F.col("quantity") - F.col("reserved_quantity")).alias("available_quantity"),
                    is_low().alias("is_low_stock"))
