"""Dashboard operators (overview, activity, top products, chart, inventory, cashiers).

Shared-scan rule: the reference runs one statement per figure; here each family is a
single pass with conditional aggregates. Top-N lists sort first and join the
dimension rows afterwards.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.exprs import full_name, mean_of, money, stock_status
from tillbook.functions.periods import AS_OF, _d, in_period
from tillbook.operators.sales import _completed_item_agg
from tillbook.sources.views import RetailTables


def base_stock(t: RetailTables) -> DataFrame:
    """The product-level stock row (``variant_id IS NULL``)."""
    return t.stock.filter(F.col("variant_id").isNull()).select(
        F.col("product_id").alias("s_product_id"), "quantity", "reserved_quantity", "last_updated")


def products_with_stock(t: RetailTables, active_only: bool = True) -> DataFrame:
    """PSC without the category: products ⟕ base stock row."""
    p = t.products.filter(F.col("is_active") == 1) if active_only else t.products
    s = base_stock(t)
    return p.join(s, p.id == s.s_product_id, "left").drop("s_product_id")


def _category_names(t: RetailTables) -> DataFrame:
    return t.categories.select(F.col("id").alias("c_id"), F.col("name").alias("category_name"))


def sales_overview(t: RetailTables, as_of=AS_OF) -> DataFrame:
    """Today / last 7 days / last 30 days in one scan; NULL → 0."""
    as_of = _d(as_of)
    s = t.sales.filter(in_period("created_at", "month", as_of))
    today = in_period("created_at", "today", as_of)
    week = in_period("created_at", "week", as_of)
    done = F.col("status") == "completed"
    amt = F.col("total_amount")
    a = s.agg(
        F.count(F.when(today, 1)).alias("today_count"),
        F.sum(F.when(today & done, amt)).alias("t_rev"),
        F.count(F.when(today & done, amt)).alias("t_n"),
        F.count(F.when(week, 1)).alias("week_count"),
        F.sum(F.when(week & done, amt)).alias("w_rev"),
        F.count(F.lit(1)).alias("month_count"),
        F.sum(F.when(done, amt)).alias("m_rev"),
    )
    zero = F.lit(0.0)
    return a.select(
        "today_count", F.coalesce(money("t_rev"), zero).alias("today_revenue"),
        F.coalesce(mean_of(F.col("t_rev"), F.col("t_n")), zero).alias("today_average"),
        "week_count", F.coalesce(money("w_rev"), zero).alias("week_revenue"),
        "month_count", F.coalesce(money("m_rev"), zero).alias("month_revenue"))


def stock_alert_counts(t: RetailTables) -> DataFrame:
    """D2 + D3 fused: active products at/below minimum, and at zero (missing stock row counts in neither)."""
    j = products_with_stock(t)
    return j.agg(F.count(F.when(F.col("quantity") <= F.col("min_stock_level"), 1)).alias("low_stock"),
                 F.count(F.when(F.col("quantity") == 0, 1)).alias("out_of_stock"))


def low_stock_count(t: RetailTables) -> DataFrame:
    """D2 (= K3)."""
    return stock_alert_counts(t).select(F.col("low_stock").alias("count"))


def out_of_stock_count(t: RetailTables) -> DataFrame:
    """D3."""
    return stock_alert_counts(t).select(F.col("out_of_stock").alias("count"))


def entity_counts(t: RetailTables) -> DataFrame:
    """Active products, active categories, active users, active alerts (one row)."""
    flags = (t.products.select(F.lit(0).alias("k"), (F.col("is_active") == 1).alias("hit"))
             .unionByName(t.categories.select(F.lit(1).alias("k"), (F.col("is_active") == 1).alias("hit")))
             .unionByName(t.users.select(F.lit(2).alias("k"), (F.col("is_active") == 1).alias("hit")))
             .unionByName(t.low_stock_alerts.select(F.lit(3).alias("k"), (F.col("alert_status") == "active").alias("hit"))))
    names = ("total_products", "total_categories", "active_users", "pending_alerts")
    return flags.agg(*[F.count(F.when((F.col("k") == i) & F.col("hit"), 1)).alias(n) for i, n in enumerate(names)])


def activity_sales(t: RetailTables, limit: int = 5) -> DataFrame:
    """Latest sales with cashier name (top-N, then the join)."""
    top = t.sales.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    u = t.users.select(F.col("id").alias("u_id"), full_name("first_name", "last_name").alias("cashier_name"))
    return top.join(u, top.cashier_id == u.u_id, "left").select(
        "id", "sale_number", money("total_amount").alias("total_amount"), "status", "created_at", "cashier_name").orderBy(
        F.col("created_at").desc(), F.col("id").desc())


def activity_movements(t: RetailTables, limit: int = 5) -> DataFrame:
    """Latest ledger rows with product and actor."""
    m = t.stock_movements.select("id", "movement_type", "quantity_change", "created_at", "product_id", "created_by")
    top = m.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    p = t.products.select(F.col("id").alias("p_id"), F.col("name").alias("product_name"), "sku")
    u = t.users.select(F.col("id").alias("u_id"), full_name("first_name", "last_name").alias("created_by_name"))
    j = top.join(p, top.product_id == p.p_id, "left").join(u, top.created_by == u.u_id, "left")
    return j.select("id", "movement_type", "quantity_change", "created_at", "product_name", "sku", "created_by_name").orderBy(
        F.col("created_at").desc(), F.col("id").desc())


def activity_alerts(t: RetailTables, limit: int = 5) -> DataFrame:
    """Latest active alerts with product (no active-product filter, as in the reference)."""
    a = t.low_stock_alerts.filter(F.col("alert_status") == "active")
    p = t.products.select(F.col("id").alias("p_id"), F.col("name").alias("product_name"), "sku")
    j = a.join(p, a.product_id == p.p_id, "inner")
    return (j.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
            .select("id", "current_stock", "min_stock_level", "created_at", "product_name", "sku"))


def top_products(t: RetailTables, period: str = "week", as_of=AS_OF, limit: int = 10) -> DataFrame:
    """D8 (flagship): top products by quantity sold in completed sales.

    period ∈ today/week/month/year, anything else = all time (as the reference).
    Aggregation runs before the product/category joins, so the dimension join sees one
    row per product; COUNT(DISTINCT sale) is a count over (sale, product) groups.
    """
    per = period if period in ("today", "week", "month", "year") else "all"
    a = _completed_item_agg(t, per, as_of, with_sale_count=True)
    p = t.products.select("id", "name", "sku", "price", "category_id")
    j = a.join(p, a.product_id == p.id, "inner").join(_category_names(t), F.col("category_id") == F.col("c_id"), "left")
    return (j.orderBy(F.col("total_sold").desc(), F.col("id").asc()).limit(limit)
            .select("id", "name", "sku", money("price").alias("price"), "category_name", "total_sold",
                    money("rev").alias("total_revenue"), "sale_count"))


def chart_slots(t: RetailTables, period: str = "week", as_of=AS_OF) -> DataFrame:
    """The dense label set of the chart: 24 hours, or the last 7 / 30 days ending at ``as_of``."""
    spark = t.spark
    as_of = _d(as_of)
    if period == "today":
        return spark.range(24).select(F.format_string("%02d:00", F.col("id").cast("int")).alias("label"))
    if period in ("week", "month"):
        n = 7 if period == "week" else 30
        start = as_of - dt.timedelta(days=n - 1)
        return spark.range(n).select(
            F.date_format(F.date_add(F.lit(start.isoformat()).cast("date"), F.col("id").cast("int")),
                          "yyyy-MM-dd").alias("label"))
    raise ValueError(f"chart period must be today/week/month, got {period!r}")


def sales_chart(t: RetailTables, period: str = "week", as_of=AS_OF) -> DataFrame:
    """Gap-filled series; count of all sales, revenue of completed ones.

    The 'week' read covers 8 dates but only 7 labels exist, so the oldest date drops
    out in the left join (kept as in the reference).
    """
    slots = chart_slots(t, period, as_of)
    fmt = "HH:00" if period == "today" else "yyyy-MM-dd"
    s = t.sales.filter(in_period("created_at", period, as_of))
    g = s.groupBy(F.date_format("created_at", fmt).alias("label")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("status") == "completed", F.col("total_amount")).otherwise(F.lit(0))).alias("rev"))
    j = slots.join(g, "label", "left")
    return j.select("label", F.coalesce(F.col("n"), F.lit(0).cast("bigint")).alias("sales"),
                    F.coalesce(money("rev"), F.lit(0.0)).alias("revenue")).orderBy("label")


def inventory_by_category(t: RetailTables) -> DataFrame:
    """Active root categories with product count, low/out counts, Σ quantity, Σ value.

    Products ⟕ stock is aggregated per category first; the category side is tiny.
    Products attached to sub-categories are not rolled up (as in the reference).
    """
    ps = products_with_stock(t)
    q = F.col("quantity")
    agg = ps.filter(F.col("category_id").isNotNull()).groupBy("category_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(q <= F.col("min_stock_level"), 1).otherwise(0)).cast("bigint").alias("low"),
        F.sum(F.when(q == 0, 1).otherwise(0)).cast("bigint").alias("out"),
        F.sum(q).alias("total_quantity"), F.sum(q * F.col("price")).alias("val"))
    c = t.categories.filter((F.col("is_active") == 1) & F.col("parent_id").isNull()).select("id", "name")
    j = c.join(agg, c.id == agg.category_id, "left")
    z = F.lit(0).cast("bigint")
    return j.select(F.col("name").alias("category_name"), F.coalesce("n", z).alias("total_products"),
                    F.coalesce("low", z).alias("low_stock_count"), F.coalesce("out", z).alias("out_of_stock_count"),
                    "total_quantity", money("val").alias("total_value")).orderBy("category_name")


def stock_distribution(t: RetailTables) -> DataFrame:
    """Out / low / in-stock counts of active products (a missing stock row is in none)."""
    q, m = F.col("quantity"), F.col("min_stock_level")
    return products_with_stock(t).agg(
        F.sum(F.when(q == 0, 1).otherwise(0)).cast("bigint").alias("out_of_stock"),
        F.sum(F.when((q > 0) & (q <= m), 1).otherwise(0)).cast("bigint").alias("low_stock"),
        F.sum(F.when(q > m, 1).otherwise(0)).cast("bigint").alias("in_stock"))


def inventory_value(t: RetailTables) -> DataFrame:
    """Σ quantity×cost, Σ quantity×price, product count."""
    q = F.col("quantity")
    a = products_with_stock(t).agg(F.sum(q * F.col("cost")).alias("c"), F.sum(q * F.col("price")).alias("r"),
                                   F.count("id").alias("total_products"))
    return a.select(money("c").alias("total_cost_value"), money("r").alias("total_retail_value"), "total_products")


def inventory_status(t: RetailTables) -> DataFrame:
    """D11 + D12 fused into one pass over products ⟕ stock."""
    q, m = F.col("quantity"), F.col("min_stock_level")
    a = products_with_stock(t).agg(
        F.sum(F.when(q == 0, 1).otherwise(0)).cast("bigint").alias("out_of_stock"),
        F.sum(F.when((q > 0) & (q <= m), 1).otherwise(0)).cast("bigint").alias("low_stock"),
        F.sum(F.when(q > m, 1).otherwise(0)).cast("bigint").alias("in_stock"),
        F.sum(q * F.col("cost")).alias("c"), F.sum(q * F.col("price")).alias("r"),
        F.count("id").alias("total_products"))
    return a.select("out_of_stock", "low_stock", "in_stock", money("c").alias("total_cost_value"),
                    money("r").alias("total_retail_value"), "total_products")


def low_stock_products(t: RetailTables, limit: int = 10) -> DataFrame:
    """Lowest active products at/below their minimum, with status label and category."""
    j = products_with_stock(t).filter(F.col("quantity") <= F.col("min_stock_level"))
    top = j.orderBy(F.col("quantity").asc(), F.col("name").asc(), F.col("id").asc()).limit(limit)
    top = top.join(_category_names(t), top.category_id == F.col("c_id"), "left")
    return top.select("id", "name", "sku", "min_stock_level", "quantity", "category_name",
                      stock_status().alias("stock_status")).orderBy("quantity", "name", "id")


def cashier_performance(t: RetailTables, period: str = "month", as_of=AS_OF) -> DataFrame:
    """Every active admin/cashier with sales count, completed revenue and mean, refunds.

    Sales are aggregated per cashier first (period predicate on the sales side), then
    the small user table is left-joined; users without sales keep zeros.
    """
    s = t.sales.filter(in_period("created_at", period, as_of) & F.col("cashier_id").isNotNull())
    done = F.col("status") == "completed"
    agg = s.groupBy("cashier_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(done, F.col("total_amount")).otherwise(F.lit(0))).alias("rev"),
        F.sum(F.when(done, F.col("total_amount"))).alias("rev_c"), F.count(F.when(done, 1)).alias("n_c"),
        F.sum(F.when(F.col("status") == "refunded", 1).otherwise(0)).cast("bigint").alias("refunded"))
    u = t.users.filter((F.col("is_active") == 1) & F.col("role").isin("admin", "cashier"))
    j = u.join(agg, u.id == agg.cashier_id, "left")
    z = F.lit(0).cast("bigint")
    return j.select("id", full_name("first_name", "last_name").alias("name"), "role",
                    F.coalesce("n", z).alias("total_sales"), F.coalesce(money("rev"), F.lit(0.0)).alias("total_revenue"),
                    mean_of(F.col("rev_c"), F.col("n_c")).alias("average_sale"),
                    F.coalesce("refunded", z).alias("refunded_sales")).orderBy(F.col("total_revenue").desc(), F.col("id").asc())

