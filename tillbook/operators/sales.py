"""Sales operators (list, summaries, analytics, carts).

Every operator is ``f(t: RetailTables, **params) -> DataFrame`` and lazy. Money stays
DECIMAL through the sums and is cast to DOUBLE in the final projection; means are
``double(sum) / count``.

Scale notes: per-sale item counts are computed only for the rows a page returns (limit
before join); fact-table predicates are timestamp ranges that reach the parquet scan;
summaries are single-pass conditional aggregates (partial aggregation map-side, one
tiny shuffle).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.functions.exprs import all_of, contains_any, currency_text, date_text, full_name, mean_of, money
from tillbook.functions.periods import AS_OF, day_range, in_period
from tillbook.plans.scans import keyed_scan
from tillbook.sources.views import RetailTables

SALE_COLS = ("id", "sale_number", "total_amount", "tax_amount", "discount_amount", "payment_method", "status",
             "cashier_id", "customer_name", "notes", "created_at")
MONEY_COLS = ("total_amount", "tax_amount", "discount_amount")


def _sale_out(df: DataFrame, *extra: str) -> DataFrame:
    cols = [money(c).alias(c) if c in MONEY_COLS else F.col(c) for c in SALE_COLS]
    return df.select(*cols, *extra)


def sales_filter(date_from=None, date_to=None, cashier_id=None, status=None, search=None):
    """The optional conjunction of the sales list (S1/S2/S3 share it)."""
    preds = [day_range("created_at", date_from, date_to)]
    if cashier_id is not None and cashier_id != "":
        preds.append(F.col("cashier_id") == F.lit(int(cashier_id)))
    if status:
        preds.append(F.col("status") == F.lit(status))
    if search:
        preds.append(contains_any(search, "sale_number", "customer_name"))
    return all_of(*preds)


def _cashier_names(t: RetailTables) -> DataFrame:
    return t.users.select(F.col("id").alias("cashier_id"), full_name("first_name", "last_name").alias("cashier_name"))


def _item_counts_for(t: RetailTables, sale_ids: DataFrame) -> DataFrame:
    """COUNT(items) for the given sales only (semi join keeps the scan's output small)."""
    items = t.sale_items.select("sale_id").join(sale_ids.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")
    return items.groupBy("sale_id").agg(F.count(F.lit(1)).alias("item_count"))


def _with_cashier_and_items(t: RetailTables, page: DataFrame) -> DataFrame:
    j = page.join(_cashier_names(t), "cashier_id", "left")
    j = j.join(_item_counts_for(t, page).withColumnRenamed("sale_id", "id"), "id", "left")
    return j.withColumn("item_count", F.coalesce(F.col("item_count"), F.lit(0).cast("bigint")))


def sales_list(t: RetailTables, date_from=None, date_to=None, cashier_id=None, status=None, search=None,
               page: int = 1, limit: int = 20, after: tuple | None = None) -> DataFrame:
    """One page of filtered sales, newest first, with cashier name and item count.

    ``after=(created_at, id)`` of the previous page's last row selects the next page by
    keyset (a pushed-down range predicate) instead of OFFSET, so deep pages cost the
    same as the first one.
    """
    s = t.sales.filter(sales_filter(date_from, date_to, cashier_id, status, search))
    if after is not None:
        ts, last_id = after
        at = F.lit(str(ts)).cast("timestamp_ntz")
        s = s.filter((F.col("created_at") < at) | ((F.col("created_at") == at) & (F.col("id") < F.lit(int(last_id)))))
        page = 1
    top = s.orderBy(F.col("created_at").desc(), F.col("id").desc()).offset((page - 1) * limit).limit(limit)
    page = _sale_out(_with_cashier_and_items(t, top), "cashier_name", "item_count")
    return page.orderBy(F.col("created_at").desc(), F.col("id").desc())  # the joins keep no order


def sales_count(t: RetailTables, date_from=None, date_to=None, cashier_id=None, status=None, search=None,
                limit: int = 20) -> DataFrame:
    """Total rows and pages under the list filters (no joins)."""
    s = t.sales.filter(sales_filter(date_from, date_to, cashier_id, status, search))
    return s.agg(F.count(F.lit(1)).alias("total")).select(
        "total", F.lit(limit).alias("per_page"), F.ceil(F.col("total") / F.lit(limit)).cast("bigint").alias("total_pages"))


def sales_filtered_summary(t: RetailTables, date_from=None, date_to=None, cashier_id=None, status=None,
                           search=None) -> DataFrame:
    """S3: count, sum and mean over all statuses, completed and refunded counts."""
    s = t.sales.filter(sales_filter(date_from, date_to, cashier_id, status, search))
    a = s.agg(F.count(F.lit(1)).alias("total_sales"), F.sum("total_amount").alias("rev"),
              F.count("total_amount").alias("n_amt"),
              F.sum(F.when(F.col("status") == "completed", 1).otherwise(0)).cast("bigint").alias("completed_sales"),
              F.sum(F.when(F.col("status") == "refunded", 1).otherwise(0)).cast("bigint").alias("refunded_sales"))
    return a.select("total_sales", money("rev").alias("total_revenue"),
                    mean_of(F.col("rev"), F.col("n_amt")).alias("average_sale"), "completed_sales", "refunded_sales")


def sale_header(t: RetailTables, ids: DataFrame | None = None) -> DataFrame:
    """Sales (all, or those whose ``id`` is in ``ids``) with the cashier name."""
    s = t.sales if ids is None else t.sales.join(ids.select("id"), "id", "left_semi")
    return _sale_out(s.join(_cashier_names(t), "cashier_id", "left"), "cashier_name")


def sale_items_detail(t: RetailTables, ids: DataFrame | None = None) -> DataFrame:
    """Items of sales with product, category and variant (one row per item, keyed by sale_id).

    The reference nests items under the sale document; here the rows stay flat and keyed,
    so no single sale's items are ever gathered into one row or one task.
    """
    si = t.sale_items if ids is None else t.sale_items.join(
        ids.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")
    p = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "sku",
                          "unit_size", "category_id")
    c = t.categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"))
    v = t.product_variants.select(F.col("id").alias("variant_id"), "variant_name", "variant_value", F.lit(0).alias("_salt"))
    # items without a variant match none; salted, they don't meet in one task when the join is shuffled
    salt = F.when(F.col("variant_id").isNull(), F.pmod(F.xxhash64("sale_id", "product_id"), F.lit(4096)) + 1).otherwise(0)
    j = (si.withColumn("_salt", salt.cast("int")).join(p, "product_id", "inner").join(c, "category_id", "left")
         .join(v, ["variant_id", "_salt"], "left"))
    return j.select("sale_id", "product_id", "variant_id", "quantity", money("unit_price").alias("unit_price"),
                    money("total_price").alias("total_price"), money("discount_amount").alias("discount_amount"),
                    "product_name", "sku", "unit_size", "category_name", "variant_name", "variant_value")


#: Items in one part of a sale's document.
PART_ITEMS = 1000


def sale_documents(t: RetailTables, ids: DataFrame | None = None, part_items: int = PART_ITEMS) -> DataFrame:
    """S5 as JSON: (sale_id, part, document), the sale with its ``items[]`` in their order.

    A sale of more than ``part_items`` lines comes in parts, each with the sale's header, so no row and no task holds an unbounded
    sale. Money is text with two decimals; NULLs are told. Lines whose product is missing are left out, as in
    ``sale_items_detail``; a sale without lines has one part with no items.
    """
    s, lines = t.sales, t.sale_lines
    if ids is not None:
        s = s.join(ids.select("id"), "id", "left_semi")
        lines = lines.join(ids.select(F.col("id").alias("sale_id")), "sale_id", "left_semi")
    p = t.products.select(F.col("id").alias("product_id"), F.col("name").alias("product_name"), "sku")
    item = F.struct("line_no", "product_id", "product_name", "sku", "variant_id", "quantity",
                    F.col("unit_price").cast("string").alias("unit_price"), F.col("total_price").cast("string").alias("total_price"))
    part = F.floor((F.col("line_no") - 1) / F.lit(part_items)).cast("int")
    parts = lines.join(p, "product_id").groupBy("sale_id", part.alias("part")).agg(F.array_sort(F.collect_list(item)).alias("items"))
    x = s.join(_cashier_names(t), "cashier_id", "left").join(parts, F.col("id") == F.col("sale_id"), "left")
    none = F.array().cast(parts.schema["items"].dataType)
    document = F.to_json(F.struct("id", "sale_number", "status", "payment_method", F.col("total_amount").cast("string").alias("total_amount"),
                                  "cashier_name", F.coalesce("items", none).alias("items")), {"ignoreNullFields": "false"})
    return x.select(F.col("id").alias("sale_id"), F.coalesce("part", F.lit(0)).alias("part"), document.alias("document"))


def _period_sales(t: RetailTables, period: str, as_of, date_from=None, date_to=None) -> DataFrame:
    return t.sales.filter(in_period("created_at", period, as_of, date_from, date_to))


def sales_period_summary(t: RetailTables, period: str = "today", as_of=AS_OF, date_from=None,
                         date_to=None) -> DataFrame:
    """Period analytics summary; net = completed revenue − refunded amount (kept as in the reference)."""
    s = _period_sales(t, period, as_of, date_from, date_to)
    done = F.col("status") == "completed"
    refd = F.col("status") == "refunded"
    a = s.agg(
        F.count(F.lit(1)).alias("total_sales"),
        F.sum(F.when(done, F.col("total_amount")).otherwise(F.lit(0))).alias("rev"),
        F.sum(F.when(done, F.col("total_amount"))).alias("rev_c"),
        F.count(F.when(done, F.col("total_amount"))).alias("n_c"),
        F.sum(F.when(done, 1).otherwise(0)).cast("bigint").alias("completed_sales"),
        F.sum(F.when(refd, 1).otherwise(0)).cast("bigint").alias("refunded_sales"),
        F.sum(F.when(refd, F.col("total_amount")).otherwise(F.lit(0))).alias("ref_amt"),
    )
    return a.select(
        "total_sales", money("rev").alias("total_revenue"), mean_of(F.col("rev_c"), F.col("n_c")).alias("average_sale"),
        "completed_sales", "refunded_sales", money("ref_amt").alias("refunded_amount"),
        money(F.coalesce(F.col("rev"), F.lit(0)) - F.coalesce(F.col("ref_amt"), F.lit(0))).alias("net_revenue"))


#: Lines that one task groups by sale and product.
TASK_ROWS = 1 << 20


def _completed_item_agg(t: RetailTables, period: str, as_of, date_from=None, date_to=None,
                        with_sale_count: bool = False) -> DataFrame:
    """Σ quantity, Σ revenue (and distinct sale count) per product over completed sales.

    Aggregates per (sale, product) first — right after the sale_id join, whose
    partitioning it reuses — then per product; so COUNT(DISTINCT sale) needs no extra
    distinct pass, and a hot product is pre-aggregated map-side before its shuffle.
    Large tables go in partitions of some ``TASK_ROWS`` lines, so a task's groups do not grow with the table.
    """
    s = _period_sales(t, period, as_of, date_from, date_to).filter(F.col("status") == "completed")
    items = t.sale_items.select("sale_id", "product_id", "quantity", "total_price")
    tasks = -(-items.count() // TASK_ROWS)  # of a stored table: from the files' footers
    if tasks > t.spark.sparkContext.defaultParallelism:
        items = items.repartition(tasks, "sale_id")
    j = items.join(s.select(F.col("id").alias("sale_id")), "sale_id", "inner")
    per_sale = j.groupBy("sale_id", "product_id").agg(F.sum("quantity").alias("q"), F.sum("total_price").alias("r"))
    aggs = [F.sum("q").alias("total_sold"), F.sum("r").alias("rev")]
    if with_sale_count:
        aggs.append(F.count(F.lit(1)).alias("sale_count"))
    return per_sale.groupBy("product_id").agg(*aggs)


def top_products_by_qty(t: RetailTables, period: str = "today", as_of=AS_OF, date_from=None, date_to=None,
                        limit: int = 10) -> DataFrame:
    """Top products by quantity in completed sales of the period (ties by id)."""
    a = _completed_item_agg(t, period, as_of, date_from, date_to)
    p = t.products.select("id", "name", "sku")
    j = a.join(p, a.product_id == p.id, "inner").select("id", "name", "sku", "total_sold", money("rev").alias("total_revenue"))
    return j.orderBy(F.col("total_sold").desc(), F.col("id").asc()).limit(limit)


def payment_method_breakdown(t: RetailTables, period: str = "today", as_of=AS_OF, date_from=None,
                             date_to=None) -> DataFrame:
    """Count and amount per payment method, completed sales only."""
    s = _period_sales(t, period, as_of, date_from, date_to).filter(F.col("status") == "completed")
    return (s.groupBy("payment_method").agg(F.count(F.lit(1)).alias("count"), F.sum("total_amount").alias("amt"))
            .select("payment_method", "count", money("amt").alias("total_amount"))
            .orderBy(F.col("total_amount").desc(), F.col("payment_method").asc()))


def hourly_sales(t: RetailTables, as_of=AS_OF) -> DataFrame:
    """Completed sales of the day ``as_of`` by hour label ``HH``."""
    s = _period_sales(t, "today", as_of).filter(F.col("status") == "completed")
    return (s.groupBy(F.date_format("created_at", "HH").alias("hour"))
            .agg(F.count(F.lit(1)).alias("sales_count"), F.sum("total_amount").alias("amt"))
            .select("hour", "sales_count", money("amt").alias("total_amount")).orderBy("hour"))


def recent_sales(t: RetailTables, limit: int = 10) -> DataFrame:
    """Latest sales with cashier and item count — top-N first, then the joins."""
    top = t.sales.orderBy(F.col("created_at").desc(), F.col("id").desc()).limit(limit)
    j = _with_cashier_and_items(t, top)
    return j.select("id", "sale_number", money("total_amount").alias("total_amount"), "payment_method", "status",
                    "created_at", "cashier_name", "item_count").orderBy(F.col("created_at").desc(), F.col("id").desc())


def cart_totals(lines: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """Line total = quantity × unit price; subtotal; total = subtotal − discount + tax.

    ``lines``: cart_id, quantity, unit_price. ``headers`` (optional): cart_id,
    discount_amount, tax_amount (missing → 0).
    """
    per = lines.groupBy("cart_id").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("subtotal"),
                                       F.count(F.lit(1)).alias("line_count"))
    if headers is not None:
        per = per.join(headers.select("cart_id", "discount_amount", "tax_amount"), "cart_id", "left")
    else:
        per = per.withColumn("discount_amount", F.lit(None).cast("decimal(12,2)")).withColumn(
            "tax_amount", F.lit(None).cast("decimal(12,2)"))
    disc = F.coalesce(F.col("discount_amount"), F.lit(0))
    tax = F.coalesce(F.col("tax_amount"), F.lit(0))
    return per.select("cart_id", "line_count", money("subtotal").alias("subtotal"), money(disc).alias("discount_amount"),
                      money(tax).alias("tax_amount"), money(F.col("subtotal") - disc + tax).alias("total_amount"))


def _judged_lines(t: RetailTables, lines: DataFrame) -> DataFrame:
    """S12 line by line: ``lines`` with the stock, the running quantity, ``reason`` and ``line_ok``.

    ``lines``: cart_id, line_no (unique in the cart), product_id, variant_id, quantity. A line is bad when
    its product is missing or inactive, when no stock row matches (variant compared
    null-safely), or when the running quantity of the same (product, variant) in the
    cart up to this line exceeds the stock (the reference checked each line against
    the pre-sale quantity; the running sum is the sequential truth).
    """
    p = t.products.filter(F.col("is_active") == 1).select(F.col("id").alias("product_id"), F.lit(1).alias("_p"))
    st = t.stock.select(F.col("product_id").alias("s_pid"), F.col("variant_id").alias("s_vid"),
                        F.col("quantity").alias("stock_quantity"))
    j = lines.join(p, "product_id", "left")
    j = j.join(st, (j.product_id == st.s_pid) & j.variant_id.eqNullSafe(st.s_vid), "left").drop("s_pid", "s_vid")
    # running quantity per (cart, product, variant) in line order: a two-level scan, so one
    # huge cart of one product is not a single window partition
    j = j.withColumn("_vk", F.coalesce(F.col("variant_id"), F.lit(-1).cast("bigint")))
    j = keyed_scan(j, ["cart_id", "product_id", "_vk"], "line_no", F.col("quantity").cast("bigint"), "sum",
                   "requested_so_far").drop("_vk")
    reason = (F.when(F.col("_p").isNull(), F.lit("product_not_found"))
              .when(F.col("stock_quantity").isNull(), F.lit("stock_record_not_found"))
              .when(F.col("requested_so_far") > F.col("stock_quantity"), F.lit("insufficient_stock")))
    return j.withColumn("reason", reason).withColumn("line_ok", F.col("reason").isNull().cast("int"))


def cart_validation(t: RetailTables, lines: DataFrame) -> DataFrame:
    """Every cart line judged (see ``_judged_lines``); a cart is accepted only if all its lines are."""
    j = _judged_lines(t, lines)
    first_bad = (j.filter(F.col("line_ok") == 0).groupBy("cart_id")
                 .agg(F.min(F.struct("line_no", "reason")).alias("fb"), F.count(F.lit(1)).alias("bad_lines")))
    out = j.join(first_bad, "cart_id", "left")
    return out.select("cart_id", "line_no", "product_id", "variant_id", "quantity", "stock_quantity",
                      "requested_so_far", "reason", "line_ok",
                      F.when(F.col("fb").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("cart_ok"),
                      F.col("fb.line_no").alias("first_bad_line"), F.col("fb.reason").alias("cart_reason"))


def cart_validation_summary(t: RetailTables, lines: DataFrame) -> DataFrame:
    """Per cart: line count, bad lines by reason, accepted flag (order-independent view of S12)."""
    return _judged_lines(t, lines).groupBy("cart_id").agg(
        F.count(F.lit(1)).alias("line_count"),
        F.sum(1 - F.col("line_ok")).cast("bigint").alias("bad_lines"),
        F.sum(F.when(F.col("reason") == "product_not_found", 1).otherwise(0)).cast("bigint").alias("missing_product"),
        F.sum(F.when(F.col("reason") == "stock_record_not_found", 1).otherwise(0)).cast("bigint").alias("missing_stock"),
        F.sum(F.when(F.col("reason") == "insufficient_stock", 1).otherwise(0)).cast("bigint").alias("short_stock"),
        F.min("line_ok").alias("accepted"))


def sale_lines_as_carts(t: RetailTables) -> DataFrame:
    """Stand-in cart lines: one cart per sale."""
    return t.sale_lines.select(F.col("sale_id").alias("cart_id"), "line_no", "product_id", "variant_id", "quantity",
                               "unit_price", "total_price")


def sales_display(t: RetailTables) -> DataFrame:
    """Sales with the client's display texts: en-US currency and date/time (client formatters)."""
    return t.sales.select("id", "sale_number", currency_text("total_amount").alias("total_text"),
                          date_text("created_at").alias("date_text"),
                          date_text("created_at", with_time=True).alias("datetime_text"))
