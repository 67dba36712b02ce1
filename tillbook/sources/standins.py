"""Request frames for the change jobs, taken from the supplied tables.

These only shape existing rows into the request schemas the jobs expect (no job logic
here): stock adjustment requests are the in/out/adjustment rows of ``stock_ops``; cart
lines are the lines of every sale, replayed in sale-id order; refund requests are the
lines that came back, one request per sale.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.session import checkpoint_dir
from tillbook.sources.views import RetailTables

def adjustment_requests(t: RetailTables) -> DataFrame:
    return t.stock_ops.filter(F.col("op").isin("in", "out", "adjustment"))


def cart_lines(t: RetailTables) -> DataFrame:
    """Every sale's lines as cart lines, with the sale's cashier and time. Carts come in the order of their ids."""
    s = t.sales.select(F.col("id").alias("sale_id"), F.col("cashier_id").alias("created_by"), "created_at")
    j = t.sale_lines.drop("created_at").join(s, "sale_id", "left")
    return j.select(F.col("sale_id").alias("cart_id"), "line_no", "product_id", "variant_id", "quantity", "unit_price",
                    "created_by", "created_at")


def cart_line_reader(t: RetailTables) -> Callable[..., DataFrame]:
    """Reads ``cart_lines`` without cashier and time: all, or those of some carts (cart_id), where only theirs are numbered.

    A sale's lines come as often as the sale is in its table; only where one is there more than once are they joined.
    """
    checkpoint_dir(t.spark)
    often = (t.sales.groupBy(F.col("id").alias("sale_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1 and sale_id is not null")
             .checkpoint(eager=True))
    once = often.isEmpty()

    def read(carts: DataFrame | None = None) -> DataFrame:
        x = t.sale_lines if carts is None else t.sale_lines_of(carts.select(F.col("cart_id").alias("sale_id")))
        if not once:
            x = x.join(often, "sale_id", "left").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.coalesce("_n", F.lit(1)))))
        return x.select(F.col("sale_id").alias("cart_id"), "line_no", "product_id", "variant_id", "quantity", "unit_price")
    return read


def refund_requests(t: RetailTables) -> tuple[DataFrame, DataFrame]:
    """(requests, request_lines): one request per sale with returned lines, listing those lines."""
    r = t.sale_lines.filter(F.col("returned") == 1)
    req = r.groupBy("sale_id").agg(F.max("created_at").alias("created_at")).select(
        F.col("sale_id").alias("request_id"), "sale_id", F.lit("returned items").alias("reason"),
        F.lit(None).cast("bigint").alias("created_by"), "created_at")
    return req, r.select(F.col("sale_id").alias("request_id"), "line_no")


def alert_acks(t: RetailTables, alerts: DataFrame | None = None) -> DataFrame:
    """One acknowledgement per alert, one hour after it was raised, by user product_id % 25."""
    a = t.low_stock_alerts if alerts is None else alerts
    return a.select(F.col("id").alias("alert_id"), (F.col("product_id") % 25).alias("user_id"),
                    (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("ack_at"))


PRODUCT_REQ_COLS = ("sku", "name", "price", "category_id", "brand", "unit_size", "cost", "min_stock_level", "barcode",
                    "description")


def catalog_relist_requests(t: RetailTables) -> DataFrame:
    """Create requests: every inactive product listed again under a fresh id (after the current maximum)."""
    offset = t.products.select(F.max("id") + 1).scalar()  # scalar subquery, evaluated once by Spark
    p = t.products.filter(F.col("is_active") == 0)
    return p.select(F.col("id").alias("req_id"), (F.col("id") + offset).alias("id"), *PRODUCT_REQ_COLS)


def catalog_update_requests(t: RetailTables) -> DataFrame:
    """Full-row update requests: every product re-submitted; some under the SKU or barcode of the product after or before them,
    which may have given it up by then, and some under a new SKU."""
    p = t.products
    after = p.select((F.col("id") - 1).alias("id"), F.col("sku").alias("_sku_after"), F.col("barcode").alias("_barcode_after"))
    before = p.select((F.col("id") + 1).alias("id"), F.col("sku").alias("_sku_before"))
    nth = F.col("id") % 7
    sku = (F.when(nth == 3, F.col("_sku_after")).when(nth == 4, F.concat(F.lit("N-"), "sku")).when(nth == 5, F.col("_sku_before"))
           .otherwise(F.col("sku")))
    barcode = F.when(F.col("id") % 11 == 2, F.col("_barcode_after")).otherwise(F.col("barcode"))
    x = p.join(after, "id", "left").join(before, "id", "left").withColumns({"sku": sku, "barcode": barcode})
    return x.select(F.col("id").alias("req_id"), "id", *PRODUCT_REQ_COLS)


def product_delete_requests(t: RetailTables) -> DataFrame:
    return t.products.select(F.col("id").alias("req_id"), F.col("id").alias("product_id"))


def category_insert_requests(t: RetailTables) -> DataFrame:
    """Every category submitted again as a new one (same name, description and parent)."""
    return t.categories.select(F.col("id").alias("req_id"), "name", "description", "parent_id")


def category_reparent_requests(t: RetailTables) -> DataFrame:
    """Roots asked to move under their lowest child (a cycle); children asked to move to the next root."""
    kids = t.categories.filter(F.col("parent_id").isNotNull()).groupBy(F.col("parent_id").alias("id")).agg(
        F.min(F.col("id")).alias("_lowest_child"))
    c = t.categories.join(kids, "id", "left")
    new_parent = F.when(F.col("parent_id").isNull(), F.col("_lowest_child")).otherwise(F.col("parent_id") % 6 + 1)
    return c.select(F.col("id").alias("req_id"), "id", "name", "description", new_parent.alias("parent_id"))


def category_delete_requests(t: RetailTables) -> DataFrame:
    return t.categories.select(F.col("id").alias("req_id"), "id")


def user_insert_requests(t: RetailTables) -> DataFrame:
    """Every user submitted again (password = username)."""
    return t.users.select(F.col("id").alias("req_id"), "username", "email", F.col("username").alias("password"),
                          "role", "first_name", "last_name")


def user_deactivation_patches(t: RetailTables, actor_id: int = 0) -> DataFrame:
    """Every user deactivated by user ``actor_id`` (only ``is_active`` supplied)."""
    nul = F.lit(None).cast("string")
    return t.users.select(F.col("id").alias("req_id"), "id", F.lit(actor_id).cast("bigint").alias("actor_id"),
                          nul.alias("username"), nul.alias("email"), nul.alias("role"), nul.alias("first_name"),
                          nul.alias("last_name"), F.lit(0).alias("is_active"))


def user_delete_requests(t: RetailTables, actor_id: int = 0) -> DataFrame:
    return t.users.select(F.col("id").alias("req_id"), "id", F.lit(actor_id).cast("bigint").alias("actor_id"))


def cart_headers(t: RetailTables) -> DataFrame:
    """Cart headers for the sale replay: every sale's own header fields."""
    return t.sales.select(F.col("id").alias("cart_id"), "sale_number", "payment_method", "cashier_id", "customer_name",
                          "discount_amount", "tax_amount", "notes", "created_at")


def new_user_requests(t: RetailTables) -> DataFrame:
    """Every user's namesake as a new user, and then another with the same e-mail in capitals."""
    u = t.users

    def each(nth: int, suffix: str, email) -> DataFrame:
        return u.select((F.col("id") * 2 + nth).alias("req_id"), F.concat(F.lit(" "), "username", F.lit(suffix)).alias("username"),
                        email.alias("email"), F.col("username").alias("password"), "role", "first_name", "last_name")
    fresh = F.concat(F.lit("new."), "email")
    return each(0, "_2", fresh).unionByName(each(1, "_3", F.upper(fresh)))


def import_rows(t: RetailTables) -> dict[str, DataFrame]:
    """Rows to import (``inserts.SeedMerge``), ``ord`` from 1,000 on: categories again and below others, products again and under new
    SKUs, some twice, users again and under new names."""
    c, p, u = t.categories, t.products, t.users
    top = c.filter(F.col("parent_id").isNull()).select(F.col("id").alias("_top"), F.col("name").alias("parent_name"))
    own = c.join(top, F.col("parent_id") == F.col("_top"), "left")
    nul = F.lit(None).cast("string")
    at = lambda nth: (F.lit(1000) + F.col("id") * 10 + nth).cast("bigint").alias("ord")
    cats = own.select(at(0), "name", "description", "parent_name").unionByName(
        own.select(at(1), F.concat(F.lit("Import "), "name").alias("name"), nul.alias("description"), nul.alias("parent_name"))).unionByName(
        own.select(at(2), "name", F.lit("imported").alias("description"), F.concat(F.lit("Import "), "parent_name").alias("parent_name")))
    named = p.join(c.select(F.col("id").alias("category_id"), F.col("name").alias("_cat")), "category_id", "left")

    def product(nth: int, sku, quantity) -> DataFrame:
        return named.select(at(nth), sku.alias("sku"), "barcode", "name", F.concat(F.lit("Import "), "_cat").alias("category"), "brand",
                            F.col("price").cast("string").alias("price"), F.col("cost").cast("string").alias("cost"), "min_stock_level",
                            quantity.cast("int").alias("quantity"))
    again = F.concat(F.lit("IMP"), (F.col("id") % 1000 * 2).cast("string"))  # ids a thousand apart share a SKU
    prods = product(0, F.col("sku"), F.lit(1)).unionByName(product(1, again, F.col("id") % 90)).unionByName(product(2, again, F.lit(7)))

    def user(nth: int, name, email) -> DataFrame:
        return u.select(at(nth), name.alias("username"), email.alias("email"), "role", "first_name", "last_name")
    users = user(0, F.col("username"), F.concat(F.lit("x."), "email")).unionByName(
        user(1, F.concat("username", F.lit("_i")), F.concat(F.lit("i."), "email"))).unionByName(
        user(2, F.concat("username", F.lit("_j")), F.concat(F.lit("i."), "email")))
    return {"users": users, "categories": cats, "products": prods}
