"""Spark schemas of the retail tables (the reference's DDL re-typed for Spark).

Keys are LONG, quantities INT, money DECIMAL(12,2), flags INT 0/1, times TIMESTAMP_NTZ.
``password_hash`` is intentionally absent from ``users``.
"""

from __future__ import annotations

from pyspark.sql import types as T

L, I, S, TS = T.LongType(), T.IntegerType(), T.StringType(), T.TimestampNTZType()
MONEY = T.DecimalType(12, 2)
PRICE = T.DecimalType(10, 2)


def _schema(*cols: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t, True) for n, t in cols])


RETAIL_SCHEMAS: dict[str, T.StructType] = {
    "users": _schema(("id", L), ("username", S), ("email", S), ("role", S), ("first_name", S),
                     ("last_name", S), ("is_active", I), ("created_at", TS), ("updated_at", TS)),
    "categories": _schema(("id", L), ("name", S), ("description", S), ("parent_id", L), ("is_active", I),
                          ("created_at", TS), ("updated_at", TS)),
    "products": _schema(("id", L), ("sku", S), ("barcode", S), ("name", S), ("description", S),
                        ("category_id", L), ("brand", S), ("unit_size", S), ("price", PRICE), ("cost", PRICE),
                        ("min_stock_level", I), ("image_url", S), ("is_active", I), ("created_at", TS),
                        ("updated_at", TS)),
    "product_variants": _schema(("id", L), ("product_id", L), ("variant_name", S), ("variant_value", S),
                                ("sku_suffix", S), ("price_adjustment", PRICE), ("is_active", I),
                                ("created_at", TS)),
    "stock": _schema(("id", L), ("product_id", L), ("variant_id", L), ("quantity", I),
                     ("reserved_quantity", I), ("last_updated", TS), ("updated_by", L)),
    "sales": _schema(("id", L), ("sale_number", S), ("total_amount", MONEY), ("tax_amount", MONEY),
                     ("discount_amount", MONEY), ("payment_method", S), ("status", S), ("cashier_id", L),
                     ("customer_name", S), ("notes", S), ("created_at", TS)),
    "sale_items": _schema(("sale_id", L), ("product_id", L), ("variant_id", L), ("quantity", I),
                          ("unit_price", MONEY), ("total_price", MONEY), ("discount_amount", MONEY),
                          ("created_at", TS)),
    # the items of sales with their place in the sale, and whether they came back
    "sale_lines": _schema(("sale_id", L), ("line_no", I), ("product_id", L), ("variant_id", L), ("quantity", I),
                          ("unit_price", MONEY), ("total_price", MONEY), ("returned", I), ("created_at", TS)),
    "stock_ops": _schema(("seq", L), ("product_id", L), ("variant_id", L), ("op", S), ("n", I),
                         ("created_by", L), ("created_at", TS)),
    "stock_movements": _schema(("id", L), ("product_id", L), ("variant_id", L), ("movement_type", S),
                               ("quantity_change", I), ("quantity_before", I), ("quantity_after", I),
                               ("reference_id", L), ("reference_type", S), ("notes", S), ("created_by", L),
                               ("created_at", TS)),
    "low_stock_alerts": _schema(("id", L), ("product_id", L), ("variant_id", L), ("current_stock", I),
                                ("min_stock_level", I), ("alert_status", S), ("acknowledged_by", L),
                                ("acknowledged_at", TS), ("created_at", TS)),
}

# Fixed values from the reference's CHECK constraints.
ROLES = ("admin", "cashier")
MOVEMENT_TYPES = ("in", "out", "adjustment", "sale", "return", "damaged")
SALE_STATUSES = ("pending", "completed", "cancelled", "refunded")
ALERT_STATUSES = ("active", "acknowledged", "resolved")
