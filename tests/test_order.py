"""Results that the reference orders stay in order when the joins after the sort are shuffled joins."""

from __future__ import annotations

import pytest

from tillbook.plans.registry import load_all
from tillbook.sources.views import RetailTables

SF = "/root/testdata/sf0.01"
NEWEST = [("created_at", True), ("id", True)]
ORDERS = {
    "sales_list": NEWEST, "sales_list_filtered": NEWEST, "sales_list_keyset": NEWEST, "recent_sales": NEWEST,
    "activity_sales": NEWEST, "activity_movements": NEWEST, "movement_history": NEWEST, "alerts_by_status": NEWEST,
    "top_products_by_qty": [("total_sold", True), ("id", False)], "top_products": [("total_sold", True), ("id", False)],
    "payment_method_breakdown": [("total_amount", True)], "hourly_sales": [("hour", False)], "sales_chart": [("label", False)],
    "inventory_by_category": [("category_name", False)], "low_stock_products": [("quantity", False), ("name", False), ("id", False)],
    "cashier_performance": [("total_revenue", True), ("id", False)], "products_list": [("name", False), ("id", False)],
    "products_list_sorted": [("price", True), ("id", True)], "product_search": [("name", False), ("id", False)],
    "product_variants_stock": [("product_id", False), ("variant_name", False), ("variant_value", False)],
    "categories_flat": [("display_name", False), ("id", False)], "subcategories": [("parent_id", False), ("name", False)],
    "stock_levels": [("is_low_stock", True), ("quantity", False), ("name", False), ("id", False)],
}


@pytest.fixture
def shuffled(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    for k, v in zip(old, ("-1", "false"), strict=True):
        spark.conf.set(k, v)
    yield RetailTables.from_testdata(spark, SF)
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_order(shuffled, name):
    rows = load_all()[name].build(shuffled).select(*[c for c, _ in ORDERS[name]]).toPandas()
    assert len(rows) > 1
    for c in rows.columns:  # NULLs first ascending, last descending
        rows[c] = rows[c].astype(object).where(rows[c].notna(), None)
    got = [tuple(r) for r in rows.itertuples(index=False)]
    want = got
    for i in range(len(ORDERS[name]) - 1, -1, -1):
        want = sorted(want, key=lambda r: (r[i] is not None, r[i] if r[i] is not None else 0), reverse=ORDERS[name][i][1])
    assert got == want
