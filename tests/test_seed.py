"""The reference's seed (5 products, 9 categories, 2 users) with hand-computed results."""

from __future__ import annotations

import datetime as dt
from decimal import Decimal

import pytest

from tillbook.operators import dashboard as D
from tillbook.operators import stock as K
from tillbook.operators.quality import SEED_CATEGORIES, SEED_PRODUCTS, seed_plan
from tillbook.sources.schemas import RETAIL_SCHEMAS
from tillbook.sources.views import RetailTables

T0 = dt.datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def seed(spark):
    cats = []
    for i, (name, desc, parent) in enumerate(SEED_CATEGORIES, start=1):
        pid = None if parent is None else 1 + [c[0] for c in SEED_CATEGORIES].index(parent)
        cats.append((i, name, desc, pid, 1, T0, T0))
    cat_id = {c[1]: c[0] for c in cats}
    prods, stock = [], []
    for i, (sku, bar, name, cat, brand, price, cost, mn, qty) in enumerate(SEED_PRODUCTS, start=1):
        prods.append((i, sku, bar, name, None, cat_id[cat], brand, "pcs", Decimal(price), Decimal(cost), mn, None, 1,
                      T0, T0))
        stock.append((i, i, None, qty, 0, T0, None))
    users = [(1, "admin", "admin@retailstore.com", "admin", "System", "Administrator", 1, T0, T0),
             (2, "cashier", "cashier@retailstore.com", "cashier", "John", "Cashier", 1, T0, T0)]
    mk = lambda n, rows: spark.createDataFrame(rows, RETAIL_SCHEMAS[n])
    return RetailTables.from_frames(spark, categories=mk("categories", cats), products=mk("products", prods),
                                    stock=mk("stock", stock), users=mk("users", users))


def test_inventory_value(seed):
    r = D.inventory_value(seed).collect()[0]
    assert r.total_retail_value == pytest.approx(648.05)
    assert r.total_cost_value == pytest.approx(340.50)
    assert r.total_products == 5


def test_stock_distribution(seed):
    r = D.stock_distribution(seed).collect()[0]
    assert (r.out_of_stock, r.low_stock, r.in_stock) == (0, 1, 4)
    assert D.low_stock_count(seed).collect()[0]["count"] == 1


def test_inventory_by_category_roots_only(seed):
    rows = {r.category_name: r for r in D.inventory_by_category(seed).collect()}
    assert set(rows) == {"Beverages", "Snacks", "Dairy", "Household", "Personal Care"}
    assert rows["Dairy"].total_products == 1 and rows["Dairy"].total_quantity == 35
    for n in ("Beverages", "Snacks", "Household", "Personal Care"):
        assert rows[n].total_products == 0 and rows[n].total_quantity is None


def test_low_stock_products(seed):
    rows = D.low_stock_products(seed).collect()
    assert [(r.sku, r.stock_status, r.category_name) for r in rows] == [("SNK002", "low_stock", "Cookies")]


def test_stock_levels_order(seed):
    rows = K.stock_levels(seed).collect()
    assert rows[0].sku == "SNK002" and rows[0].is_low_stock == 1
    assert [r.quantity for r in rows[1:]] == sorted(r.quantity for r in rows[1:])


def test_seed_merge_is_idempotent(seed):
    plan = seed_plan(seed).collect()
    assert {r.action for r in plan} == {"exists"}
    assert len(plan) == 16
