"""Registered searches and deep pages through stored indexes; their SQL is that of the plain lists."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tillbook.operators import catalog as P
from tillbook.operators import sales as S
from tillbook.operators import stock as K
from tillbook.plans import q_catalog, q_sales, q_stock
from tillbook.plans.registry import QUERIES, register
from tillbook.session import checkpoint_dir
from tillbook.sources.indexes import GramIndex, PageIndex

PRODUCT_TEXTS = ("name", "sku", "barcode", "brand")
SALE_TEXTS = ("sale_number", "customer_name")
BLOCK_ROWS = 4096


def _root(t) -> str:
    return f"{checkpoint_dir(t.spark).rstrip('/')}/indexes/{uuid.uuid4().hex[:12]}"


def _found(t, table: str, texts: tuple[str, ...], term: str):
    rows = getattr(t, table)
    index = GramIndex.build(rows, _root(t), texts)
    return t.replaced(**{table: index.candidates(rows, term)})


register("product_search_indexed", lambda t: P.product_search(_found(t, "products", PRODUCT_TEXTS, "gear"), "gear"),
         QUERIES["product_search"].sql, "P6 through the 3-gram index")
register("products_list_indexed", lambda t: P.products_list(_found(t, "products", PRODUCT_TEXTS, "Brand#1"), search="Brand#1", sort_by="price",
                                                            sort_order="desc", page=2, limit=10),
         QUERIES["products_list_sorted"].sql, "P1 brand search through the 3-gram index")
register("stock_levels_indexed", lambda t: K.stock_levels(_found(t, "products", PRODUCT_TEXTS, "RING"), low_stock_only=True, search="RING",
                                                          page=2, limit=10),
         QUERIES["stock_levels_filtered"].sql, "K1 search through the 3-gram index")
register("sales_list_indexed", lambda t: S.sales_list(_found(t, "sales", SALE_TEXTS, q_sales.LIST_FILTER["search"]), page=2, limit=5,
                                                      **q_sales.LIST_FILTER),
         QUERIES["sales_list_filtered"].sql, "S1 search through the 3-gram index")

NEWEST = (("created_at", True), ("id", True))


def _paged(t, table: str, rows, order, page: int, limit: int):
    index = PageIndex.build(rows, _root(t), order, BLOCK_ROWS)
    return t.replaced(**{table: index.page(rows, page, limit)})


register("sales_list_page", lambda t: S.sales_list(_paged(t, "sales", t.sales, NEWEST, 40, 25), limit=25),
         q_sales._list_sql("TRUE", 25, 975), "S1: a deep page through the page index")
register("movement_history_page", lambda t: K.movement_history(_paged(t, "stock_movements", t.stock_movements, NEWEST, 12, 50), limit=50),
         q_stock._movements_sql("TRUE", 50, 550), "K4: a deep page through the page index")
register("products_list_page", lambda t: P.products_list(_paged(
    t, "products", t.products.filter(F.col("is_active") == 1), (("name", False), ("id", False)), 6, 20), limit=20),
    q_catalog._list_sql("TRUE", "p.name ASC NULLS FIRST, p.id ASC", 20, 100), "P1: a deep page through the page index")
