"""Cross-operator properties on the supplied tables."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillbook.operators import dashboard as D
from tillbook.operators import sales as S
from tillbook.sources.views import RetailTables

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def t(spark):
    return RetailTables.from_testdata(spark, SF)


@pytest.mark.parametrize("day", ["1996-03-04", "1999-12-31", "2001-08-01"])
def test_hourly_sums_to_the_day(t, day):
    as_of = dt.date.fromisoformat(day)
    hourly = S.hourly_sales(t, as_of).agg(F.coalesce(F.sum("sales_count"), F.lit(0)).alias("n"),
                                          F.sum("total_amount").alias("amt")).collect()[0]
    daily = S.sales_period_summary(t, "today", as_of).collect()[0]
    assert hourly.n == daily.completed_sales
    assert (hourly.amt or 0.0) == pytest.approx(daily.total_revenue or 0.0)


def test_distribution_buckets_plus_missing_stock_is_the_product_count(t):
    d = D.stock_distribution(t).collect()[0]
    v = D.inventory_value(t).collect()[0]
    missing = D.products_with_stock(t).filter(F.col("quantity").isNull()).count()
    assert d.out_of_stock + d.low_stock + d.in_stock + missing == v.total_products


def test_chart_month_matches_period_counts(t):
    as_of = dt.date(2001, 8, 1)
    chart = D.sales_chart(t, "month", as_of).agg(F.sum("sales")).collect()[0][0]
    # the month read starts at as_of - 30 (31 dates) but the chart has 30 slots: the oldest date drops out
    read = S.sales_period_summary(t, "month", as_of).collect()[0].total_sales
    first_day = S.sales_period_summary(t, "custom", as_of, "2001-07-02", "2001-07-02").collect()[0].total_sales
    assert chart == read - first_day


def test_overview_agrees_with_period_summaries(t):
    as_of = dt.date(2001, 8, 1)
    ov = D.sales_overview(t, as_of).collect()[0]
    for period, n, rev in (("week", ov.week_count, ov.week_revenue), ("month", ov.month_count, ov.month_revenue)):
        s = S.sales_period_summary(t, period, as_of).collect()[0]
        assert n == s.total_sales and rev == pytest.approx(s.total_revenue or 0.0)
