"""Physical-plan properties of the read queries (what `.explain()` shows)."""

from __future__ import annotations

import contextlib
import io
import re

import pytest

from tillbook.plans.registry import load_all
from tillbook.sources.views import RetailTables

SF = "/root/testdata/sf0.001"
SPECS = load_all()
# Jobs whose sequential fold or stream is Python by design (mapInPandas / applyInPandasWithState).
PYTHON_BY_DESIGN = {"stock_ledger", "stream_stock_ledger", "stream_low_stock_alerts", "apply_sales",
                    "apply_sales_movements"}


def _plan(spark, name: str) -> str:
    df = SPECS[name].build(RetailTables.from_testdata(spark, SF))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("name", sorted(set(SPECS) - PYTHON_BY_DESIGN))
def test_read_plans_stay_in_the_jvm(spark, name):
    plan = _plan(spark, name)
    assert "PythonUDF" not in plan and "EvalPython" not in plan and "MapInPandas" not in plan, name


def test_flagship_pushes_filters_and_prunes_columns(spark):
    plan = _plan(spark, "top_products_year")
    assert re.search(r"PushedFilters: \[.*GreaterThanOrEqual\(o_orderdate", plan) is None  # derived column: not pushable
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_quantity:double,l_extendedprice:double>" in plan


def test_period_filter_reaches_the_scan_on_materialized_sales(spark, tmp_path):
    from tillbook.operators.sales import sales_period_summary
    t = RetailTables.from_testdata(spark, SF).materialize(str(tmp_path / "retail"), names=("sales",))
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        sales_period_summary(t, period="year").explain(mode="formatted")
    plan = buf.getvalue()
    assert "PushedFilters: [IsNotNull(created_at), GreaterThanOrEqual(created_at,2000-08-01T00:00)]" in plan
    assert "ReadSchema: struct<total_amount:decimal(12,2),status:string,created_at:timestamp_ntz>" in plan


@pytest.mark.parametrize("name", ["user_recent_sales", "recent_movements_per_product"])
def test_per_key_top_n_limits_before_the_shuffle(spark, name):
    plan = _plan(spark, name)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_sequential_fold_is_the_only_python(spark):
    plan = _plan(spark, "stock_ledger")
    assert len(set(re.findall(r"\((\d+)\) MapInPandas", plan))) == 1
    assert "FlatMapGroupsInPandas" not in plan
    assert "BatchEvalPython" not in plan
