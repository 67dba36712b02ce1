"""The materialized table layout (what bench.py measures) gives the same results as the
views derived on the fly (what the oracle checks)."""

from __future__ import annotations

import pytest

from oracle_harness import rows_of
from tillbook.plans.registry import load_all
from tillbook.sources.views import RetailTables

SF = "/root/testdata/sf0.001"
SPECS = load_all()


@pytest.fixture(scope="module")
def bundles(spark, tmp_path_factory):
    base = RetailTables.from_testdata(spark, SF)
    root = str(tmp_path_factory.mktemp("retail"))
    mat = base.materialize(root)
    return base, mat


@pytest.mark.parametrize("name", sorted(SPECS))
def test_materialized_equals_base(spark, bundles, name):
    base, mat = bundles
    a = SPECS[name].build(base).toPandas()
    b = SPECS[name].build(mat).toPandas()
    assert sorted(a.columns) == sorted(b.columns)
    assert rows_of(a) == rows_of(b)
