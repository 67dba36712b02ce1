"""Every registered query against its DuckDB oracle on the smallest supplied tables."""

from __future__ import annotations

import pytest

from oracle_harness import compare, duck
from tillbook.plans.registry import load_all
from tillbook.sources.views import RetailTables

SF = "/root/testdata/sf0.001"
SPECS = load_all()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(n for n, s in SPECS.items() if s.sql is not None))
def test_query_matches_oracle(spark, con, name):
    spec = SPECS[name]
    df = spec.build(RetailTables.from_testdata(spark, SF))
    ok, msg = compare(df, con, spec.sql)
    assert ok, msg


def test_entry_contract(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.count() > 0
    q, sql = E.queries(), E.oracle_sql()
    assert set(sql) <= set(q)
    assert set(SPECS) <= set(q)


SPARK_TO_DUCK = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE",
                 "timestamp_ntz": "TIMESTAMP", "boolean": "BOOLEAN", "date": "DATE"}


@pytest.mark.parametrize("name", sorted(n for n, s in SPECS.items() if s.sql is not None))
def test_column_types_match_oracle(spark, con, name):
    spec = SPECS[name]
    df = spec.build(RetailTables.from_testdata(spark, SF))
    rel = con.sql(spec.sql)
    duck_types = dict(zip(rel.columns, [str(t) for t in rel.types]))
    for f in df.schema.fields:
        s = f.dataType.simpleString()
        assert SPARK_TO_DUCK.get(s, s.upper()) == duck_types.get(f.name), (name, f.name, s, duck_types.get(f.name))
