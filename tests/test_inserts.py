"""Ids without gaps, and batches merged into the tables, against plain versions."""

from __future__ import annotations

import datetime as dt
import random
from decimal import Decimal

from tillbook.operators.inserts import SeedMerge, combined, seed_frames, users_after_update
from tillbook.plans.ids import allocate_ids
from tillbook.sources.schemas import RETAIL_SCHEMAS
from tillbook.sources.views import RetailTables

T0 = dt.datetime(2024, 1, 1)
NOW = "2024-02-01 00:00:00"


def _tables(spark, **rows):
    made = {n: spark.createDataFrame(rows.get(n, []), RETAIL_SCHEMAS[n]) for n in ("users", "categories", "products", "stock")}
    return RetailTables.from_frames(spark, **made)


def test_ids_are_gapless_and_in_order(spark):
    table = spark.createDataFrame([(41,), (7,)], "id long")
    rows = spark.createDataFrame([(random.Random(i).random(), i) for i in range(5000)], "x double, n int").repartition(13)
    out = allocate_ids(rows, table, "x").orderBy("x").collect()
    assert [r.id for r in out] == list(range(42, 5042))


def test_ids_of_an_empty_table_and_no_rows(spark):
    none = spark.createDataFrame([], "id long")
    rows = spark.createDataFrame([(5, "a"), (3, "b")], "id long, t string")
    assert {(r.t, r.id) for r in allocate_ids(rows, none, "t").collect()} == {("a", 1), ("b", 2)}
    assert allocate_ids(none.selectExpr("id", "id as k"), rows, "k").collect() == []


def test_seed_into_empty_tables_and_again(spark):
    t = _tables(spark)
    first = SeedMerge(t, seed_frames(spark), NOW).tables()
    cats = {r.name: r for r in first["categories"].collect()}
    assert [cats[n].id for n in ("Beverages", "Personal Care", "Bottled Water", "Cookies")] == [1, 5, 6, 9]
    assert cats["Cookies"].parent_id == cats["Snacks"].id
    prods = {r.sku: r for r in first["products"].collect()}
    assert prods["SNK002"].category_id == cats["Cookies"].id and prods["SNK002"].price == Decimal("4.50")
    held = {r.product_id: r.quantity for r in first["stock"].collect()}
    assert held[prods["SNK002"].id] == 8 and len(held) == 5
    again = SeedMerge(RetailTables.from_frames(spark, **first), seed_frames(spark), NOW).tables()
    for name, df in again.items():
        assert sorted(map(str, df.collect())) == sorted(map(str, first[name].collect())), name


def _one_by_one(users, batch):
    users, top = list(users), max((u[0] for u in users), default=0)
    for _ord, name, mail in sorted(batch):
        if name is None or mail is None or any(name == n or mail == m for _, n, m in users):
            continue
        top += 1
        users.append((top, name, mail))
    return users


def test_users_of_a_batch_as_one_by_one(spark):
    for seed in range(2):
        rnd = random.Random(seed)
        pick = lambda p, n: rnd.choice([None, *(f"{p}{i}" for i in range(n))])
        batch = [(i, pick("u", 12), pick("m", 12)) for i in range(40)]
        there = [(3, "u0", "m1"), (9, "u2", "m0")]
        t = _tables(spark, users=[(i, n, m, "admin", "a", "b", 1, T0, T0) for i, n, m in there])
        frames = seed_frames(spark)
        frames["users"] = spark.createDataFrame([(*r, "admin", "a", "b") for r in batch],
                                                "ord long, username string, email string, role string, first_name string, last_name string")
        out = SeedMerge(t, frames, NOW).users().collect()
        assert sorted((r.id, r.username, r.email) for r in out) == _one_by_one(there, batch)


def test_rows_that_cannot_be_placed(spark):
    t = _tables(spark, categories=[(1, "A", None, None, 1, T0, T0), (2, "A", None, 1, 0, T0, T0)],
                products=[(1, "S", None, "x", None, 1, None, "pcs", Decimal(1), None, 0, None, 1, T0, T0)],
                stock=[(10, 2, None, 9, 0, T0, None)])
    frames = seed_frames(spark)
    cats = [(0, "A", None, "A"), (1, "B", "first", "A"), (2, "B", "second", "A"), (3, "C", None, "nowhere"), (4, None, None, None), (5, "D", None, None)]
    prods = [(0, "S", None, "kept", "B"), (1, "T", None, "new", "nowhere"), (2, "T", None, "late", "B"), (3, None, None, "no key", "B")]
    frames["categories"] = spark.createDataFrame(cats, frames["categories"].schema)
    frames["products"] = spark.createDataFrame([(*p, None, "2.00", None, None, None) for p in prods], frames["products"].schema)
    out = SeedMerge(t, frames, NOW).tables()
    new = {(r.id, r.name, r.description, r.parent_id) for r in out["categories"].collect()}
    assert new == {(1, "A", None, None), (2, "A", None, 1), (3, "D", None, None), (4, "B", "first", 1)}
    assert {(r.id, r.sku, r.name, r.category_id) for r in out["products"].collect()} == {(1, "S", "x", 1), (2, "T", "new", None)}
    assert [(r.id, r.product_id, r.quantity) for r in out["stock"].collect()] == [(10, 2, 9)]  # product 2 had one already


def test_seeds_combine(spark):
    both = combined(seed_frames(spark), {n: f.withColumn("ord", f["ord"] + 100) for n, f in seed_frames(spark).items()})
    assert SeedMerge(_tables(spark), both, NOW).tables()["products"].count() == 5


def test_last_accepted_patch_of_each_field(spark):
    t = _tables(spark, users=[(1, "ann", "a@x.y", "admin", "A", "N", 1, T0, T0), (2, "bob", "b@x.y", "cashier", "B", "O", 1, T0, T0)])
    patches = spark.createDataFrame(
        [(1, 1, " eve ", None, None, None, None, None), (2, 1, None, " NEW@X.Y ", None, None, None, None),
         (3, 1, "zoe", None, None, None, None, 0), (4, 2, "max", None, None, None, None, None)],
        "req_id long, id long, username string, email string, role string, first_name string, last_name string, is_active int")
    checked = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 0)], "req_id long, ok int")
    out = {r.id: r for r in users_after_update(t, patches, checked, NOW).collect()}
    assert (out[1].username, out[1].email, out[1].is_active, str(out[1].updated_at)) == ("zoe", "new@x.y", 0, NOW)
    assert (out[2].username, out[2].updated_at) == ("bob", T0)
