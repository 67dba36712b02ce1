"""Edge frames for the semantics hazards."""

from __future__ import annotations

import datetime as dt
import json
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tillbook.functions.exprs import contains_any, full_name
from tillbook.operators import catalog as P
from tillbook.operators import changes as X
from tillbook.operators import checks as C
from tillbook.operators import dashboard as D
from tillbook.operators import sales as S
from tillbook.sources.schemas import RETAIL_SCHEMAS
from tillbook.sources.views import RetailTables

T0 = dt.datetime(2001, 7, 1)


def _mk(spark, name, rows):
    return spark.createDataFrame(rows, RETAIL_SCHEMAS[name])


def _prod(i, sku, cost="1.00", active=1, cat=None, mn=5):
    return (i, sku, None, f"item {i}", None, cat, "B", "pcs", Decimal("2.00"), None if cost is None else Decimal(cost),
            mn, None, active, T0, T0)


def test_h1_search_is_case_insensitive_and_keeps_wildcards(spark):
    df = spark.createDataFrame([("Red_Widget",), ("red-widget",), ("BLUE",)], "name string")
    assert df.filter(contains_any("RED_W", "name")).count() == 2  # '_' matches any character
    assert df.filter(contains_any("blue", "name")).count() == 1


def test_h2_name_concat_is_null_when_a_part_is(spark):
    df = spark.createDataFrame([("A", None), ("A", "B")], "f string, l string")
    assert [r[0] for r in df.select(full_name("f", "l")).collect()] == [None, "A B"]


def test_h3_h22_cart_validation(spark):
    products = _mk(spark, "products", [_prod(1, "A"), _prod(2, "B"), _prod(3, "C", active=0)])
    stock = _mk(spark, "stock", [(10, 1, None, 5, 0, T0, None), (11, 1, 101, 2, 0, T0, None),
                                 (20, 2, None, 1, 0, T0, None)])
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    lines = spark.createDataFrame(
        [(1, 1, 1, None, 3), (1, 2, 1, None, 3),      # same product twice: running 6 > 5 on line 2
         (2, 1, 1, 101, 2), (2, 2, 2, None, 1),      # variant matched null-safely; fits
         (3, 1, 3, None, 1), (3, 2, 2, 999, 1)],     # inactive product; no stock row for the variant
        "cart_id long, line_no int, product_id long, variant_id long, quantity int")
    v = {(r.cart_id, r.line_no): r for r in S.cart_validation(t, lines).collect()}
    assert v[(1, 1)].reason is None and v[(1, 2)].reason == "insufficient_stock" and v[(1, 1)].cart_ok == 0
    assert v[(2, 1)].reason is None and v[(2, 2)].reason is None and v[(2, 1)].cart_ok == 1
    assert v[(3, 1)].reason == "product_not_found" and v[(3, 2)].reason == "stock_record_not_found"
    assert v[(3, 2)].cart_reason == "product_not_found" and v[(3, 2)].first_bad_line == 1


def test_h7_week_chart_has_seven_slots(spark):
    sales = _mk(spark, "sales", [(1, "S1", Decimal("5.00"), Decimal(0), Decimal(0), "cash", "completed", 1, None, None,
                                  dt.datetime(2001, 7, 25, 10)),   # as_of - 7: read, but no slot
                                 (2, "S2", Decimal("7.00"), Decimal(0), Decimal(0), "cash", "pending", 1, None, None,
                                  dt.datetime(2001, 8, 1, 9))])
    t = RetailTables.from_frames(spark, sales=sales)
    rows = D.sales_chart(t, "week", dt.date(2001, 8, 1)).collect()
    assert len(rows) == 7 and rows[0].label if rows else True
    got = {r.label: (r.sales, r.revenue) for r in rows}
    assert "2001-07-25" not in got and got["2001-08-01"] == (1, 0.0)
    assert sum(s for s, _ in got.values()) == 1


def test_h24_refunds(spark):
    sales = _mk(spark, "sales", [
        (1, "S1", Decimal(10), Decimal(0), Decimal(0), "cash", "completed", 1, None, None, T0),
        (2, "S2", Decimal(10), Decimal(0), Decimal(0), "cash", "completed", 1, None, "n", T0),
        (3, "S3", Decimal(10), Decimal(0), Decimal(0), "cash", "refunded", 1, None, None, T0)])
    t = RetailTables.from_frames(spark, sales=sales)
    items = spark.createDataFrame([(1, 1, 7, None, 1), (1, 2, 8, None, 2), (2, 1, 7, None, 1), (2, 2, 8, None, 1),
                                   (3, 1, 7, None, 1)],
                                  "sale_id long, line_no int, product_id long, variant_id long, quantity int")
    req = spark.createDataFrame([(1, 1, None), (2, 2, "r"), (3, 2, None), (4, 2, None), (5, 2, None), (6, 3, None),
                                 (7, 1, None)], "request_id long, sale_id long, reason string")
    lines = spark.createDataFrame([(2, 1), (3, 1), (4, 2), (5, 2), (7, 9)], "request_id long, line_no int")
    out = {r.request_id: r for r in X.refund_outcomes(t, items, req, lines).collect()}
    assert out[1].refund_type == "full" and out[1].refunded_items == 2
    assert out[2].refund_type == "partial" and out[2].note_appended == "n\nRefund: r"
    assert out[3].accepted == 1 and out[4].accepted == 1            # partial refunds may repeat
    assert out[6].accepted == 0 and out[6].error == "Sale not found or already refunded"
    assert out[7].accepted == 0 and out[7].error == "Sale already refunded"  # after the full refund 1


def test_h27_zero_cost_becomes_null(spark):
    inc = spark.createDataFrame([(1, 100, "N1", "x", Decimal("1.00"), None, None, None, Decimal("0"), None, None, None)],
                                "req_id long, id long, sku string, name string, price decimal(10,2), category_id long, "
                                "brand string, unit_size string, cost decimal(10,2), min_stock_level int, "
                                "barcode string, description string")
    products = _mk(spark, "products", [_prod(1, "A")])
    cats = _mk(spark, "categories", [(1, "c", None, None, 1, T0, T0)])
    t = RetailTables.from_frames(spark, products=products, categories=cats)
    chk = C.catalog_check(t, inc, "insert")
    assert chk.collect()[0].ok == 1
    rows, stock = C.catalog_insert(t, inc, chk, "2001-08-01 00:00:00")
    r = rows.collect()[0]
    assert r.cost is None and r.unit_size == "pcs" and r.min_stock_level == 0
    assert stock.collect()[0].quantity == 0


def test_h29_h30_tree_with_inactive_parent_and_cycle(spark):
    cats = _mk(spark, "categories", [(1, "root", None, None, 1, T0, T0), (2, "off", None, 1, 0, T0, T0),
                                     (3, "under-off", None, 2, 1, T0, T0), (4, "kid", None, 1, 1, T0, T0),
                                     (5, "a", None, 6, 1, T0, T0), (6, "b", None, 5, 1, T0, T0)])
    products = _mk(spark, "products", [_prod(1, "A", cat=4)])
    t = RetailTables.from_frames(spark, categories=cats, products=products)
    tree = {r.id: r for r in P.category_tree(t).collect()}
    assert tree[4].in_tree == 1 and tree[4].path == "root > kid" and tree[4].product_count == 1
    assert tree[3].in_tree == 0 and tree[5].in_tree == 0 and tree[6].in_tree == 0
    clo = {(r.ancestor_id, r.descendant_id) for r in P.category_descendants(t).collect()}
    assert (5, 6) in clo and (6, 5) in clo and (1, 3) not in clo     # cycle stops; inactive node blocks descent
    req = spark.createDataFrame([(1, 1, "root", 4), (2, 4, "kid", 4), (3, 4, "kid", 99)],
                                "req_id long, id long, name string, parent_id long")
    out = {r.req_id: r.reason for r in C.category_reparent_check(t, req).collect()}
    assert out == {1: "Cannot create circular reference", 2: "Category cannot be its own parent",
                   3: "Parent category not found"}


def test_k9_acknowledge(spark):
    alerts = _mk(spark, "low_stock_alerts", [(1, 1, None, 3, 5, "active", None, None, T0),
                                             (2, 1, None, 2, 5, "acknowledged", 7, T0, T0)])
    acks = spark.createDataFrame([(1, 3, dt.datetime(2001, 7, 2)), (1, 4, dt.datetime(2001, 7, 3)),
                                  (2, 3, dt.datetime(2001, 7, 2)), (9, 3, dt.datetime(2001, 7, 2))],
                                 "alert_id long, user_id long, ack_at timestamp_ntz")
    new = {r.id: r for r in X.acknowledge_alerts(alerts, acks).collect()}
    assert new[1].alert_status == "acknowledged" and new[1].acknowledged_by == 3
    assert new[2].acknowledged_by == 7
    res = sorted((r.alert_id, r.user_id, r.result) for r in X.ack_outcomes(alerts, acks).collect())
    assert [x[2] for x in res] == ["acknowledged", "not found or already acknowledged",
                                   "not found or already acknowledged", "not found or already acknowledged"]
    twice = acks.filter("alert_id = 1 and user_id = 3").unionByName(acks.filter("alert_id = 1 and user_id = 3"))
    assert sorted(r.result for r in X.ack_outcomes(alerts, twice).collect()) == ["acknowledged", "not found or already acknowledged"]


def test_s5_documents(spark):
    """Parts of a long sale, a sale without lines, and a line whose product is missing."""
    line = lambda sale, no, pid: (sale, no, pid, None, 2, Decimal("1.50"), Decimal("3.00"), 0, T0)
    t = RetailTables.from_frames(
        spark, products=_mk(spark, "products", [_prod(1, "A")]), users=_mk(spark, "users", []),
        sales=_mk(spark, "sales", [(i, f"S{i}", Decimal("9.00"), Decimal(0), Decimal(0), "cash", "completed", None, None, None, T0) for i in (1, 2, 3)]),
        sale_lines=_mk(spark, "sale_lines", [line(1, n, 1) for n in (5, 2, 1, 4, 3)] + [line(2, 1, 77)]))
    out = {(r.sale_id, r.part): json.loads(r.document) for r in S.sale_documents(t, part_items=2).collect()}
    assert {k: [i["line_no"] for i in d["items"]] for k, d in out.items()} == {
        (1, 0): [1, 2], (1, 1): [3, 4], (1, 2): [5], (2, 0): [], (3, 0): []}
    assert out[1, 2]["items"][0]["unit_price"] == "1.50" and out[3, 0]["cashier_name"] is None
    one = spark.createDataFrame([(3,)], "id long")
    assert [r.sale_id for r in S.sale_documents(t, one).collect()] == [3]


def test_s13_line_mode_outputs(spark):
    products = _mk(spark, "products", [_prod(1, "A"), _prod(2, "B")])
    stock = _mk(spark, "stock", [(10, 1, None, 5, 0, T0, None), (20, 2, None, 1, 0, T0, None)])
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    lines = spark.createDataFrame(
        [(1, 1, 1, None, 4, Decimal("2.00"), 3, T0), (1, 2, 2, None, 2, Decimal("5.00"), 3, T0),
         (2, 1, 1, None, 1, Decimal("2.00"), 3, T0), (2, 2, 1, None, 1, Decimal("2.00"), 3, T0)],
        "cart_id long, line_no int, product_id long, variant_id long, quantity int, "
        "unit_price decimal(12,2), created_by long, created_at timestamp_ntz")
    res = X.apply_sales(t, lines)
    ok = {(r.cart_id, r.line_no): (r.line_ok, r.stock_before, r.stock_after) for r in res.collect()}
    assert ok == {(1, 1): (1, 5, 1), (1, 2): (0, 1, 1), (2, 1): (1, 1, 0), (2, 2): (0, 0, 0)}
    carts = {r.cart_id: r.outcome for r in X.apply_sales_carts(res).collect()}
    assert carts == {1: "partial", 2: "partial"}
    headers = spark.createDataFrame([(1, "S-1", None, 3, None, Decimal("1.00"), None, None, T0),
                                     (2, "S-2", "card", 3, "x", None, Decimal("0.50"), None, T0)],
                                    "cart_id long, sale_number string, payment_method string, cashier_id long, "
                                    "customer_name string, discount_amount decimal(12,2), tax_amount decimal(12,2), "
                                    "notes string, created_at timestamp_ntz")
    rows = {r.id: r for r in X.sale_replay_rows(res, headers).collect()}
    assert rows[1].total_amount == Decimal("7.00") and rows[1].payment_method == "cash"
    assert rows[2].total_amount == Decimal("2.50")
    mv = X.sale_replay_movements(res, headers).collect()
    assert sorted((m.reference_id, m.line_no, m.quantity_change, m.notes) for m in mv) == [(1, 1, -4, "Sale S-1"), (2, 1, -1, "Sale S-2")]
    assert X.sale_replay_items(res).count() == 2


def _py_carts(carts, stock):
    """Sequential truth: carts in order, all-or-nothing, running quantity within a cart."""
    stock = dict(stock)
    out = {}
    for cid in sorted(carts, key=lambda c: min(l[0] for l in carts[c])):
        need = {}
        ok = True
        for seq, pid, qty in sorted(carts[cid]):
            if pid not in stock:
                ok = False
                break
            need[pid] = need.get(pid, 0) + qty
            if need[pid] > stock[pid]:
                ok = False
        out[cid] = "accepted" if ok else "rejected"
        if ok:
            for pid, q in need.items():
                stock[pid] -= q
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_cart_mode_matches_sequential_truth(spark, seed):
    import random
    rng = random.Random(seed)
    npid = 4
    products = _mk(spark, "products", [_prod(i, f"P{i}") for i in range(npid)])
    stock_q = {i: rng.randrange(0, 25) for i in range(npid - 1)}  # product npid-1 has no stock row
    stock = _mk(spark, "stock", [(i * 10, i, None, q, 0, T0, None) for i, q in stock_q.items()])
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    carts, rows = {}, []
    for c in range(30):
        for ln in range(1, rng.randrange(1, 4) + 1):
            pid = rng.randrange(0, npid) if rng.random() < 0.95 else rng.randrange(0, npid - 1)
            q = rng.randrange(1, 6)
            seq = c * 1000 + ln
            carts.setdefault(c, []).append((seq, pid, q))
            rows.append((c, ln, pid, None, q, Decimal("1.00"), 1, T0))
    lines = spark.createDataFrame(rows, "cart_id long, line_no int, product_id long, variant_id long, "
                                        "quantity int, unit_price decimal(12,2), created_by long, created_at timestamp_ntz")
    got = {r.cart_id: r.status for r in X.apply_sales_exact(t, lines).collect()}
    want = _py_carts(carts, stock_q)
    assert got == want
    # the outputs: lines of sold carts only, stock walked down line by line, one alert per stock that gets low
    posted = X.post_sales(t.__class__.from_frames(spark, products=products, stock=stock), lines)
    left, low, walk = dict(stock_q), {}, {}
    for c, ln, pid, _, q, *_ in sorted(rows):
        if want[c] == "accepted":
            walk[c, ln] = (left[pid], left[pid] - q)
            left[pid] -= q
            if left[pid] <= 5:
                low.setdefault(pid, (c, ln, left[pid]))
    assert {(r.cart_id, r.line_no): (r.stock_before, r.stock_after) for r in posted.filter("line_ok = 1").collect()} == walk
    assert {r.product_id: r.quantity for r in X.stock_after_sales(t, posted).collect()} == left
    none = spark.createDataFrame([], RETAIL_SCHEMAS["low_stock_alerts"])
    t2 = RetailTables.from_frames(spark, products=products.withColumn("min_stock_level", F.lit(5)), stock=stock, low_stock_alerts=none)
    assert {r.product_id: (r.sale_id, r.line_no, r.current_stock) for r in X.alerts_after_sales(t2, posted).collect()} == low
    assert posted.count() == len(rows)


def test_sale_of_more_than_a_thousand_lines(spark):
    products = _mk(spark, "products", [_prod(1, "A")])
    stock = _mk(spark, "stock", [(10, 1, None, 2000, 0, T0, None)])
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    rows = [(1, i + 1, 1, None, 1, Decimal("1.00"), 1, T0) for i in range(1500)] + [
        (2, 1, 1, None, 400, Decimal("1.00"), 1, T0), (3, 1, 1, None, 101, Decimal("1.00"), 1, T0)]
    lines = spark.createDataFrame(rows, "cart_id long, line_no int, product_id long, variant_id long, quantity int, "
                                        "unit_price decimal(12,2), created_by long, created_at timestamp_ntz")
    res = X.apply_sales(t, lines)
    assert res.count() == len(rows) and {r.cart_id: r.outcome for r in X.apply_sales_carts(res).collect()} == {
        1: "completed", 2: "completed", 3: "rejected"}
    posted = {(r.cart_id, r.line_no): r.stock_after for r in X.post_sales(t, lines).collect()}
    assert len(posted) == len(rows) and posted[1, 1500] == 500 and posted[2, 1] == 100 and posted[3, 1] is None


def _sale(i, amount, status, at, cashier=1):
    return (i, f"S{i}", Decimal(amount), Decimal(0), Decimal(0), "cash", status, cashier, None, None, at)


def test_h6_h9_h10_h20_period_semantics(spark):
    as_of = dt.date(2001, 8, 1)
    sales = _mk(spark, "sales", [
        _sale(1, "10.00", "completed", dt.datetime(2001, 7, 25, 0, 0)),   # as_of - 7: inside "week"
        _sale(2, "20.00", "refunded", dt.datetime(2001, 7, 30, 12)),
        _sale(3, "5.00", "pending", dt.datetime(2001, 8, 4, 9)),          # after as_of: no upper bound
        _sale(4, "7.00", "completed", dt.datetime(2001, 7, 24, 23, 59))])  # just outside
    t = RetailTables.from_frames(spark, sales=sales)
    r = S.sales_period_summary(t, "week", as_of).collect()[0]
    assert (r.total_sales, r.total_revenue, r.completed_sales, r.refunded_sales) == (3, 10.0, 1, 1)
    assert r.net_revenue == -10.0                                # completed − refunded, kept as is
    f = S.sales_filtered_summary(t, date_from="2001-07-25", date_to="2001-08-04").collect()[0]
    assert f.total_revenue == 35.0                               # list summary sums every status
    empty = S.sales_period_summary(t, "today", dt.date(1990, 1, 1)).collect()[0]
    assert empty.total_revenue is None and empty.average_sale is None
    ov = D.sales_overview(t, dt.date(2010, 1, 1)).collect()[0]
    assert (ov.today_revenue, ov.week_revenue, ov.today_average) == (0.0, 0.0, 0.0)


def test_h11_h12_periods(spark):
    sales = _mk(spark, "sales", [_sale(1, "10.00", "completed", dt.datetime(2001, 1, 5))])
    users = _mk(spark, "users", [(1, "u", "u@x.io", "cashier", "A", "B", 1, T0, T0),
                                 (2, "v", "v@x.io", "admin", "C", "D", 1, T0, T0)])
    t = RetailTables.from_frames(spark, sales=sales, users=users)
    with pytest.raises(ValueError):
        S.sales_period_summary(t, "fortnight")
    perf = {r.id: (r.total_sales, r.total_revenue) for r in D.cashier_performance(t, "year", dt.date(2001, 8, 1)).collect()}
    assert perf == {1: (1, 10.0), 2: (0, 0.0)}                  # users without sales kept with zeros


def test_h16_h17_h18_missing_and_empty_stock(spark):
    cats = _mk(spark, "categories", [(1, "root", None, None, 1, T0, T0)])
    products = _mk(spark, "products", [_prod(1, "A", cat=1, mn=5), _prod(2, "B", cat=1, mn=5), _prod(3, "C", cat=1)])
    stock = _mk(spark, "stock", [(10, 1, None, 0, 0, T0, None), (20, 2, None, 9, 0, T0, None)])  # 3: no stock row
    t = RetailTables.from_frames(spark, categories=cats, products=products, stock=stock)
    from tillbook.operators import stock as K
    lv = {r.id: (r.stock_status, r.is_low_stock) for r in K.stock_levels(t).collect()}
    assert lv == {1: ("out_of_stock", 1), 2: ("in_stock", 0), 3: ("in_stock", 0)}
    d = D.stock_distribution(t).collect()[0]
    assert (d.out_of_stock, d.low_stock, d.in_stock) == (1, 0, 1)   # product 3 is in no bucket
    c = D.inventory_by_category(t).collect()[0]
    assert (c.total_products, c.low_stock_count, c.out_of_stock_count) == (3, 1, 1)  # out counts as low here


def test_h25_adjust_quantity_rules(spark):
    products = _mk(spark, "products", [_prod(1, "A")])
    stock = _mk(spark, "stock", [(10, 1, None, 4, 0, T0, None)])
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    adj = spark.createDataFrame([(1, 1, None, "adjustment", 0, 1, T0), (2, 1, None, "in", 3, 1, T0),
                                 (3, 1, None, "out", 10, 1, T0), (4, 2, None, "in", 1, 1, T0)],
                                RETAIL_SCHEMAS["stock_ops"])
    single = {r.seq: (r.status, r.error, r.new_quantity) for r in X.adjust_results(t, adj, min_quantity=1).collect()}
    assert single[1] == ("failed", "Validation failed", None)
    assert single[2] == ("success", None, 7) and single[3] == ("success", None, 0)   # out floors at 0
    assert single[4] == ("failed", "Product not found", None)
    bulk = {r.seq: (r.status, r.new_quantity) for r in X.adjust_results(t, adj, min_quantity=0).collect()}
    assert bulk[1] == ("success", 0) and bulk[2] == ("success", 3) and bulk[3] == ("success", 0)
    s = X.adjust_summary(X.adjust_results(t, adj)).collect()[0]
    assert (s.total, s.successful, s.failed) == (4, 3, 1)


def test_h28_sku_of_an_inactive_product(spark):
    products = _mk(spark, "products", [_prod(1, "OLD", active=0), _prod(2, "LIVE")])
    cats = _mk(spark, "categories", [(1, "c", None, None, 1, T0, T0)])
    t = RetailTables.from_frames(spark, products=products, categories=cats)
    inc = spark.createDataFrame(
        [(1, 10, "OLD", "x", Decimal("1.00"), None, None, None, None, None, None, None),
         (2, 11, "LIVE", "y", Decimal("1.00"), None, None, None, None, None, None, None),
         (3, 12, "NEW", "z", Decimal("1.00"), None, None, None, None, None, None, None),
         (4, 13, "NEW", "z2", Decimal("1.00"), None, None, None, None, None, None, None)],
        "req_id long, id long, sku string, name string, price decimal(10,2), category_id long, brand string, "
        "unit_size string, cost decimal(10,2), min_stock_level int, barcode string, description string")
    out = {r.req_id: (r.ok, r.reason, r.warning) for r in C.catalog_check(t, inc, "insert").collect()}
    assert out[1] == (1, None, "SKU is used by an inactive product")
    assert out[2] == (0, "Product with this SKU already exists", None)
    assert out[3] == (1, None, None) and out[4] == (0, "Product with this SKU already exists", None)


def test_catalog_check_dealt_to_tasks(spark, monkeypatch):
    """Large request tables: no side is broadcast, rows without a key don't meet, and the outcome is that of small ones."""
    from tillbook.plans import tasks
    products = _mk(spark, "products", [_prod(i, f"P{i}") for i in range(1, 40)])
    cats = _mk(spark, "categories", [(1, "c", None, None, 1, T0, T0)])
    t = RetailTables.from_frames(spark, products=products, categories=cats)
    inc = spark.createDataFrame([(i, i, None if i % 9 == 0 else f"P{i + (i % 4 == 0) - (i % 4 == 1)}", "x", Decimal("1.00"), 1 + i % 2, None, None,
                                  None, None, None if i % 3 else f"b{i // 2}", None) for i in range(1, 45)],
                                "req_id long, id long, sku string, name string, price decimal(10,2), category_id long, brand string, "
                                "unit_size string, cost decimal(10,2), min_stock_level int, barcode string, description string")
    want = sorted(map(str, C.catalog_check(t, inc, "update").collect()))
    after = sorted(map(str, C.catalog_update(t, inc, C.catalog_check(t, inc, "update"), "2001-08-01 00:00:00").collect()))
    monkeypatch.setattr(tasks, "TASK_ROWS", 1)
    n = tasks.tasks_for(inc)
    assert n == 44
    assert sorted(map(str, C.catalog_check(t, inc, "update").collect())) == want and "ok=0" in str(want) and "ok=1" in str(want)
    assert sorted(map(str, C.catalog_update(t, inc, C.catalog_check(t, inc, "update"), "2001-08-01 00:00:00").collect())) == after
    held = products.groupBy("sku").count()
    plan = tasks.looked_up(inc, F.col("sku"), "req_id", held, "sku", n)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


@pytest.mark.parametrize("rows", [25])
def test_carts_settled_by_components(spark, monkeypatch, rows):
    """Components of contested carts side by side, giant ones through the bounds again: as one by one."""
    import random
    monkeypatch.setattr(X, "GROUP_ROWS", rows)
    calls, components = [], X.components
    monkeypatch.setattr(X, "components", lambda *a: calls.append(1) or components(*a))
    rng = random.Random(rows)
    products = _mk(spark, "products", [_prod(i, f"P{i}") for i in range(12)])
    stock_q = {i: rng.randrange(3, 20) for i in range(12)}
    stock = _mk(spark, "stock", [(i * 10, i, None, q, 0, T0, None) for i, q in stock_q.items()])
    carts, lines = {}, []
    for c in range(36):
        for ln in range(1, rng.randrange(1, 4) + 1):
            pid, q = 4 * (c % 3) + rng.randrange(0, 4), rng.randrange(1, 7)  # three sets of products
            carts.setdefault(c, []).append((c * 1000 + ln, pid, q))
            lines.append((c, ln, pid, None, q, Decimal("1.00"), 1, T0))
    lines = spark.createDataFrame(lines, "cart_id long, line_no int, product_id long, variant_id long, "
                                         "quantity int, unit_price decimal(12,2), created_by long, created_at timestamp_ntz")
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    assert {r.cart_id: r.status for r in X.apply_sales_exact(t, lines).collect()} == _py_carts(carts, stock_q) and calls


def test_contested_carts_go_on_by_bounds(spark, monkeypatch):
    """Carts that contest few products: the bounds settle them, with one look at the components in place of one a round."""
    import random
    monkeypatch.setattr(X, "GROUP_ROWS", 2)
    calls, components = [], X.components
    monkeypatch.setattr(X, "components", lambda *a: calls.append(1) or components(*a))
    rng = random.Random(5)
    products = _mk(spark, "products", [_prod(i, f"P{i}") for i in range(4)])
    stock_q = {i: 200 for i in range(4)}
    stock = _mk(spark, "stock", [(i * 10, i, None, q, 0, T0, None) for i, q in stock_q.items()])
    carts, lines = {}, []
    for c in range(80):
        for ln, pid in enumerate(rng.sample(range(4), 2), 1):
            q = rng.randrange(1, 40)
            carts.setdefault(c, []).append((c * 1000 + ln, pid, q))
            lines.append((c, ln, pid, None, q, Decimal("1.00"), 1, T0))
    lines = spark.createDataFrame(lines, "cart_id long, line_no int, product_id long, variant_id long, "
                                         "quantity int, unit_price decimal(12,2), created_by long, created_at timestamp_ntz")
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    assert {r.cart_id: r.status for r in X.apply_sales_exact(t, lines).collect()} == _py_carts(carts, stock_q) and len(calls) <= 1


def test_item_groups_go_in_bounded_partitions(spark, monkeypatch):
    """A large table's lines are spread by their number, with the same sums."""
    from tillbook.operators import sales as S
    sales = spark.createDataFrame([(i, "completed" if i % 3 else "refunded", T0) for i in range(60)],
                                  "id long, status string, created_at timestamp_ntz")
    items = [(i % 60, i % 7, 1 + i % 4, Decimal(i)) for i in range(300)]
    t = RetailTables.from_frames(spark, sales=sales, sale_items=spark.createDataFrame(
        items, "sale_id long, product_id long, quantity int, total_price decimal(12,2)"))
    monkeypatch.setattr(S, "TASK_ROWS", 5)
    got = S._completed_item_agg(t, "all", "2001-08-01", with_sale_count=True)
    kept = [x for x in items if x[0] % 3]
    assert {(r.product_id, r.total_sold, r.rev, r.sale_count) for r in got.collect()} == {
        (p, sum(x[2] for x in kept if x[1] == p), sum(x[3] for x in kept if x[1] == p), len({x[0] for x in kept if x[1] == p})) for p in range(7)}
    assert "REPARTITION_BY_NUM" in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("window_rows", [1, 1 << 18])
def test_contested_carts_need_no_components(spark, monkeypatch, window_rows):
    """The rounds go on while they decide much, on the open carts only, whether keys are scanned in a window or in chunks."""
    import random
    monkeypatch.setattr(X, "GROUP_ROWS", 50)
    monkeypatch.setattr(X, "WINDOW_ROWS", window_rows, raising=False)
    calls, components = [], X.components
    monkeypatch.setattr(X, "components", lambda *a: calls.append(1) or components(*a))
    rng = random.Random(5)
    products = _mk(spark, "products", [_prod(i, f"P{i}") for i in range(4)])
    stock_q = {i: 200 for i in range(4)}
    stock = _mk(spark, "stock", [(i * 10, i, None, q, 0, T0, None) for i, q in stock_q.items()])
    carts, lines = {}, []
    for c in range(80):
        for ln, pid in enumerate(rng.sample(range(4), 2), 1):
            q = rng.randrange(1, 40)
            carts.setdefault(c, []).append((c * 1000 + ln, pid, q))
            lines.append((c * 30_000, ln, pid, None, q, Decimal("1.00"), 1, T0))  # several chunks
    lines = spark.createDataFrame(lines, "cart_id long, line_no int, product_id long, variant_id long, "
                                         "quantity int, unit_price decimal(12,2), created_by long, created_at timestamp_ntz")
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    got = {r.cart_id // 30_000: r.status for r in X.apply_sales_exact(t, lines).collect()}
    assert got == _py_carts(carts, stock_q) and not calls


def test_rounds_take_only_carts_that_fit_the_stock_at_the_start(spark, monkeypatch):
    """Carts that need more than a stock ever had, or have a refused line, are out before the first prefix sum; products and stocks
    that stand there twice have their lines twice, as their look-ups do."""
    seen, by_bounds = [], X._by_bounds
    monkeypatch.setattr(X, "_by_bounds", lambda rows, *a: seen.append(sorted({r.cart_id for r in rows.collect()})) or by_bounds(rows, *a))
    monkeypatch.setattr(X, "GROUP_ROWS", 0)
    products = _mk(spark, "products", [_prod(i, f"P{i}") for i in (1, 2, 3, 3)])
    stock = _mk(spark, "stock", [(10, 1, None, 10, 0, T0, None), (20, 2, None, 10, 0, T0, None), (30, 3, None, 10, 0, T0, None)])
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    carts = {1: [(1, 11)], 2: [(1, 4), (2, 4)], 3: [(2, 6), (2, 5)], 4: [(1, 6), (2, 6)], 5: [(1, 1), (9, 1)], 6: [(1, 6), (2, 7)], 7: [(3, 6)], 8: [(3, 4)]}
    rows = [(c, n, p, None, q, Decimal("1.00"), 1, T0) for c, x in carts.items() for n, (p, q) in enumerate(x, 1)]
    lines = spark.createDataFrame(rows, "cart_id long, line_no int, product_id long, variant_id long, quantity int, "
                                        "unit_price decimal(12,2), created_by long, created_at timestamp_ntz")
    sold = {2: "accepted", 4: "accepted", 8: "accepted"}  # product 3 is there twice: cart 7 takes 12, cart 8 takes 8
    assert {r.cart_id: r.status for r in X.apply_sales_exact(t, lines).collect()} == {c: sold.get(c, "rejected") for c in carts}
    assert seen[0] == [2, 4, 6, 8]
    posted = X.post_sales(t, lines).collect()
    assert sorted((r.cart_id, r.line_no, r.stock_after) for r in posted if r.line_ok) == [
        (2, 1, 6), (2, 2, 6), (4, 1, 0), (4, 2, 0), (8, 1, 2), (8, 1, 6)]
    assert len(posted) == len(rows) + 2 and {r.reason for r in posted if r.cart_id == 5} == {"Cart refused", "Product not found"}


def test_alerts_need_the_lines_of_sold_carts_only(spark, monkeypatch):
    """The alerts of a large job come from the lines of its sold carts, which alone are asked for."""
    monkeypatch.setattr(X, "GROUP_ROWS", 0)
    products = _mk(spark, "products", [_prod(i, f"P{i}") for i in (1, 2)]).withColumn("min_stock_level", F.lit(5))
    stock = _mk(spark, "stock", [(10, 1, None, 10, 0, T0, None), (20, 2, None, 10, 0, T0, None)])
    t = RetailTables.from_frames(spark, products=products, stock=stock, low_stock_alerts=spark.createDataFrame([], RETAIL_SCHEMAS["low_stock_alerts"]))
    carts = {1: [(1, 4)], 2: [(1, 11), (2, 1)], 3: [(1, 3), (2, 4)], 4: [(2, 7)], 5: [(2, 2)]}
    rows = [(c, n, p, None, q, Decimal("1.00")) for c, x in carts.items() for n, (p, q) in enumerate(x, 1)]
    lines, asked = spark.createDataFrame(rows, "cart_id long, line_no int, product_id long, variant_id long, quantity int, unit_price decimal(12,2)"), []

    def lines_of(c):
        asked.append(sorted(r.cart_id for r in c.collect()))
        return lines.join(c, "cart_id", "left_semi")
    alerts = X.alerts_after_sales(t, X.post_sales(t, lines, lines_of))
    assert {(r.product_id, r.sale_id, r.line_no, r.current_stock) for r in alerts.collect()} == {(1, 3, 1, 3), (2, 5, 1, 4)} and asked == [[1, 3, 5]]


def test_active_alerts_and_the_sales_job_run_side_by_side(spark, monkeypatch):
    """The sales job does not wait for the ledger that tells the active alerts; a stock with one raises no other."""
    import threading
    from types import SimpleNamespace

    from tillbook.plans import q_stock
    begun, names = threading.Event(), ["cart_id", "line_no", "product_id", "variant_id", "quantity", "unit_price", "line_ok", "stock_after"]
    alert = (1, 2, None, 1, 5, "active", None, None, T0)
    t = RetailTables.from_frames(spark, products=_mk(spark, "products", [_prod(i, f"P{i}") for i in (1, 2)]),
                                 low_stock_alerts=spark.createDataFrame([alert], RETAIL_SCHEMAS["low_stock_alerts"]))
    kinds = "cart_id long, line_no int, product_id long, variant_id long, quantity int, unit_price decimal(12,2), line_ok int, stock_after long"
    posted = spark.createDataFrame([(c, 1, p, None, 1, Decimal("1.00"), 1, 3) for c, p in ((7, 1), (8, 1), (9, 2))], kinds).select(*names)
    active_alert_keys = X.active_alert_keys
    monkeypatch.setattr(X, "active_alert_keys", lambda t: active_alert_keys(t) if begun.wait(60) else None)
    monkeypatch.setattr(X, "post_sales", lambda *a: begun.set() or posted)
    monkeypatch.setattr(q_stock.SI, "cart_line_reader", lambda t: SimpleNamespace)
    got = q_stock._posted_alerts(t).collect()
    assert [(r.product_id, r.sale_id, r.current_stock, r.alert_status) for r in got] == [(1, 7, 3, "active")]


def test_a_round_shuffles_open_rows_by_key_once(spark):
    """What accepted carts take and the next round's prefix sums go through one shuffle by key, then one by cart; refused rows leave before."""
    rows = spark.createDataFrame([(1, 1, -1, 4, 10, 0, "accepted"), (2, 1, -1, 9, 10, 0, "rejected"), (3, 1, -1, 5, 10, 0, None),
                                  (4, 1, -1, 2, 10, 0, None), (1, 2, -1, None, 8, 0, "accepted")],
                                 "cart_id long, product_id long, _vk long, _need long, _open long, _sold int, status string").checkpoint(eager=True)
    left = X._left_open(rows, None)
    assert {tuple(r) for r in left.collect()} == {(3, 1, -1, 5, 6, 0), (4, 1, -1, 2, 6, 0), (1, 2, -1, None, 8, 1)}
    done = X._decided(left, None)
    assert {(r.cart_id, r.status) for r in done.collect()} == {(3, "accepted"), (4, None), (1, None)}
    plan = done._jdf.queryExecution().sparkPlan().toString() + done._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 2


@pytest.mark.parametrize("seed", [1, 2])
def test_large_jobs_add_up_quantities_below_zero(spark, monkeypatch, seed):
    """A line that needs more than the stock at the start puts its cart out alone, but not where another gives some back."""
    import random
    rng = random.Random(seed)
    monkeypatch.setattr(X, "GROUP_ROWS", 0)
    products = _mk(spark, "products", [_prod(i, f"P{i}") for i in range(1, 5)])
    stock = _mk(spark, "stock", [(i * 10, i, None, 30, 0, T0, None) for i in range(1, 5)])
    t = RetailTables.from_frames(spark, products=products, stock=stock)
    carts = {1: [(1, 31), (1, -5)], 2: [(2, 31), (3, -1)], 3: [(3, 31), (3, 1)], 4: [(4, 40), (4, -20), (9, 1)]}
    carts |= {c: [(rng.randrange(1, 5), rng.choice((-8, 3, 12, 33))) for _ in range(rng.randrange(1, 4))] for c in range(5, 40)}
    rows = [(c, n, p, None, q, Decimal("1.00")) for c, x in carts.items() for n, (p, q) in enumerate(x, 1)]
    lines = spark.createDataFrame(rows, "cart_id long, line_no int, product_id long, variant_id long, quantity int, unit_price decimal(12,2)")
    needs = X._needs(t, lines, X._known_stocks(t), fitting=True)
    want = {}
    for c, x in carts.items():
        sums = {p: sum(q for k, q in x if k == p) for p, _ in x}
        if all(p < 9 and q <= 30 for p, q in sums.items()):
            want |= {(c, p): q for p, q in sums.items()}
    assert {(r.cart_id, r.product_id): r._need for r in needs.collect()} == want and (1, 1) in want and (2, 2) not in want


def test_lines_of_some_sales_are_numbered_alone(spark):
    """Only the lines of the sales asked for are numbered, with the numbers of the whole table, as often as the sale is there."""
    from types import SimpleNamespace

    from tillbook.sources import standins as SI
    from tillbook.sources.base import BASE_SCHEMAS
    rows = [(i % 5, i % 3, 1, 1 + i // 10, float(1 + i % 4), 10.0 * i, 0.0, 0.0, "RN"[i % 2], "O", T0) for i in range(40)]
    t = RetailTables(spark, base={"lineitem": spark.createDataFrame(rows, BASE_SCHEMAS["lineitem"])})
    some = spark.createDataFrame([(1,), (3,), (77,)], "sale_id long")
    got = t.sale_lines_of(some)
    assert sorted(map(tuple, got.collect())) == sorted(tuple(r) for r in t.sale_lines.collect() if r.sale_id in (1, 3))
    sales = spark.createDataFrame([(i, i, T0) for i in (0, 1, 1, 3)], "id long, cashier_id long, created_at timestamp_ntz")
    t2 = SimpleNamespace(spark=spark, sales=sales, sale_lines=t.sale_lines, sale_lines_of=t.sale_lines_of)
    read, cols = SI.cart_line_reader(t2), ["cart_id", "line_no", "product_id", "variant_id", "quantity", "unit_price"]
    want = SI.cart_lines(t2).select(*cols)
    assert sorted(map(str, read().select(*cols).collect())) == sorted(map(str, want.collect())) and want.count() == 48
    mine = read(some.withColumnRenamed("sale_id", "cart_id")).select(*cols)
    assert sorted(map(str, mine.collect())) == sorted(map(str, want.filter("cart_id in (1, 3)").collect()))


def test_components_of_graphs(spark):
    from tillbook.plans.graph import components
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(200)] + [(5000, 5000), (7, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1201)}, 5000: 5000}


REQ = ("req_id long, id long, sku string, name string, price decimal(10,2), category_id long, brand string, "
       "unit_size string, cost decimal(10,2), min_stock_level int, barcode string, description string")


def _reqs(spark, *rows):
    return spark.createDataFrame([(r, i, sku, "n", Decimal("1.00"), None, None, None, None, None, bar, None)
                                  for r, i, sku, bar in rows], REQ)


def test_requests_of_one_batch_are_settled_in_order(spark):
    products = _mk(spark, "products", [_prod(1, "A"), _prod(2, "B")])
    t = RetailTables.from_frames(spark, products=products, categories=_mk(spark, "categories", []))
    # two updates of one product with its own SKU; another product may not take it
    out = {r.req_id: r.reason for r in C.catalog_check(t, _reqs(spark, (1, 1, "A", None), (2, 1, "A", None)), "update").collect()}
    assert out == {1: None, 2: None}
    new = _reqs(spark, (1, 11, "N", "77"), (2, 12, "N", "88"), (3, 13, "M", "88"), (4, 14, "M", "99"), (5, 15, "K", "99"))
    out = {r.req_id: r.ok for r in C.catalog_check(t, new, "insert").collect()}
    assert out == {1: 1, 2: 0, 3: 1, 4: 0, 5: 1}   # a refused request blocks nothing by its barcode
    users = _mk(spark, "users", [(i, f"user{i}", f"u{i}@x.io", "cashier", "A", "B", 1, T0, T0) for i in (1, 2, 3)])
    t = RetailTables.from_frames(spark, users=users)
    nul = None
    patches = spark.createDataFrame([(1, 1, 9, "fresh", nul, nul, nul, nul, nul), (2, 2, 9, "fresh", nul, nul, nul, nul, nul),
                                     (3, 3, 9, "user3", nul, nul, "Q", nul, nul)],
                                    "req_id long, id long, actor_id long, username string, email string, role string, "
                                    "first_name string, last_name string, is_active int")
    assert {r.req_id: r.reason for r in C.user_partial_update(t, patches).collect()} == {
        1: None, 2: "Username already exists", 3: None}


def test_moves_that_close_a_circle_together(spark):
    cats = _mk(spark, "categories", [(i, f"c{i}", None, None, 1, T0, T0) for i in (1, 2, 3, 4)])
    t = RetailTables.from_frames(spark, categories=cats)
    moves = spark.createDataFrame([(1, 1, "c1", 2), (2, 2, "c2", 3), (3, 3, "c3", 1), (4, 4, "c4", 1)],
                                  "req_id long, id long, name string, parent_id long")
    assert {r.req_id: r.ok for r in C.category_reparent_check(t, moves).collect()} == {1: 1, 2: 1, 3: 0, 4: 1}


def test_deep_chain_and_cycle_of_categories(spark):
    chain = [(i, f"c{i}", None, i - 1 if i > 1 else None, 1, T0, T0) for i in range(1, 121)]
    circle = [(900, "x", None, 901, 1, T0, T0), (901, "y", None, 900, 1, T0, T0)]
    t = RetailTables.from_frames(spark, categories=_mk(spark, "categories", chain + circle), products=_mk(spark, "products", []))
    clo = P.category_descendants(t)
    assert clo.filter("ancestor_id < 900").count() == 120 * 119 // 2 and clo.filter("ancestor_id = 1").agg(F.max("depth")).first()[0] == 119
    tree = {r.id: (r.in_tree, r.depth) for r in P.category_tree(t).collect()}
    assert tree[120] == (1, 119) and tree[900] == (0, None)
    moves = spark.createDataFrame([(1, 1, "c1", 120), (2, 120, "c120", 1)], "req_id long, id long, name string, parent_id long")
    assert {r.req_id: r.reason for r in C.category_reparent_check(t, moves).collect()} == {1: "Cannot create circular reference", 2: None}


def test_very_deep_chain_takes_a_round_for_each_doubling(spark, monkeypatch):
    from pyspark.sql import DataFrame

    from tillbook.plans.graph import lifted, lineage, rings
    n, calls, checkpoint = 10_000, [], DataFrame.checkpoint
    links = spark.range(n).selectExpr("id", "nullif(id - 1, -1) as parent", "'x' as name")
    monkeypatch.setattr(DataFrame, "checkpoint", lambda self, *a, **k: calls.append(1) or checkpoint(self, *a, **k))
    deepest = lineage(links).filter("depth = 9999").first()
    assert (deepest.id, deepest.top, len(deepest.names), deepest.ended) == (9999, 0, n, 1) and len(calls) <= 15
    starts = spark.createDataFrame([(9999, 9999), (9999, 1), (70, 64), (5, 0)], "node long, up long")
    assert {(r.up, r.node) for r in lifted(starts, links).collect()} == {(9999, 0), (1, 9998), (64, 6), (0, 5)}
    round_trip = spark.createDataFrame([(1, 2, 5), (2, 3, None), (3, 1, 9), (4, 1, 70), (6, 6, None), (7, None, 1)], "id long, parent long, by long")
    assert {(r.id, r.by) for r in rings(round_trip, "by").collect()} == {(1, 9), (2, 9), (3, 9), (6, None)}


def _one_by_one(products, reqs, mode):
    """Catalogue requests checked one after the other against the rows as they then are."""
    rows, out = {p[0]: [p[1], p[2]] for p in products}, {}
    for req, pid, sku, bar in sorted(reqs):
        taken = next((k for k, v, i in (("SKU", sku, 0), ("barcode", bar, 1))
                      if v is not None and any(r[i] == v for j, r in rows.items() if mode == "insert" or j != pid)), None)
        if mode == "update" and pid not in rows:
            out[req] = "Product not found"
        elif taken:
            out[req] = f"Product with this {taken} already exists"
        else:
            out[req] = None
            rows[pid] = [sku, bar]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_batches_equal_requests_one_by_one(spark, seed):
    """Random updates that take and give up SKUs and barcodes, of one product several times."""
    import random
    r = random.Random(seed)
    products = [(i, f"S{i}", r.choice([None, f"{i}"])) for i in range(8)]
    table = _mk(spark, "products", [(*_prod(i, sku)[:2], bar, *_prod(i, sku)[3:]) for i, sku, bar in products])
    t = RetailTables.from_frames(spark, products=table, categories=_mk(spark, "categories", []))
    reqs = [(q, r.randrange(10), f"S{r.randrange(12)}", r.choice([None, f"{r.randrange(12)}"])) for q in range(40)]
    got = {x.req_id: x.reason for x in C.catalog_check(t, _reqs(spark, *reqs), "update").collect()}
    assert got == _one_by_one(products, reqs, "update") and 3 < sum(v is None for v in got.values()) < 36
    new = [(q, 100 + q, f"S{r.randrange(30)}", r.choice([None, f"{r.randrange(30)}"])) for q in range(30)]
    got = {x.req_id: x.reason for x in C.catalog_check(t, _reqs(spark, *new), "insert").collect()}
    assert got == _one_by_one(products, new, "insert")


def test_a_key_between_two_updates_of_one_product(spark):
    """The third product is seen although an earlier request of the same product claims the key; a freed SKU can be taken."""
    products = _mk(spark, "products", [_prod(5, "E"), _prod(6, "F"), (9, "I", "77", *_prod(9, "I")[3:])])
    t = RetailTables.from_frames(spark, products=products, categories=_mk(spark, "categories", []))
    reqs = _reqs(spark, (0, 9, "I", "B"), (1, 5, "K", "B"), (2, 6, "K", None), (3, 5, "K", None), (4, 5, "F", "77"))
    out = {r.req_id: r.reason for r in C.catalog_check(t, reqs, "update").collect()}
    assert out == {0: None, 1: "Product with this barcode already exists", 2: None, 3: "Product with this SKU already exists", 4: None}


def test_user_patches_are_normalised(spark):
    users = _mk(spark, "users", [(i, f"user{i}", f"U{i}@x.io", "cashier", "A", "B", 1, T0, T0) for i in (1, 2, 3)])
    t = RetailTables.from_frames(spark, users=users)
    nul = None
    patches = spark.createDataFrame([(1, 1, 9, nul, " U2@X.IO", nul, nul, nul, nul), (2, 2, 9, nul, "u2@x.io", nul, nul, nul, nul),
                                     (3, 3, 9, " third ", "New@X.io", nul, " Q ", nul, nul), (4, 1, 9, "user3", nul, nul, nul, nul, nul)],
                                    "req_id long, id long, actor_id long, username string, email string, role string, "
                                    "first_name string, last_name string, is_active int")
    out = {r.req_id: (r.reason, r.username, r.email, r.first_name) for r in C.user_partial_update(t, patches).collect()}
    assert out[1][0] == "Email already exists" and out[2][0] is None
    assert out[3] == (None, "third", "new@x.io", "Q") and out[4][0] is None
    again = spark.createDataFrame([(1, 1, 9, "one", nul, nul, nul, nul, nul), (2, 1, 9, nul, nul, nul, "Z", nul, nul),
                                   (3, 2, 9, "one", nul, nul, nul, nul, nul), (4, 2, 9, "user1", nul, nul, nul, nul, nul)], patches.schema)
    assert [r.ok for r in C.user_partial_update(t, again).orderBy("req_id").collect()] == [1, 1, 0, 1]


def test_delete_closure(spark):
    """Cascades through variants, keys cleared, rows that block, and blocks that follow from a refusal."""
    from tillbook.operators import quality as Q
    products = _mk(spark, "products", [_prod(i, f"P{i}", cat=c) for i, c in ((1, 10), (2, 11), (3, None), (4, 11))])
    variants = _mk(spark, "product_variants", [(21, 2, "v", "x", None, Decimal(0), 1, T0), (41, 4, "v", "x", None, Decimal(0), 1, T0)])
    sales = _mk(spark, "sales", [(i, f"S{i}", Decimal(1), Decimal(0), Decimal(0), "cash", "completed", u, None, None, T0) for i, u in ((1, 7), (2, 8), (3, None))])
    items = _mk(spark, "sale_items", [(1, 1, None, 1, Decimal(1), Decimal(1), Decimal(0), T0), (2, 9, 21, 1, Decimal(1), Decimal(1), Decimal(0), T0)])
    stock = _mk(spark, "stock", [(100, 1, None, 5, 0, T0, None), (101, 4, 41, 5, 0, T0, 8), (102, 3, None, 1, 0, T0, 9)])
    cats = _mk(spark, "categories", [(10, "a", None, None, 1, T0, T0), (11, "b", None, 10, 1, T0, T0)])
    users = _mk(spark, "users", [(i, f"u{i}", f"u{i}@x.io", "cashier", "A", "B", 1, T0, T0) for i in (7, 8, 9)])
    empty = {n: _mk(spark, n, []) for n in ("stock_movements", "low_stock_alerts")}
    t = RetailTables.from_frames(spark, products=products, product_variants=variants, sales=sales, sale_items=items, stock=stock,
                                 categories=cats, users=users, **empty)
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "id long")
    d = Q.DeleteClosure(t, {"products": ids(1, 2, 4, 77), "sales": ids(1), "categories": ids(10), "users": ids(7, 8, 9)})
    # product 2 goes not: its variant is in sale 2, which stays; user 8 has sale 2, user 9 the stock of product 3
    assert {(r.table_name, r.id): r.ok for r in d.outcomes().collect()} == {
        ("products", 1): 1, ("products", 2): 0, ("products", 4): 1, ("sales", 1): 1, ("categories", 10): 1, ("users", 7): 1, ("users", 8): 0, ("users", 9): 0}
    assert {(r.id, r.category_id) for r in d.after("products").collect()} == {(2, 11), (3, None)}
    assert {(r.id, r.parent_id) for r in d.after("categories").collect()} == {(11, None)}
    assert [r.id for r in d.after("stock").collect()] == [102] and [r.id for r in d.after("product_variants").collect()] == [21]
    assert [r.sale_id for r in d.after("sale_items").collect()] == [2]
