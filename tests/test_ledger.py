"""Ledger, scans and alert machine against plain sequential Python; stream vs batch."""

from __future__ import annotations

import datetime as dt
import os
import random
import tempfile
import time

import pandas as pd
import pytest
from pyspark.sql import Row, Window
from pyspark.sql import functions as F

from tillbook.operators import ledger as L
from tillbook.plans.scans import keyed_scan, keyed_walk
from tillbook.sources.schemas import RETAIL_SCHEMAS
from tillbook.sources.views import RetailTables
from tillbook.streaming import ledger_stream as LS

T0 = dt.datetime(2024, 1, 1)


def _ops(rng: random.Random, n: int, keys: int, with_sales: bool = True, hot: bool = True):
    kinds = ["in", "out", "adjustment", "return"] + (["sale", "sale"] if with_sales else [])
    rows = []
    for s in range(n):
        # one hot key holds about a third of the rows
        pid = 0 if (hot and rng.random() < 0.34) else rng.randrange(1, keys)
        rows.append((s * 3 + 1, pid, None, rng.choice(kinds), rng.randrange(1, 30), pid % 5,
                     T0 + dt.timedelta(seconds=s)))
    return rows


def _py_fold(rows, opening):
    q, out = {}, {}
    for seq, pid, vid, op, n, _by, _at in sorted(rows):
        cur = q.get((pid, vid), opening.get((pid, vid), 0))
        acc = 1
        if op == "adjustment":
            new = n
        elif op in ("in", "return"):
            new = cur + n
        elif op == "out":
            new = max(0, cur - n)
        elif cur >= n:
            new = cur - n
        else:
            new, acc = cur, 0
        q[(pid, vid)] = new
        out[seq] = (cur, new, acc)
    return out


def _py_alerts(rows, fold, min_level):
    active, events = {}, {}
    for seq, pid, vid, op, n, _by, _at in sorted(rows):
        before, after, acc = fold[seq]
        a = active.get(pid, False)
        low = after <= min_level
        if op in ("in", "out", "adjustment"):
            if low and not a:
                events[seq], active[pid] = "raise", True
            elif not low and a:
                events[seq], active[pid] = "resolve", False
        elif op == "sale" and acc == 1 and low and not a:
            events[seq], active[pid] = "raise", True
    return events


def _tables(spark, rows):
    ops = spark.createDataFrame(rows, RETAIL_SCHEMAS["stock_ops"])
    return RetailTables.from_frames(spark, stock_ops=ops), ops


@pytest.mark.parametrize("kind", ["sum", "min", "max", "count", "last"])
@pytest.mark.parametrize("exclusive", [False, True])
def test_keyed_scan_matches_plain_window(spark, kind, exclusive):
    rng = random.Random(7)
    rows = [(k, s, (None if rng.random() < 0.3 else rng.randrange(-20, 20)))
            for s in range(400) for k in [0 if rng.random() < 0.4 else rng.randrange(1, 6)]]
    df = spark.createDataFrame(rows, "k long, seq long, v long")
    got = keyed_scan(df, ["k"], "seq", "v", kind, "out", exclusive=exclusive, chunk_width=16)
    hi = -1 if exclusive else Window.currentRow
    w = Window.partitionBy("k").orderBy("seq").rowsBetween(Window.unboundedPreceding, hi)
    fn = {"sum": F.sum("v"), "min": F.min("v"), "max": F.max("v"), "count": F.count("v"),
          "last": F.last("v", ignorenulls=True)}[kind]
    want = df.withColumn("out", fn.over(w))
    a = sorted(got.select("seq", "out").collect())
    b = sorted(want.select("seq", "out").collect())
    assert a == b


def test_keyed_walk_matches_loop(spark):
    rng = random.Random(3)
    rows = [(k, s, rng.randrange(-15, 15), 10 if k == 0 else 3) for s in range(300)
            for k in [0 if rng.random() < 0.5 else 1]]
    df = spark.createDataFrame(rows, "k long, seq long, d long, b long")
    got = {r.seq: (r._q_before, r._q_after) for r in keyed_walk(df, ["k"], "seq", "d", "b", chunk_width=8).collect()}
    q = {}
    for k, s, d, b in rows:
        cur = q.get(k, b)
        q[k] = max(0, cur + d)
        assert got[s] == (cur, q[k])


@pytest.mark.parametrize("seed", [1, 2])
def test_stock_ledger_matches_sequential_fold(spark, seed):
    rng = random.Random(seed)
    rows = _ops(rng, 600, 8)
    t, ops = _tables(spark, rows)
    opening = {(pid, None): rng.randrange(0, 40) for pid in range(8)}
    op_df = spark.createDataFrame([(p, v, q) for (p, v), q in opening.items()],
                                  "product_id long, variant_id long, quantity int")
    want = _py_fold(rows, opening)
    got = L.stock_ledger(t, ops=ops, opening=op_df, chunk_width=32).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.q_before, r.q_after, r.accepted) == want[r.seq]


def test_window_ledger_equals_fold_without_sales(spark):
    rng = random.Random(11)
    rows = _ops(rng, 500, 6, with_sales=False)
    t, ops = _tables(spark, rows)
    a = {r.seq: (r.q_before, r.q_after) for r in L.stock_ledger_adjust_only(t, ops=ops, chunk_width=16).collect()}
    b = {r.seq: (r.q_before, r.q_after) for r in L.stock_ledger(t, ops=ops, chunk_width=16).collect()}
    assert a == b and len(a) == len(rows)


def test_alert_machine_matches_sequential(spark):
    rng = random.Random(5)
    rows = _ops(rng, 500, 5)
    t, ops = _tables(spark, rows)
    led = L.stock_ledger(t, ops=ops, chunk_width=32)
    got = {r.seq: r.event for r in L.low_stock_alert_events(t, led, min_level=12, chunk_width=32).collect()}
    want = _py_alerts(rows, _py_fold(rows, {}), 12)
    assert got == want
    alerts = L.alerts_table(L.low_stock_alert_events(t, led, min_level=12)).collect()
    assert sum(a.alert_status == "active" for a in alerts) <= 5


def test_ledger_consistency_holds(spark):
    rng = random.Random(9)
    rows = _ops(rng, 300, 4)
    t, ops = _tables(spark, rows)
    mv = L.movements_from_ledger(L.stock_ledger(t, ops=ops))
    assert {r.check: r.violations for r in L.ledger_consistency(mv, chunk_width=16).collect()} == {
        "before_plus_change": 0, "after_equals_next_before": 0}


def _write_events(path, rows):
    pd.DataFrame(rows, columns=["event_id", "ts", "user_id", "event_type", "value", "props"]).to_parquet(path, coerce_timestamps="us")


def test_stream_equals_batch_and_flags_late_rows(spark):
    d = tempfile.mkdtemp(prefix="tillbook-stream-", dir="/tmp")
    ev = {"in": "signup", "out": "click", "adjustment": "error", "sale": "purchase", "return": "view"}
    rng = random.Random(4)
    rows = _ops(rng, 200, 4, hot=True)
    evrows = [(s, at, pid, ev[op], float(n - 1), "{}") for s, pid, _v, op, n, _b, at in rows]
    _write_events(os.path.join(d, "events-0.parquet"), evrows[:100])
    time.sleep(1.1)
    late = (evrows[10][0] - 1, evrows[10][1], evrows[10][2], "signup", 4.0, "{}")  # older seq, second file
    _write_events(os.path.join(d, "events-1.parquet"), evrows[100:] + [late])
    prod = spark.createDataFrame([(i, f"S{i}", "p", 1, 12, T0) for i in range(4)],
                                 "id long, sku string, name string, is_active int, min_stock_level int, created_at timestamp_ntz")
    t = RetailTables.from_frames(spark, products=prod)
    log = RetailTables(spark)
    log.sf_dir = d
    stream = LS.ledger_stream(t, LS.stock_ops_stream(log, max_files_per_trigger=1))
    out = LS.run_to_table(stream, "test").collect()
    flagged = [r for r in out if r.late == 1]
    assert [r.seq for r in flagged] == [late[0]]
    want = _py_fold([(s, p, None, op, n, b, a) for s, p, _v, op, n, b, a in rows], {})
    for r in out:
        if r.late == 0:
            assert (r.q_before, r.q_after, r.accepted) == want[r.seq]


def test_folds_from_an_opening_with_small_chunks(spark):
    rng = random.Random(21)
    rows = _ops(rng, 900, 5)
    t, ops = _tables(spark, rows)
    opening = {(pid, None): rng.randrange(0, 60) for pid in range(5)}
    op_df = spark.createDataFrame([(p, v, q) for (p, v), q in opening.items()],
                                  "product_id long, variant_id long, quantity int")
    want = _py_fold(rows, opening)
    got = L.stock_ledger(t, ops=ops, opening=op_df, chunk_width=16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.q_before, r.q_after, r.accepted) == want[r.seq], r.seq


def test_number_lines_equals_row_number_with_a_hot_key(spark):
    from tillbook.plans.scans import number_lines
    rng = random.Random(13)
    rows = [(0 if rng.random() < 0.4 else rng.randrange(1, 8), rng.randrange(0, 300), i) for i in range(600)]
    df = spark.createDataFrame(rows, "sale long, product long, uid long")
    got = {r.uid: r.line_no for r in number_lines(df, "sale", ["product", "uid"], chunk_width=16).collect()}
    w = Window.partitionBy("sale").orderBy("product", "uid")
    want = {r.uid: r.rn for r in df.select("uid", F.row_number().over(w).alias("rn")).collect()}
    assert got == want


def test_a_hot_product_with_many_sales(spark):
    """200,000 sales of one product, between restocks, at default settings."""
    n = 200_000
    ops = spark.range(n).select(F.col("id").alias("seq"), F.lit(1).cast("bigint").alias("product_id"), F.lit(None).cast("bigint").alias("variant_id"),
                                F.when(F.col("id") % 10 == 0, "in").otherwise("sale").alias("op"),
                                F.when(F.col("id") % 10 == 0, 30).otherwise(F.pmod(F.xxhash64("id"), F.lit(9)) + 1).cast("int").alias("n"),
                                F.lit(1).cast("bigint").alias("created_by"), F.lit(T0).alias("created_at"))
    t = RetailTables.from_frames(spark, stock_ops=ops)
    got = L.stock_ledger(t).select("seq", "op", "n", "q_before", "q_after", "accepted").orderBy("seq").toPandas()
    q, want = 0, []
    for op, k in zip(got["op"], got["n"]):
        q = q + k if op == "in" else q - k if q >= k else q
        want.append(q)
    assert len(got) == n and got["q_after"].tolist() == want and 0 < got["accepted"].sum() < n


@pytest.mark.parametrize("seed,adjustments", [(1, True), (2, False), (3, False)])
def test_hot_keys_are_folded_in_chunks(spark, monkeypatch, seed, adjustments):
    """A key with 40 % of all ops, cut into chunks over tasks, equals the fold row by row."""
    import random
    from tillbook.operators import ledger as L
    r = random.Random(seed)
    kinds = ["in", "out", "sale", "sale", "return", "sale"] + ["adjustment"] * (adjustments and r.random() < 2)
    rows = [(i, 1 if r.random() < .4 else r.randrange(2, 12), None if i % 3 else 7, r.choice(kinds) if i % 9 else "in", r.randrange(0, 30), 1, None)
            for i in range(900)]
    ops = spark.createDataFrame(rows, "seq long, product_id long, variant_id long, op string, n int, created_by long, created_at timestamp_ntz")
    stock = spark.createDataFrame([(1, None, 50), (1, 7, 9), (2, None, 4)], "product_id long, variant_id long, quantity int")
    t = RetailTables.from_frames(spark)
    args = dict(ops=ops, opening=stock, chunk_width=40, has_adjustments=adjustments)
    plain = sorted(map(tuple, L.stock_ledger(t, **args).collect()))
    monkeypatch.setattr(L, "HOT_OPS", 60)
    assert sorted(map(tuple, L.stock_ledger(t, **args).collect())) == plain and len(plain) == 900


def test_keys_of_few_ops_are_not_cut_at_adjustments(spark, monkeypatch):
    """The ops of a key that is not hot go through one shuffle and one fold, adjustments among them."""
    monkeypatch.setattr(L, "_segments", lambda *a: pytest.fail("cut at adjustments"))
    rows = _ops(random.Random(5), 300, 6)
    names = "seq long, product_id long, variant_id long, op string, n int, created_by long, created_at timestamp_ntz"
    t = RetailTables.from_frames(spark)
    opening = {(p, None): 7 for p in range(3)}
    stock = spark.createDataFrame([(p, None, 7) for p in range(3)], "product_id long, variant_id long, quantity int")
    got = {r.seq: (r.q_before, r.q_after, r.accepted) for r in L.stock_ledger(t, spark.createDataFrame(rows, names), stock).collect()}
    assert got == _py_fold(rows, opening)


def test_alert_table_kept_by_a_stream(spark, tmp_path):
    """Batches merged one by one equal the batch job; a batch that comes again changes nothing; late rows come out."""
    rows = _ops(random.Random(6), 240, 6)
    names = "seq long, product_id long, variant_id long, op string, n int, created_by long, created_at timestamp_ntz"
    t = RetailTables.from_frames(spark)
    for i in range(3):
        spark.createDataFrame(rows[i * 80:(i + 1) * 80], names).coalesce(1).write.mode("append").parquet(str(tmp_path / "ops"))
        time.sleep(1.1)  # files are taken by their time
    ops = spark.readStream.schema(RETAIL_SCHEMAS["stock_ops"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "ops"))
    table = LS.AlertTable(t, str(tmp_path / "alerts"))
    merge, seen = table.merge, []
    table.merge = lambda df, b: (seen.append((df.collect(), b)), merge(df, b))[1]
    table.follow(LS.ledger_stream(t, ops, min_level=20))
    batch = L.alerts_table(L.low_stock_alert_events(t, L.stock_ledger(t, ops=spark.createDataFrame(rows, names)), min_level=20))
    expected = sorted(map(repr, batch.collect()))
    assert sorted(map(repr, table.read().collect())) == expected and len(seen) >= 3 and len(expected) > 5
    last, number = [x for x in seen if x[0]][-1]
    if number == seen[-1][1]:
        merge(spark.createDataFrame(last, LS.OUT_SCHEMA), number)
        assert sorted(map(repr, table.read().collect())) == expected
    late = spark.createDataFrame([Row(**{**last[0].asDict(), "late": 1})], LS.OUT_SCHEMA)
    assert [r.seq for r in LS.late_ops(late).collect()] == [last[0].seq]


def test_a_reversed_log_is_put_in_order(spark, tmp_path):
    """Files in reversed order equal the batch fold; rows later than the delay come out as late, without effect."""
    rows = [(*r[:-1], T0 + dt.timedelta(seconds=i)) for i, r in enumerate(_ops(random.Random(8), 120, 4, hot=True))]
    names = "seq long, product_id long, variant_id long, op string, n int, created_by long, created_at timestamp_ntz"
    end = (1 << 62, -1, None, "in", 0, 0, T0 + dt.timedelta(days=1))
    straggler = (rows[3][0] - 1, rows[3][1], rows[3][2], "in", 9, 0, rows[3][-1])
    after = ((1 << 62) + 1, *end[1:])  # by its batch, the stream's time is that of the one before
    for i, part in enumerate([rows[90:], rows[60:90], rows[30:60], rows[:30], [end], [after], [straggler]]):
        spark.createDataFrame(part, names).coalesce(1).write.mode("append").parquet(str(tmp_path / "log" / str(i)))
        time.sleep(0.05)
    log = spark.readStream.schema(RETAIL_SCHEMAS["stock_ops"]).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log" / "*"))
    out = LS.run_to_table(LS.reordered_ledger_stream(RetailTables.from_frames(spark), log, 3_600_000, min_level=20), "reversed", LS.ROCKSDB)
    got = out.filter("product_id >= 0").collect()
    want = _py_fold(rows, {})
    assert {r.seq: (r.q_before, r.q_after, r.accepted) for r in got if r.late == 0} == want
    assert [r.seq for r in LS.late_ops(out).collect()] == [straggler[0]]
    t = RetailTables.from_frames(spark)
    batch = L.low_stock_alert_events(t, L.stock_ledger(t, ops=spark.createDataFrame(rows, names)), min_level=20)
    assert {(r.seq, r.event) for r in got if r.event} == {(r.seq, r.event) for r in batch.collect()}
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", None) != LS.ROCKSDB


def test_waiting_rows_are_packed():
    """A key's rows of a batch wait in few state entries, and are folded in order when due, with rows of later batches left waiting."""
    import pandas as pd
    from tillbook.functions.folds import apply_op
    from tillbook.functions.reorder import Reordering

    class State(list):
        now = None
        exists = lambda self: self.now is not None
        update = lambda self, v: setattr(self, "now", v)
        appendList = list.extend  # noqa: N815

        def put(self, rows):
            self[:] = rows

    waiting, stock, timers = State(), State(), set()
    waiting.get = lambda: iter(list(waiting))
    stock.get = lambda: stock.now

    class Handle:
        getListState = lambda self, *a: waiting  # noqa: E731, N815
        getValueState = lambda self, *a: stock  # noqa: E731, N815
        registerTimer = lambda self, at: timers.add(at)  # noqa: E731, N815
        deleteTimer = lambda self, at: timers.discard(at)  # noqa: E731, N815

    class Now:
        def __init__(self, ms):
            self.getCurrentWatermarkInMs = lambda: ms

    r = Reordering(10)
    r.init(Handle())
    n = 5000
    ops = [("in", "out", "sale", "adjustment")[i % 4] for i in range(n)]
    pdf = pd.DataFrame({"seq": range(n), "op": ops, "n": [i % 17 for i in range(n)], "opening": 3, "min_level": [None if i % 2 else 4 for i in range(n)],
                        "created_by": [None if i % 3 else 1 for i in range(n)], "created_at": pd.to_datetime([None if i % 5 == 0 else i for i in range(n)], unit="ms"),
                        "ms": range(n)})
    assert not list(r.handleInputRows((1, -1), iter([pdf.iloc[::-1]]), Now(0)))
    assert len(waiting) == 2 and timers == {10}
    out = pd.concat([pd.concat(list(r.handleExpiredTimer((1, -1), Now(2010), None))), pd.concat(list(r.handleExpiredTimer((1, -1), Now(n + 10), None)))])
    q, want = 3, []
    for i in range(n):
        q, _ = apply_op(q, ops[i], i % 17)
        want.append((i, q))
    assert list(zip(out["seq"], out["q_after"])) == want and not waiting
    assert out["variant_id"].isna().all() and out["min_level"].isna().sum() == n // 2 and out["created_at"].isna().sum() == n // 5
