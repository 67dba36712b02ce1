"""Structured Streaming twins of the ledger (L1) and the alert machine (L3).

``stock_ops`` rows arrive as a stream; per (product, variant) an
``applyInPandasWithState`` function folds each micro-batch's rows in ``seq`` order
from the stored state (quantity, alert flag, last seq) and emits ledger rows with the
alert event of each row. The fold is order-dependent: the source must deliver each
key in sequence order across micro-batches (e.g. a log partitioned by key); a row
older than the key's last folded ``seq`` is emitted with ``late = 1`` and left out of
the fold. For input in order the stream equals the batch ledger. ``reordered_ledger_stream``
takes rows out of order, within a delay.

State per key is three numbers; a micro-batch holds one key's rows of that batch
only, so memory is bounded by the trigger size (``maxFilesPerTrigger`` /
``maxOffsetsPerTrigger``), not by the key's history.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from datetime import timedelta

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tillbook.functions import folds, reorder
from tillbook.operators.ledger import KEYS, NO_VARIANT, _keyed, alerts_table
from tillbook.session import checkpoint_dir
from tillbook.sources.base import BASE_SCHEMAS
from tillbook.sources.schemas import RETAIL_SCHEMAS
from tillbook.sources.views import OP_OF_EVENT, RetailTables

cloudpickle.register_pickle_by_value(folds)
cloudpickle.register_pickle_by_value(reorder)

OUT_SCHEMA = T.StructType([
    T.StructField("seq", T.LongType()), T.StructField("product_id", T.LongType()),
    T.StructField("variant_id", T.LongType()), T.StructField("op", T.StringType()),
    T.StructField("n", T.IntegerType()), T.StructField("q_before", T.IntegerType()),
    T.StructField("q_after", T.IntegerType()), T.StructField("q_change", T.IntegerType()),
    T.StructField("accepted", T.IntegerType()), T.StructField("created_by", T.LongType()),
    T.StructField("created_at", T.TimestampNTZType()), T.StructField("min_level", T.IntegerType()),
    T.StructField("event", T.StringType()), T.StructField("late", T.IntegerType()),
])
STATE_SCHEMA = T.StructType([T.StructField("q", T.LongType()), T.StructField("active", T.IntegerType()),
                             T.StructField("last_seq", T.LongType())])


def stock_ops_stream(t: RetailTables, max_files_per_trigger: int | None = None) -> DataFrame:
    """``stock_ops`` as a stream: the bundle's stored table, or event files with the batch view's mapping.

    Set ``max_files_per_trigger`` for files that arrive in sequence order (a log): it bounds the
    rows folded at once. The stored table is ordered by product, not time, and is read in one go.
    """
    r = t.spark.readStream
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    if t._root:
        return r.schema(RETAIL_SCHEMAS["stock_ops"]).parquet(f"{t._root}/stock_ops")
    if not t.sf_dir:
        raise ValueError("no files to stream from: the bundle was made of frames")
    e = r.schema(BASE_SCHEMAS["events"]).parquet(f"{t.sf_dir}/events*.parquet")
    op = None
    for ev, o in OP_OF_EVENT.items():
        op = F.when(F.col("event_type") == ev, F.lit(o)) if op is None else op.when(F.col("event_type") == ev, F.lit(o))
    return e.select(F.col("event_id").alias("seq"), F.col("user_id").alias("product_id"),
                    F.lit(None).cast("bigint").alias("variant_id"), op.alias("op"),
                    (F.floor(F.col("value")).cast("bigint") % 50 + 1).cast("int").alias("n"),
                    (F.col("user_id") % 25).alias("created_by"), F.col("ts").alias("created_at"))


def ledger_stream(t: RetailTables, ops_stream: DataFrame, opening: DataFrame | None = None,
                  min_level: int | None = None) -> DataFrame:
    """Streaming ledger + alert events (append mode). ``opening``/``min_level`` as in the batch twins."""
    x = _prepared(t, ops_stream, opening, min_level)
    return x.groupBy("product_id", "_vk").applyInPandasWithState(
        folds.ledger_state_step, OUT_SCHEMA, STATE_SCHEMA, "append", GroupStateTimeout.NoTimeout)


def _prepared(t: RetailTables, ops_stream: DataFrame, opening: DataFrame | None, min_level: int | None) -> DataFrame:
    """The ops with their key, opening quantity and minimum level."""
    x = ops_stream.withColumn("_vk", F.coalesce(F.col("variant_id"), F.lit(-1).cast("bigint")))
    if opening is None:
        x = x.withColumn("opening", F.lit(0))
    else:
        o = opening.select("product_id", F.coalesce(F.col("variant_id"), F.lit(-1).cast("bigint")).alias("_vk"),
                           F.col("quantity").cast("int").alias("opening"))
        x = x.join(o, ["product_id", "_vk"], "left").withColumn("opening", F.coalesce("opening", F.lit(0)))
    if min_level is None:
        p = t.products.select(F.col("id").alias("product_id"), F.col("min_stock_level").alias("min_level"))
        return x.join(p, "product_id", "left")
    return x.withColumn("min_level", F.lit(int(min_level)))


#: Days by which the clock of a reordering stream is ahead of its rows, and its watermark behind that clock: the watermark is the latest
#: time seen, and Spark itself drops no row as late (it would do so without a trace).
_AHEAD_DAYS = 36500
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def reordered_ledger_stream(t: RetailTables, ops_stream: DataFrame, delay_ms: int, opening: DataFrame | None = None,
                            min_level: int | None = None) -> DataFrame:
    """``ledger_stream`` for ops that come up to ``delay_ms`` out of order (by ``created_at``; NULL: due at once).

    Each key's rows wait in state until the stream has seen a time ``delay_ms`` past theirs, and are then folded in the order of
    ``seq`` (``reorder.Reordering``); rows that come too late even for that have ``late = 1`` (``late_ops``). The latest rows stay in state
    until later ones come, of any key. A key's state holds its rows of the last ``delay_ms``. Needs the RocksDB state store (``run_to_table``).
    """
    x = _prepared(t, ops_stream, opening, min_level)
    ms = F.timestamp_diff("MILLISECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("created_at"))
    x = x.withColumn("ms", F.coalesce(ms, F.lit(0)))
    x = x.withColumn("clock", F.timestamp_millis(F.col("ms") + _AHEAD_DAYS * 86_400_000)).withWatermark("clock", f"{_AHEAD_DAYS} days")
    return x.groupBy("product_id", "_vk").transformWithStateInPandas(
        reorder.Reordering(delay_ms), OUT_SCHEMA, "append", "EventTime")


@contextmanager
def _state_store(spark: SparkSession, provider: str | None):
    """The state store of the queries started within; the session's own setting comes back after."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    if provider:
        spark.conf.set(name, provider)
    try:
        yield
    finally:
        if provider:
            spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def run_to_table(df: DataFrame, name: str, provider: str | None = None) -> DataFrame:
    """Run a streaming frame to completion (``availableNow``) into parquet under the shared
    checkpoint folder and return the written table as a batch DataFrame. ``provider``: a state store for this query only."""
    spark = df.sparkSession
    root = checkpoint_dir(spark).rstrip("/")
    run = f"{root}/streams/{name}-{uuid.uuid4().hex[:10]}"
    with _state_store(spark, provider):
        q = (df.writeStream.format("parquet").option("path", f"{run}/out").option("checkpointLocation", f"{run}/chk")
             .outputMode("append").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(OUT_SCHEMA).parquet(f"{run}/out")


class AlertTable:
    """The alert table kept up to date by a stream of ledger rows with their alert events (``ledger_stream``).

    Each micro-batch is merged into the last snapshot and written as the next one. Two folders take turns by batch number, and a
    batch counts once its number is noted, so a batch that fails, or comes again, finds its predecessor unchanged and
    writes the same result. ``root`` is a folder in shared storage.
    """

    def __init__(self, t: RetailTables, root: str):
        self.spark, self.root = t.spark, root.rstrip("/")

    def _slot(self, batch: int) -> str:
        return f"{self.root}/alerts-{batch % 2}"

    def merge(self, rows: DataFrame, batch: int) -> None:
        """``foreachBatch`` body."""
        events = rows.filter(F.col("event").isNotNull() & (F.col("late") == 0)).select(
            "seq", "product_id", "variant_id", "q_after", "min_level", "event", "created_at")
        new = alerts_table(events)
        if batch:
            # raise and resolve alternate: the first event after an active alert resolves it
            hit = events.select("product_id", F.coalesce("variant_id", F.lit(NO_VARIANT)).alias("_vk"), F.lit(1).alias("_hit")).distinct()
            old = _keyed(self.spark.read.schema(RETAIL_SCHEMAS["low_stock_alerts"]).parquet(self._slot(batch - 1))).join(
                hit, KEYS, "left").withColumn("alert_status", F.when((F.col("_hit") == 1) & (F.col("alert_status") == "active"), "resolved")
                                              .otherwise(F.col("alert_status")))
            new = old.select(*new.columns).unionByName(new)
        new.write.mode("overwrite").parquet(self._slot(batch))
        self.spark.createDataFrame([(batch,)], "batch long").write.mode("append").parquet(f"{self.root}/merged")

    def follow(self, ledger: DataFrame) -> None:
        """Merge all that the stream has by now; a later call goes on from there."""
        (ledger.writeStream.foreachBatch(self.merge).option("checkpointLocation", f"{self.root}/progress")
         .outputMode("append").trigger(availableNow=True).start().awaitTermination())

    def read(self) -> DataFrame:
        last = self.spark.read.schema("batch long").parquet(f"{self.root}/merged").agg(F.max("batch")).first()[0]
        return self.spark.read.schema(RETAIL_SCHEMAS["low_stock_alerts"]).parquet(self._slot(last))


def stream_alert_table(t: RetailTables) -> DataFrame:
    """The alert table that the stream of all stock ops leaves."""
    table = AlertTable(t, f"{checkpoint_dir(t.spark).rstrip('/')}/streams/alert-table-{uuid.uuid4().hex[:10]}")
    table.follow(ledger_stream(t, stock_ops_stream(t)))
    return table.read()


def late_ops(out: DataFrame) -> DataFrame:
    """The rows of a stream's output that came after a later op of their key had been folded: without effect, for a second look."""
    return out.filter(F.col("late") == 1).select("seq", "product_id", "variant_id", "op", "n", "created_by", "created_at")


def stream_stock_ledger(t: RetailTables) -> DataFrame:
    """The stream's ledger rows (in-order rows only), in the batch ledger's columns."""
    out = run_to_table(ledger_stream(t, stock_ops_stream(t)), "ledger")
    return out.filter(F.col("late") == 0).select("seq", "product_id", "variant_id", "op", "n", "q_before", "q_after",
                                                 "q_change", "accepted", "created_by", "created_at")


def stream_low_stock_alerts(t: RetailTables) -> DataFrame:
    """The stream's alert events (raise / resolve rows)."""
    out = run_to_table(ledger_stream(t, stock_ops_stream(t)), "alerts")
    return out.filter(F.col("event").isNotNull() & (F.col("late") == 0)).select(
        "seq", "product_id", "variant_id", "op", "q_after", "min_level", "event", "created_by", "created_at")


def swapped_log(t: RetailTables, blocks: int = 4) -> tuple[DataFrame, int]:
    """The stock ops as a log whose files come pairwise in the wrong order, one a trigger, and the delay (ms) that mends it.

    The last file holds an op of no product, later than the delay, so that all before it fall due.
    """
    root = f"{checkpoint_dir(t.spark).rstrip('/')}/streams/log-{uuid.uuid4().hex[:10]}"
    ops = t.stock_ops.select(*[F.col(f.name).cast(f.dataType) for f in RETAIL_SCHEMAS["stock_ops"].fields])
    first, last = ops.agg(F.min("created_at"), F.max("created_at")).first()
    if first is None:
        ops.limit(0).write.parquet(f"{root}/0")
        return t.spark.readStream.schema(RETAIL_SCHEMAS["stock_ops"]).parquet(f"{root}/*"), 0
    step = (last - first) / blocks
    edges = [first + i * step for i in range(blocks)] + [last + timedelta(seconds=1)]
    for i in (j ^ 1 for j in range(blocks)):  # blocks is even
        part = ops.filter((F.col("created_at") >= F.lit(edges[i])) & (F.col("created_at") < F.lit(edges[i + 1])))
        part.coalesce(1).write.parquet(f"{root}/{i}")
    delay = 2 * step + timedelta(seconds=1)
    end = [(1 << 62, -1, None, "in", 0, None, last + delay + timedelta(seconds=1))]
    t.spark.createDataFrame(end, RETAIL_SCHEMAS["stock_ops"]).coalesce(1).write.parquet(f"{root}/end")
    stream = t.spark.readStream.schema(RETAIL_SCHEMAS["stock_ops"]).option("maxFilesPerTrigger", 1).parquet(f"{root}/*")
    return stream, delay // timedelta(milliseconds=1)


def stream_reordered_ledger(t: RetailTables) -> DataFrame:
    """The ledger of all stock ops from a log that is out of order, in the batch ledger's columns."""
    log, delay = swapped_log(t)
    out = run_to_table(reordered_ledger_stream(t, log, delay), "reordered", ROCKSDB)
    return out.filter((F.col("late") == 0) & (F.col("product_id") >= 0)).select(
        "seq", "product_id", "variant_id", "op", "n", "q_before", "q_after", "q_change", "accepted", "created_by", "created_at")
