"""Canonical retail tables.

``RetailTables.from_testdata`` derives the retail tables from the supplied star schema
(the derivation rules are fixed in FIXTURES.md §B and mirrored in
``tillbook.oracle.views_sql``). ``RetailTables.from_parquet`` reads tables that were
written once by ``materialize`` — the shape a production deployment would use: the
views are built in one ETL job, written range-partitioned and sorted on their query
keys, and every query reads them with pushdown and min/max skipping.

All frames are lazy; nothing is cached implicitly.
"""

from __future__ import annotations

import copy
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.sources.base import read_base
from tillbook.sources.schemas import MONEY, PRICE, RETAIL_SCHEMAS

# Fixed values of the derivation (FIXTURES.md §B).
ROOT_OF_TYPE = {"ECONOMY": 1, "LARGE": 2, "MEDIUM": 3, "PROMO": 4, "SMALL": 5}  # otherwise 6
OP_OF_EVENT = {"signup": "in", "click": "out", "error": "adjustment", "purchase": "sale", "view": "return"}
EPOCH = "2000-01-01 00:00:00"

RETAIL_TABLES = ("users", "categories", "products", "product_variants", "stock", "sales", "sale_items",
                 "sale_lines", "stock_ops")
DERIVED_TABLES = ("stock_movements", "low_stock_alerts")  # written by the ledger job


def _ts(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")


def _plus_seconds(ts: Column, secs: Column) -> Column:
    return ts + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), secs.cast("decimal(18,6)"))


def _root_id(p_type: Column) -> Column:
    expr = None
    for name, rid in ROOT_OF_TYPE.items():
        expr = F.when(p_type == name, F.lit(rid)) if expr is None else expr.when(p_type == name, F.lit(rid))
    return expr.otherwise(F.lit(6)).cast("bigint")


def _unit_price() -> Column:
    """Unit price of a lineitem, rounded half-up to the cent in integer arithmetic (exact everywhere)."""
    cents = F.expr("(cast(cast(l_extendedprice as decimal(12,2)) * 100 as bigint) * 2"
                   " + cast(floor(l_quantity) as int)) div (2 * cast(floor(l_quantity) as int))")
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(2,2)")).cast(MONEY)


def _brand_no(p_brand: Column) -> Column:
    return F.substring(p_brand, 7, 1 << 20).cast("int")


class RetailTables:
    """Bundle of lazy retail DataFrames.

    ``base`` maps base-table names to DataFrames (testdata mode); ``tables`` maps retail
    table names to DataFrames (materialized mode). Operators only touch the properties.
    """

    def __init__(self, spark: SparkSession, base: dict[str, DataFrame] | None = None,
                 tables: dict[str, DataFrame] | None = None):
        self.spark = spark
        self._base = base or {}
        self._tables = tables or {}
        self.sf_dir: str | None = None
        self._root: str | None = None

    # ------------------------------------------------------------------ constructors
    @classmethod
    def from_testdata(cls, spark: SparkSession, sf_dir: str) -> "RetailTables":
        names = ("region", "nation", "customer", "part", "orders", "lineitem", "events")
        t = cls(spark, base={n: read_base(spark, sf_dir, n) for n in names})
        t.sf_dir = sf_dir.rstrip("/")
        return t

    @classmethod
    def from_parquet(cls, spark: SparkSession, root: str) -> "RetailTables":
        """Tables written by ``materialize``; each is read (and its files listed) on first use."""
        t = cls(spark)
        t._root = root.rstrip("/")
        return t

    @classmethod
    def from_frames(cls, spark: SparkSession, **frames: DataFrame) -> "RetailTables":
        """Hand-made tables (tests, fixtures); missing tables raise on access."""
        return cls(spark, tables=dict(frames))

    def materialize(self, root: str, names: tuple[str, ...] = RETAIL_TABLES + DERIVED_TABLES) -> "RetailTables":
        """Write each table once as parquet and return a bundle that reads them back.

        Fact tables are laid out for the queries: ``sales`` range-partitioned and sorted by
        ``created_at`` (each file covers a disjoint time range, so period predicates skip
        files and row groups by their min/max statistics, with no small-file explosion of
        per-day directories), ``sale_items`` and ``stock_ops`` range-partitioned on (key, sequence),
        so they are clustered by their join key while a hot key still spreads over several files.
        """
        root = root.rstrip("/")
        for n in names:
            df = getattr(self, n)
            w = None
            if n == "sales":
                w = df.repartitionByRange("created_at").sortWithinPartitions("created_at", "id").write
            elif n == "sale_items":
                # range on (sale, product): clustered by sale, yet one huge sale spans several files
                w = df.repartitionByRange("sale_id", "product_id").sortWithinPartitions("sale_id", "product_id").write
            elif n == "sale_lines":
                w = df.repartitionByRange("sale_id", "line_no").sortWithinPartitions("sale_id", "line_no").write
            elif n == "stock_ops":
                # range on (product, seq): a product holding a third of the ops is split across files
                w = df.repartitionByRange("product_id", "seq").sortWithinPartitions("product_id", "seq").write
            elif n in DERIVED_TABLES:
                w = df.repartitionByRange("created_at").sortWithinPartitions("created_at", "id").write
            else:
                w = df.write
            w.mode("overwrite").parquet(f"{root}/{n}")
        return RetailTables.from_parquet(self.spark, root)

    def replaced(self, **frames: DataFrame) -> "RetailTables":
        """The same bundle with some tables in place of its own (e.g. the rows an index found)."""
        other = copy.copy(self)
        other.__dict__.update(frames)
        return other

    def supplied(self, name: str) -> bool:
        """Whether the bundle has table ``name``; only one of hand-made frames may lack it."""
        return bool(self._base or self._root) or name in self._tables or name in self.__dict__

    def base(self, name: str) -> DataFrame:
        return self._base[name]

    def _get(self, name: str, build) -> DataFrame:
        if name not in self._tables and getattr(self, "_root", None):
            self._tables[name] = self.spark.read.schema(RETAIL_SCHEMAS[name]).parquet(f"{self._root}/{name}")
        if name in self._tables:
            df = self._tables[name]
            cols = [f.name for f in RETAIL_SCHEMAS[name].fields] if name in RETAIL_SCHEMAS else df.columns
            return df.select(*[c for c in cols if c in df.columns])
        if not self._base:
            raise KeyError(f"table {name!r} not supplied")
        return build()

    # ------------------------------------------------------------------ retail tables
    @cached_property
    def categories(self) -> DataFrame:
        def build():
            part = self.base("part").select("p_type", "p_brand")
            root = _root_id(F.col("p_type"))
            bno = _brand_no(F.col("p_brand"))
            roots = part.select(root.alias("id"), F.col("p_type").alias("name"),
                                F.lit(None).cast("bigint").alias("parent_id"), F.lit(1).alias("is_active"))
            kids = part.select((root * 100 + bno).alias("id"), F.col("p_brand").alias("name"),
                               root.alias("parent_id"),
                               F.when(bno % 13 == 0, F.lit(0)).otherwise(F.lit(1)).alias("is_active"))
            both = roots.unionByName(kids).distinct()
            return both.select("id", "name", F.lit(None).cast("string").alias("description"), "parent_id",
                               "is_active", _ts(EPOCH).alias("created_at"), _ts(EPOCH).alias("updated_at"))
        return self._get("categories", build)

    @cached_property
    def products(self) -> DataFrame:
        def build():
            p = self.base("part")
            k = F.col("p_partkey")
            root = _root_id(F.col("p_type"))
            price = F.col("p_retailprice").cast(PRICE)
            created = _plus_seconds(_ts(EPOCH), (k % 86400))
            return p.select(
                k.alias("id"),
                F.format_string("SKU%06d", k).alias("sku"),
                F.when(k % 11 == 0, F.lit(None).cast("string"))
                 .otherwise((F.lit(10 ** 12).cast("bigint") + k).cast("string")).alias("barcode"),
                F.col("p_name").alias("name"),
                F.lit(None).cast("string").alias("description"),
                F.when(k % 37 == 0, F.lit(None).cast("bigint")).when(k % 10 == 0, root)
                 .otherwise(root * 100 + _brand_no(F.col("p_brand"))).alias("category_id"),
                F.col("p_brand").alias("brand"),
                F.lit("pcs").alias("unit_size"),
                price.alias("price"),
                F.when(k % 23 == 0, F.lit(None).cast(PRICE)).otherwise((price * F.lit(0.6).cast("decimal(2,1)"))
                                                                        .cast(PRICE)).alias("cost"),
                F.col("p_size").alias("min_stock_level"),
                F.lit(None).cast("string").alias("image_url"),
                F.when(k % 17 == 0, F.lit(0)).otherwise(F.lit(1)).alias("is_active"),
                created.alias("created_at"),
                created.alias("updated_at"),
            )
        return self._get("products", build)

    @cached_property
    def product_variants(self) -> DataFrame:
        def build():
            k = F.col("p_partkey")
            p = self.base("part").select(k).filter(k % 4 == 0)
            rows = F.array(
                F.struct((k * 10 + 1).alias("id"), F.lit("S").alias("v"), F.lit("0.00").cast(PRICE).alias("adj")),
                F.struct((k * 10 + 2).alias("id"), F.lit("L").alias("v"), F.lit("1.50").cast(PRICE).alias("adj")),
            )
            x = p.select(k.alias("product_id"), F.inline(rows))
            return x.select("id", "product_id", F.lit("size").alias("variant_name"), F.col("v").alias("variant_value"),
                            F.concat(F.lit("-"), F.col("v")).alias("sku_suffix"),
                            F.col("adj").alias("price_adjustment"), F.lit(1).alias("is_active"),
                            _ts(EPOCH).alias("created_at"))
        return self._get("product_variants", build)

    @cached_property
    def stock(self) -> DataFrame:
        def build():
            k = F.col("p_partkey")
            nul = F.lit(None).cast("bigint")
            base_q = ((k * 7919) % 120).cast("int")
            rows = F.array(
                F.when(k % 29 != 0, F.struct((k * 10).alias("id"), nul.alias("variant_id"), base_q.alias("q"))),
                F.when(k % 4 == 0, F.struct((k * 10 + 1).alias("id"), (k * 10 + 1).alias("variant_id"),
                                            ((k * 31) % 40).cast("int").alias("q"))),
                F.when(k % 4 == 0, F.struct((k * 10 + 2).alias("id"), (k * 10 + 2).alias("variant_id"),
                                            ((k * 17) % 40).cast("int").alias("q"))),
            )
            x = (self.base("part").select(k.alias("product_id"), F.explode(rows).alias("r"))
                 .filter(F.col("r").isNotNull()))
            return x.select(F.col("r.id").alias("id"), "product_id", F.col("r.variant_id").alias("variant_id"),
                            F.col("r.q").alias("quantity"), (F.col("r.q") % 5).alias("reserved_quantity"),
                            _ts(EPOCH).alias("last_updated"), F.lit(None).cast("bigint").alias("updated_by"))
        return self._get("stock", build)

    @cached_property
    def users(self) -> DataFrame:
        def build():
            n = self.base("nation")
            r = self.base("region")
            j = n.join(r, n.n_regionkey == r.r_regionkey, "inner")
            k = F.col("n_nationkey").cast("bigint")
            uname = F.lower(F.regexp_replace(F.col("n_name"), " ", "_"))
            created = _plus_seconds(_ts(EPOCH), k * 86400)
            return j.select(k.alias("id"), uname.alias("username"),
                            F.concat(uname, F.lit("@example.com")).alias("email"),
                            F.when(k % 5 == 0, F.lit("admin")).otherwise(F.lit("cashier")).alias("role"),
                            F.col("n_name").alias("first_name"), F.col("r_name").alias("last_name"),
                            F.when(k % 7 == 6, F.lit(0)).otherwise(F.lit(1)).alias("is_active"),
                            created.alias("created_at"), created.alias("updated_at"))
        return self._get("users", build)

    @cached_property
    def sales(self) -> DataFrame:
        def build():
            o = self.base("orders")
            c = self.base("customer").select("c_custkey", "c_name", "c_nationkey")
            j = o.join(c, o.o_custkey == c.c_custkey, "left")
            k = F.col("o_orderkey")
            zero = F.lit("0.00").cast(MONEY)
            status = (F.when(F.col("o_orderstatus") == "P",
                             F.when(k % 2 == 0, F.lit("pending")).otherwise(F.lit("cancelled")))
                      .when(k % 10 == 0, F.lit("refunded")).otherwise(F.lit("completed")))
            return j.select(
                k.alias("id"),
                F.format_string("SALE-%08d", k).alias("sale_number"),
                F.col("o_totalprice").cast(MONEY).alias("total_amount"),
                zero.alias("tax_amount"), zero.alias("discount_amount"),
                F.substring("o_orderpriority", 3, 1 << 20).alias("payment_method"),
                status.alias("status"),
                F.when(k % 50 == 0, F.lit(None).cast("bigint")).otherwise(F.col("c_nationkey").cast("bigint"))
                 .alias("cashier_id"),
                F.col("c_name").alias("customer_name"),
                F.lit(None).cast("string").alias("notes"),
                _plus_seconds(F.col("o_orderdate"), (k * 37) % 86400).alias("created_at"),
            )
        return self._get("sales", build)

    @cached_property
    def sale_items(self) -> DataFrame:
        def build():
            li = self.base("lineitem")
            qty = F.floor(F.col("l_quantity")).cast("int")
            return li.select(
                F.col("l_orderkey").alias("sale_id"), F.col("l_partkey").alias("product_id"),
                F.lit(None).cast("bigint").alias("variant_id"), qty.alias("quantity"),
                _unit_price().alias("unit_price"),
                F.col("l_extendedprice").cast(MONEY).alias("total_price"),
                F.lit("0.00").cast(MONEY).alias("discount_amount"),
                F.col("l_shipdate").alias("created_at"),
            )
        return self._get("sale_items", build)

    @cached_property
    def sale_lines(self) -> DataFrame:
        """``sale_items`` numbered 1, 2, ... within each sale, with the return flag: computed once when written."""
        return self._get("sale_lines", lambda: self._numbered(self.base("lineitem")))

    def sale_lines_of(self, sales: DataFrame) -> DataFrame:
        """The ``sale_lines`` of ``sales`` (sale_id); where the table is not written, only their lines are numbered."""
        if not self._base:
            return self.sale_lines.join(sales, "sale_id", "left_semi")
        from tillbook.session import checkpoint_dir
        checkpoint_dir(self.spark)
        li = self.base("lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate")
        return self._numbered(li.join(sales.hint("shuffle_hash"), li.l_orderkey == sales.sale_id, "left_semi").checkpoint(eager=True))

    @staticmethod
    def _numbered(li: DataFrame) -> DataFrame:
        from tillbook.plans.scans import number_lines
        li = number_lines(li.withColumn("_ln", F.col("l_linenumber").cast("bigint")), "l_orderkey",
                          ["_ln", "l_partkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_shipdate"])
        return li.select(
            F.col("l_orderkey").alias("sale_id"), "line_no",
            F.col("l_partkey").alias("product_id"), F.lit(None).cast("bigint").alias("variant_id"),
            F.floor("l_quantity").cast("int").alias("quantity"), _unit_price().alias("unit_price"),
            F.col("l_extendedprice").cast(MONEY).alias("total_price"),
            F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned"), F.col("l_shipdate").alias("created_at"))

    @cached_property
    def stock_ops(self) -> DataFrame:
        def build():
            e = self.base("events")
            op = None
            for ev, o in OP_OF_EVENT.items():
                op = F.when(F.col("event_type") == ev, F.lit(o)) if op is None else op.when(
                    F.col("event_type") == ev, F.lit(o))
            return e.select(
                F.col("event_id").alias("seq"), F.col("user_id").alias("product_id"),
                F.lit(None).cast("bigint").alias("variant_id"), op.alias("op"),
                (F.floor(F.col("value")).cast("bigint") % 50 + 1).cast("int").alias("n"),
                (F.col("user_id") % 25).alias("created_by"),
                F.col("ts").alias("created_at"),
            )
        return self._get("stock_ops", build)

    # ------------------------------------------------------------------ derived by jobs
    def _stored(self, name: str) -> DataFrame | None:
        if name not in self._tables and self._root:
            self._tables[name] = self.spark.read.schema(RETAIL_SCHEMAS[name]).parquet(f"{self._root}/{name}")
        return self._tables.get(name)

    @cached_property
    def ledger(self) -> DataFrame:
        """The ledger job's output over ``stock_ops`` (opening 0), checkpointed once per bundle.

        Downstream jobs (movements, alerts, consistency) scan it several times; the
        checkpoint in the session's ``spark.checkpoint.dir`` runs the fold once and cuts the
        lineage, as writing the ledger table would.
        """
        from tillbook.operators.ledger import stock_ledger
        from tillbook.session import checkpoint_dir
        checkpoint_dir(self.spark)
        return stock_ledger(self).checkpoint(eager=True)

    @cached_property
    def stock_movements(self) -> DataFrame:
        """Ledger rows of ``stock_ops`` (opening quantity 0), in the reference's movement shape."""
        if self._stored("stock_movements") is not None:
            return self._tables["stock_movements"]
        from tillbook.operators.ledger import movements_from_ledger
        return movements_from_ledger(self.ledger)

    @cached_property
    def low_stock_alerts(self) -> DataFrame:
        """Alerts raised and resolved along the ledger, minimum from the product."""
        if self._stored("low_stock_alerts") is not None:
            return self._tables["low_stock_alerts"]
        from tillbook.operators.ledger import alerts_table, low_stock_alert_events
        from tillbook.session import checkpoint_dir
        checkpoint_dir(self.spark)
        return alerts_table(low_stock_alert_events(self, self.ledger).checkpoint(eager=True))  # read twice
