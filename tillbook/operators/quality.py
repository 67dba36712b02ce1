"""Data-quality operators over the retail tables (Q1–Q5).

The reference's DDL declares CHECK lists, NOT NULL columns, foreign keys with delete
rules, and unique keys; SQLite enforces only some of them. These jobs report the
violations of a whole table set: each check is one aggregate or one anti join, and
the per-check counts are unioned into a long (check, violations) frame.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillbook.session import checkpoint_dir
from tillbook.sources.schemas import ALERT_STATUSES, MOVEMENT_TYPES, ROLES, SALE_STATUSES
from tillbook.sources.views import RetailTables

ENUMS = (("users", "role", ROLES), ("stock_movements", "movement_type", MOVEMENT_TYPES),
         ("sales", "status", SALE_STATUSES), ("low_stock_alerts", "alert_status", ALERT_STATUSES))

NOT_NULL = {
    "users": ("username", "email", "role", "first_name", "last_name"),
    "categories": ("name",),
    "products": ("sku", "name", "price"),
    "product_variants": ("product_id", "variant_name", "variant_value"),
    "stock": ("product_id", "quantity"),
    "stock_movements": ("product_id", "movement_type", "quantity_change", "quantity_before", "quantity_after"),
    "sales": ("sale_number", "total_amount"),
    "sale_items": ("sale_id", "product_id", "quantity", "unit_price", "total_price"),
    "low_stock_alerts": ("product_id", "current_stock", "min_stock_level"),
}

# (child table, column, parent table, delete rule) — the schema's foreign keys.
FOREIGN_KEYS = (
    ("categories", "parent_id", "categories", "SET NULL"),
    ("products", "category_id", "categories", "SET NULL"),
    ("product_variants", "product_id", "products", "CASCADE"),
    ("stock", "product_id", "products", "CASCADE"),
    ("stock", "variant_id", "product_variants", "CASCADE"),
    ("stock", "updated_by", "users", "NO ACTION"),
    ("stock_movements", "product_id", "products", "CASCADE"),
    ("stock_movements", "variant_id", "product_variants", "CASCADE"),
    ("stock_movements", "created_by", "users", "NO ACTION"),
    ("sales", "cashier_id", "users", "NO ACTION"),
    ("sale_items", "sale_id", "sales", "CASCADE"),
    ("sale_items", "product_id", "products", "NO ACTION"),
    ("sale_items", "variant_id", "product_variants", "NO ACTION"),
    ("low_stock_alerts", "product_id", "products", "CASCADE"),
    ("low_stock_alerts", "variant_id", "product_variants", "CASCADE"),
    ("low_stock_alerts", "acknowledged_by", "users", "NO ACTION"),
)

UNIQUE_KEYS = (("users", ("username",)), ("users", ("email",)), ("products", ("sku",)), ("sales", ("sale_number",)),
               ("stock", ("product_id", "variant_id")))


def _table(t: RetailTables, name: str) -> DataFrame:
    return getattr(t, name)


def enum_violations(t: RetailTables) -> DataFrame:
    """Q1: per (table, column, rule): rows outside the CHECK list or NULL in a NOT NULL column.

    One aggregate per table covers all of its rules.
    """
    parts = []
    for table in NOT_NULL:
        checks = [(c, "not_null", F.col(c).isNull()) for c in NOT_NULL[table]]
        checks += [(c, "in_set", F.col(c).isNotNull() & ~F.col(c).isin(*vals)) for tb, c, vals in ENUMS if tb == table]
        a = _table(t, table).agg(*[F.count(F.when(bad, 1)).alias(f"{c}__{rule}") for c, rule, bad in checks])
        stack = ", ".join(f"'{c}', '{rule}', `{c}__{rule}`" for c, rule, _ in checks)
        parts.append(a.selectExpr(f"'{table}' AS table_name",
                                  f"stack({len(checks)}, {stack}) AS (column_name, rule, violations)"))
    return reduce(DataFrame.unionByName, parts)


def fk_violations(t: RetailTables) -> DataFrame:
    """Q2: per foreign key: child rows whose non-NULL key has no parent row (left anti join)."""
    parts = []
    for child, col, parent, _rule in FOREIGN_KEYS:
        c = _table(t, child).select(F.col(col).alias("_k")).filter(F.col("_k").isNotNull())
        p = _table(t, parent).select(F.col("id").alias("_k"))
        n = c.join(p, "_k", "left_anti").agg(F.count(F.lit(1)).alias("violations"))
        parts.append(n.select(F.lit(child).alias("table_name"), F.lit(col).alias("column_name"),
                              F.lit(parent).alias("parent_table"), "violations"))
    return reduce(DataFrame.unionByName, parts)


def unique_violations(t: RetailTables) -> DataFrame:
    """Q3: per unique key: duplicated key values and rows involved (NULL variant compared as equal)."""
    parts = []
    for table, cols in UNIQUE_KEYS:
        keys = [F.coalesce(F.col(c).cast("string"), F.lit("\u0000NULL")).alias(f"_k{i}") for i, c in enumerate(cols)]
        g = _table(t, table).select(*keys).groupBy(*[f"_k{i}" for i in range(len(cols))]).agg(
            F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > 1)
        a = g.agg(F.count(F.lit(1)).alias("duplicate_keys"), F.coalesce(F.sum("_n"), F.lit(0)).cast("bigint")
                  .alias("duplicate_rows"))
        parts.append(a.select(F.lit(table).alias("table_name"), F.lit(",".join(cols)).alias("key_columns"),
                              "duplicate_keys", "duplicate_rows"))
    return reduce(DataFrame.unionByName, parts)


def fk_delete_effects(t: RetailTables, deleted: dict[str, DataFrame]) -> DataFrame:
    """Q4: rows a physical delete of ``deleted[table]`` ids would touch, per foreign key and rule.

    CASCADE rows are deleted, SET NULL rows keep the row with the key cleared, NO ACTION
    rows would block the delete. Direct effects only (one level of references).
    """
    parts = []
    for child, col, parent, rule in FOREIGN_KEYS:
        if parent not in deleted:
            continue
        ids = deleted[parent].select(F.col("id").alias("_k")).distinct()
        n = (_table(t, child).select(F.col(col).alias("_k")).join(ids, "_k", "left_semi")
             .agg(F.count(F.lit(1)).alias("affected_rows")))
        parts.append(n.select(F.lit(child).alias("table_name"), F.lit(col).alias("column_name"),
                              F.lit(parent).alias("parent_table"), F.lit(rule).alias("rule"), "affected_rows"))
    return reduce(DataFrame.unionByName, parts)


#: Tables whose rows others refer to; rows of the rest only go with them.
PARENTS = tuple(dict.fromkeys(parent for _c, _k, parent, _r in FOREIGN_KEYS))


class DeleteClosure:
    """Q4: physical deletes with all that follows from them.

    ``requested``: ids by table. They are deleted together: rows that refer to a deleted one by a CASCADE key go too, and so
    on (semi-naive: each round starts from the rows of the last one); SET NULL keys are cleared; a row that stays and refers to a deleted
    one by a NO ACTION key blocks all requested rows from which that one follows. What a refused row would have taken along stays,
    and may block others, so this is repeated until nothing more is refused: the largest part of the request that can go.
    """

    def __init__(self, t: RetailTables, requested: dict[str, DataFrame]):
        checkpoint_dir(t.spark)
        self.t = t
        asked = [_table(t, name).select("id").join(ids.select("id").distinct(), "id", "left_semi").select(
            F.lit(name).alias("table_name"), "id", F.lit(name).alias("origin_table"), F.col("id").alias("origin_id"))
            for name, ids in requested.items()]
        self.asked = reduce(DataFrame.unionByName, asked).checkpoint(eager=True)
        self.rows = self._grown(self.asked)
        while True:
            blocked = self._blocked().checkpoint(eager=True)
            if blocked.isEmpty():
                break
            self.rows = self.rows.join(blocked, ["origin_table", "origin_id"], "left_anti").select(*self.rows.columns).checkpoint(eager=True)

    def _grown(self, rows: DataFrame) -> DataFrame:
        new = rows
        while True:
            more = [new.filter(F.col("table_name") == parent).select(F.col("id").alias(col), "origin_table", "origin_id")
                    .join(_table(self.t, child).select(col, "id"), col).select(F.lit(child).alias("table_name"), "id", "origin_table", "origin_id")
                    for child, col, parent, rule in FOREIGN_KEYS if rule == "CASCADE" and child in PARENTS]
            new = reduce(DataFrame.unionByName, more).distinct().join(rows, rows.columns, "left_anti").checkpoint(eager=True)
            if new.isEmpty():
                return rows
            rows = rows.unionByName(new)

    def ids(self, table: str, name: str) -> DataFrame:
        """Ids of the deleted rows of a table, as column ``name``."""
        return self.rows.filter(F.col("table_name") == table).select(F.col("id").alias(name)).distinct()

    def _staying(self, table: str) -> DataFrame:
        x = _table(self.t, table)
        if table in PARENTS:
            x = x.join(self.ids(table, "id"), "id", "left_anti").select(*x.columns)
        for child, col, parent, rule in FOREIGN_KEYS:
            if child == table and rule == "CASCADE":
                x = x.join(self.ids(parent, col), col, "left_anti").select(*x.columns)
        return x

    def _blocked(self) -> DataFrame:
        parts = []
        for child, col, parent, rule in FOREIGN_KEYS:
            if rule == "NO ACTION":
                held = self._staying(child).select(F.col(col).alias("id")).filter("id is not null").distinct()
                parts.append(self.rows.filter(F.col("table_name") == parent).join(held, "id", "left_semi").select("origin_table", "origin_id"))
        return reduce(DataFrame.unionByName, parts).distinct()

    def outcomes(self) -> DataFrame:
        """(table_name, id, ok) for the requested rows that exist."""
        gone = self.rows.select("origin_table", "origin_id").distinct().withColumn("_gone", F.lit(1))
        x = self.asked.join(gone, ["origin_table", "origin_id"], "left")
        return x.select("table_name", "id", F.coalesce("_gone", F.lit(0)).alias("ok"))

    def after(self, table: str) -> DataFrame:
        """The table after the deletes: the rows that stay, with cleared keys."""
        x = self._staying(table)
        for child, col, parent, rule in FOREIGN_KEYS:
            if child == table and rule == "SET NULL":
                x = x.join(self.ids(parent, "_gone"), F.col(col) == F.col("_gone"), "left")
                x = x.withColumn(col, F.when(F.col("_gone").isNull(), F.col(col))).drop("_gone")
        return x

    def sizes(self) -> DataFrame:
        """(table_name, rows_left, rows_deleted) of every table."""
        def one(name: str) -> DataFrame:
            n = self.after(name).agg(F.count(F.lit(1)).alias("rows_left"))
            all_rows = _table(self.t, name).agg(F.count(F.lit(1)).alias("_all"))
            both = n.withColumn("k", F.lit(1)).join(all_rows.withColumn("k", F.lit(1)), "k")
            return both.select(F.lit(name).alias("table_name"), "rows_left", (F.col("_all") - F.col("rows_left")).alias("rows_deleted"))
        return reduce(DataFrame.unionByName, map(one, dict.fromkeys([*PARENTS, *(c for c, *_ in FOREIGN_KEYS)])))


# The reference's seed rows (initial admin and cashier, category tree, five products).
SEED_USERS = (("admin", "admin@retailstore.com", "admin", "System", "Administrator"),
              ("cashier", "cashier@retailstore.com", "cashier", "John", "Cashier"))
SEED_CATEGORIES = (("Beverages", "All types of drinks", None), ("Snacks", "Chips, crackers, and snack foods", None),
                   ("Dairy", "Milk, cheese, yogurt products", None),
                   ("Household", "Cleaning supplies and household items", None),
                   ("Personal Care", "Health and beauty products", None),
                   ("Bottled Water", None, "Beverages"), ("Soft Drinks", None, "Beverages"),
                   ("Potato Chips", None, "Snacks"), ("Cookies", None, "Snacks"))
SEED_PRODUCTS = (("BEV001", "1234567890123", "Premium Bottled Water 500ml", "Bottled Water", "AquaPure", "1.50", "0.75", 50, 100),
                 ("BEV002", "1234567890124", "Cola Classic 330ml", "Soft Drinks", "RefreshCo", "2.25", "1.20", 30, 75),
                 ("SNK001", "1234567890125", "Original Potato Chips 150g", "Potato Chips", "CrunchyBite", "3.99", "2.10", 20, 45),
                 ("SNK002", "1234567890126", "Chocolate Chip Cookies 200g", "Cookies", "SweetTreats", "4.50", "2.25", 15, 8),
                 ("DAI001", "1234567890127", "Fresh Milk 1L", "Dairy", "FarmFresh", "3.25", "1.80", 25, 35))


def seed_plan(t: RetailTables) -> DataFrame:
    """Q5: insert-if-absent of the seed into the current tables, with names resolved to ids.

    Users are skipped when the username or e-mail exists; categories when an active or
    inactive row has the same name under the same parent; products when the SKU exists.
    New rows get ids after the table's current maximum. Category names resolve to the
    lowest id with that name (existing first, then the new rows). One row per seed row:
    table, natural key, action (insert / exists), id, resolved parent or category id.
    """
    spark = t.spark
    cats = t.categories
    cat_max = cats.select(F.coalesce(F.max("id"), F.lit(0))).scalar()  # scalar subqueries, no cross join
    name_ids = cats.groupBy("name").agg(F.min("id").alias("_id"))

    roots = spark.createDataFrame([(i, n, d) for i, (n, d, p) in enumerate(SEED_CATEGORIES) if p is None],
                                  "ord int, name string, description string")
    kids = spark.createDataFrame([(i, n, p) for i, (n, d, p) in enumerate(SEED_CATEGORIES) if p is not None],
                                 "ord int, name string, parent_name string")
    root_exist = roots.join(cats.filter(F.col("parent_id").isNull()).select("name", F.col("id").alias("_eid")),
                            "name", "left").groupBy("ord", "name").agg(F.min("_eid").alias("_eid"))
    root_new = root_exist.withColumn("id", F.coalesce(F.col("_eid"), cat_max + 1 + F.col("ord")).cast("bigint"))
    # parent resolution: existing name first, else the root inserted by this seed
    kid_par = (kids.join(name_ids.withColumnRenamed("name", "parent_name"), "parent_name", "left")
               .join(root_new.select(F.col("name").alias("parent_name"), F.col("id").alias("_rid")), "parent_name", "left")
               .withColumn("parent_id", F.coalesce("_id", "_rid")))
    kid_par = kid_par.select("ord", "name", "parent_id")
    kid_exist = (kid_par.join(cats.select(F.col("name").alias("_cn"), F.col("parent_id").alias("_pp"),
                                          F.col("id").alias("_eid")),
                              (F.col("name") == F.col("_cn")) & (F.col("parent_id") == F.col("_pp")), "left")
                 .groupBy("ord", "name", "parent_id").agg(F.min("_eid").alias("_eid")))
    kid_new = kid_exist.withColumn("id", F.coalesce(F.col("_eid"), cat_max + 1 + F.col("ord")).cast("bigint"))
    cat_rows = (root_new.select(F.lit("categories").alias("table_name"), F.col("name").alias("natural_key"),
                                F.when(F.col("_eid").isNull(), "insert").otherwise("exists").alias("action"), "id",
                                F.lit(None).cast("bigint").alias("ref_id"))
                .unionByName(kid_new.select(F.lit("categories").alias("table_name"), F.col("name").alias("natural_key"),
                                            F.when(F.col("_eid").isNull(), "insert").otherwise("exists").alias("action"),
                                            "id", F.col("parent_id").alias("ref_id"))))
    all_names = (name_ids.select("name", F.col("_id").alias("cid"))
                 .unionByName(cat_rows.select(F.col("natural_key").alias("name"), F.col("id").alias("cid")))
                 .groupBy("name").agg(F.min("cid").alias("cid")))

    prods = spark.createDataFrame([(i, s, c) for i, (s, _b, _n, c, *_r) in enumerate(SEED_PRODUCTS)],
                                  "ord int, sku string, category string")
    p_max = t.products.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    p_exist = prods.join(t.products.select("sku", F.col("id").alias("_eid")), "sku", "left").groupBy(
        "ord", "sku", "category").agg(F.min("_eid").alias("_eid"))
    p_rows = (p_exist.join(all_names.withColumnRenamed("name", "category"), "category", "left")
              .select(F.lit("products").alias("table_name"), F.col("sku").alias("natural_key"),
                      F.when(F.col("_eid").isNull(), "insert").otherwise("exists").alias("action"),
                      F.coalesce(F.col("_eid"), p_max + 1 + F.col("ord")).cast("bigint").alias("id"),
                      F.col("cid").alias("ref_id")))

    users = spark.createDataFrame([(i, u, e) for i, (u, e, *_r) in enumerate(SEED_USERS)],
                                  "ord int, username string, email string")
    u_max = t.users.select(F.coalesce(F.max("id"), F.lit(0))).scalar()
    hit_u = users.join(t.users.select("username", F.col("id").alias("_eu")), "username", "left")
    hit = hit_u.join(t.users.select("email", F.col("id").alias("_ee")), "email", "left").groupBy(
        "ord", "username").agg(F.min(F.coalesce("_eu", "_ee")).alias("_eid"))
    u_rows = hit.select(
        F.lit("users").alias("table_name"), F.col("username").alias("natural_key"),
        F.when(F.col("_eid").isNull(), "insert").otherwise("exists").alias("action"),
        F.coalesce(F.col("_eid"), u_max + 1 + F.col("ord")).cast("bigint").alias("id"),
        F.lit(None).cast("bigint").alias("ref_id"))
    return cat_rows.unionByName(p_rows).unionByName(u_rows)
