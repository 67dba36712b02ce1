"""Staff operators (U1, U2, U6–U8): user lists and per-user activity statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tillbook.functions.exprs import mean_of, money
from tillbook.sources.views import RetailTables

USER_COLS = ("id", "username", "email", "role", "first_name", "last_name", "is_active", "created_at", "updated_at")


def users_list(t: RetailTables) -> DataFrame:
    """All users, newest first (no password hash exists in this model)."""
    return t.users.select(*USER_COLS).orderBy(F.col("created_at").desc(), F.col("id").desc())


def user_by_id(t: RetailTables, ids: DataFrame | None = None) -> DataFrame:
    """Users by id (all when ``ids`` is None)."""
    u = t.users.select(*USER_COLS)
    return u if ids is None else u.join(ids.select("id"), "id", "left_semi")


def user_sales_stats(t: RetailTables) -> DataFrame:
    """Per user: sales count, completed revenue and mean, first and last sale (users without sales: 0 / NULL)."""
    done = F.col("status") == "completed"
    agg = (t.sales.filter(F.col("cashier_id").isNotNull()).groupBy("cashier_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.when(done, F.col("total_amount")).otherwise(F.lit(0))).alias("rev"),
        F.sum(F.when(done, F.col("total_amount"))).alias("rev_c"), F.count(F.when(done, 1)).alias("n_c"),
        F.min("created_at").alias("first_sale"), F.max("created_at").alias("last_sale")))
    u = t.users.select("id", "username", "first_name", "last_name", "role")
    j = u.join(agg, u.id == agg.cashier_id, "left")
    return j.select("id", "username", "first_name", "last_name", "role",
                    F.coalesce("n", F.lit(0).cast("bigint")).alias("total_sales"), money("rev").alias("total_revenue"),
                    mean_of(F.col("rev_c"), F.col("n_c")).alias("average_sale"), "first_sale", "last_sale")


def user_recent_sales(t: RetailTables, n: int = 10) -> DataFrame:
    """The last ``n`` sales of every cashier (per-key top-N, WindowGroupLimit before the shuffle)."""
    s = t.sales.filter(F.col("cashier_id").isNotNull())
    w = Window.partitionBy("cashier_id").orderBy(F.col("created_at").desc(), F.col("id").desc())
    top = s.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
    return top.select("cashier_id", "rank", "id", "sale_number", money("total_amount").alias("total_amount"), "status",
                      "created_at")


def user_movement_stats(t: RetailTables) -> DataFrame:
    """U8: per actor: movement count, first and last movement."""
    agg = (t.stock_movements.filter(F.col("created_by").isNotNull()).groupBy("created_by").agg(
        F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_movement"),
        F.max("created_at").alias("last_movement")))
    u = t.users.select("id", "username")
    j = u.join(agg, u.id == agg.created_by, "left")
    return j.select("id", "username", F.coalesce("n", F.lit(0).cast("bigint")).alias("total_movements"),
                    "first_movement", "last_movement")
