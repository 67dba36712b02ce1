"""Rows that batches add, and the tables after inserts and updates.

New ids follow the largest id of the table without gaps, in the order of the requests (``plans.ids``).
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillbook.functions import folds
from tillbook.operators.checks import _holders, _settle
from tillbook.operators.quality import SEED_CATEGORIES, SEED_PRODUCTS, SEED_USERS
from tillbook.plans.ids import allocate_ids
from tillbook.session import checkpoint_dir
from tillbook.sources.views import RetailTables

def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    """``table`` and new rows, cast to its types; columns that the rows lack are NULL."""
    have = set(rows.columns)
    return table.unionByName(rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name)
                                           for f in table.schema.fields]))


def _text(c: str) -> Column:
    return F.nullif(F.trim(F.col(c)), F.lit(""))


def _accepted(requests: DataFrame, checked: DataFrame) -> DataFrame:
    return requests.join(checked.filter(F.col("ok") == 1).select("req_id"), "req_id", "left_semi")


def _now(now: str) -> list[Column]:
    ts = F.lit(now).cast("timestamp_ntz")
    return [ts.alias("created_at"), ts.alias("updated_at")]


# ---------------------------------------------------------------------- results of checked requests
def categories_after_insert(t: RetailTables, incoming: DataFrame, checked: DataFrame, now: str) -> DataFrame:
    """The category table with the accepted new categories; ids in the order of the requests."""
    parent = F.when(F.col("parent_id") != 0, F.col("parent_id"))
    rows = allocate_ids(_accepted(incoming, checked), t.categories, "req_id").select(
        "id", F.trim("name").alias("name"), _text("description").alias("description"), parent.alias("parent_id"),
        F.lit(1).alias("is_active"), *_now(now))
    return appended(t.categories, rows)


def categories_after_update(t: RetailTables, requests: DataFrame, checked: DataFrame, now: str) -> DataFrame:
    """The category table with name, description and parent of each category's last accepted request."""
    new = F.struct("req_id", F.trim("name").alias("name"), _text("description").alias("description"),
                   F.when(F.col("parent_id") != 0, F.col("parent_id")).alias("parent_id"))
    last = _accepted(requests, checked).groupBy(F.col("id").alias("_id")).agg(F.max_by(new, "req_id").alias("_new"))
    x = t.categories.join(last, F.col("id") == F.col("_id"), "left")
    hit = F.col("_new").isNotNull()
    changed = {c: F.when(hit, F.col(f"_new.{c}")).otherwise(F.col(c)) for c in ("name", "description", "parent_id")}
    changed["updated_at"] = F.when(hit, _now(now)[1]).otherwise(F.col("updated_at"))
    return x.withColumns(changed).select(*t.categories.columns)


def users_after_insert(t: RetailTables, incoming: DataFrame, checked: DataFrame, now: str) -> DataFrame:
    """The user table with the accepted new users (texts trimmed, e-mail in lower case; passwords are not kept)."""
    rows = allocate_ids(_accepted(incoming, checked), t.users, "req_id").select(
        "id", F.trim("username").alias("username"), F.lower(F.trim("email")).alias("email"), "role",
        F.trim("first_name").alias("first_name"), F.trim("last_name").alias("last_name"), F.lit(1).alias("is_active"), *_now(now))
    return appended(t.users, rows)


def users_after_update(t: RetailTables, patches: DataFrame, checked: DataFrame, now: str) -> DataFrame:
    """U4: the user table after the accepted patches: for each field the last one that gives it (not NULL)."""
    given = {"username": F.trim("username"), "email": F.lower(F.trim("email")), "role": F.col("role"),
             "first_name": F.trim("first_name"), "last_name": F.trim("last_name"), "is_active": F.col("is_active")}
    last = _accepted(patches, checked).groupBy(F.col("id").alias("_id")).agg(
        *[F.max_by(v, F.when(F.col(c).isNotNull(), F.col("req_id"))).alias(f"_{c}") for c, v in given.items()])
    x = t.users.join(last, F.col("id") == F.col("_id"), "left")
    changed = {c: F.coalesce(F.col(f"_{c}"), F.col(c)) for c in given}
    changed["updated_at"] = F.when(F.col("_id").isNotNull(), _now(now)[1]).otherwise(F.col("updated_at"))
    return x.withColumns(changed).select(*t.users.columns)


# ---------------------------------------------------------------------- seed merge
def seed_frames(spark: SparkSession) -> dict[str, DataFrame]:
    """The reference's seed rows as frames for ``SeedMerge``."""
    numbered = lambda rows: [(i, *r) for i, r in enumerate(rows)]
    return {
        "users": spark.createDataFrame(numbered(SEED_USERS), "ord long, username string, email string, role string, first_name string, last_name string"),
        "categories": spark.createDataFrame(numbered(SEED_CATEGORIES), "ord long, name string, description string, parent_name string"),
        "products": spark.createDataFrame(
            numbered(SEED_PRODUCTS), "ord long, sku string, barcode string, name string, category string, brand string, "
            "price string, cost string, min_stock_level int, quantity int")}


@dataclass
class SeedMerge:
    """Q5: seed rows of any number merged into the current tables (insert or ignore), in the order of ``ord``.

    Users are left out when a user, or a row before them, has their name or e-mail; categories when their parent has one of
    that name, active or not, or a row before them makes it; products when their SKU exists or a row before has it. Rows
    whose key is NULL are left out. Root categories come before those with a parent; a parent's or category's name stands
    for the least id of that name after the roots, or after all categories, are in. Categories whose parent isn't known are left out,
    products whose category isn't known have none. New products get a stock row; those that are there keep theirs.
    """

    t: RetailTables
    seed: dict[str, DataFrame]
    now: str

    def users(self) -> DataFrame:
        u, x = self.t.users, self.seed["users"]
        none, always = F.lit(None).cast("string"), F.lit(folds.ALWAYS)
        missing = F.col("username").isNull() | F.col("email").isNull()
        x = x.select(F.col("ord").alias("req_id"), "username", "email", "role", "first_name", "last_name",
                     F.concat(F.lit("new "), F.col("ord").cast("string")).alias("id"),
                     F.when(missing, F.lit("missing")).alias("_pre"), none.alias("_post"))
        x = _settle(x, {"Username": (F.col("username"), none, always, _holders(u, F.col("username"))),
                        "Email": (F.col("email"), none, always, _holders(u, F.col("email")))})
        new = x.filter(F.col("_pre").isNull() & F.col("_clash").isNull())
        return appended(u, allocate_ids(new, u, "req_id").select(
            "id", "username", "email", "role", "first_name", "last_name", F.lit(1).alias("is_active"), *_now(self.now)))

    def _with_new(self, cats: DataFrame, rows: DataFrame) -> DataFrame:
        """``cats`` and those of ``rows`` (ord, name, description, parent_id) that have no namesake beside them."""
        beside = F.coalesce(F.col("parent_id"), F.lit(-1))
        first = rows.groupBy("name", beside.alias("_beside")).agg(F.min(F.struct("ord", "description", "parent_id")).alias("_row"))
        new = first.join(cats.select("name", beside.alias("_beside")), ["name", "_beside"], "left_anti").select("name", "_row.*")
        return appended(cats, allocate_ids(new, cats, "ord").select(
            "id", "name", "description", "parent_id", F.lit(1).alias("is_active"), *_now(self.now)))

    def categories(self) -> DataFrame:
        checkpoint_dir(self.t.spark)
        x = self.seed["categories"].filter(F.col("name").isNotNull())
        roots = x.filter(F.col("parent_name").isNull()).withColumn("parent_id", F.lit(None).cast("bigint"))
        cats = self._with_new(self.t.categories, roots).checkpoint(eager=True)
        kids = x.join(_ids_by_name(cats, "parent_name", "parent_id"), "parent_name")
        return self._with_new(cats, kids).checkpoint(eager=True)

    def new_products(self, categories: DataFrame) -> DataFrame:
        """The products to add, with ids, their category's id and the opening quantity."""
        x = self.seed["products"].filter(F.col("sku").isNotNull())
        cols = [c for c in x.columns if c != "sku"]
        first = x.groupBy("sku").agg(F.min_by(F.struct(*cols), "ord").alias("_row")).select("sku", "_row.*")
        new = first.join(self.t.products.select("sku"), "sku", "left_anti").join(
            _ids_by_name(categories, "category", "category_id"), "category", "left")
        return allocate_ids(new, self.t.products, "ord")

    def products_and_stock(self, categories: DataFrame) -> tuple[DataFrame, DataFrame]:
        new = self.new_products(categories)
        rows = new.select("id", "sku", "barcode", "name", "category_id", "brand", F.lit("pcs").alias("unit_size"), "price", "cost",
                          F.coalesce("min_stock_level", F.lit(0)).alias("min_stock_level"), F.lit(1).alias("is_active"), *_now(self.now))
        held = new.select(F.col("id").alias("product_id"), F.coalesce("quantity", F.lit(0)).alias("quantity"),
                          F.lit(0).alias("reserved_quantity"), _now(self.now)[0].alias("last_updated"))
        base = self.t.stock.filter(F.col("variant_id").isNull()).select("product_id")
        held = allocate_ids(held.join(base, "product_id", "left_anti"), self.t.stock, "product_id")
        return appended(self.t.products, rows), appended(self.t.stock, held)

    def tables(self) -> dict[str, DataFrame]:
        cats = self.categories()
        products, stock = self.products_and_stock(cats)
        return {"users": self.users(), "categories": cats, "products": products, "stock": stock}


def _ids_by_name(cats: DataFrame, name: str, out: str) -> DataFrame:
    return cats.filter(F.col("name").isNotNull()).groupBy(F.col("name").alias(name)).agg(F.min("id").alias(out))


def combined(*seeds: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Several seeds as one; ``ord`` must tell their rows apart."""
    return {name: reduce(DataFrame.unionByName, (s[name] for s in seeds)) for name in seeds[0]}
