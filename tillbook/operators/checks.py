"""Validation and apply jobs for catalogue, category and user changes.

One pattern throughout: a request frame is checked by ordered predicates; ``reason`` is
the first failing check (the reference answers with the first error), ``ok`` = no
failure. Uniqueness checks compare against per-key aggregates of the current table
(count, min id, max id) instead of joining row to row, so a duplicated key cannot fan
out; requests of one batch that claim the same key are settled as if they came one by
one in the order of ``req_id``.
Apply jobs return the new table (anti join of changed ids ∪ changed rows).
"""

from __future__ import annotations

from functools import reduce

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tillbook.functions import folds
from tillbook.plans.graph import components, lifted, lineage, rings
from tillbook.plans.ids import allocate_ids
from tillbook.plans.tasks import looked_up, tasks_for
from tillbook.session import checkpoint_dir
from tillbook.sources.schemas import ROLES
from tillbook.sources.views import RetailTables

cloudpickle.register_pickle_by_value(folds)

# Fixed value: a plain e-mail shape (approximation of the reference's validator).
EMAIL_PATTERN = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """``reason`` = message of the first check whose failure predicate is true (NULL = passes)."""
    expr = None
    for msg, bad in checks:
        cond = F.coalesce(bad, F.lit(False))
        expr = F.when(cond, F.lit(msg)) if expr is None else expr.when(cond, F.lit(msg))
    return expr


def _blank(c: str) -> Column:
    return F.col(c).isNull() | (F.trim(F.col(c)) == "")


def _truthy_id(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != 0)


def _key_stats(df: DataFrame, key: str, prefix: str) -> DataFrame:
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(
        F.count(F.lit(1)).alias(f"{prefix}_n"), F.min("id").alias(f"{prefix}_min"), F.max("id").alias(f"{prefix}_max"))


def _exists_other(prefix: str, self_id: Column | None) -> Column:
    n, lo = F.col(f"{prefix}_n"), F.col(f"{prefix}_min")
    if self_id is None:
        return F.coalesce(n, F.lit(0)) > 0
    return F.coalesce((n > 1) | ((n == 1) & ~lo.eqNullSafe(self_id)), F.lit(False))


def _settle(df: DataFrame, kinds: dict[str, tuple[Column, Column, Column, DataFrame]], tasks: int | None = None) -> DataFrame:
    """``_clash``: the first kind of key that a row of another id holds when the request comes; NULL = none.

    ``df``: req_id (unique), id, _pre (reason of the checks before the keys'; NULL = passed) and _post (of those after). Each
    kind has the key claimed, the key that the row of this id holds now, when to check it, and the table's (key, n) with
    n rows holding each key. As if the requests came one by one: a refused one blocks no other, an accepted one gives its
    old keys up. Requests that touch a common key, claimed or given up, or a common id are linked; the components of these links
    do not touch each other, and each is settled in order in one task, holding the keys that have changed hands. ``tasks``: how many
    the requests are dealt to (``tasks_for``).
    """
    checkpoint_dir(df.sparkSession)
    x = df
    for i, (claim, old, test, held) in enumerate(kinds.values()):
        held = held.select(F.col(held.columns[0]).alias("_key"), F.col(held.columns[1]).alias(f"_n{i}")).filter("_key is not null")
        x = x.withColumns({f"_c{i}": claim.cast("string"), f"_o{i}": old.cast("string"), f"_t{i}": test})
        x = looked_up(x, F.col(f"_c{i}"), "req_id", held, "_key", tasks)
    x = x.checkpoint(eager=True)
    places = range(len(kinds))
    touched = F.array(*(F.concat(F.lit(f"{i}:"), F.col(f"_{c}{i}")) for i in places for c in "co"), F.concat(F.lit("id:"), F.col("id").cast("string")))
    request = F.concat(F.lit("r:"), F.col("req_id").cast("string"))
    links = x.filter("_pre is null").select(request.alias("a"), F.explode(F.array_distinct(F.filter(touched, lambda c: c.isNotNull()))).alias("b"))
    links = links.join(links.groupBy("b").agg(F.count(F.lit(1)).alias("_m")).filter("_m > 1"), "b").checkpoint(eager=True)
    if not links.isEmpty():
        x = looked_up(x, request, "req_id", components(links, "a", "b").select(F.col("node").alias("_r"), F.col("root").alias("_grp")), "_r", tasks)
    else:
        x = x.withColumn("_grp", F.lit(None).cast("string"))

    def each(c: str, default=None) -> Column:
        return F.array(*(F.col(f"_{c}{i}") if default is None else F.coalesce(f"_{c}{i}", F.lit(default)) for i in places))

    rows = x.select(F.coalesce("_grp", request).alias("grp"), "req_id", "id", F.col("_pre").isNull().cast("int").alias("alive"),
                    F.col("_post").isNotNull().cast("int").alias("late"), each("c").alias("claim"), each("o").alias("old"),
                    each("t").alias("test"), each("n", 0).alias("held"))
    out = (rows.repartition(tasks, "grp") if tasks else rows.repartition("grp")).sortWithinPartitions("grp", "req_id").mapInPandas(folds.settle_requests, "req_id long, clash int")
    name = F.array(*map(F.lit, kinds))
    out = out.select("req_id", F.when(F.col("clash") >= 0, F.get(name, F.col("clash"))).alias("_clash"))
    return x.select(*df.columns).join(out.hint("merge") if tasks else out, "req_id").checkpoint(eager=True)


def _holders(df: DataFrame, key: Column) -> DataFrame:
    return df.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n"))


def _finish(df: DataFrame, reason: Column, *cols: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select("req_id", *cols, reason.alias("reason"), reason.isNull().cast("int").alias("ok"), *keep)


# ---------------------------------------------------------------------- products
def catalog_check(t: RetailTables, incoming: DataFrame, mode: str = "insert") -> DataFrame:
    """Validate product create (``mode='insert'``) or full update (``'update'``) requests.

    ``incoming``: req_id, id, sku, name, price, category_id, brand, unit_size, cost,
    min_stock_level, barcode, description. Checks, in the reference's order: field
    rules; (update) product active; SKU unique among active products other than itself;
    barcode likewise when given; category active when given; then in-batch duplicates.
    ``warning`` flags a SKU held only by an inactive product (the table constraint is
    global; the reference checks active rows only).
    """
    p = t.products
    act = p.filter(F.col("is_active") == 1)
    x = incoming.withColumn("sku", F.trim("sku")).withColumn("name", F.trim("name")).withColumn(
        "barcode", F.nullif(F.trim("barcode"), F.lit("")))
    tasks = tasks_for(x)
    for key, rows, prefix in (("sku", act, "_sa"), ("sku", p, "_sx"), ("barcode", act, "_ba")):
        x = looked_up(x, F.col(key), "req_id", _key_stats(rows, key, prefix).withColumnRenamed(key, "_k"), "_k", tasks)
    cats = t.categories.filter(F.col("is_active") == 1).select(F.col("id").alias("_cat"))
    x = x.join(cats, F.col("category_id") == F.col("_cat"), "left")
    self_id = F.col("id") if mode == "update" else None
    pre = [("Validation failed", _blank("sku") | _blank("name") | F.col("price").isNull() | (F.col("price") < 0)
            | (F.col("cost") < 0) | (F.col("min_stock_level") < 0))]
    own = act.select(F.col("id").alias("_of"), F.col("id").alias("_pid"), F.col("sku").alias("_old_sku"), F.col("barcode").alias("_old_barcode"))
    x = looked_up(x, F.when(F.lit(mode == "update"), F.col("id")), "req_id", own, "_of", tasks)
    if mode == "update":
        pre.append(("Product not found", F.col("_pid").isNull()))
    post = [("Category not found", _truthy_id("category_id") & F.col("_cat").isNull())]
    x = _settle(x.withColumn("_pre", first_failure(pre)).withColumn("_post", first_failure(post)), {
        "SKU": (F.col("sku"), F.col("_old_sku"), F.lit(folds.ALWAYS), _holders(act, F.col("sku"))),
        "barcode": (F.col("barcode"), F.col("_old_barcode"), F.lit(folds.ALWAYS), _holders(act, F.col("barcode")))}, tasks)
    x = x.withColumn("_reason", F.coalesce("_pre", F.when(F.col("_clash").isNotNull(), F.format_string(
        "Product with this %s already exists", "_clash")), "_post"))
    warn = F.when(F.col("_reason").isNull() & ~_exists_other("_sa", self_id) & _exists_other("_sx", self_id),
                  F.lit("SKU is used by an inactive product"))
    return _finish(x.withColumn("warning", warn), F.col("_reason"), "id", "sku", keep=("warning",))


def _product_row(x: DataFrame, now: Column) -> DataFrame:
    """Request fields with the reference's defaults (``|| null``, ``|| 'pcs'``, ``|| 0``)."""
    blank_null = lambda c: F.nullif(F.trim(F.col(c)), F.lit(""))
    price = F.col("price").cast("decimal(10,2)")
    return x.select(
        "id", F.trim("sku").alias("sku"), blank_null("barcode").alias("barcode"), F.trim("name").alias("name"),
        blank_null("description").alias("description"),
        F.when(_truthy_id("category_id"), F.col("category_id")).alias("category_id"),
        blank_null("brand").alias("brand"), F.coalesce(blank_null("unit_size"), F.lit("pcs")).alias("unit_size"),
        price.alias("price"), F.nullif(F.col("cost").cast("decimal(10,2)"), F.lit(0)).alias("cost"),
        F.coalesce(F.col("min_stock_level"), F.lit(0)).cast("int").alias("min_stock_level"),
        now.alias("created_at"), now.alias("updated_at"))


def catalog_insert(t: RetailTables, incoming: DataFrame, checked: DataFrame, now: str) -> tuple[DataFrame, DataFrame]:
    """Accepted create requests → (new product rows, their zero stock rows)."""
    acc = incoming.join(checked.filter(F.col("ok") == 1).select("req_id"), "req_id", "left_semi")
    ts = F.lit(now).cast("timestamp_ntz")
    rows = _product_row(acc, ts).select(*[c for c in ("id", "sku", "barcode", "name", "description", "category_id",
                                                      "brand", "unit_size", "price", "cost", "min_stock_level")],
                                        F.lit(None).cast("string").alias("image_url"), F.lit(1).alias("is_active"),
                                        "created_at", "updated_at")
    held = rows.select(F.col("id").alias("product_id"), F.lit(None).cast("bigint").alias("variant_id"), F.lit(0).alias("quantity"),
                       F.lit(0).alias("reserved_quantity"), ts.alias("last_updated"), F.lit(None).cast("bigint").alias("updated_by"))
    stock = t.stock if t.supplied("stock") else held.select(F.col("product_id").alias("id")).limit(0)
    return rows, allocate_ids(held, stock, "product_id")


def catalog_update(t: RetailTables, incoming: DataFrame, checked: DataFrame, now: str) -> DataFrame:
    """Full-row replace of accepted updates; returns the new products table (image kept)."""
    old = t.products
    acc = incoming.join(checked.filter(F.col("ok") == 1).select("req_id"), "req_id", "left_semi")
    last = acc.groupBy("id").agg(F.max("req_id").alias("req_id"))
    acc = acc.join(last, ["id", "req_id"], "inner")
    ts = F.lit(now).cast("timestamp_ntz")
    new = _product_row(acc, ts).drop("created_at")
    keep = old.join(new.select("id"), "id", "left_anti")
    upd = new.join(old.select("id", "image_url", "is_active", "created_at"), "id", "inner")
    cols = old.columns
    return keep.unionByName(upd.select(*cols))


def product_soft_delete(t: RetailTables, requests: DataFrame) -> DataFrame:
    """P10: per request (req_id, product_id): refuse unknown/inactive and sold products; else deactivate."""
    act = t.products.filter(F.col("is_active") == 1).select(F.col("id").alias("product_id"), F.lit(1).alias("_act"))
    sold = t.sale_items.groupBy("product_id").agg(F.count(F.lit(1)).alias("_sold"))
    x = requests.join(act, "product_id", "left").join(sold, "product_id", "left")
    reason = first_failure([
        ("Product not found", F.col("_act").isNull()),
        ("Cannot delete product that has been sold. You can only deactivate it.", F.col("_sold") > 0)])
    return _finish(x, reason, "product_id")


def products_after_delete(t: RetailTables, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P10 apply: products and variants with ``is_active = 0`` for accepted deletions (cascade to variants)."""
    gone = results.filter(F.col("ok") == 1).select(F.col("product_id").alias("_gone")).distinct()
    p = deactivated(t.products, results, "product_id")
    v = t.product_variants.join(gone, F.col("product_id") == F.col("_gone"), "left")
    v = v.withColumn("is_active", F.when(F.col("_gone").isNotNull(), F.lit(0)).otherwise(F.col("is_active"))).drop("_gone")
    return p, v


def deactivated(table: DataFrame, results: DataFrame, id_col: str = "id") -> DataFrame:
    """C7 / U5 apply: the table with ``is_active = 0`` for the accepted requests' rows."""
    gone = results.filter(F.col("ok") == 1).select(F.col(id_col).alias("_gone")).distinct()
    x = table.join(gone, F.col("id") == F.col("_gone"), "left")
    return x.withColumn("is_active", F.when(F.col("_gone").isNotNull(), F.lit(0)).otherwise(F.col("is_active"))).drop("_gone")


# ---------------------------------------------------------------------- categories
SAME_LEVEL = "Category with this name already exists at this level"


def _place() -> Column:
    """What no two active categories may share: parent (NULL: the roots) and name."""
    return F.concat_ws(":", F.coalesce(F.col("parent_id"), F.lit(-1)).cast("string"), "name")


def category_insert_check(t: RetailTables, incoming: DataFrame) -> DataFrame:
    """(req_id, name, description, parent_id): name given; parent active when given; name unique
    among active siblings (NULL parent = root level, compared null-safely); then in-batch duplicates."""
    x = incoming.withColumn("name", F.trim("name")).withColumn(
        "parent_id", F.when(_truthy_id("parent_id"), F.col("parent_id")))
    act = t.categories.filter(F.col("is_active") == 1).select(F.col("id").alias("_par"))
    x = x.join(act, F.col("parent_id") == F.col("_par"), "left")
    pre = first_failure([("Validation failed", _blank("name")),
                         ("Parent category not found", F.col("parent_id").isNotNull() & F.col("_par").isNull())])
    none = F.lit(None).cast("string")
    x = _settle(x.withColumn("_pre", pre).withColumn("_post", none).withColumn("id", F.concat(F.lit("new "), F.col("req_id").cast("string"))), {
        "name": (_place(), none, F.lit(folds.ALWAYS), _holders(t.categories.filter(F.col("is_active") == 1), _place()))})
    reason = F.coalesce("_pre", F.when(F.col("_clash").isNotNull(), F.lit(SAME_LEVEL)))
    return _finish(x, reason, "name", "parent_id")


def category_reparent_check(t: RetailTables, requests: DataFrame) -> DataFrame:
    """(req_id, id, name, parent_id) updates: category active; not its own parent; parent active;
    parent not among its active descendants (parents are followed up from it); name unique among the new
    siblings; no two requests of the batch that together make a circle or claim one name."""
    x = requests.withColumn("name", F.trim("name")).withColumn(
        "parent_id", F.when(_truthy_id("parent_id"), F.col("parent_id")))
    act = t.categories.filter(F.col("is_active") == 1)
    x = x.join(act.select(F.col("id").alias("_self"), _place().alias("_old")), F.col("id") == F.col("_self"), "left")
    x = x.join(act.select(F.col("id").alias("_par")), F.col("parent_id") == F.col("_par"), "left")
    below = _below_itself(x.filter(F.col("parent_id").isNotNull()).select("req_id", "id", "parent_id"), act.select("id", "parent_id", "name"))
    cyc = below.select("req_id").distinct().withColumn("_cycle", F.lit(1))
    x = x.join(cyc, "req_id", "left")
    reason = first_failure([
        ("Validation failed", _blank("name")),
        ("Category not found", F.col("_self").isNull()),
        ("Category cannot be its own parent", F.col("parent_id") == F.col("id")),
        ("Parent category not found", F.col("parent_id").isNotNull() & F.col("_par").isNull()),
        ("Cannot create circular reference", F.col("_cycle") == 1)])
    x = _settle(x.withColumn("_pre", reason).withColumn("_post", F.lit(None).cast("string")), {
        "name": (_place(), F.col("_old"), F.lit(folds.ALWAYS), _holders(act, _place()))})
    reason = F.coalesce("_pre", F.when(F.col("_clash").isNotNull(), F.lit(SAME_LEVEL)))
    out = _finish(x, reason, "id", "name", "parent_id").checkpoint(eager=True)
    while True:  # moves that are fine alone may close a circle together: the latest of a circle is refused
        moved = out.filter("ok = 1").groupBy("id").agg(F.max(F.struct("req_id", "parent_id")).alias("m")).select(
            "id", F.col("m.req_id").alias("by"), F.col("m.parent_id").alias("_new"))
        edges = act.select("id", "parent_id").join(moved, "id", "left").select(
            "id", F.when(F.col("by").isNotNull(), F.col("_new")).otherwise(F.col("parent_id")).alias("parent_id"), "by")
        edges = edges.checkpoint(eager=True)
        circles = rings(edges.select("id", F.col("parent_id").alias("parent"), "by"), "by")
        last = circles.filter("by is not null").select(F.col("by").alias("req_id")).distinct().withColumn("_late", F.lit(1)).checkpoint(eager=True)
        if last.isEmpty():
            return out
        hit = F.col("_late") == 1
        out = out.join(last, "req_id", "left").select(
            "req_id", "id", "name", "parent_id", F.when(hit, "Cannot create circular reference").otherwise(F.col("reason")).alias("reason"),
            F.when(hit, 0).otherwise(F.col("ok")).alias("ok")).checkpoint(eager=True)


def _below_itself(moves: DataFrame, act: DataFrame) -> DataFrame:
    """The moves (req_id, id, parent_id) whose new parent is the category itself or lies below it, among active ones.

    The parent is lifted by the difference of the depths, with a join for each power of two. Only moves to categories that hang on a
    circle, which have no depth, are followed a level at a time.
    """
    links = act.select("id", F.col("parent_id").alias("parent"))
    depth = lineage(links.withColumn("name", F.lit(None).cast("string"))).select("id", "depth").checkpoint(eager=True)
    of = lambda c: depth.select(F.col("id").alias(c), F.col("depth").alias(f"_{c}"))
    x = moves.join(of("id"), "id", "left").join(of("parent_id"), "parent_id", "left")
    known = x.filter("_id is not null and _parent_id >= _id").select(
        F.col("parent_id").alias("node"), (F.col("_parent_id") - F.col("_id")).cast("bigint").alias("up"), "req_id", "id")
    hits = lifted(known, links).filter("node = id").select("req_id")
    w = x.filter("_parent_id is null").select("req_id", "id", F.col("parent_id").alias("cur"), F.array().cast("array<bigint>").alias("seen"))
    w, found = w.checkpoint(eager=True), [hits]
    while not w.isEmpty():
        found.append(w.filter("cur = id").select("req_id"))
        w = w.filter("cur <> id").filter(~F.array_contains("seen", F.col("cur"))).join(
            links.select(F.col("id").alias("cur"), "parent"), "cur").filter("parent is not null").select(
            "req_id", "id", F.col("parent").alias("cur"), F.array_append("seen", F.col("cur")).alias("seen")).checkpoint(eager=True)
    return reduce(DataFrame.unionByName, found)


def category_soft_delete(t: RetailTables, requests: DataFrame) -> DataFrame:
    """(req_id, id): refuse unknown/inactive, with active products, or with active children."""
    act = t.categories.filter(F.col("is_active") == 1).select(F.col("id").alias("_self"))
    prods = (t.products.filter(F.col("is_active") == 1).groupBy(F.col("category_id").alias("_pc"))
             .agg(F.count(F.lit(1)).alias("_np")))
    kids = (t.categories.filter((F.col("is_active") == 1) & F.col("parent_id").isNotNull())
            .groupBy(F.col("parent_id").alias("_kc")).agg(F.count(F.lit(1)).alias("_nk")))
    x = (requests.join(act, F.col("id") == F.col("_self"), "left").join(prods, F.col("id") == F.col("_pc"), "left")
         .join(kids, F.col("id") == F.col("_kc"), "left"))
    reason = (F.when(F.col("_self").isNull(), F.lit("Category not found"))
              .when(F.col("_np") > 0, F.format_string(
                  "Cannot delete category. It has %d products assigned to it.", F.col("_np")))
              .when(F.col("_nk") > 0, F.format_string("Cannot delete category. It has %d subcategories.", F.col("_nk"))))
    return _finish(x, reason, "id")


# ---------------------------------------------------------------------- users
def user_insert_check(t: RetailTables, incoming: DataFrame) -> DataFrame:
    """(req_id, username, email, password, role, first_name, last_name): field rules, then
    username and e-mail unique over all users and within the batch."""
    u = t.users
    x = incoming.withColumn("username", F.trim("username")).withColumn("email", F.lower(F.trim("email")))
    bad = (_blank("username") | (F.length("username") < 3) | ~F.coalesce(F.col("email").rlike(EMAIL_PATTERN), F.lit(False))
           | F.col("password").isNull() | (F.length("password") < 6) | ~F.col("role").isin(*ROLES)
           | F.col("role").isNull() | _blank("first_name") | _blank("last_name"))
    none = F.lit(None).cast("string")
    x = x.withColumn("_pre", first_failure([("Validation failed", bad)])).withColumn("_post", none)
    x = _settle(x.withColumn("id", F.concat(F.lit("new "), F.col("req_id").cast("string"))), {
        "Username": (F.col("username"), none, F.lit(folds.ALWAYS), _holders(u, F.col("username"))),
        "Email": (F.col("email"), none, F.lit(folds.ALWAYS), _holders(u, F.lower("email")))})
    reason = F.coalesce("_pre", F.when(F.col("_clash").isNotNull(), F.format_string("%s already exists", "_clash")))
    return _finish(x, reason, "username", "email")


PATCH_FIELDS = ("username", "email", "role", "first_name", "last_name", "is_active")


def user_partial_update(t: RetailTables, patches: DataFrame) -> DataFrame:
    """U4: (req_id, id, actor_id, username?, email?, role?, first_name?, last_name?, is_active?).

    Only non-NULL fields change; self-deactivation is refused; a changed username/e-mail
    must not belong to another user. Returns outcome plus the resulting field values.
    """
    u = t.users.select("id", *[F.col(c).alias(f"_old_{c}") for c in PATCH_FIELDS])
    x = patches.withColumns({c: F.trim(c) for c in ("username", "first_name", "last_name")} | {"email": F.lower(F.trim("email"))}).join(u, "id", "left")

    def asked(c: str) -> Column:
        return F.when(F.col(c).isNull(), folds.KEEP).otherwise(folds.CHANGED)

    bad = ((F.col("username").isNotNull() & (F.length(F.trim("username")) < 3))
           | (F.col("email").isNotNull() & ~F.col("email").rlike(EMAIL_PATTERN))
           | (F.col("role").isNotNull() & ~F.col("role").isin(*ROLES))
           | (F.col("first_name").isNotNull() & (F.trim("first_name") == ""))
           | (F.col("last_name").isNotNull() & (F.trim("last_name") == "")))
    reason = first_failure([
        ("Validation failed", bad),
        ("User not found", F.col("_old_username").isNull()),
        ("You cannot deactivate your own account", (F.col("actor_id") == F.col("id")) & (F.col("is_active") == 0))])
    empty = first_failure([("No fields to update", reduce(lambda a, b: a & b, [F.col(c).isNull() for c in PATCH_FIELDS]))])
    x = _settle(x.withColumn("_pre", reason).withColumn("_post", empty), {
        "Username": (F.col("username"), F.col("_old_username"), asked("username"), _holders(t.users, F.col("username"))),
        "Email": (F.col("email"), F.lower("_old_email"), asked("email"), _holders(t.users, F.lower("email")))})
    reason = F.coalesce("_pre", F.when(F.col("_clash").isNotNull(), F.format_string("%s already exists", "_clash")), "_post")
    new_vals = [F.when(reason.isNull(), F.coalesce(F.col(c), F.col(f"_old_{c}"))).otherwise(F.col(f"_old_{c}"))
                .alias(c) for c in PATCH_FIELDS]
    return x.select("req_id", "id", reason.alias("reason"), reason.isNull().cast("int").alias("ok"), *new_vals)


def user_soft_delete(t: RetailTables, requests: DataFrame) -> DataFrame:
    """(req_id, id, actor_id): refuse unknown users, self, and users with sales; else deactivate."""
    u = t.users.select(F.col("id").alias("_uid"))
    s = t.sales.filter(F.col("cashier_id").isNotNull()).groupBy(F.col("cashier_id").alias("_cid")).agg(
        F.count(F.lit(1)).alias("_ns"))
    x = requests.join(u, F.col("id") == F.col("_uid"), "left").join(s, F.col("id") == F.col("_cid"), "left")
    reason = (F.when(F.col("_uid").isNull(), F.lit("User not found"))
              .when(F.col("actor_id") == F.col("id"), F.lit("You cannot delete your own account"))
              .when(F.col("_ns") > 0, F.format_string(
                  "Cannot delete user. They have %d sales records. You can deactivate the user instead.", F.col("_ns"))))
    return _finish(x, reason, "id")
