"""Scalar expressions shared by operators (all JVM-side built-ins)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def full_name(first: str | Column, last: str | Column) -> Column:
    """``first || ' ' || last`` — NULL when either part is NULL (as in the reference)."""
    f = F.col(first) if isinstance(first, str) else first
    l_ = F.col(last) if isinstance(last, str) else last
    return F.concat(f, F.lit(" "), l_)


def like_pattern(term: str) -> str:
    """``%term%``: user ``%``/``_`` stay wildcards (reference behaviour); only ``\\`` is escaped."""
    return "%" + term.replace("\\", "\\\\") + "%"


def contains_any(term: str | None, *cols: str) -> Column:
    """Case-insensitive substring search OR-ed over columns (SQLite LIKE ignores ASCII case)."""
    if not term:
        return F.lit(True)
    pat = like_pattern(term)
    return reduce(lambda a, b: a | b, [F.coalesce(F.col(c).ilike(pat), F.lit(False)) for c in cols])


def all_of(*preds: Column) -> Column:
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def is_low(qty: str | Column = "quantity", min_level: str | Column = "min_stock_level") -> Column:
    q = F.col(qty) if isinstance(qty, str) else qty
    m = F.col(min_level) if isinstance(min_level, str) else min_level
    return F.when(q <= m, F.lit(1)).otherwise(F.lit(0))


def stock_status(qty: str | Column = "quantity", min_level: str | Column = "min_stock_level") -> Column:
    q = F.col(qty) if isinstance(qty, str) else qty
    m = F.col(min_level) if isinstance(min_level, str) else min_level
    return (F.when(q == 0, F.lit("out_of_stock")).when(q <= m, F.lit("low_stock"))
            .otherwise(F.lit("in_stock")))


def money(c: str | Column) -> Column:
    """Decimal money to DOUBLE at the output edge (sums stay exact decimals until here)."""
    col = F.col(c) if isinstance(c, str) else c
    return col.cast("double")


def mean_of(total: Column, count: Column) -> Column:
    """double(sum) / count — NULL on an empty set (matches SQL AVG, exact across engines)."""
    return F.when(count > 0, total.cast("double") / count)


def currency_text(c: str | Column) -> Column:
    """en-US currency text, e.g. ``$1,234.50`` / ``-$3.00`` (client formatter)."""
    col = F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(0))
    return F.concat(F.when(col < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"),
                    F.format_number(F.abs(col), 2))


def date_text(c: str | Column, with_time: bool = False) -> Column:
    """en-US date text: ``Aug 1, 2001`` or ``Aug 1, 2001, 09:05 AM``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.date_format(col, "MMM d, yyyy, hh:mm a" if with_time else "MMM d, yyyy")
