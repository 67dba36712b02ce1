"""Named queries: each key pairs a Spark plan with its DuckDB oracle SQL.

``QUERIES[name].build(t)`` returns the lazy Spark DataFrame over a ``RetailTables``
bundle; ``QUERIES[name].sql`` is an independent SQL formulation over the base tables
(None where the operator is not expressible in plain SQL, e.g. the streaming twins).
Parameters are fixed per key so the driver's comparison is reproducible.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Callable

from pyspark.sql import DataFrame

from tillbook.sources.views import RetailTables


@dataclass(frozen=True)
class QuerySpec:
    name: str
    build: Callable[[RetailTables], DataFrame]
    sql: str | None
    doc: str = ""


QUERIES: dict[str, QuerySpec] = {}


def register(name: str, build: Callable[[RetailTables], DataFrame], sql: str | None, doc: str = "") -> None:
    if name in QUERIES:
        raise ValueError(f"duplicate query {name!r}")
    QUERIES[name] = QuerySpec(name, build, sql, doc)


def load_all() -> dict[str, QuerySpec]:
    """Import the modules that register queries (idempotent)."""
    from tillbook.plans import q_catalog, q_changes, q_dashboard, q_ledger, q_quality, q_sales, q_staff, q_stock  # noqa: F401
    from tillbook.plans import q_documents, q_indexes, q_inserts  # noqa: F401
    return QUERIES
