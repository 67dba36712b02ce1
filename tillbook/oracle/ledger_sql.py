"""Ledger oracle in DuckDB: a row-by-row recursive CTE per (product, variant).

Independent of the Spark plan (no segments, no chunked scans): each op is applied to
the previous row's quantity, exactly as the reference's procedures did one request at
a time. Alerts follow the transition table with a LAST_VALUE(... IGNORE NULLS) window.
"""

from __future__ import annotations


def _apply(q: str) -> str:
    return (f"CAST(CASE o.op WHEN 'in' THEN {q} + o.n WHEN 'return' THEN {q} + o.n "
            f"WHEN 'out' THEN GREATEST(0, {q} - o.n) WHEN 'adjustment' THEN o.n "
            f"WHEN 'sale' THEN CASE WHEN {q} >= o.n THEN {q} - o.n ELSE {q} END END AS INTEGER)")


def _accepted(q: str) -> str:
    return f"CAST(CASE WHEN o.op = 'sale' AND {q} < o.n THEN 0 ELSE 1 END AS INTEGER)"


def ledger_ctes(ops: str = "stock_ops", opening: str | None = None) -> dict[str, str]:
    """CTEs ``ops_n`` and ``ledger`` (seq, product_id, variant_id, op, n, q_before, q_after, accepted, ...)."""
    if opening is None:
        open_sel = "CAST(0 AS INTEGER) AS opening"
        open_join = ""
    else:
        open_sel = "CAST(COALESCE(op0.quantity, 0) AS INTEGER) AS opening"
        open_join = (f" LEFT JOIN {opening} op0 ON op0.product_id = x.product_id "
                     "AND op0.variant_id IS NOT DISTINCT FROM x.variant_id")
    return {
        "ops_n": f"""
            SELECT x.*, {open_sel},
                   ROW_NUMBER() OVER (PARTITION BY x.product_id, x.variant_id ORDER BY x.seq) AS rn
            FROM {ops} x{open_join}""",
        "ledger": f"""
            WITH RECURSIVE r AS (
                SELECT o.product_id, o.variant_id, o.rn, o.seq, o.op, o.n, o.created_by, o.created_at,
                       o.opening AS q_before, {_apply('o.opening')} AS q_after, {_accepted('o.opening')} AS accepted
                FROM ops_n o WHERE o.rn = 1
                UNION ALL
                SELECT o.product_id, o.variant_id, o.rn, o.seq, o.op, o.n, o.created_by, o.created_at,
                       r.q_after, {_apply('r.q_after')}, {_accepted('r.q_after')}
                FROM r JOIN ops_n o ON o.product_id = r.product_id
                     AND o.variant_id IS NOT DISTINCT FROM r.variant_id AND o.rn = r.rn + 1
            )
            SELECT * FROM r""",
    }


LEDGER_CTES = ledger_ctes()

MOVEMENTS_SELECT = """
    SELECT seq AS id, product_id, variant_id, op AS movement_type, CAST(q_after - q_before AS INTEGER) AS quantity_change,
           q_before AS quantity_before, q_after AS quantity_after, CAST(NULL AS BIGINT) AS reference_id,
           CASE op WHEN 'sale' THEN 'sale' WHEN 'return' THEN 'refund' END AS reference_type,
           CAST(NULL AS VARCHAR) AS notes, created_by, created_at
    FROM ledger WHERE accepted = 1"""

MOVEMENTS_CTES = {**LEDGER_CTES, "stock_movements": MOVEMENTS_SELECT}


def alert_ctes(min_expr: str = "p.min_stock_level") -> dict[str, str]:
    return {
        "alert_sig": f"""
            SELECT l.*, {min_expr} AS min_level,
                   CASE WHEN {min_expr} IS NULL THEN NULL
                        WHEN l.op IN ('in', 'out', 'adjustment') THEN CASE WHEN l.q_after <= {min_expr} THEN 1 ELSE 0 END
                        WHEN l.op = 'sale' AND l.accepted = 1 AND l.q_after <= {min_expr} THEN 1
                   END AS signal
            FROM ledger l LEFT JOIN products p ON p.id = l.product_id""",
        "alert_ev": """
            SELECT *, CASE WHEN signal = 1 AND COALESCE(state_before, 0) = 0 THEN 'raise'
                           WHEN signal = 0 AND state_before = 1 THEN 'resolve' END AS event
            FROM (SELECT *, LAST_VALUE(signal IGNORE NULLS) OVER (
                            PARTITION BY product_id, variant_id ORDER BY seq
                            ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS state_before
                  FROM alert_sig)""",
        "low_stock_alerts": """
            SELECT e.seq AS id, e.product_id, e.variant_id, e.q_after AS current_stock, e.min_level AS min_stock_level,
                   CASE WHEN e.seq = m.last_seq THEN 'active' ELSE 'resolved' END AS alert_status,
                   CAST(NULL AS BIGINT) AS acknowledged_by, CAST(NULL AS TIMESTAMP) AS acknowledged_at, e.created_at
            FROM alert_ev e JOIN (SELECT product_id, variant_id, MAX(seq) AS last_seq FROM alert_ev
                                  WHERE event IS NOT NULL GROUP BY product_id, variant_id) m
              ON e.product_id = m.product_id AND e.variant_id IS NOT DISTINCT FROM m.variant_id
            WHERE e.event = 'raise'""",
    }


ALERTS_CTES = {**LEDGER_CTES, **alert_ctes()}
