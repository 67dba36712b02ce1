"""Requests of a batch one by one in DuckDB: a recursive CTE that carries the keys of all rows as LISTs."""

from __future__ import annotations


def batch_walk(kinds: int, new_rows: bool = False) -> dict[str, str]:
    """CTE ``walk`` (req_id, clash): the place of the first key that another row holds at the request's turn, or NULL.

    Over ``holders`` (id, k0, k1, ...: the keys of the rows that count) and ``claims`` (req_id, id, alive, late, k0, k1, ...).
    ``new_rows``: a request that is accepted adds a row; else it replaces the keys of its own.
    """
    keys = [f"k{i}" for i in range(kinds)]
    clash = "CASE WHEN NOT x.alive THEN NULL " + " ".join(
        f"WHEN len(list_filter(w.{k}, lambda v, i: v = x.{k} AND i IS DISTINCT FROM x.e)) > 0 THEN {n}" for n, k in enumerate(keys)) + " END"

    def after(k: str) -> str:
        change = f"list_append(w.{k}, x.{k})" if new_rows else f"list_transform(w.{k}, lambda v, i: CASE WHEN i = x.e THEN x.{k} ELSE v END)"
        return f"CASE WHEN x.alive AND NOT x.late AND ({clash}) IS NULL THEN {change} ELSE w.{k} END"

    return {
        "placed": "SELECT *, ROW_NUMBER() OVER (ORDER BY id) AS e FROM holders",
        "turns": f"""SELECT ROW_NUMBER() OVER (ORDER BY c.req_id) AS r, c.*, {'NULL' if new_rows else 'p.e'} AS e
                     FROM claims c LEFT JOIN placed p ON p.id = c.id""",
        "walk": f"""
            WITH RECURSIVE w AS (
                SELECT CAST(0 AS BIGINT) AS r, CAST(NULL AS BIGINT) AS req_id, CAST(NULL AS INTEGER) AS clash,
                       {', '.join(f"COALESCE((SELECT list({k} ORDER BY e) FROM placed), CAST([] AS VARCHAR[])) AS {k}" for k in keys)}
                UNION ALL
                SELECT x.r, x.req_id, {clash}, {', '.join(map(after, keys))}
                FROM w JOIN turns x ON x.r = w.r + 1
            ) SELECT req_id, clash FROM w WHERE r > 0""",
    }
