"""Benchmark: every registered query at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``.

Prints one JSON line: {"metric", "value" (sum of per-query medians, seconds), "unit",
"queries" {name: median seconds}, "sf", ...}.

Mode (``$BENCH_MODE``): ``materialized`` (default) first writes the canonical retail
tables once as parquet under the session's checkpoint folder (timed separately as ``build_views_sec``)
and runs the queries on them — the deployment shape, where views are an ETL product;
``base`` derives the views inside every query from the supplied base tables.
Each query is executed fully with the ``noop`` sink (no collect to the driver); one
warm-up pass, then ``$BENCH_RUNS`` (default 2) timed passes, median per query.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time
import uuid

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillbook.plans.registry import load_all  # noqa: E402
from tillbook.session import checkpoint_dir, local_session  # noqa: E402
from tillbook.sources.views import RetailTables  # noqa: E402

#: Further outputs of the job that ``post_sales`` times.
SAME_JOB = ("post_sales_items", "post_sales_movements", "post_sales_stock", "post_sales_alerts")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    mode = os.environ.get("BENCH_MODE", "materialized")
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * cpus), app="tillbook-bench")
    specs = load_all()
    names = [n for n in specs if (n in only if only else n not in SAME_JOB)]

    build = 0.0
    base = RetailTables.from_testdata(spark, sf_dir)
    if mode == "materialized":
        # the shared folder the session names (spark.checkpoint.dir), a scratch one only when unset
        root = f"{checkpoint_dir(spark).rstrip('/')}/bench-{uuid.uuid4().hex[:10]}"
        t0 = time.perf_counter()
        tables = base.materialize(f"{root}/retail")
        build = time.perf_counter() - t0
    else:
        tables = base

    def bundle():
        return RetailTables.from_parquet(spark, f"{root}/retail") if mode == "materialized" else RetailTables.from_testdata(spark, sf_dir)

    times: dict[str, list[float]] = {n: [] for n in names}
    for rep in range(runs + 1):
        for n in names:
            t0 = time.perf_counter()
            # fresh tables each time: nothing a bundle keeps (the ledger) is left out of a query's time
            specs[n].build(bundle()).write.format("noop").mode("overwrite").save()
            if rep > 0:
                times[n].append(time.perf_counter() - t0)
    med = {n: round(statistics.median(v), 4) for n, v in times.items()}
    sf = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "sum_of_query_medians", "value": round(sum(med.values()), 3), "unit": "sec",
                      "queries": med, "sf": float(sf.group(1)) if sf else sf_dir, "mode": mode, "cpus": cpus,
                      "runs": runs, "build_views_sec": round(build, 3), "n_queries": len(med)}))
    spark.stop()


if __name__ == "__main__":
    main()
