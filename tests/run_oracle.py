"""Run every registered query against its oracle: ``python tests/run_oracle.py [sf_dir] [name ...]``."""

from __future__ import annotations

import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from oracle_harness import compare, duck  # noqa: E402

from tillbook.plans.registry import load_all  # noqa: E402
from tillbook.session import local_session  # noqa: E402
from tillbook.sources.views import RetailTables  # noqa: E402


def main() -> int:
    args = sys.argv[1:]
    sf = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in args if not a.startswith("/")]
    spark = local_session(8)
    con = duck(sf)
    specs = load_all()
    bad = 0
    for name, spec in specs.items():
        if names and name not in names:
            continue
        t0 = time.time()
        t = RetailTables.from_testdata(spark, sf)
        try:
            df = spec.build(t)
            if spec.sql is None:
                n = df.count()
                print(f"{name:32s} ROWS-ONLY {n} rows ({time.time() - t0:.1f}s)", flush=True)
                continue
            ok, msg = compare(df, con, spec.sql)
        except Exception as e:  # noqa: BLE001
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{name:32s} {'OK ' if ok else 'BAD'} {msg} ({time.time() - t0:.1f}s)", flush=True)
    print(f"{bad} failing")
    return 1 if bad else 0


if __name__ == "__main__":
    raise SystemExit(main())
