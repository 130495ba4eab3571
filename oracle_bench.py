"""Time the DuckDB oracle statements of the headline queries on the same
"""

from __future__ import annotations

import json
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bench import HEADLINE  # noqa: E402
from tessera.plans.oracle import ORACLE  # noqa: E402
from tessera.sources.tables import TABLES  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    con = duckdb.connect()
    con.execute(f"SET threads = {os.environ.get('BENCH_CPUS', '8')}")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    times = {}
    for n in HEADLINE:
        t0 = time.time()
        con.execute(ORACLE[n]).fetchall()
        times[n] = round(time.time() - t0, 3)
    print(json.dumps({"metric": "duckdb_total_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf_dir": sf_dir}))


if __name__ == "__main__":
    main()
