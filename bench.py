"""Time every registered query; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. ``BENCH_ONLY`` picks
queries by name, comma-separated. Every query runs to its last row into a sink
that drops them.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ledgerweave.session import local_session  # noqa: E402
from ledgerweave.star.queries import QUERIES  # noqa: E402


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    only = {n for n in os.environ.get("BENCH_ONLY", "").split(",") if n}
    spark = local_session("bench", cores)
    # Start-up of the engine and the first look at the files are not a query.
    QUERIES["group_member_rollup"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name, build in QUERIES.items():
        if only and name not in only:
            continue
        start = time.perf_counter()
        build(spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total wall time of all queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
