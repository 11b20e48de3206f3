"""Times the headline queries: the median of 5 runs after one to warm up, written to the noop sink.

BENCH_SF_DIR: the tables; BENCH_CPUS: threads. Prints one JSON line. The yardstick is a fixed scan and aggregate of
lineitem, timed before and after the others: it tells how fast the machine was. Queries of the dashboard, pages and
searches read what their first run has stored (the warm-up, whose seconds are in "first").
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from sparkloom import registry, session
from sparkloom.sources import tables

HEADLINE = ["revenue_by_day", "revenue_by_month", "dashboard_kpis", "top_customers", "movement_page", "sql_inner_join", "sql_left_join", "sql_semi_exists", "sql_window_rank", "string_agg_items", "cosine_topk", "lexical_rank", "rrf_fusion", "index_diff_files", "chunk_hierarchy"]


YARDSTICK = "SELECT l_returnflag, l_linestatus, l_shipdate, sum(l_extendedprice * (1 - l_discount)) AS s, count(DISTINCT l_partkey) AS n FROM lineitem GROUP BY 1, 2, 3"


def timed(run, n: int = 6) -> list[float]:
    runs = []
    for _ in range(n):
        began = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        runs.append(time.perf_counter() - began)
    return runs


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(f"local[{cpus}]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    found = registry.queries()
    tables.views(spark, sf_dir, "lineitem")
    yardstick = timed(lambda: spark.sql(YARDSTICK))[1:]
    times, first = {}, {}
    for name in HEADLINE:
        runs = timed(lambda name=name: found[name](spark, sf_dir))
        print(name, runs, file=sys.stderr, flush=True)
        times[name], first[name] = round(statistics.median(runs[1:]), 3), round(runs[0], 3)
    tables.views(spark, sf_dir, "lineitem")
    yardstick += timed(lambda: spark.sql(YARDSTICK))[1:]
    print(json.dumps({"metric": "total seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2], "yardstick": round(statistics.median(yardstick), 3), "first": first}))
    spark.stop()


if __name__ == "__main__":
    main()
