"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from tablemirror.plans.queries import QUERIES
from tablemirror.session import build_session

#: The eight queries of the published benchmark, and the flagship over current versions.
HEADLINE = {
    "q1_full_count": "ag1_total_count",
    "q2_filtered_count": "ag2_filtered_count",
    "q3_by_status": "ag3_by_status",
    "q4_region_status": "ag4_by_two_dims",
    "q5_monthly_revenue": "ag5_monthly_revenue",
    "q6_top_spenders": "ag6_top_spenders",
    "q7_regional_analytics": "ag7_regional_analytics",
    "q8_join_revenue": "jn1_join_revenue",
    "current_rows": "wn1_current_rows",
    "row_diff": "jn10_row_diff",
    "flagship": "flagship",
}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "8g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.warehouse.dir": tempfile.mkdtemp(prefix="spark-warehouse-"),
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="spark-checkpoint-"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    names = {k: v for k, v in HEADLINE.items() if not sys.argv[1:] or k in sys.argv[1:]}
    took: dict[str, float] = {}
    for label, name in names.items():
        runs = []
        for _ in range(3):  # the first also compiles
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        took[label] = round(min(runs), 4)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
