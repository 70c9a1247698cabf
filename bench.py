"""Times the headline queries: one JSON line on stdout.

``etl_star`` is the way from raw tables to the stored star.  Queries marked
``raw:`` start from raw tables, the others from the stored star, the usual
flow of loading once and asking often.

BENCH_SF_DIR  folder of the test tables (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_RUNS    timed runs per query after one warm-up (default 2, median counts)
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tillwise.plans.catalog import catalog, on_star  # noqa: E402
from tillwise.session import build_session, scratch_path  # noqa: E402
from tillwise.sources.star import load_star, write_star  # noqa: E402
from tillwise.sources.trade import TradeTables, trade_star  # noqa: E402

FROM_RAW = ["aggregate_payments", "clean_customers", "revenue_trends", "order_funnel"]

FROM_STAR = [
    "v_monthly_revenue",
    "revenue_trends",
    "v_churn_risk",
    "rfm_base",
    "rfm_summary",
    "cohort_retention",
    "v_category_performance",
    "top_categories",
    "v_seller_risk",
    "seller_delivery",
    "kpi_summary",
    "churn_features",
    "churn_by_sentiment",
    "insight_report",
    "weekly_revenue",
    "stratified_split",
    "classification_metrics",
    "forecast_revenue",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.shuffle.partitions": cpus,
        "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
    }
    spark = build_session("bench", f"local[{cpus}]", **conf)
    spark.sparkContext.setLogLevel("ERROR")
    queries, raw, times = catalog(), TradeTables(spark, folder), {}

    def timed(name: str, run, count: int = runs + 1) -> None:
        taken = []
        for _ in range(count):
            start = time.perf_counter()
            run()
            taken.append(time.perf_counter() - start)
        times[name] = round(median(taken[1:] or taken), 3)
        print(f"{name:28s} {times[name]:8.3f}", file=sys.stderr, flush=True)

    def drain(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    stored = scratch_path(spark)
    timed("etl_star", lambda: write_star(trade_star(raw), stored), 2)
    star = load_star(spark, stored)
    for name in FROM_RAW:
        timed(f"raw:{name}", lambda: drain(queries[name](spark, folder)))
    for name in FROM_STAR:
        timed(name, lambda: drain(on_star(name, spark, folder, star)))
    spark.stop()
    total = round(sum(times.values()), 3)
    scale = Path(folder).name.removeprefix("sf")
    print(
        json.dumps(
            {"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": scale}
        )
    )


if __name__ == "__main__":
    main()
