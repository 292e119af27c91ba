"""Benchmark the headline queries.

Runs each query on ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) with
``local[$BENCH_CPUS]`` and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Each query runs to completion through the ``noop`` sink (full execution, no
collect) three times, and the median counts; queries that train a model run
once. Untimed warm-up queries load the JVM classes and touch all tables first.

Rollups, trends and star reports read the written book (kept for 600 s under a key
of the input files), so their times are without the three-way join; writing
the book is timed on its own as ``book_written``.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time
from statistics import median

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)

HEADLINE = [
    "monthly_kpi_rollup", "grade_quality", "collections_by_grade", "state_capacity", "yearly_stress",
    "monthly_trends", "degraded_alerts", "crisis_analysis", "kpi_scorecard",
    "whatif_underwriting", "whatif_pricing", "whatif_funding", "whatif_collections", "whatif_verification",
    "whatif_all_scenarios", "whatif_underwriting_sweep", "whatif_pricing_sweep", "fact_loans", "dax_measures_by_month",
    "validate_tables", "etl_loans", "sampled_loans", "stratified_split", "score_metrics", "driver_correlations",
    "linear_trend_forecast", "holt_forecast", "holt_forecast_by_grade",
    "holt_fitted_forecast", "driver_gini", "tabled_model_scores", "whatif_underwriting_settings", "whatif_funding_settings",
    "bucketed_rollup", "incremental_rollup", "raw_round_trip",
]
#: Timed once: a model is trained within.
ONCE = ["driver_importance", "default_scores"]
RUNS = 3


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from loanscope.plans.catalog import QUERIES
    from loanscope.session import get_session

    spark = get_session(f"local[{cpus}]", app_name="loanscope-bench", shuffle_partitions=int(cpus))
    names = [n for n in (sys.argv[1:] or HEADLINE + ONCE) if n in QUERIES]

    def run(n: str) -> float:
        t0 = time.perf_counter()
        QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    from loanscope.plans.book import loan_book

    run("grade_quality")  # warm-up, with the three-way join
    loan_book(spark, sf_dir).book().write.format("noop").mode("overwrite").save()
    t0 = time.perf_counter()
    loan_book(spark, sf_dir).kept_book()
    written = round(time.perf_counter() - t0, 3)
    for n in ("monthly_kpi_rollup", "fact_loans"):
        run(n)
    times = {"book_written": written} | {n: round(median(run(n) for _ in range(1 if n in ONCE else RUNS)), 3) for n in names}
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(m.group(1)) if m else sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
