"""The batch job that publishes everything, stage by stage.

Each stage writes its result as Parquet (or CSV for the star export) under
``out_dir`` and the next stage reads the written table back, so a lost
executor only recomputes the current stage, and the monthly rollup is
computed once and read by every report built on it (as the reference reads
its rollup table). ``out_dir`` must be shared storage on a cluster.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..operators import classifier, crisis, kpis, scorecard, star, trends, validate, whatif
from ..sources.sinks import write_rollup, write_table
from .book import PAYMENT_COLUMNS, loan_book


def publish_all(spark: SparkSession, sf_dir: str, out_dir: str, model_iterations: int = 120) -> dict[str, str]:
    """Write tables, rollup, reports, star schema and model; returns name -> path."""
    out = out_dir.rstrip("/")
    paths: dict[str, str] = {}

    def put(name: str, df, rollup: bool = False) -> str:
        p = f"{out}/{name}"
        (write_rollup if rollup else write_table)(df, p)
        paths[name] = p
        return p

    b = loan_book(spark, sf_dir)
    # stage 1: the normalised tables (SNK1); joins start from the written ones
    loans = spark.read.parquet(put("loans", b.loans()))
    borrowers = spark.read.parquet(put("borrowers", b.borrowers()))
    paid = spark.read.parquet(put("loans_with_payments", b.loans_with_payments()))
    payments = spark.read.parquet(put("payments_recoveries", paid.select("loan_key", *PAYMENT_COLUMNS)))
    people = borrowers.drop("borrower_id")
    book = spark.read.parquet(put("book", paid.join(people, "borrower_key")))
    lent = spark.read.parquet(put("loans_with_borrowers", loans.join(people, "borrower_key")))

    # stage 2: the exact monthly rollup, written once (SNK2)
    rollup = spark.read.parquet(put("monthly_kpi_rollup", kpis.monthly_kpi_rollup(book, exact=True), rollup=True))

    # stage 3: reports built on the written tables
    put("monthly_trends", trends.monthly_trends(rollup))
    put("degraded_alerts", trends.detect_degraded(rollup))
    put("kpi_scorecard", scorecard.kpi_scorecard(rollup))
    put("grade_quality", kpis.grade_quality(lent))
    put("collections_by_grade", kpis.collections_by_grade(paid))
    put("state_capacity", kpis.state_capacity(lent))
    put("crisis_analysis", crisis.crisis_analysis(book))
    put("scenarios", whatif.run_all_scenarios(paid, people, loans))
    put("validation", validate.validate(loans, borrowers, payments, rollup))

    # stage 4: star schema as headed CSV (SNK3)
    tables = star.star_schema(book, borrowers)
    star.export_star(tables, f"{out}/star")
    paths["star"] = f"{out}/star"

    # stage 5: classifier, saved for later scoring (SNK4)
    feats = classifier.loan_features(lent)
    bundle = classifier.train_default_classifier(feats, max_iter=model_iterations, path=f"{out}/model",
                                                 force_retrain=True)
    put("model_metrics", bundle.metrics)
    paths["model"] = f"{out}/model"
    return paths
