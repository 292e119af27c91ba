import os
import tempfile

from pyspark.ml import PipelineModel

from loanscope.operators import classifier
from loanscope.plans.catalog import QUERIES
from loanscope.plans.jobs import publish_all

SF = "/root/testdata/sf0.001"


def test_publish_all_writes_every_stage_and_a_loadable_model(spark):
    out = tempfile.mkdtemp(prefix="loanscope-job-")
    paths = publish_all(spark, SF, out, model_iterations=3)
    for name in ["loans", "borrowers", "payments_recoveries", "monthly_kpi_rollup", "degraded_alerts",
                 "kpi_scorecard", "scenarios", "validation", "model_metrics"]:
        assert spark.read.parquet(paths[name]).count() > 0, name
    assert all(r.passed for r in spark.read.parquet(paths["validation"]).collect())
    assert sorted(os.listdir(paths["star"])) == ["dim_borrower", "dim_date", "dim_geography", "dim_loan_grade",
                                                  "fact_loans"]
    # a published report equals the registered query of its name
    for name in ("grade_quality", "collections_by_grade", "state_capacity", "crisis_analysis"):
        a, b = spark.read.parquet(paths[name]), QUERIES[name](spark, SF)
        assert sorted(map(repr, a.select(*sorted(a.columns)).collect())) == sorted(map(repr, b.select(*sorted(b.columns)).collect())), name
    model = PipelineModel.load(paths["model"])
    book = spark.read.parquet(paths["book"])
    scored = classifier.score_loans(model, book.limit(20))
    assert scored.where("default_probability_pct BETWEEN 0 AND 100").count() == 20
    # SNK4: a saved model is loaded instead of retrained
    again = classifier.train_default_classifier(classifier.loan_features(book), path=paths["model"])
    assert again.model.stages[-1].uid == model.stages[-1].uid
