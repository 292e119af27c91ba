"""Named queries: each callable takes (spark, sf_dir) and returns a lazy DataFrame.

Every query reads the driver tables through the loan book, so its work grows
with the tables. Rollups, trends and star reports read the written book (``kept_book``).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import materialize, new_folder
from ..operators import classifier, crisis, drivers, forecast, increments, kpis, scorecard, star, sweeps, treetable, trends, validate, whatif
from ..sources.store import Store, inputs_digest
from .book import loan_book

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


@query("monthly_kpi_rollup")
def _monthly_kpi_rollup(spark, sf):
    return kpis.monthly_kpi_rollup(loan_book(spark, sf).kept_book())


@query("monthly_kpi_by_grade")
def _monthly_kpi_by_grade(spark, sf):
    return kpis.monthly_kpi_rollup(loan_book(spark, sf).kept_book(), segment="grade")


@query("grade_quality")
def _grade_quality(spark, sf):
    return kpis.grade_quality(loan_book(spark, sf).loans_with_borrowers())


@query("collections_by_grade")
def _collections_by_grade(spark, sf):
    return kpis.collections_by_grade(loan_book(spark, sf).loans_with_payments())


@query("state_capacity")
def _state_capacity(spark, sf):
    return kpis.state_capacity(loan_book(spark, sf).loans_with_borrowers())


@query("yearly_stress")
def _yearly_stress(spark, sf):
    return kpis.yearly_stress_output(loan_book(spark, sf).kept_book())


@query("grade_cohorts")
def _grade_cohorts(spark, sf):
    coh = kpis.grade_cohorts(loan_book(spark, sf).loans())
    return kpis.to_output(coh, keep=["grade"], ints=["issue_year", "total_loans"])


@query("grade_cohort_means")
def _grade_cohort_means(spark, sf):
    return kpis.grade_cohort_means(loan_book(spark, sf).loans())


@query("state_throughput_topn")
def _state_throughput_topn(spark, sf):
    return kpis.state_throughput_topn(loan_book(spark, sf).loans_with_borrowers(), top_n=10)


@query("state_month_throughput")
def _state_month_throughput(spark, sf):
    return kpis.state_month_throughput(loan_book(spark, sf).loans_with_borrowers())


def _rollup(spark, sf, segment=None):
    return kpis.monthly_kpi_rollup(loan_book(spark, sf).kept_book(), segment=segment, exact=True)


@query("monthly_trends")
def _monthly_trends(spark, sf):
    t = trends.monthly_trends(_rollup(spark, sf))
    return kpis.to_output(t, keep=["metric_month"], ints=["total_applications"])


@query("degraded_alerts")
def _degraded_alerts(spark, sf):
    return trends.detect_degraded(_rollup(spark, sf))


@query("crisis_yearly")
def _crisis_yearly(spark, sf):
    return crisis.crisis_yearly(loan_book(spark, sf).kept_book())


@query("crisis_analysis")
def _crisis_analysis(spark, sf):
    return crisis.crisis_analysis(loan_book(spark, sf).kept_book())


@query("latest_vs_previous")
def _latest_vs_previous(spark, sf):
    return scorecard.latest_vs_previous(_rollup(spark, sf))


@query("kpi_scorecard")
def _kpi_scorecard(spark, sf):
    return scorecard.kpi_scorecard(_rollup(spark, sf))


@query("whatif_underwriting")
def _whatif_underwriting(spark, sf):
    return whatif.what_if_underwriting(loan_book(spark, sf).book(), min_fico=660, max_dti=35.0)


@query("whatif_underwriting_sweep")
def _whatif_underwriting_sweep(spark, sf):
    return whatif.underwriting_sweep(loan_book(spark, sf).book())


@query("whatif_pricing")
def _whatif_pricing(spark, sf):
    return whatif.what_if_pricing(loan_book(spark, sf).loans_with_payments(), bps=150)


@query("whatif_pricing_sweep")
def _whatif_pricing_sweep(spark, sf):
    return whatif.pricing_sweep(loan_book(spark, sf).loans_with_payments())


@query("whatif_funding")
def _whatif_funding(spark, sf):
    return whatif.what_if_funding(loan_book(spark, sf).loans(), threshold=95.0)


@query("whatif_funding_sweep")
def _whatif_funding_sweep(spark, sf):
    return whatif.funding_sweep(loan_book(spark, sf).loans())


@query("whatif_collections")
def _whatif_collections(spark, sf):
    return whatif.what_if_collections(loan_book(spark, sf).loans_with_payments(), uplift=25.0, fee=16.0)


@query("whatif_collections_sweep")
def _whatif_collections_sweep(spark, sf):
    return whatif.collections_sweep(loan_book(spark, sf).loans_with_payments())


@query("whatif_verification")
def _whatif_verification(spark, sf):
    return whatif.what_if_verification(loan_book(spark, sf).book(), pct=30.0, cost=35.0)


@query("whatif_verification_sweep")
def _whatif_verification_sweep(spark, sf):
    return whatif.verification_sweep(loan_book(spark, sf).book())


@query("whatif_all_scenarios")
def _whatif_all(spark, sf):
    b = loan_book(spark, sf)
    return whatif.run_all_scenarios(b.loans_with_payments(), b.borrowers().drop("borrower_id"), b.loans())


def _scattered(spark, sf):
    """A setting per borrower, on no grid."""
    k = F.col("borrower_key")
    return loan_book(spark, sf).borrowers().select(
        k.alias("setting"), (550 + k * 37 % 200 + k % 2 * F.lit(0.5)).cast("decimal(18,2)").alias("min_fico"),
        (k * 131 % 5100 / 100).cast("decimal(18,2)").alias("max_dti"), (80 + k * 7 % 2100 / 100).cast("decimal(18,2)").alias("threshold"))


@query("whatif_underwriting_settings")
def _whatif_underwriting_settings(spark, sf):
    r = sweeps.sweep("underwriting", _scattered(spark, sf).drop("threshold"), loan_book(spark, sf).kept_book())
    return r.withColumns({c: F.col(c).cast("double") for c in ("min_fico", "max_dti")})


@query("whatif_funding_settings")
def _whatif_funding_settings(spark, sf):
    r = sweeps.sweep("funding", _scattered(spark, sf).select("setting", "threshold"), loan_book(spark, sf).loans())
    return r.withColumn("threshold", F.col("threshold").cast("double"))


@query("monthly_kpi_calendar")
def _monthly_kpi_calendar(spark, sf):
    return kpis.monthly_kpi_rollup(loan_book(spark, sf).kept_book(), calendar=True)


@query("fact_loans")
def _fact_loans(spark, sf):
    return star.fact_loans(loan_book(spark, sf).kept_book())


@query("dim_borrower")
def _dim_borrower(spark, sf):
    return star.dim_borrower(loan_book(spark, sf).borrowers())


@query("dim_date")
def _dim_date(spark, sf):
    return star.dim_date(star.fact_loans(loan_book(spark, sf).kept_book(), exact=True))


@query("dim_geography")
def _dim_geography(spark, sf):
    return star.dim_geography(star.fact_loans(loan_book(spark, sf).kept_book(), exact=True))


@query("dim_loan_grade")
def _dim_loan_grade(spark, sf):
    return star.graded_loans(loan_book(spark, sf).loans())


@query("dax_measures_by_month")
def _dax_by_month(spark, sf):
    return star.dax_measures_by_month(loan_book(spark, sf).kept_book())


@query("dax_measures_by_grade")
def _dax_by_grade(spark, sf):
    return star.dax_measures(loan_book(spark, sf).kept_book(), "grade")


@query("state_efficiency")
def _state_efficiency(spark, sf):
    return star.state_efficiency(loan_book(spark, sf).kept_book())


@query("cohort_matrix")
def _cohort_matrix(spark, sf):
    return star.cohort_matrix(loan_book(spark, sf).kept_book())


@query("collections_funnel")
def _collections_funnel(spark, sf):
    return star.collections_funnel(loan_book(spark, sf).kept_book())


@query("validate_tables")
def _validate_tables(spark, sf):
    b = loan_book(spark, sf)
    rollup = kpis.monthly_kpi_rollup(b.kept_book(), exact=True)
    floors = {"loans": 100, "borrowers": 10, "payments_recoveries": 100}
    return validate.validate(b.loans(), b.borrowers(), b.payments(), rollup, floors, loan="loan_key", borrower="borrower_key")


CLEAN_COLUMNS = ["loan_id", "issue_month", "issue_year", "loan_amnt", "funded_amnt", "funded_amnt_inv",
                 "term", "int_rate", "installment", "grade", "sub_grade", "purpose", "loan_status",
                 "is_default", "is_delinquent", "is_fully_funded", "home_ownership", "verification_status",
                 "addr_state", "fico_range_low", "fico_range_high", "dti", "revol_util", "annual_inc",
                 "emp_length", "total_rec_prncp", "recoveries", "charged_off_principal"]


@query("clean_raw_loans")
def _clean_raw_loans(spark, sf):
    from .book import raw_text_rows
    from .etl import clean_loans
    from ..sources.raw import valid_rows
    raw = valid_rows(raw_text_rows(loan_book(spark, sf).book()))
    wide = clean_loans(raw)
    df = wide.select(*CLEAN_COLUMNS, F.col("issue_date").cast("string").alias("issue_date"))
    return _cleaned(df)


_CLEAN_TEXT = ["loan_id", "borrower_id", "issue_month", "term", "grade", "sub_grade", "purpose", "loan_status", "home_ownership",
               "verification_status", "addr_state", "emp_length", "issue_date", "last_pymnt_d"]


def _cleaned(df):
    return kpis.to_output(df, keep=[c for c in df.columns if c in _CLEAN_TEXT],
                          ints=[c for c in ("issue_year", "is_default", "is_delinquent", "is_fully_funded") if c in df.columns])


def _raw_rows(spark, sf):
    """The raw rows with faults, in files ordered by position, as a stand-in for delivered files.

    The position is the loan key: rows are put in order before they become wide text.
    """
    from .book import dirty_raw_rows
    book = loan_book(spark, sf)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = lambda raw: raw.repartitionByRange(n, "o_orderkey").sortWithinPartitions("o_orderkey")
    return Store(spark).table("raw_rows", book.inputs(), lambda: dirty_raw_rows(book.dealt_book(ordered)))


def _etl_tables(spark, sf):
    """The three tables; the cleaned rows are written once for all of them."""
    from .etl import FILES, clean_loans, tables_of
    from ..sources.raw import valid_rows, with_place
    wide = lambda: clean_loans(valid_rows(with_place(_raw_rows(spark, sf))), order_by=FILES)
    return tables_of(Store(spark).table("etl_wide", loan_book(spark, sf).inputs(), wide))


@query("etl_loans")
def _etl_loans(spark, sf):
    return _cleaned(_etl_tables(spark, sf).loans.withColumn("issue_date", F.col("issue_date").cast("string")))


@query("etl_borrowers")
def _etl_borrowers(spark, sf):
    return _cleaned(_etl_tables(spark, sf).borrowers)


@query("etl_payments")
def _etl_payments(spark, sf):
    return _cleaned(_etl_tables(spark, sf).payments)


@query("etl_repeated_rows")
def _etl_repeated_rows(spark, sf):
    """SET3: rows delivered twice (every third) and thrice (every ninth) are one borrower each, known by the row's hash."""
    from .book import BORROWER_COLUMNS, raw_text_rows
    from .etl import etl
    from ..sources.raw import valid_rows
    raw = raw_text_rows(loan_book(spark, sf).book(), keep=["loan_key"])
    times = F.lit(1) + sum(F.when(F.col("loan_key") % n == 0, 1).otherwise(0) for n in (3, 9))
    rows = raw.withColumn("_times", times).withColumn("_time", F.explode(F.sequence(F.lit(1), "_times"))).drop("loan_key", "_times", "_time")
    t = etl(valid_rows(rows), columns=[*BORROWER_COLUMNS, "loan_id"])
    ids = t.loans.groupBy("borrower_id").agg(F.min("loan_id").alias("loan_id"), F.count(F.lit(1)).alias("deliveries"))
    return _cleaned(t.borrowers.join(ids, "borrower_id").drop("borrower_id")).withColumn("deliveries", F.col("deliveries").cast("bigint"))


@query("rejected_rows")
def _rejected_rows(spark, sf):
    from ..sources.raw import rejected_rows
    return rejected_rows(_raw_rows(spark, sf)).select(F.col("_pos").alias("position"), "id", "loan_amnt", "issue_d", "reason")


def _batched_sums(spark, sf):
    """The book's sums in batches: three quarters first, a quarter as a late file that is delivered twice, first wrongly."""
    book, path = loan_book(spark, sf).kept_book(), new_folder(spark, "month-sums")
    late = F.col("loan_key") % 4 == 0
    increments.start_sums(book.where(~late), path)
    increments.apply_batch(spark, path, book.where(late | (F.col("loan_key") % 4 == 1)), "late")
    increments.apply_batch(spark, path, book.where(late), "late")
    return increments.read_sums(spark, path)


@query("incremental_rollup")
def _incremental_rollup(spark, sf):
    r = increments.rollup_of(_batched_sums(spark, sf), exact=True)
    return kpis.to_output(r, keep=["metric_month"], ints=["total_applications"])


@query("borrower_reach")
def _borrower_reach(spark, sf):
    """AGG17: exact distinct borrowers by state beside the merged monthly sketches' estimate."""
    estimate = increments.borrowers_of(_batched_sums(spark, sf), ["addr_state"]).withColumnRenamed("borrowers", "estimate")
    exact = loan_book(spark, sf).kept_book().groupBy("addr_state").agg(F.countDistinct("borrower_key").alias("borrowers"))
    within = F.abs(F.col("estimate") - F.col("borrowers")) <= F.greatest(F.lit(1.0), 0.065 * F.col("borrowers"))
    return exact.join(estimate, "addr_state").select("addr_state", "borrowers", within.alias("estimate_within_4_sigma"))


@query("bucketed_rollup")
def _bucketed_rollup(spark, sf):
    from .buckets import bucketed_book
    return kpis.monthly_kpi_rollup(bucketed_book(loan_book(spark, sf)))


@query("raw_round_trip")
def _raw_round_trip(spark, sf):
    """Raw files of two layouts, one with line ends inside cells: written, read by default, merged, written and read again."""
    from .book import dirty_raw_rows
    from ..sources import raw as R
    at = F.col("_pos")
    broken = F.concat("emp_length", F.lit('\n"self", reported'))
    rows = dirty_raw_rows(loan_book(spark, sf).book()).withColumn("emp_length", F.when(at % 30 == 0, broken).otherwise(F.col("emp_length")))
    folder = new_folder(spark, "raw-files")
    R.write_merged(rows.where(at % 3 == 0), f"{folder}/a")
    R.write_merged(rows.where(at % 3 != 0), f"{folder}/b", R.TARGET_COLUMNS[::-1])
    R.write_merged(R.read_raw_loans(spark, [f"{folder}/a", f"{folder}/b"]), f"{folder}/merged")
    kept = ["id", "loan_amnt", "int_rate", "issue_d", "emp_length", "purpose", "verification_status", "addr_state", "dti", "recoveries"]
    return R.read_merged(spark, f"{folder}/merged").select(*[F.coalesce(c, F.lit("")).alias(c) for c in kept])


# ---- ML, forecasting, sampling, presentation ---------------------------------

@query("loan_features")
def _loan_features(spark, sf):
    f = classifier.loan_features(loan_book(spark, sf).loans_with_borrowers())
    return f.withColumn("annual_inc", F.round("annual_inc", 8)).withColumn("is_default", F.col("is_default").cast("bigint"))


@query("sampled_loans")
def _sampled_loans(spark, sf):
    lb = classifier.resolved(loan_book(spark, sf).loans_with_borrowers())
    s = classifier.sample_rows(lb, 2000, seed=42)
    return s.select("loan_id", F.col("is_default").cast("bigint").alias("is_default"), "grade",
                    F.col("int_rate").cast("double").alias("int_rate"))


@query("stratified_split")
def _stratified_split(spark, sf):
    lb = classifier.resolved(loan_book(spark, sf).loans_with_borrowers())
    return classifier.split_flag(lb.select("loan_id", F.col("is_default").cast("bigint").alias("is_default")))


@query("score_metrics")
def _score_metrics(spark, sf):
    lb = classifier.resolved(loan_book(spark, sf).loans_with_borrowers())
    scored = lb.select((F.col("int_rate") / 100).cast("double").alias("score"), "is_default")
    return classifier.evaluate_scores(scored, "score", "is_default", threshold=0.15)


def _driver_frame(spark, sf):
    lb = loan_book(spark, sf).loans_with_borrowers()
    # every 11th purpose is missing, as in real files
    return drivers.driver_frame(lb.withColumn("purpose", F.when(F.col("loan_key") % 11 != 0, F.col("purpose"))))


@query("driver_correlations")
def _driver_correlations(spark, sf):
    return drivers.driver_correlations(_driver_frame(spark, sf))


@query("driver_directions")
def _driver_directions(spark, sf):
    return drivers.driver_directions(_driver_frame(spark, sf))


@query("driver_gini")
def _driver_gini(spark, sf):
    return drivers.ranked_drivers(_driver_frame(spark, sf))


@query("root_cause")
def _root_cause(spark, sf):
    return drivers.root_cause_report(loan_book(spark, sf).kept_book(), _driver_frame(spark, sf))


@query("risk_tiers")
def _risk_tiers(spark, sf):
    k = F.col("loan_key") % 9
    percent = F.col("int_rate").cast("double") * 2
    for i, v in enumerate((4.996, 5.0, 11.996, 12.0, 21.996, 22.0, 34.996, 35.0)):
        percent = F.when(k == i, F.lit(v)).otherwise(percent)
    tiers = classifier.with_risk_tier(loan_book(spark, sf).loans(), percent)
    return tiers.select("loan_id", "default_probability_pct", "risk_tier", "underwriting_recommendation")


@query("score_request_defaults")
def _score_request_defaults(spark, sf):
    lb = loan_book(spark, sf).loans_with_borrowers()
    k = F.col("loan_key")
    gaps = {"int_rate": 5, "annual_inc": 7, "grade": 3, "fico_range_low": 4}
    asked = lb.select("loan_key", "loan_id", "loan_amnt", "term", "installment", "dti", "revol_util",
                      *[F.when(k % n != 0, F.col(c)).alias(c) for c, n in gaps.items()])
    d = classifier.score_defaults(asked)
    return d.select("loan_id", "grade", *[F.col(c).cast("double").alias(c) for c in (
        "loan_amnt", "term_months", "int_rate", "installment", "annual_inc", "dti", "fico_range_low", "revol_util", "open_acc")])


@query("driver_importance")
def _driver_importance(spark, sf):
    return drivers.driver_importance(drivers.driver_frame(loan_book(spark, sf).loans_with_borrowers()))


_MODELS: dict[tuple, classifier.ClassifierBundle] = {}


def _model(spark, sf) -> classifier.ClassifierBundle:
    """The default classifier of the tables in ``sf``, trained once per session and state of their files."""
    key = (spark.sparkContext.applicationId, inputs_digest(spark, loan_book(spark, sf).inputs()))
    if key not in _MODELS:
        feats = materialize(classifier.loan_features(loan_book(spark, sf).dealt_loans_with_borrowers()), "loan-features")
        _MODELS[key] = classifier.train_default_classifier(feats)
    return _MODELS[key]


@query("default_scores")
def _default_scores(spark, sf):
    b = loan_book(spark, sf)
    bundle = _model(spark, sf)
    apps = classifier.resolved(b.dealt_loans_with_borrowers()).select(
        "loan_id", "loan_amnt", "term", "int_rate", "installment", "grade", "annual_inc", "dti",
        "fico_range_low", "revol_util", "open_acc", "verification_status", "home_ownership")
    return classifier.score_loans(bundle.model, apps).select(
        "loan_id", "default_probability_pct", "risk_tier", "underwriting_recommendation")


@query("tabled_model_scores")
def _tabled_model_scores(spark, sf):
    """Every loan scored by the small fixed model, from its table."""
    path = new_folder(spark, "tree-table")
    treetable.save_model(spark, treetable.SMALL_MODEL, path)
    apps = loan_book(spark, sf).loans_with_borrowers().select(
        "loan_id", "loan_amnt", "term", "int_rate", "installment", "grade", "annual_inc", "dti",
        "fico_range_low", "revol_util", "open_acc", "verification_status", "home_ownership")
    return treetable.score_loans(treetable.load_model(spark, path), apps).select(
        "loan_id", "default_probability_pct", "risk_tier", "underwriting_recommendation")


@query("classifier_metrics")
def _classifier_metrics(spark, sf):
    return _model(spark, sf).metrics


@query("linear_trend_forecast")
def _linear_trend_forecast(spark, sf):
    return forecast.linear_forecast(_rollup(spark, sf), volume_floor=forecast.VOLUME_FLOOR)


@query("linear_trend_forecast_by_grade")
def _linear_trend_forecast_by_grade(spark, sf):
    return forecast.linear_forecast(_rollup(spark, sf, "grade"), segment="grade")


@query("holt_forecast")
def _holt_forecast(spark, sf):
    return forecast.holt_forecast(_rollup(spark, sf), volume_floor=forecast.VOLUME_FLOOR)


@query("holt_forecast_by_grade")
def _holt_forecast_by_grade(spark, sf):
    return forecast.holt_forecast(_rollup(spark, sf, "grade"), segment="grade")


@query("holt_fixed_by_grade_state")
def _holt_fixed_by_grade_state(spark, sf):
    monthly = loan_book(spark, sf).kept_book().groupBy("grade", "addr_state", F.col("issue_month").alias("metric_month")).agg(
        X.pct_of_rows(F.col("is_default")).alias("default_rate"), F.sum("funded_amnt").alias("total_funded_volume"))
    return forecast.holt_forecast(monthly, segment=["grade", "addr_state"], grid=[(0.45, 0.2, 0.92)])


@query("holt_fitted_forecast")
def _holt_fitted_forecast(spark, sf):
    return forecast.fitted_forecast(_rollup(spark, sf), volume_floor=forecast.VOLUME_FLOOR)


@query("holt_fitted_by_grade")
def _holt_fitted_by_grade(spark, sf):
    """Histories of 5 (grade A) to 29 (G) months: the shorter ones are forecast by a line."""
    r = _rollup(spark, sf, "grade")
    months = 1 + 4 * F.instr(F.lit("ABCDEFG"), F.col("grade"))
    first = F.min("metric_month").over(Window.partitionBy("grade"))
    gone = F.months_between(F.to_date(F.concat("metric_month", F.lit("-01"))), F.to_date(F.concat(first, F.lit("-01"))))
    return forecast.fitted_forecast(r.withColumn("_gone", gone).where(F.col("_gone") < months), segment="grade")


@query("annuity_instalment")
def _annuity_instalment(spark, sf):
    l = loan_book(spark, sf).loans()
    return l.select("loan_id", F.col("funded_amnt").cast("double").alias("funded_amnt"),
                    F.col("int_rate").cast("double").alias("int_rate"),
                    F.col("term_months").cast("bigint").alias("term_months"),
                    F.round(X.annuity(F.col("funded_amnt"), F.col("int_rate"), F.col("term_months")), 2)
                    .alias("monthly_instalment"))


@query("formatted_kpis")
def _formatted_kpis(spark, sf):
    r = _rollup(spark, sf)
    return r.select("metric_month",
                    X.format_currency_exact(F.col("total_funded_volume")).alias("funded_volume_text"),
                    X.format_currency_exact(F.col("total_charged_off_prncp")).alias("charged_off_text"),
                    X.format_currency_exact(F.col("total_recoveries")).alias("recoveries_text"),
                    X.format_percent_exact(F.col("default_rate")).alias("default_rate_text"),
                    X.format_percent_exact(F.col("mom_volume_growth_pct")).alias("mom_growth_text"))


@query("distinct_states")
def _distinct_states(spark, sf):
    return kpis.distinct_states(loan_book(spark, sf).borrowers())


@query("monthly_kpi_rollup_states")
def _monthly_kpi_rollup_states(spark, sf):
    book = kpis.filter_states(loan_book(spark, sf).kept_book(), ["CA", "NY", "TX"])
    return kpis.monthly_kpi_rollup(book)


@query("star_report")
def _star_report(spark, sf):
    fact = star.fact_loans(loan_book(spark, sf).kept_book(), exact=True)
    return star.star_report(fact, star.dim_geography(fact), star.dim_loan_grade(spark))


@query("star_report_full")
def _star_report_full(spark, sf):
    b = loan_book(spark, sf)
    fact = star.fact_loans(b.kept_book(), exact=True)
    return star.star_report_full(fact, star.dim_borrower(b.borrowers()), star.dim_date(fact), star.dim_geography(fact), star.dim_loan_grade(spark))


@query("star_export_round_trip")
def _star_export_round_trip(spark, sf):
    """SNK3: the star tables as headed CSV folders; the fact table read back from its own."""
    b, path = loan_book(spark, sf), new_folder(spark, "star")
    tables = star.star_schema(b.kept_book(), b.borrowers())
    star.export_star(tables, path)
    return spark.read.schema(tables["fact_loans"].schema).option("header", True).csv(f"{path}/fact_loans")


@query("cohort_matrix_wide")
def _cohort_matrix_wide(spark, sf):
    book = loan_book(spark, sf).kept_book()
    # issue years number tens
    years = sorted(r[0] for r in book.select("issue_year").where("issue_year IS NOT NULL").distinct().collect())
    return star.cohort_matrix(book, years=years)


@query("kpi_scorecard_window")
def _kpi_scorecard_window(spark, sf):
    return scorecard.kpi_scorecard(_rollup(spark, sf), "1994-01", "1996-06")
