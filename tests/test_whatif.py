from decimal import Decimal

from pyspark.sql import functions as F

from loanscope.operators import whatif

SCHEMA = ("loan_id string, loan_status string, grade string, loan_amnt decimal(18,2), funded_amnt decimal(18,2), "
          "int_rate decimal(6,2), is_default int, charged_off_principal decimal(18,2), recoveries decimal(18,2), "
          "collection_recovery_fee decimal(18,2), fico_range_low int, dti decimal(6,2), verification_status string")


def book(spark, rows=None):
    D = Decimal
    rows = rows or [
        ("1", "Fully Paid", "A", D(1000), D(1000), D("7.00"), 0, D(0), D(0), D(0), 740, D("10.00"), "Verified"),
        ("2", "Charged Off", "D", D(2000), D(1900), D("15.00"), 1, D(1140), D(100), D(18), 640, D("30.00"), "Not Verified"),
        ("3", "Default", "G", D(3000), D(3000), D("25.00"), 1, D(1800), D(50), D(9), 550, D("40.00"), "Not Verified"),
        ("4", "Current", "C", D(500), D(400), D("12.00"), 0, D(0), D(0), D(0), 670, D("20.00"), "Verified"),
        ("5", "Fully Paid", "B", D(0), D(0), D("9.00"), 0, D(0), D(0), D(0), 700, D("5.00"), "Source Verified"),
    ]
    return spark.createDataFrame(rows, SCHEMA)


def test_underwriting_no_loan_kept(spark):
    r = whatif.what_if_underwriting(book(spark), min_fico=900, max_dti=1).first()
    assert r.sim_loan_count == 0 and r.sim_default_rate_pct == 0.0
    assert r.volume_change_pct == -100.0
    assert r.recommendation.startswith("Caution")


def test_underwriting_tightening_lowers_default_rate(spark):
    r = whatif.what_if_underwriting(book(spark), min_fico=680, max_dti=30).first()
    assert r.sim_default_rate_pct < r.baseline_default_rate_pct
    assert r.baseline_loan_count == 4  # resolved only


def test_underwriting_sweep_matches_single_runs(spark):
    b = book(spark)
    sw = {(r.min_fico, r.max_dti): r for r in
          whatif.underwriting_sweep(b, fico_grid=[600, 650, 700], dti_grid=[5, 10, 30]).collect()}
    assert len(sw) == 9
    for (f, d), r in sw.items():
        one = whatif.what_if_underwriting(b, min_fico=int(f), max_dti=float(d)).first()
        assert (r.sim_loan_count, r.sim_funded_volume, r.sim_default_rate_pct, r.losses_saved_dollars) == \
            (one.sim_loan_count, one.sim_funded_volume, one.sim_default_rate_pct, one.losses_saved_dollars)


def test_pricing_factor_and_verdicts(spark):
    for bps in (-300, 0, 150):
        r = whatif.what_if_pricing(book(spark), bps=bps).first()
        assert r.apr_delta_bps == bps
        f = whatif._pricing_factor(bps)
        assert abs(r.sim_expected_losses - round(r.baseline_expected_losses * float(f), 2)) < 0.011
    assert whatif._pricing_factor(-300) == Decimal("0.976") and whatif._pricing_factor(-2000) == Decimal("0.9")
    sw = {r.apr_delta_bps: r for r in whatif.pricing_sweep(book(spark), [-300, 0, 150]).collect()}
    assert sw[150].net_yield_delta == whatif.what_if_pricing(book(spark), bps=150).first().net_yield_delta


def test_funding_zero_requested_never_qualifies(spark):
    r = whatif.what_if_funding(book(spark), threshold=95.0).first()
    assert r.total_applications == 5
    assert r.cancelled_loans_count == 2  # the 80 % loan and the zero-request loan
    sw = {r.min_fulfillment_threshold_pct: r for r in whatif.funding_sweep(book(spark), [80, 95, 100]).collect()}
    assert sw[95.0].qualified_loans_count == r.qualified_loans_count
    assert sw[80.0].qualified_loans_count == 4


def test_collections_zero_recoveries(spark):
    b = book(spark).withColumn("recoveries", F.lit(Decimal(0)).cast("decimal(18,2)")) \
        .withColumn("collection_recovery_fee", F.lit(Decimal(0)).cast("decimal(18,2)"))
    r = whatif.what_if_collections(b, 25.0, 16.0).first()
    assert r.sim_gross_recoveries == 0.0 and r.net_cash_uplift_pct == 0.0
    up = whatif.what_if_collections(book(spark), 20.0, 15.0).first()
    assert up.sim_recovery_rate_pct > up.baseline_recovery_rate_pct


def test_verification_without_unverified_loans(spark):
    b = book(spark).withColumn("verification_status", F.lit("Verified"))
    r = whatif.what_if_verification(b, 30.0, 35.0).first()
    assert r.converted_loans_count == 0 and r.credit_losses_saved == 0.0
    r2 = whatif.what_if_verification(book(spark), 50.0, 35.0).first()
    assert r2.converted_loans_count == 1 and r2.credit_losses_saved > 0
