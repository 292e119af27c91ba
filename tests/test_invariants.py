"""The reference suite's invariants, on the driver tables (sf0.001) and sf0.01."""

from loanscope.operators import crisis, forecast, kpis, validate, whatif

SF01 = "/root/testdata/sf0.01"


def test_tables_exist_and_validate(spark, book):
    rollup = kpis.monthly_kpi_rollup(book.book(), exact=True)
    rep = validate.validate(book.loans(), book.borrowers(), book.payments(), rollup).collect()
    assert all(r.passed for r in rep), [r for r in rep if not r.passed]
    assert book.loans().count() > 1000 and book.borrowers().count() > 100


def test_monthly_kpis_in_range(spark, book):
    r = kpis.monthly_kpi_rollup(book.book()).collect()
    assert r and all(0 <= x.default_rate <= 100 and x.funding_fulfillment_rate >= 50 for x in r)


def test_crisis_is_worse_than_baseline(spark):
    from loanscope.plans.book import loan_book
    c = crisis.crisis_analysis(loan_book(spark, SF01).book()).first()
    assert c.crisis_default_rate > c.post_crisis_default_rate
    assert c.default_rate_multiple >= 2.0


def test_forecast_twelve_rows(spark, book):
    f = forecast.holt_forecast(kpis.monthly_kpi_rollup(book.book(), exact=True))
    assert f.count() == 12


def test_ratios_hold_for_a_trillion_loans(spark):
    """The scenario stages on totals of 1e12 loans, against exact fractions."""
    from decimal import Decimal
    from fractions import Fraction

    from pyspark.sql import functions as F

    def rounded(x, digits):
        scaled = abs(x) * 10 ** digits
        q = (2 * scaled.numerator + scaled.denominator) // (2 * scaled.denominator)
        return Decimal(q if x >= 0 else -q).scaleb(-digits)

    bn, bdef, n, dflt = 10 ** 12 + 7, 123_456_789_012, 7 * 10 ** 11 + 3, 45_678_901_234
    bvol, vol, bloss, loss = (Decimal(v) / 100 for v in (2 * 10 ** 18 + 11, 15 * 10 ** 17 + 7, 10 ** 17 + 3, 4 * 10 ** 16 + 1))
    row = spark.createDataFrame([(bn, bdef, n, dflt, bvol, vol, bloss, loss)],
                                "bn long, bdef long, n long, dflt long, bvol decimal(38,2), vol decimal(38,2), bloss decimal(38,2), loss decimal(38,2)")
    c = F.col
    r = whatif._chain(row, whatif._uw_metrics(c("n"), c("vol"), c("dflt"), c("loss"), c("bn"), c("bvol"), c("bdef"), c("bloss"))).first()
    assert r.sim_default_rate_pct == rounded(Fraction(100 * dflt, n), 2)
    assert r["_dd6"] == rounded(100 * (Fraction(dflt, n) - Fraction(bdef, bn)), 6)
    assert r["_vc6"] == rounded(100 * Fraction(vol - bvol) / Fraction(bvol), 6)
    unv = 4 * 10 ** 11 + 9
    row = spark.createDataFrame([(bn, unv, bloss)], "total long, n_unv long, unv_loss decimal(38,2)")
    r = whatif._chain(row, whatif._verification_stages(F.lit(Decimal("30.0")), F.lit(Decimal("35.0")))).first()
    converted = int(unv * Fraction(30, 100))
    saved = Fraction(bloss) * converted * Fraction(16, 100) / unv
    assert r.converted_loans_count == converted and r.credit_losses_saved == rounded(saved, 2)
    assert r.net_economic_benefit == rounded(saved - converted * 35, 2)
    assert r.unverified_share_pct == rounded(Fraction(100 * unv, bn), 2)


def test_all_scenarios_take_one_pass_over_payments(spark, book):
    plans = []
    seen = whatif.materialize

    def written(df, name):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return seen(df, name)

    whatif.materialize = written
    try:
        rows = whatif.run_all_scenarios(book.loans_with_payments(), book.borrowers().drop("borrower_id"), book.loans()).collect()
    finally:
        whatif.materialize = seen
    assert len(plans) == 1 and plans[0].count("l_orderkey#") > 0 and plans[0].count("Join ") == 2
    one = {(r.scenario_name, r.metric): r.value for r in rows}
    for df in (whatif.what_if_underwriting(book.book()), whatif.what_if_verification(book.book()), whatif.what_if_pricing(book.loans_with_payments()),
               whatif.what_if_collections(book.loans_with_payments()), whatif.what_if_funding(book.loans())):
        r = df.first().asDict()
        assert all(one[r["scenario_name"], k] == v for k, v in r.items() if k not in ("scenario_name", "recommendation"))


def test_scenarios(spark, book):
    s1 = whatif.what_if_underwriting(book.book(), min_fico=680, max_dti=30.0).first()
    assert s1.sim_default_rate_pct < s1.baseline_default_rate_pct
    s2 = whatif.what_if_pricing(book.loans_with_payments(), bps=200).first()
    assert s2.net_yield_delta is not None
    s4 = whatif.what_if_collections(book.loans_with_payments(), 20.0, 15.0).first()
    assert s4.sim_recovery_rate_pct > s4.baseline_recovery_rate_pct
    s5 = whatif.what_if_verification(book.book(), 25.0).first()
    assert s5.credit_losses_saved > 0
