from decimal import Decimal

from pyspark.sql import functions as F

from loanscope.operators import kpis, scorecard, trends

BOOK_SCHEMA = ("issue_month string, loan_id string, loan_amnt decimal(18,2), funded_amnt decimal(18,2), "
               "int_rate decimal(6,2), is_default int, is_delinquent int, charged_off_principal decimal(18,2), "
               "recoveries decimal(18,2), collection_recovery_fee decimal(18,2), verification_status string, "
               "grade string")


def make_book(spark, months):
    rows = []
    for i, m in enumerate(months):
        for j in range(4):
            d = 1 if (i + j) % 3 == 0 else 0
            rows.append((m, f"{i}-{j}", Decimal(1000 + 10 * i), Decimal(1000 + 10 * i - (5 if j == 0 else 0)),
                         Decimal("10.00") + i, d, d, Decimal(100 * d), Decimal(10 * d), Decimal("1.80") * d,
                         "Not Verified" if j == 0 else "Verified", "A"))
    return spark.createDataFrame(rows, BOOK_SCHEMA)


def test_row_lag_vs_calendar_lag_over_a_gap(spark):
    months = [f"2011-{m:02d}" for m in range(1, 13)] + ["2015-01", "2015-02", "2015-03"]
    book = make_book(spark, months)
    row = {r.metric_month: r for r in kpis.monthly_kpi_rollup(book).collect()}
    cal = {r.metric_month: r for r in kpis.monthly_kpi_rollup(book, calendar=True).collect()}
    # 2015-01: the row lag compares with 2011-12, the calendar lag finds no 2014-12
    assert row["2015-01"].mom_volume_growth_pct is not None
    assert cal["2015-01"].mom_volume_growth_pct is None
    # YoY by rows compares 2015-01 with the row 12 back (2011-04); by calendar with 2014-01 (missing)
    assert row["2015-01"].yoy_volume_growth_pct is not None and cal["2015-01"].yoy_volume_growth_pct is None
    assert row["2011-01"].mom_volume_growth_pct is None
    vols = [row[m].total_funded_volume for m in ("2011-01", "2011-02", "2011-03")]
    assert row["2011-03"].rolling_3m_avg_funded_volume == round(sum(vols) / 3, 2) == 4035.0


def test_rollup_zero_denominators_become_zero(spark):
    book = make_book(spark, ["2020-01"]).withColumn("recoveries", F.lit(Decimal(0)).cast("decimal(18,2)")) \
        .withColumn("charged_off_principal", F.lit(Decimal(0)).cast("decimal(18,2)"))
    r = kpis.monthly_kpi_rollup(book).first()
    assert r.net_recovery_rate == 0.0 and r.collection_cost_ratio == 0.0


ROLLUP_SCHEMA = ("metric_month string, mom_default_rate_delta decimal(38,2), default_rate decimal(38,2), "
                 "funding_fulfillment_rate decimal(38,2), unverified_backlog_share decimal(38,2), "
                 "total_funded_volume decimal(38,2)")


def test_alert_rules_and_severity(spark):
    D = Decimal
    rows = [
        ("m01", D("2.00"), D("10.00"), D("99.00"), D("10.00"), D(1)),   # surge at threshold -> WARNING
        ("m02", D("5.00"), D("10.00"), D("99.00"), D("10.00"), D(1)),   # 5.0 is not > 5 -> WARNING
        ("m03", D("5.01"), D("10.00"), D("99.00"), D("10.00"), D(1)),   # CRITICAL
        ("m04", D("0.00"), D("17.99"), D("99.00"), D("10.00"), D(1)),   # nothing
        ("m05", D("0.00"), D("18.00"), D("99.00"), D("10.00"), D(1)),   # severe -> CRITICAL
        ("m06", D("0.00"), D("10.00"), D("94.90"), D("10.00"), D(1)),   # fulfilment -> WARNING
        ("m07", D("0.00"), D("10.00"), D("95.00"), D("10.00"), D(1)),   # nothing
        ("m08", D("0.00"), D("10.00"), D("99.00"), D("60.00"), D(1)),   # nothing (strict >)
        ("m09", D("0.00"), D("10.00"), D("99.00"), D("60.10"), D(1)),   # INFO
        ("m10", None, D("10.00"), D("99.00"), D("10.00"), D(1)),        # NULL delta never fires
        ("m11", D("2.50"), D("10.00"), D("90.00"), D("70.00"), D(1)),   # WARNING, three reasons
    ]
    df = spark.createDataFrame(rows, ROLLUP_SCHEMA)
    got = {r.metric_month: r for r in trends.detect_degraded(df).collect()}
    assert sorted(got) == ["m01", "m02", "m03", "m05", "m06", "m09", "m11"]
    assert [got[m].severity for m in ["m01", "m02", "m03", "m05", "m06", "m09", "m11"]] == \
        ["WARNING", "WARNING", "CRITICAL", "CRITICAL", "WARNING", "INFO", "WARNING"]
    assert got["m01"].issues_flagged == "Default rate surged +2.00% MoM (reached 10.0%)"
    assert got["m06"].issues_flagged == "Funding fulfillment fell to 94.9% (target >= 95.0%)"
    assert got["m11"].issues_flagged.count("; ") == 2


def test_trends_rolling_means_start_with_one_month(spark):
    df = make_book(spark, ["2020-01", "2020-02", "2020-03", "2020-04"])
    t = trends.monthly_trends(kpis.monthly_kpi_rollup(df, exact=True)).orderBy("metric_month").collect()
    assert t[0].rolling_3m_default_rate == t[0].default_rate
    assert t[3].rolling_3m_volume == round(sum(r.total_funded_volume for r in t[1:4]) / 3, 2)


def test_scorecard_has_twelve_rows_and_latest_delta(spark):
    df = make_book(spark, ["2020-01", "2020-02", "2020-03"])
    ro = kpis.monthly_kpi_rollup(df, exact=True)
    sc = {r.kpi_id: r for r in scorecard.kpi_scorecard(ro).collect()}
    assert sorted(sc) == list(range(1, 13))
    lv = scorecard.latest_vs_previous(ro).first()
    assert lv.latest_month == "2020-03" and lv.previous_month == "2020-02"
    assert sc[1].delta == lv.default_rate_delta
    assert sc[10].value == 4.0  # 12 applications over 3 months


def _rollup_rows(spark, series):
    from decimal import Decimal
    rows = [(s, f"{2001 + i // 12}-{i % 12 + 1:02d}", None if r is None else Decimal(str(round(r, 2))), Decimal(str(round(v, 2))))
            for s, values in series.items() for i, (r, v) in enumerate(values)]
    return spark.createDataFrame(rows, "grade string, metric_month string, default_rate decimal(10,2), total_funded_volume decimal(18,2)")


def _error(y, a, b, p):
    level, trend, e = y[0], y[1] - y[0], 0.0
    for x in y[1:]:
        ahead = level + p * trend
        e += (x - ahead) ** 2
        new = a * x + (1 - a) * ahead
        trend = b * (new - level) + (1 - b) * p * trend
        level = new
    return e


def test_fitted_holt_is_never_worse_than_the_grid(spark):
    import math
    import random

    from pyspark.sql import functions as F

    from loanscope.operators import forecast
    rng = random.Random(7)
    series = {f"S{k}": [8 + math.sin(i / (2 + k)) * 3 + rng.gauss(0, 0.5 * k) + 0.05 * i for i in range(12 + 9 * k)] for k in range(4)}
    df = spark.createDataFrame(list(series.items()), "s string, y array<double>").withColumn("n", F.size("y"))
    n = F.col("n")
    grid = forecast.X.lit_structs(forecast.holt_grid(), [("a", "double"), ("b", "double"), ("p", "double")])
    df = df.withColumn("grid", forecast._best_of(F.col("y"), n, grid)).withColumn("fit", F.col("grid"))
    for i in range(forecast.ROUNDS):
        df = df.withColumn("fit", forecast._descended(F.col("y"), n, F.col("fit"), tuple(h * 0.5 ** i for h in forecast.DESCENT_STEPS)))
    better = 0
    for r in df.collect():
        assert r.grid.e == min(_error(r.y, *t) for t in forecast.holt_grid())
        assert abs(r.fit.e - _error(r.y, r.fit.a, r.fit.b, r.fit.p)) < 1e-9 and r.fit.e <= r.grid.e
        assert 0.01 <= r.fit.a <= 1 and 0 <= r.fit.b <= r.fit.a and 0.8 <= r.fit.p <= 0.98
        better += r.fit.e < r.grid.e
    assert better >= 3


def test_series_that_cannot_be_fitted_get_the_line(spark):
    from loanscope.operators import forecast
    steady = [(5 + 0.1 * i, 2e6 + 1e4 * i) for i in range(14)]
    gap = [(None if i == 6 else r, v) for i, (r, v) in enumerate(steady)]
    df = _rollup_rows(spark, {"long": steady, "short": steady[:4], "gap": gap, "one": steady[:1]})
    got = {}
    for r in forecast.fitted_forecast(df, segment="grade").collect():
        got.setdefault(r.grade, {})[r.step] = r
    assert set(got) == {"long", "short", "gap"} and all(len(v) == 12 for v in got.values())
    assert {(g, v[1].rate_method, v[1].volume_method) for g, v in got.items()} == {
        ("long", "damped_holt", "damped_holt"), ("short", "linear_trend", "linear_trend"), ("gap", "linear_trend", "damped_holt")}
    assert got["short"][3].forecast_default_rate == 5.6 and got["short"][3].forecast_funded_volume == 2060000.0
    assert got["gap"][1].forecast_default_rate == 6.4 and got["long"][1].metric_month == "2002-03"
