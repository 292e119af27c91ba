from decimal import Decimal

from pyspark.sql import functions as F

from loanscope.functions import exprs as X


def one(spark, col, schema=None, data=None):
    df = spark.createDataFrame(data or [(1,)], schema or "x int")
    return df.select(col.alias("v")).collect()


def test_exact_ratio_rounds_half_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (3, 8), (201, 20000), (5, 0), (None, 3)], "n long, d long")
    got = [r.v for r in df.select(X.exact_ratio(F.col("n"), F.col("d"), 2, 100).alias("v")).collect()]
    assert got == [Decimal("12.50"), Decimal("-12.50"), Decimal("37.50"), Decimal("1.01"), None, None]


def test_exact_ratio_high_scale_inputs(spark):
    df = spark.createDataFrame([(Decimal("1.00000005"), Decimal("3"))], "n decimal(20,8), d decimal(20,0)")
    v = df.select(X.exact_ratio(F.col("n"), F.col("d"), 8).alias("v")).first().v
    assert v == Decimal("0.33333335")


def test_status_flags(spark):
    statuses = ["Fully Paid", "Current", "Charged Off", "Default", "Late (16-30 days)", "Late (31-120 days)",
                "In Grace Period", "Does not meet the credit policy. Status:Charged Off", None]
    df = spark.createDataFrame([(s,) for s in statuses], "s string").select(X.clean_status(F.col("s")).alias("s"))
    got = df.select("s", X.default_flag(F.col("s")).alias("d"), X.delinquent_flag(F.col("s")).alias("q")).collect()
    assert [(r.d, r.q) for r in got] == [(0, 0), (0, 0), (1, 0), (1, 1), (0, 1), (0, 1), (0, 1), (1, 0), (0, 0)]
    assert got[-1].s == "Unknown"


def test_parse_issue_date_formats(spark):
    df = spark.createDataFrame([("Dec-2011",), (" 2015-03-17 ",), ("bad",), (None,), ("13-2011",)], "s string")
    got = [r.v for r in df.select(X.parse_issue_date(F.col("s")).alias("v")).collect()]
    assert [str(v) if v else None for v in got] == ["2011-12-01", "2015-03-01", None, None, None]


def test_clean_numeric(spark):
    df = spark.createDataFrame([("$1,000",), ("13.5%",), ("abc",), (None,), (" 7 ",), ("nan",)], "s string")
    assert [r.v for r in df.select(X.clean_numeric(F.col("s")).alias("v")).collect()] == [1000.0, 13.5, 0.0, 0.0, 7.0, 0.0]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (-1.0,), (70.0,), (20.0,)], "x double")
    assert [r.v for r in df.select(X.clip(F.col("x"), 0.0, 50.0).alias("v")).collect()] == [None, 0.0, 50.0, 20.0]


def test_format_currency_tiers(spark):
    vals = [None, 999.5, 1000.0, 1e6, 1e9, -2.5e6]
    df = spark.createDataFrame([(v,) for v in vals], "x double")
    got = [r.v for r in df.select(X.format_currency(F.col("x")).alias("v")).collect()]
    assert got == ["$0", "$999.50", "$1.0K", "$1.00M", "$1.00B", "$-2.50M"]
    exact = [r.v for r in df.select(X.format_currency_exact(F.col("x").cast("decimal(20,2)")).alias("v")).collect()]
    assert exact == ["$0", "$999.50", "$1.0K", "$1.00M", "$1.00B", "$-2.50M"]
    pct = [r.v for r in df.select(X.format_percent(F.col("x")).alias("v")).collect()]
    assert pct[0] == "0.00%" and pct[2] == "1000.00%"


def test_risk_tiers(spark):
    df = spark.createDataFrame([(4.99,), (5.0,), (12.0,), (22.0,), (35.0,)], "p double")
    tier, action = X.risk_tier(F.col("p"))
    got = [r.t for r in df.select(tier.alias("t")).collect()]
    assert got == ["Prime (Low Risk)", "Near-Prime (Moderate Risk)", "Subprime (Elevated Risk)",
                   "High Risk", "Critical Default Risk"]


def test_annuity(spark):
    df = spark.createDataFrame([(12000.0, 11.5, 36), (1200.0, 0.0, 12)], "p double, r double, n int")
    got = [round(r.v, 2) for r in df.select(X.annuity(F.col("p"), F.col("r"), F.col("n")).alias("v")).collect()]
    assert got == [395.71, 100.0]


def test_grade_maps(spark):
    df = spark.createDataFrame([("A",), ("G",), ("c",), (None,)], "g string")
    got = [(r.f, r.c) for r in df.select(X.grade_fico(F.col("g")).alias("f"), X.grade_code(F.col("g")).alias("c")).collect()]
    assert got == [(740, 1), (550, 7), (660, 4), (660, 4)]
