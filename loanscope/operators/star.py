"""Star schema export (OP24), BI measures (OP25) and report tables (OP27).

The fact table is the three-way book projected to its published columns.
Dimensions are distinct values of the fact (dates, states) or fixed literal
tables (grades, state names/regions: 51 and 7 rows, so broadcasting them is
bounded by construction).

Measures follow the BI definitions: they are *fractions* (not percents),
``DIVIDE(a, b, alt)`` returns ``alt`` on a zero or missing denominator, and
time intelligence (previous month / year) looks up the true calendar month,
so a month without a predecessor gets MoM 0 and YoY = current rate.
All measures are rounded exactly to 6 places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import exact_ratio
from .kpis import month_index, to_output

# --------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# --------------------------------------------------------------------------
# State code -> (name, region); unknown codes keep the code and get "Other".
STATES = {
    "AL": ("Alabama", "South"), "AK": ("Alaska", "West"), "AZ": ("Arizona", "West"),
    "AR": ("Arkansas", "South"), "CA": ("California", "West"), "CO": ("Colorado", "West"),
    "CT": ("Connecticut", "Northeast"), "DE": ("Delaware", "South"), "FL": ("Florida", "South"),
    "GA": ("Georgia", "South"), "HI": ("Hawaii", "West"), "ID": ("Idaho", "West"),
    "IL": ("Illinois", "Midwest"), "IN": ("Indiana", "Midwest"), "IA": ("Iowa", "Midwest"),
    "KS": ("Kansas", "Midwest"), "KY": ("Kentucky", "South"), "LA": ("Louisiana", "South"),
    "ME": ("Maine", "Northeast"), "MD": ("Maryland", "South"), "MA": ("Massachusetts", "Northeast"),
    "MI": ("Michigan", "Midwest"), "MN": ("Minnesota", "Midwest"), "MS": ("Mississippi", "South"),
    "MO": ("Missouri", "Midwest"), "MT": ("Montana", "West"), "NE": ("Nebraska", "Midwest"),
    "NV": ("Nevada", "West"), "NH": ("New Hampshire", "Northeast"), "NJ": ("New Jersey", "Northeast"),
    "NM": ("New Mexico", "West"), "NY": ("New York", "Northeast"), "NC": ("North Carolina", "South"),
    "ND": ("North Dakota", "Midwest"), "OH": ("Ohio", "Midwest"), "OK": ("Oklahoma", "South"),
    "OR": ("Oregon", "West"), "PA": ("Pennsylvania", "Northeast"), "RI": ("Rhode Island", "Northeast"),
    "SC": ("South Carolina", "South"), "SD": ("South Dakota", "Midwest"), "TN": ("Tennessee", "South"),
    "TX": ("Texas", "South"), "UT": ("Utah", "West"), "VT": ("Vermont", "Northeast"),
    "VA": ("Virginia", "South"), "WA": ("Washington", "West"), "WV": ("West Virginia", "South"),
    "WI": ("Wisconsin", "Midwest"), "WY": ("Wyoming", "West"), "DC": ("District of Columbia", "South"),
}
# Grade dimension: (grade, grade_name, risk_tier, subprime_flag).
GRADES = [
    ("A", "Grade A - Prime Super", "Prime", 0),
    ("B", "Grade B - Prime Standard", "Prime", 0),
    ("C", "Grade C - Near Prime", "Near-Prime", 0),
    ("D", "Grade D - Core Subprime", "Subprime", 1),
    ("E", "Grade E - Moderate Subprime", "Subprime", 1),
    ("F", "Grade F - Speculative Subprime", "Subprime", 1),
    ("G", "Grade G - Deep Subprime", "Subprime", 1),
]
# Columns of the fact table, and which are whole numbers or text.
FACT_COLUMNS = [
    "loan_id", "borrower_id", "issue_date", "issue_month", "issue_year", "grade", "addr_state",
    "loan_amnt", "funded_amnt", "term_months", "int_rate", "installment", "purpose", "loan_status",
    "is_default", "is_delinquent", "is_fully_funded", "total_pymnt", "total_rec_prncp",
    "total_rec_int", "recoveries", "collection_recovery_fee", "charged_off_principal",
]
FACT_INTS = ["issue_year", "term_months", "is_default", "is_delinquent", "is_fully_funded"]
FACT_STRINGS = ["loan_id", "borrower_id", "issue_date", "issue_month", "grade", "addr_state",
                "purpose", "loan_status"]
# --------------------------------------------------------------------------


def fact_loans(book: DataFrame, exact: bool = False) -> DataFrame:
    """OP24 fact table: the three-way join, ``term_months`` from the term text."""
    df = book.select(
        "loan_id", "borrower_id", F.col("issue_date").cast("string").alias("issue_date"), "issue_month",
        "issue_year", "grade", "addr_state", "loan_amnt", "funded_amnt",
        X.term_months_prefix(F.col("term")).alias("term_months"), "int_rate", "installment", "purpose",
        "loan_status", "is_default", "is_delinquent", "is_fully_funded", "total_pymnt", "total_rec_prncp",
        "total_rec_int", "recoveries", "collection_recovery_fee", "charged_off_principal",
        *([c for c in ("verification_status",) if c in book.columns] if exact else []),
    )
    if exact:
        return df
    return to_output(df, keep=FACT_STRINGS, ints=FACT_INTS)


def dim_borrower(borrowers: DataFrame) -> DataFrame:
    """OP24 borrower dimension (verification status lower-cased)."""
    df = borrowers.select(
        "borrower_id", "emp_length", "home_ownership", "annual_inc",
        F.lower("verification_status").alias("verification_status"), "dti", "fico_range_low",
        "revol_util", "open_acc", "total_acc")
    return to_output(df, keep=["borrower_id", "emp_length", "home_ownership", "verification_status"],
                     ints=["open_acc", "total_acc"])


def dim_date(fact: DataFrame) -> DataFrame:
    """OP24 date dimension over the distinct issue dates of the fact."""
    d = fact.select(F.to_date("issue_date").alias("d")).where(F.col("d").isNotNull()).distinct()
    q = F.quarter("d")
    return d.select(
        F.col("d").cast("string").alias("date"),
        F.year("d").cast("bigint").alias("year"),
        F.concat(F.lit("Q"), q.cast("string")).alias("quarter"),
        F.concat(F.lit("Q"), q.cast("string"), F.lit("-"), F.year("d").cast("string")).alias("quarter_year"),
        F.date_format("d", "MMMM").alias("month_name"),
        F.date_format("d", "MMM-yyyy").alias("month_year"),
        F.month("d").cast("bigint").alias("month_number"),
        F.date_format("d", "yyyy-MM").alias("year_month"),
    )


def state_lookup(spark: SparkSession) -> DataFrame:
    rows = [(k, v[0], v[1]) for k, v in STATES.items()]
    return spark.createDataFrame(rows, "addr_state string, state_name string, region string")


def dim_geography(fact: DataFrame) -> DataFrame:
    """OP24 / JN4: states of the fact with name and region (defaults: code, ``Other``)."""
    states = fact.select("addr_state").where(F.col("addr_state").isNotNull()).distinct()
    lk = F.broadcast(state_lookup(fact.sparkSession))  # 51 fixed rows
    j = states.join(lk, "addr_state", "left")
    return j.select("addr_state", F.coalesce("state_name", "addr_state").alias("state_name"),
                    F.coalesce("region", F.lit("Other")).alias("region"))


def dim_loan_grade(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(GRADES, "grade string, grade_name string, risk_tier string, subprime_flag bigint")


def graded_loans(loans: DataFrame) -> DataFrame:
    """The grade dimension, all seven rows, with how many loans each grade has."""
    # seven rows against a handful of grades
    counts = loans.groupBy("grade").agg(F.count(F.lit(1)).cast("bigint").alias("loan_count"))
    return dim_loan_grade(loans.sparkSession).join(counts, "grade", "left").withColumn("loan_count", F.coalesce("loan_count", F.lit(0).cast("bigint")))


def star_schema(book: DataFrame, borrowers: DataFrame) -> dict[str, DataFrame]:
    """OP24: the five star tables as lazy DataFrames."""
    fact = fact_loans(book)
    return {
        "fact_loans": fact,
        "dim_borrower": dim_borrower(borrowers),
        "dim_date": dim_date(fact),
        "dim_geography": dim_geography(fact),
        "dim_loan_grade": dim_loan_grade(book.sparkSession),
    }


def export_star(tables: dict[str, DataFrame], path: str) -> None:
    """SNK3: one headed CSV folder per table."""
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/')}/{name}")


# ---- measures --------------------------------------------------------------

def _divide(a: Column, b: Column, alt) -> Column:
    """DIVIDE(a, b, alt) rounded to 6 places."""
    return F.coalesce(exact_ratio(a, b, 6), F.lit(alt).cast("decimal(38,6)"))


def _additive(df: DataFrame, keys) -> DataFrame:
    """Additive partial sums per key (safe to re-aggregate)."""
    unv = (F.col("verification_status") == "not verified").cast("int")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("is_default").alias("n_def"),
        F.sum("is_delinquent").alias("n_del"),
        F.sum("funded_amnt").alias("funded"),
        F.sum("loan_amnt").alias("requested"),
        F.sum(F.col("funded_amnt") * F.col("int_rate")).alias("funded_x_rate"),
        F.sum("charged_off_principal").alias("charged_off"),
        F.sum("recoveries").alias("rec"),
        F.sum("collection_recovery_fee").alias("fees"),
        F.sum(unv).alias("n_unv"),
    )


SUMS = ["n", "n_def", "n_del", "funded", "requested", "funded_x_rate", "charged_off", "rec", "fees", "n_unv"]


def _measures(n_months: Column, n_states: Column) -> dict:
    c = F.col
    return {
        "default_rate": _divide(c("n_def"), c("n"), 0),
        "delinquency_rate": _divide(c("n_del"), c("n"), 0),
        "weighted_apr": _divide(c("funded_x_rate"), c("funded"), 0),
        "funding_fulfillment_rate": _divide(c("funded"), c("requested"), 1),
        "total_funded_volume": c("funded"),
        "total_applications": c("n"),
        "gross_charged_off_principal": c("charged_off"),
        "net_recovery_rate": _divide(c("rec"), c("charged_off"), 0),
        "collection_cost_ratio": _divide(c("fees"), c("rec"), 0),
        "net_recovered_cash": c("rec") - c("fees"),
        "regional_throughput": _divide(c("funded"), n_months * n_states, 0),
        "backlog_share": _divide(c("n_unv"), c("n"), 0),
    }


def star_book(book: DataFrame) -> DataFrame:
    """Fact rows carrying the borrower dimension's lower-cased verification status."""
    return book.withColumn("verification_status", F.lower("verification_status"))


def dax_measures(book: DataFrame, by: str | list[str]) -> DataFrame:
    """OP25: the BI measures grouped by ``by`` (e.g. ``"grade"`` or ``"addr_state"``).

    Distinct months and states per group come from a two-level aggregation
    (group x month x state partial sums first), not a row-level count-distinct.
    """
    keys = [by] if isinstance(by, str) else list(by)
    df = star_book(book)
    inner = [k for k in dict.fromkeys(keys + ["issue_month", "addr_state"])]
    part = _additive(df, inner)
    sums = [F.sum(s).alias(s) for s in SUMS]
    g = part.groupBy(*keys).agg(*sums, F.countDistinct("issue_month").alias("n_months"),
                                F.countDistinct("addr_state").alias("n_states"))
    m = _measures(F.col("n_months"), F.col("n_states"))
    res = g.select(*keys, *[v.alias(k) for k, v in m.items()])
    res = res.withColumn("risk_adjusted_spread", F.col("weighted_apr") - F.col("default_rate") * 100)
    return to_output(res, keep=keys, ints=["total_applications"])


def dax_measures_by_month(book: DataFrame) -> DataFrame:
    """OP25 by month, with calendar MoM volume growth and YoY default delta (JN6)."""
    df = star_book(book)
    part = _additive(df, ["issue_month", "addr_state"])
    g = part.groupBy("issue_month").agg(*[F.sum(s).alias(s) for s in SUMS], F.count(F.lit(1)).alias("n_states"))
    m = _measures(F.lit(1), F.col("n_states"))
    res = g.select("issue_month", *[v.alias(k) for k, v in m.items()]) \
        .withColumn("_mi", month_index(F.col("issue_month")))
    # one row per month: the ordered window sees months, not loans
    w1 = Window.orderBy("_mi").rangeBetween(-1, -1)
    w12 = Window.orderBy("_mi").rangeBetween(-12, -12)
    prev_vol = F.first("total_funded_volume").over(w1)
    prev_def = F.first("default_rate").over(w12)
    res = res.select(
        "*",
        F.coalesce(exact_ratio(F.col("total_funded_volume") - prev_vol, prev_vol, 6),
                   F.lit(0).cast("decimal(38,6)")).alias("mom_volume_growth"),
        (F.col("default_rate") - F.coalesce(prev_def, F.lit(0))).alias("yoy_default_rate_delta"),
        (F.col("weighted_apr") - F.col("default_rate") * 100).alias("risk_adjusted_spread"),
    ).drop("_mi")
    return to_output(res, keep=["issue_month"], ints=["total_applications"])


def cohort_matrix(book: DataFrame, years: list[int] | None = None) -> DataFrame:
    """OP27 / AGG19: grade x home ownership x year: default rate (fraction) and charge-offs.

    ``years`` pivots these years into columns (given, so no job looks for them).
    """
    g = book.groupBy("grade", "home_ownership", "issue_year").agg(
        _divide(F.sum("is_default"), F.count(F.lit(1)), 0).alias("default_rate"),
        F.sum("charged_off_principal").alias("gross_charged_off_principal"),
    )
    if years:
        return (g.groupBy("grade", "home_ownership").pivot("issue_year", list(years))
                .agg(F.first("default_rate").cast("double").alias("default_rate"),
                     F.first("gross_charged_off_principal").cast("double").alias("gross_charged_off_principal")))
    return to_output(g, keep=["grade", "home_ownership"], ints=["issue_year"])


def collections_funnel(book: DataFrame) -> DataFrame:
    """OP27 / AGG20: charge-offs -> recoveries -> net recovered cash, one row per stage."""
    a = book.agg(F.sum("charged_off_principal").alias("co"), F.sum("recoveries").alias("rec"),
                 F.sum("collection_recovery_fee").alias("fees"))
    def stage(i, level, amount):
        return F.struct(F.lit(i).cast("bigint").alias("stage"), F.lit(level).alias("level"),
                        amount.cast("double").alias("amount"))
    rows = F.array(stage(1, "Gross Charged Off Principal", F.col("co")),
                   stage(2, "Recoveries", F.col("rec")),
                   stage(3, "Net Recovered Cash", F.col("rec") - F.col("fees")))
    return a.select(F.inline(rows))


def state_efficiency(book: DataFrame) -> DataFrame:
    """OP27 efficiency table: per state throughput, unverified share, default rate."""
    m = dax_measures(book, "addr_state")
    return m.select("addr_state", F.col("regional_throughput").alias("processing_throughput"),
                    F.col("backlog_share").alias("unverified_share"), "default_rate")


def star_report(fact: DataFrame, dim_geo: DataFrame, dim_grade: DataFrame) -> DataFrame:
    """JN5: fact joined to its geography and grade dimensions; measures by region and risk tier.

    The grade dimension is a fixed 7-row table and is broadcast. The
    geography dimension is derived from the data (distinct states), so its
    join is left to AQE, which broadcasts it only when its runtime size is
    under the threshold and keeps the shuffle join otherwise.
    """
    j = fact.join(dim_geo.select("addr_state", "region"), "addr_state", "left") \
        .join(F.broadcast(dim_grade.select("grade", "risk_tier")), "grade", "left")
    g = j.groupBy("region", "risk_tier").agg(
        F.count(F.lit(1)).alias("loans"),
        F.sum("funded_amnt").alias("total_funded_volume"),
        _divide(F.sum("is_default"), F.count(F.lit(1)), 0).alias("default_rate"),
        _divide(F.sum(F.col("funded_amnt") * F.col("int_rate")), F.sum("funded_amnt"), 0).alias("weighted_apr"),
    )
    return to_output(g, keep=["region", "risk_tier"], ints=["loans"])


def star_report_full(fact: DataFrame, borrowers: DataFrame, dates: DataFrame, geo: DataFrame, grades: DataFrame) -> DataFrame:
    """JN5 over all four dimensions: measures by year, region, risk tier and verification status.

    The borrower and date joins are shuffle joins (dates and states may be broadcast by AQE
    once their size is known); the fixed grade table is broadcast.
    """
    j = (fact.select("issue_date", "addr_state", "grade", "borrower_id", "funded_amnt", "is_default")
         .join(borrowers.select("borrower_id", "verification_status"), "borrower_id", "left")
         .join(dates.select(F.col("date").alias("issue_date"), "year"), "issue_date", "left")
         .join(geo.select("addr_state", "region"), "addr_state", "left")
         .join(F.broadcast(grades.select("grade", "risk_tier")), "grade", "left"))
    g = j.groupBy("year", "region", "risk_tier", "verification_status").agg(
        F.count(F.lit(1)).alias("loans"), F.sum("funded_amnt").alias("total_funded_volume"),
        _divide(F.sum("is_default"), F.count(F.lit(1)), 0).alias("default_rate"))
    return to_output(g, keep=["region", "risk_tier", "verification_status"], ints=["year", "loans"])
