"""SQL KPI operators (OP2-OP6, OP26, AGG13, AGG23).

Each takes the loan book (or one of its partial joins) and returns a lazy
DataFrame. All aggregations are hash aggregations with a partial
(map-side) phase, so a hot month, grade or state costs one partial row per
task before the shuffle. Windows run only after aggregation, on rows that
number months or states, never on loan-grain rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import exact_mean, exact_ratio, out, pct_of_rows


def _seg(segment) -> list[str]:
    if segment is None:
        return []
    return [segment] if isinstance(segment, str) else list(segment)


def month_index(month: Column) -> Column:
    """``YYYY-MM`` -> year*12 + month, for calendar (not row) offsets."""
    return (F.substring(month, 1, 4).cast("int") * 12 + F.substring(month, 6, 2).cast("int"))


def monthly_base(book: DataFrame, segment=None) -> DataFrame:
    """AGG1: monthly counts, volumes and ratios (exact decimals, not yet rounded for output)."""
    seg = _seg(segment)
    return (book.groupBy(*seg, F.col("issue_month").alias("metric_month")).agg(
        F.count("loan_id").alias("total_applications"),
        F.sum("loan_amnt").alias("total_requested_volume"),
        F.sum("funded_amnt").alias("total_funded_volume"),
        exact_mean(F.col("int_rate")).alias("avg_interest_rate"),
        pct_of_rows(F.col("is_default")).alias("default_rate"),
        pct_of_rows(F.col("is_delinquent")).alias("delinquency_rate"),
        exact_ratio(F.sum("funded_amnt"), F.sum("loan_amnt"), mult=100).alias("funding_fulfillment_rate"),
        F.sum("charged_off_principal").alias("total_charged_off_prncp"),
        F.sum("recoveries").alias("total_recoveries"),
        exact_ratio(F.sum("recoveries"), F.sum("charged_off_principal"), mult=100).alias("net_recovery_rate"),
        exact_ratio(F.sum("collection_recovery_fee"), F.sum("recoveries"), mult=100).alias("collection_cost_ratio"),
        pct_of_rows(X.unverified_flag(F.col("verification_status"))).alias("unverified_backlog_share"),
    ))


def _prior(col: str, w, k: int, calendar: bool, seg: list[str]) -> Column:
    if not calendar:
        return F.lag(col, k).over(w)
    # JN6: value of the month exactly k calendar months earlier (NULL if missing)
    wc = Window.partitionBy(*seg).orderBy("_mi").rangeBetween(-k, -k)
    return F.first(col).over(wc)


def monthly_kpi_rollup(book: DataFrame, segment=None, calendar: bool = False,
                       exact: bool = False) -> DataFrame:
    """OP2: monthly rollup with MoM / YoY deltas and a 3-row rolling mean.

    ``segment`` (a column or list, e.g. ``"grade"``) computes one series per
    segment value; the windows then partition by it. ``calendar=True`` takes
    MoM/YoY against the true previous calendar month/year instead of the
    previous row (the reference's ``LAG`` counts rows, so gaps shift it).
    ``exact=True`` keeps decimals (for chaining); otherwise doubles.
    """
    return with_trends(monthly_base(book, segment), segment, calendar, exact)


def with_trends(base: DataFrame, segment=None, calendar: bool = False, exact: bool = False) -> DataFrame:
    """The rollup of a monthly base: windows over months, never over loans."""
    seg = _seg(segment)
    base = base.withColumn("_mi", month_index(F.col("metric_month")))
    w = Window.partitionBy(*seg).orderBy("metric_month")
    v, dr = "total_funded_volume", "default_rate"
    prev1, prev12 = _prior(v, w, 1, calendar, seg), _prior(v, w, 12, calendar, seg)
    roll = w.rowsBetween(-2, 0)
    zero = F.lit(0).cast("decimal(38,2)")
    df = base.select(
        *seg, "metric_month", "total_applications", "total_funded_volume", "total_requested_volume",
        "funding_fulfillment_rate", "avg_interest_rate", "default_rate", "delinquency_rate",
        F.coalesce("total_charged_off_prncp", zero).alias("total_charged_off_prncp"),
        F.coalesce("net_recovery_rate", zero).alias("net_recovery_rate"),
        F.coalesce("collection_cost_ratio", zero).alias("collection_cost_ratio"),
        "unverified_backlog_share",
        exact_ratio(F.col(v) - prev1, prev1, mult=100).alias("mom_volume_growth_pct"),
        (F.col(dr) - _prior(dr, w, 1, calendar, seg)).alias("mom_default_rate_delta"),
        exact_ratio(F.col(v) - prev12, prev12, mult=100).alias("yoy_volume_growth_pct"),
        (F.col(dr) - _prior(dr, w, 12, calendar, seg)).alias("yoy_default_rate_delta"),
        exact_ratio(F.sum(v).over(roll), F.count(v).over(roll)).alias("rolling_3m_avg_funded_volume"),
        F.coalesce("total_recoveries", zero).alias("total_recoveries"),
    )
    if exact:
        return df
    return to_output(df, keep=seg + ["metric_month"], ints=["total_applications"])


def to_output(df: DataFrame, keep: list[str], ints=(), strings=()) -> DataFrame:
    """Cast every published column: ints -> bigint, strings kept, rest -> double."""
    cols = []
    for c in df.columns:
        if c in keep or c in strings:
            cols.append(F.col(c))
        elif c in ints:
            cols.append(out(F.col(c), c, "bigint"))
        else:
            cols.append(out(F.col(c), c))
    return df.select(*cols)


def grade_quality(loans_borrowers: DataFrame) -> DataFrame:
    """OP3 (KPI 3, 6): pricing vs realised default by grade."""
    df = loans_borrowers.groupBy("grade").agg(
        F.count("loan_id").alias("total_loans"),
        F.sum("funded_amnt").alias("total_funded_amount"),
        exact_mean(F.col("int_rate")).alias("avg_interest_rate"),
        pct_of_rows(F.col("is_default")).alias("default_rate"),
        pct_of_rows(F.col("is_delinquent")).alias("delinquency_rate"),
        # avg(rate) - default% rounded once: (sum(rate) - sum(def)*100) / count
        exact_ratio(F.sum("int_rate") - F.sum("is_default") * 100, F.count("loan_id")).alias("risk_adjusted_net_spread"),
        exact_mean(F.col("dti")).alias("avg_dti"),
        exact_mean(F.col("fico_range_low"), 1).alias("avg_fico"),
    )
    return to_output(df, keep=["grade"], ints=["total_loans"])


def collections_by_grade(loans_payments: DataFrame) -> DataFrame:
    """OP4 (KPI 7-9): losses, recoveries and collection fees by grade."""
    df = loans_payments.groupBy("grade").agg(
        F.count(F.when(F.col("is_default") == 1, 1)).alias("charged_off_loans"),
        F.sum("charged_off_principal").alias("gross_charged_off_principal"),
        F.sum("recoveries").alias("total_recoveries"),
        F.sum("collection_recovery_fee").alias("total_collection_fees"),
        exact_ratio(F.sum("recoveries"), F.sum("charged_off_principal"), mult=100).alias("recovery_rate_pct"),
        exact_ratio(F.sum("collection_recovery_fee"), F.sum("recoveries"), mult=100).alias("collection_cost_fee_ratio_pct"),
        (F.sum("recoveries") - F.sum("collection_recovery_fee")).alias("net_recovered_cash"),
    )
    return to_output(df, keep=["grade"], ints=["charged_off_loans"])


def state_capacity(loans_borrowers: DataFrame) -> DataFrame:
    """OP5 (KPI 10-12): throughput, backlog and fulfilment per state, dense-ranked."""
    base = loans_borrowers.groupBy("addr_state").agg(
        F.count("loan_id").alias("total_loans_processed"),
        F.sum("funded_amnt").alias("total_funded_volume"),
        exact_mean(F.col("int_rate")).alias("avg_interest_rate"),
        pct_of_rows(F.col("is_default")).alias("state_default_rate"),
        pct_of_rows(X.unverified_flag(F.col("verification_status"))).alias("unverified_rate_pct"),
        exact_ratio(F.sum("funded_amnt"), F.sum("loan_amnt"), mult=100).alias("funding_fulfillment_rate"),
    )
    # one row per state: the global window sees tens of rows
    ranked = base.withColumn("volume_rank", F.dense_rank().over(Window.orderBy(F.desc("total_loans_processed"))))
    return to_output(ranked, keep=["addr_state"], ints=["total_loans_processed", "volume_rank"])


def yearly_stress(book: DataFrame, extended: bool = False) -> DataFrame:
    """OP6: yearly crisis-impact table (AGG5); ``extended`` adds AGG6's columns."""
    aggs = [
        F.count("loan_id").alias("annual_volume" if not extended else "loan_count"),
        F.sum("funded_amnt").alias("annual_funded_amount" if not extended else "funded_volume"),
        exact_mean(F.col("int_rate")).alias("avg_int_rate"),
        pct_of_rows(F.col("is_default")).alias("default_rate"),
        pct_of_rows(F.col("is_delinquent")).alias("delinquency_rate"),
        exact_mean(F.col("dti")).alias("avg_dti"),
        exact_ratio(F.sum("recoveries"), F.sum("charged_off_principal"), mult=100).alias("recovery_rate"),
    ]
    if extended:
        aggs += [
            exact_mean(F.col("annual_inc")).alias("avg_annual_inc"),
            exact_mean(F.col("fico_range_low"), 1).alias("avg_fico"),
            pct_of_rows(X.unverified_flag(F.col("verification_status"))).alias("unverified_rate"),
        ]
    df = book.groupBy("issue_year").agg(*aggs)
    return df


def yearly_stress_output(book: DataFrame, extended: bool = False) -> DataFrame:
    df = yearly_stress(book, extended)
    return to_output(df, keep=[], ints=["issue_year", "annual_volume", "loan_count"])


def grade_cohorts(loans: DataFrame) -> DataFrame:
    """OP26 / AGG7: grade x issue-year cohort table."""
    df = loans.groupBy("grade", "issue_year").agg(
        F.count("loan_id").alias("total_loans"),
        F.sum("funded_amnt").alias("total_funded"),
        exact_mean(F.col("int_rate")).alias("avg_int_rate"),
        pct_of_rows(F.col("is_default")).alias("default_rate"),
        pct_of_rows(F.col("is_delinquent")).alias("delinquency_rate"),
    )
    return df


def grade_cohort_means(loans: DataFrame) -> DataFrame:
    """AGG13: per grade, summed volume and plain means of the yearly rates."""
    coh = grade_cohorts(loans)
    df = coh.groupBy("grade").agg(
        F.sum("total_funded").alias("total_funded"),
        exact_mean(F.col("avg_int_rate"), 4).alias("mean_avg_int_rate"),
        exact_mean(F.col("default_rate"), 4).alias("mean_default_rate"),
        F.count(F.lit(1)).alias("n_years"),
    )
    return to_output(df, keep=["grade"], ints=["n_years"])


def state_throughput_topn(loans_borrowers: DataFrame, top_n: int = 10) -> DataFrame:
    """OP26 / AGG8: the ``top_n`` states by loan count (top-k is the feature).

    Ties on the count are broken by state code so the result is deterministic.
    """
    df = loans_borrowers.groupBy("addr_state").agg(
        F.count("loan_id").alias("total_loans"),
        F.sum("funded_amnt").alias("total_funded_volume"),
        exact_mean(F.col("int_rate")).alias("avg_int_rate"),
        pct_of_rows(F.col("is_default")).alias("default_rate"),
        pct_of_rows(X.unverified_flag(F.col("verification_status"))).alias("unverified_share"),
    )
    top = df.orderBy(F.desc("total_loans"), F.asc("addr_state")).limit(top_n)
    return to_output(top, keep=["addr_state"], ints=["total_loans"])


def state_month_throughput(loans_borrowers: DataFrame) -> DataFrame:
    """AGG23 (KPI 10 as defined): loans and volume per state and month."""
    df = loans_borrowers.groupBy("addr_state", F.col("issue_month").alias("metric_month")).agg(
        F.count("loan_id").alias("loans_processed"),
        F.sum("funded_amnt").alias("funded_volume"),
    )
    return to_output(df, keep=["addr_state", "metric_month"], ints=["loans_processed"])


def filter_states(df: DataFrame, states=None) -> DataFrame:
    """FLT5: keep the selected states (``None`` or ``"ALL"`` keeps all), before any rollup."""
    if states is None or states == "ALL" or (isinstance(states, (list, tuple)) and "ALL" in states):
        return df
    return df.where(F.col("addr_state").isin(*([states] if isinstance(states, str) else states)))


def distinct_states(borrowers: DataFrame) -> DataFrame:
    """SRC4: sorted distinct state codes (the filter list)."""
    return borrowers.select("addr_state").distinct().orderBy("addr_state")
