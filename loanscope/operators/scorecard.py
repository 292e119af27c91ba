"""The 12-KPI scorecard over a month window (OP23) and latest-vs-previous (WIN9).

Input: the exact monthly rollup (``kpis.monthly_kpi_rollup(..., exact=True)``),
one row per month. One window ranks months newest first, one aggregation
reduces the window to a single row, and ``inline`` turns it into 12 rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import exact_ratio
from .kpis import to_output

# Scorecard KPI names, in the reference's order.
KPI_NAMES = (
    "Default / Charge-off Rate", "Delinquency Rate (30+ DPD)", "Risk-Adjusted Quality Spread",
    "Funding Fulfillment Rate", "Total Funded Volume", "Average Portfolio APR",
    "Gross Charge-Off Volume", "Net Recovery Rate", "Collection Cost Efficiency Ratio",
    "Regional Throughput Run-Rate", "Verification Backlog Share", "Application Velocity vs Issuance",
)


def month_window(rollup: DataFrame, month_from: str | None = None, month_to: str | None = None) -> DataFrame:
    """FLT4: inclusive month range on ``YYYY-MM`` strings."""
    df = rollup
    if month_from:
        df = df.filter(F.col("metric_month") >= month_from)
    if month_to:
        df = df.filter(F.col("metric_month") <= month_to)
    return df


def _ranked(rollup: DataFrame) -> DataFrame:
    return rollup.withColumn("_rn", F.row_number().over(Window.orderBy(F.desc("metric_month"))))


def latest_vs_previous(rollup: DataFrame, month_from=None, month_to=None) -> DataFrame:
    """WIN9: the newest month of the window and its change vs the month before."""
    r = _ranked(month_window(rollup, month_from, month_to))
    latest = lambda c: F.max(F.when(F.col("_rn") == 1, F.col(c)))
    prev = lambda c: F.coalesce(F.max(F.when(F.col("_rn") == 2, F.col(c))), latest(c))
    df = r.agg(
        latest("metric_month").alias("latest_month"),
        F.max(F.when(F.col("_rn") == 2, F.col("metric_month"))).alias("previous_month"),
        latest("default_rate").alias("latest_default_rate"),
        (latest("default_rate") - prev("default_rate")).alias("default_rate_delta"),
        latest("delinquency_rate").alias("latest_delinquency_rate"),
        (latest("delinquency_rate") - prev("delinquency_rate")).alias("delinquency_rate_delta"),
        latest("total_funded_volume").alias("latest_funded_volume"),
        latest("mom_volume_growth_pct").alias("latest_mom_growth_pct"),
    )
    return to_output(df, keep=["latest_month", "previous_month"])


def kpi_scorecard(rollup: DataFrame, month_from=None, month_to=None) -> DataFrame:
    """OP23: 12 rows ``(kpi_id, kpi_name, value, delta, direction, badge)``.

    Default and delinquency are application-weighted; fulfilment, APR, fee
    ratio and unverified share are plain means of the months; volumes are
    sums; recovery = sum(recoveries) * 100 / sum(charge-offs), 0 if none.
    Ratios are rounded to 4 places; deltas compare the newest two months.
    """
    r = _ranked(month_window(rollup, month_from, month_to))
    rn = F.col("_rn")
    latest = lambda c: F.max(F.when(rn == 1, F.col(c)))
    prev = lambda c: F.coalesce(F.max(F.when(rn == 2, F.col(c))), latest(c))
    apps = F.col("total_applications")
    mean = lambda c: exact_ratio(F.sum(c), F.count(c), 4)
    a = r.agg(
        F.sum("total_funded_volume").alias("tot_vol"),
        F.sum(apps).alias("tot_apps"),
        F.count(F.lit(1)).alias("n_months"),
        exact_ratio(F.sum(F.col("default_rate") * apps), F.sum(apps), 4).alias("w_def"),
        exact_ratio(F.sum(F.col("delinquency_rate") * apps), F.sum(apps), 4).alias("w_delinq"),
        mean("funding_fulfillment_rate").alias("avg_ff"),
        mean("avg_interest_rate").alias("avg_apr"),
        F.sum("total_charged_off_prncp").alias("tot_co"),
        F.sum("total_recoveries").alias("tot_rec"),
        mean("collection_cost_ratio").alias("avg_fee"),
        mean("unverified_backlog_share").alias("avg_unv"),
        latest("mom_volume_growth_pct").alias("mom"),
        (latest("default_rate") - prev("default_rate")).alias("def_delta"),
        (latest("delinquency_rate") - prev("delinquency_rate")).alias("delinq_delta"),
    )
    c = F.col
    zero = F.lit(0).cast("decimal(38,4)")
    rec_rate = F.when(c("tot_co") > 0, exact_ratio(c("tot_rec"), c("tot_co"), 4, mult=100)).otherwise(zero)
    spread = c("avg_apr") - c("w_def")
    run_rate = F.call_function("div", c("tot_apps"), F.greatest(c("n_months"), F.lit(1)))
    mom_pos = c("mom").isNotNull() & (c("mom") > 0)

    def row(i, value, delta, direction, badge):
        return F.struct(F.lit(i).cast("bigint").alias("kpi_id"), F.lit(KPI_NAMES[i - 1]).alias("kpi_name"),
                        value.cast("double").alias("value"), delta.cast("double").alias("delta"),
                        direction.alias("direction"), F.lit(badge) if isinstance(badge, str) else badge)

    def badge(col):
        return col.alias("badge")

    pos_neg = lambda cond: F.when(cond, "positive").otherwise("negative")
    none = F.lit(None).cast("double")
    rows = F.array(
        row(1, c("w_def"), c("def_delta"), pos_neg(c("def_delta") <= 0),
            badge(F.when(c("w_def") > 15, "critical").otherwise("success"))),
        row(2, c("w_delinq"), c("delinq_delta"), pos_neg(c("delinq_delta") <= 0),
            badge(F.when(c("w_delinq") > 2, "warning").otherwise("info"))),
        row(3, spread, none, pos_neg(spread > 5), badge(F.lit("info"))),
        row(4, c("avg_ff"), none, pos_neg(c("avg_ff") >= 95),
            badge(F.when(c("avg_ff") >= 95, "success").otherwise("warning"))),
        row(5, c("tot_vol"), c("mom"), pos_neg(mom_pos), badge(F.lit("info"))),
        row(6, c("avg_apr"), none, F.lit("neutral"), badge(F.lit("info"))),
        row(7, c("tot_co"), none, F.when(c("tot_co") > 0, "negative").otherwise("neutral"),
            badge(F.lit("critical"))),
        row(8, rec_rate, none, F.when(rec_rate > 8, "positive").otherwise("neutral"), badge(F.lit("warning"))),
        row(9, c("avg_fee"), none, pos_neg(c("avg_fee") < 18), badge(F.lit("info"))),
        row(10, run_rate, none, F.lit("positive"), badge(F.lit("info"))),
        row(11, c("avg_unv"), none, pos_neg(c("avg_unv") < 40),
            badge(F.when(c("avg_unv") > 50, "warning").otherwise("success"))),
        row(12, F.coalesce(c("mom"), zero), none, F.when(mom_pos, "positive").otherwise("neutral"),
            badge(F.lit("info"))),
    )
    return a.select(F.inline(rows))
