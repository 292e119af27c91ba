"""Trend smoothing and degradation alerts over the monthly rollup (OP7, OP8).

Input is the rollup from :func:`kpis.monthly_kpi_rollup` with ``exact=True``
(one row per month, or per segment and month), so the windows below sort
tens to hundreds of rows, not loans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import exact_ratio
from .kpis import _seg, to_output


def monthly_trends(rollup: DataFrame, segment=None) -> DataFrame:
    """OP7: 3- and 6-month rolling default rate, 3-month rolling volume.

    Rolling means start with one month (``min_periods=1``) and skip NULLs.
    """
    seg = _seg(segment)
    w = Window.partitionBy(*seg).orderBy("metric_month")
    w3, w6 = w.rowsBetween(-2, 0), w.rowsBetween(-5, 0)
    dr, v = "default_rate", "total_funded_volume"
    return rollup.select(
        "*",
        exact_ratio(F.sum(dr).over(w3), F.count(dr).over(w3)).alias("rolling_3m_default_rate"),
        exact_ratio(F.sum(dr).over(w6), F.count(dr).over(w6)).alias("rolling_6m_default_rate"),
        exact_ratio(F.sum(v).over(w3), F.count(v).over(w3)).alias("rolling_3m_volume"),
    )


def detect_degraded(rollup: DataFrame, mom: float = 2.0, fulfil: float = 95.0,
                    unverified: float = 60.0, severe: float = 18.0) -> DataFrame:
    """OP8: months whose KPIs crossed a policy tolerance, with severity and reasons.

    Rules, in order: MoM default delta >= ``mom`` (CRITICAL above 5.0 points,
    else WARNING); default rate >= ``severe`` (always CRITICAL); fulfilment
    below ``fulfil`` (NORMAL -> WARNING); unverified share above
    ``unverified`` (NORMAL -> INFO). NULLs never trigger a rule.
    """
    d, dr = F.col("mom_default_rate_delta"), F.col("default_rate")
    ff, uv = F.col("funding_fulfillment_rate"), F.col("unverified_backlog_share")
    r1 = d.isNotNull() & (d >= F.lit(mom))
    r2 = dr.isNotNull() & (dr >= F.lit(severe))
    r3 = ff.isNotNull() & (ff < F.lit(fulfil))
    r4 = uv.isNotNull() & (uv > F.lit(unverified))
    one = lambda c, digits: F.round(c, digits).cast("string")
    msgs = F.concat_ws("; ", F.array(
        F.when(r1, F.concat(F.lit("Default rate surged +"), one(d, 2), F.lit("% MoM (reached "),
                            dr.cast("double").cast("string"), F.lit("%)"))),
        F.when(r2, F.concat(F.lit("Severe credit stress: Default rate at "), one(dr, 2), F.lit("%"))),
        F.when(r3, F.concat(F.lit("Funding fulfillment fell to "), one(ff, 1),
                            F.lit(f"% (target >= {float(fulfil)}%)"))),
        F.when(r4, F.concat(F.lit("Verification backlog high: "), one(uv, 1),
                            F.lit("% unverified applications"))),
    ))
    sev = (F.when(r2, "CRITICAL")
           .when(r1, F.when(d > 5.0, "CRITICAL").otherwise("WARNING"))
           .when(r3, "WARNING").when(r4, "INFO").otherwise("NORMAL"))
    flagged = rollup.filter(r1 | r2 | r3 | r4).select(
        "metric_month",
        sev.alias("severity"),
        F.col("default_rate"),
        F.col("total_funded_volume").alias("funded_volume"),
        ff.alias("fulfillment_rate"),
        uv.alias("unverified_share"),
        msgs.alias("issues_flagged"),
    )
    return to_output(flagged, keep=["metric_month", "severity", "issues_flagged"])
