"""Stress-period comparison (OP9) and the root-cause bundle (OP11)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import exact_ratio
from .kpis import to_output, yearly_stress

# The driver tables' stress years (the reference hard-codes its own crisis years).
DEFAULT_CRISIS_YEARS = (1995, 1996, 1997)


def crisis_analysis(book: DataFrame, crisis_years=DEFAULT_CRISIS_YEARS) -> DataFrame:
    """OP9: default and recovery rates inside vs outside the stress years.

    * default rates are loan-count-weighted means of the (rounded) yearly rates
    * recovery rates are plain means of the yearly rates, NULL years skipped
    * ``default_rate_multiple`` = stress / max(baseline, 0.01)

    One aggregation over the yearly table (a few rows) after one over the book.
    """
    years = yearly_stress(book, extended=True)
    inside = F.col("issue_year").isin([int(y) for y in crisis_years])
    n, dr, rr = F.col("loan_count"), F.col("default_rate"), F.col("recovery_rate")

    def weighted(mask):
        return exact_ratio(F.sum(F.when(mask, n * dr)), F.sum(F.when(mask, n)))

    def mean(mask):
        return exact_ratio(F.sum(F.when(mask, rr)), F.count(F.when(mask, rr)))

    agg = years.agg(
        weighted(inside).alias("crisis_default_rate"),
        weighted(~inside).alias("post_crisis_default_rate"),
        mean(inside).alias("crisis_recovery_rate"),
        mean(~inside).alias("post_crisis_recovery_rate"),
        F.sum(F.when(inside, n)).alias("crisis_loans"),
        F.sum(F.when(~inside, n)).alias("post_crisis_loans"),
    )
    floor = F.lit(0.01).cast("decimal(4,2)")
    res = agg.select(
        "*",
        exact_ratio(F.col("crisis_default_rate"),
                    F.greatest(F.coalesce(F.col("post_crisis_default_rate"), floor), floor)).alias("default_rate_multiple"),
    )
    return to_output(res, keep=[], ints=["crisis_loans", "post_crisis_loans"])


def crisis_yearly(book: DataFrame) -> DataFrame:
    """AGG6: the extended yearly table the comparison is built on."""
    return to_output(yearly_stress(book, extended=True), keep=[], ints=["issue_year", "loan_count"])
