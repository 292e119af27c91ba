"""DuckDB oracle SQL, one string per registered query."""

from __future__ import annotations

from .book import UNVERIFIED, mean, pct, with_book, xr

SQL: dict[str, str] = {}


def register(name: str, sql: str, extra: str = "") -> None:
    SQL[name] = with_book(sql, extra)


ROLLUP_COLS = ["total_applications", "total_funded_volume", "total_requested_volume",
               "funding_fulfillment_rate", "avg_interest_rate", "default_rate", "delinquency_rate",
               "total_charged_off_prncp", "net_recovery_rate", "collection_cost_ratio",
               "unverified_backlog_share", "mom_volume_growth_pct", "mom_default_rate_delta",
               "yoy_volume_growth_pct", "yoy_default_rate_delta", "rolling_3m_avg_funded_volume",
               "total_recoveries"]


def rollup_ctes(seg: str = "") -> str:
    """CTEs ``mb`` (monthly base), ``mt`` (lags) and ``ro`` (exact rollup)."""
    part = f"PARTITION BY {seg} " if seg else ""
    segc = f"{seg}, " if seg else ""
    return f"""
mb AS (
  SELECT {segc}issue_month AS metric_month,
    COUNT(loan_id) AS total_applications,
    SUM(loan_amnt) AS total_requested_volume,
    SUM(funded_amnt) AS total_funded_volume,
    {mean('int_rate')} AS avg_interest_rate,
    {pct('is_default')} AS default_rate,
    {pct('is_delinquent')} AS delinquency_rate,
    {xr('SUM(funded_amnt)', 'SUM(loan_amnt)', 2, 100)} AS funding_fulfillment_rate,
    SUM(charged_off_principal) AS total_charged_off_prncp,
    SUM(recoveries) AS total_recoveries,
    {xr('SUM(recoveries)', 'SUM(charged_off_principal)', 2, 100)} AS net_recovery_rate,
    {xr('SUM(collection_recovery_fee)', 'SUM(recoveries)', 2, 100)} AS collection_cost_ratio,
    {pct(UNVERIFIED)} AS unverified_backlog_share
  FROM book GROUP BY {segc}issue_month
),
mt AS (
  SELECT *,
    LAG(total_funded_volume, 1) OVER (w) AS v1,
    LAG(total_funded_volume, 12) OVER (w) AS v12,
    LAG(default_rate, 1) OVER (w) AS d1,
    LAG(default_rate, 12) OVER (w) AS d12,
    SUM(total_funded_volume) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3s,
    COUNT(total_funded_volume) OVER (w ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3c
  FROM mb WINDOW w AS ({part}ORDER BY metric_month)
),
ro AS (
  SELECT {segc}metric_month, total_applications, total_funded_volume, total_requested_volume,
    funding_fulfillment_rate, avg_interest_rate, default_rate, delinquency_rate,
    coalesce(total_charged_off_prncp, 0) AS total_charged_off_prncp,
    coalesce(net_recovery_rate, 0) AS net_recovery_rate,
    coalesce(collection_cost_ratio, 0) AS collection_cost_ratio,
    unverified_backlog_share,
    {xr('total_funded_volume - v1', 'v1', 2, 100)} AS mom_volume_growth_pct,
    default_rate - d1 AS mom_default_rate_delta,
    {xr('total_funded_volume - v12', 'v12', 2, 100)} AS yoy_volume_growth_pct,
    default_rate - d12 AS yoy_default_rate_delta,
    {xr('r3s', 'r3c')} AS rolling_3m_avg_funded_volume,
    coalesce(total_recoveries, 0) AS total_recoveries
  FROM mt
)"""


def cast_cols(cols, ints=()):
    return ",\n  ".join(f"CAST({c} AS {'BIGINT' if c in ints else 'DOUBLE'}) AS {c}" for c in cols)


register("monthly_kpi_rollup", f"""
SELECT metric_month, {cast_cols(ROLLUP_COLS, ['total_applications'])}
FROM ro ORDER BY metric_month""", rollup_ctes())
register("monthly_kpi_by_grade", f"""
SELECT grade, metric_month, {cast_cols(ROLLUP_COLS, ['total_applications'])}
FROM ro ORDER BY grade, metric_month""", rollup_ctes("grade"))

register("grade_quality", f"""
SELECT grade,
  CAST(COUNT(loan_id) AS BIGINT) AS total_loans,
  CAST(SUM(funded_amnt) AS DOUBLE) AS total_funded_amount,
  CAST({mean('int_rate')} AS DOUBLE) AS avg_interest_rate,
  CAST({pct('is_default')} AS DOUBLE) AS default_rate,
  CAST({pct('is_delinquent')} AS DOUBLE) AS delinquency_rate,
  CAST({xr('SUM(int_rate) - SUM(is_default) * 100', 'COUNT(loan_id)')} AS DOUBLE) AS risk_adjusted_net_spread,
  CAST({mean('dti')} AS DOUBLE) AS avg_dti,
  CAST({mean('fico_range_low', 1)} AS DOUBLE) AS avg_fico
FROM lb GROUP BY grade ORDER BY grade""")

register("collections_by_grade", f"""
SELECT grade,
  CAST(COUNT(CASE WHEN is_default = 1 THEN 1 END) AS BIGINT) AS charged_off_loans,
  CAST(SUM(charged_off_principal) AS DOUBLE) AS gross_charged_off_principal,
  CAST(SUM(recoveries) AS DOUBLE) AS total_recoveries,
  CAST(SUM(collection_recovery_fee) AS DOUBLE) AS total_collection_fees,
  CAST({xr('SUM(recoveries)', 'SUM(charged_off_principal)', 2, 100)} AS DOUBLE) AS recovery_rate_pct,
  CAST({xr('SUM(collection_recovery_fee)', 'SUM(recoveries)', 2, 100)} AS DOUBLE) AS collection_cost_fee_ratio_pct,
  CAST(SUM(recoveries) - SUM(collection_recovery_fee) AS DOUBLE) AS net_recovered_cash
FROM lp GROUP BY grade ORDER BY grade""")

register("state_capacity", f"""
SELECT addr_state,
  CAST(total_loans_processed AS BIGINT) AS total_loans_processed,
  CAST(total_funded_volume AS DOUBLE) AS total_funded_volume,
  CAST(avg_interest_rate AS DOUBLE) AS avg_interest_rate,
  CAST(state_default_rate AS DOUBLE) AS state_default_rate,
  CAST(unverified_rate_pct AS DOUBLE) AS unverified_rate_pct,
  CAST(funding_fulfillment_rate AS DOUBLE) AS funding_fulfillment_rate,
  CAST(DENSE_RANK() OVER (ORDER BY total_loans_processed DESC) AS BIGINT) AS volume_rank
FROM sv ORDER BY total_loans_processed DESC""", f"""
sv AS (
  SELECT addr_state,
    COUNT(loan_id) AS total_loans_processed,
    SUM(funded_amnt) AS total_funded_volume,
    {mean('int_rate')} AS avg_interest_rate,
    {pct('is_default')} AS state_default_rate,
    {pct(UNVERIFIED)} AS unverified_rate_pct,
    {xr('SUM(funded_amnt)', 'SUM(loan_amnt)', 2, 100)} AS funding_fulfillment_rate
  FROM lb GROUP BY addr_state
)""")

register("yearly_stress", f"""
SELECT CAST(issue_year AS BIGINT) AS issue_year,
  CAST(COUNT(loan_id) AS BIGINT) AS annual_volume,
  CAST(SUM(funded_amnt) AS DOUBLE) AS annual_funded_amount,
  CAST({mean('int_rate')} AS DOUBLE) AS avg_int_rate,
  CAST({pct('is_default')} AS DOUBLE) AS default_rate,
  CAST({pct('is_delinquent')} AS DOUBLE) AS delinquency_rate,
  CAST({mean('dti')} AS DOUBLE) AS avg_dti,
  CAST({xr('SUM(recoveries)', 'SUM(charged_off_principal)', 2, 100)} AS DOUBLE) AS recovery_rate
FROM book GROUP BY issue_year ORDER BY issue_year""")

_COHORT = f"""
coh AS (
  SELECT grade, issue_year,
    COUNT(loan_id) AS total_loans,
    SUM(funded_amnt) AS total_funded,
    {mean('int_rate')} AS avg_int_rate,
    {pct('is_default')} AS default_rate,
    {pct('is_delinquent')} AS delinquency_rate
  FROM loans_b GROUP BY grade, issue_year
)"""

register("grade_cohorts", """
SELECT grade, CAST(issue_year AS BIGINT) AS issue_year,
  CAST(total_loans AS BIGINT) AS total_loans,
  CAST(total_funded AS DOUBLE) AS total_funded,
  CAST(avg_int_rate AS DOUBLE) AS avg_int_rate,
  CAST(default_rate AS DOUBLE) AS default_rate,
  CAST(delinquency_rate AS DOUBLE) AS delinquency_rate
FROM coh ORDER BY grade, issue_year""", _COHORT)

register("grade_cohort_means", f"""
SELECT grade,
  CAST(SUM(total_funded) AS DOUBLE) AS total_funded,
  CAST({mean('avg_int_rate', 4)} AS DOUBLE) AS mean_avg_int_rate,
  CAST({mean('default_rate', 4)} AS DOUBLE) AS mean_default_rate,
  CAST(COUNT(*) AS BIGINT) AS n_years
FROM coh GROUP BY grade ORDER BY grade""", _COHORT)

register("state_throughput_topn", f"""
SELECT addr_state,
  CAST(COUNT(loan_id) AS BIGINT) AS total_loans,
  CAST(SUM(funded_amnt) AS DOUBLE) AS total_funded_volume,
  CAST({mean('int_rate')} AS DOUBLE) AS avg_int_rate,
  CAST({pct('is_default')} AS DOUBLE) AS default_rate,
  CAST({pct(UNVERIFIED)} AS DOUBLE) AS unverified_share
FROM lb GROUP BY addr_state ORDER BY total_loans DESC, addr_state LIMIT 10""")

register("state_month_throughput", """
SELECT addr_state, issue_month AS metric_month,
  CAST(COUNT(loan_id) AS BIGINT) AS loans_processed,
  CAST(SUM(funded_amnt) AS DOUBLE) AS funded_volume
FROM lb GROUP BY addr_state, issue_month ORDER BY addr_state, metric_month""")

SQL["bucketed_rollup"] = SQL["monthly_kpi_rollup"]
SQL["incremental_rollup"] = SQL["monthly_kpi_rollup"]
register("borrower_reach", """
SELECT addr_state, COUNT(DISTINCT borrower_key) AS borrowers, TRUE AS estimate_within_4_sigma FROM book GROUP BY addr_state""")
