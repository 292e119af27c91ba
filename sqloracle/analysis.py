"""Oracle SQL for trends, alerts, crisis and scorecard queries."""

from __future__ import annotations

from .book import UNVERIFIED, mean, pct, xr
from .queries import SQL, ROLLUP_COLS, cast_cols, register, rollup_ctes

register("monthly_trends", f"""
SELECT metric_month, {cast_cols(ROLLUP_COLS, ['total_applications'])},
  CAST({xr('SUM(default_rate) OVER w3', 'COUNT(default_rate) OVER w3')} AS DOUBLE) AS rolling_3m_default_rate,
  CAST({xr('SUM(default_rate) OVER w6', 'COUNT(default_rate) OVER w6')} AS DOUBLE) AS rolling_6m_default_rate,
  CAST({xr('SUM(total_funded_volume) OVER w3', 'COUNT(total_funded_volume) OVER w3')} AS DOUBLE) AS rolling_3m_volume
FROM ro
WINDOW w3 AS (ORDER BY metric_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW),
       w6 AS (ORDER BY metric_month ROWS BETWEEN 5 PRECEDING AND CURRENT ROW)
ORDER BY metric_month""", rollup_ctes())

_R1 = "(mom_default_rate_delta IS NOT NULL AND mom_default_rate_delta >= 2.0)"
_R2 = "(default_rate IS NOT NULL AND default_rate >= 18.0)"
_R3 = "(funding_fulfillment_rate IS NOT NULL AND funding_fulfillment_rate < 95.0)"
_R4 = "(unverified_backlog_share IS NOT NULL AND unverified_backlog_share > 60.0)"

register("degraded_alerts", f"""
SELECT metric_month,
  CASE WHEN {_R2} THEN 'CRITICAL'
       WHEN {_R1} THEN (CASE WHEN mom_default_rate_delta > 5.0 THEN 'CRITICAL' ELSE 'WARNING' END)
       WHEN {_R3} THEN 'WARNING' WHEN {_R4} THEN 'INFO' ELSE 'NORMAL' END AS severity,
  CAST(default_rate AS DOUBLE) AS default_rate,
  CAST(total_funded_volume AS DOUBLE) AS funded_volume,
  CAST(funding_fulfillment_rate AS DOUBLE) AS fulfillment_rate,
  CAST(unverified_backlog_share AS DOUBLE) AS unverified_share,
  concat_ws('; ',
    CASE WHEN {_R1} THEN 'Default rate surged +' || CAST(round(mom_default_rate_delta, 2) AS VARCHAR)
         || '% MoM (reached ' || CAST(CAST(default_rate AS DOUBLE) AS VARCHAR) || '%)' END,
    CASE WHEN {_R2} THEN 'Severe credit stress: Default rate at ' || CAST(round(default_rate, 2) AS VARCHAR) || '%' END,
    CASE WHEN {_R3} THEN 'Funding fulfillment fell to ' || CAST(round(funding_fulfillment_rate, 1) AS VARCHAR)
         || '% (target >= 95.0%)' END,
    CASE WHEN {_R4} THEN 'Verification backlog high: ' || CAST(round(unverified_backlog_share, 1) AS VARCHAR)
         || '% unverified applications' END) AS issues_flagged
FROM ro WHERE {_R1} OR {_R2} OR {_R3} OR {_R4}
ORDER BY metric_month""", rollup_ctes())

_YEARLY = f"""
yr AS (
  SELECT issue_year,
    COUNT(loan_id) AS loan_count,
    SUM(funded_amnt) AS funded_volume,
    {mean('int_rate')} AS avg_int_rate,
    {pct('is_default')} AS default_rate,
    {pct('is_delinquent')} AS delinquency_rate,
    {mean('dti')} AS avg_dti,
    {xr('SUM(recoveries)', 'SUM(charged_off_principal)', 2, 100)} AS recovery_rate,
    {mean('annual_inc')} AS avg_annual_inc,
    {mean('fico_range_low', 1)} AS avg_fico,
    {pct(UNVERIFIED)} AS unverified_rate
  FROM book GROUP BY issue_year
)"""

register("crisis_yearly", f"""
SELECT CAST(issue_year AS BIGINT) AS issue_year,
  {cast_cols(['loan_count', 'funded_volume', 'avg_int_rate', 'default_rate', 'delinquency_rate',
              'avg_dti', 'recovery_rate', 'avg_annual_inc', 'avg_fico', 'unverified_rate'], ['loan_count'])}
FROM yr ORDER BY issue_year""", _YEARLY)

_IN = "issue_year IN (1995, 1996, 1997)"
register("crisis_analysis", f"""
SELECT {cast_cols(['crisis_default_rate', 'post_crisis_default_rate', 'crisis_recovery_rate',
                   'post_crisis_recovery_rate', 'crisis_loans', 'post_crisis_loans'],
                  ['crisis_loans', 'post_crisis_loans'])},
  CAST({xr('crisis_default_rate', 'greatest(coalesce(post_crisis_default_rate, 0.01), 0.01)')} AS DOUBLE)
    AS default_rate_multiple
FROM (
  SELECT
    {xr(f'SUM(CASE WHEN {_IN} THEN loan_count * default_rate END)', f'SUM(CASE WHEN {_IN} THEN loan_count END)')} AS crisis_default_rate,
    {xr(f'SUM(CASE WHEN NOT ({_IN}) THEN loan_count * default_rate END)', f'SUM(CASE WHEN NOT ({_IN}) THEN loan_count END)')} AS post_crisis_default_rate,
    {xr(f'SUM(CASE WHEN {_IN} THEN recovery_rate END)', f'COUNT(CASE WHEN {_IN} THEN recovery_rate END)')} AS crisis_recovery_rate,
    {xr(f'SUM(CASE WHEN NOT ({_IN}) THEN recovery_rate END)', f'COUNT(CASE WHEN NOT ({_IN}) THEN recovery_rate END)')} AS post_crisis_recovery_rate,
    SUM(CASE WHEN {_IN} THEN loan_count END) AS crisis_loans,
    SUM(CASE WHEN NOT ({_IN}) THEN loan_count END) AS post_crisis_loans
  FROM yr) t""", _YEARLY)

_RANKED = rollup_ctes() + """,
rk AS (SELECT *, row_number() OVER (ORDER BY metric_month DESC) AS rn FROM ro)"""

register("latest_vs_previous", """
SELECT latest_month, previous_month,
  CAST(latest_default_rate AS DOUBLE) AS latest_default_rate,
  CAST(latest_default_rate - coalesce(prev_default_rate, latest_default_rate) AS DOUBLE) AS default_rate_delta,
  CAST(latest_delinquency_rate AS DOUBLE) AS latest_delinquency_rate,
  CAST(latest_delinquency_rate - coalesce(prev_delinquency_rate, latest_delinquency_rate) AS DOUBLE) AS delinquency_rate_delta,
  CAST(latest_funded_volume AS DOUBLE) AS latest_funded_volume,
  CAST(latest_mom_growth_pct AS DOUBLE) AS latest_mom_growth_pct
FROM (
  SELECT max(CASE WHEN rn = 1 THEN metric_month END) AS latest_month,
    max(CASE WHEN rn = 2 THEN metric_month END) AS previous_month,
    max(CASE WHEN rn = 1 THEN default_rate END) AS latest_default_rate,
    max(CASE WHEN rn = 2 THEN default_rate END) AS prev_default_rate,
    max(CASE WHEN rn = 1 THEN delinquency_rate END) AS latest_delinquency_rate,
    max(CASE WHEN rn = 2 THEN delinquency_rate END) AS prev_delinquency_rate,
    max(CASE WHEN rn = 1 THEN total_funded_volume END) AS latest_funded_volume,
    max(CASE WHEN rn = 1 THEN mom_volume_growth_pct END) AS latest_mom_growth_pct
  FROM rk) t""", _RANKED)

_SC = _RANKED + f""",
sa AS (
  SELECT SUM(total_funded_volume) AS tot_vol, SUM(total_applications) AS tot_apps, COUNT(*) AS n_months,
    {xr('SUM(default_rate * total_applications)', 'SUM(total_applications)', 4)} AS w_def,
    {xr('SUM(delinquency_rate * total_applications)', 'SUM(total_applications)', 4)} AS w_delinq,
    {mean('funding_fulfillment_rate', 4)} AS avg_ff,
    {mean('avg_interest_rate', 4)} AS avg_apr,
    SUM(total_charged_off_prncp) AS tot_co, SUM(total_recoveries) AS tot_rec,
    {mean('collection_cost_ratio', 4)} AS avg_fee,
    {mean('unverified_backlog_share', 4)} AS avg_unv,
    max(CASE WHEN rn = 1 THEN mom_volume_growth_pct END) AS mom,
    max(CASE WHEN rn = 1 THEN default_rate END)
      - coalesce(max(CASE WHEN rn = 2 THEN default_rate END), max(CASE WHEN rn = 1 THEN default_rate END)) AS def_delta,
    max(CASE WHEN rn = 1 THEN delinquency_rate END)
      - coalesce(max(CASE WHEN rn = 2 THEN delinquency_rate END), max(CASE WHEN rn = 1 THEN delinquency_rate END)) AS delinq_delta
  FROM rk
),
sb AS (
  SELECT *, CASE WHEN tot_co > 0 THEN {xr('tot_rec', 'tot_co', 4, 100)} ELSE 0 END AS rec_rate,
    avg_apr - w_def AS spread, tot_apps // greatest(n_months, 1) AS run_rate,
    (mom IS NOT NULL AND mom > 0) AS mom_pos
  FROM sa
)"""


def _sc_row(i, name, value, delta, direction, badge):
    return (f"SELECT CAST({i} AS BIGINT) AS kpi_id, '{name}' AS kpi_name, CAST({value} AS DOUBLE) AS value, "
            f"CAST({delta} AS DOUBLE) AS delta, {direction} AS direction, {badge} AS badge FROM sb")


def _pn(cond):
    return f"(CASE WHEN {cond} THEN 'positive' ELSE 'negative' END)"


register("kpi_scorecard", "\nUNION ALL\n".join([
    _sc_row(1, "Default / Charge-off Rate", "w_def", "def_delta", _pn("def_delta <= 0"),
            "(CASE WHEN w_def > 15 THEN 'critical' ELSE 'success' END)"),
    _sc_row(2, "Delinquency Rate (30+ DPD)", "w_delinq", "delinq_delta", _pn("delinq_delta <= 0"),
            "(CASE WHEN w_delinq > 2 THEN 'warning' ELSE 'info' END)"),
    _sc_row(3, "Risk-Adjusted Quality Spread", "spread", "NULL", _pn("spread > 5"), "'info'"),
    _sc_row(4, "Funding Fulfillment Rate", "avg_ff", "NULL", _pn("avg_ff >= 95"),
            "(CASE WHEN avg_ff >= 95 THEN 'success' ELSE 'warning' END)"),
    _sc_row(5, "Total Funded Volume", "tot_vol", "mom", _pn("mom_pos"), "'info'"),
    _sc_row(6, "Average Portfolio APR", "avg_apr", "NULL", "'neutral'", "'info'"),
    _sc_row(7, "Gross Charge-Off Volume", "tot_co", "NULL",
            "(CASE WHEN tot_co > 0 THEN 'negative' ELSE 'neutral' END)", "'critical'"),
    _sc_row(8, "Net Recovery Rate", "rec_rate", "NULL",
            "(CASE WHEN rec_rate > 8 THEN 'positive' ELSE 'neutral' END)", "'warning'"),
    _sc_row(9, "Collection Cost Efficiency Ratio", "avg_fee", "NULL", _pn("avg_fee < 18"), "'info'"),
    _sc_row(10, "Regional Throughput Run-Rate", "run_rate", "NULL", "'positive'", "'info'"),
    _sc_row(11, "Verification Backlog Share", "avg_unv", "NULL", _pn("avg_unv < 40"),
            "(CASE WHEN avg_unv > 50 THEN 'warning' ELSE 'success' END)"),
    _sc_row(12, "Application Velocity vs Issuance", "coalesce(mom, 0)", "NULL",
            "(CASE WHEN mom_pos THEN 'positive' ELSE 'neutral' END)", "'info'"),
]), _SC)

# The scorecard over a month window (FLT4): the months are cut before they are ranked.
SQL["kpi_scorecard_window"] = SQL["kpi_scorecard"].replace(
    "DESC) AS rn FROM ro)", "DESC) AS rn FROM ro WHERE metric_month BETWEEN '1994-01' AND '1996-06')", 1)
