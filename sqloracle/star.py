"""Oracle SQL for the star schema, BI measures, report tables and validation."""

from __future__ import annotations

from loanscope.operators.star import GRADES, STATES

from .book import xr
from .queries import ROLLUP_COLS, SQL, cast_cols, register, rollup_ctes

register("monthly_kpi_calendar", f"""
SELECT metric_month, {cast_cols([c for c in ROLLUP_COLS], ['total_applications'])}
FROM cal ORDER BY metric_month""", rollup_ctes() + f""",
mi AS (SELECT *, CAST(substr(metric_month, 1, 4) AS INTEGER) * 12 + CAST(substr(metric_month, 6, 2) AS INTEGER) AS idx FROM mb),
cm AS (
  SELECT *,
    first_value(total_funded_volume) OVER (ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS c1,
    first_value(total_funded_volume) OVER (ORDER BY idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS c12,
    first_value(default_rate) OVER (ORDER BY idx RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS e1,
    first_value(default_rate) OVER (ORDER BY idx RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS e12,
    SUM(total_funded_volume) OVER (ORDER BY metric_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3s,
    COUNT(total_funded_volume) OVER (ORDER BY metric_month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS r3c
  FROM mi
),
cal AS (
  SELECT metric_month, total_applications, total_funded_volume, total_requested_volume,
    funding_fulfillment_rate, avg_interest_rate, default_rate, delinquency_rate,
    coalesce(total_charged_off_prncp, 0) AS total_charged_off_prncp,
    coalesce(net_recovery_rate, 0) AS net_recovery_rate,
    coalesce(collection_cost_ratio, 0) AS collection_cost_ratio,
    unverified_backlog_share,
    {xr('total_funded_volume - c1', 'c1', 2, 100)} AS mom_volume_growth_pct,
    default_rate - e1 AS mom_default_rate_delta,
    {xr('total_funded_volume - c12', 'c12', 2, 100)} AS yoy_volume_growth_pct,
    default_rate - e12 AS yoy_default_rate_delta,
    {xr('r3s', 'r3c')} AS rolling_3m_avg_funded_volume,
    coalesce(total_recoveries, 0) AS total_recoveries
  FROM cm
)""")

FACT_COLS = ["loan_amnt", "funded_amnt", "int_rate", "installment", "total_pymnt", "total_rec_prncp",
             "total_rec_int", "recoveries", "collection_recovery_fee", "charged_off_principal"]

register("fact_loans", f"""
SELECT loan_id, borrower_id, CAST(issue_date AS VARCHAR) AS issue_date, issue_month,
  CAST(issue_year AS BIGINT) AS issue_year, grade, addr_state,
  CAST(TRY_CAST(trim(substr(term, 1, 3)) AS INTEGER) AS BIGINT) AS term_months,
  purpose, loan_status,
  CAST(is_default AS BIGINT) AS is_default, CAST(is_delinquent AS BIGINT) AS is_delinquent,
  CAST(is_fully_funded AS BIGINT) AS is_fully_funded,
  {cast_cols(FACT_COLS)}
FROM book""")

register("dim_borrower", """
SELECT borrower_id, emp_length, home_ownership, CAST(annual_inc AS DOUBLE) AS annual_inc,
  lower(verification_status) AS verification_status, CAST(dti AS DOUBLE) AS dti,
  CAST(fico_range_low AS DOUBLE) AS fico_range_low, CAST(revol_util AS DOUBLE) AS revol_util,
  CAST(open_acc AS BIGINT) AS open_acc, CAST(total_acc AS BIGINT) AS total_acc
FROM borrowers_b""")

register("dim_date", """
SELECT CAST(d AS VARCHAR) AS date, CAST(year(d) AS BIGINT) AS year,
  'Q' || CAST(quarter(d) AS VARCHAR) AS quarter,
  'Q' || CAST(quarter(d) AS VARCHAR) || '-' || CAST(year(d) AS VARCHAR) AS quarter_year,
  strftime(d, '%B') AS month_name, strftime(d, '%b-%Y') AS month_year,
  CAST(month(d) AS BIGINT) AS month_number, strftime(d, '%Y-%m') AS year_month
FROM (SELECT DISTINCT issue_date AS d FROM book WHERE issue_date IS NOT NULL) t""")

_STATES = ", ".join(f"('{k}', '{v[0]}', '{v[1]}')" for k, v in STATES.items())
register("dim_geography", f"""
SELECT s.addr_state, coalesce(g.state_name, s.addr_state) AS state_name, coalesce(g.region, 'Other') AS region
FROM (SELECT DISTINCT addr_state FROM book WHERE addr_state IS NOT NULL) s
LEFT JOIN (VALUES {_STATES}) g(addr_state, state_name, region) ON s.addr_state = g.addr_state""")

_GRADES = ", ".join(f"('{g}', '{n}', '{t}', {f})" for g, n, t, f in GRADES)
register("dim_loan_grade", f"""
SELECT g.grade, g.grade_name, g.risk_tier, CAST(g.subprime_flag AS BIGINT) AS subprime_flag, CAST(coalesce(f.n, 0) AS BIGINT) AS loan_count
FROM (VALUES {_GRADES}) g(grade, grade_name, risk_tier, subprime_flag)
LEFT JOIN (SELECT grade, count(*) AS n FROM loans_b GROUP BY grade) f ON f.grade = g.grade""")


def _div(a, b, alt):
    return f"coalesce({xr(a, b, 6)}, {alt})"


def _part(keys):
    k = ", ".join(keys)
    return f"""
pt AS (
  SELECT {k}, COUNT(*) AS n, SUM(is_default) AS n_def, SUM(is_delinquent) AS n_del,
    SUM(funded_amnt) AS funded, SUM(loan_amnt) AS requested, SUM(funded_amnt * int_rate) AS funded_x_rate,
    SUM(charged_off_principal) AS charged_off, SUM(recoveries) AS rec, SUM(collection_recovery_fee) AS fees,
    SUM(CASE WHEN lower(verification_status) = 'not verified' THEN 1 ELSE 0 END) AS n_unv
  FROM book GROUP BY {k}
)"""


def _measures(n_months, n_states):
    return {
        "default_rate": _div("n_def", "n", 0),
        "delinquency_rate": _div("n_del", "n", 0),
        "weighted_apr": _div("funded_x_rate", "funded", 0),
        "funding_fulfillment_rate": _div("funded", "requested", 1),
        "total_funded_volume": "funded",
        "total_applications": "n",
        "gross_charged_off_principal": "charged_off",
        "net_recovery_rate": _div("rec", "charged_off", 0),
        "collection_cost_ratio": _div("fees", "rec", 0),
        "net_recovered_cash": "(rec - fees)",
        "regional_throughput": _div("funded", f"{n_months} * {n_states}", 0),
        "backlog_share": _div("n_unv", "n", 0),
    }


_SUMS = "SUM(n) AS n, SUM(n_def) AS n_def, SUM(n_del) AS n_del, SUM(funded) AS funded, SUM(requested) AS requested, " \
        "SUM(funded_x_rate) AS funded_x_rate, SUM(charged_off) AS charged_off, SUM(rec) AS rec, SUM(fees) AS fees, " \
        "SUM(n_unv) AS n_unv"


def _measure_select(key, n_months, n_states, extra=""):
    m = _measures(n_months, n_states)
    cols = [f"CAST({v} AS {'BIGINT' if k == 'total_applications' else 'DOUBLE'}) AS {k}" for k, v in m.items()]
    cols.append(f"CAST({m['weighted_apr']} - {m['default_rate']} * 100 AS DOUBLE) AS risk_adjusted_spread")
    return f"SELECT {key}, " + ", ".join(cols) + extra


register("dax_measures_by_grade", _measure_select("grade", "n_months", "n_states") + f"""
FROM (SELECT grade, {_SUMS}, COUNT(DISTINCT issue_month) AS n_months, COUNT(DISTINCT addr_state) AS n_states
      FROM pt GROUP BY grade) g""", _part(["grade", "issue_month", "addr_state"]))

_M = _measures("1", "n_states")
register("dax_measures_by_month", f"""
SELECT issue_month,
  {', '.join(f"CAST({k} AS {'BIGINT' if k == 'total_applications' else 'DOUBLE'}) AS {k}" for k in _M)},
  CAST(coalesce({xr('total_funded_volume - pv', 'pv', 6)}, 0) AS DOUBLE) AS mom_volume_growth,
  CAST(default_rate - coalesce(pd, 0) AS DOUBLE) AS yoy_default_rate_delta,
  CAST(weighted_apr - default_rate * 100 AS DOUBLE) AS risk_adjusted_spread
FROM (
  SELECT *,
    first_value(total_funded_volume) OVER (ORDER BY mi RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS pv,
    first_value(default_rate) OVER (ORDER BY mi RANGE BETWEEN 12 PRECEDING AND 12 PRECEDING) AS pd
  FROM (
    SELECT issue_month, CAST(substr(issue_month, 1, 4) AS INTEGER) * 12 + CAST(substr(issue_month, 6, 2) AS INTEGER) AS mi,
      {', '.join(f'{v} AS {k}' for k, v in _M.items())}
    FROM (SELECT issue_month, {_SUMS}, COUNT(*) AS n_states FROM pt GROUP BY issue_month) g) x) y""",
         _part(["issue_month", "addr_state"]))

_MS = _measures("n_months", "n_states")
register("state_efficiency", f"""
SELECT addr_state, CAST({_MS['regional_throughput']} AS DOUBLE) AS processing_throughput,
  CAST({_MS['backlog_share']} AS DOUBLE) AS unverified_share, CAST({_MS['default_rate']} AS DOUBLE) AS default_rate
FROM (SELECT addr_state, {_SUMS}, COUNT(DISTINCT issue_month) AS n_months, COUNT(DISTINCT addr_state) AS n_states
      FROM pt GROUP BY addr_state) g""", _part(["addr_state", "issue_month"]))

register("cohort_matrix", f"""
SELECT grade, home_ownership, CAST(issue_year AS BIGINT) AS issue_year,
  CAST({_div('SUM(is_default)', 'COUNT(*)', 0)} AS DOUBLE) AS default_rate,
  CAST(SUM(charged_off_principal) AS DOUBLE) AS gross_charged_off_principal
FROM book GROUP BY grade, home_ownership, issue_year""")

register("collections_funnel", """
SELECT CAST(1 AS BIGINT) AS stage, 'Gross Charged Off Principal' AS level, CAST(SUM(charged_off_principal) AS DOUBLE) AS amount FROM book
UNION ALL SELECT 2, 'Recoveries', CAST(SUM(recoveries) AS DOUBLE) FROM book
UNION ALL SELECT 3, 'Net Recovered Cash', CAST(SUM(recoveries) - SUM(collection_recovery_fee) AS DOUBLE) FROM book""")

_NN = " OR ".join(f"{c} IS NULL" for c in ["borrower_id", "issue_month", "issue_year", "loan_amnt", "funded_amnt",
                                            "term", "int_rate", "installment", "grade", "sub_grade", "loan_status"])


def _chk(name, table, v):
    return (f"SELECT '{name}' AS check_name, '{table}' AS table_name, CAST(coalesce(v, 0) AS BIGINT) AS violations, "
            f"coalesce(v, 0) = 0 AS passed FROM ({v}) t(v)")


register("validate_tables", "\nUNION ALL\n".join([
    _chk("primary_key_unique", "loans", "SELECT COUNT(*) FROM (SELECT loan_id FROM loans_b GROUP BY loan_id HAVING COUNT(*) > 1)"),
    _chk("primary_key_unique", "borrowers", "SELECT COUNT(*) FROM (SELECT borrower_id FROM borrowers_b GROUP BY borrower_id HAVING COUNT(*) > 1)"),
    _chk("primary_key_unique", "payments_recoveries", "SELECT COUNT(*) FROM (SELECT loan_id FROM lp GROUP BY loan_id HAVING COUNT(*) > 1)"),
    _chk("foreign_key_present", "loans", "SELECT COUNT(*) FROM loans_b l ANTI JOIN borrowers_b b ON l.borrower_id = b.borrower_id"),
    _chk("foreign_key_present", "payments_recoveries", "SELECT COUNT(*) FROM lp p ANTI JOIN loans_b l ON p.loan_id = l.loan_id"),
    _chk("not_null", "loans", f"SELECT COUNT(CASE WHEN {_NN} THEN 1 END) FROM loans_b"),
    _chk("non_empty", "loans", "SELECT CAST(COUNT(*) = 0 AS INTEGER) FROM loans_b"),
    _chk("non_empty", "borrowers", "SELECT CAST(COUNT(*) = 0 AS INTEGER) FROM borrowers_b"),
    _chk("non_empty", "payments_recoveries", "SELECT CAST(COUNT(*) = 0 AS INTEGER) FROM lp"),
    _chk("row_count_floor", "loans", "SELECT CAST(COUNT(*) < 100 AS INTEGER) FROM loans_b"),
    _chk("row_count_floor", "borrowers", "SELECT CAST(COUNT(*) < 10 AS INTEGER) FROM borrowers_b"),
    _chk("row_count_floor", "payments_recoveries", "SELECT CAST(COUNT(*) < 100 AS INTEGER) FROM lp"),
    _chk("default_rate_in_0_100", "monthly_kpi_rollup",
         "SELECT COUNT(CASE WHEN default_rate IS NULL OR default_rate < 0 OR default_rate > 100 THEN 1 END) FROM ro"),
    _chk("fulfillment_at_least_50", "monthly_kpi_rollup",
         "SELECT COUNT(CASE WHEN funding_fulfillment_rate IS NULL OR funding_fulfillment_rate < 50 THEN 1 END) FROM ro"),
    _chk("non_empty", "monthly_kpi_rollup", "SELECT CAST(COUNT(*) = 0 AS INTEGER) FROM ro"),
]), rollup_ctes())

register("distinct_states", "SELECT DISTINCT addr_state FROM borrowers_b ORDER BY addr_state")

register("monthly_kpi_rollup_states", f"""
SELECT metric_month, {cast_cols(ROLLUP_COLS, ['total_applications'])}
FROM ro ORDER BY metric_month""", rollup_ctes().replace("FROM book GROUP BY", "FROM book WHERE addr_state IN ('CA', 'NY', 'TX') GROUP BY"))

register("star_report", f"""
SELECT coalesce(g.region, 'Other') AS region, d.risk_tier,
  CAST(COUNT(*) AS BIGINT) AS loans, CAST(SUM(funded_amnt) AS DOUBLE) AS total_funded_volume,
  CAST({_div('SUM(is_default)', 'COUNT(*)', 0)} AS DOUBLE) AS default_rate,
  CAST({_div('SUM(funded_amnt * int_rate)', 'SUM(funded_amnt)', 0)} AS DOUBLE) AS weighted_apr
FROM book f
LEFT JOIN (VALUES {_STATES}) g(addr_state, state_name, region) ON f.addr_state = g.addr_state
LEFT JOIN (VALUES {_GRADES}) d(grade, grade_name, risk_tier, subprime_flag) ON f.grade = d.grade
GROUP BY coalesce(g.region, 'Other'), d.risk_tier""")

register("star_report_full", f"""
SELECT CAST(year(issue_date) AS BIGINT) AS year, coalesce(g.region, 'Other') AS region, d.risk_tier, lower(verification_status) AS verification_status,
  CAST(COUNT(*) AS BIGINT) AS loans, CAST(SUM(funded_amnt) AS DOUBLE) AS total_funded_volume,
  CAST({_div('SUM(is_default)', 'COUNT(*)', 0)} AS DOUBLE) AS default_rate
FROM book f
LEFT JOIN (VALUES {_STATES}) g(addr_state, state_name, region) ON f.addr_state = g.addr_state
LEFT JOIN (VALUES {_GRADES}) d(grade, grade_name, risk_tier, subprime_flag) ON f.grade = d.grade
GROUP BY year(issue_date), coalesce(g.region, 'Other'), d.risk_tier, lower(verification_status)""")


register("cohort_matrix_wide", """
SELECT * FROM (PIVOT cm ON issue_year USING first(default_rate) AS default_rate, first(loss) AS gross_charged_off_principal GROUP BY grade, home_ownership)""", f"""
cm AS (SELECT grade, home_ownership, issue_year, CAST({_div('SUM(is_default)', 'COUNT(*)', 0)} AS DOUBLE) AS default_rate,
    CAST(SUM(charged_off_principal) AS DOUBLE) AS loss FROM book GROUP BY grade, home_ownership, issue_year)""")
SQL["star_export_round_trip"] = SQL["fact_loans"]
