"""The loan book as DuckDB SQL CTEs, plus exact-rounding SQL helpers.

The oracle SQL is written independently of the Spark code: the same
mapping rules from the driver tables, expressed as plain SQL over the
pre-registered views ``orders``, ``customer`` and ``lineitem``.
"""

from __future__ import annotations

STATE_CODES = ["CA", "NY", "TX", "FL", "IL", "PA", "OH", "GA", "NC", "MI", "NJ", "VA", "WA",
               "AZ", "MA", "TN", "IN", "MO", "MD", "WI", "CO", "MN", "SC", "AL", "LA"]
CO_POLICY = "Does not meet the credit policy. Status:Charged Off"


def xr(num: str, den: str, digits: int = 2, mult: int = 1) -> str:
    """SQL for round(mult*num/den, digits), half away from zero, exact (DECIMAL).

    ``num``/``den`` must be exact (integer or DECIMAL with scale <= 10).
    """
    n = f"(CAST(({num}) * 10000000000 AS HUGEINT) * {mult * 10 ** digits})"
    d = f"NULLIF(CAST(({den}) * 10000000000 AS HUGEINT), 0)"
    q = f"((2 * abs({n}) + abs({d})) // (2 * abs({d})))"
    signed = f"(CASE WHEN ({n} < 0) <> ({d} < 0) THEN -{q} ELSE {q} END)"
    if digits == 0:
        return f"CAST({signed} AS DECIMAL(38,0))"
    unit = "0." + "0" * (digits - 1) + "1"
    return f"(CAST({signed} AS DECIMAL(38,0)) * {unit})"


def mean(x: str, digits: int = 2) -> str:
    return xr(f"SUM({x})", f"COUNT({x})", digits)


def pct(flag: str, digits: int = 2) -> str:
    return xr(f"SUM({flag})", "COUNT(*)", digits, 100)


UNVERIFIED = "(CASE WHEN lower(trim(verification_status)) = 'not verified' THEN 1 ELSE 0 END)"

_DEF = "(((o_orderkey * 31 + o_custkey * 17) % 100) < 3 + 3 * (o_custkey % 7) + CASE WHEN year(o_orderdate) <= 1997 THEN 12 ELSE 0 END)"

LOANS = f"""
loans_raw AS (
  SELECT o_orderkey AS loan_key, o_custkey AS borrower_key,
    CAST(o_orderkey AS VARCHAR) AS loan_id, CAST(o_custkey AS VARCHAR) AS borrower_id,
    CAST(date_trunc('month', o_orderdate) AS DATE) AS issue_date,
    CAST(year(o_orderdate) AS INTEGER) AS issue_year,
    CAST(o_totalprice AS DECIMAL(18,2)) AS loan_amnt,
    CAST(round(CAST(o_totalprice AS DECIMAL(18,2)) *
      (CASE WHEN o_orderkey % 40 = 0 THEN 0.10 WHEN o_orderkey % 40 = 1 THEN 0.96 ELSE 1.00 END), 2)
      AS DECIMAL(18,2)) AS funded_amnt,
    CASE WHEN o_orderkey % 3 = 0 THEN 60 ELSE 36 END AS term_months,
    CAST(5.50 + 2.50 * (o_custkey % 7) + 0.01 * (o_orderkey % 100) AS DECIMAL(6,2)) AS int_rate,
    substr('ABCDEFG', CAST(o_custkey % 7 + 1 AS INTEGER), 1) AS grade,
    substr('ABCDEFG', CAST(o_custkey % 7 + 1 AS INTEGER), 1) || CAST(o_orderkey % 5 + 1 AS VARCHAR) AS sub_grade,
    lower(o_orderpriority) AS purpose,
    trim(coalesce(CASE
      WHEN {_DEF} THEN (CASE WHEN o_orderkey % 20 = 0 THEN 'Default'
                             WHEN o_orderkey % 20 = 1 THEN '{CO_POLICY}'
                             ELSE 'Charged Off' END)
      WHEN o_orderstatus = 'F' THEN 'Fully Paid'
      WHEN o_orderstatus = 'O' THEN 'Current'
      WHEN o_orderstatus = 'P' THEN (CASE o_orderkey % 4 WHEN 0 THEN 'Late (31-120 days)'
                                     WHEN 1 THEN 'Late (16-30 days)' WHEN 2 THEN 'In Grace Period'
                                     ELSE 'Fully Paid' END)
    END, 'Unknown')) AS loan_status
  FROM orders
),
loans_b AS (
  SELECT *,
    strftime(issue_date, '%Y-%m') AS issue_month,
    funded_amnt AS funded_amnt_inv,
    CAST(term_months AS VARCHAR) || ' months' AS term,
    round(CASE WHEN CAST(int_rate AS DOUBLE) / 1200.0 = 0 THEN CAST(loan_amnt AS DOUBLE) / term_months
          ELSE CAST(loan_amnt AS DOUBLE) * (CAST(int_rate AS DOUBLE) / 1200.0)
               * pow(1.0 + CAST(int_rate AS DOUBLE) / 1200.0, CAST(term_months AS DOUBLE))
               / (pow(1.0 + CAST(int_rate AS DOUBLE) / 1200.0, CAST(term_months AS DOUBLE)) - 1.0) END, 2) AS installment,
    CASE WHEN lower(loan_status) LIKE '%charged off%' OR lower(loan_status) LIKE '%default%' THEN 1 ELSE 0 END AS is_default,
    CASE WHEN lower(loan_status) LIKE '%late%' OR lower(loan_status) LIKE '%grace%'
              OR lower(loan_status) LIKE '%default%' THEN 1 ELSE 0 END AS is_delinquent,
    CASE WHEN funded_amnt >= loan_amnt THEN 1 ELSE 0 END AS is_fully_funded
  FROM loans_raw
)"""

BORROWERS = f"""
borrowers_b AS (
  SELECT c_custkey AS borrower_key, CAST(c_custkey AS VARCHAR) AS borrower_id,
    CAST(c_custkey % 11 AS VARCHAR) || ' years' AS emp_length,
    CASE WHEN c_mktsegment = 'BUILDING' THEN 'OWN'
         WHEN c_mktsegment IN ('HOUSEHOLD', 'FURNITURE') THEN 'MORTGAGE' ELSE 'RENT' END AS home_ownership,
    CAST(21000.00 + 10 * CAST(c_acctbal AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS annual_inc,
    CASE WHEN c_custkey % 5 < 2 THEN 'Not Verified' WHEN c_custkey % 5 < 4 THEN 'Verified'
         ELSE 'Source Verified' END AS verification_status,
    ({STATE_CODES!r})[c_nationkey + 1] AS addr_state,
    CAST((c_custkey * 13) % 5000 * 0.01 AS DECIMAL(6,2)) AS dti,
    CAST(740 - CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 10 + 30 * (c_custkey % 7) END AS INTEGER) AS fico_range_low,
    CAST(744 - CASE WHEN c_custkey % 7 = 0 THEN 0 ELSE 10 + 30 * (c_custkey % 7) END AS INTEGER) AS fico_range_high,
    CAST(c_custkey % 30 + 1 AS INTEGER) AS open_acc,
    CAST(c_acctbal AS DECIMAL(18,2)) AS revol_bal,
    CAST((c_custkey * 29) % 1200 * 0.1 AS DECIMAL(6,1)) AS revol_util,
    CAST(c_custkey % 30 + 1 + c_custkey % 20 AS INTEGER) AS total_acc
  FROM customer
)"""

PAYMENTS = """
ret_b AS (
  SELECT l_orderkey AS loan_key,
    SUM(CASE WHEN l_returnflag = 'R' THEN CAST(l_extendedprice AS DECIMAL(18,2))
             ELSE CAST(0 AS DECIMAL(18,2)) END) AS returned
  FROM lineitem GROUP BY l_orderkey
),
lp1 AS (
  SELECT l.*, r.returned,
    CAST(CASE WHEN is_default = 1 THEN round(funded_amnt * 0.40, 2)
              WHEN loan_status = 'Fully Paid' THEN funded_amnt
              ELSE round(funded_amnt * 0.70, 2) END AS DECIMAL(18,2)) AS total_rec_prncp,
    CAST(CASE WHEN is_default = 1 THEN round(r.returned * 0.15, 2) ELSE 0 END AS DECIMAL(18,2)) AS recoveries,
    CAST(CASE WHEN is_default = 1 THEN round(r.returned * 0.15 * 0.18, 2) ELSE 0 END AS DECIMAL(18,2)) AS collection_recovery_fee
  FROM loans_b l JOIN ret_b r ON l.loan_key = r.loan_key
),
lp AS (
  SELECT *,
    CAST(CASE WHEN is_default = 1 THEN greatest(0, funded_amnt - total_rec_prncp) ELSE 0 END AS DECIMAL(18,2)) AS charged_off_principal,
    CAST(round(total_rec_prncp * 0.12, 2) AS DECIMAL(18,2)) AS total_rec_int,
    CAST(0 AS DECIMAL(18,2)) AS total_rec_late_fee,
    CAST(0 AS DECIMAL(18,2)) AS last_pymnt_amnt,
    CAST(NULL AS VARCHAR) AS last_pymnt_d,
    CAST(total_rec_prncp + CAST(round(total_rec_prncp * 0.12, 2) AS DECIMAL(18,2)) + recoveries AS DECIMAL(18,2)) AS total_pymnt
  FROM lp1
)"""

JOINS = """
lb AS (
  SELECT l.*, b.emp_length, b.home_ownership, b.annual_inc, b.verification_status, b.addr_state,
         b.dti, b.fico_range_low, b.fico_range_high, b.open_acc, b.revol_bal, b.revol_util, b.total_acc
  FROM loans_b l JOIN borrowers_b b ON l.borrower_key = b.borrower_key
),
book AS (
  SELECT p.*, b.emp_length, b.home_ownership, b.annual_inc, b.verification_status, b.addr_state,
         b.dti, b.fico_range_low, b.fico_range_high, b.open_acc, b.revol_bal, b.revol_util, b.total_acc
  FROM lp p JOIN borrowers_b b ON p.borrower_key = b.borrower_key
)"""

ALL_CTES = ",".join([LOANS, BORROWERS, PAYMENTS, JOINS])


def with_book(sql: str, extra_ctes: str = "") -> str:
    """Prefix ``sql`` with the loan-book CTEs (and optional extra CTEs)."""
    ctes = ALL_CTES + ("," + extra_ctes if extra_ctes else "")
    return f"WITH {ctes}\n{sql}"
