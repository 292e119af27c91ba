"""Oracle SQL for the ETL round trip: the expected cleaned rows, stated directly."""

from __future__ import annotations

from .queries import register

_D = lambda c: f"CAST({c} AS DOUBLE)"

register("clean_raw_loans", f"""
SELECT 'L' || loan_id AS loan_id, issue_month, CAST(issue_year AS BIGINT) AS issue_year, CAST(issue_date AS VARCHAR) AS issue_date,
  {_D('loan_amnt')} AS loan_amnt, {_D('funded_amnt')} AS funded_amnt, {_D('funded_amnt')} AS funded_amnt_inv,
  term, {_D('int_rate')} AS int_rate, installment, grade,
  CASE WHEN loan_key % 9 = 0 THEN grade || '1' ELSE sub_grade END AS sub_grade,
  purpose, loan_status,
  CAST(is_default AS BIGINT) AS is_default, CAST(is_delinquent AS BIGINT) AS is_delinquent,
  CAST(CASE WHEN {_D('funded_amnt')} >= {_D('loan_amnt')} THEN 1 ELSE 0 END AS BIGINT) AS is_fully_funded,
  home_ownership, verification_status, addr_state,
  CAST(CASE WHEN loan_key % 2 = 0 THEN 660 ELSE fico_range_low END AS DOUBLE) AS fico_range_low,
  CAST(CASE WHEN loan_key % 2 = 0 THEN 664 ELSE fico_range_low + 4 END AS DOUBLE) AS fico_range_high,
  {_D('dti')} AS dti, {_D('revol_util')} AS revol_util, {_D('annual_inc')} AS annual_inc, emp_length,
  {_D('total_rec_prncp')} AS total_rec_prncp, {_D('recoveries')} AS recoveries,
  CASE WHEN is_default = 1 THEN greatest(0.0, {_D('funded_amnt')} - {_D('total_rec_prncp')}) ELSE 0.0 END
    AS charged_off_principal
FROM book""")

# ---- the three tables from raw rows with faults -----------------------------------

_KEPT = "loan_key % 13 <> 0 AND loan_key % 17 <> 0 AND loan_key % 19 <> 0"
_DIRTY = f"""
db AS (
  SELECT *, row_number() OVER (ORDER BY loan_key) AS pos,
    CASE WHEN loan_key % 29 = 0 THEN 705 WHEN loan_key % 2 = 0 THEN 660 ELSE fico_range_low END AS fico
  FROM book WHERE {_KEPT}
)"""
_LOAN_ID = "CASE WHEN loan_key % 23 = 0 THEN 'LN_' || lpad(CAST(pos AS VARCHAR), 7, '0') ELSE 'L' || loan_id END"
_BORROWER_ID = "'BRW_' || lpad(CAST(pos AS VARCHAR), 7, '0')"
_I = lambda c: f"CAST({c} AS BIGINT) AS {c}"

register("etl_loans", f"""
SELECT {_LOAN_ID} AS loan_id, {_BORROWER_ID} AS borrower_id, CAST(issue_date AS VARCHAR) AS issue_date, issue_month, {_I('issue_year')},
  {_D('loan_amnt')} AS loan_amnt, {_D('funded_amnt')} AS funded_amnt, {_D('funded_amnt')} AS funded_amnt_inv, term,
  {_D('int_rate')} AS int_rate, installment, grade, CASE WHEN loan_key % 9 = 0 THEN grade || '1' ELSE sub_grade END AS sub_grade,
  purpose, loan_status, {_I('is_default')}, {_I('is_delinquent')},
  CAST(CASE WHEN {_D('funded_amnt')} >= {_D('loan_amnt')} THEN 1 ELSE 0 END AS BIGINT) AS is_fully_funded
FROM db""", _DIRTY)

register("etl_borrowers", f"""
SELECT {_BORROWER_ID} AS borrower_id, emp_length, home_ownership, {_D('annual_inc')} AS annual_inc, verification_status, addr_state,
  {_D('dti')} AS dti, CAST(fico AS DOUBLE) AS fico_range_low, CAST(fico + 4 AS DOUBLE) AS fico_range_high, {_D('open_acc')} AS open_acc,
  {_D('revol_bal')} AS revol_bal, {_D('revol_util')} AS revol_util, {_D('total_acc')} AS total_acc
FROM db""", _DIRTY)

register("etl_payments", f"""
SELECT {_LOAN_ID} AS loan_id, {_D('total_pymnt')} AS total_pymnt, {_D('total_rec_prncp')} AS total_rec_prncp, {_D('total_rec_int')} AS total_rec_int,
  CAST(0 AS DOUBLE) AS total_rec_late_fee, {_D('recoveries')} AS recoveries, {_D('collection_recovery_fee')} AS collection_recovery_fee,
  CAST(NULL AS VARCHAR) AS last_pymnt_d, CAST(0 AS DOUBLE) AS last_pymnt_amnt,
  CASE WHEN is_default = 1 THEN greatest(0.0, {_D('funded_amnt')} - {_D('total_rec_prncp')}) ELSE 0.0 END AS charged_off_principal
FROM db""", _DIRTY)

register("rejected_rows", """
SELECT loan_key AS position, CASE WHEN loan_key % 23 = 0 THEN '' ELSE 'L' || loan_id END AS id,
  CASE WHEN loan_key % 13 = 0 THEN 'n/a' ELSE '$' || format('{:,.2f}', loan_amnt) END AS loan_amnt,
  CASE WHEN loan_key % 17 = 0 THEN '' WHEN loan_key % 19 = 0 THEN 'Xyz-1999' ELSE strftime(issue_date, '%b-%Y') END AS issue_d,
  CASE WHEN loan_key % 13 = 0 THEN 'loan_amnt' ELSE 'issue_d' END AS reason
FROM book WHERE loan_key % 13 = 0 OR loan_key % 17 = 0""")

register("raw_round_trip", """
SELECT CASE WHEN loan_key % 23 = 0 THEN '' ELSE 'L' || loan_id END AS id, CAST(loan_amnt AS VARCHAR) AS loan_amnt,
  CAST(int_rate AS VARCHAR) AS int_rate,
  CASE WHEN loan_key % 19 = 0 THEN 'Xyz-1999' ELSE strftime(issue_date, '%b-%Y') END AS issue_d,
  emp_length || CASE WHEN loan_key % 30 = 0 THEN chr(10) || '"self", reported' ELSE '' END AS emp_length, upper(purpose) AS purpose,
  CASE WHEN verification_status = 'Verified' AND loan_key % 2 = 0 THEN 'VERIFIED - income' ELSE verification_status END AS verification_status,
  lower(addr_state) AS addr_state, CAST(dti AS VARCHAR) AS dti, CAST(recoveries AS VARCHAR) AS recoveries
FROM book WHERE loan_key % 13 <> 0 AND loan_key % 17 <> 0""")

register("etl_repeated_rows", f"""
SELECT 'L' || loan_id AS loan_id, CAST(1 + CASE WHEN loan_key % 3 = 0 THEN 1 ELSE 0 END + CASE WHEN loan_key % 9 = 0 THEN 1 ELSE 0 END AS BIGINT) AS deliveries,
  emp_length, home_ownership, {_D('annual_inc')} AS annual_inc, verification_status, addr_state, {_D('dti')} AS dti,
  CAST(CASE WHEN loan_key % 2 = 0 THEN 660 ELSE fico_range_low END AS DOUBLE) AS fico_range_low,
  CAST(CASE WHEN loan_key % 2 = 0 THEN 664 ELSE fico_range_low + 4 END AS DOUBLE) AS fico_range_high,
  {_D('open_acc')} AS open_acc, {_D('revol_bal')} AS revol_bal, {_D('revol_util')} AS revol_util, {_D('total_acc')} AS total_acc
FROM book""")
