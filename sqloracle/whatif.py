"""Oracle SQL for the what-if scenarios and their parameter sweeps.

The sweeps are written the direct way (every parameter setting joined to the
loans it keeps), which is the brute-force check for the grid algorithm.
"""

from __future__ import annotations

from .book import xr
from .queries import cast_cols, register

RESOLVED = "loan_status IN ('Fully Paid', 'Charged Off', 'Default')"


def usd0(x: str) -> str:
    return f"('$' || format('{{:,}}', CAST(round({x}, 0) AS HUGEINT)))"


def r2(x: str) -> str:
    return f"round({x}, 2)"


# ---- underwriting -----------------------------------------------------------

def _uw_cols(n, vol, dflt, loss, bn, bvol, bdef, bloss):
    dnum = f"(CASE WHEN {n} > 0 THEN {dflt} * {bn} - {bdef} * {n} ELSE -{bdef} END)"
    dden = f"(CASE WHEN {n} > 0 THEN {n} * {bn} ELSE {bn} END)"
    return {
        "sim_loan_count": n,
        "sim_funded_volume": vol,
        "sim_default_rate_pct": f"(CASE WHEN {n} > 0 THEN {xr(dflt, n, 2, 100)} ELSE 0 END)",
        "sim_credit_losses": loss,
        "volume_change_pct": xr(f"{vol} - {bvol}", bvol, 2, 100),
        "default_rate_delta_pts": xr(dnum, dden, 2, 100),
        "losses_saved_dollars": f"({bloss} - {loss})",
        "volume_sacrificed_dollars": f"({bvol} - {vol})",
        "vc6": xr(f"{vol} - {bvol}", bvol, 6, 100),
        "dd6": xr(dnum, dden, 6, 100),
    }


_UW = _uw_cols("n", "vol", "dflt", "loss", "bn", "bvol", "bdef", "bloss")
_UW_KEEP = "fico_range_low >= 660 AND dti <= 35.0"

register("whatif_underwriting", f"""
SELECT 'Underwriting Tightening (FICO / DTI)' AS scenario_name,
  CAST(660 AS DOUBLE) AS min_fico, CAST(35.0 AS DOUBLE) AS max_dti,
  CAST(bn AS BIGINT) AS baseline_loan_count,
  CAST(bvol AS DOUBLE) AS baseline_funded_volume,
  CAST({xr('bdef', 'bn', 2, 100)} AS DOUBLE) AS baseline_default_rate_pct,
  CAST(bloss AS DOUBLE) AS baseline_credit_losses,
  CAST(n AS BIGINT) AS sim_loan_count,
  {cast_cols(['sim_funded_volume', 'sim_default_rate_pct', 'sim_credit_losses', 'volume_change_pct',
              'default_rate_delta_pts', 'losses_saved_dollars', 'volume_sacrificed_dollars'])},
  CASE WHEN abs(vc6) < 10 AND dd6 <= -1 THEN
         'Highly Recommended: Tightening to FICO >= 660 & DTI <= 35.0% reduces default rate by '
         || CAST(round(abs(dd6), 2) AS VARCHAR) || ' pts and saves ' || {usd0('losses_saved_dollars')}
         || ' in credit losses while sacrificing only ' || CAST(round(abs(vc6), 1) AS VARCHAR)
         || '% of origination volume.'
       WHEN abs(vc6) > 25 THEN
         'Caution (Severe Volume Drag): Tightening eliminates ' || CAST(round(abs(vc6), 1) AS VARCHAR)
         || '% of origination volume (' || {usd0('volume_sacrificed_dollars')}
         || '). Although default rate drops by ' || CAST(round(abs(dd6), 2) AS VARCHAR)
         || ' pts, the revenue loss outweighs credit loss mitigation.'
       ELSE 'Moderate Trade-off: Saves ' || {usd0('losses_saved_dollars')} || ' in gross charge-offs with a '
         || CAST(round(abs(vc6), 1) AS VARCHAR) || '% reduction in originations. Consider phased implementation.'
  END AS recommendation
FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _UW.items() if k != 'sim_loan_count')} FROM ua) t""", f"""
ua AS (
  SELECT COUNT(*) AS bn, SUM(funded_amnt) AS bvol, SUM(is_default) AS bdef, SUM(charged_off_principal) AS bloss,
    COUNT(CASE WHEN {_UW_KEEP} THEN 1 END) AS n,
    coalesce(SUM(CASE WHEN {_UW_KEEP} THEN funded_amnt END), 0) AS vol,
    coalesce(SUM(CASE WHEN {_UW_KEEP} THEN is_default END), 0) AS dflt,
    coalesce(SUM(CASE WHEN {_UW_KEEP} THEN charged_off_principal END), 0) AS loss
  FROM book WHERE {RESOLVED}
)""")

register("whatif_underwriting_sweep", f"""
SELECT CAST(min_fico AS DOUBLE) AS min_fico, CAST(max_dti AS DOUBLE) AS max_dti,
  CAST(n AS BIGINT) AS sim_loan_count,
  {cast_cols(['sim_funded_volume', 'sim_default_rate_pct', 'sim_credit_losses', 'volume_change_pct',
              'default_rate_delta_pts', 'losses_saved_dollars', 'volume_sacrificed_dollars'])}
FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _UW.items() if k != 'sim_loan_count')}
      FROM sw JOIN base ON TRUE) t""", f"""
rb AS (SELECT * FROM book WHERE {RESOLVED}),
base AS (SELECT COUNT(*) AS bn, SUM(funded_amnt) AS bvol, SUM(is_default) AS bdef,
                SUM(charged_off_principal) AS bloss FROM rb),
prm AS (SELECT CAST(f AS DECIMAL(18,2)) AS min_fico, CAST(d AS DECIMAL(18,2)) AS max_dti
        FROM range(600, 751, 10) t1(f), range(15, 46) t2(d)),
sw AS (
  SELECT p.min_fico, p.max_dti, COUNT(r.loan_key) AS n,
    coalesce(SUM(r.funded_amnt), 0) AS vol, coalesce(SUM(r.is_default), 0) AS dflt,
    coalesce(SUM(r.charged_off_principal), 0) AS loss
  FROM prm p LEFT JOIN rb r ON r.fico_range_low >= p.min_fico AND r.dti <= p.max_dti
  GROUP BY p.min_fico, p.max_dti
)""")

# ---- pricing ------------------------------------------------------------------

_PA = f"""
pa AS (
  SELECT SUM(funded_amnt * int_rate) * 0.01 AS base_income,
    coalesce(SUM(CASE WHEN grade IN ('C', 'D', 'E', 'F', 'G') THEN funded_amnt END), 0) AS sub_funded,
    SUM(charged_off_principal) AS base_losses
  FROM lp WHERE {RESOLVED}
)"""


def _pricing_cols(bps: str, factor: str) -> dict:
    sim_income = f"(base_income + sub_funded * {bps} * 0.0001)"
    sim_losses = f"(base_losses * {factor})"
    base_net = "(base_income - base_losses)"
    sim_net = f"({sim_income} - {sim_losses})"
    return {
        "baseline_gross_interest_income": "base_income",
        "baseline_expected_losses": "base_losses",
        "baseline_net_yield": base_net,
        "sim_gross_interest_income": sim_income,
        "sim_expected_losses": sim_losses,
        "sim_net_yield": sim_net,
        "interest_income_delta": f"({sim_income} - base_income)",
        "net_yield_delta": f"({sim_net} - {base_net})",
        "net_yield_growth_pct": xr(f"{sim_net} - {base_net}", f"abs({base_net})", 2, 100),
    }


_P150 = _pricing_cols("150", "1.012")
register("whatif_pricing", f"""
SELECT 'Risk-Based APR Repricing (Grades C-G)' AS scenario_name, CAST(150 AS BIGINT) AS apr_delta_bps,
  {', '.join(f'CAST({r2(v)} AS DOUBLE) AS {k}' for k, v in _P150.items())},
  CASE WHEN {_P150['net_yield_delta']} > 0 THEN
    'Positive Net Return: Adjusting lower-grade pricing by +150 bps increases annual interest revenue by '
    || {usd0(_P150['interest_income_delta'])} || ', yielding a net bottom-line gain of '
    || {usd0(_P150['net_yield_delta'])} || ' after accounting for adverse selection.'
  ELSE 'Negative Trade-off: Rate adjustment of +150 bps results in a net yield reduction of $'
    || CAST(CAST(round(abs({_P150['net_yield_delta']}), 0) AS HUGEINT) AS VARCHAR)
    || ' due to elevated borrower default sensitivity.' END AS recommendation
FROM pa""", _PA)

_PS = _pricing_cols("bps", "factor")
register("whatif_pricing_sweep", f"""
SELECT CAST(bps AS BIGINT) AS apr_delta_bps,
  {', '.join(f'CAST({r2(v)} AS DOUBLE) AS {k}' for k, v in _PS.items() if not k.startswith('baseline'))}
FROM pa JOIN (
  SELECT b AS bps,
    CASE WHEN b > 0 THEN 1 + b * 0.01 * 0.008 ELSE greatest(0.9, 1 + b * 0.01 * 0.008) END AS factor
  FROM range(-300, 401, 25) t(b)) p ON TRUE""", _PA)

# ---- funding ---------------------------------------------------------------------

register("whatif_funding", f"""
SELECT 'Funding Fulfillment Policy Threshold' AS scenario_name,
  CAST(95.0 AS DOUBLE) AS min_fulfillment_threshold_pct,
  CAST(total AS BIGINT) AS total_applications,
  CAST({xr('full_n', 'total', 2, 100)} AS DOUBLE) AS baseline_qualified_loans_pct,
  CAST(bvol AS DOUBLE) AS baseline_funded_volume,
  CAST(q AS BIGINT) AS qualified_loans_count,
  CAST({xr('q', 'total', 2, 100)} AS DOUBLE) AS qualified_loans_pct,
  CAST(svol AS DOUBLE) AS sim_funded_volume,
  CAST(total - q AS BIGINT) AS cancelled_loans_count,
  CAST({xr('svol - bvol', 'bvol', 2, 100)} AS DOUBLE) AS volume_impact_pct,
  'Policy Threshold at 95.0%: Qualifies ' || CAST({xr('q', 'total', 1, 100)} AS VARCHAR)
  || '% of origination pipeline. Drops ' || format('{{:,}}', total - q)
  || ' partially funded applications (' || {usd0('abs(svol - bvol)')}
  || ' volume impact). Guarantees near-complete investor backing and eliminates '
  || 'partial-origination servicing friction.' AS recommendation
FROM (
  SELECT COUNT(*) AS total,
    COUNT(CASE WHEN loan_amnt <> 0 AND funded_amnt * 100 >= 99.9 * loan_amnt THEN 1 END) AS full_n,
    SUM(funded_amnt) AS bvol,
    COUNT(CASE WHEN loan_amnt <> 0 AND funded_amnt * 100 >= 95.0 * loan_amnt THEN 1 END) AS q,
    coalesce(SUM(CASE WHEN loan_amnt <> 0 AND funded_amnt * 100 >= 95.0 * loan_amnt THEN funded_amnt END), 0) AS svol
  FROM loans_b) t""")

register("whatif_funding_sweep", f"""
SELECT CAST(thr AS DOUBLE) AS min_fulfillment_threshold_pct,
  CAST(q AS BIGINT) AS qualified_loans_count,
  CAST({xr('q', 'total', 2, 100)} AS DOUBLE) AS qualified_loans_pct,
  CAST(svol AS DOUBLE) AS sim_funded_volume,
  CAST(total - q AS BIGINT) AS cancelled_loans_count,
  CAST({xr('svol - bvol', 'bvol', 2, 100)} AS DOUBLE) AS volume_impact_pct
FROM (
  SELECT p.thr, COUNT(l.loan_key) AS q, coalesce(SUM(l.funded_amnt), 0) AS svol
  FROM range(80, 101) p(thr)
  LEFT JOIN loans_b l ON l.loan_amnt <> 0 AND l.funded_amnt * 100 >= p.thr * l.loan_amnt
  GROUP BY p.thr) s
JOIN (SELECT COUNT(*) AS total, SUM(funded_amnt) AS bvol FROM loans_b) b ON TRUE""")

# ---- collections -----------------------------------------------------------------

_CA = """
ca AS (
  SELECT coalesce(SUM(recoveries), 0) AS base_rec, coalesce(SUM(collection_recovery_fee), 0) AS base_fees,
    coalesce(SUM(charged_off_principal), 0) AS base_loss
  FROM lp WHERE is_default = 1 AND charged_off_principal > 0
)"""


def _coll_cols(u: str, f: str) -> dict:
    sim_rec = f"(base_rec * (1 + {u} * 0.01))"
    sim_fees = f"({sim_rec} * {f} * 0.01)"
    base_net = "(base_rec - base_fees)"
    sim_net = f"({sim_rec} - {sim_fees})"
    delta = f"({sim_net} - {base_net})"
    return {
        "baseline_gross_recoveries": "base_rec",
        "baseline_collection_fees": "base_fees",
        "baseline_net_recovered_cash": base_net,
        "baseline_recovery_rate_pct": xr("base_rec", "base_loss", 2, 100),
        "sim_gross_recoveries": sim_rec,
        "sim_collection_fees": sim_fees,
        "sim_net_recovered_cash": sim_net,
        "sim_recovery_rate_pct": xr(sim_rec, "base_loss", 2, 100),
        "net_cash_delta": delta,
        "net_cash_uplift_pct": xr(delta, f"greatest({base_net}, 1)", 2, 100),
    }


_C = _coll_cols("25.0", "16.0")
register("whatif_collections", f"""
SELECT 'Collections Recovery & Fee Optimization' AS scenario_name,
  CAST(25.0 AS DOUBLE) AS recovery_rate_uplift_pct, CAST(16.0 AS DOUBLE) AS fee_commission_pct,
  {', '.join(f'CAST({r2(v)} AS DOUBLE) AS {k}' for k, v in _C.items())},
  'Collections Enhancement (+25.0% recovery uplift, 16.0% fee cap): Recovers an additional '
  || {usd0(_C['sim_gross_recoveries'] + ' - base_rec')} || ' in delinquent balances, yielding '
  || {usd0(_C['net_cash_delta'])} || ' in net cash after fees. Increases portfolio recovery rate from '
  || CAST({_C['baseline_recovery_rate_pct']} AS VARCHAR) || '% to '
  || CAST({_C['sim_recovery_rate_pct']} AS VARCHAR) || '%.' AS recommendation
FROM ca""", _CA)

_CS = _coll_cols("u", "f")
register("whatif_collections_sweep", f"""
SELECT CAST(u AS DOUBLE) AS recovery_rate_uplift_pct, CAST(f AS DOUBLE) AS fee_commission_pct,
  {', '.join(f'CAST({r2(v)} AS DOUBLE) AS {k}' for k, v in _CS.items() if not k.startswith('baseline'))}
FROM ca JOIN (SELECT CAST(u AS DECIMAL(10,2)) AS u, CAST(f AS DECIMAL(10,2)) AS f
              FROM range(0, 61, 5) t1(u), range(10, 26) t2(f)) p ON TRUE""", _CA)

# ---- verification ----------------------------------------------------------------

_VA = """
va AS (
  SELECT COUNT(*) AS total,
    COUNT(CASE WHEN lower(verification_status) LIKE '%not verified%' THEN 1 END) AS n_unv,
    coalesce(SUM(CASE WHEN lower(verification_status) LIKE '%not verified%' THEN charged_off_principal END), 0) AS unv_loss
  FROM book
)"""


def _ver_cols(p: str, q: str) -> dict:
    nv = f"CAST(floor(n_unv * {p} * 0.01) AS BIGINT)"
    den = "greatest(n_unv, 1)"
    saved = f"(unv_loss * {nv} * 0.16)"
    cost = f"({nv} * {q})"
    return {
        "unverified_loans_count": "n_unv",
        "unverified_share_pct": xr("n_unv", "total", 2, 100),
        "total_portfolio_loans": "total",
        "converted_loans_count": nv,
        "new_unverified_share_pct": xr(f"n_unv - {nv}", "total", 2, 100),
        "credit_losses_saved": xr(saved, den),
        "capacity_processing_cost": f"round({cost}, 2)",
        "net_economic_benefit": xr(f"{saved} - {cost} * {den}", den),
        "_sign": f"sign({saved} - {cost} * {den})",
        "_saved0": xr(saved, den, 0),
        "_net0": xr(f"{saved} - {cost} * {den}", den, 0),
    }


_VINTS = ("unverified_loans_count", "total_portfolio_loans", "converted_loans_count")


def _ver_select(cols: dict) -> str:
    return ", ".join(f"CAST({v} AS {'BIGINT' if k in _VINTS else 'DOUBLE'}) AS {k}"
                     for k, v in cols.items() if not k.startswith("_"))


_V = _ver_cols("30.0", "35.0")


def _fmt(x):
    return f"('$' || format('{{:,}}', CAST({x} AS HUGEINT)))"


register("whatif_verification", f"""
SELECT 'Verification Policy & Capacity Trade-off' AS scenario_name,
  CAST(30.0 AS DOUBLE) AS additional_verified_pct, CAST(35.0 AS DOUBLE) AS review_cost_per_loan,
  {_ver_select(_V)},
  CASE WHEN {_V['_sign']} > 0 THEN
    'Profitable Capacity Allocation: Converting 30.0% of unverified pipeline ('
    || format('{{:,}}', {_V['converted_loans_count']}) || ' loans) saves ' || {_fmt(_V['_saved0'])}
    || ' in credit losses against ' || {_fmt('round(' + _V['capacity_processing_cost'] + ', 0)')}
    || ' in verification review costs, delivering a net operational gain of ' || {_fmt(_V['_net0'])} || '.'
  ELSE 'Capacity Warning: Verification costs (' || {_fmt('round(' + _V['capacity_processing_cost'] + ', 0)')}
    || ') exceed the credit losses saved (' || {_fmt(_V['_saved0'])}
    || '). Target verification strictly on higher loan amounts (> $20k) or risk grades C-G.' END AS recommendation
FROM va""", _VA)

register("whatif_verification_sweep", f"""
SELECT CAST(p AS DOUBLE) AS additional_verified_pct, CAST(q AS DOUBLE) AS review_cost_per_loan,
  {_ver_select(_ver_cols('p', 'q'))}
FROM va JOIN (SELECT CAST(p AS DECIMAL(10,2)) AS p, CAST(q AS DECIMAL(10,2)) AS q
              FROM range(10, 81, 5) t1(p), range(15, 61, 5) t2(q)) prm ON TRUE""", _VA)

# ---- run-all: the five default scenarios as (scenario, metric, value) rows ----------

_ALL = {
    "whatif_underwriting": ["min_fico", "max_dti", "baseline_loan_count", "baseline_funded_volume",
                            "baseline_default_rate_pct", "baseline_credit_losses", "sim_loan_count",
                            "sim_funded_volume", "sim_default_rate_pct", "sim_credit_losses", "volume_change_pct",
                            "default_rate_delta_pts", "losses_saved_dollars", "volume_sacrificed_dollars"],
    "whatif_pricing": ["apr_delta_bps"] + list(_P150),
    "whatif_funding": ["min_fulfillment_threshold_pct", "total_applications", "baseline_qualified_loans_pct",
                       "baseline_funded_volume", "qualified_loans_count", "qualified_loans_pct", "sim_funded_volume",
                       "cancelled_loans_count", "volume_impact_pct"],
    "whatif_collections": ["recovery_rate_uplift_pct", "fee_commission_pct"] + list(_C),
    "whatif_verification": ["additional_verified_pct", "review_cost_per_loan"]
    + [k for k in _V if not k.startswith("_")],
}


def _long(name: str, cols: list[str]) -> str:
    from .queries import SQL
    casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in cols)
    return (f"SELECT scenario_name, metric, value FROM (UNPIVOT (SELECT scenario_name, {casts} FROM ({SQL[name]}) s) "
            f"ON {', '.join(cols)} INTO NAME metric VALUE value)")


def _register_all():
    from .queries import SQL
    SQL["whatif_all_scenarios"] = "\nUNION ALL\n".join(_long(n, c) for n, c in _ALL.items())


_register_all()

# ---- settings of a table, on no grid: the join of all pairs ------------------------

_ST = """
st AS (SELECT borrower_key AS setting, CAST(550 + borrower_key * 37 % 200 + borrower_key % 2 * 0.5 AS DECIMAL(18,2)) AS min_fico,
         CAST((borrower_key * 131 % 5100) * 0.01 AS DECIMAL(18,2)) AS max_dti,
         CAST(80 + (borrower_key * 7 % 2100) * 0.01 AS DECIMAL(18,2)) AS threshold
       FROM borrowers_b)"""

register("whatif_underwriting_settings", f"""
SELECT setting, CAST(min_fico AS DOUBLE) AS min_fico, CAST(max_dti AS DOUBLE) AS max_dti, CAST(n AS BIGINT) AS sim_loan_count,
  {cast_cols(['sim_funded_volume', 'sim_default_rate_pct', 'sim_credit_losses', 'volume_change_pct',
              'default_rate_delta_pts', 'losses_saved_dollars', 'volume_sacrificed_dollars'])}
FROM (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _UW.items() if k != 'sim_loan_count')} FROM sw JOIN base ON TRUE) t""", f"""{_ST.strip()},
rb AS (SELECT * FROM book WHERE {RESOLVED}),
base AS (SELECT COUNT(*) AS bn, SUM(funded_amnt) AS bvol, SUM(is_default) AS bdef, SUM(charged_off_principal) AS bloss FROM rb),
sw AS (SELECT p.setting, p.min_fico, p.max_dti, COUNT(r.loan_key) AS n, coalesce(SUM(r.funded_amnt), 0) AS vol,
    coalesce(SUM(r.is_default), 0) AS dflt, coalesce(SUM(r.charged_off_principal), 0) AS loss
  FROM st p LEFT JOIN rb r ON r.fico_range_low >= p.min_fico AND r.dti <= p.max_dti GROUP BY ALL)""")

register("whatif_funding_settings", f"""
SELECT setting, CAST(threshold AS DOUBLE) AS threshold, CAST(q AS BIGINT) AS qualified_loans_count,
  CAST({xr('q', 'total', 2, 100)} AS DOUBLE) AS qualified_loans_pct, CAST(svol AS DOUBLE) AS sim_funded_volume,
  CAST(total - q AS BIGINT) AS cancelled_loans_count, CAST({xr('svol - bvol', 'bvol', 2, 100)} AS DOUBLE) AS volume_impact_pct
FROM (SELECT p.setting, p.threshold, COUNT(l.loan_key) AS q, coalesce(SUM(l.funded_amnt), 0) AS svol
  FROM st p LEFT JOIN loans_b l ON l.loan_amnt <> 0 AND l.funded_amnt * 100 >= p.threshold * l.loan_amnt GROUP BY ALL) s
JOIN (SELECT COUNT(*) AS total, SUM(funded_amnt) AS bvol FROM loans_b) b ON TRUE""", _ST.strip())
