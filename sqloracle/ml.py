"""Oracle SQL for features, sampling, score metrics, correlations, linear forecasts, formats."""

from __future__ import annotations

from loanscope.functions.exprs import RISK_TIERS
from loanscope.operators.classifier import SCORE_DEFAULTS
from loanscope.operators.drivers import DRIVER_NAMES, NARRATIVES
from loanscope.operators.forecast import holt_grid

from .book import pct, xr
from .queries import SQL, register, rollup_ctes

CRISIS_COLUMNS = ["crisis_default_rate", "post_crisis_default_rate", "crisis_recovery_rate", "post_crisis_recovery_rate",
                  "crisis_loans", "post_crisis_loans", "default_rate_multiple"]
RESOLVED = "loan_status IN ('Fully Paid', 'Charged Off', 'Default')"
GRADE_CODE = "CASE grade WHEN 'A' THEN 1 WHEN 'B' THEN 2 WHEN 'C' THEN 3 WHEN 'D' THEN 4 WHEN 'E' THEN 5 " \
             "WHEN 'F' THEN 6 WHEN 'G' THEN 7 ELSE {d} END"


def clip(x, lo, hi):
    return f"(CASE WHEN {x} IS NOT NULL THEN least(greatest({x}, {lo}), {hi}) END)"


register("loan_features", f"""
SELECT loan_id, CAST(is_default AS BIGINT) AS is_default,
  coalesce(CAST(loan_amnt AS DOUBLE), 0.0) AS loan_amnt,
  CAST(CASE trim(term) WHEN '36 months' THEN 36 WHEN '60 months' THEN 60 ELSE 36 END AS DOUBLE) AS term_months,
  coalesce(CAST(int_rate AS DOUBLE), 0.0) AS int_rate,
  coalesce(installment, 0.0) AS installment,
  CAST({GRADE_CODE.format(d=4)} AS DOUBLE) AS grade_code,
  round(coalesce(ln(1 + {clip('CAST(annual_inc AS DOUBLE)', '5000.0', '500000.0')}), 0.0), 8) AS annual_inc,
  coalesce({clip('CAST(dti AS DOUBLE)', '0.0', '50.0')}, 0.0) AS dti,
  coalesce(CAST(fico_range_low AS DOUBLE), 0.0) AS fico_range_low,
  coalesce({clip('CAST(revol_util AS DOUBLE)', '0.0', '120.0')}, 0.0) AS revol_util,
  coalesce(CAST(open_acc AS DOUBLE), 0.0) AS open_acc,
  CAST(CASE WHEN verification_status = 'Not Verified' THEN 1 ELSE 0 END AS DOUBLE) AS is_unverified,
  CAST(CASE WHEN home_ownership IN ('OWN', 'MORTGAGE') THEN 1 ELSE 0 END AS DOUBLE) AS is_homeowner
FROM lb WHERE {RESOLVED}""")

register("sampled_loans", f"""
SELECT loan_id, CAST(is_default AS BIGINT) AS is_default, grade, CAST(int_rate AS DOUBLE) AS int_rate
FROM lb WHERE {RESOLVED} ORDER BY md5(loan_id || '42') LIMIT 2000""")

register("stratified_split", f"""
SELECT loan_id, is_default, CASE WHEN r <= (20 * n) // 100 THEN 'test' ELSE 'train' END AS split
FROM (SELECT loan_id, CAST(is_default AS BIGINT) AS is_default,
        row_number() OVER (PARTITION BY is_default ORDER BY md5(loan_id || '42'), loan_id) AS r,
        count(*) OVER (PARTITION BY is_default) AS n
      FROM lb WHERE {RESOLVED}) t""")

register("score_metrics", f"""
SELECT round(auc2 / (CAST(P AS DOUBLE) * N * 2), 6) AS roc_auc,
  round(ap / P, 6) AS average_precision,
  CAST({xr('P', 'P + N', 2, 100)} AS DOUBLE) AS default_prior_pct,
  CAST(P + N AS BIGINT) AS n, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp,
  CAST(P - tp AS BIGINT) AS fn, CAST(N - fp AS BIGINT) AS tn
FROM (
  SELECT SUM(pos) AS P, SUM(neg) AS N, SUM(neg * (2 * cpos - pos)) AS auc2,
    SUM(CASE WHEN pos > 0 THEN CAST(cpos AS DOUBLE) / (cpos + cneg) * pos END) AS ap,
    SUM(tp) AS tp, SUM(fp) AS fp
  FROM (
    SELECT *, SUM(pos) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cpos,
              SUM(neg) OVER (ORDER BY s DESC ROWS UNBOUNDED PRECEDING) AS cneg
    FROM (
      SELECT s, SUM(y) AS pos, SUM(1 - y) AS neg,
        COUNT(CASE WHEN s >= 0.15 AND y = 1 THEN 1 END) AS tp,
        COUNT(CASE WHEN s >= 0.15 AND y = 0 THEN 1 END) AS fp
      FROM (SELECT CAST(int_rate * 0.01 AS DOUBLE) AS s, CAST(is_default AS BIGINT) AS y FROM lb WHERE {RESOLVED}) a
      GROUP BY s) g) c) t""")

_DF = f"""
rl AS (SELECT * REPLACE (CASE WHEN loan_key % 11 <> 0 THEN purpose ELSE 'None' END AS purpose) FROM lb WHERE {RESOLVED}),
hc AS (SELECT home_ownership, CAST(dense_rank() OVER (ORDER BY home_ownership) - 1 AS DOUBLE) AS code
       FROM (SELECT DISTINCT home_ownership FROM rl) t),
pc AS (SELECT purpose, CAST(dense_rank() OVER (ORDER BY purpose) - 1 AS DOUBLE) AS code
       FROM (SELECT DISTINCT purpose FROM rl) t),
df AS (
  SELECT CAST(is_default AS DOUBLE) AS is_default,
    CAST({GRADE_CODE.format(d=4)} AS DOUBLE) AS grade_encoded,
    CAST(int_rate AS DOUBLE) AS int_rate, CAST(dti AS DOUBLE) AS dti,
    CAST(fico_range_low AS DOUBLE) AS fico_range_low, CAST(annual_inc AS DOUBLE) AS annual_inc,
    CAST(revol_util AS DOUBLE) AS revol_util, CAST(loan_amnt AS DOUBLE) AS loan_amnt,
    CASE WHEN verification_status = 'Not Verified' THEN 1.0 ELSE 0.0 END AS is_unverified,
    hc.code AS home_encoded, pc.code AS purpose_encoded
  FROM rl JOIN hc ON rl.home_ownership = hc.home_ownership JOIN pc ON rl.purpose = pc.purpose
)"""
_FEATS = ["grade_encoded", "int_rate", "dti", "fico_range_low", "annual_inc", "revol_util", "loan_amnt",
          "is_unverified", "home_encoded", "purpose_encoded"]
register("driver_correlations", "\nUNION ALL\n".join(
    f"SELECT '{f}' AS driver_key, round(corr({f}, is_default), 4) AS correlation_with_default FROM df"
    for f in _FEATS), _DF)

_INFO = ", ".join(f"('{k}', '{DRIVER_NAMES[k]}', '{NARRATIVES[k]}')" for k in _FEATS)
register("driver_directions", f"""
SELECT c.driver_key, c.correlation_with_default, i.driver_name, i.diagnostic_narrative,
  CASE WHEN coalesce(c.correlation_with_default, 0) >= 0 THEN 'Positive (+)' ELSE 'Negative (-)' END AS direction
FROM ({" UNION ALL ".join(f"SELECT '{f}' AS driver_key, round(corr({f}, is_default), 4) AS correlation_with_default FROM df" for f in _FEATS)}) c
JOIN (VALUES {_INFO}) i(driver_key, driver_name, diagnostic_narrative) ON c.driver_key = i.driver_key""", _DF)

# ---- Gini gain per driver from bins ------------------------------------------------

_BINNED = " UNION ALL ".join(f"""
SELECT '{f}' AS driver_key, CASE WHEN {f} IS NULL THEN -1 ELSE ((CAST(round({f} * 100) AS BIGINT) - lo) * 32) // (hi - lo + 1) END AS bin, is_default
FROM df, (SELECT min(CAST(round({f} * 100) AS BIGINT)) AS lo, max(CAST(round({f} * 100) AS BIGINT)) AS hi FROM df) b""" for f in _FEATS)
_GINI = _DF + f""",
bn AS ({_BINNED}),
hg AS (SELECT driver_key, bin, COUNT(*) AS n, CAST(SUM(is_default) AS BIGINT) AS n1, COUNT(*) - CAST(SUM(is_default) AS BIGINT) AS n0 FROM bn GROUP BY ALL),
gs AS (SELECT driver_key, SUM({xr('n1 * n1 + n0 * n0', 'n', 10)}) AS s, SUM(n) AS n, SUM(n1) AS n1, SUM(n0) AS n0 FROM hg GROUP BY driver_key),
gg AS (SELECT driver_key, {xr('CAST(s AS DECIMAL(28,10)) * CAST(n AS BIGINT) - (n1 * n1 + n0 * n0)', 'n * n', 8)} AS gini_gain FROM gs),
gr AS (SELECT g.*, CAST({xr('CAST(gini_gain AS DECIMAL(20,8))', 'CAST(tot AS DECIMAL(20,8))', 2, 100)} AS DOUBLE) AS gini_share_pct,
    row_number() OVER (ORDER BY gini_gain DESC, g.driver_key) AS rank FROM gg g, (SELECT SUM(gini_gain) AS tot FROM gg) t),
dr AS (SELECT g.rank, g.driver_key, i.driver_name, CAST(g.gini_gain AS DOUBLE) AS gini_gain, g.gini_share_pct, c.correlation_with_default,
    CASE WHEN coalesce(c.correlation_with_default, 0) >= 0 THEN 'Positive (+)' ELSE 'Negative (-)' END AS direction, i.diagnostic_narrative
  FROM gr g JOIN ({" UNION ALL ".join(f"SELECT '{f}' AS driver_key, round(corr({f}, is_default), 4) AS correlation_with_default FROM df" for f in _FEATS)}) c
    ON c.driver_key = g.driver_key JOIN (VALUES {_INFO}) i(driver_key, driver_name, diagnostic_narrative) ON i.driver_key = g.driver_key)"""
register("driver_gini", "SELECT * FROM dr", _GINI)

_CRISIS = SQL["crisis_analysis"]
register("root_cause", f"""
SELECT 'driver' AS section, rank, driver_name AS item, gini_gain AS value, diagnostic_narrative AS note FROM dr
UNION ALL SELECT 'crisis', 0, item, value, NULL FROM (
  UNPIVOT (SELECT {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in CRISIS_COLUMNS)} FROM ({_CRISIS}) c0) ON {', '.join(CRISIS_COLUMNS)} INTO NAME item VALUE value)""", _GINI)

_EDGES = (4.996, 5.0, 11.996, 12.0, 21.996, 22.0, 34.996, 35.0)


def _tier(i: int) -> str:
    return "CASE " + " ".join(f"WHEN pct < {t[0]} THEN '{t[i]}'" for t in RISK_TIERS if t[0] is not None) + f" ELSE '{RISK_TIERS[-1][i]}' END"


register("risk_tiers", f"""
SELECT loan_id, round(pct, 2) AS default_probability_pct, {_tier(1)} AS risk_tier, {_tier(2)} AS underwriting_recommendation
FROM (SELECT loan_id, CASE loan_key % 9 {" ".join(f"WHEN {i} THEN CAST('{v}' AS DOUBLE)" for i, v in enumerate(_EDGES))}
        ELSE CAST(int_rate AS DOUBLE) * 2 END AS pct FROM loans_b) t""")

register("tabled_model_scores", f"""
SELECT loan_id, round(pct, 2) AS default_probability_pct, {_tier(1)} AS risk_tier, {_tier(2)} AS underwriting_recommendation
FROM (SELECT loan_id, 100.0 / (1.0 + exp(-2.0 * (
    CASE WHEN CAST(int_rate AS DOUBLE) > 13 THEN CAST(-0.35 AS DOUBLE) WHEN fico_range_low > 655 THEN -0.95 ELSE -0.55 END
    + CAST(0.1 AS DOUBLE) * CASE WHEN dti <= 24.5 THEN CAST(-0.8 AS DOUBLE) WHEN ln(1.0 + greatest(CAST(annual_inc AS DOUBLE), 1000.0)) <= 11 THEN 1.3 ELSE 0.25 END
    + CAST(0.1 AS DOUBLE) * CASE WHEN verification_status <> 'Not Verified' THEN CAST(-0.2 AS DOUBLE) WHEN term_months <= 36 THEN 0.4 ELSE 1.1 END))) AS pct
  FROM lb) t""")

_GAPS = {"int_rate": 5, "annual_inc": 7, "fico_range_low": 4}
register("score_request_defaults", f"""
SELECT loan_id, CASE WHEN loan_key % 3 <> 0 THEN grade ELSE '{SCORE_DEFAULTS['grade']}' END AS grade,
  CAST(loan_amnt AS DOUBLE) AS loan_amnt, CAST(term_months AS DOUBLE) AS term_months, installment,
  {", ".join(f"CAST(CASE WHEN loan_key % {n} <> 0 THEN {c} ELSE {SCORE_DEFAULTS[c]} END AS DOUBLE) AS {c}" for c, n in _GAPS.items())},
  CAST(dti AS DOUBLE) AS dti, CAST(revol_util AS DOUBLE) AS revol_util, CAST({SCORE_DEFAULTS['open_acc']} AS DOUBLE) AS open_acc
FROM lb""")


def _linear(seg: str) -> str:
    part = f"PARTITION BY {seg} " if seg else ""
    segc = f"{seg}, " if seg else ""
    return f"""
SELECT {segc}strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(h AS INTEGER)), '%Y-%m') AS metric_month,
  CAST(h AS BIGINT) AS step,
  round(rate, 2) AS forecast_default_rate,
  round(greatest(rate - 1.96 * r_std, 0.0), 2) AS default_rate_lower,
  round(rate + 1.96 * r_std, 2) AS default_rate_upper,
  round(vol, 2) AS forecast_funded_volume,
  round(greatest(vol - 1.96 * v_std, 0.0), 2) AS volume_lower,
  round(vol + 1.96 * v_std, 2) AS volume_upper
FROM (
  SELECT *, least(greatest(ri + rs * (n - 1 + h), 0.5), 30.0) AS rate,
    {"vi + vs * (n - 1 + h)" if seg else "greatest(vi + vs * (n - 1 + h), 1000000.0)"} AS vol
  FROM (
    SELECT {segc}COUNT(*) AS n, max(metric_month) AS last_month,
      regr_slope(r, x) AS rs, regr_intercept(r, x) AS ri, regr_slope(v, x) AS vs, regr_intercept(v, x) AS vi,
      stddev_pop(CASE WHEN back <= 12 THEN r END) AS r_std, stddev_pop(CASE WHEN back <= 12 THEN v END) AS v_std
    FROM (
      SELECT {segc}metric_month, CAST(default_rate AS DOUBLE) AS r, CAST(total_funded_volume AS DOUBLE) AS v,
        CAST(row_number() OVER ({part}ORDER BY metric_month) - 1 AS DOUBLE) AS x,
        row_number() OVER ({part}ORDER BY metric_month DESC) AS back
      FROM ro) b
    GROUP BY {segc.rstrip(', ') or '()'} HAVING COUNT(*) >= 10) f,
  range(1, 13) t(h)) z"""


register("linear_trend_forecast", _linear(""), rollup_ctes())
register("linear_trend_forecast_by_grade", _linear("grade"), rollup_ctes("grade"))



def _holt(seg: list[str], source: str, grid, floor: str | None) -> str:
    """Damped Holt by recursion over the months of each series and triple."""
    segc = "".join(f"{c}, " for c in seg)
    part = f"PARTITION BY {', '.join(seg)} " if seg else ""
    on = lambda a, b: "".join(f" AND {a}.{c} = {b}.{c}" for c in seg)
    triples = ", ".join(f"(CAST('{a}' AS DOUBLE), CAST('{b}' AS DOUBLE), CAST('{p}' AS DOUBLE))" for a, b, p in grid)

    def fit(y: str) -> str:
        ahead = "(f.l + f.p * f.k)"
        level = f"(f.a * s.{y} + (1.0 - f.a) * {ahead})"
        return f"""
{y}f AS (
  SELECT {segc}a, b, p, i, CAST(l AS DOUBLE) AS l, CAST(k AS DOUBLE) AS k, CAST(0 AS DOUBLE) AS e
  FROM (SELECT {segc}1 AS i, {y} AS l, {y}2 - {y} AS k FROM hs WHERE i = 1 AND n >= 10) z, hg
  UNION ALL
  SELECT {"".join(f"f.{c}, " for c in seg)}f.a, f.b, f.p, f.i + 1, {level}, f.b * ({level} - f.l) + (1.0 - f.b) * f.p * f.k,
    f.e + (s.{y} - {ahead}) * (s.{y} - {ahead})
  FROM {y}f f JOIN hs s ON s.i = f.i + 1{on('s', 'f')}
),
{y}b AS (
  SELECT * FROM (SELECT f.*, row_number() OVER ({'PARTITION BY ' + ', '.join('f.' + c for c in seg) if seg else ''} ORDER BY e, a, b, p) AS rn
    FROM {y}f f JOIN hl ON f.i = hl.n{on('f', 'hl')}) z WHERE rn = 1
)"""
    cte = f"""
hs AS (
  SELECT *, lead(r) OVER ({part}ORDER BY metric_month) AS r2, lead(v) OVER ({part}ORDER BY metric_month) AS v2
  FROM (SELECT {segc}metric_month, CAST(default_rate AS DOUBLE) AS r, CAST(total_funded_volume AS DOUBLE) AS v,
      row_number() OVER ({part}ORDER BY metric_month) AS i, row_number() OVER ({part}ORDER BY metric_month DESC) AS back,
      count(*) OVER ({part.strip()}) AS n FROM {source}) z
),
hl AS (
  SELECT {segc}max(n) AS n, max(metric_month) AS last_month,
    stddev_pop(CASE WHEN back <= 12 THEN r END) AS r_std, stddev_pop(CASE WHEN back <= 12 THEN v END) AS v_std
  FROM hs GROUP BY {segc.rstrip(', ') or '()'} HAVING max(n) >= 10
),
hg AS (SELECT * FROM (VALUES {triples}) g(a, b, p)),
hd AS (
  SELECT DISTINCT p, 1 AS h, CAST(p AS DOUBLE) AS s, CAST(p AS DOUBLE) AS q FROM hg
  UNION ALL SELECT p, h + 1, s + q * p, q * p FROM hd WHERE h < 12
),{fit('r')},{fit('v')}"""
    volume = "vb.l + dv.s * vb.k"
    return cte, f"""
SELECT {segc}metric_month, step, round(rate, 2) AS forecast_default_rate,
  round(greatest(rate - 1.96 * r_std, 0.0), 2) AS default_rate_lower, round(rate + 1.96 * r_std, 2) AS default_rate_upper,
  round(vol, 2) AS forecast_funded_volume, round(greatest(vol - 1.96 * v_std, 0.0), 2) AS volume_lower,
  round(vol + 1.96 * v_std, 2) AS volume_upper
FROM (
  SELECT {"".join(f"hl.{c}, " for c in seg)}strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(dr.h AS INTEGER)), '%Y-%m') AS metric_month,
    CAST(dr.h AS BIGINT) AS step, r_std, v_std, least(greatest(rb.l + dr.s * rb.k, 0.5), 30.0) AS rate,
    {f"greatest({volume}, {floor})" if floor else volume} AS vol
  FROM hl JOIN rb ON TRUE{on('hl', 'rb')} JOIN vb ON TRUE{on('hl', 'vb')}
  JOIN hd dr ON dr.p = rb.p JOIN hd dv ON dv.p = vb.p AND dv.h = dr.h) z"""


def _register_holt(name: str, seg: list[str], ctes: str, source: str, grid, floor: str | None = None) -> None:
    cte, sql = _holt(seg, source, grid, floor)
    register(name, sql, ctes + "," + cte)
    SQL[name] = SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)


_register_holt("holt_forecast", [], rollup_ctes(), "ro", holt_grid(), "1000000.0")
_register_holt("holt_forecast_by_grade", ["grade"], rollup_ctes("grade"), "ro", holt_grid())
_register_holt("holt_fixed_by_grade_state", ["grade", "addr_state"], f"""
gs AS (SELECT grade, addr_state, issue_month AS metric_month, {pct('is_default')} AS default_rate, SUM(funded_amnt) AS total_funded_volume
       FROM book GROUP BY grade, addr_state, issue_month)""", "gs", [(0.45, 0.2, 0.92)])



def _fitted(seg: list[str], source: str, floor: str | None, rounds: int = 6, least: int = 10) -> tuple[str, str]:
    """Fitted damped Holt: a recursion over the months for the grid, then one per round for 27 neighbours of the best triple."""
    segs = seg or ["one"]
    segc, part = ", ".join(segs), f"PARTITION BY {', '.join(segs)} "
    on = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in segs)
    grid = ", ".join(f"(CAST('{a}' AS DOUBLE), CAST('{b}' AS DOUBLE), CAST('{p}' AS DOUBLE))" for a, b, p in holt_grid())
    ctes = [f"""h0 AS (SELECT {', '.join(seg) if seg else '1 AS one'}, metric_month, CAST(default_rate AS DOUBLE) AS r,
    CAST(total_funded_volume AS DOUBLE) AS v, CAST(default_rate AS DECIMAL(18,2)) AS rd, CAST(total_funded_volume AS DECIMAL(18,2)) AS vd FROM {source}),
hs AS (SELECT *, lead(r) OVER ({part}ORDER BY metric_month) AS r2, lead(v) OVER ({part}ORDER BY metric_month) AS v2,
    row_number() OVER ({part}ORDER BY metric_month) AS i, row_number() OVER ({part}ORDER BY metric_month) - 1 AS x,
    row_number() OVER ({part}ORDER BY metric_month DESC) AS back, count(*) OVER ({part.strip()}) AS n FROM h0)""",
        f"""hl AS (SELECT {segc}, max(n) AS n, max(metric_month) AS last_month,
    stddev_pop(CASE WHEN back <= 12 THEN r END) AS r_std, stddev_pop(CASE WHEN back <= 12 THEN v END) AS v_std,
    CAST(sum(x) AS BIGINT) AS sx, CAST(sum(x * x) AS BIGINT) AS sxx, CAST(sum(rd) AS DECIMAL(28,2)) AS r_sy, CAST(sum(rd * x) AS DECIMAL(28,2)) AS r_sxy,
    CAST(sum(vd) AS DECIMAL(28,2)) AS v_sy, CAST(sum(vd * x) AS DECIMAL(28,2)) AS v_sxy
  FROM hs GROUP BY {segc} HAVING max(n) >= 2)""", f"hg AS (SELECT * FROM (VALUES {grid}) g(a, b, p))",
        "mv AS (SELECT x.m AS ma, y.m AS mb, z.m AS mp FROM (VALUES (-1), (0), (1)) x(m), (VALUES (-1), (0), (1)) y(m), (VALUES (-1), (0), (1)) z(m))"]
    for y in "rv":
        ahead = "(f.l + f.p * f.k)"
        level = f"(f.a * s.{y} + (1.0 - f.a) * {ahead})"
        for k in range(rounds + 1):
            if k == 0:
                ctes.append(f"{y}c0 AS (SELECT {segc}, hg.* FROM hl, hg WHERE n >= {least})")
            else:
                h = 0.5 ** (k - 1)
                a = f"least(greatest(a + ma * CAST('{0.05 * h!r}' AS DOUBLE), 0.01), 1.0)"
                ctes.append(f"""{y}c{k} AS (SELECT DISTINCT {segc}, na AS a, least(greatest(b + mb * CAST('{0.05 * h!r}' AS DOUBLE), 0.0), na) AS b,
    least(greatest(p + mp * CAST('{0.02 * h!r}' AS DOUBLE), 0.8), 0.98) AS p FROM (SELECT *, {a} AS na FROM {y}b{k - 1}, mv) z)""")
            ctes.append(f"""{y}f{k} AS (
  SELECT {', '.join('c.' + c for c in segs)}, c.a, c.b, c.p, CAST(1 AS BIGINT) AS i, s.{y} AS l, s.{y}2 - s.{y} AS k, CAST(0 AS DOUBLE) AS e
  FROM {y}c{k} c JOIN hs s ON s.i = 1 AND {on('s', 'c')}
  UNION ALL
  SELECT {', '.join('f.' + c for c in segs)}, f.a, f.b, f.p, f.i + 1, {level}, f.b * ({level} - f.l) + (1.0 - f.b) * f.p * f.k,
    f.e + (s.{y} - {ahead}) * (s.{y} - {ahead})
  FROM {y}f{k} f JOIN hs s ON s.i = f.i + 1 AND {on('s', 'f')})""")
            ctes.append(f"""{y}b{k} AS (SELECT * EXCLUDE (rn) FROM (SELECT f.*, row_number() OVER (PARTITION BY {', '.join('f.' + c for c in segs)} ORDER BY e, a, b, p) AS rn
    FROM {y}f{k} f JOIN hl ON f.i = hl.n AND {on('f', 'hl')}) z WHERE rn = 1)""")
    ctes.append("ah AS (SELECT h FROM range(1, 13) t(h))")

    def value(y: str) -> str:
        damp = f"list_sum(list_transform(range(1, h + 1), lambda j: pow({y}b{rounds}.p, j)))"
        line = xr(f"{y}_sy * (n * sxx - sx * sx) + (n * {y}_sxy - sx * {y}_sy) * (n * (n - 1 + h) - sx)", "n * (n * sxx - sx * sx)", 6)
        return f"CASE WHEN {y}b{rounds}.a IS NULL THEN CAST({line} AS DOUBLE) ELSE {y}b{rounds}.l + {damp} * {y}b{rounds}.k END"

    volume = f"greatest({value('v')}, {floor})" if floor else value("v")
    sql = f"""
SELECT {''.join(c + ', ' for c in seg)}metric_month, step, round(rate, 2) AS forecast_default_rate,
  round(greatest(rate - 1.96 * r_std, 0.0), 2) AS default_rate_lower, round(rate + 1.96 * r_std, 2) AS default_rate_upper,
  round(vol, 2) AS forecast_funded_volume, round(greatest(vol - 1.96 * v_std, 0.0), 2) AS volume_lower,
  round(vol + 1.96 * v_std, 2) AS volume_upper, rate_method, volume_method
FROM (
  SELECT {', '.join('hl.' + c for c in segs)}, strftime(CAST(last_month || '-01' AS DATE) + to_months(CAST(h AS INTEGER)), '%Y-%m') AS metric_month,
    CAST(h AS BIGINT) AS step, r_std, v_std, least(greatest({value('r')}, 0.5), 30.0) AS rate, {volume} AS vol,
    CASE WHEN rb{rounds}.a IS NULL THEN 'linear_trend' ELSE 'damped_holt' END AS rate_method,
    CASE WHEN vb{rounds}.a IS NULL THEN 'linear_trend' ELSE 'damped_holt' END AS volume_method
  FROM hl JOIN ah ON TRUE LEFT JOIN rb{rounds} ON {on('hl', f'rb{rounds}')} LEFT JOIN vb{rounds} ON {on('hl', f'vb{rounds}')}) z"""
    return ",\n".join(ctes), sql


def _register_fitted(name: str, seg: list[str], ctes: str, source: str, floor: str | None = None) -> None:
    cte, sql = _fitted(seg, source, floor)
    register(name, sql, ctes + "," + cte)
    SQL[name] = SQL[name].replace("WITH ", "WITH RECURSIVE ", 1)


_register_fitted("holt_fitted_forecast", [], rollup_ctes(), "ro", "1000000.0")
_register_fitted("holt_fitted_by_grade", ["grade"], rollup_ctes("grade") + """,
short AS (SELECT * FROM (SELECT *, min(metric_month) OVER (PARTITION BY grade) AS first FROM ro) z
  WHERE date_diff('month', CAST(first || '-01' AS DATE), CAST(metric_month || '-01' AS DATE)) < 1 + 4 * instr('ABCDEFG', grade))""", "short")

register("annuity_instalment", """
SELECT loan_id, CAST(funded_amnt AS DOUBLE) AS funded_amnt, CAST(int_rate AS DOUBLE) AS int_rate,
  CAST(term_months AS BIGINT) AS term_months,
  round(CASE WHEN CAST(int_rate AS DOUBLE) / 1200.0 = 0 THEN CAST(funded_amnt AS DOUBLE) / term_months
        ELSE CAST(funded_amnt AS DOUBLE) * (CAST(int_rate AS DOUBLE) / 1200.0)
             * pow(1.0 + CAST(int_rate AS DOUBLE) / 1200.0, CAST(term_months AS DOUBLE))
             / (pow(1.0 + CAST(int_rate AS DOUBLE) / 1200.0, CAST(term_months AS DOUBLE)) - 1.0) END, 2)
    AS monthly_instalment
FROM loans_b""")


def _cur(x):
    v = f"CAST({x} AS DECIMAL(20,2))"
    return (f"(CASE WHEN {v} IS NULL THEN '$0' "
            f"WHEN abs({v}) >= 1000000000 THEN '$' || CAST(round({v} * 0.000000001, 2) AS VARCHAR) || 'B' "
            f"WHEN abs({v}) >= 1000000 THEN '$' || CAST(round({v} * 0.000001, 2) AS VARCHAR) || 'M' "
            f"WHEN abs({v}) >= 1000 THEN '$' || CAST(round({v} * 0.001, 1) AS VARCHAR) || 'K' "
            f"ELSE '$' || CAST(round({v}, 2) AS VARCHAR) END)")


def _pct(x):
    return f"(CASE WHEN {x} IS NULL THEN '0.00%' ELSE CAST(round(CAST({x} AS DECIMAL(20,4)), 2) AS VARCHAR) || '%' END)"


register("formatted_kpis", f"""
SELECT metric_month, {_cur('total_funded_volume')} AS funded_volume_text,
  {_cur('total_charged_off_prncp')} AS charged_off_text, {_cur('total_recoveries')} AS recoveries_text,
  {_pct('default_rate')} AS default_rate_text, {_pct('mom_volume_growth_pct')} AS mom_growth_text
FROM ro""", rollup_ctes())
