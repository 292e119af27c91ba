"""What-if policy simulators (OP17-OP21), run-all (OP22) and parameter sweeps (JN7).

Each scenario is one conditional-aggregation pass over the book and returns
one wide row: inputs, baseline, simulated, deltas and a recommendation.
Money stays exact decimal until output; ratios use :func:`exact_ratio`.

Sweeps never pair loans with parameter settings. Scenarios that are linear in
their parameter (pricing, collections, verification) aggregate once and fan
the single aggregate row out over a literal parameter array. Threshold
scenarios (underwriting, funding) bucket each loan by the index of the
thresholds it passes, aggregate the bounded grid of buckets, and turn it into
per-setting totals with cumulative sums over that grid.
"""

from __future__ import annotations

import re
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import RESOLVED_STATUSES, exact_ratio
from ..session import materialize

# --------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results: scenario names and
# recommendations.
# --------------------------------------------------------------------------
NAMES = {
    "underwriting": "Underwriting Tightening (FICO / DTI)",
    "pricing": "Risk-Based APR Repricing (Grades C-G)",
    "funding": "Funding Fulfillment Policy Threshold",
    "collections": "Collections Recovery & Fee Optimization",
    "verification": "Verification Policy & Capacity Trade-off",
}
UNDERWRITING_GOOD = "Highly Recommended: Tightening to FICO >= {fico} & DTI <= {dti}% reduces default rate by {points} pts and saves {saved} in credit losses while sacrificing only {volume}% of origination volume."
UNDERWRITING_DRAG = "Caution (Severe Volume Drag): Tightening eliminates {volume}% of origination volume ({sacrificed}). Although default rate drops by {points} pts, the revenue loss outweighs credit loss mitigation."
UNDERWRITING_MIDDLE = "Moderate Trade-off: Saves {saved} in gross charge-offs with a {volume}% reduction in originations. Consider phased implementation."
PRICING_GAIN = "Positive Net Return: Adjusting lower-grade pricing by {bps} bps increases annual interest revenue by {income}, yielding a net bottom-line gain of {net} after accounting for adverse selection."
PRICING_LOSS = "Negative Trade-off: Rate adjustment of {bps} bps results in a net yield reduction of ${net} due to elevated borrower default sensitivity."
FUNDING = "Policy Threshold at {threshold}%: Qualifies {qualified}% of origination pipeline. Drops {dropped} partially funded applications ({volume} volume impact). Guarantees near-complete investor backing and eliminates partial-origination servicing friction."
COLLECTIONS = "Collections Enhancement (+{uplift}% recovery uplift, {fee}% fee cap): Recovers an additional {more} in delinquent balances, yielding {net} in net cash after fees. Increases portfolio recovery rate from {before}% to {after}%."
VERIFICATION_GAIN = "Profitable Capacity Allocation: Converting {pct}% of unverified pipeline ({loans} loans) saves {saved} in credit losses against {cost} in verification review costs, delivering a net operational gain of {net}."
VERIFICATION_WARNING = "Capacity Warning: Verification costs ({cost}) exceed the credit losses saved ({saved}). Target verification strictly on higher loan amounts (> $20k) or risk grades C-G."
# --------------------------------------------------------------------------

MONEY38 = "decimal(38,2)"


def _fill(text: str, **values: Column) -> Column:
    """``text`` with its fields replaced by columns."""
    parts = re.split(r"{(\w+)}", text)
    return F.concat(*[values[x] if i % 2 else F.lit(x) for i, x in enumerate(parts)])


def _dec(v) -> Column:
    return F.lit(Decimal(str(v)))


def _r2(c: Column) -> Column:
    """Round an exact decimal expression to 2 places (half away from zero)."""
    return F.round(c, 2)


def _usd0(c: Column) -> Column:
    """``${:,.0f}`` of an exact decimal (rounded half away from zero)."""
    return F.concat(F.lit("$"), F.format_number(F.round(c, 0), 0))


def _txt(c: Column, digits: int) -> Column:
    return F.round(c, digits).cast("string")


def _chain(df: DataFrame, stages) -> DataFrame:
    """Add columns stage by stage, so later expressions refer to earlier ones by name.

    Keeps each expression tree small (the exact ratios reference their inputs
    several times), which keeps analysis fast on the driver.
    """
    for st in stages:
        df = df.select("*", *[v.alias(k) for k, v in st.items()])
    return df


def resolved(df: DataFrame) -> DataFrame:
    """FLT3: loans with a final outcome (status is derived, so the filter runs before the shuffle, not in the scan)."""
    return df.filter(F.col("loan_status").isin(*RESOLVED_STATUSES))


# ---- OP17 underwriting -----------------------------------------------------

def _uw_metrics(n, vol, dflt, loss, bn, bvol, bdef, bloss):
    """Simulated-vs-baseline columns of the underwriting scenario."""
    zero = F.lit(0).cast("decimal(38,2)")
    n, bn, dflt, bdef = (x.cast("decimal(38,0)") for x in (n, bn, dflt, bdef))
    c = F.col
    # delta = 100*(d/n - bd/bn) exactly; 0-kept -> -baseline rate
    s1 = {"_dnum": F.when(n > 0, dflt * bn - bdef * n).otherwise(-bdef),
          "_dden": F.when(n > 0, n * bn).otherwise(bn),
          "_dvol": vol - bvol}
    s2 = {
        "sim_loan_count": n.cast("bigint"),
        "sim_funded_volume": vol,
        "sim_default_rate_pct": F.when(n > 0, exact_ratio(dflt, n, 2, 100, 0)).otherwise(zero),
        "sim_credit_losses": loss,
        "volume_change_pct": exact_ratio(c("_dvol"), bvol, 2, 100, 2),
        "default_rate_delta_pts": exact_ratio(c("_dnum"), c("_dden"), 2, 100, 0),
        "losses_saved_dollars": bloss - loss,
        "volume_sacrificed_dollars": bvol - vol,
        "_vc6": exact_ratio(c("_dvol"), bvol, 6, 100, 2),
        "_dd6": exact_ratio(c("_dnum"), c("_dden"), 6, 100, 0),
    }
    return [s1, s2]


def _uw_recommendation(min_fico: Column, max_dti: Column) -> Column:
    c = F.col
    vc, dd = F.abs(c("_vc6")), c("_dd6")
    fill = {"fico": min_fico.cast("string"), "dti": max_dti.cast("string"), "points": _txt(F.abs(dd), 2), "volume": _txt(vc, 1),
            "saved": _usd0(c("losses_saved_dollars")), "sacrificed": _usd0(c("volume_sacrificed_dollars"))}
    return (F.when((vc < 10) & (dd <= -1), _fill(UNDERWRITING_GOOD, **fill)).when(vc > 25, _fill(UNDERWRITING_DRAG, **fill))
            .otherwise(_fill(UNDERWRITING_MIDDLE, **fill)))


def what_if_underwriting(book: DataFrame, min_fico: float = 660, max_dti: float = 35.0) -> DataFrame:
    """OP17: keep resolved loans with ``fico >= min_fico and dti <= max_dti``."""
    return _underwriting_row(resolved(book).agg(*_underwriting_sums(F.lit(True), min_fico, max_dti)), min_fico, max_dti)


def _underwriting_sums(base: Column, min_fico, max_dti) -> list[Column]:
    keep = base & (F.col("fico_range_low") >= _dec(min_fico)) & (F.col("dti") <= _dec(max_dti))
    return [
        F.count(F.when(base, 1)).alias("baseline_loan_count"),
        F.sum(F.when(base, F.col("funded_amnt"))).alias("baseline_funded_volume"),
        F.sum(F.when(base, F.col("is_default"))).alias("_bdef"),
        F.sum(F.when(base, F.col("charged_off_principal"))).alias("baseline_credit_losses"),
        F.count(F.when(keep, 1)).alias("_n"),
        F.coalesce(F.sum(F.when(keep, F.col("funded_amnt"))), F.lit(0).cast(MONEY38)).alias("_vol"),
        F.coalesce(F.sum(F.when(keep, F.col("is_default"))), F.lit(0).cast("bigint")).alias("_def"),
        F.coalesce(F.sum(F.when(keep, F.col("charged_off_principal"))), F.lit(0).cast(MONEY38)).alias("_loss"),
    ]


def _underwriting_row(a: DataFrame, min_fico, max_dti) -> DataFrame:
    c = F.col
    m = _uw_metrics(c("_n"), c("_vol"), c("_def"), c("_loss"), c("baseline_loan_count"),
                    c("baseline_funded_volume"), c("_bdef"), c("baseline_credit_losses"))
    a = _chain(a, [{"baseline_default_rate_pct": exact_ratio(c("_bdef"), c("baseline_loan_count"), 2, 100, 0)}] + m)
    return a.select(
        F.lit(NAMES["underwriting"]).alias("scenario_name"),
        _dec(min_fico).cast("double").alias("min_fico"), _dec(max_dti).cast("double").alias("max_dti"),
        c("baseline_loan_count").cast("bigint").alias("baseline_loan_count"),
        *[X.out(c(k), k) for k in ("baseline_funded_volume", "baseline_default_rate_pct", "baseline_credit_losses")],
        c("sim_loan_count").cast("bigint").alias("sim_loan_count"),
        *[X.out(c(k), k) for k in ("sim_funded_volume", "sim_default_rate_pct", "sim_credit_losses",
                                   "volume_change_pct", "default_rate_delta_pts", "losses_saved_dollars",
                                   "volume_sacrificed_dollars")],
        _uw_recommendation(F.lit(_num_text(min_fico)), F.lit(_num_text(max_dti))).alias("recommendation"),
    )


def _num_text(v) -> str:
    """Python's ``str`` of a number as the reference prints its inputs."""
    return str(v)


def _thresholds_passed(x: Column, thresholds, strict: bool = False) -> Column:
    """Number of sorted thresholds ``t`` with ``t <= x`` (``t < x`` if strict); 0 for NULL."""
    arr = X.lit_array(thresholds, "decimal(18,2)")
    cnt = F.size(F.filter(arr, (lambda t: t < x) if strict else (lambda t: t <= x)))
    return F.when(x.isNull(), F.lit(0)).otherwise(cnt)


def underwriting_sweep(book: DataFrame, fico_grid=range(600, 751, 10), dti_grid=range(15, 46)) -> DataFrame:
    """OP22/JN7: the underwriting scenario for every (min_fico, max_dti) setting.

    A loan is kept for FICO threshold i iff it passes thresholds 0..i, and for
    DTI threshold j iff its DTI is below-or-equal, i.e. j >= number of DTI
    thresholds strictly below it. Loans are counted into that (fi, dj) grid
    cell, and per-setting totals are 2-D cumulative sums over the grid.
    """
    fg = [Decimal(str(v)) for v in fico_grid]
    dg = [Decimal(str(v)) for v in dti_grid]
    nf, nd = len(fg), len(dg)
    df = resolved(book)
    fico, dti = F.col("fico_range_low"), F.col("dti")
    fi = _thresholds_passed(fico, fg)
    dj = F.when(dti.isNull(), F.lit(nd)).otherwise(_thresholds_passed(dti, dg, strict=True))
    cells = df.groupBy(fi.alias("fi"), dj.alias("dj")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("funded_amnt").alias("vol"),
        F.sum("is_default").alias("dflt"), F.sum("charged_off_principal").alias("loss"))
    grid = _index_grid(df.sparkSession, nf, nd)
    dense = grid.join(cells, ["fi", "dj"], "left").na.fill(0, ["n", "dflt"])
    dense = dense.withColumns({"vol": F.coalesce("vol", F.lit(0).cast(MONEY38)),
                               "loss": F.coalesce("loss", F.lit(0).cast(MONEY38))})
    w1 = Window.partitionBy("dj").orderBy(F.desc("fi")).rowsBetween(Window.unboundedPreceding, 0)
    w2 = Window.partitionBy("fi").orderBy("dj").rowsBetween(Window.unboundedPreceding, 0)
    ms = ["n", "vol", "dflt", "loss"]
    s1 = dense.select("fi", "dj", *[F.sum(m).over(w1).alias(m) for m in ms])
    s2 = s1.select("fi", "dj", *[F.sum(m).over(w2).alias(m) for m in ms])
    # cell (0, nd) holds every loan: the baseline, spread over the grid by a global window
    is_all = (F.col("fi") == 0) & (F.col("dj") == nd)
    whole = Window.partitionBy()
    s2 = s2.select("*", *[F.max(F.when(is_all, F.col(m))).over(whole).alias(b)
                          for m, b in zip(ms, ["bn", "bvol", "bdef", "bloss"])])
    pick = s2.filter((F.col("fi") >= 1) & (F.col("dj") < nd))
    c = F.col
    m = _uw_metrics(c("n"), c("vol"), c("dflt"), c("loss"), c("bn"), c("bvol"), c("bdef"), c("bloss"))
    fico_val = F.element_at(X.lit_array(fg, "decimal(18,2)"), c("fi"))
    dti_val = F.element_at(X.lit_array(dg, "decimal(18,2)"), c("dj") + 1)
    res = _chain(pick.select("*", fico_val.alias("min_fico"), dti_val.alias("max_dti")), m)
    return res.select(
        X.out(c("min_fico"), "min_fico"), X.out(c("max_dti"), "max_dti"),
        c("sim_loan_count").cast("bigint").alias("sim_loan_count"),
        *[X.out(c(k), k) for k in ("sim_funded_volume", "sim_default_rate_pct", "sim_credit_losses",
                                   "volume_change_pct", "default_rate_delta_pts", "losses_saved_dollars",
                                   "volume_sacrificed_dollars")],
    )


def _index_grid(spark, nf: int, nd: int) -> DataFrame:
    """All (fi, dj) pairs of the bounded parameter grid, from one ``range``."""
    w = nd + 1
    return spark.range(0, (nf + 1) * w).select(
        (F.col("id") / w).cast("int").alias("fi"), (F.col("id") % w).cast("int").alias("dj"))


# ---- OP18 pricing ------------------------------------------------------------

SUBPRIME_PRICING_GRADES = ("C", "D", "E", "F", "G")


def _pricing_factor(bps: int) -> Decimal:
    f = Decimal(1) + Decimal(bps) / Decimal(100) * Decimal("0.008")
    return f if bps > 0 else max(Decimal("0.9"), f)


def _pricing_sums(base: Column) -> list[Column]:
    fr = F.col("funded_amnt") * F.col("int_rate")
    return [
        F.coalesce((F.sum(F.when(base, fr)) * _dec("0.01")).cast("decimal(38,6)"), F.lit(0).cast("decimal(38,6)")).alias("base_income"),
        F.sum(F.when(base & F.col("grade").isin(*SUBPRIME_PRICING_GRADES), F.col("funded_amnt"))).alias("sub_funded"),
        F.coalesce(F.sum(F.when(base, F.col("charged_off_principal"))), F.lit(0).cast(MONEY38)).alias("base_losses"),
    ]


def _pricing_agg(loans_payments: DataFrame) -> DataFrame:
    return resolved(loans_payments).agg(*_pricing_sums(F.lit(True)))


PRICING_COLS = ["baseline_gross_interest_income", "baseline_expected_losses", "baseline_net_yield",
                "sim_gross_interest_income", "sim_expected_losses", "sim_net_yield",
                "interest_income_delta", "net_yield_delta", "net_yield_growth_pct"]


def _pricing_stages(bps: Column, factor: Column) -> list:
    c = F.col
    sub = F.coalesce(c("sub_funded"), F.lit(0).cast(MONEY38))
    return [
        {"baseline_gross_interest_income": c("base_income"),
         "baseline_expected_losses": c("base_losses"),
         "baseline_net_yield": c("base_income") - c("base_losses"),
         "sim_gross_interest_income": (c("base_income") + sub * bps * _dec("0.0001")).cast("decimal(38,6)"),
         "sim_expected_losses": (c("base_losses") * factor).cast("decimal(38,6)")},
        {"sim_net_yield": c("sim_gross_interest_income") - c("sim_expected_losses"),
         "interest_income_delta": c("sim_gross_interest_income") - c("base_income")},
        {"net_yield_delta": c("sim_net_yield") - c("baseline_net_yield")},
        {"net_yield_growth_pct": exact_ratio(c("net_yield_delta"), F.abs(c("baseline_net_yield")), 2, 100)},
    ]


def what_if_pricing(loans_payments: DataFrame, bps: int = 150) -> DataFrame:
    """OP18: +bps on grades C-G; losses scale by 1 + bps/100 * 0.008 (floor 0.9 when bps <= 0)."""
    return _pricing_row(_pricing_agg(loans_payments), bps)


def _pricing_row(a: DataFrame, bps: int) -> DataFrame:
    cols = PRICING_COLS
    r = _chain(a, _pricing_stages(F.lit(int(bps)), F.lit(_pricing_factor(int(bps)))))
    c = F.col
    sign = f"{int(bps):+d}"
    shown = {"bps": F.lit(sign), "income": _usd0(c("interest_income_delta"))}
    rec = F.when(c("net_yield_delta") > 0, _fill(PRICING_GAIN, net=_usd0(c("net_yield_delta")), **shown)).otherwise(
        _fill(PRICING_LOSS, net=F.round(F.abs(c("net_yield_delta")), 0).cast("decimal(38,0)").cast("string"), **shown))
    return r.select(F.lit(NAMES["pricing"]).alias("scenario_name"),
                    F.lit(int(bps)).cast("bigint").alias("apr_delta_bps"),
                    *[X.out(_r2(c(k)), k) for k in cols], rec.alias("recommendation"))


def pricing_sweep(loans_payments: DataFrame, bps_grid=range(-300, 401, 25)) -> DataFrame:
    """OP22/JN7: the pricing scenario for each bps setting, from one aggregate row."""
    a = _pricing_agg(loans_payments)
    params = X.lit_structs([(int(b), _pricing_factor(int(b))) for b in bps_grid],
                           [("bps", "int"), ("factor", "decimal(10,6)")])
    p = a.select("*", F.explode(params).alias("p"))
    r = _chain(p, _pricing_stages(F.col("p.bps"), F.col("p.factor")))
    return r.select(F.col("p.bps").cast("bigint").alias("apr_delta_bps"),
                    *[X.out(_r2(F.col(k)), k) for k in PRICING_COLS if not k.startswith("baseline")])


# ---- OP19 funding ------------------------------------------------------------

def what_if_funding(loans: DataFrame, threshold: float = 95.0) -> DataFrame:
    """OP19: only loans funded to at least ``threshold`` % of the request are issued."""
    f, l = F.col("funded_amnt"), F.col("loan_amnt")
    full = (l != 0) & (f * 100 >= _dec("99.9") * l)
    ok = (l != 0) & (f * 100 >= _dec(threshold) * l)
    a = loans.agg(
        F.count(F.lit(1)).alias("total_applications"),
        F.count(F.when(full, 1)).alias("_full"),
        F.sum("funded_amnt").alias("baseline_funded_volume"),
        F.count(F.when(ok, 1)).alias("qualified_loans_count"),
        F.coalesce(F.sum(F.when(ok, f)), F.lit(0).cast(MONEY38)).alias("sim_funded_volume"),
    )
    c = F.col
    a = a.select("*",
                 exact_ratio(c("_full"), c("total_applications"), 2, 100, 0).alias("baseline_qualified_loans_pct"),
                 exact_ratio(c("qualified_loans_count"), c("total_applications"), 2, 100, 0).alias("qualified_loans_pct"),
                 exact_ratio(c("qualified_loans_count"), c("total_applications"), 1, 100, 0).alias("_q1"),
                 (c("total_applications") - c("qualified_loans_count")).alias("cancelled_loans_count"),
                 exact_ratio(c("sim_funded_volume") - c("baseline_funded_volume"), c("baseline_funded_volume"), 2, 100, 2)
                 .alias("volume_impact_pct"))
    rec = _fill(FUNDING, threshold=F.lit(_num_text(threshold)), qualified=c("_q1").cast("string"),
                dropped=F.format_number(c("cancelled_loans_count"), 0),
                volume=_usd0(F.abs(c("sim_funded_volume") - c("baseline_funded_volume"))))
    return a.select(
        F.lit(NAMES["funding"]).alias("scenario_name"),
        _dec(threshold).cast("double").alias("min_fulfillment_threshold_pct"),
        c("total_applications").cast("bigint").alias("total_applications"),
        X.out(c("baseline_qualified_loans_pct"), "baseline_qualified_loans_pct"),
        X.out(c("baseline_funded_volume"), "baseline_funded_volume"),
        c("qualified_loans_count").cast("bigint").alias("qualified_loans_count"),
        X.out(c("qualified_loans_pct"), "qualified_loans_pct"),
        X.out(c("sim_funded_volume"), "sim_funded_volume"),
        c("cancelled_loans_count").cast("bigint").alias("cancelled_loans_count"),
        X.out(c("volume_impact_pct"), "volume_impact_pct"),
        rec.alias("recommendation"),
    )


def funding_sweep(loans: DataFrame, thresholds=range(80, 101)) -> DataFrame:
    """OP22/JN7: the funding scenario per threshold via per-bucket suffix sums."""
    ts = [Decimal(str(t)) for t in thresholds]
    f, l = F.col("funded_amnt"), F.col("loan_amnt")
    # number of thresholds t with funded*100 >= t*loan (0 when loan is 0)
    passed = F.when(l == 0, F.lit(0)).otherwise(
        F.size(F.filter(X.lit_array(ts, "decimal(18,2)"), lambda t: f * 100 >= t * l)))
    cells = loans.groupBy(passed.alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum("funded_amnt").alias("vol"))
    spark = loans.sparkSession
    dense = spark.range(0, len(ts) + 1).select(F.col("id").cast("int").alias("k")).join(cells, "k", "left")
    dense = dense.select("k", F.coalesce("n", F.lit(0)).alias("n"),
                         F.coalesce("vol", F.lit(0).cast(MONEY38)).alias("vol"))
    w = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    s = dense.select("k", F.sum("n").over(w).alias("n"), F.sum("vol").over(w).alias("vol"))
    # the suffix sum at k = 0 covers every loan: the baseline
    whole = Window.partitionBy()
    s = s.select("*", F.max(F.when(F.col("k") == 0, F.col("n"))).over(whole).alias("total"),
                 F.max(F.when(F.col("k") == 0, F.col("vol"))).over(whole).alias("bvol")).filter(F.col("k") >= 1)
    c = F.col
    return s.select(
        X.out(F.element_at(X.lit_array(ts, "decimal(18,2)"), c("k")), "min_fulfillment_threshold_pct"),
        c("n").cast("bigint").alias("qualified_loans_count"),
        X.out(exact_ratio(c("n"), c("total"), 2, 100, 0), "qualified_loans_pct"),
        X.out(c("vol"), "sim_funded_volume"),
        (c("total") - c("n")).cast("bigint").alias("cancelled_loans_count"),
        X.out(exact_ratio(c("vol") - c("bvol"), c("bvol"), 2, 100, 2), "volume_impact_pct"),
    )


# ---- OP20 collections ----------------------------------------------------------

def _charged_off() -> Column:
    return (F.col("is_default") == 1) & (F.col("charged_off_principal") > 0)


def _collections_sums(base: Column) -> list[Column]:
    zero = F.lit(0).cast(MONEY38)
    return [F.coalesce(F.sum(F.when(base, F.col(x))), zero).alias(y) for x, y in
            (("recoveries", "base_rec"), ("collection_recovery_fee", "base_fees"), ("charged_off_principal", "base_loss"))]


def _collections_agg(loans_payments: DataFrame) -> DataFrame:
    return loans_payments.filter(_charged_off()).agg(*_collections_sums(F.lit(True)))


COLLECTIONS_COLS = ["baseline_gross_recoveries", "baseline_collection_fees", "baseline_net_recovered_cash",
                    "baseline_recovery_rate_pct", "sim_gross_recoveries", "sim_collection_fees",
                    "sim_net_recovered_cash", "sim_recovery_rate_pct", "net_cash_delta", "net_cash_uplift_pct"]


def _collections_stages(uplift: Column, fee: Column) -> list:
    c = F.col
    return [
        {"baseline_gross_recoveries": c("base_rec"),
         "baseline_collection_fees": c("base_fees"),
         "baseline_net_recovered_cash": c("base_rec") - c("base_fees"),
         "baseline_recovery_rate_pct": exact_ratio(c("base_rec"), c("base_loss"), 2, 100, 2),
         "sim_gross_recoveries": (c("base_rec") * (1 + uplift * _dec("0.01"))).cast("decimal(38,8)")},
        {"sim_collection_fees": (c("sim_gross_recoveries") * fee * _dec("0.01")).cast("decimal(38,8)"),
         "sim_recovery_rate_pct": exact_ratio(c("sim_gross_recoveries"), c("base_loss"), 2, 100)},
        {"sim_net_recovered_cash": c("sim_gross_recoveries") - c("sim_collection_fees")},
        {"net_cash_delta": c("sim_net_recovered_cash") - c("baseline_net_recovered_cash")},
        {"net_cash_uplift_pct": exact_ratio(c("net_cash_delta"), F.greatest(
            c("baseline_net_recovered_cash"), F.lit(1).cast(MONEY38)), 2, 100)},
    ]


def what_if_collections(loans_payments: DataFrame, uplift: float = 25.0, fee: float = 16.0) -> DataFrame:
    """OP20: recoveries x (1 + uplift%), fees = fee% of the new recoveries."""
    return _collections_row(_collections_agg(loans_payments), uplift, fee)


def _collections_row(a: DataFrame, uplift, fee) -> DataFrame:
    cols = COLLECTIONS_COLS
    r = _chain(a, _collections_stages(_dec(uplift), _dec(fee)))
    c = F.col
    rec = _fill(COLLECTIONS, uplift=F.lit(_num_text(uplift)), fee=F.lit(_num_text(fee)),
                more=_usd0(c("sim_gross_recoveries") - c("baseline_gross_recoveries")), net=_usd0(c("net_cash_delta")),
                before=c("baseline_recovery_rate_pct").cast("string"), after=c("sim_recovery_rate_pct").cast("string"))
    return r.select(F.lit(NAMES["collections"]).alias("scenario_name"),
                    _dec(uplift).cast("double").alias("recovery_rate_uplift_pct"),
                    _dec(fee).cast("double").alias("fee_commission_pct"),
                    *[X.out(_r2(c(k)), k) for k in cols], rec.alias("recommendation"))


def collections_sweep(loans_payments: DataFrame, uplifts=range(0, 61, 5), fees=range(10, 26)) -> DataFrame:
    """OP22/JN7: collections scenario over an (uplift, fee) grid from one aggregate row."""
    a = _collections_agg(loans_payments)
    params = X.lit_structs([(u, f) for u in uplifts for f in fees], [("u", "decimal(10,2)"), ("f", "decimal(10,2)")])
    p = a.select("*", F.explode(params).alias("p"))
    r = _chain(p, _collections_stages(F.col("p.u"), F.col("p.f")))
    return r.select(X.out(F.col("p.u"), "recovery_rate_uplift_pct"), X.out(F.col("p.f"), "fee_commission_pct"),
                    *[X.out(_r2(F.col(k)), k) for k in COLLECTIONS_COLS if not k.startswith("baseline")])


# ---- OP21 verification -----------------------------------------------------------

def _verification_sums(base: Column) -> list[Column]:
    unv = base & F.lower(F.col("verification_status").cast("string")).contains("not verified")
    return [
        F.count(F.when(base, 1)).alias("total"),
        F.count(F.when(unv, 1)).alias("n_unv"),
        F.coalesce(F.sum(F.when(unv, F.col("charged_off_principal"))), F.lit(0).cast(MONEY38)).alias("unv_loss"),
    ]


def _verification_agg(book: DataFrame) -> DataFrame:
    return book.agg(*_verification_sums(F.lit(True)))


VERIFICATION_COLS = ["unverified_loans_count", "unverified_share_pct", "total_portfolio_loans",
                     "converted_loans_count", "new_unverified_share_pct", "credit_losses_saved",
                     "capacity_processing_cost", "net_economic_benefit"]


def _verification_stages(pct: Column, cost: Column) -> list:
    c = F.col
    return [
        {"converted_loans_count": F.floor(c("n_unv") * pct * _dec("0.01")).cast("bigint"),
         "_den": F.greatest(c("n_unv"), F.lit(1))},
        {"_saved_num": c("unv_loss") * c("converted_loans_count") * _dec("0.16"),
         "_cost": (c("converted_loans_count") * cost).cast("decimal(38,6)")},
        {"_net_num": c("_saved_num") - c("_cost") * c("_den")},
        {"unverified_loans_count": c("n_unv"),
         "unverified_share_pct": exact_ratio(c("n_unv"), c("total"), 2, 100, 0),
         "total_portfolio_loans": c("total"),
         "new_unverified_share_pct": exact_ratio(c("n_unv") - c("converted_loans_count"), c("total"), 2, 100, 0),
         "credit_losses_saved": exact_ratio(c("_saved_num"), c("_den"), scale=4),
         "capacity_processing_cost": _r2(c("_cost")),
         "net_economic_benefit": exact_ratio(c("_net_num"), c("_den"), scale=6),
         "_net_sign": F.signum(c("_net_num")),
         "_saved0": exact_ratio(c("_saved_num"), c("_den"), 0, scale=4),
         "_net0": exact_ratio(c("_net_num"), c("_den"), 0, scale=6)},
    ]


def what_if_verification(book: DataFrame, pct: float = 30.0, cost: float = 35.0) -> DataFrame:
    """OP21: verify ``pct`` % of unverified loans at ``cost`` each; saves 16 % of their mean loss."""
    return _verification_row(_verification_agg(book), pct, cost)


def _verification_row(a: DataFrame, pct, cost) -> DataFrame:
    cols = VERIFICATION_COLS
    r = _chain(a, _verification_stages(_dec(pct), _dec(cost)))
    c = F.col
    fmt = lambda x: F.concat(F.lit("$"), F.format_number(x, 0))
    cost0 = F.round(c("capacity_processing_cost"), 0)
    fill = {"pct": F.lit(_num_text(pct)), "loans": F.format_number(c("converted_loans_count"), 0), "saved": fmt(c("_saved0")),
            "cost": fmt(cost0), "net": fmt(c("_net0"))}
    rec = F.when(c("_net_sign") > 0, _fill(VERIFICATION_GAIN, **fill)).otherwise(_fill(VERIFICATION_WARNING, **fill))
    ints = ("unverified_loans_count", "total_portfolio_loans", "converted_loans_count")
    return r.select(F.lit(NAMES["verification"]).alias("scenario_name"),
                    _dec(pct).cast("double").alias("additional_verified_pct"),
                    _dec(cost).cast("double").alias("review_cost_per_loan"),
                    *[c(k).cast("bigint").alias(k) if k in ints else X.out(c(k), k)
                      for k in cols if not k.startswith("_")],
                    rec.alias("recommendation"))


def verification_sweep(book: DataFrame, pcts=range(10, 81, 5), costs=range(15, 61, 5)) -> DataFrame:
    """OP22/JN7: verification scenario over a (pct, cost) grid from one aggregate row."""
    a = _verification_agg(book)
    params = X.lit_structs([(p, q) for p in pcts for q in costs], [("p", "decimal(10,2)"), ("q", "decimal(10,2)")])
    x = a.select("*", F.explode(params).alias("prm"))
    r = _chain(x, _verification_stages(F.col("prm.p"), F.col("prm.q")))
    ints = ("unverified_loans_count", "total_portfolio_loans", "converted_loans_count")
    return r.select(X.out(F.col("prm.p"), "additional_verified_pct"), X.out(F.col("prm.q"), "review_cost_per_loan"),
                    *[F.col(k).cast("bigint").alias(k) if k in ints else X.out(F.col(k), k)
                      for k in VERIFICATION_COLS])


# ---- OP22 run-all --------------------------------------------------------------

def run_all_scenarios(loans_payments: DataFrame, borrowers: DataFrame, loans: DataFrame) -> DataFrame:
    """OP22: the five scenarios at their default settings, as (scenario, metric, value) rows.

    The four scenarios on payments share one pass: loans with payments, left-joined to their
    borrowers (``borrower_key``; scenarios on the book count loans with a borrower only), are
    reduced to one row of conditional sums, which is written and read by each scenario.
    """
    done = F.col("loan_status").isin(*RESOLVED_STATUSES)
    known = F.coalesce(F.col("_borrower"), F.lit(False))
    sums = {
        "u": _underwriting_sums(known & done, 660, 35.0), "p": _pricing_sums(done),
        "c": _collections_sums(_charged_off()), "v": _verification_sums(known),
    }
    joined = loans_payments.join(borrowers.withColumn("_borrower", F.lit(True)), "borrower_key", "left")
    row = materialize(joined.agg(*[F.struct(*cols).alias(k) for k, cols in sums.items()]), "scenario-sums")
    part = lambda k: row.select(f"{k}.*")
    frames = [_underwriting_row(part("u"), 660, 35.0), _pricing_row(part("p"), 150), what_if_funding(loans),
              _collections_row(part("c"), 25.0, 16.0), _verification_row(part("v"), 30.0, 35.0)]
    out = None
    for f in frames:
        metrics = [c for c in f.columns if c not in ("scenario_name", "recommendation")]
        long = f.select("scenario_name", F.inline(F.array(*[
            F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])))
        out = long if out is None else out.unionByName(long)
    return out
