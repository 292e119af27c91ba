"""Column -> Column building blocks shared by every operator.

All of these are built-in Spark expressions, so they stay inside whole-stage
codegen; nothing here runs Python per row.

Rounding: every rounded ratio goes through :func:`exact_ratio`, which divides
exact decimals and rounds half away from zero with an integral division. The
result does not depend on partitioning or on float summation order.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Fixed values that must equal the reference's for equal results.
# --------------------------------------------------------------------------
# FICO proxy by grade (used when no FICO is present), default 660.
GRADE_FICO = {"A": 740, "B": 700, "C": 670, "D": 640, "E": 610, "F": 580, "G": 550}
FICO_DEFAULT = 660
# Grade ordinal used by the driver ranking and the classifier.
GRADE_CODE = {"A": 1, "B": 2, "C": 3, "D": 4, "E": 5, "F": 6, "G": 7}
# Term text -> months, default 36.
TERM_MONTHS = {"36 months": 36, "60 months": 60}
# Loan statuses counted as resolved by the analyses.
RESOLVED_STATUSES = ("Fully Paid", "Charged Off", "Default")
# Status substrings (lower case) for the default and delinquency flags.
DEFAULT_WORDS = ("charged off", "default")
DELINQUENT_WORDS = ("late", "grace", "default")
# Risk tiers of a default probability in percent: (upper bound, tier, action).
RISK_TIERS = (
    (5.0, "Prime (Low Risk)", "Approve (Fast-Track Automated Issuance)"),
    (12.0, "Near-Prime (Moderate Risk)", "Approve (Standard Underwriting Terms)"),
    (22.0, "Subprime (Elevated Risk)", "Manual Underwriting / Require Income Verification"),
    (35.0, "High Risk", "Counter-Offer (Lower Principal / Higher APR / Co-signer)"),
    (None, "Critical Default Risk", "Decline Application (Credit Policy Breach)"),
)
# --------------------------------------------------------------------------

MONEY = "decimal(18,2)"


def lit_map(mapping: dict) -> Column:
    """A literal ``map`` column built from a small fixed Python dict."""
    items = []
    for k, v in mapping.items():
        items += [F.lit(k), F.lit(v)]
    return F.create_map(*items)


def lit_array(values, sql_type: str) -> Column:
    """A literal array built in one SQL expression (one JVM call, any length)."""
    items = ", ".join(f"CAST('{v}' AS {sql_type})" for v in values)
    return F.expr(f"array({items})")


def lit_structs(rows, fields) -> Column:
    """A literal array of structs; ``fields`` is [(name, sql_type)], rows are tuples."""
    def one(r):
        parts = ", ".join(f"'{n}', CAST('{v}' AS {t})" for v, (n, t) in zip(r, fields))
        return f"named_struct({parts})"
    return F.expr("array(" + ", ".join(one(r) for r in rows) + ")")


def exact_ratio(num: Column, den: Column, digits: int = 2, mult: int = 1, scale: int = 10) -> Column:
    """``round(mult * num / den, digits)`` half away from zero, as an exact decimal.

    ``num`` and ``den`` must be exact, with at most ``scale`` decimal places
    (0 for counts). Both are scaled to integers; whole part and rest of the
    division are taken apart, so ``mult * num * 10**scale`` has all 38 digits
    for itself and the result may have 18 before the point. Returns NULL when
    ``den`` is 0 or NULL, like ``x / NULLIF(den, 0)``.
    """
    def whole(c: Column) -> Column:
        return (c * F.lit(10 ** scale).cast(f"decimal({scale + 1},0)")).cast("decimal(38,0)") if scale else c.cast("decimal(38,0)")
    n = whole(num) * F.lit(mult).cast("decimal(5,0)")
    d = F.nullif(whole(den), F.lit(0).cast("decimal(38,0)"))
    a, b = F.abs(n), F.abs(d)
    # round(|n|/|d|) = |n| div |d| and the rest, to ``digits`` places: (2 r 10^digits + |d|) div 2|d|
    rest = (a % b) * F.lit(2 * 10 ** digits).cast("decimal(12,0)") + b
    part = F.call_function("div", rest, b * 2).cast("decimal(20,0)")
    unit = F.lit(Decimal(1).scaleb(-digits)) if digits else F.lit(Decimal(1))
    q = F.call_function("div", a, b).cast("decimal(20,0)") + part * unit
    return F.when((n < 0) != (d < 0), -q).otherwise(q)


def exact_mean(col: Column, digits: int = 2) -> Column:
    """Exact ``round(avg(col), digits)`` (NULLs skipped), as an aggregate."""
    return exact_ratio(F.sum(col), F.count(col), digits)


def pct_of_rows(flag: Column, digits: int = 2) -> Column:
    """``round(sum(flag) * 100 / count(*), digits)`` as an aggregate."""
    return exact_ratio(F.sum(flag), F.count(F.lit(1)), digits, mult=100, scale=0)


def out(col: Column, name: str, kind: str = "double") -> Column:
    """Cast an output column to its published type and name it."""
    return col.cast(kind).alias(name)


def money(col: Column) -> Column:
    return col.cast(MONEY)


def round_money(col: Column) -> Column:
    """Round an exact decimal expression to cents and keep it exact."""
    return F.round(col, 2).cast(MONEY)


# ---- status, flags -------------------------------------------------------

def _contains_any(text: Column, words) -> Column:
    low = F.lower(text)
    cond = F.lit(False)
    for w in words:
        cond = cond | low.contains(w)
    return cond


def clean_status(status: Column) -> Column:
    """PRJ8: trimmed status text, ``Unknown`` when missing."""
    return F.trim(F.coalesce(status, F.lit("Unknown")))


def default_flag(status: Column) -> Column:
    """1 when the status mentions a charge-off or a default."""
    return _contains_any(status, DEFAULT_WORDS).cast("int")


def delinquent_flag(status: Column) -> Column:
    """1 when the status mentions late, grace or default."""
    return _contains_any(status, DELINQUENT_WORDS).cast("int")


def fully_funded_flag(funded: Column, requested: Column) -> Column:
    return (funded >= requested).cast("int")


def charged_off_principal(is_default: Column, funded: Column, rec_prncp: Column) -> Column:
    """PRJ9: ``max(0, funded - principal received)`` for defaulted loans, else 0."""
    zero = F.lit(0).cast(MONEY)
    return F.when(is_default == 1, F.greatest(zero, (funded - rec_prncp).cast(MONEY))).otherwise(zero)


def unverified_flag(verification: Column) -> Column:
    """Case-insensitive 'not verified' test (one normalised predicate)."""
    return (F.lower(F.trim(verification)) == "not verified").cast("int")


# ---- cleaning ------------------------------------------------------------

def strip_cell(col: Column) -> Column:
    """PRJ1: trim spaces, double quotes, CR and LF at both ends."""
    return F.regexp_replace(col, r'^[ "\r\n]+|[ "\r\n]+$', "")


def clean_numeric(col: Column) -> Column:
    """PRJ3: strip ``$ % ,``, coerce to double; bad or missing -> 0.0."""
    txt = F.trim(F.regexp_replace(col.cast("string"), r"[$%,]", ""))
    num = txt.try_cast("double")  # try_cast: a plain cast raises under ANSI
    return F.when(num.isNull() | F.isnan(num), F.lit(0.0)).otherwise(num)


def parse_issue_date(col: Column) -> Column:
    """PRJ4: ``Mon-YYYY`` or ``YYYY-MM-DD`` -> first day of that month, else NULL."""
    s = F.trim(col.cast("string"))
    d = F.coalesce(F.try_to_date(s, "MMM-yyyy"), F.try_to_date(s, "yyyy-MM-dd"))
    return F.trunc(d, "month")


def grade_fico(grade: Column) -> Column:
    """PRJ6: FICO proxy of a grade, 660 when unknown."""
    return F.coalesce(F.element_at(lit_map(GRADE_FICO), grade), F.lit(FICO_DEFAULT))


def grade_code(grade: Column, default: int = 4) -> Column:
    return F.coalesce(F.element_at(lit_map(GRADE_CODE), grade), F.lit(default))


def term_months(term: Column) -> Column:
    """PRJ13 (map form): ``36 months``/``60 months`` -> 36/60, else 36."""
    return F.coalesce(F.element_at(lit_map(TERM_MONTHS), F.trim(term)), F.lit(36))


def term_months_prefix(term: Column) -> Column:
    """PRJ13 (SQL form): integer in the first three characters."""
    return F.trim(F.substring(term, 1, 3)).try_cast("int")


def clip(col: Column, lo: float, hi: float) -> Column:
    """Clip into [lo, hi]; NULL stays NULL (Spark's greatest/least skip NULLs)."""
    return F.when(col.isNotNull(), F.least(F.greatest(col, F.lit(lo)), F.lit(hi)))


def annuity(principal: Column, apr_pct: Column, n_months: Column) -> Column:
    """PRJ17: monthly instalment ``P r (1+r)^n / ((1+r)^n - 1)``, r = APR/1200.

    Zero rate -> ``P / n``.
    """
    r = apr_pct.cast("double") / 1200.0
    g = F.pow(1.0 + r, n_months.cast("double"))
    p = principal.cast("double")
    return F.when(r == 0, p / n_months).otherwise(p * r * g / (g - 1.0))


# ---- presentation --------------------------------------------------------

def format_currency(col: Column) -> Column:
    """PRJ18: ``$1.23B``, ``$4.56M``, ``$7.8K``, ``$9.99``; NULL -> ``$0``."""
    v = col.cast("double")
    a = F.abs(v)
    return (F.when(v.isNull() | F.isnan(v), F.lit("$0"))
            .when(a >= 1e9, F.format_string("$%.2fB", v / 1e9))
            .when(a >= 1e6, F.format_string("$%.2fM", v / 1e6))
            .when(a >= 1e3, F.format_string("$%.1fK", v / 1e3))
            .otherwise(F.format_string("$%.2f", v)))


def format_currency_exact(col: Column) -> Column:
    """PRJ18 on an exact decimal: same tiers, rounded half away from zero."""
    v = col.cast("decimal(20,2)")
    a = F.abs(v)
    txt = lambda scale, digits, unit: F.concat(
        F.lit("$"), F.round(v * F.lit(Decimal(scale)), digits).cast("string"), F.lit(unit))
    return (F.when(v.isNull(), F.lit("$0"))
            .when(a >= 10 ** 9, txt("0.000000001", 2, "B"))
            .when(a >= 10 ** 6, txt("0.000001", 2, "M"))
            .when(a >= 10 ** 3, txt("0.001", 1, "K"))
            .otherwise(F.concat(F.lit("$"), F.round(v, 2).cast("string"))))


def format_percent_exact(col: Column) -> Column:
    return F.when(col.isNull(), F.lit("0.00%")).otherwise(
        F.concat(F.round(col.cast("decimal(20,4)"), 2).cast("string"), F.lit("%")))


def format_percent(col: Column) -> Column:
    v = col.cast("double")
    return F.when(v.isNull() | F.isnan(v), F.lit("0.00%")).otherwise(F.format_string("%.2f%%", v))


def risk_tier(prob_pct: Column) -> tuple[Column, Column]:
    """OP16 tiers: (tier, recommendation) of a default probability in percent."""
    tier = action = None
    for bound, name, rec in RISK_TIERS:
        cond = prob_pct < bound if bound is not None else None
        if tier is None:
            tier, action = F.when(cond, name), F.when(cond, rec)
        elif cond is not None:
            tier, action = tier.when(cond, name), action.when(cond, rec)
        else:
            tier, action = tier.otherwise(name), action.otherwise(rec)
    return tier, action
