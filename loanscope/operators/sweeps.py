"""Sweeps over any table of settings (JN7, OP22): ``sweep(op, settings, frame)``.

The linear scenarios (pricing, collections, verification) need one row of sums, which
each setting takes as a scalar subquery. The threshold scenarios need sums over all loans that a setting lets
through: ``funding`` over a half-line, ``underwriting`` over a quarter-plane (FICO at least, DTI at
most). Loans and settings never meet in pairs:

* :func:`prefix_sums`: points and queries of a group are sorted together along y, cut into ranges
  of y; a running sum within each range and the sums of the ranges before give the sum up to a query.
  The cuts only balance the work.
* :func:`dominance_sums`: a point belongs to one node per level of a binary tree over x, and
  the values from x upwards are made of at most one node per level; each node is a group of the
  prefix sums. Work is linear in points plus queries, times the levels (bits of x).

Loans are first summed per distinct pair of values, within tasks before any shuffle, so
a value that a third of all loans share is one row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import exact_ratio
from . import whatif as W

#: Ranges of y per group.
RANGES = 64
#: Bits below the level in a node's number.
NODE_BITS = 40
MEASURES = ["n", "vol", "dflt", "loss"]


def _hundredths(c: Column, up: bool) -> Column:
    """A number as whole hundredths, rounded up or down: exact for comparisons with settings of two places."""
    scaled = c.cast("decimal(28,10)") * F.lit(100)
    return (F.ceil(scaled) if up else F.floor(scaled)).cast("long")


def _setting(c: Column) -> Column:
    return c.cast("decimal(18,2)")


def prefix_sums(points: DataFrame, queries: DataFrame, measures: list[str], ranges: int = RANGES) -> DataFrame:
    """(grp, y, measures) and (grp, y, id) to (grp, id, measures): sums of the group's points up to y, included."""
    cuts = points.agg(F.percentile_approx("y", [i / ranges for i in range(1, ranges)], 1000)).first()[0] or []
    # an array filter would do, but its lambda leads the optimizer to a filter on a column that is not there
    cut = F.expr("CASE " + "".join(f"WHEN y <= {c} THEN {i} " for i, c in enumerate(sorted(set(cuts)))) + f"ELSE {len(set(cuts))} END") if cuts else F.lit(0)
    zero = [F.lit(0).cast("decimal(38,2)").alias(m) for m in measures]
    rows = points.select("grp", "y", F.lit(0).alias("kind"), F.lit(None).cast(queries.schema["id"].dataType).alias("id"),
                         *[F.col(m).cast("decimal(38,2)").alias(m) for m in measures])
    rows = rows.union(queries.select("grp", "y", F.lit(1), "id", *zero)).withColumn("rng", cut)
    cells = rows.groupBy("grp", "rng").agg(*[F.sum(m).alias(m) for m in measures])
    # a row per group and range
    before = Window.partitionBy("grp").orderBy("rng").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("grp", "rng", *[F.coalesce(F.sum(m).over(before), F.lit(0)).alias(f"b_{m}") for m in measures])
    # points come before queries of the same y
    within = Window.partitionBy("grp", "rng").orderBy("y", "kind").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("grp", "rng", "id", "kind", *[F.sum(m).over(within).alias(m) for m in measures]).where("kind = 1")
    return run.join(cells, ["grp", "rng"]).select("grp", "id", *[(F.col(m) + F.col(f"b_{m}")).alias(m) for m in measures])


def dominance_sums(points: DataFrame, queries: DataFrame, measures: list[str], ranges: int = RANGES) -> DataFrame:
    """(x, y, measures) and (x, y, id) to (id, measures): sums of the points with x at least and y at most the query's.

    x and y are whole numbers. A query that no point can meet has no row.
    """
    bounds = points.agg(F.min("x"), F.max("x")).first()
    if bounds[0] is None:
        return queries.select("id", *[F.lit(0).cast("decimal(38,2)").alias(m) for m in measures]).where("false")
    low, bits = bounds[0], max(1, int(bounds[1] - bounds[0]).bit_length())
    level = F.explode(F.sequence(F.lit(0), F.lit(bits - 1))).alias("level")
    node = lambda n: (F.col("level").cast("long") * (1 << NODE_BITS) + n).alias("grp")
    nodes = points.select((F.col("x") - low).alias("x"), "y", *measures, level).select(node(F.expr("shiftright(x, level)")), "y", *measures)
    nodes = nodes.groupBy("grp", "y").agg(*[F.sum(m).alias(m) for m in measures])
    # from x upwards: x itself, and the right neighbour of x's node on each level where x's node is a left child
    asked = queries.select(F.when(F.col("x") >= low, F.col("x") - low).when(F.col("x") < low, F.lit(0).cast("long")).alias("x"), "y", "id").where((F.col("x") < (1 << bits)) & F.col("y").isNotNull())
    asked = asked.select("x", "y", "id", level)
    right = asked.where("shiftright(x, level) % 2 = 0").select(node(F.expr("shiftright(x, level)") + 1), "y", "id")
    own = asked.where("level = 0").select(node(F.col("x")), "y", "id")
    sums = prefix_sums(nodes, own.union(right), measures, ranges)
    return sums.groupBy("id").agg(*[F.sum(m).alias(m) for m in measures])


def _loan_sums(by: DataFrame, keys: list[str]) -> DataFrame:
    return by.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("funded_amnt").alias("vol"), F.sum("is_default").alias("dflt"),
                                 F.sum("charged_off_principal").alias("loss"))


def _with_row(settings: DataFrame, row: DataFrame) -> DataFrame:
    """Each setting beside the one row of ``row``, a scalar subquery."""
    return settings.withColumn("_row", row.select(F.struct("*")).scalar()).select(*settings.columns, "_row.*")


def _distinct(settings: DataFrame, params: list[str]) -> DataFrame:
    return settings.select(*[_setting(F.col(p)).alias(p) for p in params]).distinct()


def _back(settings: DataFrame, params: list[str], result: DataFrame) -> DataFrame:
    """The result beside every row of ``settings``, repeated and null settings included."""
    on = None
    for p in params:
        same = _setting(settings[p]).eqNullSafe(result[f"_{p}"])
        on = same if on is None else on & same
    return settings.join(result, on, "left").drop(*[f"_{p}" for p in params])


def _named(result: DataFrame, params: list[str]) -> DataFrame:
    for p in params:
        result = result.withColumnRenamed(p, f"_{p}")
    return result


UNDERWRITING_COLS = ("sim_funded_volume", "sim_default_rate_pct", "sim_credit_losses", "volume_change_pct", "default_rate_delta_pts",
                     "losses_saved_dollars", "volume_sacrificed_dollars")


def _underwriting(settings: DataFrame, book: DataFrame) -> DataFrame:
    params = ["min_fico", "max_dti"]
    loans = W.resolved(book)
    asked = _distinct(settings, params)
    known = loans.where("fico_range_low IS NOT NULL AND dti IS NOT NULL")
    points = _loan_sums(known.withColumns({"x": _hundredths(F.col("fico_range_low"), False), "y": _hundredths(F.col("dti"), True)}), ["x", "y"])
    queries = asked.where("min_fico IS NOT NULL AND max_dti IS NOT NULL").select(
        _hundredths(F.col("min_fico"), True).alias("x"), _hundredths(F.col("max_dti"), False).alias("y"), F.struct(*params).alias("id"))
    sums = dominance_sums(points, queries, MEASURES).select("id.min_fico", "id.max_dti", *MEASURES)
    zero = lambda m: F.coalesce(F.col(m), F.lit(0).cast("decimal(38,2)")).alias(m)
    same = [asked[p].eqNullSafe(sums[p]) for p in params]
    full = asked.join(sums, same, "left").select(*[asked[p] for p in params], *[zero(m) for m in MEASURES])
    base = loans.agg(F.count(F.lit(1)).alias("bn"), F.sum("funded_amnt").alias("bvol"), F.sum("is_default").alias("bdef"),
                     F.sum("charged_off_principal").alias("bloss"))
    c = F.col
    r = W._chain(_with_row(full, base), W._uw_metrics(c("n"), c("vol"), c("dflt"), c("loss"), c("bn"), c("bvol"), c("bdef"), c("bloss")))
    r = r.select(*params, c("sim_loan_count").cast("bigint").alias("sim_loan_count"), *[X.out(c(k), k) for k in UNDERWRITING_COLS])
    return _back(settings, params, _named(r, params))


def _funding(settings: DataFrame, loans: DataFrame) -> DataFrame:
    params = ["threshold"]
    f, l = F.col("funded_amnt").cast("decimal(18,2)"), F.col("loan_amnt").cast("decimal(18,2)")
    # funded * 100 >= t * loan  <=>  t in hundredths <= funded * 10000 div loan; the half-line of its negative
    passed = F.call_function("div", f * F.lit(10000), F.nullif(l, F.lit(0).cast("decimal(18,2)"))).cast("long")
    sums = loans.select(F.negative(passed).alias("y"), f.alias("funded_amnt")).where("y IS NOT NULL").groupBy("y").agg(
        F.count(F.lit(1)).alias("n"), F.sum("funded_amnt").alias("vol")).withColumn("grp", F.lit(0))
    asked = _distinct(settings, params)
    queries = asked.where("threshold IS NOT NULL").select(F.lit(0).alias("grp"), F.negative(_hundredths(F.col("threshold"), True)).alias("y"), F.col("threshold").alias("id"))
    got = prefix_sums(sums, queries, ["n", "vol"]).select(F.col("id").alias("_t"), "n", "vol")
    zero = lambda m: F.coalesce(F.col(m), F.lit(0).cast("decimal(38,2)")).alias(m)
    full = asked.join(got, F.col("threshold") == F.col("_t"), "left").select("threshold", zero("n"), zero("vol"))
    c = F.col
    r = _with_row(full, loans.agg(F.count(F.lit(1)).alias("total"), F.sum("funded_amnt").alias("bvol")))
    n = c("n").cast("decimal(38,0)")
    r = r.select("threshold", n.cast("bigint").alias("qualified_loans_count"), X.out(exact_ratio(n, c("total"), 2, 100, 0), "qualified_loans_pct"),
                 X.out(c("vol"), "sim_funded_volume"), (c("total") - n).cast("bigint").alias("cancelled_loans_count"),
                 X.out(exact_ratio(c("vol") - c("bvol"), c("bvol"), 2, 100, 2), "volume_impact_pct"))
    return _back(settings, params, _named(r, params))


def _linear(row_of, stages_of, params: list[str], columns: list[str], counts: tuple = ()):
    def run(settings: DataFrame, frame: DataFrame) -> DataFrame:
        asked = _distinct(settings, params)
        for p in params:
            asked = asked.where(F.col(p).isNotNull())
        r = W._chain(_with_row(asked, row_of(frame)), stages_of(*[F.col(p) for p in params]))
        r = r.select(*params, *[F.col(k).cast("bigint").alias(k) if k in counts else X.out(W._r2(F.col(k)), k) for k in columns])
        return _back(settings, params, _named(r, params))
    return run


def _pricing_factor(bps: Column) -> Column:
    """:func:`whatif._pricing_factor` of a column."""
    f = (1 + bps * F.lit(Decimal("0.00008"))).cast("decimal(20,8)")
    return F.when(bps > 0, f).otherwise(F.greatest(F.lit(Decimal("0.90000000")).cast("decimal(20,8)"), f))


OPS = {
    "underwriting": _underwriting,
    "funding": _funding,
    "pricing": _linear(W._pricing_agg, lambda bps: W._pricing_stages(bps, _pricing_factor(bps)), ["bps"],
                       [k for k in W.PRICING_COLS if not k.startswith("baseline")]),
    "collections": _linear(W._collections_agg, W._collections_stages, ["uplift", "fee"],
                           [k for k in W.COLLECTIONS_COLS if not k.startswith("baseline")]),
    "verification": _linear(W._verification_agg, W._verification_stages, ["pct", "cost"],
                            ["converted_loans_count", "new_unverified_share_pct", "credit_losses_saved", "capacity_processing_cost",
                             "net_economic_benefit"], ("converted_loans_count",)),
}
#: Which columns of ``settings`` each scenario reads.
SETTINGS = {"underwriting": ["min_fico", "max_dti"], "funding": ["threshold"], "pricing": ["bps"], "collections": ["uplift", "fee"],
            "verification": ["pct", "cost"]}


def sweep(op: str, settings: DataFrame, frame: DataFrame) -> DataFrame:
    """OP22: every row of ``settings``, with the scenario's results for it.

    ``frame`` is what the scenario itself takes (the book, or loans with payments). Settings
    are taken to two decimal places and need not be distinct or on any grid. With a null
    setting no loan passes a threshold, and a linear scenario has null results.
    """
    missing = [p for p in SETTINGS[op] if p not in settings.columns]
    if missing:
        raise ValueError(f"settings of {op} need the columns {missing}")
    return OPS[op](settings, frame)
