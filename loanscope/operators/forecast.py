"""Forecasts of default rate and funded volume per series (OP12, AGG15, AGG16).

Input: the monthly rollup (one row per segment and month). Two methods:

* ``linear_forecast`` - degree-1 least-squares trend over the row index
  (``regr_slope`` / ``regr_intercept``) plus bands from the population std of
  the last 12 points; pure aggregates and windows.
* ``holt_forecast`` - damped additive Holt per series: the months of a series are
  a sorted array, the parameter grid is exploded beside it, one-step errors are
  folded with ``aggregate`` and the best triple is the least struct.
* ``fitted_forecast`` - the same with the parameters refined from the best grid point, and the
  straight line for a metric whose series cannot be fitted; the method is named per metric.

Rules shared by both: fewer than ``min_points`` months -> no forecast; rate
clipped to [0.5, 30]; volume floored at ``volume_floor`` (the portfolio-wide floor
is 1,000,000; segments have none); band = +-1.96 x population std of the last 12
actuals (constant width), lower bound >= 0; 2 places.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X

RATE_CLIP = (0.5, 30.0)
#: Floor of the portfolio-wide volume (fixed value).
VOLUME_FLOOR = 1_000_000.0
Z95 = 1.96


def _seg(segment):
    return [] if segment is None else ([segment] if isinstance(segment, str) else list(segment))


def linear_forecast(rollup: DataFrame, periods: int = 12, segment=None, min_points: int = 10,
                    volume_floor: float | None = None) -> DataFrame:
    """AGG15 + AGG16: straight-line forecast with constant-width bands."""
    seg = _seg(segment)
    w = Window.partitionBy(*seg).orderBy("metric_month")
    wd = Window.partitionBy(*seg).orderBy(F.desc("metric_month"))
    base = rollup.select(*seg, "metric_month", F.col("default_rate").cast("double").alias("r"),
                         F.col("total_funded_volume").cast("double").alias("v"),
                         (F.row_number().over(w) - 1).cast("double").alias("x"),
                         F.row_number().over(wd).alias("back"))
    recent = F.col("back") <= 12
    fit = base.groupBy(*seg).agg(
        F.count(F.lit(1)).alias("n"), F.max("metric_month").alias("last_month"),
        F.regr_slope("r", "x").alias("r_slope"), F.regr_intercept("r", "x").alias("r_icpt"),
        F.regr_slope("v", "x").alias("v_slope"), F.regr_intercept("v", "x").alias("v_icpt"),
        F.stddev_pop(F.when(recent, F.col("r"))).alias("r_std"),
        F.stddev_pop(F.when(recent, F.col("v"))).alias("v_std"),
    ).where(F.col("n") >= min_points)
    steps = fit.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h"))
    x = F.col("n") - 1 + F.col("h")
    rate = F.least(F.greatest(F.col("r_icpt") + F.col("r_slope") * x, F.lit(RATE_CLIP[0])), F.lit(RATE_CLIP[1]))
    vol = F.col("v_icpt") + F.col("v_slope") * x
    if volume_floor is not None:
        vol = F.greatest(vol, F.lit(volume_floor))
    first = F.to_date(F.concat(F.col("last_month"), F.lit("-01")))
    month = F.date_format(F.add_months(first, F.col("h")), "yyyy-MM")
    valued = steps.select(*seg, month.alias("metric_month"), F.col("h").cast("bigint").alias("step"),
                          rate.alias("r"), vol.alias("v"), "r_std", "v_std")
    return _banded(valued, seg)


# ---- damped Holt ------------------------------------------------------------

#: Smoothing parameters that the fit tries (trend smoothing no faster than level smoothing).
ALPHAS = tuple(round(0.05 + 0.1 * i, 2) for i in range(10))
BETAS = tuple(round(0.1 * i, 1) for i in range(7))
PHIS = (0.8, 0.84, 0.88, 0.92, 0.96, 0.98)


def holt_grid() -> list[tuple[float, float, float]]:
    return [(a, b, p) for a in ALPHAS for b in BETAS if b <= a for p in PHIS]


def _fitted(series: DataFrame, seg: list[str], value: str, grid) -> DataFrame:
    """Per series the triple of least squared one-step errors, with its final level and trend.

    Level starts at the first value, trend at the first difference. The months of a
    series are one sorted array; every triple folds it once.
    """
    triples = X.lit_structs(grid, [("a", "double"), ("b", "double"), ("p", "double")])
    tried = series.select(*seg, "n", value, F.explode(triples).alias("t"))
    y, t = F.col(value), F.col("t")

    def step(s, x):
        ahead = s["l"] + t["p"] * s["b"]
        level = t["a"] * x + (1.0 - t["a"]) * ahead
        trend = t["b"] * (level - s["l"]) + (1.0 - t["b"]) * t["p"] * s["b"]
        error = x - ahead
        return F.struct(level.alias("l"), trend.alias("b"), (s["e"] + error * error).alias("e"))

    start = F.struct(y[0].alias("l"), (y[1] - y[0]).alias("b"), F.lit(0.0).alias("e"))
    folded = tried.select(*seg, "t", F.aggregate(F.slice(y, 2, F.col("n") - 1), start, step).alias("s"))
    best = F.min(F.struct(F.col("s.e"), F.col("t.a"), F.col("t.b"), F.col("t.p"), F.col("s.l").alias("l"), F.col("s.b").alias("k"))).alias(f"{value}_fit")
    return folded.groupBy(*seg).agg(best)


def _holt_ahead(fit: str) -> Column:
    """The forecast ``h`` months ahead from a fitted level, trend and damping."""
    damp = F.aggregate(F.sequence(F.lit(1), F.col("h")), F.struct(F.lit(0.0).alias("s"), F.lit(1.0).alias("q")),
                       lambda s, _: F.struct((s["s"] + s["q"] * F.col(f"{fit}.p")).alias("s"), (s["q"] * F.col(f"{fit}.p")).alias("q")), lambda s: s["s"])
    return F.col(f"{fit}.l") + damp * F.col(f"{fit}.k")


def holt_forecast(rollup: DataFrame, periods: int = 12, segment=None, min_points: int = 10,
                  volume_floor: float | None = None, grid=None) -> DataFrame:
    """OP12: damped additive Holt forecast of every series, in built-in expressions.

    The smoothing triple is the best of ``grid`` (default: :func:`holt_grid`) by squared
    one-step error, ties to the smaller triple.
    """
    seg = _seg(segment)
    w = Window.partitionBy(*seg).orderBy(F.desc("metric_month"))
    data = rollup.select(*seg, "metric_month", F.col("default_rate").cast("double").alias("r"),
                         F.col("total_funded_volume").cast("double").alias("v"), F.row_number().over(w).alias("back"))
    recent = F.col("back") <= 12
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("metric_month", c))), lambda x: x[c])
    series = data.groupBy(*seg).agg(
        F.count(F.lit(1)).cast("int").alias("n"), F.max("metric_month").alias("last_month"), ordered("r").alias("r"), ordered("v").alias("v"),
        F.stddev_pop(F.when(recent, F.col("r"))).alias("r_std"), F.stddev_pop(F.when(recent, F.col("v"))).alias("v_std"),
    ).where(F.col("n") >= max(2, min_points))
    grid = list(grid or holt_grid())
    fits = [_fitted(series, seg, v, grid) for v in ("r", "v")]
    joined = series.select(*seg, "last_month", "r_std", "v_std")
    for f in fits:  # one row per series
        joined = joined.join(f, seg) if seg else joined.crossJoin(F.broadcast(f))
    steps = joined.select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h"))

    ahead = _holt_ahead
    rate = F.least(F.greatest(ahead("r_fit"), F.lit(RATE_CLIP[0])), F.lit(RATE_CLIP[1]))
    volume = ahead("v_fit")
    if volume_floor is not None:
        volume = F.greatest(volume, F.lit(volume_floor))
    first = F.to_date(F.concat(F.col("last_month"), F.lit("-01")))
    valued = steps.select(*seg, F.date_format(F.add_months(first, F.col("h")), "yyyy-MM").alias("metric_month"),
                          F.col("h").cast("bigint").alias("step"), rate.alias("r"), volume.alias("v"), "r_std", "v_std")
    return _banded(valued, seg)


#: First steps of the descent in (alpha, beta, phi), halved each round, and bounds of alpha and phi (beta: 0 to alpha).
DESCENT_STEPS = (0.05, 0.05, 0.02)
ALPHA_BOUNDS, PHI_BOUNDS = (0.01, 1.0), (0.8, 0.98)
ROUNDS = 6


def _holt_fold(y: Column, n: Column, a: Column, b: Column, p: Column) -> Column:
    """Level, trend and squared error of a triple over the series ``y``."""
    def step(s, x):
        ahead = s["l"] + p * s["k"]
        level = a * x + (1.0 - a) * ahead
        error = x - ahead
        return F.struct((s["e"] + error * error).alias("e"), a.alias("a"), b.alias("b"), p.alias("p"), level.alias("l"),
                        (b * (level - s["l"]) + (1.0 - b) * p * s["k"]).alias("k"))

    start = F.struct(F.lit(0.0).alias("e"), a.alias("a"), b.alias("b"), p.alias("p"), y[0].alias("l"), (y[1] - y[0]).alias("k"))
    return F.aggregate(F.slice(y, 2, n - 1), start, step)


def _best_of(y: Column, n: Column, triples: Column) -> Column:
    """The triple of least error, with its error, level and trend; ties to the smaller triple."""
    return F.array_min(F.transform(triples, lambda t: _holt_fold(y, n, t["a"], t["b"], t["p"])))


def _descended(y: Column, n: Column, best: Column, step: tuple[float, float, float]) -> Column:
    """The best of a triple and its 26 neighbours within the bounds: one round, never worse than ``best``."""
    moves = F.array(*[F.struct(*[F.lit(m * h).alias(c) for m, h, c in zip(ms, step, "abp")])
                      for ms in itertools.product((-1, 0, 1), repeat=3)])
    clip = lambda c, lo, hi: F.least(F.greatest(c, F.lit(lo)), F.lit(hi) if isinstance(hi, float) else hi)

    def tried(m):
        a = clip(best["a"] + m["a"], *ALPHA_BOUNDS)
        return _holt_fold(y, n, a, clip(best["b"] + m["b"], 0.0, a), clip(best["p"] + m["p"], *PHI_BOUNDS))

    return F.array_min(F.transform(moves, tried))


def fitted_forecast(rollup: DataFrame, periods: int = 12, segment=None, min_points: int = 10, line_points: int = 2,
                    volume_floor: float | None = None, rounds: int = ROUNDS) -> DataFrame:
    """OP12: damped Holt with fitted parameters, or the straight line, per metric of every series.

    The fit starts from the best point of :func:`holt_grid` and takes the best of the point and its
    neighbours ``rounds`` times, at half the distance each time, so its squared error is never above
    the grid's. All of it happens inside the row of a series. A metric with fewer than ``min_points``
    months, a missing month's value or an error that is no number is forecast by the straight line through its
    values; series of fewer than ``line_points`` months have no forecast.
    """
    seg = _seg(segment)
    w = Window.partitionBy(*seg)
    exact = lambda c: F.col(c).cast("decimal(24,4)")
    data = rollup.select(*seg, "metric_month", F.col("default_rate").cast("double").alias("r"), F.col("total_funded_volume").cast("double").alias("v"),
                         exact("default_rate").alias("rd"), exact("total_funded_volume").alias("vd"),
                         (F.row_number().over(w.orderBy("metric_month")) - 1).cast("long").alias("x"),
                         F.row_number().over(w.orderBy(F.desc("metric_month"))).alias("back"))
    recent = F.col("back") <= 12
    known = lambda c, x: F.sum(F.when(F.col(c).isNotNull(), x)).cast("decimal(14,0)")
    ordered = lambda c: F.transform(F.sort_array(F.collect_list(F.struct("metric_month", c))), lambda x: x[c]).alias(f"{c}s")
    per = lambda c: [ordered(c), F.stddev_pop(F.when(recent, F.col(c))).alias(f"{c}_std"), F.count(c).alias(f"{c}_n"),
                     known(c, F.col("x")).alias(f"{c}_sx"), known(c, F.col("x") * F.col("x")).alias(f"{c}_sxx"),
                     F.sum(f"{c}d").cast("decimal(24,4)").alias(f"{c}_sy"), F.sum(F.col(f"{c}d") * F.col("x")).cast("decimal(26,4)").alias(f"{c}_sxy")]
    series = data.groupBy(*seg).agg(F.count(F.lit(1)).cast("int").alias("n"), F.max("metric_month").alias("last_month"), *per("r"), *per("v"))
    series = series.where(F.col("n") >= line_points)
    grid = X.lit_structs(holt_grid(), [("a", "double"), ("b", "double"), ("p", "double")])
    for c in "rv":
        y, n = F.col(f"{c}s"), F.col("n")
        fits = (n >= max(2, min_points)) & (F.col(f"{c}_n") == n)
        series = series.withColumn(f"{c}_fit", F.when(fits, _best_of(y, n, grid)))
        for i in range(rounds):
            step = tuple(h * 0.5 ** i for h in DESCENT_STEPS)
            series = series.withColumn(f"{c}_fit", F.when(F.col(f"{c}_fit").isNotNull(), _descended(y, n, F.col(f"{c}_fit"), step)))
        error = F.col(f"{c}_fit.e")
        series = series.withColumn(f"{c}_holt", error.isNotNull() & ~F.isnan(error) & (error != float("inf")))
    steps = series.drop("rs", "vs").select("*", F.explode(F.sequence(F.lit(1), F.lit(periods))).alias("h"))

    def ahead(c):
        # the least-squares line at x, as one exact ratio of sums
        n, sx, sxx, sy, sxy = (F.col(f"{c}_{k}") for k in ("n", "sx", "sxx", "sy", "sxy"))
        n, x = n.cast("decimal(8,0)"), (F.col("n") - 1 + F.col("h")).cast("decimal(8,0)")
        spread = (n * sxx - sx * sx).cast("decimal(14,0)")
        top = sy * spread + (n * sxy - sx * sy).cast("decimal(28,4)") * (n * x - sx).cast("decimal(10,0)")
        line = X.exact_ratio(top, n * spread, 6).cast("double")
        return F.when(F.col(f"{c}_holt"), _holt_ahead(f"{c}_fit")).otherwise(line)

    rate = F.least(F.greatest(ahead("r"), F.lit(RATE_CLIP[0])), F.lit(RATE_CLIP[1]))
    volume = ahead("v") if volume_floor is None else F.greatest(ahead("v"), F.lit(volume_floor))
    method = lambda c, name: F.when(F.col(f"{c}_holt"), "damped_holt").otherwise("linear_trend").alias(name)
    first = F.to_date(F.concat(F.col("last_month"), F.lit("-01")))
    valued = steps.select(*seg, F.date_format(F.add_months(first, F.col("h")), "yyyy-MM").alias("metric_month"), F.col("h").cast("bigint").alias("step"),
                          rate.alias("r"), volume.alias("v"), "r_std", "v_std", method("r", "rate_method"), method("v", "volume_method"))
    return _banded(valued, seg, ["rate_method", "volume_method"])


def _banded(df: DataFrame, seg: list[str], more: list[str] = []) -> DataFrame:
    """Forecasts ``r`` and ``v`` with constant-width bands, 2 places."""
    r, v = F.col("r"), F.col("v")
    return df.select(
        *seg, "metric_month", "step", *more, F.round(r, 2).alias("forecast_default_rate"),
        F.round(F.greatest(r - Z95 * F.col("r_std"), F.lit(0.0)), 2).alias("default_rate_lower"),
        F.round(r + Z95 * F.col("r_std"), 2).alias("default_rate_upper"), F.round(v, 2).alias("forecast_funded_volume"),
        F.round(F.greatest(v - Z95 * F.col("v_std"), F.lit(0.0)), 2).alias("volume_lower"),
        F.round(v + Z95 * F.col("v_std"), 2).alias("volume_upper"))
