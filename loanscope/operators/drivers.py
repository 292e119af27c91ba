"""Default-driver ranking (OP10, AGG14) and the root-cause bundle (OP11).

Correlations are ten ``corr`` aggregates in one pass. Categorical codes are
alphabetical indices of the distinct values, numbered as a small table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..plans.etl import dense_row_index
from .classifier import resolved, sample_rows
from .crisis import crisis_analysis

# --------------------------------------------------------------------------
# Driver features, display names and narratives.
# --------------------------------------------------------------------------
DRIVER_FEATURES = ["grade_encoded", "int_rate", "dti", "fico_range_low", "annual_inc", "revol_util",
                   "loan_amnt", "is_unverified", "home_encoded", "purpose_encoded"]
DRIVER_NAMES = {
    "grade_encoded": "Credit Risk Grade (A-G Tier)",
    "int_rate": "Loan Interest Rate (APR %)",
    "dti": "Debt-to-Income Ratio (DTI %)",
    "fico_range_low": "Borrower Credit Score (FICO)",
    "annual_inc": "Annual Household Income ($)",
    "revol_util": "Revolving Credit Utilization (%)",
    "loan_amnt": "Requested Loan Principal ($)",
    "is_unverified": "Income Documentation (Unverified Backlog)",
    "home_encoded": "Home Ownership Type (Rent vs Own)",
    "purpose_encoded": "Loan Stated Purpose Category",
}
NARRATIVES = {
    "grade_encoded": "Subprime grade tiers (D-G) exhibit significantly higher default velocity. Primary driver of aggregate portfolio loss.",
    "int_rate": "Higher interest burden elevates monthly debt obligations, compounding borrower default probability.",
    "dti": "Excessive debt-to-income limits borrower cashflow cushion during income interruptions or macro distress.",
    "fico_range_low": "Lower FICO scores correlate strongly with prior delinquency history and vulnerability to macro shocks.",
    "annual_inc": "Lower income tiers lack liquidity reserves; defaults spike when income drops below debt service capacity.",
    "revol_util": "High credit card utilization indicates revolving credit dependency and liquidity strain.",
    "loan_amnt": "Larger balances carry heavier monthly installments, magnifying loss severity upon charge-off.",
    "is_unverified": "Unverified income applications carry elevated misstatement risk and higher delinquency rates.",
    "home_encoded": "Renters demonstrate slightly higher mobility and default rates than mortgage holders.",
    "purpose_encoded": "Small business loans and emergency consolidations show higher default dispersion than consumer debt.",
}
# --------------------------------------------------------------------------


def with_codes(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """PRJ15: ``df`` with 0-based alphabetical codes of text columns (label encoding), by new name.

    The distinct labels of all columns (NULL is the label ``None``) are numbered together in
    ranges, so any number of them stays off the driver, the plan and a single task. Labels
    meet their rows by a join that is broadcast once their measured size is small and whose
    hot labels are split otherwise.
    """
    text = {c: F.coalesce(F.col(c).cast("string"), F.lit("None")) for c in columns}
    pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("_col"), t.alias("_label")) for c, t in text.items()]))).distinct()
    numbered = dense_row_index(pairs, ["_col", "_label"], "_no")
    first = numbered.groupBy("_col").agg(F.min("_no").alias("_first"))
    # one row per column
    codes = numbered.join(F.broadcast(first), "_col").select("_col", "_label", (F.col("_no") - F.col("_first")).cast("double").alias("_code"))
    for c, name in columns.items():
        mine = codes.where(F.col("_col") == c).select("_label", F.col("_code").alias(name))
        df = df.join(mine, text[c] == F.col("_label"), "left").drop("_label")
    return df


def driver_frame(loans_borrowers: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """Resolved loans with the ten driver features (NULLs kept; the model fills 0)."""
    df = resolved(loans_borrowers)
    if sample:
        df = sample_rows(df, sample, seed)
    d = lambda c: F.col(c).cast("double")
    df = df.select(
        "loan_id", F.col("is_default").cast("double").alias("is_default"),
        X.grade_code(F.col("grade"), 4).cast("double").alias("grade_encoded"),
        d("int_rate").alias("int_rate"), d("dti").alias("dti"), d("fico_range_low").alias("fico_range_low"),
        d("annual_inc").alias("annual_inc"), d("revol_util").alias("revol_util"), d("loan_amnt").alias("loan_amnt"),
        X.unverified_flag(F.col("verification_status")).cast("double").alias("is_unverified"),
        "home_ownership", "purpose")
    return with_codes(df, {"home_ownership": "home_encoded", "purpose": "purpose_encoded"})


def driver_correlations(frame: DataFrame) -> DataFrame:
    """AGG14: Pearson r of each driver with default (NULL pairs skipped), 4 places."""
    a = frame.agg(*[F.corr(c, "is_default").alias(c) for c in DRIVER_FEATURES])
    rows = F.array(*[F.struct(F.lit(c).alias("driver_key"), F.round(F.col(c), 4).alias("correlation_with_default"))
                     for c in DRIVER_FEATURES])
    return a.select(F.inline(rows))


def driver_importance(frame: DataFrame, num_trees: int = 100, max_depth: int = 8, seed: int = 42) -> DataFrame:
    """OP10: random-forest importance (%), correlation, direction, narrative, rank."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    filled = frame.na.fill(0.0, DRIVER_FEATURES)
    vec = VectorAssembler(inputCols=DRIVER_FEATURES, outputCol="features").transform(filled)
    rf = RandomForestClassifier(labelCol="is_default", featuresCol="features", numTrees=num_trees,
                                maxDepth=max_depth, seed=seed).fit(vec)
    imp = [float(v) for v in rf.featureImportances.toArray()]
    spark = frame.sparkSession
    imps = spark.createDataFrame([(k, round(v * 100, 2)) for k, v in zip(DRIVER_FEATURES, imp)],
                                 "driver_key string, importance_weight double")
    info = spark.createDataFrame([(k, DRIVER_NAMES[k], NARRATIVES[k]) for k in DRIVER_FEATURES],
                                 "driver_key string, driver_name string, diagnostic_narrative string")
    corr = driver_correlations(frame)
    # ten rows each: joins of bounded tables
    j = imps.join(corr, "driver_key").join(info, "driver_key")
    r = F.coalesce(F.col("correlation_with_default"), F.lit(0.0))
    j = j.withColumn("direction", F.when(r >= 0, "Positive (+)").otherwise("Negative (-)"))
    w = Window.orderBy(F.desc("importance_weight"), F.asc("driver_key"))
    return j.withColumn("rank", F.row_number().over(w).cast("bigint")).select(
        "rank", "driver_key", "driver_name", "importance_weight", "correlation_with_default", "direction",
        "diagnostic_narrative")


def driver_directions(frame: DataFrame) -> DataFrame:
    """OP10 without the forest's weight: each driver's name, correlation, direction and narrative."""
    info = frame.sparkSession.createDataFrame([(k, DRIVER_NAMES[k], NARRATIVES[k]) for k in DRIVER_FEATURES],
                                              "driver_key string, driver_name string, diagnostic_narrative string")
    # ten rows on either side
    j = driver_correlations(frame).join(F.broadcast(info), "driver_key")
    r = F.coalesce(F.col("correlation_with_default"), F.lit(0.0))
    return j.withColumn("direction", F.when(r >= 0, "Positive (+)").otherwise("Negative (-)"))


#: Equal ranges of a feature between its least and greatest value; missing values are a bin of their own.
GINI_BINS = 32


def driver_gini(frame: DataFrame, bins: int = GINI_BINS) -> DataFrame:
    """OP10, WIN8, SRT2: drivers ranked by how much knowing their bin lowers the Gini impurity of default.

    Each loan becomes a (driver, bin) per driver, counted by label within tasks; ten drivers
    times a few bins are shuffled. Values are whole hundredths and all ratios exact decimals, so the
    ranking does not depend on partitioning or a seed; ties go to the smaller key.
    """
    cents = {c: F.round(F.col(c) * 100).cast("long") for c in DRIVER_FEATURES}
    bounds = frame.agg(*[f(x).alias(f"{n}_{c}") for c, x in cents.items() for n, f in (("lo", F.min), ("hi", F.max))])
    ranged = frame.withColumn("_b", bounds.select(F.struct("*")).scalar())

    def place(c: str):
        lo, hi = F.col(f"_b.lo_{c}"), F.col(f"_b.hi_{c}")
        at = F.call_function("div", (cents[c] - lo) * F.lit(bins).cast("long"), hi - lo + 1)
        return F.struct(F.lit(c).alias("driver_key"), F.coalesce(at, F.lit(-1).cast("long")).alias("bin"))

    counts = ranged.select(F.col("is_default").cast("long").alias("y"), F.inline(F.array(*[place(c) for c in DRIVER_FEATURES]))).groupBy(
        "driver_key", "bin").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("n1"))
    big = lambda c: F.col(c).cast("decimal(19,0)")
    square = lambda a, b: (big(a) * big(a) + big(b) * big(b)).cast("decimal(38,0)")
    pure = X.exact_ratio(square("n1", "n0"), F.col("n"), 10, scale=0)
    sums = counts.withColumn("n0", F.col("n") - F.col("n1")).groupBy("driver_key").agg(
        F.sum(pure.cast("decimal(30,10)")).alias("s"), F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum("n0").alias("n0"))
    whole = F.col("n").cast("decimal(14,0)")
    gain = X.exact_ratio(F.col("s").cast("decimal(24,10)") * whole - square("n1", "n0").cast("decimal(28,0)"), (whole * whole).cast("decimal(28,0)"), 8)
    # ten rows from here on
    gains = sums.select("driver_key", gain.alias("gini_gain"))
    every, order = Window.partitionBy(), Window.orderBy(F.desc("gini_gain"), F.asc("driver_key"))
    return gains.select("driver_key", "gini_gain", X.exact_ratio(F.col("gini_gain"), F.sum("gini_gain").over(every), 2, 100).alias("gini_share_pct"),
                        F.row_number().over(order).cast("bigint").alias("rank"))


def ranked_drivers(frame: DataFrame) -> DataFrame:
    """OP10 by Gini gain: rank, gain and share beside correlation, direction and narrative."""
    # ten rows on either side
    j = driver_gini(frame).join(F.broadcast(driver_directions(frame)), "driver_key")
    return j.select("rank", "driver_key", "driver_name", F.col("gini_gain").cast("double").alias("gini_gain"),
                    F.col("gini_share_pct").cast("double").alias("gini_share_pct"), "correlation_with_default", "direction", "diagnostic_narrative")


def root_cause(book: DataFrame, loans_borrowers: DataFrame, crisis_years=(1995, 1996, 1997),
               sample: int | None = None) -> dict[str, DataFrame]:
    """OP11: the crisis comparison and the drivers, ranked by the forest and by Gini gain."""
    frame = driver_frame(loans_borrowers, sample)
    return {"crisis_analysis": crisis_analysis(book, crisis_years), "ranked_drivers": driver_importance(frame), "gini_drivers": ranked_drivers(frame)}


def root_cause_report(book: DataFrame, frame: DataFrame, crisis_years=(1995, 1996, 1997)) -> DataFrame:
    """OP11 as one table: the crisis figures and the drivers ranked by Gini gain."""
    crisis = crisis_analysis(book, crisis_years)
    figures = F.array(*[F.struct(F.lit("crisis").alias("section"), F.lit(0).cast("bigint").alias("rank"), F.lit(c).alias("item"),
                                 F.col(c).cast("double").alias("value"), F.lit(None).cast("string").alias("note")) for c in crisis.columns])
    drivers = ranked_drivers(frame).select(F.lit("driver").alias("section"), "rank", F.col("driver_name").alias("item"),
                                           F.col("gini_gain").alias("value"), F.col("diagnostic_narrative").alias("note"))
    return crisis.select(F.inline(figures)).unionByName(drivers)
