"""Loan-level default classifier (OP13-OP16) and deterministic sampling (SRT4).

* features: built-in column expressions (one narrow projection)
* sampling / splitting: md5 of (loan id, seed) - repeatable, engine independent;
  the split is stratified: the same share of each label
* model: Spark ML ``GBTClassifier`` in a ``Pipeline`` (distributed training)
* metrics: exact ROC-AUC and average precision from cumulative counts per
  distinct score, summed in score ranges
* scoring: ``model.transform`` on any batch or streaming DataFrame
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..functions.exprs import RESOLVED_STATUSES
from ..session import dealt, many_rows, materialize

FEATURES = ["loan_amnt", "term_months", "int_rate", "installment", "grade_code", "annual_inc", "dti",
            "fico_range_low", "revol_util", "open_acc", "is_unverified", "is_homeowner"]

# Defaults for fields missing at scoring time (fixed values of the reference's scorer).
SCORE_DEFAULTS = {"loan_amnt": 10000.0, "term_months": 36, "int_rate": 12.0, "installment": 330.0,
                  "grade": "C", "annual_inc": 65000.0, "dti": 18.0, "fico_range_low": 690.0,
                  "revol_util": 45.0, "open_acc": 10}


def md5_order(key, seed: int):
    """Repeatable pseudo-random order key: md5 of ``key || seed`` (a NULL key: of the seed alone)."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(str(seed))))


def sample_rows(df: DataFrame, n: int, seed: int = 42, key: str = "loan_id") -> DataFrame:
    """SRT4: a repeatable random sample: the first ``n`` rows in md5 order.

    md5 values are uniform, so all rows up to some md5 prefix are the first rows
    of that order. The prefix is found from histograms of the key column: 65,536
    counts of the next 16 bits at a time, until the rows up to it are few more
    than ``n``. The histogram is an eager job; the sample itself is lazy.
    """
    order = md5_order(key, seed)
    keys = df.select(key)
    low, taken = "", 0  # rows with a prefix below ``low`` are all in the sample
    for _ in range(4):
        depth = len(low) + 4
        cell = F.substring(order, 1, depth)
        found = keys.where(order.startswith(low)) if low else keys
        counts = sorted((r["cell"], r["n"]) for r in found.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).collect())
        for prefix, many in counts:
            if taken + many >= n:
                break
            taken += many
        else:
            return df.orderBy(order)  # fewer rows than asked for
        low = prefix
        if taken + many <= 2 * n:
            break
    return df.where(F.substring(order, 1, len(low)) <= low).orderBy(order).limit(n)


def split_flag(df: DataFrame, test_pct: int = 20, seed: int = 42, key: str = "loan_id", label: str = "is_default",
               bits: int = 16) -> DataFrame:
    """Stratified split: of each label the first ``test_pct`` % rows (rounded down) in md5 order are ``test``.

    The cut is found per label from a histogram of md5 prefixes (``2**bits`` cells at most);
    only rows of the one cell in which a label's cut falls are ordered among themselves.
    """
    order = md5_order(key, seed)
    cell = F.substring(order, 1, bits // 4)
    keyed = df.withColumns({"_order": order, "_cell": cell})
    counts = keyed.groupBy(F.col(label).alias("_label"), F.col("_cell").alias("_c")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy("_label").orderBy("_c").rowsBetween(Window.unboundedPreceding, 0)
    sums = counts.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(Window.partitionBy("_label"))})
    want = F.floor(F.col("_all") * test_pct / 100)
    cut = sums.where((F.col("_upto") - F.col("_n") <= want) & (F.col("_upto") > want)).select(
        "_label", F.col("_c").alias("_cut"), (want - F.col("_upto") + F.col("_n")).alias("_rest"))
    # one row per label
    marked = keyed.join(F.broadcast(cut), F.col(label).eqNullSafe(F.col("_label")), "left")
    edge = marked.where(F.col("_cell") == F.col("_cut")).withColumn(
        "_r", F.row_number().over(Window.partitionBy("_label").orderBy("_order", key)))
    rest = marked.where(~F.coalesce(F.col("_cell") == F.col("_cut"), F.lit(False)))
    test = F.col("_cell") < F.col("_cut")
    both = edge.withColumn("split", F.when(F.col("_r") <= F.col("_rest"), "test").otherwise("train")).drop("_r").unionByName(
        rest.withColumn("split", F.when(test, "test").otherwise("train")))
    return both.select(*df.columns, "split")


def resolved(df: DataFrame) -> DataFrame:
    return df.filter(F.col("loan_status").isin(*RESOLVED_STATUSES))


def loan_features(loans_borrowers: DataFrame, sample: int | None = None, seed: int = 42) -> DataFrame:
    """OP13: the 12 model features of resolved loans (optionally an md5 sample)."""
    df = resolved(loans_borrowers)
    if sample:
        df = sample_rows(df, sample, seed)
    return _transform(df, training=True).select("loan_id", "is_default", *FEATURES)


def _transform(df: DataFrame, training: bool) -> DataFrame:
    """The shared feature transform (PRJ14). Training clips; NULL features -> 0."""
    d = lambda c: F.col(c).cast("double")
    inc = d("annual_inc")
    cols = {
        "loan_amnt": d("loan_amnt"),
        "term_months": (X.term_months(F.col("term")) if "term" in df.columns else F.col("term_months")).cast("double"),
        "int_rate": d("int_rate"),
        "installment": d("installment"),
        "grade_code": X.grade_code(F.col("grade"), 4 if training else 3).cast("double"),
        "annual_inc": F.log1p(X.clip(inc, 5000.0, 500000.0)) if training
        else F.log1p(F.greatest(inc, F.lit(1000.0))),
        "dti": X.clip(d("dti"), 0.0, 50.0),
        "fico_range_low": d("fico_range_low"),
        "revol_util": X.clip(d("revol_util"), 0.0, 120.0),
        "open_acc": d("open_acc"),
        "is_unverified": X.unverified_flag(F.col("verification_status")).cast("double"),
        "is_homeowner": F.col("home_ownership").isin("OWN", "MORTGAGE").cast("double"),
    }
    return df.withColumns({k: F.coalesce(v, F.lit(0.0)) for k, v in cols.items()})


def score_defaults(df: DataFrame) -> DataFrame:
    """Fill fields missing from scoring requests with the scorer's defaults."""
    out = df
    for k, v in SCORE_DEFAULTS.items():
        out = out.withColumn(k, F.coalesce(F.col(k), F.lit(v)) if k in out.columns else F.lit(v))
    if "term_months" not in df.columns and "term" in df.columns:
        out = out.withColumn("term_months", X.term_months(F.col("term")))
    for c in ("verification_status", "home_ownership"):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast("string"))
    return out


# ---- metrics ---------------------------------------------------------------

def evaluate_scores(df: DataFrame, score: str = "score", label: str = "is_default", threshold: float = 0.25,
                    ranges: int | None = None) -> DataFrame:
    """OP15: one row with roc_auc, average_precision, prior and the confusion matrix.

    ROC-AUC counts ties as half (Mann-Whitney); average precision is the
    step-wise sum of precision x recall increments over distinct scores. The
    counts per distinct score are cut into score ranges and written once; each
    range is summed on its own, and its running counts start from the sums of
    the ranges above it, so no task sees more than one range.
    """
    s, y = F.col(score).cast("double"), F.col(label).cast("long")
    per = df.select(s.alias("s"), y.alias("y")).groupBy("s").agg(
        F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    spark = df.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    cut = materialize(per.repartitionByRange(n, F.desc("s")).withColumn("part", F.spark_partition_id()), "score-ranges")
    big = "decimal(38,0)"
    # one row per range
    above = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = cut.groupBy("part").agg(F.sum("pos").alias("p"), F.sum("neg").alias("q"))
    starts = sums.select(F.col("part").alias("_part"), F.coalesce(F.sum("p").over(above), F.lit(0)).alias("p0"),
                         F.coalesce(F.sum("q").over(above), F.lit(0)).alias("q0"))
    w = Window.partitionBy("part").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    cum = cut.select("*", F.sum("pos").over(w).alias("p1"), F.sum("neg").over(w).alias("q1")).join(
        starts, F.col("part") == F.col("_part")).withColumns({"cpos": F.col("p0") + F.col("p1"), "cneg": F.col("q0") + F.col("q1")})
    c = F.col
    hit = c("s") >= threshold
    a = cum.agg(
        F.sum("pos").alias("P"), F.sum("neg").alias("N"),
        # twice the Mann-Whitney count: integral, so exact in any order
        F.sum((c("neg").cast("decimal(19,0)") * (c("cpos") * 2 - c("pos")).cast("decimal(19,0)")).cast(big)).alias("auc_num2"),
        F.sum(F.when(c("pos") > 0, c("cpos") / (c("cpos") + c("cneg")) * c("pos"))).alias("ap_num"),
        F.sum(F.when(hit, c("pos")).otherwise(0)).alias("tp"), F.sum(F.when(hit, c("neg")).otherwise(0)).alias("fp"))
    return a.select(
        F.round(c("auc_num2").cast("double") / (c("P").cast("double") * c("N") * 2), 6).alias("roc_auc"),
        F.round(c("ap_num") / c("P"), 6).alias("average_precision"),
        X.exact_ratio(c("P"), c("P") + c("N"), 2, 100, 0).cast("double").alias("default_prior_pct"),
        (c("P") + c("N")).cast("bigint").alias("n"),
        c("tp").cast("bigint").alias("tp"), c("fp").cast("bigint").alias("fp"),
        (c("P") - c("tp")).cast("bigint").alias("fn"), (c("N") - c("fp")).cast("bigint").alias("tn"),
    )


# ---- model -----------------------------------------------------------------

@dataclass
class ClassifierBundle:
    model: object            # pyspark.ml.PipelineModel
    metrics: DataFrame       # one row: roc_auc, average_precision, ..., n
    importances: DataFrame   # feature, importance_pct


def training_parts(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """``rows`` in even parts, each in order.

    Training passes over all rows some 500 times, so its time is that of the largest part.
    Which part a row is in and its place there follow from the rows alone, so split candidates
    do not depend on the files.
    """
    return dealt(rows, parts).sortWithinPartitions(*rows.columns)


def train_default_classifier(features: DataFrame, max_iter: int = 120, step_size: float = 0.08,
                             max_depth: int = 4, seed: int = 42, test_pct: int = 20,
                             threshold: float = 0.25, path: str | None = None,
                             force_retrain: bool = False) -> ClassifierBundle:
    """OP14 + SNK4: GBT on an md5 80/20 split; metrics on the test part.

    With ``path`` the fitted pipeline is saved there and loaded on the next
    call unless ``force_retrain``. The split of more than ``session.DEALT_FROM``
    rows is written once and its training rows are dealt to all cores.
    """
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    data = split_flag(features.withColumn("label", F.col("is_default").cast("double")), test_pct, seed)
    model = None
    if path and not force_retrain:
        try:
            model = PipelineModel.load(path)
        except Exception:  # noqa: BLE001 - no saved model yet
            model = None
    if model is None:
        train = data.where(F.col("split") == "train")
        if many_rows(features):
            data = materialize(data, "loan-split")
            train = training_parts(data.where(F.col("split") == "train").select("loan_id", "label", *FEATURES))
        pipe = Pipeline(stages=[
            VectorAssembler(inputCols=FEATURES, outputCol="features", handleInvalid="keep"),
            GBTClassifier(labelCol="label", featuresCol="features", maxIter=max_iter, stepSize=step_size,
                          maxDepth=max_depth, seed=seed),
        ])
        model = pipe.fit(train)
        if path:
            model.write().overwrite().save(path)
    scored = score_frame(model, data.where(F.col("split") == "test"))
    metrics = evaluate_scores(scored, "probability_default", "is_default", threshold)
    gbt = model.stages[-1]
    imp = [float(v) for v in gbt.featureImportances.toArray()]
    spark = features.sparkSession
    importances = spark.createDataFrame([(f, round(v * 100, 2)) for f, v in zip(FEATURES, imp)],
                                        "feature string, importance_pct double")
    return ClassifierBundle(model, metrics, importances)


def score_frame(model, df: DataFrame) -> DataFrame:
    """Apply a fitted pipeline; adds ``probability_default`` in 0..1."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    return out.withColumn("probability_default", vector_to_array("probability")[1]) \
        .drop("features", "rawPrediction", "probability", "prediction")


def score_loans(model, requests: DataFrame) -> DataFrame:
    """OP16: score a batch (or stream) of applications: probability %, tier, action."""
    feats = _transform(score_defaults(requests), training=False)
    scored = score_frame(model, feats)
    return with_risk_tier(scored, F.col("probability_default") * 100.0)


def with_risk_tier(df: DataFrame, percent) -> DataFrame:
    """Tier and action of a default probability in percent: cut on the raw value, shown to 2 places."""
    tier, action = X.risk_tier(percent)
    return df.withColumns({"default_probability_pct": F.round(percent, 2), "risk_tier": tier,
                           "underwriting_recommendation": action})
