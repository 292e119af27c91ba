"""A monthly rollup kept up to date by batches (SNK2, OP2, AGG17).

What is stored are exact sums, counts and distinct-count sketches per month, state and
batch, in a partition per month. A batch of loans (a late file, a correction of an earlier
batch) touches only its own months: their partitions are read, the batch's rows in them are
replaced and the partitions are overwritten, all others stay as they are. Applying a batch again
changes nothing, so a failed run is simply repeated. The rollup itself is worked out from the
sums, whose number is months x states x batches, never loans; its windows run over months.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.exprs import exact_ratio, unverified_flag
from ..session import materialize
from ..sources.sinks import write_rollup
from .kpis import _seg, with_trends

#: Columns summed as they are, and as flags.
SUMMED = ["loan_amnt", "funded_amnt", "int_rate", "is_default", "is_delinquent", "charged_off_principal", "recoveries", "collection_recovery_fee"]
COUNTS = ["n_rows", "n_loans", "n_rates"]
KEYS = ["metric_month", "addr_state"]
#: A sketch of 2**12 registers: a relative standard error of 1.6 %, some kilobytes at most.
SKETCH_LG_K = 12


def month_sums(book: DataFrame, batch: str) -> DataFrame:
    """The batch's exact sums and sketches; one partial row per task, month and state before the shuffle.

    Loans without an issue month have no place in the rollup.
    """
    return book.where("issue_month IS NOT NULL").groupBy(F.col("issue_month").alias("metric_month"), "addr_state").agg(
        F.lit(batch).alias("batch"), F.count(F.lit(1)).alias("n_rows"), F.count("loan_id").alias("n_loans"), F.count("int_rate").alias("n_rates"),
        *[F.sum(c).cast("decimal(38,2)").alias(c) for c in SUMMED],
        F.sum(unverified_flag(F.col("verification_status"))).cast("decimal(38,2)").alias("unverified"),
        F.hll_sketch_agg("borrower_key", SKETCH_LG_K).alias("borrowers"))


def _partitions(df: DataFrame, path: str) -> None:
    """Replaces the months of ``df`` and no other."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("metric_month").parquet(path)


def start_sums(book: DataFrame, path: str, batch: str = "base") -> None:
    """The first batch; whatever ``path`` held goes."""
    month_sums(book, batch).repartition("metric_month").write.mode("overwrite").partitionBy("metric_month").parquet(path)


def read_sums(spark: SparkSession, path: str) -> DataFrame:
    """The stored sums; months are read as text, whatever the folder names look like."""
    found = spark.read.parquet(path).schema
    schema = StructType([StructField(f.name, StringType() if f.name == "metric_month" else f.dataType) for f in found])
    return spark.read.schema(schema).parquet(path)


def apply_batch(spark: SparkSession, path: str, book: DataFrame, batch: str) -> list[str]:
    """Adds the loans of ``book`` as ``batch``, or replaces that batch by them; the months it touched.

    A month that the batch leaves keeps the batch's rows with zeros, as overwriting cannot
    remove the last row of a partition.
    """
    new = materialize(month_sums(book, batch), "batch-sums")
    stored = read_sums(spark, path)
    mine = stored.where(F.col("batch") == batch)
    # months number tens to hundreds: their list prunes the partitions that are read
    months = sorted(r[0] for r in new.select("metric_month").union(mine.select("metric_month")).distinct().collect())
    touched = stored.where(F.col("metric_month").isin(months))
    left = touched.where(F.col("batch") == batch).join(new.select(*KEYS), KEYS, "left_anti")
    zeros = left.withColumns({c: F.lit(0).cast(left.schema[c].dataType) for c in [*COUNTS, *SUMMED, "unverified"]}
                             | {"borrowers": F.lit(None).cast("binary")})
    rest = touched.where(F.col("batch") != batch)
    # written aside first: the partitions that are read are the ones to be replaced
    whole = materialize(reduce(lambda a, b: a.unionByName(b), [rest, zeros, new]), "month-sums")
    _partitions(whole.repartition("metric_month"), path)
    return months


def base_of(sums: DataFrame, segment=None) -> DataFrame:
    """AGG1's monthly base from sums of any grain that holds ``segment``."""
    by = [*_seg(segment), "metric_month"]
    s = sums.groupBy(*by).agg(*[F.sum(c).alias(c) for c in [*COUNTS, *SUMMED, "unverified"]]).where("n_rows > 0")
    pct = lambda c: exact_ratio(F.col(c).cast("decimal(38,0)"), F.col("n_rows"), 2, mult=100, scale=0)
    ratio = lambda a, b: exact_ratio(F.col(a), F.col(b), mult=100)
    return s.select(
        *by, F.col("n_loans").alias("total_applications"), F.col("loan_amnt").alias("total_requested_volume"),
        F.col("funded_amnt").alias("total_funded_volume"), exact_ratio(F.col("int_rate"), F.col("n_rates")).alias("avg_interest_rate"),
        pct("is_default").alias("default_rate"), pct("is_delinquent").alias("delinquency_rate"),
        ratio("funded_amnt", "loan_amnt").alias("funding_fulfillment_rate"), F.col("charged_off_principal").alias("total_charged_off_prncp"),
        F.col("recoveries").alias("total_recoveries"), ratio("recoveries", "charged_off_principal").alias("net_recovery_rate"),
        ratio("collection_recovery_fee", "recoveries").alias("collection_cost_ratio"), pct("unverified").alias("unverified_backlog_share"))


def rollup_of(sums: DataFrame, segment=None, calendar: bool = False, exact: bool = False) -> DataFrame:
    """OP2 from stored sums."""
    return with_trends(base_of(sums, segment), segment, calendar, exact)


def update_rollup(spark: SparkSession, sums_path: str, rollup_path: str, book: DataFrame, batch: str) -> list[str]:
    """A batch into the sums, then the rollup table anew: only the windows over months are rerun."""
    months = apply_batch(spark, sums_path, book, batch)
    write_rollup(rollup_of(read_sums(spark, sums_path), exact=True), rollup_path)
    return months


def borrowers_of(sums: DataFrame, by: list[str]) -> DataFrame:
    """AGG17: estimated distinct borrowers for any grouping of months and states, from merged sketches."""
    return sums.where("borrowers IS NOT NULL").groupBy(*by).agg(F.hll_sketch_estimate(F.hll_union_agg("borrowers")).alias("borrowers"))
