"""The three tables in buckets, so that the three-way join moves no rows (SNK1, JN1-JN3).

Loans, payments and borrowers are written in buckets of (borrower_key, slot), sorted by it and the
loan, one file per bucket. All joins of the book are on these columns or more, so each task reads
one bucket of every table and joins it where it lies.

A borrower with very many loans would fill one bucket. Borrowers with more than
``1 / (HOT_SHARE * buckets)`` of all loans are hot: their loans are dealt over slots by loan key and
their own row is repeated once per slot. There are fewer than ``HOT_SHARE * buckets`` of them at any
size of the data, so their list is broadcast.

Joins that may use buckets of fewer columns than they compare need
``spark.sql.requireAllClusterKeysForCoPartition=false``; it is set in a session of their own, and
the caller's settings stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import new_folder
from ..sources.store import inputs_digest
from .book import PAYMENT_COLUMNS, LoanBook

HOT_SHARE = 2
KEYS = ["borrower_key", "slot"]
TABLES = ("loans", "payments", "borrowers")


def hot_borrowers(loans: DataFrame, buckets: int) -> DataFrame:
    """borrower_key and number of slots of each hot borrower: a slot holds at most half a bucket's share."""
    counts = loans.groupBy("borrower_key").agg(F.count(F.lit(1)).alias("_n"))
    # one row: the number of loans
    total = loans.agg(F.count(F.lit(1)).alias("_all"))
    share = F.greatest(F.lit(1), F.floor(F.col("_all") / (HOT_SHARE * buckets)))
    return counts.join(F.broadcast(total)).where(F.col("_n") > share).select(
        F.col("borrower_key").alias("_hot"), F.ceil(F.col("_n") / share).cast("long").alias("_slots"))


def _dealt(df: DataFrame, hot: DataFrame) -> DataFrame:
    """``slot`` of each loan: 0, or a deal by loan key for the loans of hot borrowers."""
    slot = F.coalesce(F.pmod(F.xxhash64("loan_key"), F.col("_slots")), F.lit(0).cast("long"))
    return df.join(F.broadcast(hot), F.col("borrower_key") == F.col("_hot"), "left").withColumn("slot", slot).drop("_hot", "_slots")


def _repeated(borrowers: DataFrame, hot: DataFrame) -> DataFrame:
    """A row of a borrower per slot."""
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("_slots") - 1, F.lit(0).cast("long"))))
    return borrowers.join(F.broadcast(hot), F.col("borrower_key") == F.col("_hot"), "left").withColumn("slot", every).drop("_hot", "_slots")


def write_bucketed(book: LoanBook, names: dict[str, str], buckets: int, folder: str) -> None:
    """The three tables as bucketed tables of the catalog, their files under ``folder``."""
    loans, paid = book.loans(), book.loans_with_payments()
    hot = hot_borrowers(loans, buckets)
    frames = {
        "loans": _dealt(loans, hot),
        "payments": _dealt(paid.select("borrower_key", "loan_key", *[c for c in PAYMENT_COLUMNS if c != "loan_id"]), hot),
        "borrowers": _repeated(book.borrowers().drop("borrower_id"), hot),
    }
    for table, df in frames.items():
        order = KEYS + (["loan_key"] if "loan_key" in df.columns else [])
        # the exchange deals as the buckets do: a task writes one bucket as one file
        (df.repartition(buckets, *KEYS).write.mode("overwrite").option("path", f"{folder}/{table}")
         .bucketBy(buckets, *KEYS).sortBy(*order).saveAsTable(names[table]))


def bucketed_book(book: LoanBook, buckets: int | None = None) -> DataFrame:
    """JN1-JN3 over bucketed tables: the three-way join without an exchange.

    The tables are written once per state of the input files and session catalog.
    """
    spark = book.spark
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    key = inputs_digest(spark, book.inputs())[:16]
    names = {t: f"loanscope_{key}_{buckets}_{t}" for t in TABLES}
    if not all(spark.catalog.tableExists(n) for n in names.values()):
        write_bucketed(book, names, buckets, new_folder(spark, "buckets"))
    return joined(spark, names)


def joined(spark: SparkSession, names: dict[str, str]) -> DataFrame:
    own = spark.newSession()
    own.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for setting in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(setting, spark.conf.get(setting))
    loans, payments, borrowers = (own.table(names[t]) for t in TABLES)
    # both sides grow with the data: never broadcast
    return (loans.join(payments.hint("merge"), [*KEYS, "loan_key"]).join(borrowers.hint("merge"), KEYS).drop("slot"))
