"""ETL from merged raw loan rows to borrowers, loans and payments (OP1).

Narrow projections; the only extra job is for the dense row-position ids that
the reference's ``BRW_%07d`` / ``LN_%07d`` need: a count per split of the files,
or rows written in ranges where another order is asked for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import materialize
from .book import BORROWER_COLUMNS, LOAN_COLUMNS, PAYMENT_COLUMNS

# Numeric raw columns cleaned to double (missing -> 0.0).
NUMERIC_COLUMNS = [
    "loan_amnt", "funded_amnt", "funded_amnt_inv", "int_rate", "installment",
    "annual_inc", "dti", "open_acc", "revol_bal", "revol_util", "total_acc",
    "total_pymnt", "total_rec_prncp", "total_rec_int", "total_rec_late_fee",
    "recoveries", "collection_recovery_fee", "last_pymnt_amnt",
]
# Ids treated as missing.
MISSING_IDS = ("", "nan", "None", "0")
# Verification recode.
VERIFICATION_RECODE = {"VERIFIED - income": "Verified"}

_LOCAL_BITS = 33  # monotonically_increasing_id: partition id above bit 33


def dense_row_index(df: DataFrame, order_by: list[str], name: str = "row_no", start: int = 1) -> DataFrame:
    """Add a dense 1..N row position in the order of ``order_by``, without a global window.

    The frame is cut into ranges of that order and written once with the range and the
    place in it, so both uses below see the same numbers; one row per range gives each
    range its offset. Ties in ``order_by`` get positions in no particular order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tagged = df.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).withColumns(
        {"_pid": F.spark_partition_id(), "_mid": F.monotonically_increasing_id()})
    tagged = materialize(tagged, "row-index")
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    # one row per range: the ordered window runs over ranges, not rows
    offsets = counts.select("_pid", (F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
                            .alias("_off"))
    local = F.col("_mid").bitwiseAND(F.lit((1 << _LOCAL_BITS) - 1))
    out = tagged.join(offsets, "_pid", "left")
    return out.withColumn(name, F.coalesce("_off", F.lit(0)) + local + start).drop("_pid", "_mid", "_off")


def file_row_index(df: DataFrame, name: str = "row_no", start: int = 1) -> DataFrame:
    """Add a dense 1..N row position in file order, without moving or writing rows.

    ``df`` has the columns ``_file`` and ``_start`` of its rows' splits (``raw.with_place``) and only
    narrow steps since the scan, so a split's rows are neighbours of one task. A count per split
    and its prefix sum give each split its offset; a row adds its distance from the split's
    first row. The offsets, a row per split of the input, are broadcast.
    """
    tagged = df.withColumn("_mid", F.monotonically_increasing_id())
    counts = tagged.groupBy("_file", "_start").agg(F.count(F.lit(1)).alias("_n"), F.min("_mid").alias("_first"))
    # one row per split: the ordered window runs over splits, not rows
    before = F.sum("_n").over(Window.orderBy("_file", "_start").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select(F.col("_file").alias("_f"), F.col("_start").alias("_s"), "_first", F.coalesce(before, F.lit(0)).alias("_off"))
    placed = tagged.join(F.broadcast(offsets), (F.col("_file") == F.col("_f")) & (F.col("_start") == F.col("_s")))
    return placed.withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first") + start).drop("_mid", "_f", "_s", "_first", "_off")


def _blank_to_null(c: Column) -> Column:
    return F.when(F.trim(c) != "", c)


def _text(c: str, default: str) -> Column:
    return F.trim(F.coalesce(_blank_to_null(F.col(c)), F.lit(default)))


@dataclass
class Tables:
    borrowers: DataFrame
    loans: DataFrame
    payments: DataFrame
    wide: DataFrame


#: ``order_by`` of rows as their files hold them.
FILES = "files"


def clean_loans(raw: DataFrame, order_by: list[str] | str | None = None) -> DataFrame:
    """PRJ3-PRJ11 + FLT2 on merged raw rows: one wide, cleaned row per loan.

    Generated ids number the rows that are left: in file order (``FILES``, for rows read with
    their places), in the order of the columns ``order_by``, or, without it, by a stable
    hash of the row (as ``BRW_`` and 16 hex digits), which needs no pass of its own.
    """
    issue = X.parse_issue_date(F.col("issue_d"))
    df = raw.withColumn("issue_date", issue).where(F.col("issue_date").isNotNull())
    df = df.withColumns({
        "issue_month": F.date_format("issue_date", "yyyy-MM"),
        "issue_year": F.year("issue_date"),
        **{c: X.clean_numeric(F.col(c)) if c in raw.columns else F.lit(0.0) for c in NUMERIC_COLUMNS},
    })
    df = df.withColumn("funded_amnt", F.when(F.col("funded_amnt") > 0, F.col("funded_amnt")).otherwise(F.col("loan_amnt")))
    df = df.withColumn("funded_amnt_inv", F.when(F.col("funded_amnt_inv") > 0, F.col("funded_amnt_inv"))
                       .otherwise(F.col("funded_amnt")))
    # FICO proxy from the raw grade (before it is cleaned), where no FICO is supplied
    fico = X.grade_fico(_blank_to_null(F.col("grade"))).cast("double")
    if "fico_range_low" in raw.columns:
        given = F.trim(F.col("fico_range_low").cast("string")).try_cast("double")
        fico = F.coalesce(F.nanvl(given, F.lit(None).cast("double")), fico)
    df = df.withColumns({"fico_range_low": fico, "fico_range_high": fico + 4})
    if order_by:
        df = file_row_index(df, "_row") if order_by == FILES else dense_row_index(df, order_by, "_row")
        pos = F.format_string("%07d", F.col("_row"))
    else:
        pos = F.lpad(F.hex(F.xxhash64(*[F.col(c) for c in raw.columns])), 16, "0")
    raw_id = F.trim(F.coalesce(F.col("id").cast("string"), F.lit("")))
    df = df.withColumns({
        "loan_id": F.when(raw_id.isin(*MISSING_IDS), F.concat(F.lit("LN_"), pos)).otherwise(F.col("id")),
        "borrower_id": F.concat(F.lit("BRW_"), pos),
        "loan_status": X.clean_status(_blank_to_null(F.col("loan_status"))),
    })
    df = df.withColumns({
        "is_default": X.default_flag(F.col("loan_status")),
        "is_delinquent": X.delinquent_flag(F.col("loan_status")),
        "is_fully_funded": X.fully_funded_flag(F.col("funded_amnt"), F.col("loan_amnt")),
    })
    zero = F.lit(0.0)
    df = df.withColumn("charged_off_principal", F.when(
        F.col("is_default") == 1, F.greatest(zero, F.col("funded_amnt") - F.col("total_rec_prncp"))).otherwise(zero))
    grade = F.upper(_text("grade", "C"))
    df = df.withColumn("grade", grade)
    verification = _text("verification_status", "Not Verified")
    for k, v in VERIFICATION_RECODE.items():
        verification = F.when(verification == k, F.lit(v)).otherwise(verification)
    df = df.withColumns({
        "sub_grade": F.upper(F.trim(F.coalesce(_blank_to_null(F.col("sub_grade")), F.concat(F.col("grade"), F.lit("1"))))),
        "term": _text("term", "36 months"),
        "home_ownership": F.upper(_text("home_ownership", "MORTGAGE")),
        "verification_status": verification,
        "purpose": F.lower(_text("purpose", "debt_consolidation")),
        "addr_state": F.upper(_text("addr_state", "CA")),
        "emp_length": _text("emp_length", "n/a"),
        "last_pymnt_d": _blank_to_null(F.col("last_pymnt_d")) if "last_pymnt_d" in raw.columns else F.lit(None).cast("string"),
    })
    return df.drop("_row", "_file", "_start")


def tables_of(wide: DataFrame) -> Tables:
    """The three tables of cleaned rows with unique ids."""
    return Tables(wide.select(*BORROWER_COLUMNS), wide.select(*LOAN_COLUMNS), wide.select(*PAYMENT_COLUMNS), wide)


def etl(raw: DataFrame, order_by: list[str] | str | None = None, columns: list[str] | None = None) -> Tables:
    """OP1 / SET3: borrowers, loans and payments tables from merged raw rows.

    Dense ids are unique by construction; hashed ids repeat where whole rows repeat, and
    only then are borrowers deduplicated. For a caller that reads several of the tables, ``columns``
    names what it reads: these are cleaned and written once, and the tables hold no others.
    """
    wide = clean_loans(raw, order_by)
    if columns:
        wide = materialize(wide.select(*columns), "cleaned-rows")
    borrowers, loans, payments = (wide.select(*[c for c in names if not columns or c in columns])
                                  for names in (BORROWER_COLUMNS, LOAN_COLUMNS, PAYMENT_COLUMNS))
    if not order_by:
        borrowers = borrowers.dropDuplicates(["borrower_id"])
    return Tables(borrowers, loans, payments, wide)


def write_tables(t: Tables, path: str) -> None:
    """SNK1: overwrite the three tables as Parquet (idempotent re-runs)."""
    base = path.rstrip("/")
    t.borrowers.write.mode("overwrite").parquet(f"{base}/borrowers")
    t.loans.write.mode("overwrite").parquet(f"{base}/loans")
    t.payments.write.mode("overwrite").parquet(f"{base}/payments_recoveries")
