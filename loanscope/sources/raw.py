"""Raw loan CSV files: read, align, validate and merge (SRC1, SRC2, SET1, FLT1, PRJ1-2, SNK5).

Files may differ in column order and set, may start with a one-line
preamble, and hold text cells with ``$ % ,`` decorations or line ends. One
pass over the lines tells each file's header and whether its cells span lines.
Files are read with an all-string schema (no inference pass), aligned to the 30
target columns by lower-cased header name, and unioned by name.
Header and preamble lines fall out through the row-validity filter.
"""

from __future__ import annotations

import csv
from functools import reduce
from typing import NamedTuple
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.exprs import strip_cell

# --------------------------------------------------------------------------
# The 30 target columns of the merged raw file, in order.
# --------------------------------------------------------------------------
TARGET_COLUMNS = [
    "id", "loan_amnt", "funded_amnt", "funded_amnt_inv", "term", "int_rate",
    "installment", "grade", "sub_grade", "emp_length", "home_ownership",
    "annual_inc", "verification_status", "issue_d", "loan_status", "purpose",
    "addr_state", "dti", "open_acc", "revol_bal", "revol_util", "total_acc",
    "total_pymnt", "total_rec_prncp", "total_rec_int", "total_rec_late_fee",
    "recoveries", "collection_recovery_fee", "last_pymnt_d", "last_pymnt_amnt",
]
MIN_FIELDS = 5
ISSUE_D_PREFIX = r"^[A-Za-z]{3}-[0-9]{4}"
# --------------------------------------------------------------------------


def _strip_text(s: str) -> str:
    return s.strip(' \n\r"')


#: Quoting of the files (RFC 4180): a quote inside a quoted cell is doubled.
DIALECT = {"quote": '"', "escape": '"'}


class Layout(NamedTuple):
    """Files of one header line, of which all or none have cells that span lines."""

    header: tuple[str, ...]
    multiline: bool
    paths: tuple[str, ...]


def file_lines(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One row per file: its first two lines (by position) and whether a quoted cell of it spans lines.

    A cell that spans lines leaves an odd number of quotes on the line where it opens. The lines
    are read where they lie and only summaries are shuffled. Two lines of a file that follow each
    other have ids of different parity, so the least even and the least odd id of the file's first
    split are its first two lines; collect_set keeps the aggregate on hash maps, without a sort of the lines.
    """
    lines = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"),
                                          "value", F.monotonically_increasing_id().alias("at"))
    odd = (F.length("value") - F.length(F.replace(F.col("value"), F.lit('"'), F.lit("")))) % 2
    begins = [F.min(F.when((F.col("start") == 0) & (F.col("at") % 2 == r), F.struct("at", "value"))).alias(f"l{r}") for r in (0, 1)]
    files = lines.groupBy("path").agg(F.collect_set(odd).alias("odd"), *begins)
    # l0 and l1 in the order of their ids; a file of one line has only one of them
    swapped = F.col("l0").isNull() | (F.col("l1.at") < F.col("l0.at"))
    return files.select("path", F.when(swapped, F.col("l1.value")).otherwise(F.col("l0.value")).alias("first"),
                        F.when(swapped, F.col("l0.value")).otherwise(F.col("l1.value")).alias("second"),
                        F.array_contains("odd", 1).alias("multiline"))


def raw_layouts(spark: SparkSession, paths: list[str]) -> list[Layout]:
    """The files by header line and kind, found in one pass over their lines.

    One preamble line is skipped when the first line mentions neither ``id`` nor
    ``loan_amnt``. A row per distinct header, with its paths, reaches the driver.
    """
    told = F.lower("first")
    preamble = ~told.contains("id") & ~told.contains("loan_amnt") & F.col("second").isNotNull()
    kinds = (file_lines(spark, paths).groupBy(F.when(preamble, F.col("second")).otherwise(F.col("first")).alias("header"), "multiline")
             .agg(F.sort_array(F.collect_list("path")).alias("paths")))
    return [Layout(tuple(_strip_text(c) for c in next(csv.reader([r.header]), [])), r.multiline, tuple(unquote(p) for p in r.paths))
            for r in sorted(kinds.collect(), key=lambda r: r.paths[0])]


def peek_headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """Header cells of each file, by the file's path."""
    return {p: list(x.header) for x in raw_layouts(spark, paths) for p in x.paths}


def _num_text(c: Column, chars: str) -> Column:
    return F.trim(F.regexp_replace(c, f"[{chars}]", ""))


def with_place(df: DataFrame) -> DataFrame:
    """A scan with ``_file`` and ``_start`` of each row's split, for positions in file order."""
    return df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))


def read_raw_files(spark: SparkSession, paths: list[str], header: list[str], multiline: bool = False, places: bool = False) -> DataFrame:
    """Files of one header aligned to TARGET_COLUMNS (all strings, absent -> empty)."""
    n = max(len(header), MIN_FIELDS)
    schema = T.StructType([T.StructField(f"_c{i}", T.StringType()) for i in range(n)])
    df = (spark.read.schema(schema).options(**DIALECT).option("header", False).option("mode", "PERMISSIVE")
          .option("multiLine", multiline).csv(paths))
    df = with_place(df) if places else df
    pos = {c.lower(): i for i, c in enumerate(header)}
    cols = []
    for t in TARGET_COLUMNS:
        i = pos.get(t.lower())
        cols.append((strip_cell(F.coalesce(F.col(f"_c{i}"), F.lit(""))) if i is not None else F.lit("")).alias(t))
    # a row needs at least MIN_FIELDS cells: something at position >= MIN_FIELDS-1
    tail = F.coalesce(*[F.col(f"_c{i}") for i in range(MIN_FIELDS - 1, n)])
    return df.where(tail.isNotNull()).select(*cols, *(["_file", "_start"] if places else []))


def _validity() -> tuple[Column, Column, Column]:
    """FLT1's conditions: amount and rate parse, the issue date looks like one."""
    return (_num_text(F.col("loan_amnt"), "$,").try_cast("double").isNotNull(), _num_text(F.col("int_rate"), "%").try_cast("double").isNotNull(),
            F.coalesce(F.col("issue_d").rlike(ISSUE_D_PREFIX), F.lit(False)))


def valid_rows(df: DataFrame) -> DataFrame:
    """FLT1 + PRJ2: amount and rate parse as numbers, issue_d looks like ``Mon-YYYY``."""
    amt, rate = _num_text(F.col("loan_amnt"), "$,"), _num_text(F.col("int_rate"), "%")
    ok = reduce(lambda a, b: a & b, _validity())
    nonempty = lambda c: F.when(F.col(c) != "", F.col(c))
    return df.where(ok).withColumns({
        "loan_amnt": amt,
        "int_rate": rate,
        "funded_amnt": F.coalesce(_num_text(nonempty("funded_amnt"), "$,"), F.lit("")),
        "dti": F.coalesce(_num_text(nonempty("dti"), "%"), F.lit("")),
        "revol_util": F.coalesce(_num_text(nonempty("revol_util"), "%"), F.lit("")),
    })


def rejected_rows(df: DataFrame) -> DataFrame:
    """The rows that FLT1 drops, as they came, with the reason."""
    amt, rate, issue = _validity()
    reason = F.when(~amt, "loan_amnt").when(~rate, "int_rate").when(~issue, "issue_d")
    return df.withColumn("reason", reason).where(F.col("reason").isNotNull())


def read_raw_loans(spark: SparkSession, paths, multiline: bool | None = None, places: bool = False) -> DataFrame:
    """SRC1 + SET1 + FLT1: merged, validated raw loan rows from several CSV files.

    Files of equal headers are read together, so the plan has at most two branches per
    distinct header: files with line ends inside quoted cells are read whole, all others are
    split. ``multiline`` sets the way of reading for all files; ``places`` keeps the rows' splits for
    positions in file order. Files without a line have no rows.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    frames = [read_raw_files(spark, list(x.paths), list(x.header), x.multiline if multiline is None else multiline, places)
              for x in raw_layouts(spark, paths)]
    if not frames:
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in TARGET_COLUMNS) + (", _file string, _start long" if places else ""))
    return valid_rows(reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames))


def write_merged(df: DataFrame, path: str, columns: list[str] = TARGET_COLUMNS) -> None:
    """SNK5: the merged raw files with the fixed 30-column header (or another order of it)."""
    (df.select(*columns).write.mode("overwrite").options(**DIALECT).option("header", True)
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).option("emptyValue", "").csv(path))


def read_merged(spark: SparkSession, path: str, multiline: bool | None = None) -> DataFrame:
    """SRC2: the merged files back, all columns as strings (explicit schema, no inference).

    Files with line ends inside quoted cells are read whole, all others are split, unless
    ``multiline`` says how to read all of them.
    """
    schema = T.StructType([T.StructField(c, T.StringType()) for c in TARGET_COLUMNS])
    reader = spark.read.schema(schema).options(**DIALECT).option("header", True)
    if multiline is not None:
        return reader.option("multiLine", multiline).csv(path)
    by_kind: dict[bool, list[str]] = {}
    for x in raw_layouts(spark, [path]):
        by_kind.setdefault(x.multiline, []).extend(x.paths)
    frames = [reader.option("multiLine", kind).csv(paths) for kind, paths in by_kind.items()]
    return reduce(DataFrame.union, frames) if frames else spark.createDataFrame([], schema)
