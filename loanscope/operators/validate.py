"""Data-quality checks (OP28): the schema's constraints and the reference tests' invariants.

Each check is an aggregation (one grouping of all keys, conditional counts)
producing report rows ``(check_name, table_name, violations, passed)``; the rows
are unioned so the whole report is one job.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOAN_NOT_NULL = ["borrower_id", "issue_month", "issue_year", "loan_amnt", "funded_amnt", "term",
                 "int_rate", "installment", "grade", "sub_grade", "loan_status"]


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Number of key values that occur more than once (NULL keys count too)."""
    d = df.groupBy(key).count().where(F.col("count") > 1)
    return d.agg(F.count(F.lit(1)).alias("v"))


def missing_parents(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    """JN8: child rows whose foreign key has no parent row (left anti join)."""
    orphans = child.select(F.col(fk).alias("_k")).join(parent.select(F.col(pk).alias("_k")), "_k", "left_anti")
    return orphans.agg(F.count(F.lit(1)).alias("v"))


def _rows(stats: DataFrame, checks) -> DataFrame:
    """Several report rows from one aggregation row: checks = [(name, table, column)]."""
    arr = F.array(*[F.struct(F.lit(n).alias("check_name"), F.lit(t).alias("table_name"),
                             F.coalesce(F.col(c), F.lit(0)).cast("bigint").alias("violations"))
                    for n, t, c in checks])
    return stats.select(F.inline(arr)).withColumn("passed", F.col("violations") == 0)


def key_audit(loans: DataFrame, borrowers: DataFrame, payments: DataFrame, loan: str = "loan_id", borrower: str = "borrower_id") -> DataFrame:
    """All primary and foreign keys at once, as one row of violations.

    Every key value of every table becomes a row tagged with its space (loans or borrowers) and
    its table; one grouping by space and key, with counts per table, yields duplicates and
    orphans of all of them. A hot foreign key is one partial row per task. NULL keys group
    together: repeated ones are duplicates, and a NULL foreign key has no parent.
    """
    text = not all(loans.schema[c].dataType.typeName() == "long" for c in (loan, borrower))

    def tagged(space: int, table: str, column: str):
        key = F.col(column).cast("string") if text else F.col(column).cast("long")
        return F.struct(F.lit(space).alias("space"), F.lit(table).alias("tab"), key.alias("k"))

    keys = loans.select(F.inline(F.array(tagged(1, "l", loan), tagged(2, "l", borrower))))
    keys = keys.union(payments.select(F.inline(F.array(tagged(1, "p", loan))))).union(borrowers.select(F.inline(F.array(tagged(2, "b", borrower)))))
    of = lambda t: F.count(F.when(F.col("tab") == t, 1)).alias(t)
    groups = keys.groupBy("space", "k").agg(of("l"), of("p"), of("b"))
    loans_space, borrowers_space = F.col("space") == 1, F.col("space") == 2
    count = lambda c: F.count(F.when(c, 1))
    orphans = lambda space, child, parent: F.sum(F.when(space & (F.col("k").isNull() | (F.col(parent) == 0)), F.col(child)))
    return groups.agg(count(loans_space & (F.col("l") > 1)).alias("dl"), count(borrowers_space & (F.col("b") > 1)).alias("db"),
                      count(loans_space & (F.col("p") > 1)).alias("dp"), orphans(borrowers_space, "l", "b").alias("ol"),
                      orphans(loans_space, "p", "l").alias("op"))


def validate(loans: DataFrame, borrowers: DataFrame, payments: DataFrame, rollup: DataFrame | None = None,
             floors: dict[str, int] | None = None, loan: str = "loan_id", borrower: str = "borrower_id") -> DataFrame:
    """OP28: keys in one grouping, row-level checks in one pass per table.

    ``floors`` gives least row counts by table name; falling short is one violation. ``loan`` and
    ``borrower`` name the key columns.
    """
    floors = floors or {}
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in LOAN_NOT_NULL])
    empty = (F.count(F.lit(1)) == 0).cast("int")
    few = lambda t: (F.count(F.lit(1)) < floors.get(t, 0)).cast("int").alias("few")
    floor = lambda t: [("row_count_floor", t, "few")] if t in floors else []
    checks = [
        _rows(key_audit(loans, borrowers, payments, loan, borrower), [
            ("primary_key_unique", "loans", "dl"), ("primary_key_unique", "borrowers", "db"), ("primary_key_unique", "payments_recoveries", "dp"),
            ("foreign_key_present", "loans", "ol"), ("foreign_key_present", "payments_recoveries", "op")]),
        _rows(loans.agg(F.count(F.when(any_null, 1)).alias("nn"), empty.alias("ne"), few("loans")),
              [("not_null", "loans", "nn"), ("non_empty", "loans", "ne"), *floor("loans")]),
        _rows(borrowers.agg(empty.alias("ne"), few("borrowers")), [("non_empty", "borrowers", "ne"), *floor("borrowers")]),
        _rows(payments.agg(empty.alias("ne"), few("payments_recoveries")),
              [("non_empty", "payments_recoveries", "ne"), *floor("payments_recoveries")]),
    ]
    if rollup is not None:
        dr, ff = F.col("default_rate"), F.col("funding_fulfillment_rate")
        checks.append(_rows(rollup.agg(
            F.count(F.when(dr.isNull() | (dr < 0) | (dr > 100), 1)).alias("dr"),
            F.count(F.when(ff.isNull() | (ff < 50), 1)).alias("ff"), empty.alias("ne")),
            [("default_rate_in_0_100", "monthly_kpi_rollup", "dr"),
             ("fulfillment_at_least_50", "monthly_kpi_rollup", "ff"),
             ("non_empty", "monthly_kpi_rollup", "ne")]))
    return reduce(DataFrame.unionByName, checks)
