"""Table sinks (SNK1, SNK2): idempotent overwrites of Parquet tables.

Overwrite (not append) makes a re-run replace its output instead of
violating the primary keys, and a lost executor simply recomputes its tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)


def write_rollup(rollup: DataFrame, path: str) -> None:
    """SNK2: replace the monthly rollup table (one small file set)."""
    write_table(rollup.coalesce(1), path)
