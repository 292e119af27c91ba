"""Scans of the driver's Parquet tables.

Every scan names its columns, so the Parquet reader only decodes what the
loan book uses (visible as ``ReadSchema`` in the plan).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..session import table_path

COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
               "o_orderdate", "o_orderpriority"],
    "customer": ["c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "lineitem": ["l_orderkey", "l_extendedprice", "l_returnflag"],
}


def scan(spark: SparkSession, sf_dir: str, name: str, columns=None) -> DataFrame:
    cols = columns or COLUMNS.get(name)
    df = spark.read.parquet(table_path(sf_dir, name))
    return df.select(*cols) if cols else df
