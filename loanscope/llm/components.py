"""Connected components of a link table, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loanscope.session import materialize


def connected(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a`` and ``b``); root is the smallest node of its component.

    Large-star and small-star steps alternate until the links no longer change: first
    every node points its larger neighbours, then all its smaller ones, to the smallest
    it knows. Each step is a partial aggregate and a join that may split skewed nodes;
    its links are written to the shared folder, so lineage stays short.
    """
    links = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links, before = materialize(links, name), None
    while not links.isEmpty():
        for large in (True, False):
            both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
            least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m") if large else F.min("b").alias("m"))
            seen = both.filter("b > a") if large else both
            moved = seen.join(least, "a").select("b", "m")
            if not large:  # the node itself follows its smallest neighbour too
                moved = moved.union(least.select(F.col("a").alias("b"), "m"))
            links = materialize(moved.filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), name)
        # Equal sums of mixed links and equal counts: nothing moved (also true of the stars that end it).
        now = tuple(links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first())
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root")).union(links.select("b", "b").distinct())
