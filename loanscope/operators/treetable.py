"""A boosted tree model as a table, compiled into one column expression (SNK4, OP14, OP16).

The table has a row per node: ``tree, node, feature, cut, left, right, value, weight``. An inner
node sends a row left where its feature is at most ``cut``; a leaf (no feature) has a ``value``;
``weight`` is the tree's. Such a table is written, read and inspected like any other, and the
expression it compiles to needs no ML library: it runs in batch, in streams and in SQL.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import write_table
from . import classifier


class Node(NamedTuple):
    tree: int
    node: int
    feature: str | None
    cut: float | None
    left: int | None
    right: int | None
    value: float | None
    weight: float


SCHEMA = "tree int, node int, feature string, cut double, left int, right int, value double, weight double"
_SPLIT = re.compile(r"If \(feature (\d+) <= (\S+)\)$")
_LEAF = re.compile(r"Predict: (\S+)$")


def _tree_nodes(number: int, weight: float, text: str, features: list[str]) -> list[Node]:
    """The nodes of a tree from its printed form, in the order of a walk, left first."""
    lines = [line.strip() for line in text.splitlines()[1:] if line.strip()]
    nodes: list[Node] = []

    def read(at: int) -> tuple[int, int]:
        """The node that line ``at`` begins: its number and the line after it."""
        own = len(nodes)
        split, leaf = _SPLIT.match(lines[at]), _LEAF.match(lines[at])
        if leaf:
            nodes.append(Node(number, own, None, None, None, None, float(leaf[1]), weight))
            return own, at + 1
        if not split:
            raise ValueError(f"only splits of ordered features can be tabled: {lines[at]}")
        nodes.append(Node(number, own, features[int(split[1])], float(split[2]), None, None, None, weight))
        left, at = read(at + 1)
        right, at = read(at + 1)  # past the Else line
        nodes[own] = nodes[own]._replace(left=left, right=right)
        return own, at

    read(0)
    return nodes


def model_nodes(model, features: list[str] = classifier.FEATURES) -> list[Node]:
    """The nodes of a fitted boosted-tree model or of a pipeline that ends in one."""
    gbt = model.stages[-1] if hasattr(model, "stages") else model
    return [n for i, (t, w) in enumerate(zip(gbt.trees, gbt.treeWeights)) for n in _tree_nodes(i, float(w), t.toDebugString, features)]


def model_table(spark: SparkSession, nodes: Iterable[Node]) -> DataFrame:
    return spark.createDataFrame([tuple(n) for n in nodes], SCHEMA)


def save_model(spark: SparkSession, nodes: Iterable[Node], path: str) -> None:
    write_table(model_table(spark, nodes).coalesce(1), path)


def load_model(spark: SparkSession, path: str) -> list[Node]:
    """A saved model; its nodes number thousands, whatever the data's size."""
    return [Node(*r) for r in spark.read.parquet(path).select(*Node._fields).orderBy("tree", "node").collect()]


def margin_sql(nodes: Iterable[Node]) -> str:
    """The weighted sum of all trees as a SQL expression over the feature columns."""
    trees: dict[int, dict[int, Node]] = {}
    for n in nodes:
        trees.setdefault(n.tree, {})[n.node] = n

    def tree(of: dict[int, Node], at: int) -> str:
        n = of[at]
        if n.feature is None:
            return f"CAST({n.value!r} AS DOUBLE)"
        return f"CASE WHEN {n.feature} <= CAST({n.cut!r} AS DOUBLE) THEN {tree(of, n.left)} ELSE {tree(of, n.right)} END"

    sums = [f"CAST({of[min(of)].weight!r} AS DOUBLE) * ({tree(of, min(of))})" for _, of in sorted(trees.items())]
    while len(sums) > 1:  # a balanced sum: hundreds of trees nest only a few levels deep
        sums = [f"({' + '.join(sums[i:i + 8])})" for i in range(0, len(sums), 8)]
    return sums[0] if sums else "CAST(0 AS DOUBLE)"


def probability(nodes: Iterable[Node]) -> Column:
    """Probability of default of a row with the feature columns."""
    return 1.0 / (1.0 + F.exp(-2.0 * F.expr(margin_sql(nodes))))


def score_table(nodes: Iterable[Node], df: DataFrame) -> DataFrame:
    """``df`` with ``probability_default`` in 0..1."""
    return df.withColumn("probability_default", probability(nodes))


def score_loans(nodes: Iterable[Node], requests: DataFrame) -> DataFrame:
    """OP16 with a tabled model: probability %, tier and action of a batch or stream of applications."""
    feats = classifier._transform(classifier.score_defaults(requests), training=False)
    return classifier.with_risk_tier(score_table(nodes, feats), F.col("probability_default") * 100.0)


#: A small model of three trees, to score every loan the same way everywhere.
SMALL_MODEL = [
    Node(0, 0, "int_rate", 13.0, 1, 4, None, 1.0),
    Node(0, 1, "fico_range_low", 655.0, 2, 3, None, 1.0),
    Node(0, 2, None, None, None, None, -0.55, 1.0),
    Node(0, 3, None, None, None, None, -0.95, 1.0),
    Node(0, 4, None, None, None, None, -0.35, 1.0),
    Node(1, 0, "dti", 24.5, 1, 2, None, 0.1),
    Node(1, 1, None, None, None, None, -0.8, 0.1),
    Node(1, 2, "annual_inc", 11.0, 3, 4, None, 0.1),
    Node(1, 3, None, None, None, None, 1.3, 0.1),
    Node(1, 4, None, None, None, None, 0.25, 0.1),
    Node(2, 0, "is_unverified", 0.5, 1, 2, None, 0.1),
    Node(2, 1, None, None, None, None, -0.2, 0.1),
    Node(2, 2, "term_months", 36.0, 3, 4, None, 0.1),
    Node(2, 3, None, None, None, None, 0.4, 0.1),
    Node(2, 4, None, None, None, None, 1.1, 0.1),
]
