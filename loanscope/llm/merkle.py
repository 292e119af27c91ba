"""Merkle manifest of a table: butterfly exchange of subtree roots.

A row becomes a leaf, the leaves of a group (a source) form a tree of fanout 16 in the order of
their ids, and the roots of the groups form the tree above them.

1. Leaves are hashed where they are read; from there on only digests move.
2. Rows are numbered within their group by ranges of (group, id): a count per range and group
   gives each range its offset, so that a group of any size is numbered by many tasks.
3. Runs of ``16 ** LOCAL_LEVELS`` aligned leaves are the partitions of the exchange. One row
   holds such a run and the root of its subtree.
4. Butterfly: in round r the partitions of an aligned group of sixteen subtrees, of ``16 ** r``
   partitions each, swap their subtree's roots: each asks one partner in each of the other
   subtrees, the one at its own place (modulo the partner subtree's size where that is the
   ragged last one). Every partition hashes the common ancestor itself and keeps the siblings,
   so after the last round it holds its whole upper proof and nothing has to be sent down.
5. Each partition then writes the proofs of its leaves and folds the tampered ones.

Cases: a null field is hashed as ``-``; a null group is a group of its own and comes first; null
ids come first; equal ids are ordered by their leaf; repeated rows are leaves of their own; an
empty table has no rows; a lone leaf is its own root and has the empty proof. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loanscope.session import materialize

from .common import fold_col

FANOUT = 16
#: Levels below a partition of the exchange: 4,096 leaves.
LOCAL_LEVELS = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_hash(fields: list[Column]) -> Column:
    """Hex sha256 of the fields, each as byte count, colon and value, or ``-`` where null."""
    def part(c: Column) -> Column:
        text = c.cast("string")
        return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))

    return F.sha2(F.concat(*map(part, fields)), 256)


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels_above(n: int) -> int:
    """Levels between n nodes and their root."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FANOUT), levels + 1
    return levels


def local_levels(nodes: list[str], levels: int) -> list[list[str]]:
    """The nodes and the levels above them, ``levels`` in number."""
    out = [nodes]
    for _ in range(levels):
        out.append([digest(out[-1][i:i + FANOUT]) for i in range(0, len(out[-1]), FANOUT)])
    return out


def numbered(leaves: DataFrame) -> DataFrame:
    """``leaves`` (grp, id, leaf, ...) with ``pos``, the place in the group, and ``n``, the group's size.

    Rows are cut into ranges of (grp, id, leaf); the last key only parts repeated rows, so
    that any number of them can be cut.
    """
    spark = leaves.sparkSession
    order = ["grp", "id", "leaf", "_copy"]
    ranged = (leaves.withColumn("_copy", F.monotonically_increasing_id())
              .repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).sortWithinPartitions(*order)
              .drop("_copy").withColumns({"_rng": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))
    ranged = materialize(ranged, "merkle-ranges")
    counts = ranged.groupBy("grp", "_rng").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    # one row per range and group
    before = Window.partitionBy("grp").orderBy("_rng").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("grp", "_rng", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                           F.sum("_n").over(Window.partitionBy("grp")).alias("n"))
    at = counts.select(F.col("grp").alias("_g"), F.col("_rng").alias("_r"), "_first", "_before", "n")
    rows = ranged.join(at, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("_rng") == F.col("_r")))
    return rows.withColumn("pos", F.col("_before") + F.col("_at") - F.col("_first")).drop("_g", "_r", "_rng", "_at", "_first", "_before")


def partitions(rows: DataFrame, local: int) -> DataFrame:
    """One row per run of ``16 ** local`` leaves: its leaves in order, its subtree's root, the group's number of runs."""
    size = FANOUT ** local
    runs = (rows.groupBy("grp", "n", F.expr(f"pos div {size}").alias("part"))
            .agg(F.sort_array(F.collect_list(F.struct("pos", "id", "leaf", "changed"))).alias("rows")))
    runs = runs.select("grp", "part", "n", F.expr(f"(n + {size - 1}) div {size}").alias("parts"), F.col("rows.id").cast("array<string>").alias("ids"),
                       F.col("rows.leaf").alias("leaves"), F.col("rows.changed").alias("changed"))
    schema = ("grp string, part long, n long, parts long, ids array<string>, leaves array<string>, changed array<string>, "
              "levels int, node string")

    def roots(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            levels = [min(local, levels_above(n)) for n in f["n"]]
            nodes = [local_levels(list(x), k)[-1][0] for x, k in zip(f["leaves"], levels)]
            yield f.assign(levels=levels, node=nodes)

    return runs.mapInPandas(roots, schema)


def butterfly(parts: DataFrame) -> DataFrame:
    """(grp, part, parts, node) to (grp, part, path, node): siblings left and right by round, and the group's root."""
    state = materialize(parts.select("grp", "part", "parts", "node", F.array().cast("array<struct<left:string,right:string>>").alias("path")),
                        "merkle-round")
    most, stride = state.agg(F.max("parts")).first()[0] or 0, 1
    while stride < most:
        own = F.expr(f"part div {stride}")
        nodes = F.expr(f"(parts + {stride - 1}) div {stride}")
        first = own - own % FANOUT
        last = F.least(first + FANOUT - 1, nodes - 1)
        asks = state.filter(nodes > 1).select(
            "grp", "part", "parts", "path", own.alias("own"), F.explode(F.sequence(first, last)).alias("other"))
        size = F.least(F.lit(stride), F.col("parts") - F.col("other") * stride)
        asks = asks.withColumn("partner", F.col("other") * stride + (F.col("part") % stride) % size)
        theirs = state.select(F.col("grp").alias("_g"), F.col("part").alias("partner"), "node")
        met = (asks.join(theirs.withColumnRenamed("partner", "_p"), F.col("grp").eqNullSafe(F.col("_g")) & (F.col("partner") == F.col("_p")))
               .groupBy("grp", "part", "parts", "path", "own").agg(F.sort_array(F.collect_list(F.struct("other", "node"))).alias("ring")))

        def side(keep) -> Column:
            return F.array_join(F.transform(F.filter("ring", keep), lambda x: x["node"]), "")

        told = met.select("grp", "part", "parts", F.sha2(side(lambda x: F.lit(True)), 256).alias("node"),
                          F.concat("path", F.array(F.struct(side(lambda x: x["other"] < F.col("own")).alias("left"),
                                                            side(lambda x: x["other"] > F.col("own")).alias("right")))).alias("path"))
        state = materialize(told.union(state.filter(nodes <= 1).select(*told.columns)), "merkle-round")
        stride *= FANOUT
    return state.select("grp", "part", "path", "node")


def tree(leaves: DataFrame, local: int = LOCAL_LEVELS) -> DataFrame:
    """(grp, id, leaf, changed) to a row per run of leaves with their upper proof and the group's root.

    Columns: grp, ids, leaves, changed, levels (local ones), path, subroot.
    """
    parts = materialize(partitions(numbered(leaves), local), "merkle-parts")
    upper = butterfly(parts).select(F.col("grp").alias("_g"), F.col("part").alias("_p"), "path", F.col("node").alias("subroot"))
    return (parts.join(upper, F.col("grp").eqNullSafe(F.col("_g")) & (F.col("part") == F.col("_p")))
            .select("grp", "ids", "leaves", "changed", "levels", "path", "subroot"))


def own_path(levels: list[list[str]], i: int) -> list[tuple[str, str]]:
    """Siblings left and right of leaf i on each of the levels but the topmost."""
    out = []
    for nodes in levels[:-1]:
        at = i - i % FANOUT
        out.append(("".join(nodes[at:i]), "".join(nodes[i + 1:at + FANOUT])))
        i //= FANOUT
    return out


def fold_path(leaf: str, path: list[tuple[str, str]]) -> str:
    for left, right in path:
        leaf = digest([left, leaf, right])
    return leaf


def _pairs(path) -> list[tuple[str, str]]:
    return [(p["left"], p["right"]) for p in path]


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "source",
             fields: tuple[str, ...] = FIELDS, changed: Column | None = None, local: int = LOCAL_LEVELS) -> DataFrame:
    """A row per row of ``df``: id, leaf, subroot, root, proof, proof_sha256, folded_root and verified.

    ``changed`` is the leaf hash to be verified in place of a row's own (null: its own). ``proof``
    holds the siblings level by level, as (left, right) texts of concatenated digests.
    """
    cells = [F.col(c) for c in fields]
    leaves = materialize(df.select(F.col(group_col).cast("string").alias("grp"), F.col(id_col).cast("long").alias("id"),
                                   leaf_hash(cells).alias("leaf"),
                                   (F.lit(None) if changed is None else changed).cast("string").alias("changed")), "merkle-leaves")
    runs = materialize(tree(leaves, local), "merkle-runs")
    groups = runs.groupBy("grp").agg(F.first("subroot").alias("subroot"))
    tops = tree(groups.select(F.lit(None).cast("string").alias("grp"), F.col("grp").alias("id"), F.col("subroot").alias("leaf"),
                              F.lit(None).cast("string").alias("changed")), local)
    top_schema = "_g string, root string, top array<struct<left:string,right:string>>"

    def group_paths(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                levels = local_levels(list(r.leaves), r.levels)
                upper = _pairs(r.path)
                paths = [[dict(left=a, right=b) for a, b in own_path(levels, i) + upper] for i in range(len(r.leaves))]
                yield pd.DataFrame({"_g": list(r.ids), "root": r.subroot, "top": paths})

    above = materialize(tops.mapInPandas(group_paths, top_schema), "merkle-tops")
    met = runs.join(above, F.col("grp").eqNullSafe(F.col("_g"))).select("ids", "leaves", "changed", "levels", "path", "subroot", "root", "top")
    schema = (f"{id_col} long, leaf string, subroot string, root string, proof array<struct<left:string,right:string>>, "
              "proof_sha256 string, folded_root string, verified boolean")

    def prove(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for r in f.itertuples(index=False):
                levels = local_levels(list(r.leaves), r.levels)
                upper = _pairs(r.path) + _pairs(r.top)
                ids = [None if i is None else int(i) for i in r.ids]
                for at in range(0, len(ids), 256):
                    some = range(at, min(at + 256, len(ids)))
                    paths = [own_path(levels, i) + upper for i in some]
                    folded = [fold_path(r.leaves[i] if r.changed[i] is None else r.changed[i], p) for i, p in zip(some, paths)]
                    yield pd.DataFrame({
                        id_col: pd.Series([ids[i] for i in some], dtype="Int64"), "leaf": [r.leaves[i] for i in some],
                        "subroot": r.subroot, "root": r.root,
                        "proof": [[dict(left=a, right=b) for a, b in p] for p in paths],
                        "proof_sha256": [digest([a + b for a, b in p]) for p in paths],
                        "folded_root": folded, "verified": [x == r.root for x in folded]})

    return met.mapInPandas(prove, schema)


def tampered_leaf(id_col: str = "doc_id", text_col: str = "text", fields: tuple[str, ...] = FIELDS) -> Column:
    """The leaf of a row whose A-Z are lower-cased, where 5 divides the crc32 of its id; else null."""
    lower = F.translate(F.col(text_col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(fold_col(id_col, 5) == 0, leaf_hash([lower if c == text_col else F.col(c) for c in fields]))


def _sql(levels: int = 8) -> str:
    """The query in DuckDB's SQL, for up to ``16 ** levels`` rows of a source and as many sources."""
    part = "coalesce(strlen({0}) || ':' || {0}, '-')".format
    leaf = "sha256(" + " || ".join(part(f"CAST({c} AS VARCHAR)") for c in FIELDS) + ")"
    low = leaf.replace("CAST(text AS VARCHAR)", "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")
    byte = "list_reduce([xor(c, b) & 255, 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END)"
    crc = ("xor(4294967295, list_reduce(list_prepend(4294967295, [ord(x)::BIGINT FOR x IN string_split(coalesce(CAST(doc_id AS VARCHAR), ''), '') IF x <> '']), "
           f"lambda c, b: xor(c >> 8, {byte})))")
    out = [f"""d AS (SELECT doc_id, source, {leaf} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {low} END AS changed FROM documents),
p AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, changed) - 1 AS pos FROM d)"""]

    def climb(name: str, base: str) -> None:
        """Levels of ``base`` (g, pos, h): per level the runs of sixteen nodes, of groups that still have several."""
        out.append(f"{name}0 AS ({base})")
        for i in range(levels):
            at = f"{name}{i}"
            out.append(f"""{at}r AS (SELECT g, pos // 16 AS pos, list(h ORDER BY pos) AS run
    FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {at}) WHERE c > 1 GROUP BY g, pos // 16),
{name}{i + 1} AS (SELECT g, pos, sha256(array_to_string(run, '')) AS h FROM {at}r
    UNION ALL SELECT g, pos, h FROM (SELECT *, count(*) OVER (PARTITION BY g) AS c FROM {at}) WHERE c = 1)""")

    def prove(name: str, start: str, first: str) -> None:
        """Siblings and folds of the rows of ``start`` (k, g, i, proof, f) along the levels of ``name``."""
        out.append(f"{first}0 AS ({start})")
        for i in range(levels):
            out.append(f"""{first}{i + 1} AS (SELECT w.k, w.g, w.i // 16 AS i,
    CASE WHEN r.run IS NULL THEN w.proof ELSE w.proof || array_to_string(r.run[:(w.i % 16)], '') || array_to_string(r.run[(w.i % 16 + 2):], '') END AS proof,
    CASE WHEN r.run IS NULL THEN w.f ELSE sha256(array_to_string(r.run[:(w.i % 16)], '') || w.f || array_to_string(r.run[(w.i % 16 + 2):], '')) END AS f
    FROM {first}{i} w LEFT JOIN {name}{i}r r ON r.g IS NOT DISTINCT FROM w.g AND r.pos = w.i // 16)""")

    climb("a", "SELECT source AS g, pos, leaf AS h FROM p")
    out.append(f"s AS (SELECT g AS source, h AS subroot, row_number() OVER (ORDER BY g NULLS FIRST) - 1 AS pos FROM a{levels})")
    climb("b", "SELECT 0 AS g, pos, subroot AS h FROM s")
    prove("a", "SELECT struct_pack(source := source, pos := pos) AS k, source AS g, pos AS i, '' AS proof, coalesce(changed, leaf) AS f FROM p", "v")
    prove("b", f"SELECT v.k, 0 AS g, s.pos AS i, v.proof, v.f FROM v{levels} v JOIN s ON s.source IS NOT DISTINCT FROM v.g", "w")
    return "WITH " + ",\n".join(out) + f"""
SELECT p.doc_id, p.leaf, s.subroot, t.h AS root, sha256(w.proof) AS proof_sha256, w.f AS folded_root, w.f = t.h AS verified
FROM p JOIN s ON s.source IS NOT DISTINCT FROM p.source JOIN b{levels} t ON true
JOIN w{levels} w ON w.k.source IS NOT DISTINCT FROM p.source AND w.k.pos = p.pos"""


ORACLE = _sql()
