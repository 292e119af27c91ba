"""Merkle manifest against the definition, over several rounds of the exchange."""
import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from loanscope.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, root string, grp int"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, low=False):
    text = r[1]
    if low and text is not None:
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    cells = [r[0], r[3], r[2], r[4], text]
    return H("".join("-" if c is None else f"{len(str(c).encode())}:{c}" for c in cells))


def climb(nodes):
    """Levels from the nodes to their root."""
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i:i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def path_of(levels, i):
    path = []
    for nodes in levels[:-1]:
        at = i // 16 * 16
        path.append(("".join(nodes[at:i]), "".join(nodes[i + 1:at + 16])))
        i //= 16
    return path


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = climb([leaf_of(r) for r in by[s]])
    top = climb([trees[s][-1][0] for s in order])
    out = []
    for j, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = path_of(trees[s], i) + path_of(top, j)
            bad = zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 5 == 0
            f = leaf_of(r, bad)
            for a, b in path:
                f = H(a, f, b)
            out.append((r[0], leaf_of(r), trees[s][-1][0], top[-1][0], H(*[a + b for a, b in path]), f, f == top[-1][0]))
    return out


def rows_of_some_size():
    rows = [(i, f"Text {i} äÖ", "en", "hot", i * 3, "x", 1) for i in range(700)]
    rows += [(10_000 + i, None if i % 3 else "Ab", None, f"s{i % 21}", None, None, None) for i in range(60)]
    rows += [(20_000, "", "de", None, 0, "y", 2), (20_000, "Z", "de", None, 0, "y", 2), (None, "Null id", "fr", "hot", 1, "z", 3)]
    rows += [(30_000, "Same", "en", "hot", 4, "x", 1)] * 40  # repeated rows
    rows += [(40_000, "x" * 300_000, "en", "long", 300_000, "x", 1)]
    rows += [(50_000 + i, "é", "en", s, 1, "x", 1) for i, s in enumerate(["é", "z", "Z", ""])]
    return rows


@pytest.mark.parametrize("local", [1, 2])
def test_manifest_equals_the_definition(spark, local):
    rows = rows_of_some_size()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = merkle.manifest(df, changed=merkle.tampered_leaf(), local=local).drop("proof").collect()
    assert sorted((tuple(r) for r in got), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[4])) == \
        sorted(plain(rows), key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[4]))


def test_honest_rows_are_verified_and_proofs_fold(spark):
    df = spark.createDataFrame(rows_of_some_size()[:100], SCHEMA)
    for r in merkle.manifest(df, local=1).collect():
        assert r.verified and merkle.fold_path(r.leaf, [(p.left, p.right) for p in r.proof]) == r.root


def test_one_changed_row_changes_only_its_verdict(spark):
    df = spark.createDataFrame(rows_of_some_size()[:300], SCHEMA)
    changed = F.when(F.col("doc_id") == 77, F.sha2(F.lit("other"), 256))
    assert [r.doc_id for r in merkle.manifest(df, changed=changed, local=1).collect() if not r.verified] == [77]


def test_empty_table_and_lone_leaf(spark):
    assert merkle.manifest(spark.createDataFrame([], SCHEMA)).count() == 0
    row = (1, "A", "en", "s", 1, "x", 1)
    r = merkle.manifest(spark.createDataFrame([row], SCHEMA)).first()
    assert r.leaf == r.subroot == r.root == leaf_of(row) and r.proof_sha256 == H("") and r.verified
