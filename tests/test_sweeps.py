"""Sweeps over tables of settings: equal to single scenarios and to all pairs, without pairing rows."""
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from loanscope.operators import sweeps, whatif


def test_dominance_sums_equal_all_pairs(spark):
    rng = random.Random(1)
    points = [(rng.choice([3, 700, 701, 702, 900, rng.randrange(2000)]), rng.choice([0, 5, rng.randrange(-50, 400)]), rng.randrange(9)) for _ in range(400)]
    queries = [(rng.randrange(-20, 2100), rng.randrange(-60, 420), i) for i in range(300)] + [(None, 5, 900), (5, None, 901), (2500, 1, 902)]
    p = spark.createDataFrame(points, "x long, y long, n long").groupBy("x", "y").agg(F.sum("n").alias("n"))
    got = {r.id: int(r.n) for r in sweeps.dominance_sums(p, spark.createDataFrame(queries, "x long, y long, id long"), ["n"], ranges=7).collect()}
    for x, y, i in queries:
        want = sum(n for a, b, n in points if x is not None and y is not None and a >= x and b <= y)
        assert got.get(i, 0) == want, (x, y)


def test_prefix_sums_of_few_and_of_one_value(spark):
    p = spark.createDataFrame([("a", 5, 1), ("a", 5, 2), ("b", 7, 4)], "grp string, y long, n long")
    q = spark.createDataFrame([("a", 4, 1), ("a", 5, 2), ("b", 9, 3), ("c", 9, 4)], "grp string, y long, id long")
    assert {r.id: int(r.n) for r in sweeps.prefix_sums(p, q, ["n"]).collect()} == {1: 0, 2: 3, 3: 4, 4: 0}
    assert sweeps.dominance_sums(p.selectExpr("y AS x", "y", "n").where("false"), q.selectExpr("y AS x", "y", "id"), ["n"]).count() == 0


def settings(spark, **columns):
    names = list(columns)
    rows = [tuple(None if v is None else Decimal(str(v)) for v in r) + (f"row {i}",) for i, r in enumerate(zip(*columns.values()))]
    return spark.createDataFrame(rows, ", ".join(f"{n} decimal(18,2)" for n in names) + ", note string")


SINGLE = {"underwriting": (whatif.what_if_underwriting, {"min_fico": [660, 660, 0, 900, 701], "max_dti": [35, 35, 99, 99, 0.07]}),
          "pricing": (whatif.what_if_pricing, {"bps": [150, -300, 0, -2000]}),
          "funding": (whatif.what_if_funding, {"threshold": [95, 9.5, 100, 200, 0]}),
          "collections": (whatif.what_if_collections, {"uplift": [25, 0, 12.5], "fee": [16, 30, 0.25]}),
          "verification": (whatif.what_if_verification, {"pct": [30, 100, 12.5], "cost": [35, 0, 9.99]})}


@pytest.mark.parametrize("op", list(SINGLE))
def test_every_setting_gives_the_single_scenario(spark, book, op):
    single, columns = SINGLE[op]
    frame = {"funding": book.loans, "pricing": book.loans_with_payments, "collections": book.loans_with_payments}.get(op, book.book)()
    out = sweeps.sweep(op, settings(spark, **columns), frame)
    got = {r.note: r.asDict() for r in out.collect()}
    assert len(got) == len(next(iter(columns.values())))
    for i, values in enumerate(zip(*columns.values())):
        want = single(frame, *values).first().asDict()
        shared = [c for c in out.columns if c in want and c not in columns]
        assert len(shared) >= 3
        assert {c: got[f"row {i}"][c] for c in shared} == {c: want[c] for c in shared}, values


def test_null_and_missing_settings(spark, book):
    r = sweeps.sweep("underwriting", settings(spark, min_fico=[None, 660], max_dti=[30, None]), book.book()).collect()
    assert [x.sim_loan_count for x in r] == [0, 0]
    assert sweeps.sweep("pricing", settings(spark, bps=[None]), book.loans_with_payments()).first().net_yield_delta is None
    with pytest.raises(ValueError, match="fee"):
        sweeps.sweep("collections", settings(spark, uplift=[1]), book.loans_with_payments())


def test_settings_meet_no_loans_in_pairs(spark, book):
    plan = sweeps.sweep("underwriting", settings(spark, min_fico=[1, 2], max_dti=[3, 4]), book.book())._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
