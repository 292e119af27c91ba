import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from loanscope.operators import classifier, forecast


def test_evaluate_scores_matches_hand_values(spark):
    # scores with a tie: AUC by Mann-Whitney with half ties; AP step-wise
    data = [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0), (0.2, 1), (0.1, 0)]
    df = spark.createDataFrame(data, "score double, is_default int")
    r = classifier.evaluate_scores(df, threshold=0.5).first()
    # pairs (pos, neg): 9; pos>neg: 0.9>all 3, 0.8 (tie .5 with .8) + .3 + .1 -> 2.5, 0.2 > 0.1 -> 1 => 6.5/9
    assert r.roc_auc == round(6.5 / 9, 6)
    # AP: thresholds 0.9 (P=1,R=1/3), 0.8 (P=2/3,R=2/3), 0.3, 0.2 (P=3/5,R=1)
    assert r.average_precision == round((1 * 1 / 3) + (2 / 3) * (1 / 3) + (3 / 5) * (1 / 3), 6)
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 1, 1, 2)
    assert r.default_prior_pct == 50.0


def test_sampling_and_split_are_repeatable(spark, book):
    lb = classifier.resolved(book.loans_with_borrowers())
    s1 = [r.loan_id for r in classifier.sample_rows(lb, 50, 7).collect()]
    s2 = [r.loan_id for r in classifier.sample_rows(lb, 50, 7).collect()]
    assert s1 == s2 and len(set(s1)) == 50
    whole = sorted(lb.selectExpr("md5(concat(loan_id, '7')) AS h", "loan_id").collect())[:50]
    assert s1 == [r.loan_id for r in whole]
    assert classifier.sample_rows(lb, 10 ** 9, 7).count() == lb.count()
    for bits in (4, 16):  # stratified: of each label exactly a fifth, rounded down
        for r in classifier.split_flag(lb, bits=bits).groupBy("is_default").agg(F.count("*").alias("n"), F.sum(F.expr("int(split = 'test')")).alias("t")).collect():
            assert r.t == r.n * 20 // 100


def test_score_metrics_do_not_depend_on_ranges_and_hold_for_large_counts(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 200, 3000) / 1e9, rng.integers(0, 2, 3000)  # closer than any fixed resolution
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y)], "score double, is_default int")
    rows = [classifier.evaluate_scores(df, threshold=1e-7, ranges=n).first() for n in (1, 7)]
    assert rows[0] == rows[1]
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean((pos[:, None] > neg) + 0.5 * (pos[:, None] == neg))
    assert abs(rows[0].roc_auc - auc) < 1e-6
    # counts of 1e12 loans stay exact
    big = spark.createDataFrame([(0.9, 6 * 10 ** 11, 10 ** 11), (0.1, 10 ** 11, 5 * 10 ** 11)], "s double, pos long, neg long")
    n = big.selectExpr("sum(CAST(CAST(neg AS decimal(19,0)) * CAST(2 * pos AS decimal(19,0)) AS decimal(38,0))) AS x").first().x
    assert int(n) == 2 * (6 * 10 ** 22 + 5 * 10 ** 22)


def test_tiers_are_cut_on_the_raw_percent(spark):
    df = spark.createDataFrame([(4.9963,), (5.0,), (11.996,), (12.0,), (21.999,), (22.0,), (34.999,), (35.0,)], "p double")
    got = [r.risk_tier.split(" (")[0] for r in classifier.with_risk_tier(df, F.col("p")).collect()]
    assert got == ["Prime", "Near-Prime", "Near-Prime", "Subprime", "Subprime", "High Risk", "High Risk", "Critical Default Risk"]


def test_missing_categories_are_a_category(spark):
    from loanscope.operators import drivers
    df = spark.createDataFrame([("OWN", "a"), (None, "b"), ("RENT", None), ("MORTGAGE", "a")], "home_ownership string, purpose string")
    got = drivers.with_codes(df, {"home_ownership": "h", "purpose": "p"}).collect()
    # MORTGAGE, None, OWN, RENT
    assert {(r.home_ownership, r.purpose, r.h, r.p) for r in got} == {("OWN", "a", 2, 1), (None, "b", 1, 2), ("RENT", None, 3, 0), ("MORTGAGE", "a", 0, 1)}


def test_codes_of_many_labels_stay_out_of_the_plan(spark):
    from loanscope.operators import drivers
    df = spark.range(5000).select(F.format_string("label %05d", F.col("id") % 2500).alias("purpose"), F.lit("x").alias("home_ownership"))
    out = drivers.with_codes(df, {"purpose": "p", "home_ownership": "h"})
    assert "label 00017" not in out._jdf.queryExecution().toString()
    assert all(r.p == int(r.purpose[6:]) and r.h == 0 for r in out.collect())


def test_classifier_learns_a_separable_rule(spark):
    rng = np.random.default_rng(0)
    n = 600
    x = rng.uniform(0, 1, n)
    pdf = pd.DataFrame({f: rng.uniform(0, 1, n) for f in classifier.FEATURES})
    pdf["int_rate"] = x * 30
    pdf["is_default"] = (x > 0.6).astype(int)
    pdf["loan_id"] = [str(i) for i in range(n)]
    feats = spark.createDataFrame(pdf)
    b = classifier.train_default_classifier(feats, max_iter=5, max_depth=2)
    m = b.metrics.first()
    assert m.roc_auc > 0.9
    scored = classifier.score_frame(b.model, feats).agg(F.min("probability_default").alias("lo"),
                                                        F.max("probability_default").alias("hi")).first()
    assert 0.0 <= scored.lo <= scored.hi <= 1.0
    imp = b.importances.collect()
    assert abs(sum(r.importance_pct for r in imp) - 100) < 0.1


def test_score_loans_fills_defaults(spark):
    pdf = pd.DataFrame({f: np.linspace(0, 1, 200) for f in classifier.FEATURES})
    pdf["is_default"] = (np.arange(200) % 3 == 0).astype(int)
    pdf["loan_id"] = [str(i) for i in range(200)]
    b = classifier.train_default_classifier(spark.createDataFrame(pdf), max_iter=3, max_depth=2)
    req = spark.createDataFrame([("x", 12000.0, "B", 75000.0, "Verified", "MORTGAGE")],
                                "loan_id string, loan_amnt double, grade string, annual_inc double, "
                                "verification_status string, home_ownership string")
    r = classifier.score_loans(b.model, req).first()
    assert 0 <= r.default_probability_pct <= 100 and r.risk_tier and r.underwriting_recommendation


def test_training_rows_of_one_file_are_dealt_to_all_cores(spark, monkeypatch):
    from pyspark.ml import Pipeline

    from loanscope import session
    rng = np.random.default_rng(5)
    n = 3000
    pdf = pd.DataFrame({f: rng.integers(0, 40, n).astype(float) for f in classifier.FEATURES})
    pdf["is_default"] = (pdf["int_rate"] + rng.uniform(0, 20, n) > 35).astype(int)
    pdf["loan_id"] = [None if i % 50 == 0 else str(i // 2) for i in range(n)]
    feats = session.materialize(spark.createDataFrame(pdf).coalesce(1), "one-part")
    seen, fit = [], Pipeline.fit

    def watched(self, df, *args):
        seen.append(df)
        return fit(self, df, *args)

    monkeypatch.setattr(Pipeline, "fit", watched)
    plain = classifier.train_default_classifier(feats, max_iter=3, max_depth=2)
    monkeypatch.setattr(session, "DEALT_FROM", n - 1, raising=False)
    one = classifier.train_default_classifier(feats, max_iter=3, max_depth=2)
    parts = [sorted(r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()) for df in seen]
    assert max(parts[0]) > 0.9 * sum(parts[0])
    assert len(parts[1]) >= 2 * spark.sparkContext.defaultParallelism and max(parts[1]) < 0.2 * n and sum(parts[1]) == sum(parts[0])
    # the same rows, split and scores
    rows = [sorted(df.select("loan_id", "label", *classifier.FEATURES).collect(), key=repr) for df in seen]
    assert rows[0] == rows[1] and plain.metrics.first().n == one.metrics.first().n == n - len(rows[0])
    scores = [[r.probability_default for r in classifier.score_frame(b.model, feats).select(*classifier.FEATURES, "probability_default").orderBy(*classifier.FEATURES).collect()] for b in (plain, one)]
    assert np.allclose(*scores, atol=1e-9)
    # other files of the rows give the same parts in the same order
    other = [[tuple(r) for r in classifier.training_parts(df, 3).withColumn("p", F.spark_partition_id()).collect()] for df in (feats, feats.repartition(5))]
    assert other[0] == other[1]


def test_book_of_one_row_group_is_dealt_and_the_same(spark, tmp_path, monkeypatch):
    import datetime as dt

    from loanscope import session
    from loanscope.plans.book import LoanBook
    day = dt.datetime(1996, 1, 31)
    orders = [(None if i % 61 == 0 else i // 2, None if i % 47 == 0 else i % 90, "FOP"[i % 3] if i % 53 else None,
               None if i % 59 == 0 else 1000.0 + i, day + dt.timedelta(days=i) if i % 43 else None, f"{i % 5}-X") for i in range(900)]
    people = [(None if i % 31 == 0 else i // 2 * 2, i % 25, None if i % 29 == 0 else 10.0 * i, ("BUILDING", "FURNITURE", None)[i % 3]) for i in range(80)]
    spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string") \
        .coalesce(1).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(people, "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    book = LoanBook(spark, str(tmp_path))
    plain = book.loans_with_borrowers()
    monkeypatch.setattr(session, "DEALT_FROM", 899, raising=False)
    dealt = book.dealt_loans_with_borrowers()
    assert sorted(dealt.columns) == sorted(plain.columns)
    rows = [sorted(map(repr, df.select(*plain.columns).collect())) for df in (plain, dealt)]
    assert rows[0] == rows[1] and len(rows[0]) > 300
    parts = [df.groupBy(F.spark_partition_id()).count().count() for df in (plain, dealt)]
    assert parts[0] == 1 and parts[1] >= spark.sparkContext.defaultParallelism


def test_holt_on_a_trend_and_short_series(spark):
    months = [f"{2000 + i // 12}-{i % 12 + 1:02d}" for i in range(36)]
    rows = [(m, 5.0 + 0.1 * i, 2_000_000.0 + 10_000.0 * i) for i, m in enumerate(months)]
    df = spark.createDataFrame(rows, "metric_month string, default_rate double, total_funded_volume double")
    f = forecast.holt_forecast(df).orderBy("step").collect()
    assert len(f) == 12 and f[0].metric_month == "2003-01"
    assert abs(f[0].forecast_default_rate - 8.6) < 0.2  # continues the trend
    assert all(r.default_rate_lower >= 0 for r in f)
    short = df.limit(9)
    assert forecast.holt_forecast(short).count() == 0
    assert forecast.linear_forecast(short).count() == 0
    lin = forecast.linear_forecast(df).orderBy("step").first()
    assert abs(lin.forecast_default_rate - 8.6) < 1e-6


def test_sample_and_split_take_null_keys(spark):
    from loanscope.operators.classifier import sample_rows, split_flag
    df = spark.createDataFrame([(None if i % 3 == 0 else f"L{i}", i % 2) for i in range(90)], "loan_id string, is_default int")
    for n in (1, 10, 45, 80, 200):
        assert sample_rows(df, n).count() == min(n, 90)
    split = split_flag(df)
    assert split.count() == 90 and split.where("split = 'test'").count() == 18


def test_tabled_model_equals_the_model(spark, book):
    from loanscope.operators import classifier, treetable
    from loanscope.session import new_folder
    features = classifier.loan_features(book.loans_with_borrowers()).cache()
    bundle = classifier.train_default_classifier(features, max_iter=7, max_depth=3)
    nodes = treetable.model_nodes(bundle.model)
    assert len({n.tree for n in nodes}) == 7 and max(n.node for n in nodes) > 4
    path = new_folder(spark, "model")
    treetable.save_model(spark, nodes, path)
    loaded = treetable.load_model(spark, path)
    assert loaded == nodes
    want = {r.loan_id: r.probability_default for r in classifier.score_frame(bundle.model, features).collect()}
    got = {r.loan_id: r.probability_default for r in treetable.score_table(loaded, features).collect()}
    assert want.keys() == got.keys() and len(set(want.values())) > 5
    assert max(abs(want[k] - got[k]) for k in want) < 1e-12
    # requests with missing fields, and in SQL
    asked = book.loans_with_borrowers().select("loan_id", "int_rate", "grade")
    a = classifier.score_loans(bundle.model, asked).select("loan_id", "default_probability_pct", "risk_tier").collect()
    b = treetable.score_loans(loaded, asked).select("loan_id", "default_probability_pct", "risk_tier").collect()
    assert sorted(a) == sorted(b)
    features.createOrReplaceTempView("tabled_features")
    s = spark.sql(f"SELECT loan_id, 1 / (1 + exp(-2 * {treetable.margin_sql(loaded)})) AS p FROM tabled_features").collect()
    assert all(abs(r.p - want[r.loan_id]) < 1e-12 for r in s)


def test_tabled_model_of_many_trees_runs(spark):
    from loanscope.operators import treetable
    nodes = [n._replace(tree=n.tree + 3 * k) for k in range(60) for n in treetable.SMALL_MODEL]
    df = spark.range(50).selectExpr("CAST(id AS double) AS int_rate", "600.0D + id AS fico_range_low", "id * 1.0D AS dti", "10.0D + id / 20 AS annual_inc",
                                    "id % 2 * 1.0D AS is_unverified", "36.0D + id % 3 * 12 AS term_months")
    one = {r.int_rate: r.m for r in df.selectExpr("int_rate", f"{treetable.margin_sql(treetable.SMALL_MODEL)} AS m").collect()}
    for r in df.selectExpr("int_rate", f"{treetable.margin_sql(nodes)} AS m").collect():
        assert abs(r.m - 60 * one[r.int_rate]) < 1e-9


def test_gini_gain_equals_the_definition(spark):
    from fractions import Fraction

    from loanscope.operators import drivers
    rows = [(float(i % 4 == 0 or i % 7 == 3), *[None if (i + j) % 13 == 0 else float((i * (j + 3)) % (5 + 11 * j)) / 4 for j in range(10)]) for i in range(300)]
    frame = spark.createDataFrame(rows, "is_default double, " + ", ".join(f"{c} double" for c in drivers.DRIVER_FEATURES))
    got = {r.driver_key: r for r in drivers.driver_gini(frame).collect()}
    want = {}
    for j, c in enumerate(drivers.DRIVER_FEATURES):
        cents = [None if r[j + 1] is None else round(r[j + 1] * 100) for r in rows]
        known = [x for x in cents if x is not None]
        lo, hi = min(known), max(known)
        bins = {}
        for x, r in zip(cents, rows):
            bins.setdefault(-1 if x is None else (x - lo) * 32 // (hi - lo + 1), []).append(r[0])
        impurity = lambda ys: 1 - sum(Fraction(ys.count(v), len(ys)) ** 2 for v in (0.0, 1.0))
        want[c] = impurity([r[0] for r in rows]) - sum(Fraction(len(b), len(rows)) * impurity(b) for b in bins.values())
    for c, w in want.items():
        assert abs(float(got[c].gini_gain) - float(w)) < 1e-7
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1]["rank"])] == sorted(want, key=lambda c: (-got[c].gini_gain, c))
    assert abs(sum(float(r.gini_share_pct) for r in got.values()) - 100) < 0.1
