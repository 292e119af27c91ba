"""The rollup by batches equals the rollup computed at once; only touched months are written."""
import glob
import os

from pyspark.sql import functions as F

from loanscope.operators import increments, kpis
from loanscope.session import new_folder
from loanscope.sources.sinks import write_rollup


def rollup(df, **kw):
    return sorted(map(str, df.orderBy("metric_month").collect()))


def files_of(path):
    return {m: sorted(os.path.basename(f) for f in glob.glob(f"{path}/metric_month={m}/*.parquet"))
            for m in (d.split("=")[1] for d in glob.glob(f"{path}/metric_month=*"))}


def test_batches_add_up_and_touch_only_their_months(spark, book):
    rows = book.book().cache()
    sums, table = new_folder(spark, "sums"), new_folder(spark, "rollup")
    late = (F.col("issue_month").between("1996-03", "1996-05")) & (F.col("loan_key") % 3 == 0)
    want = rollup(kpis.monthly_kpi_rollup(rows, exact=True))
    increments.start_sums(rows.where(~late), sums)
    before = files_of(sums)
    assert increments.update_rollup(spark, sums, table, rows.where(late), "late") == ["1996-03", "1996-04", "1996-05"]
    assert rollup(spark.read.parquet(table)) == want
    after = files_of(sums)
    assert {m for m in after if after[m] != before.get(m)} == {"1996-03", "1996-04", "1996-05"}
    # again: nothing changes
    increments.update_rollup(spark, sums, table, rows.where(late), "late")
    assert rollup(spark.read.parquet(table)) == want
    # the batch is corrected and leaves a month
    fewer = late & (F.col("issue_month") != "1996-04")
    assert increments.update_rollup(spark, sums, table, rows.where(fewer), "late") == ["1996-03", "1996-04", "1996-05"]
    assert rollup(spark.read.parquet(table)) == rollup(kpis.monthly_kpi_rollup(rows.where(~late | fewer), exact=True))


def test_a_month_that_only_a_withdrawn_batch_had_is_gone(spark, book):
    rows, sums = book.book(), new_folder(spark, "sums")
    base = F.col("issue_month") < "1997-01"
    increments.start_sums(rows.where(base), sums)
    increments.apply_batch(spark, sums, rows.where(F.col("issue_month") == "1997-02"), "b")
    increments.apply_batch(spark, sums, rows.where("false"), "b")
    got = increments.rollup_of(increments.read_sums(spark, sums), exact=True)
    assert rollup(got) == rollup(kpis.monthly_kpi_rollup(rows.where(base), exact=True))
    # by state from the same sums, as a column and as a filter
    by_state = increments.rollup_of(increments.read_sums(spark, sums), "addr_state", exact=True)
    assert sorted(map(str, by_state.collect())) == sorted(map(str, kpis.monthly_kpi_rollup(rows.where(base), "addr_state", exact=True).collect()))
    only = increments.read_sums(spark, sums).where("addr_state = 'CA'")
    assert rollup(increments.rollup_of(only, exact=True)) == rollup(kpis.monthly_kpi_rollup(rows.where(base & (F.col("addr_state") == "CA")), exact=True))


def test_sketches_merge_over_months_states_and_batches(spark):
    n = 40_000
    loans = spark.range(n * 3).select(
        F.col("id").alias("loan_key"), F.col("id").cast("string").alias("loan_id"), (F.col("id") % n).alias("borrower_key"),
        F.concat(F.lit("2001-0"), (F.col("id") % 7 + 1).cast("string")).alias("issue_month"), F.concat(F.lit("S"), (F.col("id") % 5).cast("string")).alias("addr_state"),
        *[F.lit(1).cast("decimal(18,2)").alias(c) for c in ("loan_amnt", "funded_amnt", "int_rate", "charged_off_principal", "recoveries", "collection_recovery_fee")],
        F.lit(0).alias("is_default"), F.lit(0).alias("is_delinquent"), F.lit("Verified").alias("verification_status"))
    path = new_folder(spark, "sums")
    increments.start_sums(loans.where("loan_key < 60000"), path)
    increments.apply_batch(spark, path, loans.where("loan_key >= 60000"), "late")
    sums = increments.read_sums(spark, path)
    assert abs(increments.borrowers_of(sums, []).first()[0] / n - 1) < 0.065
    exact = {r[0]: r[1] for r in loans.groupBy("addr_state").agg(F.countDistinct("borrower_key")).collect()}
    for r in increments.borrowers_of(sums, ["addr_state"]).collect():
        assert abs(r.borrowers / exact[r.addr_state] - 1) < 0.065


def test_write_rollup_replaces(spark, book):
    path = new_folder(spark, "rollup")
    for df in (book.book(), book.book().where("addr_state = 'CA'")):
        want = kpis.monthly_kpi_rollup(df, exact=True)
        write_rollup(want, path)
        assert rollup(spark.read.parquet(path)) == rollup(want)
