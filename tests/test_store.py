"""The keyed store: found again, renewed by changed inputs and expiry, old folders removed."""
import glob
import os
import tempfile
import time

import pytest
from pyspark.sql import functions as F

from loanscope.operators import validate
from loanscope.plans.catalog import QUERIES
from loanscope.sources.store import Store, inputs_digest

SF = "/root/testdata/sf0.001"


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="loanscope-store-")


def table(spark, path, n):
    spark.range(n).write.mode("overwrite").parquet(path)
    return path


def test_results_are_found_again_until_inputs_change(spark, folder):
    path, built = table(spark, f"{folder}/in", 10), []

    def build():
        return spark.read.parquet(path).select((F.col("id") * 2).alias("x"))

    def kept(store):
        before = set(glob.glob(f"{folder}/store/double/*/*"))
        df = store.table("double", [path], build)
        built.append(len(set(glob.glob(f"{folder}/store/double/*/*")) - before))
        return df

    first = kept(Store(spark, folder))
    assert kept(Store(spark.newSession(), folder)).inputFiles() == first.inputFiles()  # another session
    assert built == [1, 0] and first.agg(F.sum("x")).first()[0] == 90
    table(spark, path, 11)  # same name, other files
    assert kept(Store(spark, folder)).agg(F.sum("x")).first()[0] == 110
    kept(Store(spark, folder, expiry=0))  # expired at once
    assert built == [1, 0, 1, 1]


def test_touched_and_added_files_change_the_digest(spark, folder):
    path = table(spark, f"{folder}/in", 10)
    told = inputs_digest(spark, [path])
    assert inputs_digest(spark, [path]) == told
    part = sorted(glob.glob(f"{path}/part-*.parquet"))[0]
    os.utime(part, (time.time() + 5, time.time() + 5))
    assert inputs_digest(spark, [path]) != told
    told = inputs_digest(spark, [path])
    spark.range(1).write.mode("append").parquet(path)
    assert inputs_digest(spark, [path]) != told


def test_broken_writes_do_not_count_and_old_folders_go(spark, folder):
    path = table(spark, f"{folder}/in", 10)
    build = lambda: spark.read.parquet(path)
    Store(spark, folder).table("t", [path], build)
    (kept,) = glob.glob(f"{folder}/store/t/*/*")
    os.remove(f"{kept}/_SUCCESS")
    assert Store(spark, folder).table("t", [path], build).count() == 10
    assert len(glob.glob(f"{folder}/store/t/*/*")) == 2
    # past removal: both go when the next result of that name is written
    time.sleep(0.05)
    assert Store(spark, folder, expiry=0, removal=0.01).table("t", [path], build).count() == 10
    assert len(glob.glob(f"{folder}/store/t/*/*")) == 1 and not os.path.exists(kept)


def test_reports_read_one_written_book(spark):
    files = set()
    for name in ("monthly_trends", "star_report_full", "crisis_analysis"):
        inputs = [f for f in QUERIES[name](spark, SF).inputFiles() if "/store/book/" in f]
        assert inputs and not any("lineitem" in f for f in QUERIES[name](spark, SF).inputFiles())
        files.add(os.path.dirname(inputs[0]))
    assert len(files) == 1


def test_key_audit_counts_duplicates_orphans_and_nulls(spark):
    loans = spark.createDataFrame([(1, 10), (1, 10), (2, 11), (3, None), (None, 99), (None, 10)], "loan_key long, borrower_key long")
    borrowers = spark.createDataFrame([(10,), (11,), (11,), (12,)], "borrower_key long")
    payments = spark.createDataFrame([(1,), (2,), (2,), (7,), (None,)], "loan_key long")
    got = validate.key_audit(loans, borrowers, payments, "loan_key", "borrower_key")
    assert got.first().asDict() == {"dl": 2, "db": 1, "dp": 1, "ol": 2, "op": 2}
    text = [d.select(*[F.col(c).cast("string").alias(c) for c in d.columns]) for d in (loans, borrowers, payments)]
    assert validate.key_audit(*text, "loan_key", "borrower_key").first() == got.first()
    # the same from one anti-join and one grouping per key
    for df, key, want in ((loans, "loan_key", "dl"), (borrowers, "borrower_key", "db"), (payments, "loan_key", "dp")):
        assert validate.duplicate_keys(df, key).first().v == got.first()[want]
    assert validate.missing_parents(loans, "borrower_key", borrowers, "borrower_key").first().v == got.first().ol
    assert validate.missing_parents(payments, "loan_key", loans, "loan_key").first().v == got.first().op
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning") == 1
