"""Bucketed tables: no exchange in the three-way join, same book, hot borrowers over several buckets."""
import glob

from pyspark.sql import functions as F

from loanscope.plans import buckets
from loanscope.plans.book import LoanBook

SF = "/root/testdata/sf0.001"


def test_three_way_join_has_no_exchange_and_equals_the_book(spark):
    book = LoanBook(spark, SF)
    got = buckets.bucketed_book(book, 4)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and plan.count("SortMergeJoin") == 2 and "SelectedBucketsCount" in plan
    columns = [c for c in book.book().columns if c in got.columns]
    assert {"loan_id", "funded_amnt", "addr_state", "recoveries", "verification_status"} <= set(columns)
    a, b = (df.select(*columns).collect() for df in (got, book.book()))
    assert sorted(map(str, a)) == sorted(map(str, b)) and len(a) > 1000
    # the second call reads the written tables; the caller's settings are untouched
    assert buckets.bucketed_book(book, 4).inputFiles() == got.inputFiles()
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


class HotBook(LoanBook):
    """Every other loan belongs to borrower 1."""

    def _hot(self, df):
        return df.withColumn("borrower_key", F.when(F.col("loan_key") % 2 == 0, F.lit(1).cast("long")).otherwise(F.col("borrower_key")))

    def loans(self):
        return self._hot(super().loans())

    def loans_with_payments(self):
        return self._hot(super().loans_with_payments())


def test_a_hot_borrower_is_dealt_over_buckets(spark):
    book, n = HotBook(spark, SF), 8
    names = {t: f"hot_{t}" for t in buckets.TABLES}
    from loanscope.session import new_folder
    folder = new_folder(spark, "hot-buckets")
    buckets.write_bucketed(book, names, n, folder)
    assert len(glob.glob(f"{folder.removeprefix('file://')}/loans/*.parquet")) <= n
    loans = spark.table("hot_loans")
    total = loans.count()
    per = [r["count"] for r in loans.groupBy(F.pmod(F.hash(*buckets.KEYS), F.lit(n))).count().collect()]
    assert total == book.loans().count() and max(per) < total / 3  # one bucket would hold more than half of all
    assert spark.table("hot_borrowers").where("borrower_key = 1").count() > 4
    got = buckets.joined(spark, names)
    want = book.loans_with_payments().join(book.borrowers().drop("borrower_id"), "borrower_key")
    columns = ["loan_key", "borrower_key", "funded_amnt", "recoveries", "addr_state"]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
