"""The loan book: borrowers, loans and payments built from the driver tables.

The driver supplies TPC-H-like tables, so the reference's three normalised
tables are derived from them with fixed integer/decimal rules:

* ``loans``      - one row per ``orders`` row (narrow projection, no shuffle)
* ``borrowers``  - one row per ``customer`` row (narrow projection)
* ``payments``   - loans that have line items, with the returned-line value
                   ``r`` pre-aggregated per order (partial aggregation before
                   the shuffle, then a join on the order key)

Joins use the long keys ``loan_key`` / ``borrower_key``; the string ids of the
reference model (``loan_id``, ``borrower_id``) are carried as columns.

Scale notes: the lineitem aggregate and the orders side are both hash
partitioned on the order key, so the loans-payments join reuses the
aggregate's shuffle. The borrower join is a sort-merge join on the customer
key (AQE may turn it into a broadcast when the runtime size is small, and
splits a skewed customer partition when one customer holds many loans).
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import exprs as X
from ..session import dealt, many_rows, table_path
from ..sources.driver import scan
from ..sources.store import Store

D = lambda s: F.lit(Decimal(s))  # noqa: E731  exact decimal literal

# --------------------------------------------------------------------------
# Fixed values of the driver-table mapping.
# --------------------------------------------------------------------------
GRADE_LETTERS = "ABCDEFG"
# State code per nation key.
STATE_CODES = ["CA", "NY", "TX", "FL", "IL", "PA", "OH", "GA", "NC", "MI", "NJ", "VA", "WA",
               "AZ", "MA", "TN", "IN", "MO", "MD", "WI", "CO", "MN", "SC", "AL", "LA"]
CREDIT_POLICY_CO = "Does not meet the credit policy. Status:Charged Off"
# Columns of the three tables.
LOAN_COLUMNS = [
    "loan_id", "borrower_id", "issue_date", "issue_month", "issue_year",
    "loan_amnt", "funded_amnt", "funded_amnt_inv", "term", "int_rate",
    "installment", "grade", "sub_grade", "purpose", "loan_status",
    "is_default", "is_delinquent", "is_fully_funded",
]
BORROWER_COLUMNS = [
    "borrower_id", "emp_length", "home_ownership", "annual_inc",
    "verification_status", "addr_state", "dti", "fico_range_low",
    "fico_range_high", "open_acc", "revol_bal", "revol_util", "total_acc",
]
PAYMENT_COLUMNS = [
    "loan_id", "total_pymnt", "total_rec_prncp", "total_rec_int",
    "total_rec_late_fee", "recoveries", "collection_recovery_fee",
    "last_pymnt_d", "last_pymnt_amnt", "charged_off_principal",
]
# --------------------------------------------------------------------------


def _loans_from_orders(orders: DataFrame, keep=()) -> DataFrame:
    k, b = F.col("o_orderkey"), F.col("o_custkey")
    loan_amnt = F.col("o_totalprice").cast(X.MONEY)
    factor = (F.when(k % 40 == 0, D("0.10")).when(k % 40 == 1, D("0.96"))
              .otherwise(D("1.00")))
    term_n = F.when(k % 3 == 0, F.lit(60)).otherwise(F.lit(36))
    grade = F.substr(F.lit(GRADE_LETTERS), (b % 7 + 1).cast("int"), F.lit(1))
    year = F.year("o_orderdate")
    defaulted = ((k * 31 + b * 17) % 100) < (3 + 3 * (b % 7) + F.when(year <= 1997, 12).otherwise(0))
    p_status = (F.when(k % 4 == 0, "Late (31-120 days)").when(k % 4 == 1, "Late (16-30 days)")
                .when(k % 4 == 2, "In Grace Period").otherwise("Fully Paid"))
    status = (F.when(defaulted, F.when(k % 20 == 0, "Default")
                     .when(k % 20 == 1, CREDIT_POLICY_CO).otherwise("Charged Off"))
              .when(F.col("o_orderstatus") == "F", "Fully Paid")
              .when(F.col("o_orderstatus") == "O", "Current")
              .when(F.col("o_orderstatus") == "P", p_status))
    df = orders.select(
        k.alias("loan_key"), b.alias("borrower_key"),
        k.cast("string").alias("loan_id"), b.cast("string").alias("borrower_id"),
        F.date_trunc("month", "o_orderdate").cast("date").alias("issue_date"),
        year.cast("int").alias("issue_year"),
        loan_amnt.alias("loan_amnt"),
        X.round_money(loan_amnt * factor).alias("funded_amnt"),
        term_n.alias("term_months"),
        (D("5.50") + D("2.50") * (b % 7) + D("0.01") * (k % 100)).cast("decimal(6,2)").alias("int_rate"),
        grade.alias("grade"),
        F.concat(grade, (k % 5 + 1).cast("string")).alias("sub_grade"),
        F.lower("o_orderpriority").alias("purpose"),
        X.clean_status(status).alias("loan_status"),
        *[F.col(c) for c in keep],
    )
    return df.select(
        "*",
        F.date_format("issue_date", "yyyy-MM").alias("issue_month"),
        F.col("funded_amnt").alias("funded_amnt_inv"),
        F.concat(F.col("term_months").cast("string"), F.lit(" months")).alias("term"),
        F.round(X.annuity(F.col("loan_amnt"), F.col("int_rate"), F.col("term_months")), 2).alias("installment"),
        X.default_flag(F.col("loan_status")).alias("is_default"),
        X.delinquent_flag(F.col("loan_status")).alias("is_delinquent"),
        X.fully_funded_flag(F.col("funded_amnt"), F.col("loan_amnt")).alias("is_fully_funded"),
    )


def _borrower_columns() -> list[Column]:
    """The borrowers columns from customer columns, without the keys."""
    c = F.col("c_custkey")
    acct = F.col("c_acctbal").cast(X.MONEY)
    open_acc = (c % 30 + 1).cast("int")
    fico = (740 - F.when(c % 7 == 0, 0).otherwise(10 + 30 * (c % 7))).cast("int")
    seg = F.col("c_mktsegment")
    return [
        F.concat((c % 11).cast("string"), F.lit(" years")).alias("emp_length"),
        (F.when(seg == "BUILDING", "OWN").when(seg.isin("HOUSEHOLD", "FURNITURE"), "MORTGAGE")
         .otherwise("RENT")).alias("home_ownership"),
        (D("21000.00") + acct * 10).cast(X.MONEY).alias("annual_inc"),
        (F.when(c % 5 < 2, "Not Verified").when(c % 5 < 4, "Verified")
         .otherwise("Source Verified")).alias("verification_status"),
        F.element_at(X.lit_array(STATE_CODES, "string"), F.col("c_nationkey").cast("int") + 1).alias("addr_state"),
        ((c * 13) % 5000 * D("0.01")).cast("decimal(6,2)").alias("dti"),
        fico.alias("fico_range_low"),
        (fico + 4).alias("fico_range_high"),
        open_acc.alias("open_acc"),
        acct.alias("revol_bal"),
        ((c * 29) % 1200 * D("0.1")).cast("decimal(6,1)").alias("revol_util"),
        (open_acc + c % 20).cast("int").alias("total_acc"),
    ]


def _borrowers_from_customers(customer: DataFrame) -> DataFrame:
    c = F.col("c_custkey")
    return customer.select(c.alias("borrower_key"), c.cast("string").alias("borrower_id"), *_borrower_columns())


def _returned_value_per_order(lineitem: DataFrame) -> DataFrame:
    """Sum of returned-line value per order; one row per order with lines."""
    price = F.col("l_extendedprice").cast(X.MONEY)
    return (lineitem.groupBy(F.col("l_orderkey").alias("loan_key"))
            .agg(F.sum(F.when(F.col("l_returnflag") == "R", price)
                       .otherwise(F.lit(0).cast(X.MONEY))).alias("_returned")))


def _with_payment_columns(df: DataFrame) -> DataFrame:
    """Add the payments columns given funded_amnt, loan_status, is_default, _returned."""
    dflt = F.col("is_default") == 1
    funded = F.col("funded_amnt")
    zero = F.lit(0).cast(X.MONEY)
    prncp = (F.when(dflt, X.round_money(funded * D("0.40")))
             .when(F.col("loan_status") == "Fully Paid", funded)
             .otherwise(X.round_money(funded * D("0.70"))))
    r = F.col("_returned")
    df = df.withColumns({
        "total_rec_prncp": prncp.cast(X.MONEY),
        "recoveries": F.when(dflt, X.round_money(r * D("0.15"))).otherwise(zero),
        "collection_recovery_fee": F.when(dflt, X.round_money(r * D("0.15") * D("0.18"))).otherwise(zero),
    })
    return df.withColumns({
        "charged_off_principal": X.charged_off_principal(F.col("is_default"), funded, F.col("total_rec_prncp")),
        "total_rec_int": X.round_money(F.col("total_rec_prncp") * D("0.12")),
        "total_rec_late_fee": zero,
        "last_pymnt_amnt": zero,
        "last_pymnt_d": F.lit(None).cast("string"),
    }).withColumn(
        "total_pymnt", (F.col("total_rec_prncp") + F.col("total_rec_int") + F.col("recoveries")).cast(X.MONEY))


class LoanBook:
    """Lazy handles on the three tables plus the joined book.

    The DataFrames are logical plans (no data is cached); each is built once
    per book and reused, since building a plan costs driver round trips.
    """

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._plans: dict[str, DataFrame] = {}

    def _memo(self, name: str, build) -> DataFrame:
        if name not in self._plans:
            self._plans[name] = build()
        return self._plans[name]

    def loans(self) -> DataFrame:
        return self._memo("loans", lambda: _loans_from_orders(scan(self.spark, self.sf_dir, "orders")))

    def borrowers(self) -> DataFrame:
        return self._memo("borrowers", lambda: _borrowers_from_customers(scan(self.spark, self.sf_dir, "customer")))

    def _orders_with_lines(self) -> DataFrame:
        """Raw order columns and ``_returned`` of the orders that have lines."""
        ret = _returned_value_per_order(scan(self.spark, self.sf_dir, "lineitem"))
        orders = scan(self.spark, self.sf_dir, "orders")
        # One row per order on both sides: it grows with the data, so never broadcast it.
        return orders.join(ret.hint("merge"), orders["o_orderkey"] == ret["loan_key"], "inner").drop("loan_key")

    def loans_with_payments(self) -> DataFrame:
        """Loans inner-joined with their payments (orders without lines drop out)."""
        # Join the raw order columns first and derive the loan columns after the join:
        # the shuffle moves 5 raw columns, and the derivation runs in the join's tasks.
        return self._memo("loans_with_payments", lambda: _with_payment_columns(
            _loans_from_orders(self._orders_with_lines(), keep=["_returned"])))

    def payments(self) -> DataFrame:
        return self._memo("payments", lambda: self.loans_with_payments().select("loan_key", *PAYMENT_COLUMNS))

    def loans_with_borrowers(self) -> DataFrame:
        return self._memo("loans_with_borrowers", lambda: self.loans().join(
            self.borrowers().drop("borrower_id"), "borrower_key", "inner"))

    def dealt_loans_with_borrowers(self) -> DataFrame:
        """:meth:`loans_with_borrowers` for work on each row; of many orders the raw rows are dealt evenly and joined first."""
        orders, customer = scan(self.spark, self.sf_dir, "orders"), scan(self.spark, self.sf_dir, "customer")
        if not many_rows(orders):
            return self.loans_with_borrowers()
        raw = dealt(orders).join(customer, orders["o_custkey"] == customer["c_custkey"], "inner")
        return _loans_from_orders(raw, keep=customer.columns).select("*", *_borrower_columns()).drop(*customer.columns)

    def book(self) -> DataFrame:
        """The three-way join (JN3): loans x borrowers x payments."""
        return self._memo("book", lambda: self.loans_with_payments().join(
            self.borrowers().drop("borrower_id"), "borrower_key", "inner"))

    def dealt_book(self, deal=lambda raw: raw) -> DataFrame:
        """:meth:`book` with ``deal`` done on its raw columns: what moves or sorts rows (by ``o_orderkey``,
        say) then handles a dozen short columns, and the book's columns are derived in the tasks behind it."""
        customer = scan(self.spark, self.sf_dir, "customer")
        j = self._orders_with_lines()
        raw = deal(j.join(customer, j["o_custkey"] == customer["c_custkey"], "inner"))
        kept = _loans_from_orders(raw, keep=["_returned", *customer.columns])
        return _with_payment_columns(kept).select("*", *_borrower_columns()).drop("_returned", *customer.columns)

    def inputs(self) -> list[str]:
        return [table_path(self.sf_dir, t) for t in ("orders", "customer", "lineitem")]

    def kept_book(self) -> DataFrame:
        """:meth:`book` as a written table that all reports of the same input files read (SRC5)."""
        return Store(self.spark).table("book", self.inputs(), self.book)


_BOOKS: dict[tuple, LoanBook] = {}


def loan_book(spark: SparkSession, sf_dir: str) -> LoanBook:
    """The loan book over the driver tables in ``sf_dir`` (one per session and folder)."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir)
    if key not in _BOOKS:
        _BOOKS[key] = LoanBook(spark, sf_dir)
    return _BOOKS[key]


def raw_text_rows(book: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The book rendered as raw loan-file text, with the decorations real files carry.

    Amounts as ``$12,345.67``, rates as ``13.50%``, dates as ``Mar-1995``,
    mixed case and padding, recoded verification text and some blank cells,
    chosen by fixed rules on the loan key, so the ETL has real cleaning work.
    """
    k = F.col("loan_key")
    s = lambda c: F.col(c).cast("string")
    blank = F.lit("")
    return book.select(
        F.concat(F.lit("L"), s("loan_id")).alias("id"),
        F.concat(F.lit("$"), F.format_number("loan_amnt", 2)).alias("loan_amnt"),
        s("funded_amnt").alias("funded_amnt"),
        F.when(k % 7 == 0, blank).otherwise(s("funded_amnt_inv")).alias("funded_amnt_inv"),
        F.concat(F.lit(" "), F.col("term")).alias("term"),
        F.concat(s("int_rate"), F.lit("%")).alias("int_rate"),
        s("installment").alias("installment"),
        F.when(k % 2 == 0, F.lower("grade")).otherwise(F.col("grade")).alias("grade"),
        F.when(k % 9 == 0, blank).otherwise(F.col("sub_grade")).alias("sub_grade"),
        F.col("emp_length"),
        F.lower("home_ownership").alias("home_ownership"),
        s("annual_inc").alias("annual_inc"),
        F.when((F.col("verification_status") == "Verified") & (k % 2 == 0), F.lit("VERIFIED - income"))
        .otherwise(F.col("verification_status")).alias("verification_status"),
        F.date_format("issue_date", "MMM-yyyy").alias("issue_d"),
        F.concat(F.lit(" "), F.col("loan_status"), F.lit(" ")).alias("loan_status"),
        F.upper("purpose").alias("purpose"),
        F.lower("addr_state").alias("addr_state"),
        s("dti").alias("dti"),
        s("open_acc").alias("open_acc"),
        s("revol_bal").alias("revol_bal"),
        F.concat(s("revol_util"), F.lit("%")).alias("revol_util"),
        s("total_acc").alias("total_acc"),
        s("total_pymnt").alias("total_pymnt"),
        s("total_rec_prncp").alias("total_rec_prncp"),
        s("total_rec_int").alias("total_rec_int"),
        s("total_rec_late_fee").alias("total_rec_late_fee"),
        s("recoveries").alias("recoveries"),
        s("collection_recovery_fee").alias("collection_recovery_fee"),
        blank.alias("last_pymnt_d"),
        s("last_pymnt_amnt").alias("last_pymnt_amnt"),
        *(keep or []),
    )


def dirty_raw_rows(book: DataFrame) -> DataFrame:
    """:func:`raw_text_rows` with the faults of real files, by fixed rules on the loan key.

    Unreadable amounts (13th), missing issue dates (17th), a month that is none (19th),
    missing ids (23rd), and on every 29th a supplied FICO. ``_pos`` is the row's place.
    """
    k = F.col("loan_key")
    raw = raw_text_rows(book.withColumn("_pos", k), keep=["_pos"])
    at = F.col("_pos")
    return raw.withColumns({
        "loan_amnt": F.when(at % 13 == 0, F.lit("n/a")).otherwise(F.col("loan_amnt")),
        "issue_d": F.when(at % 17 == 0, F.lit("")).when(at % 19 == 0, F.lit("Xyz-1999")).otherwise(F.col("issue_d")),
        "id": F.when(at % 23 == 0, F.lit("")).otherwise(F.col("id")),
        "fico_range_low": F.when(at % 29 == 0, F.lit("705")).otherwise(F.lit("")),
    })
