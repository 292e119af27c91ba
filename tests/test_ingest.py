import os
import tempfile

from pyspark.sql import functions as F

from loanscope.plans.etl import dense_row_index, etl
from loanscope.sources.raw import TARGET_COLUMNS, file_lines, peek_headers, raw_layouts, read_merged, read_raw_loans, write_merged

FILE_A = '''Notes offered by Prospectus (preamble line)
"id","member_id","loan_amnt","funded_amnt","term","int_rate","grade","sub_grade","issue_d","loan_status","addr_state","verification_status","dti","revol_util","total_rec_prncp","home_ownership","purpose"
"101","9","$1,000","1000"," 36 months"," 13.5%","b","B2","Dec-2011","Fully Paid","ca","Verified","12.5%","45%","1000","rent","Car"
"102","9","abc","1000"," 36 months","10%","A","A1","Dec-2011","Fully Paid","NY","Verified","1","1","0","OWN","car"
"103","9","2500","","60 months","11%","C","","Nov-2011","Charged Off","TX","VERIFIED - income","3","2","500","MORTGAGE","other"
"104","9","2500","2500","60 months","11%","C","C1","2011-11-01","Charged Off","TX","Verified","3","2","500","MORTGAGE","other"
"0","9","3000","2900","36 months","9%","A","A3","Jan-2012","Late (16-30 days)","FL","Not Verified","3","2","100","OWN","car"
"","9","4000","4000","36 months","9%","A","A3","Feb-2012","Current","FL","Not Verified","3","2","100","OWN","car"
"short","row"
'''
FILE_B = '''loan_amnt,id,int_rate,issue_d,loan_status,grade,term,funded_amnt,recoveries
"5,000",201,7.5%,Mar-2015,Default,E,36 months,4000,"12.5"
6000,202,8%,Apr-2015,"Does not meet the credit policy. Status:Charged Off",F,60 months,6000,0
'''


def write(tmp, name, text):
    p = os.path.join(tmp, name)
    with open(p, "w") as f:
        f.write(text)
    return p


def test_read_align_validate_and_etl(spark):
    tmp = tempfile.mkdtemp(prefix="loanscope-ingest-")
    a, b = write(tmp, "a.csv", FILE_A), write(tmp, "b.csv", FILE_B)
    raw = read_raw_loans(spark, [a, b])
    assert raw.columns == TARGET_COLUMNS
    ids = sorted(r.id for r in raw.collect())
    # bad amount (102), bad issue_d form (104), short row and header/preamble lines are dropped
    assert ids == ["", "0", "101", "103", "201", "202"]
    r101 = raw.where(F.col("id") == "101").first()
    assert (r101.loan_amnt, r101.int_rate, r101.dti, r101.revol_util) == ("1000", "13.5", "12.5", "45")
    # merged file round trip (SNK5 / SRC2)
    out = os.path.join(tmp, "merged")
    write_merged(raw, out)
    assert read_merged(spark, out).count() == 6

    t = etl(raw, order_by=["issue_d", "loan_amnt"])
    w = {r.loan_id: r for r in t.wide.collect()}
    assert len(w) == 6
    assert w["101"].grade == "B" and w["101"].fico_range_low == 660.0  # lower-case raw grade -> proxy 660
    assert w["201"].fico_range_low == 610.0 and w["201"].fico_range_high == 614.0
    assert w["103"].funded_amnt == 2500.0 and w["103"].sub_grade == "C1" and w["103"].verification_status == "Verified"
    assert w["101"].addr_state == "CA" and w["101"].home_ownership == "RENT" and w["101"].purpose == "car"
    assert w["201"].addr_state == "CA" and w["201"].purpose == "debt_consolidation" and w["201"].emp_length == "n/a"
    assert w["201"].is_default == 1 and w["201"].charged_off_principal == 4000.0
    assert w["202"].is_default == 1 and w["202"].is_delinquent == 0
    assert w["101"].issue_month == "2011-12" and w["201"].issue_year == 2015
    ln = sorted(k for k in w if k.startswith("LN_"))
    assert len(ln) == 2  # ids "0" and "" are replaced by position ids
    brw = sorted(r.borrower_id for r in t.borrowers.collect())
    assert brw == [f"BRW_{i:07d}" for i in range(1, 7)]
    assert t.loans.count() == 6 and t.payments.count() == 6


def test_dense_row_index_is_dense_over_partitions(spark):
    df = spark.range(0, 1000, numPartitions=7)
    got = [(r.id, r.row_no) for r in dense_row_index(df.repartition(5), ["id"]).orderBy("id").collect()]
    assert got == [(i, i + 1) for i in range(1000)]


QUOTED = '''id,loan_amnt,funded_amnt,term,int_rate,issue_d,loan_status,purpose,emp_length
1,1000,1000,36 months,10%,Dec-2011,Fully Paid,"say ""hi"", ok",10+ years
2,2000,2000,36 months,10%,Dec-2011,Current,"a, b","line one
line two"
3,"3,000",3000,36 months,10%,Jan-2012,Current,"plain"," padded "
'''


def test_quoted_cells_survive_reading_and_writing(spark):
    tmp = tempfile.mkdtemp(prefix="loanscope-quotes-")
    raw = read_raw_loans(spark, write(tmp, "q.csv", QUOTED), multiline=True)
    got = {r.id: r for r in raw.collect()}
    assert sorted(got) == ["1", "2", "3"]
    assert got["1"].purpose == 'say "hi", ok' and got["2"].purpose == "a, b" and got["2"].emp_length == "line one\nline two"
    out = os.path.join(tmp, "merged")
    write_merged(raw, out)
    back = {r.id: r for r in read_merged(spark, out, multiline=True).collect()}
    assert {k: (v.purpose, v.emp_length, v.loan_amnt) for k, v in back.items()} == {k: (v.purpose, v.emp_length, v.loan_amnt) for k, v in got.items()}


def test_headers_of_many_files_come_from_one_pass(spark):
    tmp = tempfile.mkdtemp(prefix="loanscope-many-")
    paths = [write(tmp, f"f {i}.csv", FILE_B if i % 2 else FILE_A) for i in range(6)] + [write(tmp, "empty.csv", "")]
    assert read_raw_loans(spark, paths).count() == 3 * 4 + 3 * 2
    assert len(peek_headers(spark, paths)) == 6
    assert read_raw_loans(spark, paths[-1]).collect() == []


def test_hashed_ids_need_no_order(spark):
    tmp = tempfile.mkdtemp(prefix="loanscope-hash-")
    t = etl(read_raw_loans(spark, write(tmp, "a.csv", FILE_A)))
    a, b = ([r.borrower_id for r in t.borrowers.orderBy("borrower_id").collect()] for _ in range(2))
    assert a == b and len(set(a)) == 4 and all(x.startswith("BRW_") and len(x) == 20 for x in a)


def test_supplied_fico_is_kept(spark):
    from loanscope.plans.etl import clean_loans
    raw = spark.createDataFrame([("1", "A", "701"), ("2", "A", ""), ("3", "B", "x"), ("4", "Z", None)], "id string, grade string, fico_range_low string")
    full = raw.selectExpr("*", *[f"CAST(NULL AS string) AS {c}" for c in TARGET_COLUMNS if c not in raw.columns and c != "issue_d"], "'Dec-2011' AS issue_d")
    got = {r.loan_id: (r.fico_range_low, r.fico_range_high) for r in clean_loans(full).collect()}
    assert got == {"1": (701.0, 705.0), "2": (740.0, 744.0), "3": (700.0, 704.0), "4": (660.0, 664.0)}


def test_cells_with_line_ends_survive_default_reading(spark):
    tmp = tempfile.mkdtemp(prefix="loanscope-lines-")
    # the second row's line end lies before most of its cells; a preamble and a file without such cells beside it
    broken = '''Notes "as is"
id,purpose,loan_amnt,int_rate,issue_d,addr_state,dti,recoveries
1,car,1000,10%,Dec-2011,NY,1.5,0
2,"two
lines and ""quotes""

end",2000,11%,Dec-2011,TX,2.5,7
3,"x, y",3000,12%,Jan-2012,FL,3.5,0
'''
    paths = [write(tmp, "a.csv", broken), write(tmp, "b.csv", FILE_B)]
    layouts = {x.paths[0][-5:]: x.multiline for x in raw_layouts(spark, paths)}
    assert layouts == {"a.csv": True, "b.csv": False}
    raw = read_raw_loans(spark, paths)
    got = {r.id: (r.purpose, r.loan_amnt, r.addr_state, r.dti, r.recoveries) for r in raw.collect()}
    assert got["2"] == ('two\nlines and ""quotes""'.replace('""', '"') + "\n\nend", "2000", "TX", "2.5", "7")
    assert got["1"] == ("car", "1000", "NY", "1.5", "0") and got["3"][0] == "x, y" and set(got) == {"1", "2", "3", "201", "202"}
    out = os.path.join(tmp, "merged")
    write_merged(raw, out)
    # empty cells come back as nulls
    back = {r.id: tuple(c or "" for c in (r.purpose, r.loan_amnt, r.addr_state, r.dti, r.recoveries)) for r in read_merged(spark, out).collect()}
    assert back == got


def test_header_pass_stays_in_the_jvm_and_needs_no_sort(spark):
    tmp = tempfile.mkdtemp(prefix="loanscope-plan-")
    df = file_lines(spark, [write(tmp, f"{i}.csv", FILE_A if i % 2 else FILE_B) for i in range(8)])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "MapInArrow" not in plan and "Sort" not in plan and "ObjectHashAggregate" in plan
    rows = {r.path[-5:]: (r.first, r.second) for r in df.collect()}
    assert rows["1.csv"] == tuple(FILE_A.split("\n")[:2]) and rows["0.csv"] == tuple(FILE_B.split("\n")[:2])


def test_first_two_lines_of_files_of_many_splits(spark):
    tmp = tempfile.mkdtemp(prefix="loanscope-split-")
    body = "".join(f"{i},{1000 + i},10%,Dec-2011,Current,A,36 months,1000,0\n" for i in range(3000))
    paths = [write(tmp, "big.csv", FILE_B.split("\n")[0].replace("loan_amnt,id", "id,loan_amnt") + "\n" + body), write(tmp, "one.csv", "id,loan_amnt"), write(tmp, "b.csv", FILE_B)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        got = {r.path.rsplit("/", 1)[1]: (r.first, r.second) for r in file_lines(spark, paths).collect()}
        assert got["one.csv"] == ("id,loan_amnt", None) and got["b.csv"][0] == FILE_B.split("\n")[0]
        assert got["big.csv"][1] == body.split("\n")[0]
        assert read_raw_loans(spark, paths).count() == 3002
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_positions_in_file_order_move_no_rows(spark):
    from loanscope.plans.etl import FILES, clean_loans, file_row_index
    from loanscope.sources.raw import with_place
    tmp = tempfile.mkdtemp(prefix="loanscope-order-")
    head, n = "id,loan_amnt,int_rate,issue_d,loan_status,grade\n", 4000
    # every fifth row is dropped by the filters; ids of every seventh are missing
    row = lambda k: f"{'' if k % 7 == 0 else f'R{k}'},{1000 + k},10%,{'Dec-2011' if k % 5 else 'x'},Current,{'ABCDEFG'[k % 7]}\n"
    cuts = [0, 700, 701, 2500, n]
    paths = [write(tmp, f"{i}.csv", head + "".join(map(row, range(a, b)))) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    paths.append(write(tmp, "9.csv", head + '9000,7777,10%,Dec-2011,"Cur\nrent",A\n'))
    want = [1000 + k for k in range(n) if k % 5] + [7777]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in ("8192", "134217728"):  # many splits of a file, many files of a task
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            raw = read_raw_loans(spark, paths[::-1], places=True)
            wide = clean_loans(raw, order_by=FILES)
            got = {int(r.borrower_id[4:]): int(r.loan_amnt) for r in wide.select("borrower_id", "loan_amnt").collect()}
            assert got == {i + 1: v for i, v in enumerate(want)}, size
            named = {r.loan_id for r in wide.select("loan_id").collect()}
            assert f"LN_{want.index(1007) + 1:07d}" in named and "R1" in named
            plan = wide._jdf.queryExecution().executedPlan().toString()
            assert "rangepartitioning" not in plan and "SortMergeJoin" not in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    # a Parquet scan, and an empty one
    spark.range(100).repartition(4).write.parquet(f"{tmp}/p")
    index = file_row_index(with_place(spark.read.parquet(f"{tmp}/p")))
    assert sorted(r.row_no for r in index.collect()) == list(range(1, 101)) and index.columns == ["id", "_file", "_start", "row_no"]
    assert file_row_index(with_place(spark.read.parquet(f"{tmp}/p").where("id < 0"))).count() == 0


def test_raw_rows_are_put_in_order_before_they_are_wide(spark, book, monkeypatch):
    from loanscope.plans import catalog
    from loanscope.plans.book import dirty_raw_rows

    class Unwritten:
        def __init__(self, spark):
            pass

        def table(self, name, inputs, build):
            return build()

    monkeypatch.setattr(catalog, "Store", Unwritten)
    raw = catalog._raw_rows(spark, book.sf_dir)
    plan = raw._jdf.queryExecution().optimizedPlan().toString()
    assert "format_number" in plan and "format_number" not in plan[plan.index("RepartitionByExpression"):]
    assert [r["_pos"] for r in raw.select("_pos").collect()] == sorted(r.loan_key for r in book.book().select("loan_key").collect())
    plain = dirty_raw_rows(book.book())
    assert raw.columns == plain.columns and raw.exceptAll(plain).count() == 0 and plain.exceptAll(raw).count() == 0


def test_repeated_rows_are_joined_and_cleaned_once(spark, book):
    from pyspark.sql import functions as F
    from loanscope.plans.catalog import QUERIES
    found = QUERIES["etl_repeated_rows"](spark, book.sf_dir)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and "xxhash64" not in plan
    r = found.agg(F.sum("deliveries"), F.min("deliveries"), F.max("deliveries"), F.count("*")).first()
    keys = [x.loan_key for x in book.book().select("loan_key").collect()]
    assert tuple(r) == (sum(1 + (k % 3 == 0) + (k % 9 == 0) for k in keys), 1, 3, len(keys))
