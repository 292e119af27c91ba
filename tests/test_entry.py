import os
import subprocess
import sys

import duckdb

import __spark_entry__ as E
from sqloracle import SQL
from tools.check_oracle import TABLES, rows_of

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0 and "default_rate" in df.columns


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_queries_match_duckdb_at_sf0001(spark):
    con = duckdb.connect()
    for t in TABLES:
        p = os.path.join(SF, f"{t}.parquet")
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    queries = {k: v for k, v in E.queries().items() if k in SQL}
    wrong = []
    for name, query in queries.items():
        sdf = query(spark, SF)
        res = con.execute(SQL[name])
        dcols = [d[0] for d in res.description]
        if sorted(sdf.columns) != sorted(dcols) or rows_of(sdf.columns, [tuple(r) for r in sdf.collect()]) != rows_of(dcols, res.fetchall()):
            wrong.append(name)
    assert len(queries) > 50 and wrong == []


def test_entry_without_an_optional_package():
    """A package that only the text operators need is missing: the other queries stay, with a warning."""
    code = ("import sys, warnings\n"
            "sys.modules['ahocorasick'] = None\n"
            f"sys.path.insert(0, {ROOT!r})\n"
            "with warnings.catch_warnings(record=True) as seen:\n"
            "    warnings.simplefilter('always')\n"
            "    import __spark_entry__ as E\n"
            "left = [str(w.message) for w in seen if 'text operators' in str(w.message)]\n"
            "print(len(E.queries()) > 60, 'monthly_kpi_rollup' in E.queries(), set(E.oracle_sql()) <= set(E.queries()), len(left) <= 1)\n")
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=120)
    assert out.stdout.split() == ["True"] * 4, out.stderr
