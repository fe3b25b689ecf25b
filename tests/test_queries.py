"""Every query against its SQL on the small tables, through DuckDB."""

import math
import os

import duckdb
import pandas as pd
import pytest

from ticktrail.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and math.isnan(v)):
        return "~"
    return repr(round(float(v), 9)) if isinstance(v, float) else str(v)


def rows(pdf):
    cols = sorted(pdf.columns)
    return cols, sorted(tuple(map(plain, r)) for r in pdf[cols].astype(object).itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, db, name):
    got = catalog.QUERIES[name](spark, SF)
    if name not in catalog.ORACLES:
        assert got.count() > 0
        return
    want = db.sql(catalog.ORACLES[name])
    a, b = [list(r) for r in got.collect()], want.fetchall()
    assert rows(pd.DataFrame(a, columns=got.columns, dtype=object)) == rows(pd.DataFrame(b, columns=want.columns, dtype=object))


def test_entry_works_without_the_llm_folders():
    import subprocess
    import sys

    code = "import sys; sys.modules['ticktrail.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'session_attribution' in q and 'pipeline' not in q and set(e.oracle_sql()) <= set(q)"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert subprocess.run([sys.executable, "-c", code], cwd=root).returncode == 0
