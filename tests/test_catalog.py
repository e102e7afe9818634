"""Each query gives the rows of its SQL, or some rows where SQL can't express it."""

import glob
import os

import duckdb
import pytest

from foliant.plans import documents

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(documents.QUERIES))
def test_query_equals_sql(spark, duck, name):
    got = documents.QUERIES[name](spark, SF)
    if name not in documents.ORACLE_SQL:
        assert got.count() > 0
        return
    want = duck.sql(documents.ORACLE_SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    rows = [tuple(r[i] for i in order) for r in want.fetchall()]
    assert sorted(map(str, (tuple(r) for r in got.select(columns).collect()))) == sorted(map(str, rows))


def test_answers_with_a_blank_title_equal_sql(spark, tmp_path):
    rows = [(i, t, lang, "s", 0) for i, (t, lang) in enumerate([("Ö Ö", "fr"), (None, None), ("", "en"), ("Ö 1 Ö", "de"), (" a", "fr")] * 3)]
    rows = [(i, *r[1:]) for r in rows for i in (r[0], 5 * r[0] + 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.sql(documents.ORACLE_SQL["parsed_answers"])
    got = documents.QUERIES["parsed_answers"](spark, str(tmp_path)).select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(want.fetchall())
