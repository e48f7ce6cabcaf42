"""Every registered query with SQL agrees with it on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in NAMES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _rows(rows):
    return sorted(tuple(repr(round(x, 6)) if isinstance(x, float) else repr(x) for x in r) for r in rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = duck.execute(entry.oracle_sql()[name])
    theirs = [c[0] for c in got.description]
    assert cols == sorted(theirs)
    want = [tuple(r[theirs.index(c)] for c in cols) for r in got.fetchall()]
    assert _rows([tuple(r[c] for c in cols) for r in df.collect()]) == _rows(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
