"""Queries against their SQL on texts that the small tables lack: empty, blank, null, of one character, and rounded at a tie."""

import math

import duckdb
import pytest

import __spark_entry__ as entry


def tie(k: int, n: int) -> str:
    """k commas in a text of n characters that is one word."""
    return "," * k + "x" * (n - k)


TEXTS = ["", " \n ", None, "aaaa", "the", "the the end, casino!", tie(333, 5120), tie(169, 5120), tie(427, 25600), tie(246, 30720), "naïve — x"]


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("odd"))
    rows = [(i, t, "en", "src1", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").coalesce(1).write.parquet(f"file://{d}/documents.parquet")
    return d


def key(x):
    return (("nan",) if math.isnan(x) else (math.copysign(1, x), x)) if isinstance(x, float) else x


@pytest.mark.parametrize("name", ["entropy", "term_density", "viewer_stats"])
def test_odd_texts_give_what_sql_gives(spark, odd, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{odd}/documents.parquet/*.parquet'")
    df = entry.queries()[name](spark, f"file://{odd}")
    got = con.execute(entry.oracle_sql()[name])
    cols = [c[0] for c in got.description]
    want = sorted(([*map(key, r)] for r in got.fetchall()), key=lambda r: r[0])
    assert sorted(([key(r[c]) for c in cols] for r in df.collect()), key=lambda r: r[0]) == want
