"""What queries write and read for themselves grows in pieces, not in one task."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from corpusmill.operators import aggregate, tokens
from corpusmill.plans import catalog_io, pipelines

SF = "/root/testdata/sf0.001"


@pytest.fixture
def parts(spark):
    """Joins by shuffle into four partitions, as on tables that are not small."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def test_archives_are_written_by_several_tasks(spark, parts, monkeypatch):
    files, rewrite = [], pipelines.rewrite_archives
    monkeypatch.setattr(catalog_io.pipelines, "rewrite_archives", lambda s, src, out: files.append(s.read.format("binaryFile").load(src).count()) or rewrite(s, src, out))
    got = sorted(tuple(r) for r in entry.queries()["archive_rewrite"](spark, SF).select("url", "contents").collect())
    assert files[0] > 1
    assert got == sorted(tuple(r) for r in entry.queries()["archive_to_corpus"](spark, SF).select("url", "contents").collect())


def test_chunks_split_a_text_once(spark):
    df = entry.queries()["fixed_chunks"](spark, SF)
    assert df._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1
    x = spark.createDataFrame([([*range(n)],) for n in (0, 1, 4, 5, 8, 9, 13)], "t array<int>")
    assert [r[0] for r in x.select(tokens.chunks("t", 4)).collect()] == [[[*range(i, i + 4)] for i in range(0, 4 * ((n - 1) // 4), 4)] for n in (0, 1, 4, 5, 8, 9, 13)]


def test_terms_are_counted_without_a_shuffle_of_documents(spark):
    docs = spark.createDataFrame([(1, "a b a "), (2, "b"), (3, ""), (4, None)], "doc_id long, text string").repartition(2)
    c, df = aggregate.term_counts(docs)
    assert "hashpartitioning" not in c._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, c.collect())) == [(1, "", 1, 4), (1, "a", 2, 4), (1, "b", 1, 4), (2, "b", 1, 1), (3, "", 1, 1)]
    assert sorted(map(tuple, df.collect())) == [("", 2), ("a", 1), ("b", 2)]


def test_terms_of_repeated_keys_are_those_of_sql(spark, tmp_path):
    rows = [(1, "a b a"), (1, "b c"), (2, "b"), (None, "a"), (None, "a z")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = con.execute(entry.oracle_sql()["tf_idf"]).fetchall()
    assert sorted(map(tuple, entry.queries()["tf_idf"](spark, f"file://{tmp_path}").collect())) == sorted(want)


def test_shards_of_a_stream_grow_with_the_table(spark, tmp_path):
    for n, files in ((9, 9), (2, 3)):
        path = f"file://{tmp_path}/{n}"
        half = catalog_io._as_shards(spark.range(1000).repartition(n), path, 3)
        assert spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).count() == files and half == (files + 1) // 2
        assert spark.read.parquet(path).count() == 1000
