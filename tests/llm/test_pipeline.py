"""Stages on a small table of documents against what each must do to planted cases."""

import re

import pytest

import corpus_pipeline
from corpusmill.llm.common import materialize

WORDS = re.compile(r"[^\x20\x09-\x0d]+")


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory, prose):
    d = tmp_path_factory.mktemp("tables")
    item = prose(30, 77, 3000)
    passage = prose(60, 78, 3000)
    texts = {i: f"{prose(60 + i, i, 3000)}.\n{prose(30, 200 + i, 3000)}." for i in range(60)}
    texts[100] = texts[5]
    texts[101] = texts[6].replace(texts[6].split()[40], "changed", 1)
    texts[102] = prose(50, 301, 3000) + " " + passage + " " + prose(50, 302, 3000)
    texts[103] = prose(50, 303, 3000) + " " + passage + " " + prose(50, 304, 3000)
    texts[104] = prose(50, 305, 3000) + " " + item + " " + prose(50, 306, 3000)
    texts[105] = "again and again and so " * 40
    texts[106] = "few words"
    texts[107] = None
    texts[108] = " ".join(f"{w}$$$###" for w in prose(80, 307, 3000).split())
    rows = [(i, t, "en", "web", len(t or "")) for i, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"file://{d}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"file://{d}/benchmark.parquet")
    return f"file://{d}", texts, passage


def test_stages(spark, tables):
    d, texts, passage = tables
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns = docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, d))
        seen[name] = docs
        if name != "packing":
            assert docs.columns == columns
    ids = {k: {r[0] for r in v.select("doc_id").collect()} for k, v in seen.items()}
    every = set(texts)
    assert every - ids["quality_rules"] == {105, 106, 107, 108}
    assert ids["quality_rules"] - ids["near_dedup"] == {100, 101}
    assert ids["substring_dedup"] == ids["near_dedup"]
    cut = {r["doc_id"]: r["text"] for r in seen["substring_dedup"].collect()}
    assert passage in cut[102] and passage not in cut[103] and len(WORDS.findall(cut[103])) == 100
    assert all(cut[i] == texts[i] for i in ids["substring_dedup"] - {103})
    assert ids["substring_dedup"] - ids["benchmark_decontamination"] == {104}
    assert ids["packing"] == ids["benchmark_decontamination"]
    run = sorted(map(tuple, corpus_pipeline.run(spark, d).select("doc_id", "start", "length", "ids_crc32").collect()))
    assert run == sorted(map(tuple, seen["packing"].select("doc_id", "start", "length", "ids_crc32").collect()))


def test_empty_input(spark, tables, tmp_path):
    d, _, _ = tables
    spark.read.parquet(f"{d}/documents.parquet").limit(0).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.read.parquet(f"{d}/benchmark.parquet").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and [n for k in range(1, 11) for n in names if n.startswith(f"op{k}_")] and set(entry.oracle_sql()) <= set(names)
