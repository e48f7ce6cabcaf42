"""Null ids, repeated rows, clashing columns and empty tables, for every operator on documents and every stage."""

from collections import Counter

import pytest

import corpus_pipeline
from corpusmill.llm import decontam, licenses, minhash, packing, quality, substrings, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _salt int, g string, h long, _cm_id long, bucket int, rank int"


@pytest.fixture(scope="module")
def odd_docs(spark, prose):
    p = prose(70, 900, 4000)
    rows = [(i, t) for i, t in enumerate([p, prose(30, 901, 4000) + " " + p, None, "", "Released under the MIT License.", prose(80, 902, 4000)])]
    rows += [(None, prose(80, 903, 4000)), (None, prose(80, 903, 4000)), (None, None), (5, rows[5][1]), (5, rows[5][1])]
    return spark.createDataFrame([(i, t, "en" if i else None, None if i == 1 else "web", len(t or ""), 3, "g", 9, 9, 1, 1) for i, t in rows], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(0, 1), (1, 0), (1, 0), (4, 0), (5, 0), (None, 1), (3, None)], "doc_id long, toxic int")


ONE_ROW_EACH = {
    "licenses": lambda d, x: licenses.license_scan(d),
    "tokens": lambda d, x: tokens.token_counts(d, tokens.default_vocabulary()),
    "toxicity": lambda d, x: toxicity.toxicity(d, x),
    "quality": lambda d, x: quality.quality_rules(d),
    "minhash": lambda d, x: minhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", sorted(ONE_ROW_EACH))
def test_one_row_for_every_row(odd_docs, labels, name):
    f = ONE_ROW_EACH[name]
    got = Counter(r["doc_id"] for r in f(odd_docs, labels).collect())
    assert got == Counter(r["doc_id"] for r in odd_docs.select("doc_id").collect())
    assert f(odd_docs.limit(0), labels).count() == 0


def test_packing_places_every_id_once(odd_docs):
    rows = packing.pack(odd_docs, tokens.default_vocabulary()).collect()
    assert Counter(r["doc_id"] for r in rows) == Counter(r["doc_id"] for r in odd_docs.select("doc_id").collect())
    ends = sorted((r["sequence_id"], r["offset"], r["length"]) for r in rows)
    at = {}
    for s, o, n in ends:
        assert at.get(s, 0) == o and o + n <= 2048
        at[s] = o + n


def test_passages_and_items(spark, odd_docs, prose):
    got = {(r["doc_id"], r["source_doc_id"]) for r in substrings.repeated_passages(odd_docs).collect()}
    assert got == {(1, 0)}
    items = spark.createDataFrame([(1, prose(80, 903, 4000)), (1, prose(80, 903, 4000)), (None, "x"), (2, None)], "item_id long, text string")
    found = decontam.contaminated(odd_docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in found} == {(None, 1)}


def test_stages_name_rows_without_an_id(spark, odd_docs, prose, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([(1, prose(80, 903, 4000))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    ids = lambda x: Counter(r["doc_id"] for r in x.collect())
    assert ids(corpus_pipeline.quality_rules(spark, odd_docs, d)) == Counter({0: 1, 1: 1, 5: 3, None: 2})
    assert ids(corpus_pipeline.near_dedup(spark, odd_docs, d)) == Counter({0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 1, None: 2})
    assert ids(corpus_pipeline.benchmark_decontamination(spark, odd_docs, d)) == Counter({0: 1, 1: 1, 2: 1, 3: 1, 4: 1, 5: 3, None: 1})
    cut = corpus_pipeline.substring_dedup(spark, odd_docs, d)
    assert cut.columns == odd_docs.columns and {r["text"] for r in cut.where("doc_id = 1").collect()} == {prose(30, 901, 4000) + " "}
