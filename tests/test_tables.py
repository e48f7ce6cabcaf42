from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import aggregate, dedup, extract, relational, tokens
from corpusmill.plans import pipelines
from corpusmill.sources import readers, writers
from corpusmill.streaming import streams


def test_view_scores_groups_of_four_and_five(spark):
    rows = [("a", x) for x in (10, 10, 10, 10)] + [("b", x) for x in (10, 10, 10, 10, 1000)]
    got = aggregate.view_scores(spark.createDataFrame(rows, "key string, count long"), cutoff=0.0).collect()
    # the outlier is clipped at 20: mean 12, deviation 4
    assert [(r["key"], r["n"]) for r in got] == [("b", 5)]
    assert abs(got[0]["score"] - (3 / 4.1 + 4 * 12 * 5**0.333)) < 1e-9


def test_simhash_zero_null_and_pairs(spark):
    df = spark.createDataFrame([(1, "alpha beta gamma"), (2, "the of"), (3, "zeta zeta zeta eta eta"), (4, "zeta zeta zeta eta eta")], "doc_id long, text string")
    got = {r[0]: r[1] for r in dedup.simhash_bits(df).collect()}
    assert set(got[1]) == {"0"} and got[3] == got[4] and "1" in got[3]
    assert dedup.simhash_pairs(dedup.simhash_bits(df)).count() == 0


def test_first_by_keeps_null_keys_and_smallest(spark):
    df = spark.createDataFrame([(2, "a"), (1, "a"), (3, None), (4, None)], "doc_id long, text string")
    assert sorted(r[0] for r in dedup.first_by(df, F.col("text")).collect()) == [1, 3, 4]


def test_chunks(spark):
    df = spark.createDataFrame([([1] * n,) for n in (8, 9, 16, 17)], "t array<int>")
    assert [len(r[0]) for r in df.select(tokens.chunks("t", 8)).collect()] == [0, 1, 1, 2]


def test_bpe_round_trip(spark):
    df = spark.createDataFrame([(1, "low lower lowest low low")], "doc_id long, text string")
    merges = tokens.train_bpe(df, 14)
    assert merges[0] == ("l", "o") and ("lo", "w") in merges
    chars = sorted({c for p in merges for t in p for c in t})
    names = [*chars]
    names += [a + b for a, b in merges if a + b not in names]
    ids = tokens.encode(df, merges).first()["tokens"]
    back = "".join(names[i] for i in ids)
    assert back.startswith("low low") and len(ids) < 25
    m = spark.createDataFrame([(list("abab"),)], "t array<string>").select(tokens.merge_pass("t", "a", "b")).first()[0]
    assert m == ["ab", "ab"]


def brute_bpe(texts, size):
    words = Counter(w + " " for t in texts for w in t.split(" ") if w)
    split, merges = {w: list(w) for w in words}, []
    for _ in range(size):
        pairs = Counter()
        for w, x in split.items():
            for p in zip(x, x[1:]):
                pairs[p] += words[w]
        if not pairs:
            break
        a, b = min(pairs, key=lambda p: (-pairs[p], p))
        merges.append((a, b))
        for w, x in split.items():
            out = []
            for t in x:
                if out and out[-1] == a and t == b:
                    out[-1] = a + b
                else:
                    out.append(t)
            split[w] = out
    return merges


def test_bpe_of_a_large_alphabet_keeps_every_character(spark):
    texts = ["".join(chr(0x4E00 + i) for i in range(300)) + " z", "abab aab abab \U0001F600\n\ue000 ababa", "aaaa aaa b b", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    merges = tokens.train_bpe(df, 12)
    assert len(merges) == 12 and merges == brute_bpe(texts, 12)
    names = sorted({c for t in texts for c in t} | {" "})
    names += dict.fromkeys(a + b for a, b in merges if a + b not in names)
    for r in tokens.encode(df, merges).collect():
        assert "".join(names[i] for i in r["tokens"]) == "".join(w + " " for w in r["text"].split(" ") if w)


def test_ranked_split_does_not_depend_on_partitions(spark):
    a = relational.split(spark.range(100).withColumnRenamed("id", "doc_id").repartition(1), "doc_id")
    b = relational.split(spark.range(100).withColumnRenamed("id", "doc_id").repartition(8), "doc_id")
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    assert a.where("part = 'train'").count() == 90


def test_question_answer_pairs(spark):
    text = "Intro.\nWhat is this thing?\n\n" + "It is one thing of many that are here. And it is more.\n" * 3
    got = extract.question_answers(spark.createDataFrame([(text,)], "text string")).collect()
    assert [r["prompt"] for r in got] == ["What is this thing?"]


def test_extraction(spark):
    df = spark.createDataFrame([('x {"a": {"b": 1}} y',)], "t string")
    assert df.select(extract.balanced_json(F.col("t"))).first()[0] == '{"a": {"b": 1}}'
    page = '<td>Page views in the past 30 days</td><td><div class="m"><a rel="x" href="y">1,234</a></div></td>'
    assert spark.createDataFrame([(page,)], "t string").select(extract.page_views("t")).first()[0] == 1234
    assert spark.createDataFrame([('<text start="1" dur="2">Hi there</text>',)], "t string").select(extract.caption_lines("t")).first()[0] == ["Hi there"]
    assert spark.createDataFrame([('a /watch?v=abc&x "/watch?v=de"',)], "t string").select(extract.video_ids("t")).first()[0] == ["abc", "de"]
    links = '<a href="/wiki/A">a</a><a href="/wiki/Help:B">b</a><a href="/wiki/C">c</a>'
    assert spark.createDataFrame([(links, "C")], "t string, own string").select(extract.wiki_links("t", "own")).first()[0] == ["A"]


WET = """WARC/1.0
WARC-Type: warcinfo

software: x

WARC/1.0
WARC-Type: conversion
WARC-Target-URI: http://A.org/X
WARC-Identified-Content-Language: eng
Content-Type: text/plain

title line
the text has an inline WARC/1.0 mark
WARC/1.0
WARC-Type: conversion
WARC-Target-URI: http://b.org/
Content-Type: text/plain

t
body
"""


def test_web_archive(spark, tmp_path):
    (tmp_path / "a.wet").write_text(WET)
    rows = readers.web_archive(spark, str(tmp_path / "a.wet")).collect()
    assert [(r["url"], r["lan"]) for r in rows] == [("http://a.org/x", "eng"), ("http://b.org/", None)]
    assert rows[0]["contents"].strip() == "the text has an inline WARC/1.0 mark"
    (tmp_path / "b.wet").write_bytes(WET.replace("\n", "\r\n").encode())
    assert readers.web_archive(spark, str(tmp_path / "b.wet"), mark="WARC/1.0\r\n").count() == 2


def test_readers(spark, tmp_path):
    (tmp_path / "w.xml").write_text("<mediawiki><page><title>A</title><revision><text>body</text></revision></page><page><title>B</title><redirect title='A'/><revision><text>x</text></revision></page></mediawiki>")
    assert [tuple(r) for r in readers.wiki_dump(spark, str(tmp_path / "w.xml")).collect()] == [("A", "body")]
    (tmp_path / "q.csv").write_text('Post Id,Parent Id,PostType,Body\n1,,Question,"a ""q"", b"\n2,1.0,Answer,"x\ny"\n')
    posts = readers.question_csv(spark, str(tmp_path / "q.csv"))
    assert aggregate.answers_of(posts).first()["answers"] == {2: "x\ny"}
    (tmp_path / "l.json").write_text('{"positive": ["a"], "negative": ["b", "c"]}')
    assert sorted(map(tuple, readers.labelled_json(spark, str(tmp_path / "l.json")).collect())) == [("a", 1), ("b", 0), ("c", 0)]
    (tmp_path / "u.json").write_text('["x", "y"]')
    assert readers.string_list(spark, str(tmp_path / "u.json")).count() == 2
    (tmp_path / "v.txt").write_text("en The_X 7 0\nen File 1\nde Y 3 0\n")
    assert [r["count"] for r in readers.page_views(spark, str(tmp_path / "v.txt")).collect()] == [7, 1, 3]
    (tmp_path / "d.json").write_text('{"u": {"filepath": "f", "n_visits": 2, "urls": ["v", "w"]}}')
    nodes, edges = readers.link_directory(spark, str(tmp_path / "d.json"))
    assert nodes.count() == 1 and edges.count() == 2


def test_delimited_round_trip(spark, tmp_path):
    docs = spark.createDataFrame([("a\nb",), ("c",)], "text string").coalesce(1)
    writers.delimited(docs, str(tmp_path / "x"))
    assert [r[0] for r in readers.delimited(spark, str(tmp_path / "x")).collect()] == ["a\nb", "c"]


def test_shards_by_size(spark, tmp_path):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10).alias("text"))
    writers.by_size(docs, str(tmp_path / "s"), 30)
    got = spark.read.parquet(str(tmp_path / "s")).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in got] == [3, 3, 3, 1]


def test_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (600 if i % 2 else 10), "en") for i in range(20)], "doc_id long, text string, lang string")
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    s = streams.shards(spark, str(tmp_path / "in"), docs.schema, 1)
    streams.write(streams.filtered(s), str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination()
    batch = streams.web_gate(spark.read.parquet(str(tmp_path / "in")))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).select("doc_id").collect()) == sorted(r[0] for r in batch.select("doc_id").collect())


def test_wiki_by_views(spark):
    pages = spark.createDataFrame([("Big One", "text " * 300), ("Small", "text " * 300)], "title string, text string")
    views = spark.createDataFrame([(f"en Big_One {n} 0", "Big_One", n) for n in (100, 110, 90, 100, 105)] + [("de X 1 0", "X", 1)], "value string, title string, count long")
    assert [r["key"] for r in pipelines.wiki_by_views(pages, views).collect()] == ["bigone"]


@pytest.mark.parametrize("depth,nodes", [(1, 2), (3, 4)])
def test_reachable(spark, depth, nodes):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (3, 0)], "src long, dst long")
    assert relational.reachable(e, spark.createDataFrame([(0,)], "node long"), depth).count() == nodes


def test_registered_functions(spark):
    from corpusmill.functions.register import register_all

    register_all(spark)
    r = spark.sql("SELECT normalize_text('Colour'), nfkc('ﬁ'), is_clean_code('import ctypes'), uses_good_libraries('import numpy'), count_of('aXbX', 'X')").first()
    assert tuple(r) == ("Color", "fi", False, True, 2)
    q = "What is this thing?\n\n" + "It is one thing of many that are here. And it is more.\n" * 3
    df = spark.createDataFrame([(q,)], "t string")
    df.createOrReplaceTempView("qa_texts")
    assert spark.sql("SELECT prompt FROM qa_texts, LATERAL question_answers(t)").first()[0] == "What is this thing?"


def test_whole_corpus_merges_and_batches(spark):
    df = spark.createDataFrame([("abab abab",), ("xab",)], "text string")
    assert tokens.train_bpe_whole(df, 2) == [("a", "b"), ("ab", "ab")]
    assert [len(b) for b in tokens.batches(spark.range(5).repartition(2), 2)] == [2, 2, 1]
