"""What SQL cannot express, against plain Python; and repeated rows, ties and nulls."""

import ast
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusmill.functions import metrics
from corpusmill.functions import text as tx
from corpusmill.functions.expr import trie_pattern
from corpusmill.functions.phrases import mapping, phrases
from corpusmill.operators import aggregate, code, dedup, filters, relational, tokens
from corpusmill.streaming import streams

TEXTS = ["", "Colour and COLOUR, grey—area; the the cat", "teh pyhton ©  wich ½ «x»", "naïve Straße … “q” end", "deeplearning deeplearninG x", "a\x00\uffff\x00b colour", None]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(2)


def column(df, c):
    return [r["x"] for r in df.select("doc_id", c.alias("x")).orderBy("doc_id").collect()]


def test_spelling_and_punctuation(texts):
    pairs = {k: v for n in ("british", "split_words", "quotes", "dashes", "spacing") for k, v in mapping(n).items()}
    pattern = re.compile(r"\b(?:" + "|".join(map(re.escape, sorted(pairs, key=len, reverse=True))) + r")\b", re.I)

    def cased(m):
        new = pairs.get(m[0].lower())
        return m[0] if not new else new.upper() if m[0].isupper() else new.capitalize() if m[0][0].isupper() else new

    assert column(texts, tx.normalize_text(F.col("text"))) == [t and pattern.sub(cased, t) if t else t for t in TEXTS]
    words = mapping("british") | mapping("split_words")
    plain = re.compile(r"\b(?:" + "|".join(sorted(words, key=len, reverse=True)) + r")\b", re.I)

    def bounded(t):
        t = plain.sub(lambda m: words.get(m[0].lower(), m[0]), t)
        for n in ("quotes", "dashes", "spacing"):
            for a, b in mapping(n).items():
                t = t.replace(a, b)
        return t

    assert column(texts, tx.correct_boundaries("text")) == [t if t is None else bounded(t) for t in TEXTS]


def test_corrections_take_the_first_of_two_that_share_a_space(texts, spark):
    chars = mapping("chars")
    words = {f" {k} ": f" {v} " for n in ("common", "tech", "split_words", "british") for k, v in mapping(n).items()}
    pattern = re.compile("|".join(map(re.escape, sorted([*chars, *words], key=len, reverse=True))))
    want = [t if t is None else pattern.sub(lambda m: (chars | words)[m[0]], t) for t in TEXTS]
    assert column(texts, tx.correct_by_dict(F.col("text"))) == want
    one = spark.createDataFrame([(0, "x teh teh wich y")], "doc_id long, text string")
    assert column(one, tx.correct_by_dict(F.col("text"))) == ["x the teh which y"]


def test_transcript_replacements_run_in_order(spark):
    df = spark.createDataFrame([(0, "It\u2019s \u2018ok\u2019 a uh  um b")], "doc_id long, text string")
    t = "It\u2019s \u2018ok\u2019 a uh  um b".lower()
    for a, b in tx.TRANSCRIPT:
        t = t.replace(a, b)
    # typographic apostrophes become plain ones first, and those are deleted later
    assert "'" not in t and column(df, tx.clean_transcript("text")) == [t]


def test_punctuation_and_accents(texts):
    got = column(texts, tx.strip_accents(F.col("text")))
    assert got == [t if t is None else "".join(c for c in unicodedata.normalize("NFD", t) if not unicodedata.combining(c)) for t in TEXTS]


def test_trie_matches_what_an_alternation_by_length_matches():
    items = ["a", "ab", "abc", "b.c", "b", "bcd", "+"]
    slow = re.compile("|".join(map(re.escape, sorted(items, key=len, reverse=True))))
    for t in ("abcd", "xab.cbcd+", "aabb.cab", "+abbcd"):
        assert re.findall(trie_pattern(items), t) == slow.findall(t)


def test_literals_count_without_overlaps_and_with_copies(spark):
    df = spark.createDataFrame([(0, "aaaa bb abab"), (1, ""), (2, None)], "doc_id long, text string")
    items = ["aa", "bb", "ab", "aba", "bb"]
    want = [sum(t.count(x) for x in items) if t is not None else None for t in ("aaaa bb abab", "", None)]
    assert column(df, filters.count_literals("text", items)) == want


CODE = ['"""Doc # not a comment."""\nimport numpy\n\n# note one\nx = 1  # two\n', "def f(:\n", "import ctypes\nx = 1\n", "from torch.nn import x\nclass A:\n    '''In.'''\n", "", "x = 'FindWindow'\n"]


def test_code_against_the_parser(spark):
    df = spark.createDataFrame(list(enumerate(CODE)), "doc_id long, text string")

    def modules(t):
        try:
            nodes = list(ast.walk(ast.parse(t)))
        except SyntaxError:
            return None
        return [a.name for n in nodes if isinstance(n, ast.Import) for a in n.names] + [n.module for n in nodes if isinstance(n, ast.ImportFrom) and n.module]

    deny, words, allow = set(phrases("code_deny")), phrases("code_words"), phrases("code_allow")
    clean = [m is not None and not {x.split(".")[0] for x in m} & deny and not any(w in t for w in words) for t in CODE for m in [modules(t)]]
    assert column(df, code.clean_code("text")) == clean
    assert column(df, code.good_libraries("text")) == [any(x.startswith(a) for x in modules(t) or [] for a in allow) for t in CODE]
    assert column(df, code.comment_text("text"))[0] == ["Doc # not a comment.", ' not a comment."""', " note one", " two"]
    got = column(df, metrics.comment_lines("text"))
    assert [(r["comment_lines"], r["lines"]) for r in got][:1] == [(6, 5)] or got[0]["lines"] == 5


def test_local_and_distributed_training_give_the_same_merges(spark):
    rows = [(i, t) for i, t in enumerate(["low lower lowest low low", "new newer newest wider wide", "aaa aaaa aa banana bandana", "", None])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert tokens.train_bpe(df, 25) == tokens.train_bpe(df, 25, most_local=0)


def test_byte_level_round_trip_with_special_tokens(spark, tmp_path):
    rows = [(0, "naïve  café — 東京\n\ttabs"), (1, ""), (2, " lead and trail ")]
    x = spark.createDataFrame(rows, "doc_id long, text string").withColumn("b", tokens.byte_text("text"))
    path = f"file://{tmp_path}/tok"
    tokens.save_tokenizer(spark, path, tokens.train_bpe(x, 10, "b", word_end=""), [c for c in tokens.alphabet(x, "b") if c != " "], ["<|endoftext|>"])
    merges, ids = tokens.load_tokenizer(spark, path)
    assert max(ids.values()) == ids["<|endoftext|>"] == len(ids) - 1
    enc = tokens.encode(x, merges, "b", end_id=ids["<|endoftext|>"], ids=ids, word_end="")
    assert {r["doc_id"]: r["text"] for r in tokens.decode_bytes(enc, merges, ids).collect()} == {i: t + "<|endoftext|>" for i, t in rows}


def test_ids_of_more_than_two_bytes_are_an_error(spark):
    df = spark.createDataFrame([([1, 65535],)], "t array<int>")
    assert df.select(tokens.uint16("t")).first()[0] == [1, 65535]
    with pytest.raises(Exception, match="two bytes"):
        spark.createDataFrame([([1, 65536],)], "t array<int>").select(tokens.uint16("t")).collect()


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "t"), (1, "t"), (2, "t"), (3, None), (3, None), (4, None)], "doc_id long, text string")
    got = sorted((r["doc_id"], r["text"]) for r in dedup.dedup_prefix(df).collect())
    assert got == [(1, "t"), (3, None), (4, None)]
    same = spark.createDataFrame([("http://a", "x"), ("http://a", "x"), ("HTTP://A", "w")], "url string, contents string")
    assert [tuple(r) for r in dedup.first_by(same, dedup.url_key("url"), "contents").collect()] == [("HTTP://A", "w")]


def test_stream_and_batch_dedup_urls_alike(spark, tmp_path):
    rows = [(1, "http://a"), (1, "http://a"), (2, "HTTP://A"), (3, None), (3, None), (4, None)]
    df = spark.createDataFrame(rows, "page_id long, url string")
    df.coalesce(1).write.parquet(f"file://{tmp_path}/in")
    q = streams.write(streams.unique_urls(streams.shards(spark, f"file://{tmp_path}/in", df.schema)), f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    q.awaitTermination()
    got = spark.read.schema(df.schema).parquet(f"file://{tmp_path}/out")
    keys = lambda x: sorted((r["url"] or "").lower() + str(r["page_id"] if r["url"] is None else "") for r in x.collect())
    assert keys(got) == keys(dedup.dedup_urls(df))


def test_running_sums_of_sparse_orders(spark):
    ids = [(hash(str(i)) % 2**60 - 2**59, i % 7 + 1) for i in range(300)]
    df = spark.createDataFrame(ids, "doc_id long, n long")
    got = {r["doc_id"]: r["before"] for r in aggregate.running_shards(df, "n", "doc_id", 10, rows=16).collect()}
    total, want = 0, {}
    for i, n in sorted(ids):
        want[i] = total
        total += n
    assert got == want


def test_reachable_with_a_visit_threshold(spark):
    e = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (0, 4), (4, 5), (5, 0)], "src long, dst long")
    n = spark.createDataFrame([(i, 0 if i == 4 else 9) for i in range(6)], "node long, n_visits int")
    start = spark.createDataFrame([(0,)], "node long")
    got = {r["node"]: r["depth"] for r in relational.reachable(e, start, 9, n, 5).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3}


def test_hamming_pairs_against_all_pairs(spark):
    import random

    r = random.Random(4)
    base = [r.getrandbits(64) for _ in range(30)]
    sigs = base + [b ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) ^ (1 << r.randrange(64)) for b in base] + [0]
    df = spark.createDataFrame([(i, f"{s:064b}") for i, s in enumerate(sigs)], "doc_id long, simhash string")
    got = {(x["a"], x["b"], x["distance"]) for x in dedup.simhash_pairs(df).collect()}
    first = {}
    for i, s in enumerate(sigs):
        first.setdefault(s, i)
    want = {(i, j, bin(s ^ t).count("1")) for s, i in first.items() for t, j in first.items() if i < j and s and t and bin(s ^ t).count("1") <= 3}
    assert got == want
