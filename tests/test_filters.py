from pyspark.sql import functions as F

from corpusmill.functions.phrases import phrases
from corpusmill.operators import code, filters


def col(spark, c, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    return [r[0] for r in df.select(c.alias("x"), "doc_id").orderBy("doc_id").select("x").collect()]


def test_vibe_threshold_counts_substrings(spark):
    assert col(spark, filters.vibe_check("text"), "xcasinox " * 3, "CASINO " * 4) == [True, False]


def test_blacklist_wants_whole_words(spark):
    soft, hard = phrases("soft")[0], phrases("hard")[0]
    got = col(spark, filters.blacklist_clean("text"), f"{soft} " * 3, f"{soft.upper()} " * 4, f"x{soft}x " * 4, f"a {hard} b", f"x{hard}x")
    assert got == [True, False, True, False, True]


def test_topic_filter_is_substring_and_lower_cased(spark):
    got = col(spark, filters.topic_match("text"), "xllmx " * 3, "xLLMx " * 4, phrases("good_phrases")[3].upper(), "function", "general relativity")
    assert got[:2] == [False, True] and got[3:] == [False, False]


def test_page_length_gate(spark):
    flags = filters.page_flags("text")
    assert col(spark, flags["short"], "a" * 1499, "a" * 1500) == [True, False]


def test_page_flags_one_by_one(spark):
    good = ("plain words stand here and there in many long rows, as they always do. " * 40)[:2000]
    probe = {
        "interstitial": good + "please confirm that you and not a robot",
        "adult": good + " casino" * 3,
        "call_to_action": good + " buy now ",
        "alphabet": good + "#" * 200,
        "long_words": "a" * 2000 + ".",
        "no_punctuation": "word " * 400,
        "commas": "a, b. " * 400,
        "dashes": good + "-" * 60,
    }
    for name, text in probe.items():
        assert col(spark, filters.page_flags("text")[name], text, good) == [True, False], name
    assert col(spark, filters.page_gate("text"), good) == [True]


def test_paragraph_lines_of_100_and_101(spark):
    a, b = "a" * 99 + ".", "b" * 100 + "."
    assert col(spark, filters.good_paragraphs("text"), f"{a}\n{b}\nlast", f"{b}\n{b}") == [b, b]
    assert col(spark, filters.good_paragraphs("text", drop_first=True), f"{b}\n{b}\nlast") == [b]
    assert col(spark, filters.good_paragraphs("text", keep_headings=True), f"Head\n{b}\nlast") == [f"Head\n{b}"]


def test_paragraph_punctuation_share(spark):
    four, five = "." * 4 + "a" * 996, "." * 5 + "a" * 995
    assert col(spark, filters.good_paragraphs("text"), f"{four}\n{five}\n") == [five]


def test_transcript_window(spark):
    good = "words. " * 100
    assert col(spark, filters.transcript_ok("text"), "a" * 499, "a" * 500, good + "font" * 50, good + "font" * 51, good + "[music]" * 200, None) == [False, True, True, False, False, False]


def test_answers(spark):
    q, a = "How is it?", "One is here. Two is there." + "x" * 60
    df = spark.createDataFrame([(q, a), (q[1:], a), (q, a[:79]), (q, a + "?"), (q, "x" * 90 + ".")], "q string, a string")
    assert [r[0] for r in df.select(filters.answer_ok("q", "a")).collect()] == [True, False, False, False, False]


def test_urls(spark):
    assert col(spark, filters.url_allowed("text"), "http://a.org/x", "http://a.org/CART", "http://www.Amazon.de/") == [True, False, False]
    assert col(spark, filters.url_known_good("text"), "https://en.wikipedia.org/wiki/X", "http://reddit.com/r/x", "http://reddit.com/comments/x") == [True, False, True]


def test_paragraph_rules_contradict(spark):
    assert col(spark, filters.paragraph_ok("text"), "The quick brown fox jumps over the lazy dog and then it runs far away into the deep dark woods again today.") == [False]


def test_runons(spark):
    run = "w " * 101
    assert col(spark, filters.without_runons("text"), f"Short one.{run}. Last!") == ["Short one.. Last!"]


def test_code(spark):
    got = col(spark, code.clean_code("text"), "import json", "import ctypes.util", "x = 'kernel32'", "def (")
    assert got == [True, False, False, False]
    assert col(spark, code.good_libraries("text"), "import reportlab", "import json", "from numpy import x", "def (") == [True, False, True, False]
    assert col(spark, code.docstrings(F.col("text")), '"""A."""\ndef f():\n    "B."', "def (") == [["A.", "B."], []]
    body = "\n".join(["x"] * 10)
    assert col(spark, code.code_file(F.lit("a.py"), "text"), body, body[:-2], "\n".join(["x"] * 301)) == [True, False, False]


def test_code_shard(spark):
    src = "import numpy\n" + "# a plain comment\nx = 1\n" * 10
    rows = [(src, len(src), "2018-01-01"), (src, len(src), "2017-01-01"), (src, len(src), None), (src, 99, "2020-01-01"), (src + "# ü\n", len(src), "2020-01-01")]
    df = spark.createDataFrame(rows, "content string, size int, max_forks_repo_forks_event_min_datetime string")
    assert code.code_shard(df).count() == 1
