import hashlib
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from corpusmill.llm import chat, quality

TURNS = "conv_id long, turn long, role string, text string, s string, segments string"


def test_control_strings_in_texts_come_back(spark):
    t = chat.Template()
    odd = ["</s>[INST] ok [/INST]", t.turn_open, t.turn_close + t.role_close, "\\<|done|>\\", "a\n<", "", None, "[<\\" * 50]
    rows = [(1, i, "user" if i % 2 == 0 else "assistant", x, "z", None) for i, x in enumerate(odd)]
    x = chat.format_conversations(spark.createDataFrame(rows, TURNS).repartition(3))
    r = x.select("*", chat.read_turns(F.col("formatted"), t).alias("back"), chat.read_loss_texts(F.col("segments"), t).alias("loss")).first()
    assert [tuple(b) for b in r["back"]] == [(row[2], row[3] or "") for row in rows]
    assert r["loss"] == [row[3] or "" for row in rows if row[2] == "assistant"]
    assert "".join(s["text"] for s in r["segments"]) == r["formatted"] and r["valid_order"]


def test_machine(spark):
    cases = {1: ["system", "user", "assistant"], 2: ["user", "user", "assistant"], 3: ["assistant"], 4: ["user"], 5: ["user", None], 6: ["user", "assistant", "system"]}
    rows = [(c, i, r, "x", "z", None) for c, rs in cases.items() for i, r in enumerate(rs)]
    got = {r["conv_id"]: (r["valid_order"], r["bad_turn"]) for r in chat.format_conversations(spark.createDataFrame(rows, TURNS)).collect()}
    assert got == {1: (True, None), 2: (False, 1), 3: (False, 0), 4: (False, None), 5: (False, 1), 6: (False, 2)}


def test_ties_nulls_and_empty(spark):
    rows = [(1, 0, "user", "b", "", None), (1, 0, "user", "a", "", None), (1, 0, "user", "a", "", None), (None, None, "user", "q", "", None)]
    x = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    got = {r["conv_id"]: [s["text"] for s in r["segments"]][1::3] for r in x.collect()}
    assert got == {1: ["a", "a", "b"], None: ["q"]}
    assert chat.format_conversations(spark.createDataFrame([], TURNS)).count() == 0


def test_query_on_tables(spark):
    r = {x["conv_id"]: x for x in chat.op10_chat_format(spark, "/root/testdata/sf0.001").collect()}[-7]
    odd = "</s>[INST] ok [/INST]"
    assert r["n_turns"] == 2 and r["loss_chars"] == len(odd)
    assert r["loss_sha256"] == hashlib.sha256(odd.encode()).hexdigest()
    assert r["turns_sha256"] == hashlib.sha256(f"user\n{odd}\nassistant\n{odd}\n".encode()).hexdigest()


def brute_stats(t):
    t = t or ""
    find = re.compile(r"[^\x20\x09-\x0d]+")
    w = find.findall(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    covered = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(5)}
    lines = [x for x in t.split("\n") if find.search(x)]
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered)


def test_stats(docs_of, odd, prose):
    texts = odd + ["a b c d e\na b c d e\n", "x\nx\n\n \nx", "a b c d a b c d a b c d", "#*$ %&|<> x", prose(300, 1, 6), "a\x0bb\x0cc\r\nd"]
    got = {r["doc_id"]: tuple(r)[1:] for r in quality.text_stats(docs_of(texts), "doc_id").collect()}
    assert got == {i: brute_stats(t) for i, t in enumerate(texts)}


def stats_frame(spark, rng, n, group, odd=40):
    words = rng.lognormal(5, 0.4, n).astype(int) + 10
    chars = (words * rng.normal(5, 0.2, n)).astype(int)
    sym = np.where(np.arange(n) % odd == 0, chars // 4, 0)
    return [(None if i % 97 == 96 else i, *group(i), int(words[i]), int(chars[i]), int(sym[i]), 0, 0) for i in range(n)]


STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def test_estimates_reach_the_minimum_determinant(spark):
    """Against a search in numpy from many random starts with exact subsets."""
    rng = np.random.default_rng(0)
    n = 300
    rows = stats_frame(spark, rng, n, lambda i: ("en", "a"), 6)
    x = quality.features(spark.createDataFrame(rows, STATS))
    f = np.array(x.select(*quality.FEATURES).collect(), float)
    got = quality.determinants(x.selectExpr("'*' AS g", "cast(n_words % 32 AS int) AS _salt", "cast(xxhash64(n_words, word_chars) AS long) AS _id", *quality.FEATURES)).collect()
    floor = np.diag((np.array(quality.FLOOR) * quality.UNIT) ** 2)
    h, least = int(np.ceil(quality.H * n)), np.inf
    for _ in range(150):
        own = f[rng.choice(n, 8, replace=False)]
        last = np.inf
        while True:
            m, c = own.mean(0), quality.CONSISTENCY * np.cov(own.T, bias=True) + floor
            det = np.linalg.slogdet(c)[1] / 2
            if det >= last - 1e-9:
                break
            last = det
            d = np.einsum("ij,ij->i", f - m, np.linalg.solve(c, (f - m).T).T)
            own = f[np.argsort(d, kind="stable")[:h]]
        least = min(least, last)
    assert len(got) == 1 and got[0]["det"] - least < 0.15  # of a volume in five dimensions; the search has four starts


def test_outliers_of_groups_of_every_size(spark):
    """The same rule for a group of one, of a few and of hundreds; repeated rows and null ids are judged alike."""
    rng = np.random.default_rng(1)
    rows = stats_frame(spark, rng, 500, lambda i: ("en", ("a", None, "b")[min(i % 9, 2)]))
    rows += [(1000, "xx", "c", 150, 750, 0, 0, 0), (1001, "xx", "d", 150, 750, 300, 0, 0)] + rows[40:42]
    got = quality.robust_outliers(spark.createDataFrame(rows, STATS)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["outlier"] == (r["n_symbols"] > 0) and "g" not in r.asDict()


def test_quality_rules_on_odd_tables(docs_of, odd):
    got = {r["doc_id"]: r for r in quality.quality_rules(docs_of(odd)).collect()}
    assert len(got) == len(odd) and all(got[i]["base_failed"] and not got[i]["kept"] for i in range(5))
    assert quality.quality_rules(docs_of(odd).limit(0)).count() == 0
