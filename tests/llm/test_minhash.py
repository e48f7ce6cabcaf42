import random
import re

import numpy as np

from corpusmill.llm import minhash
from corpusmill.llm.common import connected_components, shingle_sets


def brute(texts, k, num=80, den=100):
    """Component of each document by all pairs."""
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()})
    c = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((c[i], c[j]))
                c = [a if x == b else x for x in c]
    return c, [len(s) for s in sets]


def check(docs_of, texts, k):
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs_of(texts), k=k).collect()}
    comp, sizes = brute(texts, k)
    assert len(got) == len(texts)
    for i, (c, n) in enumerate(zip(comp, sizes)):
        assert (got[i]["component_id"], got[i]["n_shingles"], got[i]["kept"]) == (c, n, c == i), i


def test_copies_near_copies_and_odd_texts(docs_of, prose, odd):
    r = random.Random(1)
    texts = list(odd) + [prose(60, 5), prose(60, 5).upper(), prose(60, 6)]
    base = prose(80, 9, 5000).split()
    for edits in [1, 2, 3, 4, 6, 8, 10, 12] * 6:
        w = list(base)
        for _ in range(edits):
            w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
        texts.append(" ".join(w))
    check(docs_of, texts, 2)
    check(docs_of, texts, 5)


def test_chain_of_edits_is_one_component(docs_of, prose):
    w, texts = prose(60, 3, 5000).split(), []
    for i in range(12):
        w = list(w)
        w[5 * i : 5 * i + 2] = [f"n{i}", f"m{i}"]
        texts.append(" ".join(w))
    check(docs_of, texts, 2)


def test_empty_table_and_null_ids(spark, docs_of):
    assert minhash.near_duplicates(docs_of(["x"]).limit(0)).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (3, "a b c d e f")], "doc_id long, text string")
    assert sorted((r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect()) == [(3, False), (3, True), (3, True)]


def test_sketch_fills_every_coordinate_and_estimates(prose):
    a, b = np.arange(200, dtype=np.uint64) * np.uint64(7919), np.arange(40, 240, dtype=np.uint64) * np.uint64(7919)
    h = np.concatenate([a, b, a[:1]])
    d = np.repeat([0, 1, 2], [200, 200, 1])
    s = minhash.fast_sketch(h, d, 4, 400)
    assert (s[:3] != minhash._FULL).all() and (s[3] == minhash._FULL).all()
    assert abs((s[0] == s[1]).mean() - 160 / 240) < 0.1
    assert (s == minhash.fast_sketch(h[::-1].copy(), d[::-1].copy(), 4, 400)).all()


def test_shingles_across_documents_do_not_mix():
    t = b"a bc d" + b"a b" + b"" + b"c d"
    h, d = shingle_sets(np.frombuffer(t, np.uint8), np.array([0, 6, 9, 9, 12]), 2)
    assert np.bincount(d, minlength=4).tolist() == [2, 1, 0, 1]


def test_components_of_paths_and_stars(spark):
    e = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(200, 150)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(e, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(21)}, **{100 + i: 100 for i in range(30)}, 150: 150, 200: 150}


def test_residual_pairs_are_few_of_a_groups_pairs(spark, docs_of, prose, monkeypatch):
    """Near copies of one text, some of them at its fringe, at two sizes of the group.

    The components are exact at both. Residual pairs are those close to the threshold: 30 of 4,950 and
    577 of 79,800 when this was written, so they still grow with the square of such a group.
    """
    counts, real = [], minhash._residual
    monkeypatch.setattr(minhash, "_residual", lambda *a: counts.append((p := real(*a)).count()) or p)
    base = prose(120, 21, 5000).split()
    for n in (100, 400):
        r, texts = random.Random(3), []
        for i in range(n):
            w = list(base)
            for _ in range(r.randint(1, 22)):
                w[r.randrange(len(w))] = f"x{r.randrange(10**9)}"
            texts.append(" ".join(w))
        check(docs_of, texts, 2)
    assert counts[0] <= 0.01 * 100 * 99 / 2 and counts[1] <= 0.01 * 400 * 399 / 2
