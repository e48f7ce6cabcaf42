"""Licences, URLs, benchmark items, toxicity and repeated passages."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corpusmill.llm import common, decontam, licenses, substrings, toxicity, urls
from corpusmill.llm.common import BlockedBloom

W = re.compile(r"[^\x20\x09-\x0d]+")


def test_bloom_has_no_false_negatives_and_few_false_positives():
    h = np.random.default_rng(0).integers(0, 2**64, 60_000, dtype=np.uint64)
    b = BlockedBloom(BlockedBloom.blocks_for(30_000))
    b.add(h[:30_000])
    assert b.test(h[:30_000]).all() and b.test(h[30_000:]).mean() < 0.01


@pytest.mark.parametrize("piece", [common.PIECE, 1 << 11])
def test_filter_reaches_the_driver_in_packed_rows(spark, monkeypatch, piece):
    """At once or piece by piece, it is the filter that its keys make, and few rows come instead of one a word."""
    n, rows, frame = 60_000, [0], type(spark.range(0))

    def counted(f):
        def run(self, *args, **kwargs):
            out = f(self, *args, **kwargs)
            out = out if hasattr(out, "__len__") else list(out)
            rows[0] += len(out)
            return out

        return run

    for name in ("collect", "toPandas", "toLocalIterator", "toArrow"):
        monkeypatch.setattr(frame, name, counted(getattr(frame, name)))
    monkeypatch.setattr(common, "PIECE", piece)
    keys = np.random.default_rng(1).integers(-(2**63), 2**63, n)
    got = common.bloom_of(spark.createDataFrame([(int(k),) for k in keys] + [(None,)], "h long"), "h")
    want = BlockedBloom(BlockedBloom.blocks_for(n))
    want.add(keys.view(np.uint64))
    assert got.n_blocks == want.n_blocks and (got.words == want.words).all() and (want.words != 0).sum() > 10_000
    assert rows[0] <= 50
    assert common.bloom_of(spark.createDataFrame([], "h long"), "h").words.sum() == 0


def test_licences(docs_of, odd, prose):
    texts = odd + [
        prose(30, 1) + "\nReleased under the MIT License.\n" + prose(20, 2),
        "// Licensed under the Apache License, Version 2.0 (the \"License\");",
        "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.",
        "Licensed under CC BY-NC 4.0.",
        "This text is licensed under the Foo Content License, edition 12.",
        "He has a driving license and a fishing license.",
        OTHER,
    ]
    got = {r["doc_id"]: r for r in licenses.license_scan(docs_of(texts)).collect()}
    n = len(odd)
    assert all(got[i]["licenses"] == [] for i in range(n))
    assert (got[n]["licenses"], got[n]["paragraphs"]) == (["mit"], [1])
    assert [got[n + i]["licenses"] for i in range(1, 5)] == [["apache-2.0"], ["gpl-3.0", "all-rights-reserved"], ["cc-by-nc-4.0"], ["unknown"]]
    assert got[n + 5]["licenses"] == [] and got[n + 6]["licenses"] == []
    assert licenses.license_scan(docs_of(texts).limit(0)).count() == 0


OTHER = "The version of the story that was released is free of the rights of others.\nTerms and conditions of the lease."


def test_licence_model_is_calibrated_on_what_it_has_not_seen():
    r = licenses.model().reliability
    assert r["right"] >= 0.95 and r["unseen_rejected"] > 0.95 and r["prose_none"] > 0.98 and r["found"] > 0.5


@pytest.mark.parametrize(
    "text, family",
    [
        ("SPDX-License-Identifier: MIT", "mit"),
        ("# SPDX-License-Identifier: GPL-2.0-only", "gpl-2.0"),
        ("Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz (CC BY 4.0).", "cc-by-4.0"),
        ("Redistribution and use in source and binary\nforms, with or without modification, are\npermitted provided that the following\nconditions are met:", "bsd"),
        ("This work is licensed under the Example Content License, version 7.", "unknown"),
        ("((((((((((All rights reserved.))))))))))", "all-rights-reserved"),
    ],
)
def test_licence_paragraphs(docs_of, text, family):
    assert set(licenses.license_scan(docs_of(["x\n\n" + text + "\n\ny"])).first()["licenses"]) == {family}


def brute_url(u):
    m = re.match(r"(?s)^.*?://([^/?#]*)([^?#]*)", u or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for text, v in urls.RULES:
        h, _, p = text.partition("/")
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[0])):
            best = (text, v)
    return host, path, best


def test_urls(spark):
    us = [None, "", "no scheme", "http://A.Example.com/en/7x", "http://com/en/", "http://xcom/en/", "https://x.net/de/1", "https://example.net/de/8?x", "https://notexample.net/de/8", "http://a.org/es/://b.com/en/", "http://spam-farm.org/x#y", "http://www.spam-farm.org/x/?utm_source=1", "://", "x://h?q", "http://a.com/en"]
    pages = spark.createDataFrame([(i, u, "h", "m") for i, u in enumerate(us)] + [(0, None, "h", "m")], "page_id long, url string, hit string, maybe string")
    listed = spark.createDataFrame([("spam-farm.org/x",), ("com/en/",), (None,)], "url string")
    got = urls.judge(pages, listed).collect()
    assert len(got) == len(us) + 1
    for r in got:
        host, path, best = brute_url(us[r["page_id"]])
        on_list = best is None and host in ("spam-farm.org", "www.spam-farm.org")
        assert (r["host"], r["path"], r["rule"]) == (host, path, best and best[0])
        assert r["verdict"] == (best[1] if best else "block" if on_list else "allow")
    assert urls.judge(pages.limit(0), listed).count() == 0 and urls.judge(pages, listed.limit(0)).count() == len(us) + 1


def test_benchmark_items_plain_and_with_other_slots(spark, docs_of, odd, prose):
    item = "A train leaves Berlin at 9 with 120 people and goes 80 km every hour so how far is Berlin after 9 hours of a ride"
    other = item.replace("Berlin", "Madrid").replace("9", "7").replace("120", "55").replace("80", "95")
    wrong = item.replace("leaves Berlin", "leaves Madrid").replace("9 with", "3 with").replace("is Berlin after 9", "is Rome after 8").replace("120", "44").replace("80", "60")
    texts = odd + [prose(40, 1) + " " + item + " " + prose(40, 2), other, wrong, prose(200, 3), " ".join(item.split()[:10])]
    items = spark.createDataFrame([(5, item, "x"), (6, item, "x"), (None, item, "x"), (7, None, "x"), (8, "too short", "x")], "item_id long, text string, kind string")
    got = {(r["doc_id"], r["kind"]): r for r in decontam.contaminated(docs_of(texts), items).collect()}
    n = len(odd)
    assert sorted(got) == [(n, "plain"), (n, "template"), (n + 1, "template")]
    assert {r["item_id"] for r in got.values()} == {5} and got[n, "plain"]["start_word"] == 40 and got[n, "plain"]["coverage"] == 1.0
    assert decontam.contaminated(docs_of(texts).limit(0), items).count() == 0
    assert decontam.contaminated(docs_of(texts), items.limit(0)).count() == 0


def test_canonical_words():
    a = np.frombuffer("The \"Car\" ran 5 km, -3.5% of 1,000.".encode(), np.uint8)
    t = decontam.canonical_words(a, np.array([0, len(a)]))[1]
    kind = {int(decontam.NUM): "#", int(decontam.NAME): "N", int(decontam.UNIT): "u"}
    assert "".join(kind.get(int(x), ".") for x in t) == ".N.#u#.#"


def brute_cosines(texts, y, query, df, n_docs):
    """Cosines of a query with all examples, from the texts alone."""
    bag = lambda t: Counter(x for w in re.findall(r"[^\W\d_]{2,}", t.lower()) for x in ([w, w[:4] + "-"] if len(w) > 4 else [w]))
    bags, n1, n0 = [bag(t) for t in texts], sum(y), len(y) - sum(y)
    has = [Counter(w for b, v in zip(bags, y) if v == c for w in b) for c in (0, 1)]

    def weight(w):
        a, b = has[1][w], has[0][w]
        p = (a + b) / (n1 + n0)
        z = abs((a + 0.5) / (n1 + 1) - (b + 0.5) / (n0 + 1)) / math.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
        return (math.log((1 + n_docs) / (1 + df[w])) + 1) * z * z / (z * z + 16)

    def vector(b):
        v = {w: (1 + math.log(n)) * weight(w) for w, n in b.items() if has[0][w] + has[1][w]}
        norm = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / norm for w, x in v.items()}

    q, vs = vector(bag(query)), [vector(b) for b in bags]
    return [sum(x * v.get(w, 0) for w, x in q.items()) for v in vs]


def test_nearest_examples_are_exact_and_toxic_texts_found(spark, prose):
    r = random.Random(2)
    bad = [f"vile{chr(97 + i)}" for i in range(8)]
    texts, y = [], []
    for i in range(600):
        w = prose(60, i, 300).split()
        toxic = i % 5 == 0
        if toxic:
            w[10:14] = r.sample(bad, 4)
        texts.append(" ".join(w))
        y.append(int(toxic))
    ix = toxicity.Index(texts[:450], y[:450], list(range(450)), 0.2)
    assert set(bad) <= set(ix.terms)
    df = Counter(w for t in texts[:450] for w in toxicity.words(t))
    for t in texts[450:470]:
        rows, cos = ix.nearest([ix._query(t)], 10)[0]
        want = brute_cosines(texts[:450], y[:450], t, df, 450)
        assert np.allclose(cos, sorted(want, reverse=True)[:10]) and np.allclose(cos, [want[ix.ids[r]] for r in rows])
    docs = spark.createDataFrame([(i, t, "q", 0.5) for i, t in enumerate([*texts, None, ""])], "doc_id long, text string, evidence string, score double")
    labels = spark.createDataFrame([(i, v) for i, v in enumerate(y)] + [(3, None), (None, 1), (10**6, 1)], "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.toxicity(docs, labels).collect()}
    held = [i for i in range(600) if got[i]["held_out"]]
    assert 90 < len(held) < 220
    assert np.mean([got[i]["predicted"] == y[i] for i in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[600]["score"] == got[601]["score"] < 0.3
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0
    assert {r["score"] for r in toxicity.toxicity(docs.limit(3), labels.limit(0)).collect()} == {0.0}


def test_chains_find_the_best_collinear_run():
    """Scores against the quadratic recurrence."""
    r = np.random.default_rng(3)
    k, gap = substrings.K, substrings.GAP
    for _ in range(40):
        n = int(r.integers(2, 40))
        pos, apos = r.integers(0, 120, n), r.integers(0, 120, n)
        order = sorted(range(n), key=lambda i: (pos[i], -apos[i]))
        step = lambda a, b: min(k, pos[b] - pos[a], apos[b] - apos[a]) - gap * (pos[b] - pos[a] + apos[b] - apos[a])
        best = [float(k)] * n
        for x, i in enumerate(order):
            prev = [(best[j] + gap * float(pos[j] + apos[j]), j) for j in order[:x] if pos[j] < pos[i] and apos[j] < apos[i]]
            if prev:
                v, j = max(prev)
                if v - gap * (pos[i] + apos[i]) > 0:
                    best[i] = min(k, pos[i] - pos[j], apos[i] - apos[j]) + v - gap * (pos[i] + apos[i])
        got = substrings.chains(pos, apos)
        for c in got:
            assert all(pos[a] < pos[b] and apos[a] < apos[b] for a, b in zip(c, c[1:]))
        if got and max(best) > k:
            assert max(k + sum(step(a, b) for a, b in zip(c, c[1:])) for c in got) >= max(best) - 1e-6


def test_repeated_passages(docs_of, odd, prose):
    p, q = prose(70, 50, 4000), prose(60, 51, 4000).split()
    edited = list(q)
    for i in (9, 21, 38, 50):
        edited[i] = f"edit{i}"
    del edited[30]
    fill = lambda i, n=80: prose(n, 100 + i, 4000)
    texts = odd + [fill(0) + " " + p + " " + fill(1), fill(2) + " " + p, p + " " + fill(3), fill(4) + " " + " ".join(q), " ".join(edited) + " " + fill(5), fill(6, 200), fill(7) + " " + " ".join(p.split()[:40])]
    n = len(odd)
    rows = substrings.repeated_passages(docs_of(texts)).collect()
    pairs = {(r["doc_id"], r["source_doc_id"]) for r in rows}
    assert pairs == {(n + 1, n), (n + 2, n), (n + 4, n + 3)}
    by = {r["doc_id"]: r for r in rows}
    assert (by[n + 1]["start_word"], by[n + 1]["end_word"], by[n + 1]["source_start"]) == (80, 150, 80) and by[n + 1]["identity"] == 1.0
    assert by[n + 4]["start_word"] <= 2 and by[n + 4]["end_word"] >= 57 and 0.8 < by[n + 4]["identity"] < 1
    kept = {r["doc_id"]: r for r in substrings.without_repeats(docs_of(texts)).collect()}
    assert kept[n]["text"] == texts[n] and W.findall(kept[n + 1]["text"]) == texts[n + 1].split()[:80] and kept[n + 1]["n_chars"] == len(kept[n + 1]["text"])
    assert W.findall(kept[n + 2]["text"]) == texts[n + 2].split()[70:] and len(kept) == len(texts)
    assert substrings.repeated_passages(docs_of(texts).limit(0)).count() == 0


def test_whole_copies_go(docs_of, prose):
    t = prose(120, 1, 3000)
    assert [r["doc_id"] for r in substrings.without_repeats(docs_of([t, t, t])).collect()] == [0]


@pytest.mark.parametrize("shift", [0, 3])
def test_cyclic_texts(docs_of, shift):
    t = ("alpha beta gamma delta epsilon zeta eta theta iota kappa " * 12).split()
    got = substrings.repeated_passages(docs_of([" ".join(t), " ".join(t[shift:])])).collect()
    covered = {i for r in got for i in range(r["start_word"], r["end_word"])}
    assert len(covered) >= len(t) - shift - 10  # a cycle at an end has no counterpart at its shift


@pytest.mark.parametrize("equal, other", [(60, 80), (200, 150)])
def test_two_passages_around_other_text(docs_of, prose, equal, other):
    p, q = prose(equal, 60, 4000), prose(equal, 61, 4000)
    texts = [p + " " + prose(other, 62 + i, 4000) + " " + q for i in range(2)]
    rows = sorted(substrings.repeated_passages(docs_of(texts)).collect(), key=lambda r: r["start_word"])
    assert [(r["doc_id"], r["source_doc_id"], r["start_word"], r["end_word"]) for r in rows] == [(1, 0, 0, equal), (1, 0, equal + other, 2 * equal + other)]


def test_parts_hold_every_like_run_of_a_chain():
    r = np.random.default_rng(5)
    for _ in range(60):
        n = int(r.integers(2, 30))
        p, q = np.cumsum(r.integers(1, 25, n)), np.cumsum(r.integers(1, 25, n))
        m = np.cumsum(np.r_[0, np.minimum(np.diff(p), np.diff(q)).clip(0, 5)])
        ok = lambda i, j: 5 + m[j] - m[i] >= 0.8 * max(p[j] - p[i] + 5, q[j] - q[i] + 5) - 1e-6
        got = substrings.parts(m, p, q, 0.8)
        held = {t for i, j in got for t in range(i, j + 1)}
        assert all(ok(i, j) for i, j in got) and held == set(range(n))
        far = [max(j for j in range(i, n) if ok(i, j)) for i in range(n)]
        assert {j for _, j in got} <= set(far)


def test_passage_whose_seeds_are_in_several_lower_documents(docs_of, prose):
    p = prose(60, 70, 4000).split()
    fill = lambda i, n=70: prose(n, 71 + i, 4000).split()
    texts = [" ".join(x) for x in (fill(0) + p[:30] + fill(1), fill(2) + p[27:] + fill(3), fill(4) + p + fill(5), p + fill(6), fill(7, 60) + p)]
    rows = sorted(tuple(r)[:6] for r in substrings.repeated_passages(docs_of(texts)).collect())
    assert rows == [(3, 0, 60, 2, 70, 130), (4, 60, 120, 2, 70, 130)]


def test_every_window_of_a_lower_document_is_covered(docs_of, prose):
    """Against brute force, on documents pasted together from a few passages and common phrases."""
    r = random.Random(8)
    pool = [prose(r.randint(12, 90), 200 + i, 3000).split() for i in range(14)]
    texts = []
    for i in range(24):
        w = prose(12, 300 + i, 3000).split()
        for _ in range(5):
            x = r.choice(pool)
            a = r.randint(0, len(x) // 3)
            w += x[a : a + r.randint(10, 90)] + (prose(3, 400 + i, 3000).split() if r.random() < 0.5 else [])
        texts.append(w)
    covered = {i: set() for i in range(len(texts))}
    for d in substrings.repeated_passages(docs_of([" ".join(t) for t in texts])).collect():
        covered[d["doc_id"]].update(range(d["start_word"], d["end_word"]))
    lower, shared = set(), 0
    for i, t in enumerate(texts):
        own = [tuple(t[j : j + 50]) for j in range(len(t) - 49)]
        for j, x in enumerate(own):
            if x in lower:
                shared += 1
                assert set(range(j, j + 50)) <= covered[i]
        lower.update(own)
    assert shared > 20


def test_benchmark_items_with_words_put_in_or_left_out(spark, docs_of, prose):
    plain = prose(20, 80, 4000).split()
    short = prose(18, 84, 4000).split()
    item = "A train leaves Berlin at 9 with many people and goes fast to Berlin where it stays until noon"
    texts = [
        prose(30, 81) + " " + " ".join(plain[:10] + ["added"] + plain[10:]) + " " + prose(30, 82),
        " ".join(plain[:10] + plain[11:]),
        " ".join(short[:9] + ["added"] + short[9:]),
        item.replace("Berlin", "New York").replace("9", "9 000"),
        prose(200, 83),
    ]
    items = spark.createDataFrame([(1, " ".join(plain)), (2, item), (3, " ".join(short))], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["kind"]): r for r in decontam.contaminated(docs_of(texts), items).collect()}
    assert sorted(got) == [(0, 1, "plain"), (1, 1, "plain"), (2, 3, "plain"), (3, 2, "template")]
    assert (got[0, 1, "plain"]["start_word"], got[0, 1, "plain"]["end_word"]) == (30, 51)
    r = got[3, 2, "template"]
    assert (r["start_word"], r["end_word"], r["coverage"], r["consistency"]) == (0, 22, 1.0, 1.0)


def test_units_only_after_numbers_spelt_numbers_and_capitals():
    text = "In a house in the city Łódź m is seven apples or 5 m wide!!!!!!!!!!!!"
    a = np.frombuffer(text.encode(), np.uint8)
    t = decontam.canonical_words(a, np.array([0, len(a)]))[1]
    kind = {int(decontam.NUM): "#", int(decontam.NAME): "N", int(decontam.UNIT): "u"}
    assert "".join(kind.get(int(x), ".") for x in t) == "......N..#..#u."


def test_short_items_match_whole_lines_and_sentences(spark, docs_of, prose):
    items = spark.createDataFrame([(1, "Who wrote it?"), (2, "Paris"), (3, "a b c d e f g")], "item_id long, text string")
    texts = [prose(20, 1) + ".\nWho wrote it?\n" + prose(20, 2), "They asked who wrote it and why. " + prose(9, 3), "It is in Paris now.", "x. Paris. y", "a b c d e f g", "a b c d e f g h", None]
    got = sorted((r["doc_id"], r["item_id"], r["kind"]) for r in decontam.contaminated(docs_of(texts), items).collect())
    assert got == [(0, 1, "plain"), (3, 2, "plain"), (4, 3, "plain")]


@pytest.mark.parametrize("n", [40, 160])
def test_edited_passages_are_found_at_two_sizes(docs_of, prose, n):
    """Recall against what was planted: each passage in two documents, with every tenth word changed in one of them."""
    r = random.Random(n)
    texts = []
    for i in range(n):
        p = prose(70, 1000 + i, 5000).split()
        q = [f"e{i}x{j}" if j % 10 == 7 else w for j, w in enumerate(p)]
        texts += [" ".join([*prose(40, 5000 + 2 * i + s, 5000).split(), *x, *prose(40, 9000 + 2 * i + s, 5000).split()]) for s, x in enumerate((p, q))]
    order = list(range(len(texts)))
    r.shuffle(order)
    rows = substrings.repeated_passages(docs_of([texts[i] for i in order])).collect()
    found = {tuple(sorted((order[x["doc_id"]], order[x["source_doc_id"]]))) for x in rows}
    assert sum((2 * i, 2 * i + 1) in found for i in range(n)) >= 0.9 * n
    assert all(b == a + 1 and a % 2 == 0 for a, b in found)


def test_items_of_one_template_are_compared_each(spark, docs_of):
    """A document that is consistent with one item and not with the smallest of its template."""
    text = "the train from {} goes slowly to {} and then the bus from {} goes quickly back to {} in the end"
    first, second = text.format("Berlin", "Rome", "Berlin", "Rome"), text.format("Paris", "Oslo", "Vienna", "Lisbon")
    items = spark.createDataFrame([(1, first), (2, second), (3, second + "."), (4, second), (5, None)], "item_id long, text string")
    texts = [text.format("Madrid", "Kyiv", "Dublin", "Prague"), first, second]
    got = {(r["doc_id"], r["item_id"], r["kind"]) for r in decontam.contaminated(docs_of(texts), items).collect()}
    assert {(0, 2, "template"), (1, 1, "plain"), (1, 1, "template"), (2, 2, "plain"), (2, 2, "template")} <= got
    assert (0, 1, "template") not in got and {x[1] for x in got} <= {1, 2}
    assert sorted(tuple(r) for r in decontam.item_classes(items).collect()) == [(1, 1), (2, 2), (3, 2), (4, 2)]


def test_an_occurrence_beside_another_one_is_found(spark, docs_of):
    """An edited consistent one, of two diagonals that do not suffice, right behind a part with other fillings and more of the hits."""
    item = "from Berlin we walked on to Rome over hills and from there to Oslo by ship all alone"
    other = "from Paris we walked on to Paris over hills and from there"
    edited = "from Kyiv we walked on to Madrid over hills very slowly and from there to Dublin by ship all alone"
    items = spark.createDataFrame([(1, item)], "item_id long, text string")
    got = {r["doc_id"] for r in decontam.contaminated(docs_of([edited, other + " . . " + edited]), items).where("kind = 'template'").collect()}
    assert got == {0, 1}
    pos, ipos = [0, 1, 2, 3, 4, 20, 21, 29, 30], [0, 1, 2, 3, 4, 0, 1, 8, 9]
    assert decontam.rising(pos, ipos) == [0, 1, 2, 3, 4, 7, 8]
    assert decontam.nearest(pos, ipos, 100) == [[0, 1, 2, 3, 4], [5, 6, 7, 8]]
    assert decontam.nearest([0, 0, 1, 1, 2, 2], [6, 2, 7, 3, 8, 4], 100) == [[0, 2, 4], [1, 3, 5]]
