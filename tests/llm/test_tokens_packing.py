import os
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusmill.llm import packing, tokens

PATH = tokens.default_vocabulary() if os.path.isdir("/opt/tokenizers") else None
pytestmark = pytest.mark.skipif(PATH is None, reason="no vocabulary files here")
if PATH:
    from tokenizers import Tokenizer

    LIB = Tokenizer.from_file(PATH)

ALPHABET = list("aabet  \n\n\t'rsvelld!.?09éßçñ²ª½日本ы😀  \x1c\x85​́") + ["'re", "'ll", "<|endoftext|>", "<|end", "  ", "the", " ing"]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=25).map("".join))
def test_every_prefix_count_is_the_librarys(text):
    got = tokens.Encoder.of(PATH).counts(text)
    assert got.tolist() == [len(LIB.encode(text[: i + 1], add_special_tokens=False).ids) for i in range(len(text))]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_ids_are_the_librarys(text):
    assert tokens.Encoder.of(PATH).ids(text).tolist() == LIB.encode(text, add_special_tokens=False).ids


def test_every_token_is_reached_by_its_merges():
    enc = tokens.Encoder.of(PATH)
    for b, t in list(enc.vocab.items())[::37]:
        try:
            s = b.decode()
        except UnicodeDecodeError:
            continue
        assert enc.ids(s).tolist() == LIB.encode(s, add_special_tokens=False).ids


def test_token_table(docs_of, odd):
    got = {r["doc_id"]: r for r in tokens.token_counts(docs_of(odd), PATH).collect()}
    for i, t in enumerate(odd):
        n = len(LIB.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((t or "").encode()), n, n > 512)
    assert tokens.token_counts(docs_of(odd).limit(0), PATH).count() == 0


def test_budget_questions(docs_of, prose):
    text = prose(50, 2) + "  \n<|endoftext|>'ll"
    x = tokens.prefix_counts(docs_of([text, None]), PATH)
    r = x.select("doc_id", tokens.tokens_before(F.col("counts"), F.lit(20)).alias("n"), tokens.longest_within(F.col("counts"), F.lit(17)).alias("c")).orderBy("doc_id").collect()
    count = lambda n: len(LIB.encode(text[:n], add_special_tokens=False).ids)
    assert r[0]["n"] == count(20) and r[0]["c"] == max(n for n in range(len(text) + 1) if count(n) <= 17)
    assert (r[1]["n"], r[1]["c"]) == (0, 0)


def check_pieces(rows, texts, size):
    by_doc, by_seq = {}, {}
    for r in rows:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert sorted(by_doc) == list(range(len(texts)))
    for i, t in enumerate(texts):
        ids = np.array([*LIB.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for r in sorted(by_doc[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= size
    return by_seq


def test_packing(docs_of, odd, prose):
    texts = odd + [prose(n, n) for n in (10, 50, 300, 301, 500, 900, 900, 900)] * 3
    seqs = check_pieces(packing.pack(docs_of(texts), PATH, 512).collect(), texts, 512)
    total = sum(r["length"] for s in seqs.values() for r in s)
    assert len(seqs) <= total / 512 * 1.15 + 1
    assert packing.pack(docs_of(texts).limit(0), PATH).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 50), max_size=20))
def test_plan_places_every_piece_once(histogram):
    p = packing.plan(histogram, 64)
    length = np.repeat(list(histogram), list(histogram.values())).astype(np.int64)
    rank = np.concatenate([np.arange(n) for n in histogram.values()]) if histogram else np.zeros(0, np.int64)
    seq, off = packing.locate(p, length, rank) if len(length) else (length, length)
    used = {}
    for s, o, n in zip(seq.tolist(), off.tolist(), length.tolist()):
        used.setdefault(s, []).append((o, n))
    for v in used.values():
        at = 0
        for o, n in sorted(v):
            assert o == at
            at += n
        assert at <= 64
