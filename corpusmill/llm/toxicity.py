"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max inverted index, and distance-weighted votes.

Examples are a bounded sample of the labelled rows that may be learned from: at most POSITIVES
and NEGATIVES, the least by a hash, as far as EXAMPLE_CHARS characters of text in all go. Terms
are all their words and the first PREFIX letters of longer words, which catch inflected forms; no
term is left out. A term's weight is (1 + ln count) * IDF over all documents * relevance, where
relevance = z^2 / (z^2 + Z^2) for the z-score of the term's shares in the two classes; so words that
say nothing of the label weigh little, but none is cut. Vectors have length 1, and their products
are cosines.

The index holds each term's postings in blocks of examples, with the largest weight of the term in
each block; terms of many examples have full rows, which are added up first. For a text, the largest
such sum in a block and the sum of query weight times block maximum bound every cosine in it.
The HEAD blocks of the highest bounds are scored in full, then every block whose bound exceeds the
K-th best cosine so far; so the K nearest are exact (ties go to the earlier example). Votes are
weighted by 1 / (distance + EPS) and by the classes' shares among all labelled rows, and become
probabilities by a monotone map fitted on the votes that examples get from the other folds. The nearest examples
are returned as evidence.

Every whole text is scored; a text without any term gets the share of toxic rows. Labels, language,
source and doc_id are not read by the score.

Defined results: null text = empty text; labels that are null are ignored, and rows that
contradict each other count as toxic if at least half say so; repeated rows and rows without a
doc_id are scored alike; without any toxic or any other example the score is the share of toxic
rows (0 without labels); empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, materialize, table

POSITIVES, NEGATIVES, EXAMPLE_CHARS = 1024, 1024, 64_000_000
K, EPS, BLOCK, HEAD, FOLDS = 24, 0.05, 64, 6, 4
PREFIX, Z = 4, 4.0
_WORD = re.compile(r"[^\W\d_]{2,}")
#: The same for texts of one-byte code points, in lower case.
_LATIN, _NOT_LATIN = re.compile(r"[a-zªµºß-öø-ÿ]{2,}"), re.compile(r"[^\x00-\xff]")
#: Terms of this share of the examples have their weights in full rows.
DENSE = 1 / 16
#: Words whose terms a worker keeps.
CACHE = 200_000


def split(text: str) -> list[str]:
    low = text.lower()
    return (_WORD if _NOT_LATIN.search(low) else _LATIN).findall(low)


def words(text: str) -> Counter:
    """Counts of a text's terms: its words, and the beginnings of its words of more than PREFIX letters."""
    found: Counter = Counter()
    for w, n in Counter(split(text)).items():
        found[w] += n
        if len(w) > PREFIX:
            found[f"{w[:PREFIX]}-"] += n
    return found


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """All numbers of the ranges [lo, hi), one range behind the other."""
    n = hi - lo
    ends = np.cumsum(n)
    return np.repeat(lo - np.r_[0, ends[:-1]], n) + np.arange(ends[-1] if len(ends) else 0)


class Index:
    """Terms, weights and postings of the labelled examples, and the map from votes to probabilities."""

    def __init__(self, texts: list[str], labels: list[int], ids: list[int], share: float, n_docs: int = 0, df: dict[str, int] | None = None, calibrate: bool = True):
        """df: documents with each term, of n_docs; by default those of the examples."""
        y, bags = np.array(labels, float), [words(t) if isinstance(t, str) else t for t in texts]
        self.share, self.terms, self._of = share, {}, {}
        n1, n0 = y.sum(), (1 - y).sum()
        self.usable = bool(n1 > 0 and n0 > 0)
        if not self.usable:
            return
        own = {1: Counter(), 0: Counter()}
        for b, c in zip(bags, labels, strict=True):
            own[c].update(b.keys())
        names = sorted(own[1].keys() | own[0].keys())
        self.terms = {w: i for i, w in enumerate(names)}
        a, b = (np.array([own[c][w] for w in names], float) for c in (1, 0))
        df, n_docs = (own[1] + own[0], len(texts)) if df is None else (df, n_docs)
        idf = np.log((1 + n_docs) / (1 + np.array([df.get(w, 0) for w in names], float))) + 1
        p = (a + b) / (n1 + n0)
        z = np.abs((a + 0.5) / (n1 + 1) - (b + 0.5) / (n0 + 1)) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-9)
        self.weights = np.maximum(idf, 1e-3) * z**2 / (z**2 + Z**2)
        vectors = [self._vector({self.terms[w]: n for w, n in x.items()}) for x in bags]
        full = [i for i, v in enumerate(vectors) if len(v[0])]
        # like examples side by side, so that block maxima are tight
        full.sort(key=lambda i: (labels[i], int(vectors[i][0][np.argmax(vectors[i][1])]), len(vectors[i][0]), i))
        self.y, self.ids = y[full], np.array(ids, np.int64)[full]
        self.weight = np.where(self.y == 1, share / n1, (1 - share) / n0)
        self.blocks = max(1, -(-len(full) // BLOCK))
        rows = np.concatenate([np.full(len(vectors[i][0]), r) for r, i in enumerate(full)]).astype(np.int64) if full else np.zeros(0, np.int64)
        cols, vals = (np.concatenate([vectors[i][k] for i in full]) if full else np.zeros(0, (np.int64, float)[k]) for k in (0, 1))
        times = np.bincount(cols, minlength=len(names))
        often = np.flatnonzero(times > max(1, DENSE * len(full)))
        self.row_of = np.full(len(names), -1)
        self.row_of[often] = np.arange(len(often))
        self.rows = np.zeros((len(often), self.blocks * BLOCK))
        of = self.row_of[cols]
        self.rows[of[of >= 0], rows[of >= 0]] = vals[of >= 0]
        cols, rows, vals = cols[of < 0], rows[of < 0], vals[of < 0]
        order = np.lexsort((rows, cols))
        cols, self.post_row, self.post_val = cols[order], rows[order], vals[order]
        # an entry is the run of a term's postings in one block
        key = cols * self.blocks + self.post_row // BLOCK
        start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
        self.entry_post = np.r_[start, len(key)]
        self.entry_block = key[start] % self.blocks
        self.entry_max = np.maximum.reduceat(self.post_val, start) if len(start) else np.zeros(0)
        self.term_entry = np.searchsorted(key[start] // self.blocks, np.arange(len(names) + 1))
        if calibrate:
            self._calibrate(bags, labels, n_docs, df)

    def _vector(self, bag: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.fromiter(bag.keys(), np.int64, len(bag))
        v = (1 + np.log(np.fromiter(bag.values(), float, len(bag)))) * self.weights[t]
        norm = np.sqrt((v * v).sum())
        return (t, v / norm) if norm else (t[:0], v[:0])

    def _query(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        bag: dict[int, int] = {}
        of = self._of
        for w, n in Counter(split(text)).items():
            got = of.get(w)
            if got is None:
                got = tuple(i for i in (self.terms.get(w), self.terms.get(f"{w[:PREFIX]}-") if len(w) > PREFIX else None) if i is not None)
                if len(of) > CACHE:
                    of.clear()
                of[w] = got
            for i in got:
                bag[i] = bag.get(i, 0) + n
        return self._vector(bag)

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int = K) -> list[tuple[np.ndarray, np.ndarray]]:
        """Rows and cosines of the k nearest examples of each query, nearest first; exact."""
        often = np.zeros((len(queries), len(self.rows)))
        for i, (t, v) in enumerate(queries):
            full = self.row_of[t]
            often[i, full[full >= 0]] = v[full >= 0]
        first = often @ self.rows if len(self.rows) else np.zeros((len(queries), self.blocks * BLOCK))
        return [self._nearest(t, v, cos, k) for (t, v), cos in zip(queries, first, strict=True)]

    def _nearest(self, t: np.ndarray, v: np.ndarray, cos: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """nearest() of one query, from the sums over the terms that have full rows."""
        rare = self.row_of[t] < 0
        t, v = t[rare], v[rare]
        lo, hi = self.term_entry[t], self.term_entry[t + 1]
        entry, w = _ranges(lo, hi), np.repeat(v, hi - lo)
        block = self.entry_block[entry]
        bound = cos.reshape(self.blocks, BLOCK).max(1) + np.bincount(block, w * self.entry_max[entry], self.blocks)
        order = np.argsort(-bound, kind="stable")

        def score(blocks: np.ndarray) -> None:
            now = np.zeros(self.blocks, bool)
            now[blocks] = True
            ok = np.flatnonzero(now[block])
            a, b = self.entry_post[entry[ok]], self.entry_post[entry[ok] + 1]
            post = _ranges(a, b)
            np.add(cos, np.bincount(self.post_row[post], np.repeat(w[ok], b - a) * self.post_val[post], len(cos)), out=cos)

        score(order[:HEAD])
        done = cos.reshape(self.blocks, BLOCK)[order[:HEAD]].ravel()
        least = np.partition(done, -k)[-k] if k <= len(done) else 0.0
        rest = order[HEAD:]
        rest = rest[bound[rest] >= max(least - 1e-9, 1e-300)]
        if len(rest):
            score(rest)
        # blocks that were left out have parts of cosines only, all of them below the k-th best
        out = np.setdiff1d(order[HEAD:], rest, assume_unique=True)
        cos.reshape(self.blocks, BLOCK)[out] = 0
        rows = np.flatnonzero(cos > 0)
        if len(rows) > 4 * k:
            rows = rows[cos[rows] >= np.partition(cos[rows], -k)[-k] - 1e-8]
        best = np.lexsort((rows, -np.round(cos[rows], 9)))[:k]
        return rows[best], cos[rows[best]]

    def _vote(self, rows: np.ndarray, cos: np.ndarray) -> float:
        w = self.weight[rows] / (np.maximum(1 - cos, 0) + EPS)
        return float((w * self.y[rows]).sum() / w.sum())

    def _calibrate(self, bags: list[Counter], labels: list[int], n_docs: int, df: dict[str, int]) -> None:
        """Isotonic regression (pool adjacent violators) of labels on votes that examples get from the other FOLDS - 1 folds."""
        x, y = np.full(len(bags), self.share), np.array(labels, float)
        for f in range(FOLDS):
            rest = [i for i in range(len(bags)) if i % FOLDS != f]
            other = Index([bags[i] for i in rest], [labels[i] for i in rest], rest, self.share, n_docs, df, calibrate=False)
            mine = range(f, len(bags), FOLDS) if other.usable else ()
            for i, (rows, cos) in zip(mine, other.nearest([other._vector({other.terms[w]: n for w, n in bags[i].items() if w in other.terms}) for i in mine]) if mine else (), strict=True):
                x[i] = other._vote(rows, cos) if len(rows) else self.share
        n1 = y.sum()
        weight = np.where(y == 1, self.share / n1, (1 - self.share) / (len(y) - n1))
        order = np.argsort(x, kind="stable")
        pools: list[list[float]] = []
        for i in order:
            pools.append([weight[i] * y[i], weight[i], x[i], x[i]])
            while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
                a = pools.pop()
                pools[-1] = [pools[-1][0] + a[0], pools[-1][1] + a[1], pools[-1][2], a[3]]
        self.at = np.array([z for p in pools for z in (p[2], p[3])] or [0.0])
        self.p = np.array([z for p in pools for z in (p[0] / p[1],) * 2] or [self.share])

    def scores(self, texts: list[str]) -> list[tuple[float, list[int]]]:
        """Probability of toxicity and the ids of the five nearest examples, for each text."""
        if not self.usable:
            return [(self.share, [])] * len(texts)
        out = []
        for rows, cos in self.nearest([self._query(t) for t in texts]):
            if not len(rows):
                out.append((self.share, []))
                continue
            vote = self._vote(rows, cos)
            # the map's ends get a little of the vote, so that no score is a bare 0 or 1
            out.append((float(0.98 * np.interp(vote, self.at, self.p) + 0.02 * vote), self.ids[rows[:5]].tolist()))
        return out

    def __getstate__(self):
        return self.__dict__ | {"_of": {}}


def _term_counts(terms):
    """(term number, documents with it) of the documents of a partition; at most one row a term."""

    def run(batches):
        known, of = terms.value, {}
        n = np.zeros(len(known), np.int64)
        for b in batches:
            for text in b.column("text"):
                got: set[int] = set()
                for w in set(split(text.as_py() or "")):
                    ids = of.get(w)
                    if ids is None:
                        ids = tuple(i for i in (known.get(w), known.get(f"{w[:PREFIX]}-") if len(w) > PREFIX else None) if i is not None)
                        if len(of) > CACHE:
                            of.clear()
                        of[w] = ids
                    got.update(ids)
                n[list(got)] += 1
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at])], ["i", "n"])

    return run


def fit(docs: DataFrame, labels: DataFrame) -> Index:
    """The index of a bounded sample of the labelled rows that may be learned from, with IDF over all documents."""
    y = labels.where("doc_id is not null and toxic is not null").where(F.crc32(F.col("doc_id").cast("string")) % 4 != 2)
    y = y.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in y.groupBy("y").agg(F.count("*").alias("n")).collect()}
    share = n.get(1, 0) / max(1, sum(n.values()))
    pick = lambda c, most: y.where(F.col("y") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    sample = pick(1, POSITIVES).unionByName(pick(0, NEGATIVES))  # at most POSITIVES + NEGATIVES ids: small enough to broadcast
    mine = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"))
    mine = materialize(mine)
    sizes = mine.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()  # as many as the sample
    upto = np.cumsum([r["n"] for r in sizes])
    kept = [r["doc_id"] for r, c in zip(sizes, upto, strict=True) if c <= EXAMPLE_CHARS]
    rows = mine.where(F.col("doc_id").isin(kept)).orderBy("doc_id").collect()
    # copies of one text are one example
    rows = list({(r["text"], r["y"]): r for r in reversed(rows)}.values())[::-1]
    texts = [r["text"] or "" for r in rows]
    names = sorted(set().union(*(words(t).keys() for t in texts)))
    terms = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(names)})
    counts = docs.select("text").mapInArrow(lean(_term_counts(terms)), "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toPandas()  # as many rows as the examples have terms
    df = {names[i]: int(c) for i, c in zip(counts["i"], counts["n"], strict=True)}
    terms.unpersist()
    return Index(texts, [r["y"] for r in rows], [r["doc_id"] for r in rows], share, docs.count(), df)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence (ids of the nearest examples)."""
    index = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def run(batches):
        x = index.value
        for b in batches:
            text = b.column("text")
            for i in range(0, len(text), 128):
                got = x.scores([t.as_py() or "" for t in text.slice(i, 128)])
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, 128), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.list_(pa.int64()))], ["doc_id", "score", "evidence"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, score double, evidence array<long>")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "evidence")


def op7_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents from the labels that may be learned from."""
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
