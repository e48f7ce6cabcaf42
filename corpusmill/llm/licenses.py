"""Licence scans: a trained paragraph classifier, with a calibrated unknown class and a template comparison.

Paragraphs are lines, and runs of lines between blank ones where no line of a run is a licence by
itself; so a licence that is wrapped over lines is read as a whole. Features are the word 1- to
3-grams of a paragraph, sparse and binary. A multinomial logistic regression over the licence
families and `none` is trained on variants (openings, endings, dropped words) of the paragraphs in
license_texts.py.

Calibration never sees what the model was trained on. In each of FOLDS rounds a part of the
templates, with all their variants, and whole kinds of licences (all GNU ones, all Creative Commons
ones, and so on) are left out, of training and of the comparison; two more variants of every
template are never trained on. Left-out templates of known families and left-out prose set the
temperature (least log loss). The least probability and the least likeness of a family are the pair
that confirms the most left-out paragraphs, while at least the share RIGHT of those that it confirms
are of the family; those of left-out kinds, which are licences of no known family, are among them.
Model.reliability has the figures.

A paragraph whose most probable class is a family is of that family if the family has the least
probability or more and the least likeness or more: the share of the shorter one's 2-grams that the
paragraph and a template of the family both have. Otherwise it is `unknown` if the probability of
`none` is below that of all but the share FALSE of left-out prose.

The model depends on constants alone, so it is the same at every size; it is trained once on the
driver (a few hundred paragraphs) and broadcast.

Defined results: null and empty texts have no paragraphs; every document gets one row, with
empty lists where nothing is found; a null doc_id stays null; repeated rows are scanned each; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import IS_SPACE, U64, lean, mix, slices, table, text_buffer, word_bounds, word_hashes
from corpusmill.llm.decontam import bare
from corpusmill.llm.license_texts import COMMON, OTHER, TEMPLATES

#: Least share of right ones among the paragraphs confirmed as a family, for which thresholds are fitted.
RIGHT = 0.95
NONE, UNKNOWN = "none", "unknown"
FOLDS, FRESH, MIXED, ROUNDS, RATE, DECAY, PRIOR = 4, 2, 60, 120, 1.5, 1e-4, 2.0
#: Share of prose that may be taken for a licence of no known family.
FALSE = 0.005
_OPEN = ("", "", "", "Copyright 2019 the authors.", "Note:", "(c) 2021 Jane Doe.", "*", "//", "#", "License:")
_CLOSE = ("", "", "", "See LICENSE for details.", "Thank you.", "More text follows here.")
_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?()[]{}<>\"'`|*#/-")] = True


def _words(data: np.ndarray, offsets: np.ndarray):
    """Hashes and paragraph numbers of the words, without punctuation at their edges."""
    s, t, line = word_bounds(data, offsets)
    s, t = bare(data, s, t, _EDGE)
    ok = s < t
    return word_hashes(data, s[ok], t[ok]), line[ok]


def _grams(w: np.ndarray, line: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    if n == 1:
        return mix(w + U64(1)), line
    m = len(w) - n + 1
    if m <= 0:
        return w[:0], line[:0]
    h = np.full(m, U64(n), U64)
    for j in range(n):
        h = mix(h * U64(0x9E3779B97F4A7C15) + w[j : j + m])
    ok = line[:m] == line[n - 1 :]
    return h[ok], line[:m][ok]


def _of_text(text: str) -> list[np.ndarray]:
    data = np.frombuffer(text.encode(), np.uint8)
    w, line = _words(data, np.array([0, len(data)]))
    return [_grams(w, line, n)[0] for n in (1, 2, 3)]


def _variants(rng: np.random.Generator) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """(bags of n-grams, sets of 2-grams, classes, template numbers) of the training paragraphs; the first of a template is the template itself."""
    bags, pairs, y, group = [], [], [], []
    none, g = len(TEMPLATES), 0
    for c, texts in [*enumerate(TEMPLATES.values()), (none, OTHER)]:
        for text in texts:
            words = text.split()
            made = [text]
            for _ in range(FRESH + 9):
                some = [x for x in words if rng.random() > 0.06] if len(words) > 6 else words
                if c == none and rng.random() < 0.5:
                    some = rng.permutation(words).tolist()
                made.append(" ".join((_OPEN[rng.integers(len(_OPEN))], *some, _CLOSE[rng.integers(len(_CLOSE))])))
            for x in made:
                grams = _of_text(x)
                bags.append(np.unique(np.concatenate(grams)))
                pairs.append(np.unique(grams[1]))
                y.append(c)
                group.append(g)
            g += 1
    for words in COMMON.values():
        for _ in range(MIXED):
            grams = _of_text(" ".join(rng.choice(words, int(rng.integers(4, 60)))))
            bags.append(np.unique(np.concatenate(grams)))
            pairs.append(np.unique(grams[1]))
            y.append(none)
            group.append(g)
            g += 1
    return bags, pairs, np.array(y), np.array(group)


def likeness(pairs: np.ndarray, templates: list[np.ndarray]) -> float:
    """The largest share of the shorter one's 2-grams that the paragraph and a template both have."""
    return max((len(np.intersect1d(pairs, t, assume_unique=True)) / max(1, min(len(pairs), len(t))) for t in templates), default=0.0)


class Model:
    """Weights by n-gram hash, temperature and threshold, and the templates' 2-grams."""

    def __init__(self):
        rng = np.random.Generator(np.random.PCG64(7))
        self.names = [*TEMPLATES, NONE]
        bags, pairs, y, group = _variants(rng)
        none, start = len(TEMPLATES), np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
        fresh = np.isin(np.arange(len(y)) - start[group], (1, FRESH))
        kinds = [next((k for k in ("gpl", "cc-by") if k in n), n) for n in TEMPLATES]
        kind = np.array([sorted(set(kinds)).index(k) for k in kinds] + [-1])[y]
        # left-out evidence: logits, likeness by class, the true class (-1: a family that the model did not know)
        logits, truth, like, new = [], [], [], []
        for f in range(FOLDS):
            unseen = (y < none) & (kind % FOLDS == f)
            held = ~unseen & ((group * 7 + group // 5) % FOLDS == f)
            train = ~unseen & ~held & ~fresh
            keys, w, bias = self._train([bags[i] for i in np.flatnonzero(train)], y[train])
            old = {c: [pairs[i] for i in start if train[i] and y[i] == c] for c in range(none)}
            for i in np.flatnonzero(unseen | held | fresh):
                z = w[np.flatnonzero(np.isin(keys, bags[i], assume_unique=True))].sum(0) + bias
                z[[c for c, t in old.items() if not t]] = -1e9
                logits.append(z)
                truth.append(-1 if unseen[i] else y[i])
                new.append(held[i])
                like.append(likeness(pairs[i], old[int(z.argmax())]) if z.argmax() < none else 0.0)
        z, truth, like = np.array(logits), np.array(truth), np.array(like)
        known = (truth >= 0) & np.array(new)
        loss = lambda t: -np.log(self._soft(z[known] / t)[np.arange(known.sum()), truth[known]] + 1e-9).mean()
        self.temperature = min((0.25 * 1.1**i for i in range(40)), key=loss)
        p = self._soft(z / self.temperature)
        best, top = p.argmax(1), p.max(1)
        fits = (best < none) & (best == truth)
        choices = []
        for alike in np.arange(0.5, 1.0, 0.05):
            for least in np.arange(0.05, 0.95, 0.01):
                taken = (best < none) & (like >= alike) & (top >= least)
                if taken.any() and fits[taken].mean() >= RIGHT:
                    choices.append((int(fits[taken].sum()), -alike, -least))
        _, alike, least = max(choices, default=(0, -1.0, -0.95))
        self.alike, self.sure = -float(alike), -float(least)
        sure = (best < none) & (like >= self.alike) & (top >= self.sure)
        good = sure & fits
        # what `none` may have at most, so that few left-out paragraphs of prose pass for an unknown licence
        self.none = float(np.quantile(p[truth == none, -1], FALSE, method="lower"))
        #: Shares of left-out paragraphs: right among those confirmed as a family, fresh variants of known templates found, paragraphs of unknown families not confirmed as another, prose taken for none.
        self.reliability = {"right": float(good[sure].mean()) if sure.any() else 1.0, "confirmed": int(sure.sum()), "found": float((sure & good)[(truth >= 0) & (truth < none) & ~np.array(new)].mean()), "unseen_rejected": float(1 - sure[truth < 0].mean()), "prose_none": float((p[:, -1] >= self.none)[truth == none].mean()), "none": self.none, "sure": self.sure, "alike": self.alike, "temperature": self.temperature}
        self.keys, self.w, self.bias = self._train(bags, y)
        # a first test by the hash's upper bits spares nearly all n-grams of ordinary text the search
        self.first = np.zeros(1 << 16, bool)
        self.first[(self.keys >> U64(48)).astype(np.int64)] = True
        self.templates = {c: [pairs[i] for i in start if y[i] == c] for c in range(none)}

    def _train(self, bags: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(n-grams of three paragraphs or more, weights, biases) by gradient descent with momentum."""
        keys, n = np.unique(np.concatenate(bags), return_counts=True)
        keys = keys[n >= 3]
        x = np.zeros((len(bags), len(keys)), np.float32)
        for i, b in enumerate(bags):
            x[i, np.flatnonzero(np.isin(keys, b, assume_unique=True))] = 1
        target = np.eye(len(self.names), dtype=np.float32)[y]
        w, bias = np.zeros((len(keys), len(self.names)), np.float32), np.zeros(len(self.names), np.float32)
        bias[-1] = PRIOR  # a paragraph with nothing known in it is no licence
        step = np.zeros_like(w)
        for _ in range(ROUNDS):
            p = self._soft(x @ w + bias)
            step = 0.9 * step - RATE * (x.T @ (p - target) / len(bags) + DECAY * w)
            w += step
        return keys, w, bias

    @staticmethod
    def _soft(z):
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, str, float, float]]:
        """(paragraph, family or unknown, probability, likeness) of the paragraphs that are licences."""
        w, line = _words(data, offsets)
        found, rows = [], []
        for n in (1, 2, 3):
            h, at = _grams(w, line, n)
            ok = self.first[(h >> U64(48)).astype(np.int64)]
            h, at = h[ok], at[ok]
            i = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            ok = self.keys[i] == h
            found.append(i[ok])
            rows.append(at[ok])
        found, rows = np.concatenate(found), np.concatenate(rows)
        if not len(rows):
            return []
        both = np.unique(rows * np.int64(len(self.keys)) + found)
        both, found = both // len(self.keys), both % len(self.keys)
        lines, start = np.unique(both, return_index=True)
        p = self._soft((np.add.reduceat(self.w[found], start, axis=0) + self.bias) / self.temperature)
        best = p.argmax(1)
        out = []
        for k in np.flatnonzero(best < len(self.names) - 1):
            a, b = np.searchsorted(line, lines[k]), np.searchsorted(line, lines[k], "right")
            pairs = np.unique(_grams(w[a:b], line[a:b], 2)[0])
            c = int(best[k])
            like = likeness(pairs, self.templates[c])
            sure = p[k, c] >= self.sure and like >= self.alike
            if sure or p[k, -1] < self.none:
                out.append((int(lines[k]), self.names[c] if sure else UNKNOWN, float(p[k, c]), float(like)))
        return out


@functools.cache
def model() -> Model:
    return Model()


def paragraphs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the lines, none of which spans documents, and the document of each."""
    cuts = np.unique(np.concatenate([offsets, np.flatnonzero(data == 0x0A) + 1]))
    return cuts, np.searchsorted(offsets, cuts[:-1], "right") - 1


def blocks(data: np.ndarray, cuts: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Numbers of the lines that begin a run of lines with words, of one document."""
    full = np.r_[0, np.cumsum(~IS_SPACE[data])]
    blank = full[cuts[1:]] == full[cuts[:-1]]
    new = np.r_[True, doc[1:] != doc[:-1]][: len(doc)] | np.r_[True, blank[:-1]][: len(doc)] | blank
    return np.flatnonzero(new)


_OUT = "doc_id long, licenses array<string>, paragraphs array<long>, probabilities array<double>, likeness array<double>"


def _scan(shared):
    def run(batches):
        m = shared.value
        for b in batches:
            data, off = text_buffer(b.column("text"))
            for i, j in slices(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                cuts, doc = paragraphs(part, o)
                first = np.searchsorted(doc, np.arange(j - i))
                got: list[list] = [[] for _ in range(j - i)]
                rows = m.scan(part, cuts)
                begin = blocks(part, cuts, doc)
                size = np.diff(np.r_[begin, len(doc)])
                # runs of several lines, none of which is a known licence by itself
                known = np.zeros(len(doc) + 1, np.int64)
                known[1:] = np.cumsum(np.isin(np.arange(len(doc)), [r[0] for r in rows if r[1] != UNKNOWN]))
                open_ = (size > 1) & (known[begin + size] == known[begin])
                if open_.any():
                    ends = np.r_[begin, len(doc)]
                    whole = [(int(begin[x]), *r) for x, *r in m.scan(part, cuts[ends]) if open_[x] and r[0] != UNKNOWN]
                    inside = {line for x, *_ in whole for line in range(x, x + int(size[np.searchsorted(begin, x)]))}
                    rows = sorted([r for r in rows if r[0] not in inside] + whole)
                for line, name, p, like in rows:
                    d = int(doc[line])
                    got[d].append((name, line - int(first[d]), p, like))
                cols = [b.column("doc_id").slice(i, j - i)]
                cols += [pa.array([[x[k] for x in g] for g in got], pa.list_(t)) for k, t in enumerate((pa.string(), pa.int64(), pa.float64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "licenses", "paragraphs", "probabilities", "likeness"])

    return run


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, and per licence paragraph its family, number, probability and likeness to a template."""
    shared = docs.sparkSession.sparkContext.broadcast(model())
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_scan(shared)), _OUT)


def op1_license_scan(spark, sf_dir: str) -> DataFrame:
    """Licence paragraphs of all documents."""
    x = license_scan(table(spark, sf_dir, "documents"))
    return x.select("doc_id", F.size("licenses").cast("long").alias("n_paragraphs"), F.array_sort(F.array_distinct("licenses")).alias("families"), F.round(F.coalesce(F.array_max("probabilities"), F.lit(0.0)), 6).alias("probability"), "paragraphs")


