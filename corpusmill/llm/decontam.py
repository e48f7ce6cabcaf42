"""Benchmark decontamination by template canonicalisation.

Words are runs between ASCII white space, without surrounding punctuation, A-Z lower-cased. In
a template, numbers (in digits or words), names (words with a capital first letter, but for words of
SMALL, which open sentences) and units right after a number become typed placeholders. Windows of K words of the items, plain and as templates, are joined by hash with
the windows of all documents. Document windows are first tested against a Bloom filter of the
items' windows (bounded size), so only possible hits leave the scan.

Templates are taken word by word, and with runs of like placeholders as one slot, so that a slot may
be filled with any number of words. Hits on one diagonal (document position minus item position)
form an occurrence, and so do the most hits in the order of the item, each no further than the
item's length behind the last, and the runs in that order in which each hit follows the nearest one
before it, so that one occurrence does not spoil another beside it: words that were put in or left out only shift the rest. In a template
occurrence every filling of the item must become one filling of the document: of the fillings
that changed anywhere, their number over the number of what they became must reach CONSISTENT,
and the same in reverse. So an item with other numbers or names is caught, while a text that
merely has the same shape with unrelated fillings is not. An occurrence counts if it covers LEAST_WORDS words, or
LEAST_SHARE of the item's windows. Items with equal words and
placeholders with equal fillings are one class, reported by its smallest item_id; item_classes() has
the members. Items of one template with other fillings are compared each, as a document may be
consistent with one of them and not with another.

Items with fewer than K words have no window. They match as they are: where all their words, and no
others, make up a line or a sentence of a document.

Defined results: null texts are empty; items without a word match nothing; windows whose template has fewer than LITERALS literal words are matched as
plain words only; repeated documents are reported each; null ids are ignored on the item side
and reported as null on the document side; empty tables give no rows.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.expr import let
from corpusmill.llm.common import U64, bloom_of, lean, materialize, mix, share, slices, table, text_buffer, tidied, window_hashes, word_bounds, word_hashes

K, LITERALS, LEAST_WORDS, LEAST_SHARE, CONSISTENT = 8, 4, 13, 0.5, 0.8
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec second seconds min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent % c f k pa bar w kw v a hz khz mhz ghz b kb mb gb tb mph kmh meter meters metre metres mile miles inch inches foot feet gram grams kilogram kilograms liter liters litre litres".split()
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen half".split()
SMALL = "a an the this that these those each every all some any no if when while after before since because although as at by for from in into of on to with without and but or so then there here it he she they we you i his her their our its my your is are was were be has have had do does did can could will would should may might how what which who whom whose where why not find suppose let given calculate determine".split()

_EDGE = np.zeros(256, bool)
_EDGE[list(b".,;:!?()[]{}\"'`|")] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
#: Capital letters by their code point below 2,048, which is one or two bytes of UTF-8.
_UPPER = np.array([chr(c).isupper() for c in range(0x800)])
NUM, NAME, UNIT = (U64(x) for x in (0xA5A5000000000001, 0xA5A5000000000002, 0xA5A5000000000003))


def _hash_words(words: list[str]) -> np.ndarray:
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    s, t, _ = word_bounds(data, np.array([0, len(data)]))
    return np.sort(word_hashes(data, s, t))


_UNITS, _NUMBERS, _SMALL = (_hash_words(x) for x in (UNITS, NUMBERS, SMALL))


def _in(w: np.ndarray, known: np.ndarray) -> np.ndarray:
    return known[np.minimum(np.searchsorted(known, w), len(known) - 1)] == w


def bare(data: np.ndarray, s: np.ndarray, t: np.ndarray, edge: np.ndarray = _EDGE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words without the punctuation around them, however much there is."""
    s, t = s.copy(), t.copy()
    for ends, step in ((s, 1), (t, -1)):
        at = np.arange(len(s))
        while len(at):
            at = at[s[at] < t[at]]
            at = at[edge[data[ends[at] - (step < 0)]]]
            ends[at] += step
    return s, t


def capital(data: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Whether the letter at each s is a capital, in any script whose letters take one or two bytes."""
    one, two = data[s].astype(np.int64), data[np.minimum(s + 1, len(data) - 1)].astype(np.int64)
    return _UPPER[np.where((one >= 0xC2) & (one <= 0xDF), (one & 0x1F) << 6 | two & 0x3F, np.where(one < 0x80, one, 0))]


def canonical_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(plain hashes, template hashes, document numbers, whether the word begins a line, and a sentence); words of punctuation alone are left out."""
    s0, t0, doc = word_bounds(data, offsets)
    s, t = bare(data, s0, t0)
    full = s < t
    if not full.any():
        z = np.zeros(0, bool)
        return np.zeros(0, U64), np.zeros(0, U64), doc[full], z, z
    breaks = np.r_[0, np.cumsum(data == 0x0A)]
    stops = np.r_[0, np.cumsum(np.isin(data, list(b".!?")))]
    s, t, doc, tail = s[full], t[full], doc[full], t0[full]
    w = word_hashes(data, s, t)
    other = np.r_[True, doc[1:] != doc[:-1]]
    line = other | np.r_[True, breaks[s[1:]] > breaks[t[:-1]]]
    sentence = line | np.r_[True, stops[np.maximum(tail[:-1], t[:-1])] > stops[t[:-1]]]
    digits = np.r_[0, np.cumsum(_DIGIT[data])]
    number = (digits[t] - digits[s] > 0) & (_DIGIT[data[s]] | (np.isin(data[s], list(b"+-$")) & (t - s > 1))) | _in(w, _NUMBERS)
    unit = _in(w, _UNITS) & np.r_[False, number[:-1]] & ~other
    name = capital(data, s) & ~_in(w, _SMALL)
    return w, np.where(number, NUM, np.where(unit, UNIT, np.where(name, NAME, w))), doc, line, sentence


def whole(w: np.ndarray, doc: np.ndarray, line: np.ndarray, sentence: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, first words, numbers of words) of the lines and sentences of fewer than K words."""
    out = []
    for begins in (line, sentence):
        first = np.flatnonzero(begins)
        n = np.diff(np.r_[first, len(w)])
        first, n = first[n < K], n[n < K]
        h = n.astype(U64)
        for j in range(K - 1):
            live = n > j
            h[live] = mix(h[live] * U64(31) + w[first[live] + j])
        out.append((h, first, n))
    h, first, n = (np.concatenate(z) for z in zip(*out, strict=True))
    once = np.unique(np.stack([first, n]), axis=1, return_index=True)[1] if len(first) else np.zeros(0, np.int64)
    return h[once], first[once], n[once]


def slotted(w: np.ndarray, tpl: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(plain hashes, template hashes, document numbers, first words) with every run of like placeholders as one slot."""
    if not len(w):
        return w, tpl, doc, np.zeros(0, np.int64)
    go_on = (tpl[1:] != w[1:]) & (tpl[:-1] != w[:-1]) & (tpl[1:] == tpl[:-1]) & (doc[1:] == doc[:-1])
    first = np.flatnonzero(np.r_[True, ~go_on])
    i = np.arange(len(w)) - np.repeat(first, np.diff(np.r_[first, len(w)]))
    run = np.add.reduceat(mix(w + i.astype(U64)), first)
    return np.where(tpl[first] != w[first], run, w[first]), tpl[first], doc[first], first


def windows(data: np.ndarray, offsets: np.ndarray, flt=None, item: bool = False) -> dict[str, np.ndarray]:
    """doc, pos, start and end in words, kind (0 plain, 1 template, 2 template of slots, 3 short and whole), h, and slots (K fillings, 0 where literal) of the windows that may be in flt."""
    words, template, docs, line, sentence = canonical_words(data, offsets)
    begin = np.searchsorted(docs, np.arange(len(offsets)))
    out = {k: [] for k in ("doc", "pos", "start", "end", "kind", "h", "slots")}
    every = np.arange(len(words))

    def put(kind, doc, pos, start, end, h, slots):
        for k, v in zip(out, (doc, pos, start, end, np.full(len(h), kind, np.int32), h, slots), strict=True):
            out[k].append(v)

    for kind, (w, tpl, doc, word) in enumerate(((words, template, docs, every), (words, template, docs, every), slotted(words, template, docs))):
        first = np.searchsorted(doc, np.arange(len(offsets)))
        word = np.r_[word, len(words)]
        filled = tpl != w
        count = np.r_[0, np.cumsum(filled)]
        h, at = window_hashes(tpl if kind else w, doc, K)
        if kind and len(at):
            n = count[at + K] - count[at]
            ok = (n > 0) & (n <= K - LITERALS)
            h, at = h[ok], at[ok]
        h = mix(h + U64(kind + 1))
        if flt is not None and len(h):
            ok = flt.test(h)
            h, at = h[ok], at[ok]
        i = at[:, None] + np.arange(K)
        slots = np.where(filled[i], w[i], U64(0)).reshape(-1, K) if kind and len(at) else np.zeros((len(at), K), U64)
        put(kind, doc[at], at - first[doc[at]], word[at] - begin[doc[at]], word[at + K] - begin[doc[at]], h, slots)
    if item:
        # an item counts as a whole, however many lines it has
        line = sentence = np.r_[True, docs[1:] != docs[:-1]][: len(docs)]
    h, at, n = whole(words, docs, line, sentence)
    h = mix(h + U64(4))
    if flt is not None and len(h):
        ok = flt.test(h)
        h, at, n = h[ok], at[ok], n[ok]
    start = at - begin[docs[at]]
    put(3, docs[at], start if not item else start * 0, start, start + n, h, np.zeros((len(h), K), U64))
    return {k: np.concatenate(v) for k, v in out.items()}


_OUT = "id long, pos long, start long, end long, kind int, h long, slots array<long>"


def _scan(flt):
    def run(batches):
        for b in batches:
            data, off = text_buffer(b.column("text"))
            ids = b.column("id")
            for i, j in slices(off):
                x = windows(data[off[i] : off[j]], off[i : j + 1] - off[i], flt.value if flt else None, flt is None)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x["h"]) * K + 1, K, dtype=np.int32)), pa.array(x["slots"].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([ids.slice(i, j - i).take(pa.array(x["doc"])), *(pa.array(x[c]) for c in ("pos", "start", "end", "kind")), pa.array(x["h"].view(np.int64)), lists], ["id", "pos", "start", "end", "kind", "h", "slots"])

    return run


def rising(pos: list[int], ipos: list[int]) -> list[int]:
    """Indices of a longest run of hits that rises in both; hits are sorted by pos, and by falling ipos where equal."""
    ends, at, before = [], [], []
    for i, v in enumerate(ipos):
        j = bisect_left(ends, v)
        before.append(at[j - 1] if j else -1)
        ends[j : j + 1], at[j : j + 1] = [v], [i]
    out, i = [], at[-1]
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def nearest(pos: list[int], ipos: list[int], reach: int) -> list[list[int]]:
    """Indices of all sorted hits (as in rising()) in runs that rise in both: each goes on from the nearest run behind it that it can, within reach."""
    out, open_, i = [], [], 0
    while i < len(pos):
        p, moved = pos[i], []
        open_ = [r for r in open_ if p - pos[r[-1]] <= reach]
        while i < len(pos) and pos[i] == p:
            j = next((j for j in range(len(open_) - 1, -1, -1) if ipos[open_[j][-1]] < ipos[i]), None)
            run = [] if j is None else open_.pop(j)
            if j is None:
                out.append(run)
            run.append(i)
            moved.append(run)
            i += 1
        open_ += reversed(moved)
    return out


def _pooled(batches):
    """Of the hits of each document, item and kind in sorted rows, those of the best order, and the runs of nearest() that differ, numbered in `diagonal`."""
    kept = None

    def chosen(t: pa.Table):
        key = list(zip(*(t.column(c).to_pylist() for c in ("doc_id", "item_id", "kind")), strict=True))
        pos, ipos, n = (t.column(c).to_pylist() for c in ("pos", "ipos", "n_windows"))
        take, label, s = [], [], 0
        for e in range(1, len(key) + 1):
            if e == len(key) or key[e] != key[s] or pos[e] - pos[e - 1] > n[s] + K - 1:
                best = rising(pos[s:e], ipos[s:e])
                for r in (best, *(r for r in nearest(pos[s:e], ipos[s:e], n[s] + K - 1) if r != best and len(r) > 1)):
                    take += [s + i for i in r]
                    label += [len(take)] * len(r)
                s = e
        t = t.take(pa.array(take, pa.int64()))
        return t.set_column(t.schema.get_field_index("diagonal"), "diagonal", pa.array(label, pa.int64())).combine_chunks().to_batches()

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([kept, t]).combine_chunks() if kept is not None else t
        if len(t):
            last = [t.column(c).to_pylist() for c in ("doc_id", "item_id", "kind")]
            cut = len(t)
            while cut and all(c[cut - 1] == c[-1] for c in last):
                cut -= 1
            if cut:
                yield from chosen(t.slice(0, cut))
            kept = t.slice(cut)
    if kept is not None and len(kept):
        yield from chosen(kept)


def _windows_of(items: DataFrame) -> DataFrame:
    it = items.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null")
    return materialize(it.mapInArrow(lean(_scan(None)), _OUT))


def _classes(own: DataFrame) -> DataFrame:
    """id and class, the smallest id of equal windows and fillings of every kind."""
    seq = own.groupBy("id").agg(F.sha2(F.to_json(F.sort_array(F.collect_list(F.struct("kind", "pos", "h", "slots")))), 256).alias("key"))
    return seq.join(seq.groupBy("key").agg(F.min("id").alias("class")), "key").select("id", "class")


@tidied
def item_classes(items: DataFrame) -> DataFrame:
    """item_id and class_id of the items with a word: contaminated() reports class_id in place of each item_id of its class."""
    return _classes(_windows_of(items)).select(F.col("id").alias("item_id"), F.col("class").alias("class_id"))


@tidied
def contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id, kind (plain or template), start_word, end_word, coverage, consistency: the best occurrence a document, item and kind."""
    spark = docs.sparkSession
    own = _windows_of(items)
    least = _classes(own).where("id = class").select("id")
    size = own.groupBy("kind", "id").agg(F.count("*").alias("n_windows"))
    own = materialize(own.join(least, "id").join(size, ["kind", "id"]))
    flt = share(spark, bloom_of(own.select("h").distinct(), "h", 48))
    found = docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(lean(_scan(flt)), _OUT)
    item = own.select("kind", "h", F.col("id").alias("item_id"), F.col("pos").alias("ipos"), F.col("slots").alias("islots"), "n_windows")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hit = found.withColumnRenamed("id", "doc_id").join(item, ["kind", "h"])
    fill = F.filter(F.arrays_zip("islots", "slots"), lambda z: z["islots"] != 0)
    hit = hit.select("doc_id", "item_id", "kind", "n_windows", "pos", "start", "end", "ipos", (F.col("pos") - F.col("ipos")).alias("diagonal"), fill.alias("fill"))
    hit = materialize(hit)
    rows = hit.repartition(n, "doc_id", "item_id", "kind").sortWithinPartitions("doc_id", "item_id", "kind", "pos", F.desc("ipos"))
    pooled = rows.mapInArrow(lean(_pooled), hit.schema)
    hit = hit.withColumn("pooled", F.lit(False)).unionByName(pooled.withColumn("pooled", F.lit(True)))
    occ = hit.groupBy("doc_id", "item_id", "kind", "pooled", "diagonal").agg(
        F.first("n_windows").alias("n_windows"),
        F.array_sort(F.collect_set("ipos")).alias("at"),
        F.min("start").alias("start_word"),
        F.max("end").alias("end_word"),
        F.array_distinct(F.flatten(F.collect_set("fill"))).alias("fills"),
    )
    # words of the item in its hits: K, and behind each hit what the next one adds
    occ = occ.withColumn("hits", F.size("at")).withColumn("words", K + F.aggregate(F.zip_with(F.slice("at", 2, F.col("hits")), F.slice("at", 1, F.col("hits") - 1), lambda y, x: F.least(y - x, F.lit(K))), F.lit(0).cast("long"), lambda a, x: a + x))
    # of the fillings that changed somewhere, and of all that they became: is it one for one?
    def one_to_one(c):
        names = F.array_distinct(F.transform(F.filter("fills", lambda z: z["islots"] != z["slots"]), lambda z: z[c]))
        return let(names, lambda n: F.when(F.size(n) == 0, F.lit(1.0)).otherwise(F.size(n) / F.size(F.filter("fills", lambda z: F.array_contains(n, z[c])))))

    occ = occ.withColumn("consistency", F.least(one_to_one("islots"), one_to_one("slots")))
    occ = occ.withColumn("coverage", F.least(F.lit(1.0), F.col("hits") / F.col("n_windows")))
    occ = occ.where((F.col("consistency") >= CONSISTENT) & ((F.col("words") >= LEAST_WORDS) | (F.col("coverage") >= LEAST_SHARE)))
    occ = occ.withColumn("kind", F.when(F.col("kind").isin(0, 3), "plain").otherwise("template"))
    best = occ.groupBy("doc_id", "item_id", "kind").agg(F.max_by(F.struct("start_word", "end_word", "coverage", "consistency"), F.struct("coverage", ~F.col("pooled"), "hits", -F.col("start_word"))).alias("o"))
    return best.select("doc_id", "item_id", "kind", "o.*")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
