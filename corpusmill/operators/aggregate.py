"""Aggregations over corpora. All group by key with partial sums; nothing is gathered but what is asked for."""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.arrow import pieces
from corpusmill.functions.expr import col, count_of
from corpusmill.functions.text import simhash_clean


def view_scores(counts: DataFrame, key: str = "key", count: str = "count", least: int = 5, cutoff: float = 200.0) -> DataFrame:
    """key, n, score: clipped mean and steadiness of each key's counts.

    Counts are clipped at twice the integer median, so the median comes first and the moments
    second. A key's counts are folded to (count, times) before both, which bounds a hot key's
    shuffle by its distinct counts.
    """
    c = counts.where(F.col(key).isNotNull() & F.col(count).isNotNull()).groupBy(F.col(key).alias("key"), F.col(count).cast("long").alias("x")).agg(F.count("*").alias("times"))
    m = c.groupBy("key").agg(F.floor(F.expr("percentile(x, 0.5, times)")).alias("m"), F.sum("times").alias("n"))
    m = m.where(F.col("n") >= least)
    j = c.join(m, "key").withColumn("y", F.least(F.col("x"), 2 * F.col("m")))
    s = j.groupBy("key").agg(F.first("n").alias("n"), F.sum(F.col("y") * F.col("times")).alias("s1"), F.sum(F.col("y") * F.col("y") * F.col("times")).alias("s2"))
    mean = F.col("s1") / F.col("n")
    dev = F.sqrt(F.greatest(F.col("s2") / F.col("n") - mean * mean, F.lit(0.0)))
    score = 3.0 / (0.1 + dev) + 4.0 * mean * F.pow(F.col("n").cast("double"), F.lit(0.333))
    return s.select("key", "n", score.alias("score")).where(F.col("score") > cutoff)


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """word, n over the canonical words of all texts (the empty word counts)."""
    return docs.select(F.explode(F.split(simhash_clean(text), " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def top_words(docs: DataFrame, k: int = 100, text: str = "text") -> DataFrame:
    return word_counts(docs, text).orderBy(F.desc("n"), "word").limit(k)


def doc_word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(key, F.explode(F.split(simhash_clean(text), " ")).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))


def term_counts(docs: DataFrame, key: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(key, word, n, m) for each word of each document, m being the document's words, and (word, df).

    A document is one row, so its words are counted where it is read and only sums by word are
    shuffled. Where keys repeat, rows of a key are one document, whose words are grouped. Rows
    without a key are one document of df.
    """
    odd = docs.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull())
    if not odd.isEmpty():
        c = docs.select(key, F.explode(F.split(text, " ")).alias("word")).groupBy(key, "word").agg(F.count("*").alias("n"))
        m = c.groupBy(key).agg(F.sum("n").alias("m"))
        return c.join(m, key), c.groupBy("word").agg(F.count("*").alias("df"))

    def count(batches):
        for b in batches:
            at = 0
            for p in pieces(b.column(1)):
                rows, words, n, m = [], [], [], []
                for i, t in enumerate(p.to_pylist()):
                    if t is not None:
                        all_words = t.split(" ")
                        got = Counter(all_words)
                        rows += [at + i] * len(got)
                        words += got
                        n += got.values()
                        m += [len(all_words)] * len(got)
                at += len(p)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(rows, pa.int64())), pa.array(words, pa.string()), pa.array(n, pa.int64()), pa.array(m, pa.int64())], [key, "word", "n", "m"])

    def documents_of(batches):
        total: Counter = Counter()
        for b in batches:
            for p in pieces(b.column(0)):
                for t in p.to_pylist():
                    total.update(set(t.split(" ")) if t is not None else ())
                if len(total) > 200_000:  # what a task holds is bounded
                    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])
                    total = Counter()
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

    kind = docs.schema[key].dataType.simpleString()
    c = docs.select(key, text).mapInArrow(count, f"`{key}` {kind}, word string, n long, m long")
    return c, docs.select(text).mapInArrow(documents_of, "word string, n long").groupBy("word").agg(F.sum("n").alias("df"))


def char_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    return docs.select(F.explode(F.split(F.col(text), "")).alias("c")).where("c <> ''").groupBy("c").agg(F.count("*").alias("n"))


def rare_chars(docs: DataFrame, text: str = "text", share: float = 2e-7, good: str = "") -> DataFrame:
    """Characters below a share of all, outside `good`."""
    c = char_counts(docs, text)
    total = c.agg(F.sum("n").alias("total"))
    return c.join(F.broadcast(total)).where((F.col("n") / F.col("total") < share) & ~F.contains(F.lit(good), F.col("c"))).select("c", "n")  # one row is broadcast


def corpus_totals(docs: DataFrame, *by: str, text: str = "text") -> DataFrame:
    return docs.groupBy(*by).agg(F.count("*").alias("n_docs"), F.sum(F.length(text)).alias("n_chars"), F.sum(F.size(F.split(text, " "))).alias("n_words"))


def pair_counts(tokens: DataFrame, column: str = "tokens", weight=None) -> DataFrame:
    """first, second, n: adjacent pairs of an array column, each as often as `weight` says (1)."""
    t = F.col(column)
    pairs = F.transform(F.sequence(F.lit(0), F.size(t) - 2), lambda i: F.struct(F.get(t, i).alias("first"), F.get(t, i + 1).alias("second")))
    x = tokens.where(F.size(t) > 1).select(F.explode(pairs).alias("p"), (col(weight) if weight is not None else F.lit(1)).alias("w"))
    return x.groupBy("p.first", "p.second").agg(F.sum("w").cast("long").alias("n"))


def term_count(docs: DataFrame, term: str, text: str = "text") -> DataFrame:
    return docs.agg(F.coalesce(F.sum(count_of(F.lower(F.col(text)), term)), F.lit(0)).cast("long").alias("n"))


def block_means(values: DataFrame, size: int, order: str = "i", value: str = "v") -> DataFrame:
    """Means of `size` equal blocks of the last size * (n div size) values; order holds 0, 1, ... n - 1."""
    n = values.agg(F.count("*").alias("n"))
    x = values.join(F.broadcast(n)).withColumn("factor", F.floor(F.col("n") / size))  # one row is broadcast
    x = x.withColumn("k", F.col(order) - (F.col("n") - size * F.col("factor"))).where((F.col("factor") > 0) & (F.col("k") >= 0))
    return x.groupBy(F.floor(F.col("k") / F.col("factor")).alias("block")).agg(F.avg(value).alias("mean"))


def kept_totals(docs: DataFrame, **flags) -> DataFrame:
    """Rows, and rows for which each flag holds."""
    return docs.agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()])


def answers_of(posts: DataFrame, id: str = "id", parent: str = "parent", kind: str = "kind", body: str = "body") -> DataFrame:
    """id, question, answers MAP<id, text>: answers of each question by their parent; questions without any have an empty map."""
    q = posts.where(F.col(kind) == "Question").select(F.col(id).alias("id"), F.col(body).alias("question"))
    a = posts.where(F.col(kind) != "Question").groupBy(F.col(parent).cast("bigint").alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(id).alias("k"), F.col(body).alias("v")))).alias("a"))
    pairs = F.coalesce("a", F.array().cast("array<struct<k:bigint,v:string>>"))
    return q.join(a, "id", "left").select("id", "question", F.map_from_entries(pairs).alias("answers"))


def running_shards(docs: DataFrame, size: str, order: str, limit: int, rows: int = 1 << 16) -> DataFrame:
    """shard = earlier bytes div limit, by running sums in two steps.

    The range of the order is cut into as many equal parts as there are `rows` rows; sums of the
    parts first, then a window over those few sums, then a window within each part, so that no task
    holds the whole table, whether the orders are dense or hashes. `order` must be a BIGINT.
    """
    o = F.col(order).cast("double")
    span = docs.agg(F.min(o).alias("_lo"), F.max(o).alias("_hi"), F.greatest(F.ceil(F.count("*") / rows), F.lit(1)).alias("_parts"))
    x = docs.join(F.broadcast(span))  # one row is broadcast
    x = x.withColumn("_b", F.floor((o - F.col("_lo")) / (F.col("_hi") - F.col("_lo") + 1) * F.col("_parts"))).drop("_lo", "_hi", "_parts")
    sums = x.groupBy("_b").agg(F.sum(size).alias("_s"))
    # one row for about `rows` rows: the only window without a key runs over those
    before = sums.withColumn("_before", F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_s")
    w = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    x = x.join(before, "_b").withColumn("before", (F.col("_before") + F.coalesce(F.sum(size).over(w), F.lit(0))).cast("long"))
    return x.withColumn("shard", F.floor(F.col("before") / limit).cast("long")).drop("_b", "_before")
