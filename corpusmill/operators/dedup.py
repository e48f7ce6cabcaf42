"""Exact dedup, SimHash signatures and set operations on keys."""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import by_pieces
from corpusmill.functions.expr import col
from corpusmill.functions.metrics import doc_id
from corpusmill.functions.phrases import phrases
from corpusmill.functions.text import simhash_clean
from corpusmill.operators.filters import transcript_ok


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns that can be hashed."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def or_row(key: Column, row: Column) -> Column:
    """The key; where it is null, one of the row's own, so that rows without a key are never taken for copies of each other."""
    return F.coalesce(key.cast("string"), F.concat(F.lit("row "), row.cast("string")))


def first_by(df: DataFrame, key: Column, order: str = "doc_id") -> DataFrame:
    """One row for every key: that of the smallest `order` (ties: the smallest row hash).

    Two steps on narrow columns: a grouped minimum (partial on the map side, so a key with very
    many rows is no hot task), then a semi-join back to the full rows. What still ties are repeated
    rows, of which one stays; they lie in the join's partition. Rows with a null key stay,
    repeated ones once.
    """
    x = df.withColumns({"_h": row_hash(df)}).withColumn("_k", or_row(key, F.col("_h")))
    x = x.withColumn("_o", F.struct(F.col(order).alias("o"), "_h"))
    least = x.groupBy("_k").agg(F.min("_o").alias("_o"))
    return x.join(least, ["_k", "_o"], "left_semi").dropDuplicates(["_k", "_o"]).drop("_k", "_o", "_h")


def dedup_prefix(docs: DataFrame, text: str = "text", order: str = "doc_id", chars: int = 4096) -> DataFrame:
    """First document for each distinct beginning of `chars` characters; null texts are no copies of each other."""
    return first_by(docs, doc_id(text, chars), order)


def dedup_cleaned(docs: DataFrame, cleaned: Column, text: str = "text", order: str = "doc_id", gate: Column | None = None) -> DataFrame:
    """First document for each cleaned text, after a gate on the uncleaned text (transcript_ok by default)."""
    return first_by(docs.where(transcript_ok(text) if gate is None else gate), F.md5(cleaned), order)


def url_key(url) -> Column:
    return F.substring(F.md5(F.lower(col(url))), 1, 16)


def dedup_urls(pages: DataFrame, url: str = "url", order: str = "page_id") -> DataFrame:
    return first_by(pages, url_key(url), order)


def by_id(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """Documents with this key; no row if it is missing."""
    return docs.where(doc_id(text) == key)


def _signature(words: list[str], stop: frozenset[str], bits: int, seen: dict) -> str | None:
    """Bits as a text of 0 and 1, lowest first; null where all words are stopwords."""
    counts = Counter(w for w in words if w not in stop)
    if not counts:
        return None
    sums: dict[int, np.ndarray] = {}
    for w, n in counts.items():
        if n > 1:  # ln 1 = 0
            h = seen.get(w)
            if h is None:
                if len(seen) > 200_000:
                    seen.clear()
                h = seen[w] = np.unpackbits(np.frombuffer(hashlib.md5(w.encode()).digest()[:8], np.uint8))[::-1].astype(np.int64) * 2 - 1
            sums[n] = sums.get(n, 0) + h
    total = np.zeros(64)
    for n in sorted(sums):
        total += sums[n] * (n * math.log(n))
    return "".join("1" if x > 1e-7 else "0" for x in total[:bits])


def simhash_bits(docs: DataFrame, key: str = "doc_id", text: str = "text", stopwords=None, bits: int = 64) -> DataFrame:
    """key, simhash: bits as a text of 0 and 1, lowest first; null where all words are stopwords.

    Each word adds count * ln(count) with its hash's signs; words that occur once add nothing, so
    texts of unrepeated words hash to zero, which is never a sign of likeness. Signs are summed as
    integers for each count, then combined in ascending order of count; sums within 1e-7 of zero
    are zero, so that counts that cancel give no bit. One pass over each text, without a shuffle.
    """
    stop = frozenset(phrases("stopwords") if stopwords is None else stopwords)

    def signer():
        seen: dict = {}
        return lambda texts: [None if t is None else _signature(t.split(" "), stop, bits, seen) for t in texts]

    return docs.select(key, by_pieces(signer, T.StringType())(simhash_clean(text)).alias("simhash"))


def simhash_pairs(hashes: DataFrame, key: str = "doc_id", most: int = 3) -> DataFrame:
    """a, b, distance: signatures at most `most` (under 4) bits apart. Equal signatures are one class; all-zero ones pair with nothing.

    The 64 bits fall into six blocks. Signatures with fewer than four differing bits agree on three
    of them at least, so they meet under one of the 20 choices of three blocks, some 32 bits: random
    signatures meet under a key with a probability of 2^-32. The smallest key of a class stands for it.
    """
    if most > 3:
        raise ValueError("keys of three blocks of six find up to three differing bits")
    x = hashes.where(F.col("simhash").contains("1")).groupBy("simhash").agg(F.min(key).alias("id"))
    edges = [0, 11, 22, 33, 44, 54, 64]
    keys = [F.concat(*[F.substring("simhash", edges[i] + 1, edges[i + 1] - edges[i]) for i in c]) for c in combinations(range(6), 3)]
    number = F.conv(F.col("simhash"), 2, -10).cast("bigint")
    x = x.select("id", number.alias("s"), F.posexplode(F.array(*[F.conv(k, 2, 10).cast("bigint") for k in keys])).alias("band", "piece"))
    two = lambda n: x.select("band", "piece", F.col("id").alias(n), F.col("s").alias(f"s{n}"))
    distance = F.bit_count(F.col("sa").bitwiseXOR(F.col("sb")))
    return two("a").join(two("b"), ["band", "piece"]).where("a < b").select("a", "b", distance.alias("distance")).where(F.col("distance") <= most).distinct()
