"""Scalar metrics of a text."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import each
from corpusmill.functions.expr import col, count_chars, count_of
from corpusmill.functions.phrases import mapping


def viewer_stats(text) -> Column:
    """STRUCT of alphabet, punctuation and comma shares, mean word length and a count; zero where nothing is there."""
    t = col(text)
    n = F.length(t)
    w = F.size(F.filter(F.split(t, r"(?U)\s+"), lambda x: x != ""))
    over = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    return F.struct(
        over(count_chars(F.lower(t), "abcdefghijklmnopqrstuvwxyz.?!,"), n).alias("alphabet_share"),
        over(count_chars(t, '.!?",'), n).alias("punctuation_share"),
        over(n, w).alias("mean_word"),
        over(count_of(t, ","), w).alias("comma_share"),
        count_of(t, "casino").cast("long").alias("casino"),
    )


def term_density(text, term: str) -> Column:
    t = col(text)
    return F.when(F.length(t) > 0, count_of(t, term) / F.length(t) / len(term)).otherwise(0.0)


def _entropy(text: str) -> float:
    n = np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)[1]
    return float(np.log2(n.sum()) - (n * np.log2(n)).sum() / n.sum()) if len(n) else 0.0


_entropies = each(_entropy, T.DoubleType())


def entropy(text) -> Column:
    """Shannon entropy of the characters in bits; 0 for an empty text. One histogram a text, in Arrow batches."""
    return _entropies(col(text))


def topic_score(text, weights: dict[str, int] | None = None) -> Column:
    """Product over topics of count * weight / 2 (1 where a topic does not occur), by length."""
    t = col(text)
    out = F.lit(1.0)
    for k, w in (weights or mapping("topic_weights")).items():
        c = count_of(t, k)
        out = out * F.when(c > 0, c * (w / 2)).otherwise(1.0)
    return out / F.length(t)


def tf_idf(count, n_terms, n_docs, df=None) -> Column:
    """Term frequency by ln(n_docs) (as written), or by ln(n_docs / df)."""
    return col(count) / col(n_terms) * (F.ln(col(n_docs)) if df is None else F.ln(col(n_docs) / col(df)))


def doc_id(text, chars: int = 4096) -> Column:
    """Key of a document by its first characters."""
    return F.md5(F.substring(col(text), 1, chars))


def comment_lines(source) -> Column:
    """STRUCT of comment (and triple-quoted) lines and all lines, by a toggle on lines that open with triple quotes."""
    lines = F.split(F.regexp_replace(col(source), r"\n$", ""), "\n")
    lines = F.when(col(source) == "", F.array().cast("array<string>")).otherwise(lines)

    def step(a, raw):
        x = F.trim(raw)
        quote = x.startswith('"""') | x.startswith("'''")
        comment = x.startswith("#")
        inside = F.when(~comment & quote, ~a["inside"]).otherwise(a["inside"])
        return F.struct(inside.alias("inside"), (a["n"] + F.when(comment | quote | a["inside"], 1).otherwise(0)).alias("n"))

    got = F.aggregate(lines, F.struct(F.lit(False).alias("inside"), F.lit(0).cast("long").alias("n")), step)
    return F.struct(got["n"].alias("comment_lines"), F.size(lines).cast("long").alias("lines"))
