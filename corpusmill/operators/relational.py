"""Joins, set operations, deterministic sampling, splits and order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.functions.expr import bucket, col, keep
from corpusmill.functions.text import title_key
from corpusmill.sources.scratch import cut


def with_scores(pages: DataFrame, scores: DataFrame, title: str = "title", cutoff: float = 30.0) -> DataFrame:
    """Pages whose title key has a score above the cutoff. Spark broadcasts the scores if their size allows."""
    return pages.withColumn("key", title_key(title)).join(scores.where(F.col("score") > cutoff), "key")


def not_done(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return todo.join(done.select(key), key, "left_anti")


def only_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_semi")


def union_of(frames: Sequence[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def url_union(frames: Sequence[DataFrame], url: str = "url") -> DataFrame:
    return union_of([f.select(url) for f in frames]).distinct()


def sample(df: DataFrame, key: str, share: float) -> DataFrame:
    """About a share of the rows, always the same."""
    return df.where(keep(key, share))


def shuffled(df: DataFrame, key: str, seed: int = 0) -> DataFrame:
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), col(key).cast("string"))), key)


def ranked(df: DataFrame, key: str) -> DataFrame:
    """rank: 0, 1, ... by the md5 of the key, exact over the whole table, without one task that holds it.

    Rows are ranked within 4,096 hash ranges, shifted by the counts of the ranges before.
    """
    x = df.withColumns({"_h": F.md5(col(key).cast("string")), "_n": F.lit(1)}).withColumn("_r", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    counts = x.groupBy("_r").agg(F.count("*").alias("_c"))  # at most 4,096 rows
    before = counts.withColumn("_before", F.coalesce(F.sum("_c").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_c")
    x = x.join(F.broadcast(before), "_r")
    return x.withColumn("rank", (F.row_number().over(Window.partitionBy("_r").orderBy("_h", key)) - 1 + F.col("_before")).cast("long")).drop("_h", "_n", "_r", "_before")


def split(df: DataFrame, key: str, share: float = 0.1) -> DataFrame:
    """part: train for the first int(n * (1 - share)) rows by rank, eval for the rest."""
    n = df.agg(F.count("*").alias("_n"))
    x = ranked(df, key).join(F.broadcast(n))  # one row is broadcast
    return x.withColumn("part", F.when(F.col("rank") < F.floor(F.col("_n") * (1 - share)), "train").otherwise("eval")).drop("_n")


def fraction(df: DataFrame, key: str, share: float) -> DataFrame:
    """Exactly int(share * n) rows, the first by rank."""
    n = df.agg(F.count("*").alias("_n"))
    return ranked(df, key).join(F.broadcast(n)).where(F.col("rank") < F.floor(F.col("_n") * share)).drop("_n", "rank")


def top(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(k)


def argmax(df: DataFrame, value: str, *tie: str) -> DataFrame:
    """The row with the largest value; of several, the smallest by tie."""
    best = df.agg(F.max(value).alias(value))
    rows = df.join(F.broadcast(best), value)  # one row is broadcast
    return rows.agg(F.min(F.struct(*tie)).alias("t"), F.first(value).alias(value)).select("t.*", value)


def prompt_pairs(turns: DataFrame) -> DataFrame:
    """conv_id, turn, prompt, response: each user turn with the assistant turn right after it."""
    u = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    a = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("response"))
    return u.join(a, ["conv_id", "turn"])


def reachable(edges: DataFrame, start: DataFrame, depth: int = 3, nodes: DataFrame | None = None, least_visits: int | None = None) -> DataFrame:
    """node, depth: what stored links lead to from the start nodes, each at its least depth.

    With nodes (node, n_visits), only nodes of more than least_visits visits are kept and followed.
    Every round ends in a table of the shared folder, so the plan stays one round long.
    """
    alive = None if nodes is None else nodes.where(F.col("n_visits") > (least_visits or 0)).select("node")
    keep = lambda x: x if alive is None else x.join(alive, "node", "left_semi")
    seen = front = cut(keep(start.select("node").distinct()).withColumn("depth", F.lit(0)))
    for d in range(1, depth + 1):
        new = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct()
        front = cut(keep(new).join(seen, "node", "left_anti").withColumn("depth", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
    return seen


def sorted_desc(values) -> Column:
    return F.sort_array(col(values), asc=False)


def hash_bucket(df: DataFrame, key: str, n: int) -> DataFrame:
    return df.withColumn("bucket", bucket(key, n))
