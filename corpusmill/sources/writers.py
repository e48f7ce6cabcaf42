"""Writers: delimited text, shards by size or count, keyed stores and manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.metrics import doc_id
from corpusmill.functions.phrases import END
from corpusmill.operators.aggregate import running_shards
from corpusmill.operators.dedup import first_by


def delimited(docs: DataFrame, path: str, text: str = "text", by: str | None = None, end: str = END, mode: str = "errorifexists") -> None:
    """Texts joined by the end mark, one folder for each value of `by`."""
    x = docs.select(F.col(text).alias("value"), *([by] if by else []))
    w = x.write.mode(mode).option("lineSep", end)
    (w.partitionBy(by) if by else w).text(path)


def resume(docs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """What a manifest of finished keys does not hold yet."""
    return docs.join(done.select(key), key, "left_anti")


def by_size(docs: DataFrame, path: str, limit: int, order: str = "doc_id", text: str = "text", total: int | None = None) -> None:
    """Shards of about `limit` bytes in order (folders shard=0, 1, ...), up to `total` bytes if given."""
    x = running_shards(docs.withColumn("_n", F.octet_length(text)), "_n", order, limit)
    x = x if total is None else x.where(F.col("before") < total)
    x.drop("_n", "before").repartition("shard").write.partitionBy("shard").parquet(path)


def by_count(docs: DataFrame, path: str, most: int, format: str = "parquet") -> None:
    """Files of at most `most` rows; the last, partial one is written, too."""
    docs.write.option("maxRecordsPerFile", most).format(format).save(path)


def content_store(docs: DataFrame, path: str, text: str = "text", order: str = "doc_id") -> None:
    """One row for each distinct text, keyed by its hash."""
    first_by(docs.withColumn("doc_key", F.md5(text)), F.col("doc_key"), order).write.parquet(path)


def document_store(docs: DataFrame, path: str, text: str = "text", order: str = "doc_id", buckets: int = 256) -> None:
    """Documents keyed by the hash of their beginning, in folders by key prefix for point lookups."""
    x = first_by(docs.withColumn("doc_key", doc_id(text)), F.col("doc_key"), order)
    x.withColumn("part", F.pmod(F.xxhash64("doc_key"), F.lit(buckets))).repartition("part").write.partitionBy("part").parquet(path)


def token_shards(tokens: DataFrame, path: str, most_tokens: int = 10_000_000, order: str = "doc_id", column: str = "tokens") -> None:
    x = running_shards(tokens.withColumn("_n", F.size(column)), "_n", order, most_tokens)
    x.drop("_n", "before").repartition("shard").write.partitionBy("shard").parquet(path)


def manifest(keys: DataFrame, path: str) -> None:
    keys.distinct().write.mode("append").parquet(path)


def scores_json(scores: DataFrame, path: str) -> None:
    scores.write.json(path)
