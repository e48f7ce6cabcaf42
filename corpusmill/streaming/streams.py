"""The batch filters over unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.operators.dedup import or_row, row_hash, url_key
from corpusmill.operators.filters import web_gate


def shards(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """Parquet shards as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def filtered(stream: DataFrame, **gate) -> DataFrame:
    """The web gate; the same expression as in batch, so both give the same rows."""
    return web_gate(stream, **gate)


def unique_urls(stream: DataFrame, url: str = "url", time: str | None = None, delay: str = "7 days") -> DataFrame:
    """First row of every URL; rows without one stay, repeated ones once, as in batch. With a time column the state is bounded by the delay."""
    x = stream.withColumn("_k", or_row(url_key(url), row_hash(stream)))
    if time:
        return x.withWatermark(time, delay).dropDuplicatesWithinWatermark(["_k"]).drop("_k")
    return x.dropDuplicates(["_k"]).drop("_k")


def write(stream: DataFrame, path: str, checkpoint: str, rows_per_file: int = 150_000, once: bool = True) -> StreamingQuery:
    """Exactly-once files. `once` works off what is there and stops."""
    w = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).option("maxRecordsPerFile", rows_per_file)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="1 minute")).start()


def totals(stream: DataFrame, by: str = "source", text: str = "text") -> DataFrame:
    """Running totals by a column (complete mode)."""
    return stream.groupBy(by).agg(F.count("*").alias("n_docs"), F.sum(F.length(text)).alias("n_chars"))
