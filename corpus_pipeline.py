"""The corpus pipeline: quality rules, near-dedup, substring dedup, benchmark decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and
read again as the next stage's docs. All but the last return the columns of documents.

Defined results: null and empty texts fail the quality rules; a row without a doc_id is judged by
a hash of the row in place of the id, like any other; of equal rows, and of near duplicates, one
stays, that of the lowest doc_id; rows of one doc_id whose texts differ are rejected together and
else stay; extra columns are carried along; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import decontam, minhash, packing, quality, substrings
from corpusmill.llm.common import keyed, materialize, table, unkeyed
from corpusmill.llm.tokens import default_vocabulary


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outlier of their language and source."""
    own = keyed(docs)
    rejected = materialize(quality.quality_rules(own).where(~F.col("kept")).select("doc_id").distinct())
    return unkeyed(own.join(rejected, "doc_id", "left_anti"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The lowest document of each near-duplicate component (five words, similarity 0.8), and one of equal rows."""
    own = keyed(docs)
    extra = materialize(minhash.near_duplicates(own).where(~F.col("kept")).select("doc_id").distinct())
    again = materialize(own.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"))
    kept = own.join(extra, "doc_id", "left_anti")
    if not again.isEmpty():
        kept = kept.join(again, "doc_id", "left_anti").unionByName(kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return unkeyed(kept, docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that a lower document has."""
    return unkeyed(substrings.without_repeats(keyed(docs)), docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    own = keyed(docs)
    found = materialize(decontam.contaminated(own, table(spark, sf_dir, "benchmark")).select("doc_id").distinct())
    return unkeyed(own.join(found, "doc_id", "left_anti"), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the training sequences."""
    return packing.pack(docs, default_vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: The stages' estimates, sketches and chains are not expressible in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
