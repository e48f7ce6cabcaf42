"""End-to-end plans: archive to corpus, shards to training text, wiki dump by page views; a learned quality score."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.operators import aggregate, dedup, filters, relational
from corpusmill.sources import readers, writers
from corpusmill.sources.scratch import cut


def clean_archive(records: DataFrame, keep_headings: bool = False) -> DataFrame:
    """url, contents of archive records (see readers.web_archive): cheap tests on the header first, one shuffle for the URLs."""
    x = records.where(filters.url_allowed("url") & filters.language_is("lan"))
    x = dedup.dedup_urls(x, order="page_id" if "page_id" in x.columns else "contents")
    x = x.withColumn("contents", tx.nfkc(filters.good_paragraphs("contents", keep_headings=keep_headings)))
    x = x.where(filters.page_gate("contents")).withColumn("contents", tx.page_characters(filters.without_runons("contents")))
    return x.where(filters.plain_characters("contents")).withColumn("contents", tx.sentence_spacing("contents"))


def training_text(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Gate, punctuation, topic filter, spelling, dedup in one lazy plan."""
    x = filters.web_gate(docs, key=key, strict=True).withColumn("text", tx.normalize_punctuation("text"))
    x = x.where(filters.topic_filter("text", key)).withColumn("text", tx.normalize_text(F.col("text")))
    return dedup.dedup_prefix(x, order=key)


def wiki_by_views(pages: DataFrame, views: DataFrame, cutoff: float = 200.0, least_score: float = 30.0, least_chars: int = 1000) -> DataFrame:
    """key, score, text of wiki pages that are read often; the join comes before the costly clean-up."""
    counts = views.where(filters.page_view_line("value")).select(tx.title_key("title").alias("key"), "count")
    scores = aggregate.view_scores(counts, cutoff=cutoff)
    x = relational.with_scores(pages, scores, cutoff=least_score).withColumn("text", tx.wikitext("text"))
    return x.where(F.length("text") >= least_chars).select("key", "score", "text")


def clean_web_archive(spark: SparkSession, path: str) -> DataFrame:
    return clean_archive(readers.web_archive(spark, path))


def rewrite_archives(spark: SparkSession, path: str, out: str) -> DataFrame:
    """Cleaned copies of the archives below a path, those that were not done before, and what is there now.

    `out` keeps the cleaned rows (file, url, contents) and a manifest of finished files; a run that
    ended early is taken up where it stopped. Archives are not deleted.
    """
    files = readers.file_list(spark, path, "").select(F.col("path").alias("file"))
    try:
        done = spark.read.schema("file string").parquet(f"{out}/done")
    except AnalysisException:  # the first run
        done = files.limit(0)
    todo = cut(relational.not_done(files, done, "file"))
    names = [r["file"] for r in todo.collect()]  # one row an archive, as in a manifest
    if names:
        x = clean_archive(readers.web_archive(spark, names))
        x.select("url", "contents").write.mode("append").parquet(f"{out}/rows")
        writers.manifest(todo, f"{out}/done")
    return spark.read.schema("url string, contents string").parquet(f"{out}/rows")


def good_copy(frames: list[DataFrame], path: str, text: str = "text") -> None:
    """Several corpora as one, its characters made good."""
    relational.union_of(frames).withColumn(text, tx.make_good(text)).write.parquet(path)


def prepared_corpus(docs: DataFrame, key: str = "doc_id", good: str = tx.ASCII_GOOD) -> DataFrame:
    """Transcripts cleaned by dictionary and of rare characters, one row a distinct text."""
    rare = aggregate.rare_chars(docs, good=good).agg(F.coalesce(F.array_join(F.collect_list("c"), ""), F.lit("")).alias("_rare"))  # one row: the alphabet bounds it
    x = docs.join(F.broadcast(rare))
    cleaned = tx.strip(F.translate(tx.correct_by_dict(F.col("text")), F.col("_rare"), F.lit("")))
    x = x.where(filters.transcript_ok("text")).withColumn("text", cleaned).drop("_rare")
    return dedup.first_by(x, F.md5("text"), key)


def learned_quality(docs: DataFrame, labels: DataFrame, features: int = 1 << 16, label: str = "quality") -> DataFrame:
    """doc_id, score: logistic regression on hashed words, fitted on the labelled rows."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import HashingTF, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    x = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    train = x.join(labels.where(F.col(label).isNotNull()).select("doc_id", F.col(label).cast("double").alias("label")), "doc_id")
    model = Pipeline(
        stages=[
            RegexTokenizer(inputCol="text", outputCol="w", pattern="\\s+"),
            HashingTF(inputCol="w", outputCol="f", numFeatures=features, binary=True),
            LogisticRegression(featuresCol="f", labelCol="label", regParam=0.01, maxIter=20),
        ]
    ).fit(train)
    return model.transform(x).select("doc_id", F.get(vector_to_array("probability"), F.lit(1)).alias("score"))
