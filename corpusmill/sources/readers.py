"""Readers for the formats that corpora come in. All give lazy DataFrames over Spark's own sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.expr import keep, strip
from corpusmill.functions.phrases import END
from corpusmill.functions.text import strip_accents

#: Names of hub data sets and where their shards lie below a root.
ALIASES = {"web": "web/*.parquet", "code": "code/*.parquet", "wiki": "wiki/*.xml", "qa": "qa/*.csv", "news": "news/*.json"}


def hub(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The shards of a named data set below a root, by the format of its alias."""
    path = f"{root.rstrip('/')}/{ALIASES[name]}"
    readers = {"parquet": parquet, "xml": wiki_dump, "csv": question_csv, "json": news_json}
    return readers[path.rsplit(".", 1)[1]](spark, path)


def parquet(spark: SparkSession, path: str, *columns: str, skip_corrupt: bool = False) -> DataFrame:
    """Parquet shards; unreadable files are passed over if asked."""
    df = spark.read.option("ignoreCorruptFiles", str(skip_corrupt).lower()).parquet(path)
    return df.select(*columns) if columns else df


def delimited(spark: SparkSession, path: str, end: str = END) -> DataFrame:
    """text: the non-empty documents of files that join them by an end mark."""
    x = spark.read.option("lineSep", end).text(path)
    return x.select(strip("value").alias("text")).where("text <> ''")


def _header(name: str) -> Column:
    return F.regexp_extract("head", rf"(?m)^{name}: ?(.*?)\r?$", 1)


def web_archive(spark: SparkSession, path: str, mark: str = "WARC/1.0\n", most_header_lines: int = 25, drop_first_line: bool = True) -> DataFrame:
    """url (lower case), lan, type, contents: the records of text archives. Give `WARC/1.0\\r\\n` for files with such line ends.

    Records without a target, those whose header exceeds the limit and the leading information
    record are left out.
    """
    x = spark.read.option("lineSep", mark).text(path).withColumn("value", F.regexp_replace("value", "\r\n", "\n"))
    parts = F.split("value", "\n\n", 2)
    x = x.select(F.get(parts, F.lit(0)).alias("head"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("body"))
    x = x.where((F.size(F.split("head", "\n")) <= most_header_lines) & (_header("WARC-Type") != "warcinfo"))
    body = F.regexp_replace("body", r"^[^\n]*\n?", "") if drop_first_line else F.col("body")
    lan = _header("WARC-Identified-Content-Language")
    x = x.select(F.lower(_header("WARC-Target-URI")).alias("url"), F.when(lan != "", lan).alias("lan"), _header("Content-Type").alias("type"), body.alias("contents"))
    return x.where("url <> ''")


WIKI = T.StructType([T.StructField("title", T.StringType()), T.StructField("redirect", T.StructType([T.StructField("_title", T.StringType())])), T.StructField("revision", T.StructType([T.StructField("text", T.StringType())]))])


def wiki_dump(spark: SparkSession, path: str) -> DataFrame:
    """title, text of the pages that are no redirect and not blank."""
    x = spark.read.format("xml").option("rowTag", "page").schema(WIKI).load(path)
    return x.where("redirect IS NULL").select("title", F.col("revision.text").alias("text")).where(F.coalesce(strip("text") != "", F.lit(False)))


def page_views(spark: SparkSession, *paths: str) -> DataFrame:
    """project, title, count of space-separated lines."""
    v = F.split("value", " ")
    return spark.read.text(list(paths)).select("value", F.get(v, F.lit(0)).alias("project"), F.get(v, F.lit(1)).alias("title"), F.expr("try_cast(get(split(value, ' '), 2) AS BIGINT)").alias("count"))


QA = "`Post Id` BIGINT, `Parent Id` DOUBLE, PostType STRING, Body STRING"


def question_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, parent, kind, body."""
    x = spark.read.schema(QA).csv(path, header=True, multiLine=True, quote='"', escape='"')
    return x.select(F.col("Post Id").alias("id"), F.col("Parent Id").cast("bigint").alias("parent"), F.col("PostType").alias("kind"), F.col("Body").alias("body"))


def transcript_csv(spark: SparkSession, path: str) -> DataFrame:
    """id, text of lines whose commas also stand inside the text: field 0, and all but the first two and last seven, without the quotes around."""
    p = F.split("value", ",")
    n = F.size(p)
    text = F.array_join(F.slice(p, 3, F.greatest(n - 9, F.lit(0))), "")
    x = spark.read.text(path).where(F.size(p) > 9)
    return x.select(F.get(p, F.lit(0)).alias("id"), F.substring(text, 2, F.greatest(F.length(text) - 2, F.lit(0))).alias("text"))


def news_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("language STRING, title STRING, text STRING").json(path, multiLine=True)


def json_records(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    r = spark.read.schema(schema) if schema else spark.read
    return r.json(path, multiLine=multi_line)


def labelled_json(spark: SparkSession, path: str) -> DataFrame:
    """text, label from an object of positive and negative texts."""
    x = spark.read.schema("positive ARRAY<STRING>, negative ARRAY<STRING>").json(path, multiLine=True)
    one = lambda c, v: x.select(F.explode(c).alias("text"), F.lit(v).alias("label"))
    return one("positive", 1).unionByName(one("negative", 0))


def string_list(spark: SparkSession, path: str, name: str = "url") -> DataFrame:
    """A JSON array of strings as one column."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias(name))


def whole_files(spark: SparkSession, path: str, pattern: str | None = None, recursive: bool = True, skip_numbered: bool = False) -> DataFrame:
    """path, text: one document a file. skip_numbered leaves out names that start with a digit."""
    r = spark.read.option("recursiveFileLookup", str(recursive).lower())
    r = r.option("pathGlobFilter", pattern) if pattern else r
    x = r.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    return x.where(~F.substring_index("path", "/", -1).rlike(r"^\d")) if skip_numbered else x


def books(spark: SparkSession, path: str) -> DataFrame:
    """Files that say within 10,000 characters that they are English, in ASCII letters where there are any."""
    x = whole_files(spark, path).where(F.contains(F.substring("text", 1, 10_000), F.lit("Language: English")))
    return x.withColumn("text", strip_accents(F.col("text")))


def text_set(spark: SparkSession, path: str, most_files: int | None = None, as_dict: bool = False) -> DataFrame:
    """path, text of the first files by path; as_dict: one row with a map of name to text, for small sets only."""
    x = whole_files(spark, path)
    x = x if most_files is None else x.orderBy("path").limit(most_files)
    return x if not as_dict else x.agg(F.map_from_entries(F.collect_list(F.struct(F.substring_index("path", "/", -1), "text"))).alias("texts"))


def text_stats(texts: DataFrame) -> DataFrame:
    """n_files, n_chars of a text set."""
    return texts.agg(F.count("*").alias("n_files"), F.coalesce(F.sum(F.length("text")), F.lit(0)).cast("long").alias("n_chars"))


def file_list(spark: SparkSession, path: str, suffix: str = ".py") -> DataFrame:
    """path, length of the files below a folder."""
    x = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(path)
    return x.select("path", "length")


def url_manifest(spark: SparkSession, path: str, prefix: str = "") -> DataFrame:
    """url: the lines of a path list behind a prefix."""
    return spark.read.text(path).select(strip("value").alias("v")).where("v <> ''").select(F.concat(F.lit(prefix), "v").alias("url"))


def lines(spark: SparkSession, path: str) -> DataFrame:
    """value: the lines of text files, such as blog exports whose fields are not quoted."""
    return spark.read.text(path)


def segment_urls(spark: SparkSession, path: str, prefix: str) -> DataFrame:
    """url: the files below a folder of segments, by the last four parts of their paths (folder, segment, kind, file)."""
    p = F.split("path", "/")
    return file_list(spark, path, "").select(F.concat(F.lit(prefix), F.array_join(F.slice(p, F.size(p) - 3, F.lit(4)), "/")).alias("url"))


def corpus_text(spark: SparkSession, path: str, lower: bool = True, end: bool = True, newlines: bool = False, share: float = 1.0) -> DataFrame:
    """path, text: files lower-cased, without end marks, newlines as spaces, as asked; a share of the files, always the same, if below 1."""
    x = whole_files(spark, path)
    x = x if share >= 1 else x.where(keep("path", share))
    c = F.lower("text") if lower else F.col("text")
    c = F.replace(c, F.lit(END), F.lit("")) if end else c
    return x.select("path", (c if newlines else F.translate(c, "\n", " ")).alias("text"))


def link_directory(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a JSON object url -> {filepath, n_visits, urls}."""
    x = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string, struct<filepath string, n_visits int, urls array<string>>>")).alias("node", "v"))
    return x.select("node", "v.filepath", "v.n_visits"), x.select(F.col("node").alias("src"), F.explode("v.urls").alias("dst"))


def stats_json(spark: SparkSession, path: str) -> DataFrame:
    """name, step, tokens, loss of a training run's record."""
    x = spark.read.schema("tokens ARRAY<DOUBLE>, losses ARRAY<DOUBLE>, name STRING").json(path, multiLine=True)
    return x.select("name", F.posexplode(F.arrays_zip("tokens", "losses")).alias("step", "v")).select("name", "step", F.col("v.tokens").alias("tokens"), F.col("v.losses").alias("loss"))
