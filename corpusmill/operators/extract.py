"""Extraction: arrays of what a text holds, and frames that explode them."""

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import each
from corpusmill.functions.expr import col, strip
from corpusmill.functions.text import html_paragraphs
from corpusmill.operators.filters import answer_ok

_BRACE = re.compile(r"[{}]")
_PAIR = r"(?ms)^([A-Z][^?\n]{3,100}\?)\s*\n+((?:.{30,}\n?){2,})"


def question_answers(df: DataFrame, text: str = "text") -> DataFrame:
    """One row (prompt, response) for each question line and the text behind it that pass answer_ok."""
    part = lambda g: F.regexp_extract_all(F.col(text), F.lit(_PAIR), F.lit(g))
    x = df.select(*df.columns, F.explode(F.arrays_zip(part(1).alias("q"), part(2).alias("a"))).alias("_p"))
    x = x.select(*df.columns, strip(F.col("_p.q")).alias("prompt"), strip(F.col("_p.a")).alias("response"))
    return x.where(answer_ok("prompt", "response"))


def expand_prompts(df: DataFrame, prompts: str = "prompts", completions: str = "completions") -> DataFrame:
    """Every prompt with every completion of its own row."""
    x = df.withColumn("prompt", F.explode(prompts))
    return x.withColumn("completion", F.explode(completions)).drop(prompts, completions)


def paragraphs(text) -> Column:
    return F.array_join(html_paragraphs(text), "\n")


def links(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r'href="([^"]*)"'), F.lit(1))


def wiki_links(text, own=None) -> Column:
    """Article links, without those of other name spaces and the page itself."""
    found = F.regexp_extract_all(col(text), F.lit(r'href="/wiki/([^"#]+)"'), F.lit(1))
    other = r"^(Category|Help|Special|Wikipedia|Portal):|^Main_Page$|redirect"
    found = F.filter(found, lambda x: ~x.rlike(other))
    return F.array_distinct(found if own is None else F.filter(found, lambda x: x != col(own)))


def page_views(text) -> Column:
    """The monthly figure of an information page."""
    raw = F.regexp_extract(col(text), r'(?s)<td>Page views in the past 30 days</td>.*?<a [^>]*>([\d, ]+)</a>', 1)
    return F.translate(raw, ", ", "").try_cast("bigint")


def video_links(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"watch\?v=[A-Za-z0-9_-]+"), F.lit(0))


def question_links(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"/questions/[0-9]{6,9}/[a-z-]+"), F.lit(0))


def _behind(parts: Column) -> Column:
    """All parts but the first."""
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def prefixed_links(text, prefix: str, marker: str) -> Column:
    """What follows each prefix up to a quote, if it holds the marker."""
    quoted = "\\Q" + prefix + "\\E"
    return F.filter(F.transform(_behind(F.split(col(text), quoted)), lambda x: F.substring_index(x, '"', 1)), lambda x: F.contains(x, F.lit(marker)))


def caption_lines(text) -> Column:
    return F.regexp_extract_all(col(text), F.lit(r"text start=[^>]*>([^<]*)<"), F.lit(1))


def video_ids(text) -> Column:
    """Distinct ids after /watch?v=, cut at the quote, at & and at t=."""
    parts = _behind(F.split(col(text), r"/watch\?v="))
    return F.array_distinct(F.transform(parts, lambda p: F.substring_index(F.substring_index(F.substring_index(p, '"', 1), "&", 1), "t=", 1)))


def _balanced(text: str) -> str | None:
    start, depth = -1, 0
    for m in _BRACE.finditer(text):
        if m[0] == "{":
            start = m.start() if start < 0 else start
            depth += 1
        elif start >= 0:
            depth -= 1
            if not depth:
                return text[start : m.end()]
    return None


balanced_json = each(_balanced, T.StringType())
balanced_json.__doc__ = "The text from its first brace to the brace that closes it; null if none does."


def documents(df: DataFrame, text: str = "value", end: str = "<|endoftext|>") -> DataFrame:
    """One row for each non-empty document of delimited texts."""
    return df.select(F.explode(F.split(text, "\\Q" + end + "\\E")).alias("text")).where(strip("text") != "")


def new_links(pages: DataFrame, links: Column, known: DataFrame) -> DataFrame:
    """link: what pages link to and the known set does not hold, once each; a crawl's next frontier."""
    return pages.select(F.explode(links).alias("link")).distinct().join(known.select("link"), "link", "left_anti")
