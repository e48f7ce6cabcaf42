"""Registered queries of readers, writers, streams and plans, with their SQL.

Each writes fixtures in the format of its reader from whole tables, into a folder of its own below
the shared folder, reads them back and returns what SQL gives on the tables themselves.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusmill.functions import metrics, text as tx
from corpusmill.functions.expr import rounded, strip
from corpusmill.functions.phrases import END, mapping, phrases
from corpusmill.operators import aggregate, code, extract, filters, relational, tokens
from corpusmill.plans import pipelines
from corpusmill.plans.catalog import _BUCKET, ORACLES, QUERIES, _any, _as_code, _chars, _cnt, _cnt_all, _fold, _inject, _injected, _list, _q, _query, _t
from corpusmill.sources import readers, writers
from corpusmill.sources.scratch import new_path
from corpusmill.streaming import streams

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"


def _text_file(df, path: str, sep: str = "\n") -> str:
    df.select(F.col(df.columns[0]).alias("value")).write.option("lineSep", sep).text(path)
    return path


# ------------------------------------------------------------------ readers and writers


@_query("parquet_shards", "SELECT doc_id, lang, n_chars FROM documents")
def _parquet_shards(s, d):
    path = new_path(s)
    writers.by_count(_t(s, d, "documents"), path, 100)
    return readers.parquet(s, path, "doc_id", "lang", "n_chars", skip_corrupt=True)


@_query("delimited_round_trip", f"SELECT {_STRIP.format('text')} AS text FROM documents WHERE {_STRIP.format('text')} <> ''")
def _delimited(s, d):
    path = new_path(s)
    writers.delimited(_t(s, d, "documents"), path, by="lang")
    return readers.delimited(s, f"{path}/lang=*")


def _records(pages, body):
    """Archive records of pages; every fifth is of another language, every seventh has no target."""
    target = F.when(F.col("page_id") % 7 == 0, "").otherwise(F.concat(F.lit("WARC-Target-URI: "), "url", F.lit("\n")))
    lan = F.when(F.col("page_id") % 5 == 0, "deu").otherwise("eng")
    return pages.select(F.concat(F.lit("WARC/1.0\nWARC-Type: conversion\n"), target, F.lit("WARC-Identified-Content-Language: "), lan, F.lit("\nContent-Type: text/plain\n\nfirst line\n"), body).alias("value"))


@_query("archive_records", "SELECT lower(url) AS url, CASE WHEN page_id % 5 = 0 THEN 'deu' ELSE 'eng' END AS lan, 'text/plain' AS type, replace(html, chr(13) || chr(10), chr(10)) || chr(10) AS contents FROM pages WHERE page_id % 7 <> 0")
def _archive_records(s, d):
    return readers.web_archive(s, _text_file(_records(_t(s, d, "pages"), F.col("html")), new_path(s)))


#: A page whose paragraphs are a whole document, behind lines that the rules drop.
_PAGE = "SELECT page_id, lower(url) AS url, p.text || chr(10) || replace(p.text, '. ', '.') || chr(10) || 'menu' || chr(10) || 'end' || chr(10) AS contents FROM (SELECT * FROM pages WHERE page_id % 7 <> 0 AND page_id % 5 <> 0) JOIN documents p ON p.doc_id = page_id"


def _pages_of_documents(s, d):
    docs = _t(s, d, "documents").select(F.col("doc_id").alias("page_id"), "text")
    body = F.concat("text", F.lit("\n"), F.replace("text", F.lit(". "), F.lit(".")), F.lit("\nmenu\nend"))
    return _records(_t(s, d, "pages").join(docs, "page_id"), body)


def _gate_sql(t: str) -> str:
    """The ten tests of a page on a column; true rejects."""
    n, w, low = f"greatest(length({t}), 1)", f"len(string_split({t}, ' '))", f"lower({t})"
    commas, marks = _cnt(low, "','"), _chars(low, ",.!?")
    tests = [
        f"length({t}) < 1500",
        _any(low, ["the previous page is sending you to", "please confirm that you and not a robot"]),
        f"6 * {_cnt_all(low, phrases('adult'))} / {n} > 0.005",
        _any(low, phrases("calls")),
        f"""{_chars(low, "abcdefghijklmnopqrstuvwxyz0123456789 .?!,'")} / {n} < 0.95""",
        f"length({t}) / {w} > 12",
        f"{marks} / {n} < 0.002",
        f"{commas} / {w} > 0.1",
        f"({commas} / {w} > 0.075 AND ({marks} - {commas}) / {n} < 0.005)",
        f"{_cnt(low, _q('-'))} / {n} > 0.01",
    ]
    return " OR ".join(f"({x})" for x in tests)


@_query(
    "archive_to_corpus",
    f"""WITH p AS ({_PAGE}), u AS (SELECT url, min(contents) AS c FROM p WHERE NOT ({_any('url', phrases('url_paths') + phrases('url_shops'))}) GROUP BY url),
    g AS (SELECT url, array_to_string(list_filter(string_split(c, chr(10))[:-2], lambda x: length(x) > 100 AND {_chars('x', ',.!?')} / length(x) >= 0.005), chr(10)) AS c FROM u),
    k AS (SELECT url, array_to_string(list_filter(regexp_extract_all(c, '(?s)[^.?!]+|[.?!]'), lambda p: len(string_split(p, ' ')) <= 100), '') AS c FROM g WHERE NOT ({_gate_sql('c')})),
    m AS (SELECT url, {_fold('c', mapping('page_punct').items())} AS c FROM k)
    SELECT url, regexp_replace(c, '\\.([A-Z])', '. \\1', 'g') AS contents FROM m WHERE NOT regexp_matches(c, '[^\\x20-\\x7E\\n\\t]')""",
)
def _archive_to_corpus(s, d):
    x = pipelines.clean_web_archive(s, _text_file(_pages_of_documents(s, d), new_path(s)))
    return x.select("url", "contents")


@_query("archive_rewrite", ORACLES["archive_to_corpus"])
def _archive_rewrite(s, d):
    """The same as files rewritten in two runs; the second finds nothing to do."""
    src, out = _text_file(_pages_of_documents(s, d), new_path(s)), new_path(s)
    pipelines.rewrite_archives(s, src, out)
    return pipelines.rewrite_archives(s, src, out)


@_query("wiki_dump", f"SELECT 'Title ' || doc_id AS title, {_STRIP.format('text')} AS text FROM documents WHERE doc_id % 10 <> 0 AND {_STRIP.format('text')} <> ''")
def _wiki_dump(s, d):
    redirect = F.when(F.col("doc_id") % 10 == 0, F.struct(F.lit("Other").alias("_title")))
    page = _t(s, d, "documents").select(F.concat(F.lit("Title "), F.col("doc_id").cast("string")).alias("title"), redirect.alias("redirect"), F.struct("text").alias("revision"))
    path = new_path(s)
    page.write.format("xml").option("rowTag", "page").option("rootTag", "mediawiki").save(path)
    return readers.wiki_dump(s, path).select("title", strip("text").alias("text"))


#: Lines of page views: title User_<id>, the day's events.
def _view_lines(s, d):
    c = _t(s, d, "events").groupBy("user_id", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    project = F.when(F.col("user_id") % 11 == 0, "de").otherwise("en")
    title = F.concat(F.when(F.col("user_id") % 13 == 0, "File:").otherwise("User_"), F.col("user_id").cast("string"))
    return c.select(F.concat_ws(" ", project, title, F.col("n").cast("string"), F.lit("0")))


_VIEW_SQL = "SELECT CASE WHEN user_id % 11 = 0 THEN 'de' ELSE 'en' END AS project, (CASE WHEN user_id % 13 = 0 THEN 'File:' ELSE 'User_' END) || user_id AS title, count(*) AS n FROM events GROUP BY user_id, CAST(ts AS DATE)"


@_query("view_lines", f"SELECT project, title, n AS count, project = 'en' AND NOT contains(lower(title), 'file:') AS kept FROM ({_VIEW_SQL})")
def _view_file(s, d):
    x = readers.page_views(s, _text_file(_view_lines(s, d), new_path(s)))
    return x.select("project", "title", "count", filters.page_view_line("value").alias("kept"))


@_query(
    "wiki_by_views",
    f"""WITH v AS (SELECT translate(lower(title), ' _', '') AS key, n AS x FROM ({_VIEW_SQL}) WHERE project = 'en' AND NOT contains(lower(title), 'file:')),
    m AS (SELECT key, floor(median(x)) AS m, count(*) AS n FROM v GROUP BY key HAVING count(*) >= 5), y AS (SELECT v.key, n, least(x, 2 * m) AS y FROM v JOIN m ON v.key = m.key),
    s AS (SELECT key, 3 / (.1 + stddev_pop(y)) + 4 * avg(y) * pow(n, .333) AS score FROM y GROUP BY key, n),
    t AS (SELECT 'user' || doc_id AS key, {_STRIP.format('text')} AS text FROM documents)
    SELECT key, round(score, 6) AS score, text FROM s JOIN t USING (key) WHERE score > 10 AND length(text) >= 300""",
)
def _wiki_by_views(s, d):
    # the documents' characters that are markup are what wiki_text covers; here the joins and gates count
    pages = _t(s, d, "documents").select(F.concat(F.lit("User "), F.col("doc_id").cast("string")).alias("title"), "text")
    views = readers.page_views(s, _text_file(_view_lines(s, d), new_path(s)))
    scores = aggregate.view_scores(views.where(filters.page_view_line("value")).select(tx.title_key("title").alias("key"), "count"), cutoff=10.0)
    x = relational.with_scores(pages, scores, cutoff=10.0).withColumn("text", strip("text"))
    return x.where(F.length("text") >= 300).select("key", rounded("score", 6).alias("score"), "text")


@_query("question_file", "SELECT conv_id * 100 + turn AS id, CASE WHEN role <> 'user' THEN conv_id * 100 + turn - 1 END AS parent, CASE WHEN role = 'user' THEN 'Question' ELSE 'Answer' END AS kind, replace('<p>' || text || '</p>', chr(13), '') AS body FROM conversations")
def _question_file(s, d):
    i = F.col("conv_id") * 100 + F.col("turn")
    x = _t(s, d, "conversations").select(i.alias("Post Id"), F.when(F.col("role") != "user", (i - 1).cast("double")).alias("Parent Id"), F.when(F.col("role") == "user", "Question").otherwise("Answer").alias("PostType"), F.concat(F.lit("<p>"), F.translate("text", "\r", ""), F.lit("</p>")).alias("Body"))
    path = new_path(s)
    x.write.csv(path, header=True, quote='"', escape='"')
    return readers.question_csv(s, path)


@_query("transcript_lines", "SELECT CAST(doc_id AS VARCHAR) AS id, replace(replace(text, chr(10), ' '), ',', '') AS text FROM documents")
def _transcript_lines(s, d):
    line = F.concat(F.col("doc_id").cast("string"), F.lit(',x,"'), F.translate("text", "\n", " "), F.lit('",a,b,c,d,e,f,g'))
    return readers.transcript_csv(s, _text_file(_t(s, d, "documents").select(line), new_path(s)))


@_query("news_files", "SELECT 'english' AS language, 'Item ' || item_id AS title, text FROM benchmark")
def _news_files(s, d):
    path = new_path(s)
    x = _t(s, d, "benchmark").select("item_id", F.lit("english").alias("language"), F.concat(F.lit("Item "), F.col("item_id").cast("string")).alias("title"), "text")
    x.repartition(8, "item_id").write.option("maxRecordsPerFile", 1).json(path)
    return readers.news_json(s, path)


def _item_files(s, d, text):
    """One file for each benchmark item, in a folder of its number; a file ends with a newline."""
    path = new_path(s)
    _t(s, d, "benchmark").select("item_id", text.alias("value")).repartition(8, "item_id").write.partitionBy("item_id").text(path)
    return path


def _item(path: str = "path"):
    return F.regexp_extract(path, r"item_id=(\d+)", 1).cast("bigint")


@_query("corpus_files", f"SELECT item_id, replace(lower(replace(text, '{END}', '')), chr(10), ' ') || ' ' AS text FROM benchmark")
def _corpus_files(s, d):
    x = readers.corpus_text(s, _item_files(s, d, F.concat("text", F.lit(END))))
    return x.select(_item().alias("item_id"), "text")


@_query("text_set_totals", "SELECT count(*) AS n_files, CAST(sum(length(text) + 1) AS BIGINT) AS n_chars FROM benchmark")
def _text_set_totals(s, d):
    return readers.text_stats(readers.text_set(s, _item_files(s, d, F.col("text"))))


@_query("english_books", "SELECT item_id, strip_accents(text || ' Language: English') || chr(10) AS text FROM benchmark WHERE item_id % 3 = 0")
def _english_books(s, d):
    mark = F.when(F.col("item_id") % 3 == 0, " Language: English").otherwise(" Language: French")
    return readers.books(s, _item_files(s, d, F.concat("text", mark))).select(_item().alias("item_id"), "text")


@_query("file_sizes", "SELECT item_id, CAST(strlen(text) + 1 AS BIGINT) AS length FROM benchmark")
def _file_sizes(s, d):
    return readers.file_list(s, _item_files(s, d, F.col("text")), ".txt").select(_item().alias("item_id"), "length")


@_query("url_manifest", "SELECT 'https://data.example.org/' || regexp_replace(url, '^\\s+|\\s+$', '', 'g') AS url FROM pages")
def _url_manifest(s, d):
    return readers.url_manifest(s, _text_file(_t(s, d, "pages").select("url"), new_path(s)), "https://data.example.org/")


@_query("directory_lookup", "SELECT page_id, 'files/' || page_id AS filepath, CAST(length(html) AS INTEGER) AS n_visits FROM pages WHERE page_id % 4 <> 1")
def _directory_lookup(s, d):
    p = _t(s, d, "pages")
    key = F.concat(F.lit("p"), F.col("page_id").cast("string"))
    entry = F.struct(F.concat(F.lit("files/"), F.col("page_id").cast("string")).alias("filepath"), F.length("html").alias("n_visits"), F.array("url").alias("urls"))
    # one object a file, of a bounded number of entries
    objects = p.where("page_id % 4 <> 1").groupBy(F.floor(F.col("page_id") / 500)).agg(F.to_json(F.map_from_entries(F.collect_list(F.struct(key.alias("k"), entry.alias("v"))))).alias("value")).select("value")
    path = new_path(s)
    objects.repartition(4).write.option("maxRecordsPerFile", 1).text(path)
    nodes = readers.link_directory(s, path)[0]
    return p.select("page_id", key.alias("node")).join(nodes, "node").select("page_id", "filepath", "n_visits")


@_query("size_shards", "SELECT doc_id, CAST(b // 50000 AS BIGINT) AS shard FROM (SELECT doc_id, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 3000000")
def _size_shards(s, d):
    path = new_path(s)
    writers.by_size(_t(s, d, "documents"), path, 50_000, total=3_000_000)
    return s.read.parquet(path).select("doc_id", F.col("shard").cast("long").alias("shard"))


@_query("content_store", "SELECT md5(text) AS doc_key, min(doc_id) AS doc_id FROM documents GROUP BY 1")
def _content_store(s, d):
    path = new_path(s)
    docs = _t(s, d, "documents")
    writers.content_store(docs.unionByName(docs.where("doc_id % 2 = 0")), path)
    return s.read.parquet(path).select("doc_key", "doc_id")


@_query("document_store", "SELECT doc_id FROM documents WHERE md5(substr(text, 1, 4096)) IN (SELECT md5(substr(text, 1, 4096)) FROM documents GROUP BY 1) QUALIFY row_number() OVER (PARTITION BY md5(substr(text, 1, 4096)) ORDER BY doc_id) = 1")
def _document_store(s, d):
    path = new_path(s)
    writers.document_store(_t(s, d, "documents"), path, buckets=16)
    return s.read.parquet(path).select("doc_id")


@_query("token_files", "SELECT doc_id, CAST(b // 20000 AS BIGINT) AS shard, CAST(n AS BIGINT) AS n_tokens FROM (SELECT doc_id, n, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (SELECT doc_id, len(string_split(text, ' ')) AS n FROM documents))")
def _token_files(s, d):
    path = new_path(s)
    x = _t(s, d, "documents").select("doc_id", F.transform(F.split("text", " "), lambda w: F.length(w)).alias("tokens"))
    writers.token_shards(x.withColumn("tokens", tokens.uint16("tokens")), path, 20_000)
    return s.read.parquet(path).select("doc_id", F.col("shard").cast("long").alias("shard"), F.size("tokens").cast("long").alias("n_tokens"))


@_query("crawl_todo", "SELECT page_id FROM (SELECT page_id, coalesce(sum(strlen(html)) OVER (ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM pages WHERE page_id % 3 <> 0) WHERE b < 200000")
def _crawl_todo(s, d):
    """What a manifest of finished pages lacks, up to a total size."""
    p, done = _t(s, d, "pages"), new_path(s)
    writers.manifest(p.where("page_id % 3 = 0").select("page_id"), done)
    todo = writers.resume(p, s.read.parquet(done), "page_id").select("page_id", F.octet_length("html").cast("long").alias("n"))
    return aggregate.running_shards(todo, "n", "page_id", 200_000).where("shard = 0").select("page_id")


@_query("score_file", "SELECT user_id AS key, count(*) AS score FROM events GROUP BY user_id")
def _score_file(s, d):
    path = new_path(s)
    writers.scores_json(_t(s, d, "events").groupBy(F.col("user_id").alias("key")).agg(F.count("*").alias("score")), path)
    return readers.json_records(s, path, "key BIGINT, score BIGINT", multi_line=False)


@_query("good_copy", ORACLES["make_good"].replace("FROM documents", "FROM (SELECT doc_id, text FROM documents UNION ALL SELECT page_id, html FROM pages)"))
def _good_copy(s, d):
    path = new_path(s)
    pipelines.good_copy([_t(s, d, "documents").select("doc_id", "text"), _t(s, d, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))], path)
    return s.read.parquet(path)


@_query("string_file", "SELECT url FROM pages")
def _string_file(s, d):
    path = new_path(s)
    arrays = _t(s, d, "pages").groupBy(F.floor(F.col("page_id") / 500)).agg(F.to_json(F.collect_list("url")).alias("value")).select("value")
    arrays.repartition(4).write.option("maxRecordsPerFile", 1).text(path)
    return readers.string_list(s, path)


# ------------------------------------------------------------------ streams


def _as_shards(df, path: str, least: int = 4) -> int:
    """Writes df as the shards of a stream, `least` files and more where it has more partitions; how many of them make half of the stream."""
    n = max(least, df.rdd.getNumPartitions())
    df.repartition(n).write.parquet(path)
    return -(-n // 2)


@_query("stream_gate", f"SELECT doc_id FROM {_injected(phrases('vibe'))} WHERE lang = 'en' AND length(text) > 4000 AND {_cnt_all('lower(text)', phrases('vibe'))} <= 3")
def _stream_gate(s, d):
    src, out = new_path(s), new_path(s)
    docs = _inject(_t(s, d, "documents"), phrases("vibe"))
    half = _as_shards(docs, src)
    q = streams.write(streams.filtered(streams.shards(s, src, docs.schema, half), strict=True), out, new_path(s))
    q.awaitTermination()
    return s.read.schema(docs.schema).parquet(out).select("doc_id")


@_query("stream_urls", "SELECT count(DISTINCT lower(url)) AS n FROM pages")
def _stream_urls(s, d):
    src, out = new_path(s), new_path(s)
    pages = _t(s, d, "pages").select("page_id", "url")
    half = _as_shards(pages.unionByName(pages.withColumn("url", F.upper("url"))), src, 3)
    q = streams.write(streams.unique_urls(streams.shards(s, src, pages.schema, half)), out, new_path(s))
    q.awaitTermination()
    return s.read.schema(pages.schema).parquet(out).agg(F.count("*").alias("n"))


@_query("stream_totals", "SELECT source, count(*) AS n_docs, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM documents GROUP BY source")
def _stream_totals(s, d):
    src, out = new_path(s), new_path(s)
    docs = _t(s, d, "documents")
    half = _as_shards(docs, src, 3)
    write = lambda df, batch: df.write.mode("overwrite").parquet(out)
    x = streams.totals(streams.shards(s, src, docs.schema, half))
    x.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", new_path(s)).trigger(availableNow=True).start().awaitTermination()
    return s.read.parquet(out)


# ------------------------------------------------------------------ rules and transforms


@_query("whitelist_matches", f"SELECT doc_id, CAST({' + '.join(_cnt('lower(text)', _q(x)) for x in ('quantum', 'the sea', 'zeta'))} AS BIGINT) AS n FROM {_injected(['Quantum', 'the SEA', 'zeta'])}")
def _whitelist(s, d):
    x = _inject(_t(s, d, "documents"), ["Quantum", "the SEA", "zeta"])
    return x.select("doc_id", filters.whitelist_matches("text", ["quantum", "the sea", "zeta"]).cast("long").alias("n"))


@_query("language_header", "SELECT doc_id, coalesce(CASE WHEN lang = 'en' THEN 'eng' WHEN lang = 'de' THEN 'eng,deu' WHEN lang = 'fr' THEN NULL ELSE lang END = 'eng', false) AS kept FROM documents")
def _language_header(s, d):
    h = F.when(F.col("lang") == "en", "eng").when(F.col("lang") == "de", "eng,deu").when(F.col("lang") == "fr", F.lit(None)).otherwise(F.col("lang"))
    return _t(s, d, "documents").select("doc_id", filters.language_is(h).alias("kept"))


_QA_SQL = "length(q) BETWEEN 10 AND 120 AND length(a) >= 80 AND NOT ends_with(a, '?') AND len(string_split(a, '.')) - 1 >= 2"


@_query("answer_gate", f"SELECT conv_id, turn, {_QA_SQL} AS kept FROM (SELECT u.conv_id, u.turn, substr(u.text, 1, u.turn * 40 + 5) AS q, a.text AS a FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant')")
def _answer_gate(s, d):
    x = relational.prompt_pairs(_t(s, d, "conversations"))
    return x.select("conv_id", "turn", filters.answer_ok(F.substr("prompt", F.lit(1), F.col("turn").cast("int") * 40 + 5), "response").alias("kept"))


@_query(
    "text_answers",
    f"""SELECT conv_id, q AS prompt, a AS response FROM (SELECT conv_id, 'What does number ' || conv_id || ' mean here?' AS q, regexp_replace(t, '^\\s+|\\s+$', '', 'g') || chr(10) || 'It is as it was before that. So it is here, too.' AS a
      FROM (SELECT conv_id, string_agg(regexp_replace(translate(text, '?' || chr(10), '. '), '^\\s+|\\s+$', '', 'g') , ' ' ORDER BY turn) AS t FROM conversations WHERE text IS NOT NULL GROUP BY conv_id) WHERE length(regexp_replace(t, '^\\s+|\\s+$', '', 'g')) >= 30) WHERE {_QA_SQL}""",
)
def _text_answers(s, d):
    one = strip(F.translate("text", "?\n", ". "))
    parts = _t(s, d, "conversations").where("text IS NOT NULL").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", one.alias("t")))).alias("p"))  # a conversation is one text
    t = strip(F.array_join(F.transform("p", lambda x: x["t"]), " "))
    whole = F.concat(F.lit("Some words first.\nWhat does number "), F.col("conv_id").cast("string"), F.lit(" mean here?\n\n"), t, F.lit("\nIt is as it was before that. So it is here, too.\n"))
    x = parts.where(F.length(t) >= 30).select("conv_id", whole.alias("text"))
    return extract.question_answers(x).select("conv_id", "prompt", "response")


_CORRECT_SQL = "regexp_replace({}, '(?i)\\b{}\\b', '{}', 'g')"


def _correct_sql(t: str) -> str:
    for a, b in (mapping("british") | mapping("split_words")).items():
        t = _CORRECT_SQL.format(t, a, b)
    return _fold(t, [p for n in ("quotes", "dashes", "spacing") for p in mapping(n).items()])


_BOUNDARY_PROBE = ["Colour", "GREY", "analyse,", "theatre—centre", "deeplearning"]


@_query("correct_boundaries", f"SELECT doc_id, {_correct_sql('text')} AS text FROM {_injected(_BOUNDARY_PROBE)}")
def _correct_boundaries(s, d):
    return _inject(_t(s, d, "documents"), _BOUNDARY_PROBE).select("doc_id", tx.correct_boundaries("text").alias("text"))


@_query("normalize_symbols")
def _normalize_symbols(s, d):
    return _inject(_t(s, d, "documents"), ["Colour", "½", "«x»"]).select("doc_id", tx.normalize_symbols("text").alias("text"))


@_query("clean_text")
def _clean_text(s, d):
    return _inject(_t(s, d, "documents"), ["teh", "©", "pyhton"]).select("doc_id", tx.clean_text("text", "xyz").alias("text"))


@_query("wiki_html", "SELECT page_id, regexp_replace(array_to_string(list_transform(list_transform(string_split(t, '<p>')[2:], lambda p: replace(replace(replace(regexp_replace(string_split(p, '</p>')[1], '^\\s+|\\s+$', '', 'g'), '&#91;', '['), '&#93;', ']'), chr(10), ' ')), lambda p: regexp_replace(regexp_replace(regexp_replace(p, '<a href=\"/wiki/[^\"<>]*\"(?: class=\"[^\"<>]*\")?(?: title=\"([^\"<>]*)\")[^<>]*>[^<>]*</a>', '\\1', 'g'), '<sup id=\"[A-Za-z0-9_.-]*\" class=\"reference\"><a href=\"#cite_note-[^\"]*\">[^<]*</a></sup>', '', 'g'), '<[^>]*>', '', 'g')), chr(10)), ' {2,}', ' ', 'g') AS text FROM (SELECT page_id, html || '<p>a <a href=\"/wiki/B\" title=\"B title\">b</a>  c&#91;1&#93;<sup id=\"r-1\" class=\"reference\"><a href=\"#cite_note-1\">x</a></sup></p>' AS t FROM pages)")
def _wiki_html(s, d):
    more = '<p>a <a href="/wiki/B" title="B title">b</a>  c&#91;1&#93;<sup id="r-1" class="reference"><a href="#cite_note-1">x</a></sup></p>'
    return _t(s, d, "pages").select("page_id", tx.wiki_html(F.concat("html", F.lit(more))).alias("text"))


@_query("transcript_html", "SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(replace('<font color=\"x\">' || text || '</font> &amp;  end', '&amp;', '&'), '</?font[^>]*>', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g') AS text FROM documents WHERE NOT contains(text, '&')")
def _transcript_html(s, d):
    t = F.concat(F.lit('<font color="x">'), "text", F.lit("</font> &amp;  end"))
    return _t(s, d, "documents").where(~F.contains("text", F.lit("&"))).select("doc_id", tx.transcript_html(t).alias("text"))


_LATIN = list(mapping("transliterate").items())


@_query("transliterate", f"SELECT doc_id, regexp_replace({_fold('text', _LATIN)}, '[\\x{{0400}}-\\x{{04ff}}\\x{{3040}}-\\x{{30ff}}\\x{{3400}}-\\x{{4dbf}}\\x{{4e00}}-\\x{{9fff}}]', '?', 'g') AS text FROM {_injected(['東', 'д', '⅓', '♪'])}")
def _transliterate(s, d):
    return _inject(_t(s, d, "documents"), ["東", "д", "⅓", "♪"]).select("doc_id", tx.transliterate("text").alias("text"))


@_query("question_documents", "SELECT conv_id * 100 + turn AS id, 'Question:' || chr(10) || text || chr(10) || chr(10) || coalesce((SELECT string_agg('Answer:' || chr(10) || a.text || chr(10) || chr(10), '' ORDER BY a.turn) FROM conversations a WHERE a.conv_id = q.conv_id AND a.role <> 'user' AND a.turn = q.turn + 1), '') || '<|endoftext|>' AS text FROM conversations q WHERE role = 'user'")
def _question_documents(s, d):
    return QUERIES["question_map"](s, d).select("id", tx.question_document("question", F.map_values("answers")).alias("text"))


@_query("question_map")
def _question_map(s, d):
    i = F.col("conv_id") * 100 + F.col("turn")
    posts = _t(s, d, "conversations").select(i.alias("id"), F.when(F.col("role") != "user", i - 1).alias("parent"), F.when(F.col("role") == "user", "Question").otherwise("Answer").alias("kind"), F.col("text").alias("body"))
    return aggregate.answers_of(posts)


# ------------------------------------------------------------------ extraction


@_query("wiki_links", "SELECT page_id, unnest(list_distinct(list_filter(regexp_extract_all(t, 'href=\"/wiki/([^\"#]+)\"', 1), lambda x: NOT regexp_matches(x, '^(Category|Help|Special|Wikipedia|Portal):|^Main_Page$|redirect') AND x <> 'Own'))) AS link FROM (SELECT page_id, html || '<a href=\"/wiki/A' || (page_id % 7) || '\"> <a href=\"/wiki/Help:X\"> <a href=\"/wiki/Own\"> <a href=\"/wiki/A' || (page_id % 7) || '\"> <a href=\"/wiki/B#c\">' AS t FROM pages)")
def _wiki_links(s, d):
    k = (F.col("page_id") % 7).cast("string")
    t = F.concat("html", F.lit('<a href="/wiki/A'), k, F.lit('"> <a href="/wiki/Help:X"> <a href="/wiki/Own"> <a href="/wiki/A'), k, F.lit('"> <a href="/wiki/B#c">'))
    return _t(s, d, "pages").select("page_id", F.explode(extract.wiki_links(t, F.lit("Own"))).alias("link"))


@_query("page_view_figures", "SELECT page_id, CASE WHEN page_id % 2 = 0 THEN page_id * 1234 END AS views FROM pages")
def _page_view_figures(s, d):
    n = F.format_number(F.col("page_id") * 1234, 0)
    t = F.when(F.col("page_id") % 2 == 0, F.concat("html", F.lit('<td>Page views in the past 30 days</td>\n<td><a href="x">'), n, F.lit("</a></td>"))).otherwise(F.col("html"))
    return _t(s, d, "pages").select("page_id", extract.page_views(t).alias("views"))


@_query("prefixed_links", "SELECT page_id, link FROM (SELECT page_id, unnest(['2024/a' || page_id, '2024/end']) AS link FROM pages)")
def _prefixed_links(s, d):
    t = F.concat("html", F.lit(' <a href="https://n.example.org/2024/a'), F.col("page_id").cast("string"), F.lit('"> <a href="https://n.example.org/about"> <a href="https://n.example.org/2024/end">'))
    return _t(s, d, "pages").select("page_id", F.explode(extract.prefixed_links(t, "https://n.example.org/", "2024")).alias("link"))


@_query("caption_lines", "SELECT doc_id, line FROM (SELECT doc_id, unnest([replace(replace(text, '<', ' '), chr(10), ' '), 'second ' || doc_id]) AS line FROM documents)")
def _caption_lines(s, d):
    t = F.concat(F.lit('<text start="0" dur="1">'), F.translate("text", "<\n", "  "), F.lit('</text><text start="5">second '), F.col("doc_id").cast("string"), F.lit("</text>"))
    return _t(s, d, "documents").select("doc_id", F.explode(extract.caption_lines(t)).alias("line"))


@_query("video_ids", "SELECT page_id, unnest(list_distinct(['v' || page_id, 'w' || page_id])) AS id FROM pages")
def _video_ids(s, d):
    k = F.col("page_id").cast("string")
    t = F.concat("html", F.lit(' "/watch?v=v'), k, F.lit('&t=3" "/watch?v=w'), k, F.lit('t=9" "/watch?v=v'), k, F.lit('"'))
    return _t(s, d, "pages").select("page_id", F.explode(extract.video_ids(t)).alias("id"))


@_query("new_video_links", "SELECT DISTINCT 'watch?v=a' || (page_id % 50) AS link FROM pages WHERE page_id % 50 NOT IN (SELECT page_id FROM pages WHERE page_id % 3 = 0)")
def _new_video_links(s, d):
    p = _t(s, d, "pages")
    t = F.concat("html", F.lit(" /watch?v=a"), (F.col("page_id") % 50).cast("string"))
    known = p.where("page_id % 3 = 0").select(F.concat(F.lit("watch?v=a"), F.col("page_id").cast("string")).alias("link"))
    return extract.new_links(p.select(t.alias("t")), extract.video_links("t"), known)


@_query("balanced_objects", "SELECT doc_id, '{' || translate(text, '{}', '') || '{a}}' AS object FROM documents")
def _balanced_objects(s, d):
    t = F.concat(F.lit("} lead {"), F.translate("text", "{}", ""), F.lit("{a}} and {b} }"))
    return _t(s, d, "documents").select("doc_id", extract.balanced_json(t).alias("object"))


# ------------------------------------------------------------------ code, tokens, order


@_query("comment_lines")
def _comment_lines(s, d):
    return _t(s, d, "documents").select("doc_id", metrics.comment_lines(_as_code()).alias("c")).select("doc_id", "c.*")


@_query("code_comments")
def _code_comments(s, d):
    return _t(s, d, "documents").select("doc_id", code.comment_text(_as_code()).alias("comments"))


@_query("python_files")
def _python_files(s, d):
    files = _t(s, d, "documents").select("doc_id", F.concat(F.lit("src/f"), F.col("doc_id").cast("string"), F.lit(".py")).alias("path"), _as_code().alias("content"))
    return code.python_files(files).select("doc_id", "path")


@_query("code_shard")
def _code_shard(s, d):
    c = F.concat(F.lit("import numpy\n"), _as_code())
    x = _t(s, d, "documents").select("doc_id", c.alias("content"), F.octet_length(c).alias("size"), F.concat((F.col("doc_id") % 8 + 2014).cast("string"), F.lit("-01-01")).alias("max_forks_repo_forks_event_min_datetime"))
    return code.code_shard(x).select("doc_id", "content")


@_query("char_freq_sample", f"SELECT c, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS c FROM documents WHERE {_BUCKET} < 500) WHERE c <> '' GROUP BY c")
def _char_freq_sample(s, d):
    return aggregate.char_counts(relational.sample(_t(s, d, "documents"), "doc_id", 0.05))


@_query("sorted_lengths", "SELECT source, list_sort(list(length(text)), 'DESC') AS lengths FROM documents GROUP BY source")
def _sorted_lengths(s, d):
    x = _t(s, d, "documents").groupBy("source").agg(F.collect_list(F.length("text").cast("long")).alias("v"))  # one number a document
    return x.select("source", relational.sorted_desc("v").alias("lengths"))


@_query("shuffled_ids", "SELECT doc_id, row_number() OVER (ORDER BY md5('7:' || doc_id), doc_id) - 1 AS place FROM documents")
def _shuffled_ids(s, d):
    """The places that a seeded shuffle gives, by ranks in two steps."""
    x = _t(s, d, "documents").select(F.concat(F.lit("7:"), F.col("doc_id").cast("string")).alias("k"), "doc_id")
    return relational.ranked(x, "k").select("doc_id", F.col("rank").alias("place"))


@_query("merge_pass", "SELECT doc_id, string_split(substr(m, 2, length(m) - 2), chr(1) || chr(1)) AS tokens FROM (SELECT doc_id, replace(chr(1) || array_to_string(string_split(text, ''), chr(1) || chr(1)) || chr(1), chr(1) || 't' || chr(1) || chr(1) || 'h' || chr(1), chr(1) || 'th' || chr(1)) AS m FROM documents WHERE text <> '')")
def _merge_pass(s, d):
    t = F.filter(F.split("text", ""), lambda c: c != "")
    return _t(s, d, "documents").where("text <> ''").select("doc_id", tokens.merge_pass(t, "t", "h").alias("tokens"))


@_query("byte_level_bpe", "SELECT doc_id, text FROM documents")
def _byte_level_bpe(s, d):
    """Trained on bytes, saved, loaded, encoded, and decoded back to the texts."""
    docs = _t(s, d, "documents").select("doc_id", "text")
    x = docs.withColumn("b", tokens.byte_text("text"))
    path = new_path(s)
    tokens.save_tokenizer(s, path, tokens.train_bpe(x, 64, "b", word_end=""), [c for c in tokens.alphabet(x, "b") if c != " "], [END])
    merges, ids = tokens.load_tokenizer(s, path)
    return tokens.decode_bytes(tokens.encode(x, merges, "b", ids=ids, word_end=""), merges, ids).select("doc_id", "text")


@_query("whole_text_merges")
def _whole_text_merges(s, d):
    merges = tokens.train_bpe_whole(_t(s, d, "documents"), 3)
    return s.createDataFrame([(i, a, b) for i, (a, b) in enumerate(merges)], "step int, first string, second string")
