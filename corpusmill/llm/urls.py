"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

judge() gives every URL a verdict. Where a rule fits, the longest decides. Elsewhere the list
does: the filter of all listed canonical URLs (bounded size, see BlockedBloom) is broadcast and
tested as Arrow batches; URLs that may be listed go to an exact hash join on the canonical URL,
which removes the filter's false positives; all others skip the shuffle. The result does not
depend on the filter's size.

The list of the registered query is the canonical URLs of all pages on hosts whose first label
starts with `spam` (after a leading www. or m.).

Defined results: a null URL or one without `://` has an empty host and path, fits no rule, is
never listed and is allowed; repeated rows are judged alike; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import U64, bloom_of, table

#: (host and path prefix, verdict)
RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path, both empty without `://`."""
    u = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"(?s)^.*?://([^/?#]*)", 1), _UP, _LOW)
    return host, F.regexp_extract(u, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical(url: Column) -> Column:
    """Host without www., path without trailing slashes, query without utm_ and ref parameters; null where there is no host."""
    host, path = host_path(url)
    host = F.regexp_replace(host, r"^www\.", "")
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^[^#]*?\?([^#]*)", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(r"^(utm_[^=]*|ref)(=|$)")), "&")
    return F.when(host != "", F.concat(host, F.regexp_replace(path, "/+$", ""), F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def rule_of(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict), null where none fits. Rules are tested longest first."""
    rule, verdict = F.when(F.lit(False), F.lit("")), F.when(F.lit(False), F.lit(""))
    for text, v in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(slash + p)
        rule, verdict = rule.when(fits, F.lit(text)), verdict.when(fits, F.lit(v))
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, listed. `listed` has a column url of canonical URLs."""
    host, path = host_path(F.col("url"))
    p = pages.select("page_id", "url").select("page_id", host.alias("host"), path.alias("path"), canonical(F.col("url")).alias("canonical"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    p = p.select("*", rule.alias("rule"), verdict.alias("ruled"))
    exact = listed.select(F.col("url").alias("canonical")).where("canonical is not null").distinct()
    flt = pages.sparkSession.sparkContext.broadcast(bloom_of(exact.select(F.xxhash64("canonical").alias("h")), "h"))

    @F.pandas_udf("boolean")
    def may_be_listed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for h in batches:
            yield pd.Series(flt.value.test(h.to_numpy(np.int64).view(U64)))

    p = p.withColumn("maybe", F.col("ruled").isNull() & F.col("canonical").isNotNull() & may_be_listed(F.xxhash64("canonical")))
    hits = p.where("maybe").join(exact.withColumn("hit", F.lit(True)), "canonical", "left")
    rest = p.where("not maybe").withColumn("hit", F.lit(False))
    cols = ("page_id", "host", "path", "rule", "ruled", "hit")
    out = hits.select(*cols).unionByName(rest.select(*cols))
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", F.when(F.coalesce("hit", F.lit(False)), "block").otherwise("allow")).alias("verdict"), F.coalesce("hit", F.lit(False)).alias("listed"))


def op4_url_filter(spark, sf_dir: str) -> DataFrame:
    """Every page's URL by the rules, and elsewhere by the list of spam hosts' URLs."""
    pages = table(spark, sf_dir, "pages")
    spam = host_path(F.col("url"))[0].rlike(r"^(www\.|m\.)?spam")
    return judge(pages, pages.where(spam).select(canonical(F.col("url")).alias("url")))


_HOST = f"translate(regexp_extract(u, '^.*?://([^/?#]*)', 1, 's'), '{_UP}', '{_LOW}')"
_KEPT = "array_to_string(list_filter(string_split(regexp_extract(u, '^[^#]*?\\?([^#]*)', 1, 's'), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=]*|ref)(=|$)')), '&')"
_FIT = "\n".join(
    f"WHEN (host = '{t.partition('/')[0]}' OR ends_with(host, '.{t.partition('/')[0]}')) AND starts_with(path, '/{t.partition('/')[2]}') THEN '{{{k}}}'" for k, (t, _) in enumerate(sorted(RULES, key=lambda r: (-len(r[0]), r[0])))
)
_SORTED = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(url, '') AS u FROM pages),
q AS (SELECT page_id, u, {_HOST} AS host, regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path, {_KEPT} AS kept FROM p),
r AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') || CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS canon,
        CASE {_FIT.format(*[t for t, _ in _SORTED])} END AS rule,
        CASE {_FIT.format(*[v for _, v in _SORTED])} END AS ruled FROM q),
s AS (SELECT DISTINCT canon FROM r WHERE regexp_matches(host, '^(www\\.|m\\.)?spam') AND canon IS NOT NULL)
SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN s.canon IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       ruled IS NULL AND s.canon IS NOT NULL AS listed
FROM r LEFT JOIN s ON r.canon = s.canon
"""
