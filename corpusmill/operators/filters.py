"""Filters as Columns: true keeps the row. Thresholds are strict or not as the rules demand.

Verdicts that keep a small random share take the document's key and use a hash of it, so that
the same documents are kept everywhere. Counts and verdicts before sampling have functions of
their own.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import by_pieces
from corpusmill.functions.expr import alternation, col, contains_any, count_all, count_chars, count_of, keep, strip, words
from corpusmill.functions.phrases import phrases

LETTERS = "abcdefghijklmnopqrstuvwxyz"


# ------------------------------------------------------------------ documents


def vibe_hits(text) -> Column:
    return count_all(F.lower(col(text)), phrases("vibe"))


def vibe_check(text, threshold: int = 3) -> Column:
    """At most `threshold` occurrences of spam, adult and sermon phrases, anywhere in the lower-cased text."""
    return vibe_hits(text) <= threshold


def hard_hit(text, items=None) -> Column:
    return col(text).rlike(alternation(items or phrases("hard")))


def soft_hits(text, items=None) -> Column:
    return F.regexp_count(col(text), F.lit(alternation(items or phrases("soft"))))


def blacklist_clean(text, threshold: int = 3) -> Column:
    """No hard phrase and at most `threshold` soft ones, as whole words."""
    return ~hard_hit(text) & (soft_hits(text) <= threshold)


def blacklist(text, key, threshold: int = 3, share: float = 0.01) -> Column:
    return blacklist_clean(text, threshold) | keep(key, share)


def _automaton(items: tuple[str, ...]):
    """An automaton over literals, each with its number of copies in the list."""
    import ahocorasick

    a = ahocorasick.Automaton()
    for x, n in Counter(items).items():
        a.add_word(x, (x, n))
    a.make_automaton()
    return a


def literal_counter(items):
    """count_literals() as a function of a column."""
    items = tuple(items)

    def counter():
        a = _automaton(items)

        def one(t: str) -> int:
            n, ends = 0, {}
            for end, (x, k) in a.iter(t):
                # occurrences of one literal do not overlap
                if ends.get(x, -1) < end - len(x) + 1:
                    ends[x] = end
                    n += k
            return n

        return lambda texts: [None if t is None else one(t) for t in texts]

    return by_pieces(counter, T.LongType())


def count_literals(text, items) -> Column:
    """count_all() in one pass over each text, however many literals there are: an automaton over Arrow batches."""
    return literal_counter(items)(col(text))


def topic_hits(text, keywords=None) -> Column:
    return count_literals(F.lower(col(text)), keywords or phrases("topics"))


def topic_match(text, keywords=None, good=None, threshold: int = 3) -> Column:
    """A high-quality phrase occurs, or topic keywords occur more than `threshold` times in all."""
    return (count_literals(F.lower(col(text)), good or phrases("good_phrases")) > 0) | (topic_hits(text, keywords) > threshold)


def topic_filter(text, key, threshold: int = 3, share: float = 0.05) -> Column:
    return topic_match(text, threshold=threshold) | keep(key, share)


def whitelist_matches(text, items: list[str]) -> Column:
    return F.regexp_count(col(text), F.lit(alternation(items).replace("\\b", "")))


def web_gate(docs: DataFrame, text="text", lang="lang", key="doc_id", min_score=0.97, min_chars=2500, strict=False, chars: str | None = None) -> DataFrame:
    """English documents with a high language score (where that column exists), long enough, and clean.

    strict: the vibe check and 4,000 characters instead of the blacklist and 2,500. `chars`
    names a column of precomputed lengths, which lets the length test reach the scan.
    """
    rule = col(lang) == "en"
    if "language_score" in docs.columns:
        rule &= F.col("language_score") > min_score
    n = F.col(chars) if chars else F.length(col(text))
    rule &= n > (4000 if strict else min_chars)
    return docs.where(rule).where(vibe_check(text) if strict else blacklist(text, key))


# ------------------------------------------------------------------ pages


def url_allowed(url) -> Column:
    """No shop path and no shop name in the lower-cased URL."""
    u = F.lower(col(url))
    return ~(contains_any(u, phrases("url_paths")) | contains_any(u, phrases("url_shops")))


def url_known_good(url) -> Column:
    """URLs of a few reference, question and university sites."""
    u = col(url)
    has = lambda *xs: F.greatest(F.lit(True), F.lit(True)) if not xs else _all([F.contains(u, F.lit(x)) for x in xs])
    pairs = [("://reddit.com", "comments"), ("quora.com", "answer"), ("scholarpedia.org", "article")]
    single = "geeksforgeeks.org/python w3schools.com en.wikipedia.org stackexchange ://python.org ://britannica.com ://stanford.edu ://harvard.edu ://mit.edu ://gutenberg.org ://nytimes.com ://history.com".split()
    return _any([has(*p) for p in pairs] + [has(s) for s in single])


def _all(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out & x
    return out


def _any(xs: list[Column]) -> Column:
    out = xs[0]
    for x in xs[1:]:
        out = out | x
    return out


def language_is(header, code: str = "eng") -> Column:
    """The header names this language and no other; a missing header fails."""
    return F.coalesce(col(header) == code, F.lit(False))


def punctuation(text) -> Column:
    return count_chars(text, ",.!?")


def page_flags(text) -> Column:
    """STRUCT of the ten tests of a page; true rejects."""
    t = col(text)
    low = F.lower(t)
    n, w = F.length(t), words(low)
    commas, marks = count_of(low, ","), punctuation(low)
    share = lambda x, y: x / F.greatest(y, F.lit(1))
    return F.struct(
        (n < 1500).alias("short"),
        contains_any(low, ["the previous page is sending you to", "please confirm that you and not a robot"]).alias("interstitial"),
        (share(6 * count_all(low, phrases("adult")), n) > 0.005).alias("adult"),
        contains_any(low, phrases("calls")).alias("call_to_action"),
        (share(count_chars(low, LETTERS + "0123456789 .?!,'"), n) < 0.95).alias("alphabet"),
        (n / w > 12).alias("long_words"),
        (share(marks, n) < 0.002).alias("no_punctuation"),
        (commas / w > 0.1).alias("commas"),
        ((commas / w > 0.075) & (share(marks - commas, n) < 0.005)).alias("lists"),
        (share(count_of(low, "-"), n) > 0.01).alias("dashes"),
    )


PAGE_TESTS = ("short", "interstitial", "adult", "call_to_action", "alphabet", "long_words", "no_punctuation", "commas", "lists", "dashes")


def page_gate(text) -> Column:
    f = page_flags(text)
    return ~_any([f[x] for x in PAGE_TESTS])


def without_runons(text, most: int = 100) -> Column:
    """The text without sentences of more than `most` space-separated words; all else, terminators included, stays.

    A sentence is what stands between terminators (. ? !), so only the sentence goes.
    """
    pieces = F.regexp_extract_all(col(text), F.lit(r"(?s)[^.?!]+|[.?!]"), F.lit(0))
    return F.array_join(F.filter(pieces, lambda p: words(p) <= most), "")


def good_paragraphs(text, drop_first: bool = False, least: int = 100, keep_headings: bool = False, drop_last: bool = True) -> Column:
    """Lines longer than `least` with enough punctuation, joined by newlines.

    The first line goes if drop_first; the last is never taken unless drop_last is false.
    keep_headings also keeps a line that is followed by a long one.
    """
    lines = F.split(col(text), "\n")
    if drop_first:
        lines = F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0)))
    last = F.size(lines) - (1 if drop_last else 0)
    saved = lambda i: (F.length(F.get(lines, i + 1)) > least) if keep_headings else F.lit(False)
    full = lambda x: (F.length(x) > least) & (punctuation(x) / F.greatest(F.length(x), F.lit(1)) >= 0.005)
    return F.array_join(F.filter(F.slice(lines, 1, F.greatest(last, F.lit(0))), lambda x, i: full(x) | ((F.length(x) >= 1) & (F.length(x) <= least) & F.coalesce(saved(i), F.lit(False)))), "\n")


def heading_paragraphs(text, least: int = 100) -> Column:
    """Long lines, and non-empty short ones right before a long one; null if under 1,000 characters remain."""
    lines = F.split(col(text), "\n")
    body = F.slice(lines, 1, F.greatest(F.size(lines) - 1, F.lit(0)))
    out = F.array_join(F.filter(body, lambda x, i: (F.length(x) > least) | ((F.length(x) >= 1) & (F.length(F.get(lines, i + 1)) > least))), "\n")
    return F.when(F.length(out) >= 1000, out)


def plain_characters(text) -> Column:
    """Only ASCII letters, digits, punctuation, space, tab and newline."""
    return ~col(text).rlike(r"[^\x20-\x7E\n\t]")


# ------------------------------------------------------------------ paragraphs, transcripts, news


def paragraph_flags(text) -> Column:
    """STRUCT of the tests of a paragraph; true rejects. Symbols and the closing mark contradict, so none passes all."""
    t = col(text)
    return F.struct(
        t.rlike(r"https?://\S+|www\.\S+").alias("url"),
        t.rlike(r"```|<code>.*</code>|[#*-]|\d+\.").alias("code"),
        t.rlike(r"(?U)[^\w\s]").alias("symbols"),
        (F.regexp_count(t, F.lit(r"(?U)\w+")) < 20).alias("few_words"),
        (~strip(t).rlike(r"^[A-Z].*[.!?]$")).alias("no_sentence"),
        (F.length(t) - F.length(F.replace(t, F.lit("\n"), F.lit(""))) >= 5).alias("many_lines"),
    )


def paragraph_ok(text) -> Column:
    f = paragraph_flags(text)
    return ~_any([f[x] for x in ("url", "code", "symbols", "few_words", "no_sentence", "many_lines")])


def alphabet_share(text) -> Column:
    low = F.lower(col(text))
    return count_chars(low, LETTERS + ".?!") / F.length(low)


def alphabet_ok(text) -> Column:
    """At least half letters and end marks, and few adult words. An empty text fails."""
    low = F.lower(col(text))
    return F.coalesce((alphabet_share(text) >= 0.5) & (6 * count_all(low, phrases("adult4")) / F.length(low) <= 0.01), F.lit(False))


def transcript_ok(text) -> Column:
    """The first 5,000 characters: 500 at least, not much markup, music or applause."""
    head = F.lower(F.substring(col(text), 1, 5000))
    n = F.length(head)
    return F.coalesce((n >= 500) & (count_of(head, "font") <= 50) & (7 * count_of(head, "[music]") / n <= 0.1) & (10 * count_of(head, "[applause]") / n <= 0.1), F.lit(False))


def punctuated(text) -> Column:
    return F.coalesce(count_of(text, ".") / F.length(col(text)) > 0.005, F.lit(False))


def mentions_python(text) -> Column:
    return F.contains(F.lower(col(text)), F.lit("python"))


def news_ok(language, text) -> Column:
    return (col(language) == "english") & (count_of(text, "https") <= 30)


def page_view_line(line) -> Column:
    """English project lines that are no file, category or list."""
    low = F.lower(col(line))
    return (F.substring(col(line), 1, 3) == "en ") & ~contains_any(low, [" file:", " category:", " list_of_"])


def answer_ok(question, answer) -> Column:
    """A question of 10 to 120 characters; an answer of 80 at least, of two sentences, that does not end as a question."""
    q, a = col(question), col(answer)
    return F.length(q).between(10, 120) & (F.length(a) >= 80) & ~a.endswith("?") & (count_of(a, ".") >= 2)
