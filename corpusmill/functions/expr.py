"""Column builders that the filters, metrics and transforms share."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def count_of(text: Column | str, phrase: Column | str) -> Column:
    """Non-overlapping occurrences of a literal."""
    t, p = col(text), F.lit(phrase) if isinstance(phrase, str) else phrase
    return F.floor((F.length(t) - F.length(F.replace(t, p, F.lit("")))) / F.length(p))


def let(value: Column | str, f: Callable[[Column], Column]) -> Column:
    """f(value) with the value computed once, however often f uses it, also within lambdas."""
    return F.get(F.transform(F.array(col(value)), f), F.lit(0))


def count_all(text: Column | str, items: Iterable[str]) -> Column:
    """Sum of the occurrences of every literal; only those that occur are counted, in one expression without a shuffle."""
    lits = F.array(*[F.lit(x) for x in items])
    return let(text, lambda t: F.aggregate(F.filter(lits, lambda p: F.contains(t, p)), F.lit(0).cast("long"), lambda a, p: a + count_of(t, p)))


def contains_any(text: Column | str, items: Iterable[str]) -> Column:
    lits = F.array(*[F.lit(x) for x in items])
    return let(text, lambda t: F.exists(lits, lambda p: F.contains(t, p)))


def count_chars(text: Column | str, chars: str) -> Column:
    """Characters of the text that are in `chars`."""
    t = col(text)
    return F.length(t) - F.length(F.translate(t, chars, ""))


def rounded(x: Column | str, digits: int) -> Column:
    """x to some digits as SQL engines on doubles round: half away from zero of the product by a power of ten."""
    return F.round(col(x) * 10.0**digits) / 10.0**digits


def words(text: Column | str) -> Column:
    """Pieces between single spaces, empty ones included."""
    return F.size(F.split(col(text), " "))


def strip(text: Column | str) -> Column:
    """Without white space at both ends (every kind, not only spaces)."""
    return F.regexp_replace(col(text), r"^(?U:\s)+|(?U:\s)+$", "")


def alternation(items: Iterable[str], flags: str = "(?i)") -> str:
    """A whole-word pattern for any of the literals."""
    quoted = ("".join(c if c.isalnum() or c == " " else "\\" + c for c in x) for x in items)
    return flags + r"\b(?:" + "|".join(quoted) + r")\b"


def bucket(key: Column | str, n: int = 10_000) -> Column:
    """A number below n from the key's md5: the same in any engine and for any partitioning."""
    return F.conv(F.substring(F.md5(col(key).cast("string")), 1, 8), 16, 10).cast("bigint") % n


def keep(key: Column | str, share: float) -> Column:
    """True for about `share` of the keys, always the same ones."""
    return bucket(key) < round(share * 10_000)


def replace_all(text: Column | str, pairs: dict[str, str] | Iterable[tuple[str, str]]) -> Column:
    """Literal replacements in order. Runs of one-character pairs that cannot feed each other are one translate()."""
    c = col(text)
    src = dst = ""
    for a, b in pairs.items() if isinstance(pairs, dict) else pairs:
        if len(a) == 1 and len(b) == 1 and a not in src + dst:
            src, dst = src + a, dst + b
            continue
        if src:
            c, src, dst = F.translate(c, src, dst), "", ""
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, src, dst) if src else c


def trie_pattern(items: Iterable[str]) -> str:
    """A regular expression for any of the literals, longest first, that reads no character twice."""
    root: dict = {}
    for x in items:
        at = root
        for c in x:
            at = at.setdefault(c, {})
        at[""] = {}

    def show(at: dict) -> str:
        parts = [re.escape(c) + show(sub) for c, sub in at.items() if c]
        if not parts:
            return ""
        body = parts[0] if len(parts) == 1 and "" not in at else "(?:" + "|".join(parts) + ")"
        return body + "?" if "" in at else body

    return show(root)
