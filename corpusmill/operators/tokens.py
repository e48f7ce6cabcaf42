"""Byte-pair encoding and training windows over arrays of token ids."""

from __future__ import annotations

import heapq
import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.functions.arrow import by_pieces, each, pieces
from corpusmill.functions.expr import col, let
from corpusmill.sources.scratch import cut


def word_frequencies(docs: DataFrame, text: str = "text", least: int = 1, word_end: str = " ") -> DataFrame:
    """word (with a space behind it), n: what training needs of a corpus."""
    return docs.select(F.explode(F.split(text, " ")).alias("w")).where("w <> ''").groupBy(F.concat("w", F.lit(word_end)).alias("word")).agg(F.count("*").alias("n")).where(F.col("n") >= least)


def alphabet(docs: DataFrame, text: str = "text") -> list[str]:
    """The distinct characters of the texts, sorted: at most as many as Unicode has."""
    got = docs.select(F.explode(F.array_distinct(F.split(text, ""))).alias("c")).where("c <> ''").distinct().collect()
    return sorted(r["c"] for r in got)


#: Words are held as int32 symbols, a 0 before, between and behind them; symbol i + 1 is the i-th known token.
def _pack(words: pa.Array, chars: np.ndarray) -> np.ndarray:
    """Words as symbols, given the sorted code points of all words."""
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False)
    x = np.frombuffer("".join(words.to_pylist()).encode("utf-32-le"), "<u4")
    out = np.zeros(len(x) + len(lengths) + 1, np.int32)
    out[np.arange(len(x)) + np.repeat(np.arange(1, len(lengths) + 1), lengths)] = np.searchsorted(chars, x) + 1
    return out


def _merged(x: np.ndarray, merges: list[tuple[int, int, int]]) -> np.ndarray:
    """Symbols with every (first, second) made (new), from left to right; the pairs share no symbol."""
    for a, b, new in merges:
        hit = np.flatnonzero((x[:-1] == a) & (x[1:] == b))
        if not len(hit):
            continue
        if a == b:  # every other one of a run
            i = np.arange(len(hit))
            hit = hit[(i - np.maximum.accumulate(np.where(np.diff(hit, prepend=-2) > 1, i, 0))) % 2 == 0]
        rest = np.ones(len(x), bool)
        rest[hit + 1] = False
        x = x.copy()
        x[hit] = new
        x = x[rest]
    return x


def _pair_sums(parts: Iterator[tuple[np.ndarray, np.ndarray]], known: list[str]) -> Iterator[tuple[list[str], list[str], np.ndarray]]:
    """first, second, n of the adjacent tokens in (symbols, word counts), a few parts at a time."""
    k, dense = len(known) + 1, None
    for x, n in parts:
        ok = np.flatnonzero((x[:-1] != 0) & (x[1:] != 0))
        key = x[:-1][ok].astype(np.int64) * k + x[1:][ok]
        weight = n[(np.cumsum(x == 0, dtype=np.int32) - 1)[ok]]
        if k <= 2048:  # sums below 2^53 are exact
            got = np.bincount(key, weight, k * k)
            dense = got if dense is None else dense + got
            continue
        keys, at = np.unique(key, return_inverse=True)
        yield [known[i - 1] for i in (keys // k).tolist()], [known[i - 1] for i in (keys % k).tolist()], np.bincount(at, weight, len(keys)).astype(np.int64)
    if dense is not None:
        keys = np.flatnonzero(dense)
        yield [known[i - 1] for i in (keys // k).tolist()], [known[i - 1] for i in (keys % k).tolist()], dense[keys].astype(np.int64)


def _next_merges(top: list[tuple[int, str, str]], whole: bool, known: set[str]) -> list[tuple[str, str]]:
    """The merges that are sure to come next, given the first pairs (n, first, second) in order; whole: there are no more.

    A merge lowers the counts of pairs that have one of its tokens and makes pairs with the new
    token. Those of a pair (x, new) come from pairs (x, first) or (second, x), so they are no more
    frequent than such a pair was. Hence the next pair in order is the next merge as long as it
    shares no token with the merges before it and no pair of their tokens ties with it. A merge of
    a token with itself, and one whose token exists, may raise counts and end the list.
    """
    out, used = [], set()
    for i, (n, a, b) in enumerate(top):
        tied = [(c, d) for m, c, d in top[i + 1 :] if m == n] if out else []
        if out and ({a, b} & used or (not whole and n == top[-1][0]) or any({c, d} & used for c, d in tied)):
            break
        out.append((a, b))
        if a == b or a + b in known or a + b in used:
            break
        used |= {a, b, a + b}
    return out


def train_bpe(docs: DataFrame, size: int, text: str = "text", most_local: int = 2_000_000, word_end: str = " ", most_chars: int = 1 << 23) -> list[tuple[str, str]]:
    """At most `size` merges, most frequent pair first (ties: the smallest pair).

    The corpus is folded to the counts of all its words, which are packed as symbols. Up to
    `most_local` distinct words of `most_chars` characters in all are merged on the driver (some 100
    MB); more stay distributed, and the most frequent pairs of a step reach the driver. Both give
    the same merges. A step takes all merges that are sure to follow (see _next_merges).
    """
    words = cut(word_frequencies(docs, text, word_end=word_end))
    sizes = words.agg(F.count("*").alias("n"), F.sum(F.length("word")).alias("chars")).first()
    if not sizes["n"]:
        return []
    known = alphabet(words, "word")
    chars = np.array([ord(c) for c in known], np.int64)

    def pack(batches):
        for b in batches:
            if len(b):
                yield pa.RecordBatch.from_arrays([pa.array([_pack(b.column("word"), chars).tobytes()], pa.binary()), pa.array([b.column("n").to_numpy().tobytes()], pa.binary())], ["x", "n"])

    # one row has the words of a batch; without compression a task reads no more than a split's bytes
    state = words.mapInArrow(pack, "x binary, n binary")
    if sizes["n"] > most_local or sizes["chars"] > most_chars:
        return _learn_distributed(cut(state, "uncompressed"), known, size)
    got = state.toArrow()
    parts = [(np.frombuffer(x.as_buffer(), np.int32), np.frombuffer(n.as_buffer(), np.int64)) for x, n in zip(got.column("x"), got.column("n"))]

    def best(known: list[str]) -> list[tuple[int, str, str]]:
        sums = [(-n, a, b) for (a, b), n in _total(_pair_sums(iter(parts), known)).items()]
        return [(-n, a, b) for n, a, b in heapq.nsmallest(_MOST, sums)]

    def merge(step: list[tuple[int, int, int]]) -> None:
        parts[:] = [(_merged(x, step), n) for x, n in parts]

    return _learn(best, merge, known, size)


#: So many pairs, the most frequent ones, come to the driver in a step.
_MOST = 1000


def _learn(best, merge, known: list[str], size: int) -> list[tuple[str, str]]:
    """Merges, given what finds the most frequent pairs (n, first, second) and what applies the merges of a step."""
    number, merges = {t: i + 1 for i, t in enumerate(known)}, []
    while len(merges) < size and (top := best(known)):
        new = _next_merges(top, len(top) < _MOST, set(known))[: size - len(merges)]
        merges += new
        known = [*known, *dict.fromkeys(a + b for a, b in new if a + b not in number)]
        number = {t: i + 1 for i, t in enumerate(known)}
        merge([(number[a], number[b], number[a + b]) for a, b in new])
    return merges


def _learn_distributed(state: DataFrame, known: list[str], size: int, every: int = 16) -> list[tuple[str, str]]:
    """_learn() over rows of symbols x and word counts n, which are written anew after every so many steps."""
    todo: list[list[tuple[int, int, int]]] = []

    def current(batches, todo):
        for b in batches:
            for x, n in zip(b.column("x"), b.column("n")):
                x = np.frombuffer(x.as_buffer(), np.int32)
                for step in todo:
                    x = _merged(x, step)
                yield x, np.frombuffer(n.as_buffer(), np.int64)

    def best(known):
        def count(batches, todo=tuple(todo)):
            for f, s, c in _pair_sums(current(batches, todo), known):
                yield pa.RecordBatch.from_arrays([pa.array(f, pa.string()), pa.array(s, pa.string()), pa.array(c, pa.int64())], ["first", "second", "n"])

        sums = state.mapInArrow(count, "first string, second string, n long").groupBy("first", "second").agg(F.sum("n").alias("n"))
        return [(r["n"], r["first"], r["second"]) for r in sums.orderBy(F.desc("n"), "first", "second").limit(_MOST).collect()]

    def merge(step):
        nonlocal state, todo
        todo = [*todo, step]
        if len(todo) < every:
            return

        def advance(batches, todo=tuple(todo)):
            for x, n in current(batches, todo):
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()), pa.array([n.tobytes()], pa.binary())], ["x", "n"])

        state, todo = cut(state.mapInArrow(advance, "x binary, n binary"), "uncompressed"), []

    return _learn(best, merge, known, size)


def _total(sums) -> Counter:
    """_pair_sums() of several parts added up."""
    total: Counter = Counter()
    for f, s, c in sums:
        for a, b, n in zip(f, s, c.tolist()):
            total[a, b] += n
    return total


def expand(token: str, mapping: dict[str, tuple[str, ...]]) -> str:
    """The characters of a token, by the pairs that made it."""
    parts = mapping.get(token, (token,))
    return parts[0] if len(parts) == 1 else "".join(expand(p, mapping) for p in parts)


def merge_pass(tokens, first: str, second: str) -> Column:
    """One left-to-right merge of a pair in an array of strings, as one replacement in the joined tokens (\\x01 stands around each)."""
    joined = F.concat(F.lit("\x01"), F.array_join(col(tokens), "\x01\x01"), F.lit("\x01"))
    merged = F.replace(joined, F.lit(f"\x01{first}\x01\x01{second}\x01"), F.lit(f"\x01{first}{second}\x01"))
    parts = F.split(F.substring(merged, 2, F.greatest(F.length(merged) - 2, F.lit(0))), "\x01\x01")
    return F.when(F.size(col(tokens)) > 0, parts).otherwise(F.array().cast("array<string>"))


_byte_text = each(lambda t: t.encode().decode("latin-1").translate(_BYTES), T.StringType())


def byte_text(text) -> Column:
    """The text's UTF-8 bytes as printable characters, one each, with a space before each byte of a space: words for train_bpe and encode with word_end ''."""
    return _byte_text(col(text))


def decode_bytes(df: DataFrame, merges: list[tuple[str, str]], ids: dict[str, int], tokens: str = "tokens") -> DataFrame:
    """df plus text: what byte-level tokens stand for; special tokens as they are."""
    byte = {c: b for b, c in enumerate(_BYTE)}
    learned = {a + b for a, b in merges}
    raw = {i: bytes(byte[c] for c in t) if t in learned or t in byte else t.encode() for t, i in ids.items()}
    return df.withColumn("text", each(lambda x: b"".join([raw[i] for i in x]).decode(errors="replace"), T.StringType())(F.col(tokens)))


def _byte_characters() -> list[str]:
    """A character for every byte: itself where it prints, and otherwise the next one from 256 on."""
    plain, free = {*range(33, 127), *range(161, 173), *range(174, 256)}, iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(free)) for b in range(256)]


_BYTE = _byte_characters()
_BYTES = {b: (" " if b == 32 else "") + c for b, c in enumerate(_BYTE)}


def save_tokenizer(spark, path: str, merges: list[tuple[str, str]], chars: list[str], special: list[str]) -> None:
    """A vocabulary, its merges and its special tokens as one JSON row."""
    spark.createDataFrame([(chars, [list(m) for m in merges], special)], "chars array<string>, merges array<array<string>>, special array<string>").coalesce(1).write.json(path)


def load_tokenizer(spark, path: str) -> tuple[list[tuple[str, str]], dict[str, int]]:
    """(merges, ids): characters, merges and special tokens are numbered in this order, as encode() numbers them."""
    r = spark.read.schema("chars array<string>, merges array<array<string>>, special array<string>").json(path).first()
    merges, ids = [tuple(m) for m in r["merges"]], {}
    for t in [*sorted(r["chars"]), *(a + b for a, b in merges), *r["special"]]:
        ids.setdefault(t, len(ids))
    return merges, ids


def endless() -> Iterator[int]:
    """1 without end: a sampler for loaders that draw their own windows."""
    return itertools.repeat(1)


def encode(docs: DataFrame, merges: list[tuple[str, str]], text: str = "text", end_id: int | None = None, ids: dict[str, int] | None = None, word_end: str = " ") -> DataFrame:
    """docs plus tokens ARRAY<INT>, in Arrow batches; ids, if not given, number the sorted characters of the texts and merges, then the merges."""
    known = ids
    if known is None:
        chars = sorted({*alphabet(docs, text), *word_end, *(c for p in merges for t in p for c in t)})
        known = {}
        for t in [*chars, *(a + b for a, b in merges)]:
            known.setdefault(t, len(known))

    def encoder():
        rank = {p: i for i, p in enumerate(merges)}
        number = known
        cache: dict[str, list[int]] = {}

        def word(w: str) -> list[int]:
            got = cache.get(w)
            if got is None:
                x = list(w)
                while len(x) > 1:
                    best = min((rank.get(p, 1 << 60), i) for i, p in enumerate(zip(x, x[1:])))
                    if best[0] == 1 << 60:
                        break
                    i = best[1]
                    x[i : i + 2] = [x[i] + x[i + 1]]
                got = [number[t] for t in x]
                if len(cache) < 200_000:
                    cache[w] = got
            return got

        end = [] if end_id is None else [end_id]
        return lambda texts: [[i for w in (t or "").split(" ") if w for i in word(w + word_end)] + end for t in texts]

    return docs.withColumn("tokens", by_pieces(encoder, T.ArrayType(T.IntegerType()))(F.col(text)))


def chunks(tokens, size: int) -> Column:
    """Consecutive chunks of `size`; a rest of `size` or fewer is dropped."""

    def cut_up(t: Column) -> Column:
        n = F.floor((F.size(t) - 1) / size).cast("int")
        return F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(0))), lambda i: i < n), lambda i: F.slice(t, i * size + 1, size))

    return let(tokens, cut_up)  # else the array, such as a split text, is made anew for every chunk


def windows(df: DataFrame, length: int, per_row: int, key: str = "doc_id", tokens: str = "tokens", seed: int = 0) -> DataFrame:
    """key, start, input_ids, target_ids: hashed starts below n - (length + 1); targets are shifted by one."""
    t = F.col(tokens)
    room = F.size(t) - (length + 1)
    at = F.transform(F.sequence(F.lit(1), F.lit(per_row)), lambda i: F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"), i.cast("string"))), 1, 8), 16, 10).cast("bigint"), room).cast("int"))
    x = df.where(room > 0).select(key, t.alias("_t"), F.explode(at).alias("start"))
    return x.select(key, "start", F.slice("_t", F.col("start") + 1, length).alias("input_ids"), F.slice("_t", F.col("start") + 2, length).alias("target_ids"))


def n_windows(n_tokens, length: int) -> Column:
    return F.floor(col(n_tokens) / length)


def first_shards(shards: DataFrame, most: int, order: str = "shard", size: str = "n_tokens") -> DataFrame:
    """Shards by number until more than `most` tokens are in; the one that passes the limit is taken whole.

    Sums run over one row a shard, which is as many rows as files.
    """
    before = F.coalesce(F.sum(size).over(Window.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return shards.withColumn("before", before.cast("long")).where(F.col("before") <= most)


def uint16(tokens) -> Column:
    """Ids as they would be stored in two unsigned bytes; an id of 65,536 or more is an error, not another id."""
    t = col(tokens)
    return F.when(F.exists(t, lambda x: (x < 0) | (x > 0xFFFF)), F.raise_error(F.lit("a token id needs more than two bytes")).cast("array<int>")).otherwise(t)


def train_bpe_whole(docs: DataFrame, n_merges: int, text: str = "text", every: int = 8) -> list[tuple[str, str]]:
    """Merges over whole texts, spaces included: each step counts all adjacent pairs, takes the most frequent and merges it everywhere.

    The corpus stays distributed; the most frequent pairs of a step reach the driver, and a step
    takes all merges that are sure to follow (see _next_merges). Texts are packed as symbols a piece
    at a time and counted there, so that only sums are shuffled; merged symbols are written every
    few steps.
    """
    x = docs.where(F.col(text) != "").select(text)

    def seen(batches):
        for b in batches:
            found = [np.unique(np.frombuffer("".join(p.to_pylist()).encode("utf-32-le"), "<i4")) for p in pieces(b.column(0))]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate(found)))], ["c"])

    chars = np.array(sorted(r["c"] for r in x.mapInArrow(seen, "c int").distinct().collect()), np.int64)  # at most as many as Unicode has

    def pack(batches):
        for b in batches:
            for p in pieces(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([_pack(p, chars).tobytes()], pa.binary()), pa.array([np.ones(len(p), np.int64).tobytes()], pa.binary())], ["x", "n"])

    return _learn_distributed(x.mapInArrow(pack, "x binary, n binary"), [chr(c) for c in chars], n_merges, every)


def batches(windows_df: DataFrame, size: int) -> Iterator[list]:
    """Rows in lists of `size` for a trainer; Spark fetches the next partition meanwhile."""
    out: list = []
    for row in windows_df.toLocalIterator(prefetchPartitions=True):
        out.append(row)
        if len(out) == size:
            yield out
            out = []
    if out:
        yield out
