"""Token counts by prefix dynamic programming, for byte-level BPE vocabularies in tokenizers' JSON form.

A vocabulary's split pattern cuts a text into pieces, and each piece is encoded on its own. For
a piece, let last[i] be the last token of the encoding of its first i bytes. It is the one
token t that ends there and forms a valid pair with last[i - len(t)]; a pair is valid if
encoding its bytes gives the pair back. So one pass gives the exact token count of every
prefix, count[i] = count[i - len(t)] + 1. Pieces repeat, so their counts are kept in a bounded
cache, and the counts of a text's prefixes are running sums over its pieces.

Three places need care, because a prefix may split otherwise than the whole text: white-space
runs (the last character of a run joins the next piece), contractions cut in the middle, and
special strings cut in the middle. All are handled, so counts[i] equals the length of the
library's encoding of text[:i] for every i.

prefix_counts() stores the counts; tokens_before() and longest_within() answer truncation and
budget questions from them, without encoding again.

Defined results: null and empty texts have no tokens; special strings inside a text are one
token, as by the library's default; repeated rows are counted alike; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

import json
import re
from array import array
from operator import sub

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, table

#: White space as the library's pattern sees it (Unicode White_Space).
_S = r"\t-\r \x85\xa0  -     　"
_EXACT = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_S}\p{{L}}\p{{N}}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_LETTER = r"A-Za-zÀ-ÖØ-öø-ɏ"
#: The same for texts of ASCII and Latin letters only, in which the standard library's faster classes do.
_LATIN = re.compile(rf"'(?:s|t|re|ve|m|ll|d)| ?[{_LETTER}]+| ?[0-9]+| ?[^{_LETTER}0-9\t-\r ]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
_NOT_LATIN = re.compile(r"[^\x00-\x7fÀ-ɏ]")
_RUN = re.compile(rf"[{_S}]{{2,}}(?=[^{_S}])")
_CUT = {"'re", "'ve", "'ll"}
#: Pieces whose counts a worker keeps (about 150 bytes each).
CACHE = 500_000


def split(text: str) -> list[str]:
    return (_EXACT if _NOT_LATIN.search(text) else _LATIN).findall(text)


def _byte_of() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids exactly as the library gives them, by the merge ranks of its JSON file."""

    _open: dict[str, Encoder] = {}

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        back = _byte_of()
        vocab = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in self.special}
        merges = [x if isinstance(x, list) else x.split(" ") for x in spec["model"]["merges"]]
        n = len(vocab) - len(merges)
        order = [vocab[bytes(back[c] for c in a + b)] for a, b in merges]
        if order != list(range(n, n + len(order))) or spec["normalizer"] or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError(f"{path}: not a plain byte-level BPE whose ids follow its merges")
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.vocab, self.longest = vocab, max(map(len, vocab))
        self.bytes = {v: k for k, v in vocab.items()}
        self.core = tiktoken.Encoding("corpusmill", pat_str=pattern, mergeable_ranks=vocab, special_tokens=self.special)
        #: Sizes of the tokens that end with each byte, longest first.
        self._ends = [sorted({len(k) for k in vocab if k[-1] == x}, reverse=True) for x in range(256)]
        self._pairs: dict[int, bool] = {}
        self._deltas: dict[str, bytes] = {}
        self._special = re.compile("|".join(map(re.escape, self.special))) if self.special else None

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._open:
            cls._open[path] = cls(path)
        return cls._open[path]

    def ids(self, text: str) -> np.ndarray:
        """uint32 ids of a whole text, special strings as the library's default has them."""
        return self.core.encode_to_numpy(text, allowed_special=set(self.special), disallowed_special=())

    def _pair(self, p: int, t: int) -> bool:
        ok = self.core._core_bpe.encode_single_piece(self.bytes[p] + self.bytes[t]) == [p, t]
        if len(self._pairs) > 2 * CACHE:
            self._pairs.clear()
        self._pairs[p << 20 | t] = ok
        return ok

    def piece_counts(self, piece: str) -> list[int]:
        """Tokens of piece[:1], piece[:2], ..., by dynamic programming."""
        b = piece.encode()
        n = len(b)
        last, count = [0] * (n + 1), [0] * (n + 1)
        ends, get, known, pair = self._ends, self.vocab.get, self._pairs.get, self._pair
        for i in range(1, n + 1):
            for size in ends[b[i - 1]]:
                j = i - size
                if j < 0:
                    continue
                t = get(b[j:i])
                if t is None:
                    continue
                if j:
                    p = last[j]
                    ok = known(p << 20 | t)
                    if ok is None:
                        ok = pair(p, t)
                    if not ok:
                        continue
                last[i], count[i] = t, count[j] + 1
                break
        if n == len(piece):
            out = count[1:]
        else:
            out = [count[i] for i in range(1, n + 1) if i == n or b[i] & 0xC0 != 0x80]
        if piece in _CUT:
            out[1] = 2
        return out

    def _piece(self, piece: str) -> bytes:
        d = self._deltas.get(piece)
        if d is None:
            c = self.piece_counts(piece)
            d = array("i", map(sub, c, [0, *c])).tobytes()
            if len(piece) <= 64:
                if len(self._deltas) > CACHE:
                    self._deltas.clear()
                self._deltas[piece] = d
        return d

    def _plain(self, text: str) -> np.ndarray:
        get = self._deltas.get
        pieces = split(text)
        out = np.cumsum(np.frombuffer(b"".join([get(x) or self._piece(x) for x in pieces]), np.int32), dtype=np.int32)
        for m in _RUN.finditer(text):
            i, j = m.span()
            out[j - 1] = (out[i - 1] if i else 0) + self.piece_counts(m[0])[-1]
        return out

    def counts(self, text: str) -> np.ndarray:
        """int32: counts[i] is the number of tokens of the first i + 1 code points."""
        if not text:
            return np.zeros(0, np.int32)
        if self._special is None or not self._special.search(text):
            return self._plain(text)
        parts, at, base = [], 0, 0
        for m in self._special.finditer(text):
            c = self._plain(text[at : m.end() - 1]) + base
            own = self._plain(text[at : m.start()])[-1] if m.start() > at else 0
            base += int(own) + 1
            parts += [c, np.array([base], np.int32)]
            at = m.end()
        if at < len(text):
            parts.append(self._plain(text[at:]) + base)
        return np.concatenate(parts).astype(np.int32)


def _count(path: str, stored: bool, limit: int = 0, head: int = 0):
    def run(batches):
        enc = Encoder.of(path)
        for b in batches:
            text = b.column("text")
            for i in range(0, len(text), 256):
                part = [x or "" for x in text.slice(i, 256).to_pylist()]
                counts = [enc.counts(x) for x in part]
                cols = [
                    b.column("doc_id").slice(i, 256),
                    pa.array([len(x.encode()) for x in part], pa.int64()),
                    pa.array([int(c[-1]) if len(c) else 0 for c in counts], pa.int64()),
                ]
                if not stored:
                    cols.append(pa.array([int(np.flatnonzero(c <= limit)[-1]) + 1 if len(c) and c.min() <= limit else 0 for c in counts], pa.int64()))
                    cols.append(pa.array([int(c[min(head, len(c)) - 1]) if len(c) else 0 for c in counts], pa.int64()))
                if stored:
                    ends = np.r_[0, np.cumsum([len(c) for c in counts])]
                    cols.append(pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.concatenate(counts))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_tokens", *(["counts"] if stored else ["chars_in_limit", "tokens_of_head"])])

    return run


def prefix_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, counts ARRAY<INT>: counts[i] = tokens of the first i + 1 code points."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_count(path, True)), "doc_id long, n_bytes long, n_tokens long, counts array<int>")


def tokens_before(counts: Column, chars: Column) -> Column:
    """Tokens of the text's first `chars` code points."""
    n = F.least(chars, F.size(counts))
    return F.when(n <= 0, F.lit(0)).otherwise(F.get(counts, n - 1))


def longest_within(counts: Column, budget: Column) -> Column:
    """The most code points whose encoding takes no more than `budget` tokens."""
    fits = F.filter(F.transform(counts, lambda c, i: F.when(c <= budget, i + 1)), lambda x: x.isNotNull())
    return F.coalesce(F.try_element_at(fits, F.lit(-1)), F.lit(0))


def token_counts(docs: DataFrame, path: str, limit: int = 512, head: int = 1000) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit, and from the same prefix counts a budget and a truncation: chars_in_limit (the most
    code points whose encoding takes no more than `limit` tokens) and tokens_of_head (tokens of the first `head` code points)."""
    schema = "doc_id long, n_bytes long, n_tokens long, chars_in_limit long, tokens_of_head long"
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_count(path, False, limit, head)), schema)
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """Bytes and tokens of every whole document."""
    return token_counts(table(spark, sf_dir, "documents"), default_vocabulary())
