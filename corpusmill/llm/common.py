"""Shared pieces of the training-data operators: tables, checkpoints, vectorised text hashing.

Python code works on the Arrow buffers of whole texts in slices of a few megabytes of
whole documents, so that memory is bounded by the longest document and not by a batch.
"""

from __future__ import annotations

import ctypes
import functools
import os
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.sources.scratch import cut

#: ASCII white space that separates words: space, tab, \n, \v, \f, \r.
SPACE = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACE)] = True
#: Bytes of text that are worked on at once (a longer document is its own slice).
SLICE_BYTES = 1_000_000

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class _Open(threading.local):
    """The tables and broadcasts of the operators at work on this thread, one list an operator."""

    def __init__(self):
        self.lists: list[list] = []


_OPEN = _Open()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a table in the shared folder.

    The files survive the loss of any executor. A tidied() operator drops them when its result is
    written; others stay until the folder is cleaned by whoever owns it.
    """
    out = cut(df)
    if _OPEN.lists:
        _OPEN.lists[-1].append(out)
    return out


def share(spark: SparkSession, value):
    """A broadcast, which a tidied() operator takes back when its result is written."""
    out = spark.sparkContext.broadcast(value)
    if _OPEN.lists:
        _OPEN.lists[-1].append(out)
    return out


def trim() -> None:
    """Give memory that this process holds in reserve back to the system."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release is not None:
        release(0)


def tidied(operator):
    """The operator, its result written to the shared folder and the tables and broadcasts of its way taken back."""

    @functools.wraps(operator)
    def run(*args, **kwargs):
        _OPEN.lists.append([])
        try:
            out = cut(operator(*args, **kwargs))
        finally:
            for x in _OPEN.lists.pop():
                drop_table(x) if isinstance(x, DataFrame) else x.unpersist()
            trim()
        if _OPEN.lists:
            _OPEN.lists[-1].append(out)
        return out

    return run


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that materialize() wrote and that nothing reads any more."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for f in {os.path.dirname(x) for x in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Keys of rows without a doc_id are at least this; no table has such ids.
NO_ID = 1 << 62


def keyed(docs: DataFrame) -> DataFrame:
    """docs with doc_id BIGINT, where it is null a hash of the row beyond NO_ID, so that every row can be named; equal rows have equal keys."""
    row = F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns])
    return docs.withColumn("doc_id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID) + F.pmod(row, F.lit(1 << 61))))


def unkeyed(docs: DataFrame, like: DataFrame) -> DataFrame:
    """The columns of like, with null for the keys that keyed() made."""
    return docs.withColumn("doc_id", F.when(F.col("doc_id") < NO_ID, F.col("doc_id")).cast(like.schema["doc_id"].dataType)).select(*[f"`{c}`" for c in like.columns])


def free_name(df: DataFrame, name: str) -> str:
    """The name, or one made of it that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def lean(run):
    """run (a function of record batches), giving memory back to the system when its partition ends.

    A Python worker lives on between tasks; without this it would keep the most that it ever held.
    """

    def task(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return task


# ---------------------------------------------------------------- Arrow text buffers


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls are empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]] if len(off) else raw[:0], off - off[0] if len(off) else np.zeros(1, np.int64)


def slices(offsets: np.ndarray, most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of whole documents of about `most` bytes each."""
    n, i = len(offsets) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and document numbers of the words (maximal runs of bytes that are not SPACE)."""
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, z
    full = ~IS_SPACE[data]
    first, last = full.copy(), full.copy()
    first[1:] &= ~full[:-1]
    last[:-1] &= ~full[1:]
    b = offsets[:-1][np.diff(offsets) > 0]
    first[b] = full[b]
    e = offsets[1:][np.diff(offsets) > 0] - 1
    last[e] = full[e]
    s, t = np.flatnonzero(first), np.flatnonzero(last) + 1
    return s, t, np.searchsorted(offsets, s, "right") - 1


def _table(seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, 256, dtype=U64)


_BYTES = _table(20260101)
_LOWER = _BYTES.copy()
_LOWER[65:91] = _BYTES[97:123]
_P = U64(0x9E3779B97F4A7C15)
#: Words of more bytes are hashed one by one.
_LONG = 32
_TO_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (two multiply-xorshift rounds)."""
    x = x ^ (x >> U64(32))
    x = x * U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    x *= U64(0xD6E8FEB86659FD93)
    x ^= x >> U64(32)
    return x


def word_hashes(data: np.ndarray, s: np.ndarray, t: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of data[s:t], A-Z lower-cased if asked; equal words have equal hashes."""
    size = t - s
    h = np.zeros(len(s), U64)
    if not len(s):
        return h
    table = _LOWER if lower else _BYTES
    order = np.argsort(-size, kind="stable")
    first, ordered = s[order], size[order]
    x = np.zeros(len(s), U64)
    for j in range(int(min(ordered[0], _LONG))):
        n = int(np.searchsorted(-ordered, -j, "left"))  # words of more than j bytes come first
        x[:n] *= _P
        x[:n] += table[data[first[:n] + j]]
    h[order] = mix(x * _P + ordered.astype(U64))
    for i in order[: int(np.searchsorted(-ordered, -_LONG, "left"))].tolist():
        raw = data[s[i] : t[i]].tobytes()
        h[i] = xxhash.xxh64_intdigest(raw.translate(_TO_LOWER) if lower else raw)
    return h


_STEP = [U64(x) for x in _table(20260102)]


def window_hashes(words: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of k words within a document, and the word number where each starts."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    h = np.zeros(n, U64)
    for j in range(k):
        h = (h ^ words[j : j + n]) * (_STEP[j % 256] | U64(1))
        h ^= h >> U64(29)
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return mix(h[at]), at


def shingle_sets(data: np.ndarray, offsets: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, document) of the distinct k-word shingles, sorted by document and hash.

    A document with fewer than k words but at least one has one shingle, its whole
    sequence; one without words has none.
    """
    s, t, doc = word_bounds(data, offsets)
    w = word_hashes(data, s, t)
    h, at = window_hashes(w, doc, k)
    d = doc[at]
    n_words = np.bincount(doc, minlength=len(offsets) - 1)
    short = np.flatnonzero((n_words > 0) & (n_words < k))
    if len(short):
        firsts = np.searchsorted(doc, short)
        extra = np.zeros(len(short), U64)
        for j in range(k - 1):
            live = n_words[short] > j
            extra[live] = mix(extra[live] * U64(31) + w[firsts[live] + j] + U64(j + 1))
        h, d = np.concatenate([h, extra]), np.concatenate([d, short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    if len(h):
        keep = np.ones(len(h), bool)
        keep[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
        h, d = h[keep], d[keep]
    return h, d


def arrow_fields(schema: str) -> list[str]:
    """Column names of a simple DDL string."""
    return [x.split()[0] for x in schema.split(",")]


# ---------------------------------------------------------------- blocked Bloom filter


class BlockedBloom:
    """A Bloom filter whose k bits for a key lie in one 512-bit block (one cache line).

    It takes 64-bit key hashes. Its size is chosen from the number of keys and never
    exceeds MOST bytes; with more keys only its false-positive rate grows, and callers
    remove false positives by an exact join.
    """

    MOST = 32 << 20
    K = 6

    def __init__(self, n_blocks: int, words: np.ndarray | None = None):
        self.n_blocks = n_blocks
        self.words = np.zeros(n_blocks * 8, U64) if words is None else words

    @classmethod
    def blocks_for(cls, n_keys: int, bits: int = 16) -> int:
        return int(min(cls.MOST // 64, max(16, -(-n_keys * bits // 512))))

    @classmethod
    def positions(cls, h: np.ndarray, n_blocks: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """The block of each key, and for each of its K bits the word within the block and the mask."""
        block = ((h >> U64(40)) * U64(n_blocks)) >> U64(24)
        bits, g = [], h
        for _ in range(cls.K):
            bits.append(((g & U64(7)), U64(1) << ((g >> U64(3)) & U64(63))))
            g = g >> U64(9) if _ < 3 else mix(h + U64(_))
        return block, bits

    def add(self, h: np.ndarray) -> None:
        block, bits = self.positions(h, self.n_blocks)
        for word, m in bits:
            np.bitwise_or.at(self.words, (block * U64(8) + word).astype(np.int64), m)

    def __contains__(self, h: int) -> bool:
        return bool(self.test(np.array([h], U64))[0])

    def test(self, h: np.ndarray) -> np.ndarray:
        block, bits = self.positions(h, self.n_blocks)
        ok = np.ones(len(h), bool)
        for word, m in bits:
            ok &= (self.words[(block * U64(8) + word).astype(np.int64)] & m) != 0
        return ok


#: Words of a filter that the driver takes at once.
PIECE = 1 << 18


def bloom_of(keys: DataFrame, column: str, bits: int = 16) -> BlockedBloom:
    """A filter, with `bits` bits a key while it can, of a BIGINT column of hashes, built by a distributed bit-or of its 64-bit words.

    What reaches the driver is the filter alone: at most BlockedBloom.MOST bytes, however many keys. Its
    words come packed in binary rows of an Arrow batch each, PIECE words or so at once, as a row a word would
    take some 500 bytes a word there.
    """
    keys = keys.select(F.col(column).cast("bigint").alias("h")).where("h is not null")
    n_blocks = BlockedBloom.blocks_for(keys.count(), bits)

    def masks(batches):
        for b in batches:
            h = b.column("h").to_numpy(zero_copy_only=False).astype(np.int64).view(U64)
            f = {}
            block, bits = BlockedBloom.positions(h, n_blocks)
            for word, m in bits:
                i = (block * U64(8) + word).astype(np.int64)
                order = np.argsort(i, kind="stable")
                i, m = i[order], m[order]
                if len(i):
                    at = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
                    f.setdefault("i", []).append(i[at])
                    f.setdefault("m", []).append(np.bitwise_or.reduceat(m, at))
            if f:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f["i"])), pa.array(np.concatenate(f["m"]).view(np.int64))], ["i", "m"])

    def packed(batches):
        for b in batches:
            if len(b):
                i, m = b.column("i").to_numpy().astype("<i4"), b.column("m").to_numpy().astype("<i8")
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (i, m)], ["i", "m"])

    words = keys.mapInArrow(lean(masks), "i long, m long").groupBy("i").agg(F.bit_or("m").alias("m")).mapInArrow(lean(packed), "i binary, m binary")
    out = BlockedBloom(n_blocks)

    def fill(rows):
        for i, m in rows:
            out.words[np.frombuffer(i, "<i4")] = np.frombuffer(m, "<i8").view(U64)

    pieces = -(-n_blocks * 8 // PIECE)
    if pieces == 1:
        fill(words.collect())
    else:
        words = cut(words)
        fill(words.coalesce(pieces).toLocalIterator())
        drop_table(words)
    return out


# ---------------------------------------------------------------- connected components


#: Parts into which the edges of one node are split where they meet its minimum.
SALTS = 8


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """edges joined with the one row (u, m) of their u; the edges of a hub come in SALTS parts."""
    parts = least.withColumn("_part", F.explode(F.array(*[F.lit(i) for i in range(SALTS)]))).hint("merge")  # of no bounded size: never broadcast
    return edges.withColumn("_part", F.pmod(F.hash("v"), F.lit(SALTS))).join(parts, ["u", "_part"]).drop("_part")


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, component) of every end of an edge (a, b); component is the smallest id that it reaches.

    Alternating large-star and small-star steps. Each is one grouped minimum and one
    equi-join on edges, so no group of neighbours is ever gathered in one place, and each
    round is written to the shared folder, so that the plan stays short and a lost
    executor costs one round.
    """
    e = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = _with_least(both, least).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = _with_least(large, least)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        new = materialize(small)
        mark = new.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        drop_table(e)
        e = new
        if tuple(mark) == seen:
            break
        seen = tuple(mark)
    else:
        raise RuntimeError("components did not settle")
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return out.unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
