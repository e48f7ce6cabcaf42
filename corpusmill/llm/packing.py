"""Packing documents into training sequences: shortest pack first over the histogram of lengths.

A document is its token ids and an end id. It is cut into pieces of at most SIZE ids: full
pieces first, then its remainder. plan() sees only the histogram of piece lengths, which has at
most SIZE entries however large the corpus. It places lengths longest first; each piece goes to
the shortest pack that it fits, and packs with equal contents are one entry with a count, so
that a length is placed by updating counts of patterns. Entries number at most two per length,
and placements at most 63 per entry (distinct lengths in one pack), which bounds the plan.

Pieces get a rank among those of their length, and placements cover runs of ranks; joining the
two gives every piece its sequence and offset. Ranks are taken within (length, hash bucket) and
shifted by the counts of the buckets before, so no length, however common, is ranked in one task.

Defined results: null text = empty text = the end id alone; repeated rows are packed each;
an empty table gives no rows; extra columns are ignored; a null doc_id is packed like any other.
"""

from __future__ import annotations

import heapq
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import lean, materialize, table
from corpusmill.llm.tokens import Encoder, default_vocabulary

SIZE, END = 2048, 1


def plan(histogram: dict[int, int], size: int = SIZE) -> np.ndarray:
    """Placements, one row each: length, first rank, pieces, first sequence, pieces a sequence, offset in the sequence.

    The piece of rank first + r lies in sequence first_sequence + r // m at offset + (r % m) * length.
    """
    heap: list[tuple[int, int, int]] = []  # (-space, first sequence, sequences)
    out, sequences = [], 0
    for length in sorted(histogram, reverse=True):
        left, rank = histogram[length], 0
        while left and heap and -heap[0][0] >= length:
            space, first, count = heapq.heappop(heap)
            space = -space
            n = min(left, count)
            out.append((length, rank, n, first, 1, size - space))
            if n < count:
                heapq.heappush(heap, (-space, first + n, count - n))
            if space > length:
                heapq.heappush(heap, (length - space, first, n))
            left, rank = left - n, rank + n
        m = size // length
        for n, a in ((left // m, m), (1 if left % m else 0, left % m)):
            if n:
                out.append((length, rank, n * a, sequences, a, 0))
                if size > a * length:
                    heapq.heappush(heap, (a * length - size, sequences, n))
                sequences, rank = sequences + n, rank + n * a
    return np.array(out, np.int64).reshape(-1, 6)


def locate(p: np.ndarray, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and rank."""
    order = np.lexsort((p[:, 1], p[:, 0]))
    p = p[order]
    keys = p[:, 0] * np.int64(2**50) + p[:, 1]
    at = np.searchsorted(keys, length * np.int64(2**50) + rank, "right") - 1
    r = rank - p[at, 1]
    return p[at, 3] + r // p[at, 4], p[at, 5] + (r % p[at, 4]) * length


def _pieces(path: str, size: int, end: int):
    def run(batches):
        enc = Encoder.of(path)
        tail = np.uint32(end).astype("<u4").tobytes()
        for b in batches:
            docs, text = b.column("doc_id"), b.column("text")
            for i in range(0, len(text), 256):
                rows = []
                for k, x in enumerate(text.slice(i, 256).to_pylist()):
                    ids = enc.ids(x or "").astype("<u4").tobytes() + tail
                    n = len(ids) // 4
                    rows += [(i + k, a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), n) for a in range(0, n, size)]
                c = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([docs.take(pa.array(c[:, 0])), *(pa.array(c[:, j]) for j in range(1, 5))], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row a piece."""
    pieces = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(_pieces(path, size, end)), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = materialize(pieces)
    n = pieces.count()
    buckets = max(64, n // 50_000)
    p = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(buckets)).cast("int"))
    # counts by (length, bucket), with the pieces of the length in earlier buckets; a window of at most `buckets` rows a length
    counts = p.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    counts = materialize(counts)
    shift = counts.select("length", "bucket", "n", F.sum("n").over(_before("length", "bucket")).alias("upto")).select("length", "bucket", (F.col("upto") - F.col("n")).alias("shift"))
    histogram = {int(r["length"]): int(r["n"]) for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `size` rows
    placed = plan(histogram, size)
    ranked = p.withColumn("rank", F.row_number().over(_order("length", "bucket")) - 1).join(shift, ["length", "bucket"])
    ranked = ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("rank") + F.col("shift")).cast("long").alias("rank"))

    def lookup(batches):
        for b in batches:
            s, o = locate(placed, b.column("length").to_numpy(), b.column("rank").to_numpy())
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")), pa.array(s), pa.array(o)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

    return ranked.mapInArrow(lean(lookup), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _before(a: str, b: str):
    from pyspark.sql import Window

    return Window.partitionBy(a).orderBy(b).rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _order(a: str, b: str):
    from pyspark.sql import Window

    return Window.partitionBy(a, b).orderBy("doc_id", "start")


def op3_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), default_vocabulary())
