"""Near-duplicate documents: fast similarity sketches, banding, exact verification, components.

Sketch (Dahlgaard, Knudsen and Thorup 2017): in round i < t every element goes to one hashed
bin with value i + hash; in round t + j every element goes to bin j; a bin keeps its least
value, and rounds end when every bin is full. So each coordinate fills with certainty, after
about t log t placements, and the share of equal coordinates concentrates around the Jaccard
similarity.

Candidates share all R coordinates of one of B bands. At the default similarity of 0.8 a pair
escapes all 40 bands of 5 with probability (1 - 0.8^5)^40 = 1.3e-7. Every link is confirmed on
the full shingle sets, in integers. Documents with equal sets form one class first, and only
one document of a class is looked at further.

No bucket is expanded into all its pairs: every member meets the most frequent minimum of its buckets,
then, where that linked it to nothing yet, its buckets' smallest and largest member, and linked
documents join one component. In buckets that still hold several components, members meet across
components on what sets them apart from a pivot (_residual says why that misses no link). Pairs inside
a component change nothing. What is left of a group are pairs of several components close to the
threshold: few (0.7 % of the pairs of a group of 400 near copies with a wide fringe), but their number
still grows with the square of such a group, as each of them has to be told from a link.

Defined results: null and blank texts have no shingles and are linked with nothing; fewer words
than k make one shingle; repeated rows and equal texts are one class; a null doc_id takes its
class's component; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import U64, bloom_of, connected_components, lean, materialize, mix, share, shingle_sets, slices, table, text_buffer, tidied

BANDS, ROWS = 40, 5
_FULL = U64(2**64 - 1)


def fast_sketch(h: np.ndarray, d: np.ndarray, n: int, t: int) -> np.ndarray:
    """(n, t) sketches of the sets (h, d); a document without elements keeps empty coordinates."""
    s = np.full(n * t, _FULL, U64)
    rows = s.reshape(n, t)
    live = np.unique(d)
    open_ = np.zeros(n, bool)
    open_[live] = True
    for i in range(2 * t):
        if not len(h):
            break
        g = mix(h + U64((i * 0x9E3779B97F4A7C15 + 0x1234567) % 2**64))
        b = ((g >> U64(32)) * U64(t)) >> U64(32) if i < t else np.full(len(h), i - t, U64)
        at = d * t + b.astype(np.int64)
        free = s[at] == _FULL
        at, v = at[free], (g[free] & U64(0xFFFFFFFF)) | U64(i << 32)
        np.minimum.at(s, at, v)
        still = live[(rows[live] == _FULL).any(1)]
        if len(still) < len(live):
            open_[live] = False
            open_[still] = True
            live = still
            k = open_[d]
            h, d = h[k], d[k]
    return rows


def band_keys(sketch: np.ndarray, bands: int, rows: int) -> np.ndarray:
    x = sketch[:, : bands * rows].reshape(len(sketch), bands, rows)
    key = np.broadcast_to(mix(np.arange(1, bands + 1, dtype=U64)), x.shape[:2]).copy()
    for j in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + x[:, :, j])
    return key


def _sketches(k: int, bands: int, rows: int):
    def run(batches):
        for b in batches:
            data, off = text_buffer(b.column("text"))
            for i, j in slices(off):
                o = off[i : j + 1] - off[i]
                n = j - i
                h, d = shingle_sets(data[off[i] : off[j]], o, k)
                at = np.searchsorted(d, np.arange(n + 1))
                keys = band_keys(fast_sketch(h, d, n, bands * rows), bands, rows).view(np.int64)
                full = np.diff(at) > 0
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.where(full, bands, 0))].astype(np.int32)), pa.array(keys[full].ravel()))
                ids = [hashlib.blake2b(h[at[x] : at[x + 1]].tobytes(), digest_size=16).digest() if full[x] else None for x in range(n)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, n), pa.array(np.diff(at)), pa.array(ids, pa.binary()), lists], ["doc_id", "n_shingles", "set_key", "bands"])

    return run


def _sets(k: int, wanted):
    """The sets of the documents whose id may be in the filter `wanted` (a broadcast)."""

    def run(batches):
        for b in batches:
            keep = b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            ids = b.column("doc_id").fill_null(0).to_numpy().astype(np.int64)
            keep &= wanted.value.test(mix(ids.view(U64)))
            b = b.filter(pa.array(keep))
            data, off = text_buffer(b.column("text"))
            for i, j in slices(off):
                n = j - i
                h, d = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], k)
                at = np.searchsorted(d, np.arange(n + 1))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(i, n), pa.array([h[at[x] : at[x + 1]].tobytes() for x in range(n)], pa.binary())], ["doc_id", "shingles"])

    return run


def _links(num: int, den: int):
    def run(batches):
        for b in batches:
            x, y = b.column("x"), b.column("y")
            ok = np.zeros(len(x), bool)
            for i in range(len(x)):
                p, q = np.frombuffer(x[i].as_buffer(), U64), np.frombuffer(y[i].as_buffer(), U64)
                if den * min(len(p), len(q)) < num * max(len(p), len(q)):
                    continue
                at = np.searchsorted(q, p)
                both = int((q[np.minimum(at, len(q) - 1)] == p).sum())
                ok[i] = den * both >= num * (len(p) + len(q) - both)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(pa.array(ok)), b.column("b").filter(pa.array(ok))], ["a", "b"])

    return run


def verify(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets satisfy den * |intersection| >= num * |union|."""
    p = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"), F.col("n").alias("na")), "a")
    p = p.join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"), F.col("n").alias("nb")), "b")
    p = p.where(F.least("na", "nb") * den >= F.greatest("na", "nb") * num)
    return p.select("a", "b", "x", "y").mapInArrow(lean(_links(num, den)), "a long, b long")


def _differences(num: int, den: int):
    """For members x and their cluster's pivot y: whether they are linked, and the elements of one of the two alone."""

    def run(batches):
        for b in batches:
            linked, d, n, e = [], [], [], []
            for i in range(len(b)):
                x, p = np.frombuffer(b.column("x")[i].as_buffer(), U64), np.frombuffer(b.column("y")[i].as_buffer(), U64)
                here = p[np.minimum(np.searchsorted(p, x), len(p) - 1)] == x
                own = np.concatenate([x[~here], p[np.isin(p, x[here], assume_unique=True, invert=True)]])
                both = int(here.sum())
                linked.append(den * both >= num * (len(x) + len(p) - both))
                d.append(len(own))
                n.append(len(x))
                e.append(own.view(np.int64))
            ends = np.r_[0, np.cumsum(d)].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(e) if e else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("pivot", "id", "c", "own")), pa.array(linked, pa.bool_()), pa.array(d, pa.int64()), pa.array(n, pa.int64()), lists], ["pivot", "id", "c", "own", "linked", "d", "n", "e"])

    return run


def _residual(d: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b, ca, cb) of members of different components c that can be linked, by their differences from a pivot.

    d has pivot, id, c, own (the pivot's component), d (size of the difference), n (of the set) and e
    (the difference). Let D(x) be the symmetric difference of x and the pivot P, t = num / den. Sets
    x, y have similarity t or more if they differ in at most T = (1 - t) / (1 + t) * (|x| + |y|) elements,
    so if they share need = (|D(x)| + |D(y)| - T) / 2 elements of their differences. If y is not linked to
    P, |D(y)| exceeds (1 - t) * |y or P|, and sharing none would link y to P; so at least one is shared.

    Only elements that members of several components have can be shared by a pair that matters. Let
    s(x) be their number in D(x). As need <= min(s(x), s(y)), a member whose need exceeds what it or
    any member of another component has is done. The others meet on elements in ascending order of
    frequency: whatever element is the first that a linked pair shares, need - 1 more follow it in both.
    """
    ratio = (den - num) / (den + num)
    x = d.select("pivot", "id", "c", "own", "d", "n", F.explode("e").alias("e"))
    several = materialize(x.groupBy("pivot", "e").agg(F.count("*").alias("f"), F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("pivot", "e", "f"))
    had = x.join(several, ["pivot", "e"]).groupBy("pivot", "id", "c", "own", "d", "n").agg(F.array_sort(F.collect_list(F.struct("f", "e"))).alias("e")).withColumn("s", F.size("e").cast("long"))
    had = materialize(had)
    out = F.col("c") != F.col("own")
    gain = 2 * F.col("s") - F.col("d")
    top = had.groupBy("pivot").agg(F.max(gain).alias("g_all"), F.max(F.when(out, gain)).alias("g_out"), F.min("d").alias("d_all"), F.min(F.when(out, F.col("d"))).alias("d_out"), F.max("n").alias("n_all"))
    slack = ratio * (F.col("n") + F.least(F.col("n") * (den / num), F.col("n_all")))
    had = had.join(top, "pivot").withColumns({"gain": F.when(out, F.col("g_all")).otherwise(F.col("g_out")), "least": F.when(out, F.col("d_all")).otherwise(F.col("d_out"))})
    need = F.greatest(F.lit(1.0), (F.col("d") + F.col("least") - slack) / 2 - 1e-6)
    had = had.withColumn("need", F.ceil(need)).where((F.col("d") <= slack + F.col("gain") + 1e-6) & (F.col("need") <= F.col("s")))
    e = had.select("pivot", "id", "c", "d", "n", "s", F.posexplode(F.slice("e", F.lit(1), F.greatest(F.col("s") - F.col("need") + 1, F.lit(0)).cast("int"))).alias("at", "e"))
    e = materialize(e.select("pivot", "id", "c", "d", "n", (F.col("s") - F.col("at")).alias("rest"), F.col("e.e").alias("e")))
    mixed = e.groupBy("pivot", "e").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("pivot", "e")
    e = e.join(mixed, ["pivot", "e"])
    two = lambda y: e.select("pivot", "e", F.col("id").alias(y), *[F.col(z).alias(f"{z}{y}") for z in ("c", "rest", "d", "n")])
    enough = 2 * F.least("resta", "restb") + 1e-6 >= F.col("da") + F.col("db") - ratio * (F.col("na") + F.col("nb"))
    alike = F.least("na", "nb") * den >= F.greatest("na", "nb") * num
    pairs = two("a").join(two("b"), ["pivot", "e"]).where((F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & enough & alike)
    return pairs.select("a", "b", "ca", "cb").distinct()


def _differing(left: DataFrame, sets: DataFrame, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(links with pivots, members with their differences from the pivot) of the members (lo, id, c) of clusters of buckets.

    A cluster is a component of shared buckets; its pivot is its most frequent bucket minimum.
    """
    cluster = materialize(connected_components(left.select(F.col("lo").alias("a"), F.col("id").alias("b"))))
    m = left.join(cluster, "id").select("lo", "id", "c", F.col("component").alias("cluster"))
    pivot = m.groupBy("cluster", "lo").agg(F.count("*").alias("n")).groupBy("cluster").agg(F.max_by("lo", F.struct("n", "lo")).alias("pivot"))
    own = left.select(F.col("id").alias("pivot"), F.col("c").alias("own")).distinct()
    pivot = pivot.join(own, "pivot")
    m = m.select("cluster", "id", "c").distinct().join(pivot, "cluster").where("id <> pivot")
    m = m.join(sets.select("id", F.col("shingles").alias("x")), "id").join(sets.select(F.col("id").alias("pivot"), F.col("shingles").alias("y")), "pivot")
    d = materialize(m.select("pivot", "id", "c", "own", "x", "y").mapInArrow(lean(_differences(num, den)), "pivot long, id long, c long, own long, linked boolean, d long, n long, e array<long>"))
    direct = d.where("linked and c <> own").select(F.col("pivot").alias("a"), F.col("id").alias("b")).distinct()
    # what the pivot links directly has joined its component
    return direct, d.withColumn("c", F.when(F.col("linked"), F.col("own")).otherwise(F.col("c")))


def _across(left: DataFrame, sets: DataFrame, tested: DataFrame, num: int, den: int) -> DataFrame:
    """Links (a, b) between members (lo, id, c) of different components c within clusters of buckets; see _residual."""
    direct, d = _differing(left, sets, num, den)
    pairs = materialize(_residual(d, num, den).join(tested, ["a", "b"], "left_anti"))
    return direct.unionByName(verify(pairs.select("a", "b"), sets, num, den))


@tidied
def near_duplicates(docs: DataFrame, k: int = 5, num: int = 80, den: int = 100, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: documents linked where den * |A and B| >= num * |A or B|."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sk = materialize(docs.mapInArrow(lean(_sketches(k, bands, rows)), "doc_id long, n_shingles long, set_key binary, bands array<long>"))
    reps = materialize(sk.where("set_key is not null").groupBy("set_key").agg(F.min("doc_id").alias("id"), F.any_value("bands").alias("bands"), F.any_value("n_shingles").alias("n")))
    some = reps.where("id is not null")
    keys = some.select("id", F.explode("bands").alias("key"))
    shared = materialize(keys.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo < hi"))
    flt = share(spark, bloom_of(shared.select("key"), "key"))

    def members_of(batches):
        for b in batches:
            lists = b.column("bands")
            flat = lists.flatten().to_numpy()
            owner = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
            ok = flt.value.test(flat.view(U64))
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(owner[ok])), pa.array(flat[ok])], ["id", "key"])

    members = materialize(some.select("id", "bands").mapInArrow(lean(members_of), "id long, key long").join(shared, "key"))
    ids = members.select(F.xxhash64("id"), "id").distinct()

    def hashed(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mix(b.column("id").to_numpy().view(U64)).view(np.int64))], ["h"])

    wanted = share(spark, bloom_of(ids.select("id").mapInArrow(lean(hashed), "h long"), "h"))
    exact = docs.mapInArrow(lean(_sets(k, wanted)), "doc_id long, shingles binary").withColumnRenamed("doc_id", "id")
    sets = exact.join(members.select("id").distinct(), "id", "left_semi").dropDuplicates(["id"])
    sets = materialize(sets.select("id", "shingles", (F.octet_length("shingles") / 8).cast("long").alias("n")))
    # first every member meets the most frequent minimum of its buckets; those it is linked to need not meet again
    main = members.where("lo <> id").groupBy("id", "lo").agg(F.count("*").alias("n")).groupBy("id").agg(F.max_by("lo", F.struct("n", -F.col("lo"))).alias("a")).select("a", F.col("id").alias("b"))
    main = materialize(main)
    first = materialize(verify(main, sets, num, den))
    label = first.select(F.col("b").alias("id"), F.col("a").alias("label"))
    hubs = members.select(F.col("lo").alias("a"), F.col("id").alias("b")).unionByName(members.select(F.col("id").alias("a"), F.col("hi").alias("b"))).where("a <> b").distinct()
    hubs = hubs.join(main, ["a", "b"], "left_anti")
    for x in ("a", "b"):
        hubs = hubs.join(label.select(F.col("id").alias(x), F.col("label").alias(f"l{x}")), x, "left")
    hubs = materialize(hubs.where(F.coalesce("la", "a") != F.coalesce("lb", "b")).select("a", "b"))
    links = materialize(first.unionByName(verify(hubs, sets, num, den)))
    hubs = main.unionByName(hubs)
    comp = materialize(connected_components(links))
    # buckets that still hold several components
    at = members.select("key", "lo", "id").join(comp, "id", "left").select("key", "lo", "id", F.coalesce("component", "id").alias("c"))
    mixed = at.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 < c1").select("key")
    left = materialize(at.join(mixed, "key").select("lo", "id", "c").distinct())
    more = materialize(_across(left, sets, hubs, num, den))
    if more.isEmpty():
        final = comp
    else:
        # what was found joins components, not documents
        c = lambda x: comp.select(F.col("id").alias(x), F.col("component").alias(f"c{x}"))
        e = more.join(c("a"), "a", "left").join(c("b"), "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
        joined = materialize(connected_components(e))
        whole = comp.unionByName(joined.join(comp, "id", "left_anti").select("id", F.col("id").alias("component")))
        final = whole.join(joined.select(F.col("id").alias("component"), F.col("component").alias("top")), "component", "left").select("id", F.coalesce("top", "component").alias("component"))
    cls = reps.select("set_key", "id").join(final, "id", "left").select("set_key", F.coalesce("component", "id").alias("component_id"))
    out = sk.drop("bands").join(cls, "set_key", "left").select("doc_id", "n_shingles", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def op9_minhash(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents on two-word shingles at similarity 0.8."""
    return near_duplicates(table(spark, sf_dir, "documents"), k=2)


ORACLE_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS MATERIALIZED (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) > 1 THEN list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) WHEN len(w) = 1 THEN [w[1]] END)) AS x FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r(doc_id, c) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT t.a, r.c FROM r JOIN (SELECT a, b FROM e UNION ALL SELECT b, a FROM e) t ON t.b = r.doc_id)
SELECT r.doc_id, coalesce(max(n.n), 0) AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept
FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
