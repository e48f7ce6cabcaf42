"""Quality rules: text statistics, base rules, and robust multivariate outliers; DataFrame and SQL functions only.

text_stats() counts over whole texts. robust_outliers() estimates for every (lang, source)
group the location and scatter of transformed statistics by the minimum covariance determinant,
and rejects documents whose squared Mahalanobis distance exceeds a chi-square quantile.

Minimum covariance determinant: of the subsets that hold the share H of a group, the one whose
covariance has the least determinant. It is sought from STARTS starts in each group: medians and
median absolute deviations, and small subsets chosen by hash. A concentration step keeps the share
H of the documents that lie nearest and takes their mean and covariance. All starts take FIRST
steps; the best of each group then goes on until no group's log determinant moves by STILL any more.

One formula serves groups of every size: PRIOR rows with the estimate of the group's language are
added to its moments, and PRIOR rows with the estimate of the whole corpus to a language's. They
count among the rows of which the share H is kept, so of n rows the nearest H * (n + PRIOR) - PRIOR
are: none of a group of a few, which has its language's estimate and cannot hide behind its own
spread, and nearly the share H of many. Groups, languages and the corpus take their steps together,
each with the last estimate of what is around it.

Features are integers (1/1024 units) and sums are exact, so that the result does not depend on the
order in which rows are added. Distances are ranked in fine logarithmic bins, and the subset is the
least run of whole bins that holds the share H, so a group of any size takes grouped counts only; no
group is sorted or gathered. Scatter gets a floor on its diagonal (FLOOR), because clean corpora
have columns that are zero for nearly every document.

Defined results: null text = empty text (no words, fails the base rules); null lang or source
= a group of its own; null doc_id is judged like any other; repeated rows are judged alike, each
counts; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import materialize, table, tidied

WS = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"
UNIT = 1024
#: Share of a group that an estimate rests on, starts, steps that all of them take, most steps of the best.
H, STARTS, FIRST, MOST, STILL = 0.75, 4, 2, 8, 0.01
#: Rows with the estimate of the next larger group that count in a group's moments; rows of a start by hash.
PRIOR, START_ROWS = 50, 12
#: Parts into which the rows of a group are split wherever they meet its estimates.
SALTS = 16
FEATURES = ("f_length", "f_word", "f_symbols", "f_lines", "f_repeat")
#: Per feature: least standard deviation, in feature units.
FLOOR = (0.8, 0.12, 0.06, 0.08, 0.08)
#: Chi-square with 5 degrees of freedom, upper tail of one in 10,000. The factor that makes the covariance
#: of a normal sample's nearest 75 % consistent: .75 / P(chi-square of 7 <= the 75 % quantile of 5).
CUT, CONSISTENCY = 25.745, 1.41207


def text_stats(docs: DataFrame, *keep: str) -> DataFrame:
    """The kept columns, and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (all BIGINT)."""
    spark_blank = " \t\n\x0b\f\r"
    t = F.coalesce(F.col("text"), F.lit(""))
    w = docs.select(
        *keep,
        t.alias("_t"),
        F.filter(F.split(t, f"[{WS}]+"), lambda x: x != "").alias("_w"),
        F.filter(F.split(t, "\n"), lambda x: x.rlike(f"[^{WS}]")).alias("_l"),
    )
    n = F.size("_w")
    windows = F.when(n < 5, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.greatest(n - 5, F.lit(0))), lambda i: F.xxhash64(*[F.get(F.col("_w"), i + j) for j in range(5)]))
    )
    w = w.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.translate("_t", spark_blank, "")).cast("long").alias("word_chars"),
        (F.length("_t") - F.length(F.translate("_t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_l") - F.size(F.array_distinct("_l"))).cast("long").alias("n_dup_lines"),
        windows.alias("_h"),
    )
    # only texts in which some window repeats are looked at further
    again = F.size(F.array_distinct("_h")) < F.size("_h")
    by_hash = F.array_sort(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    w = w.withColumn("_s", F.when(again, by_hash)).drop("_h")
    s = F.col("_s")
    same = lambda i, x: (F.get(s, i - 1)["h"] == x["h"]) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))
    marked = F.transform(s, lambda x, i: F.when(F.when(i > 0, F.coalesce(same(i, x), F.lit(False))).otherwise(F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))), x["i"]))
    w = w.withColumn("_p", F.when(s.isNotNull(), F.array_sort(F.filter(marked, lambda x: x.isNotNull())))).drop("_s")
    p = F.col("_p")
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x)
    return w.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long"))).drop("_p")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def features(stats: DataFrame) -> DataFrame:
    """Adds FEATURES, as integers of 1/UNIT: log length, log mean word length, and square roots of shares."""
    n, c = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    f = (
        F.ln(1.0 + F.col("n_words")),
        F.ln(c / n),
        F.sqrt(F.col("n_symbols") / c),
        F.sqrt(F.col("n_dup_lines") / n),
        F.sqrt(F.col("n_repeat_words") / n),
    )
    return stats.withColumns({k: F.round(x * UNIT).cast("int") for k, x in zip(FEATURES, f, strict=True)})


_P = len(FEATURES)
_PAIRS = [(i, j) for i in range(_P) for j in range(i + 1)]
_FIT = [*[f"m{i}" for i in range(_P)], *[f"l{i}{j}" for i, j in _PAIRS]]
_SUMS = [*[f"s{i}" for i in range(_P)], *[f"q{i}{j}" for i, j in _PAIRS]]


_COV = [f"c{i}{j}" for i, j in _PAIRS]


#: SQL of the count, sums and sums of products of rows: exact, as integers.
_OF_ROWS = ", ".join(["count(*) AS n", *[f"sum(cast({x} AS BIGINT)) AS s{i}" for i, x in enumerate(FEATURES)], *[f"sum(cast({FEATURES[i]} AS BIGINT) * cast({FEATURES[j]} AS BIGINT)) AS q{i}{j}" for i, j in _PAIRS]])


def _estimate(m: DataFrame, prior: DataFrame | None, *keys: str) -> DataFrame:
    """keys, mean m_i, covariance c_ij, Cholesky factor l_ij of CONSISTENCY * covariance + floor, and its log determinant, from sums."""
    w = "cast(0 AS DOUBLE)"
    if prior is not None:
        # groups with nothing around them have no row in prior
        m, w = m.join(prior, "g", "left"), f"if(pm0 IS NULL, 0D, {PRIOR}D)"
    had = lambda x: "0D" if prior is None else f"coalesce({x}, 0D)"
    m = m.selectExpr(*keys, *m.columns[len(keys) :], f"{w} AS _w")
    m = m.selectExpr(*keys, "n + _w AS n", *[f"s{i} + _w * {had(f'pm{i}')} AS s{i}" for i in range(_P)], *[f"q{i}{j} + _w * ({had(f'pc{i}{j}')} + {had(f'pm{i}')} * {had(f'pm{j}')}) AS q{i}{j}" for i, j in _PAIRS])
    m = m.selectExpr(*keys, "n", *[f"q{i}{j}" for i, j in _PAIRS], *[f"s{i} / n AS m{i}" for i in range(_P)])
    m = m.selectExpr(*keys, *[f"m{i}" for i in range(_P)], *[f"q{i}{j} / n - m{i} * m{j} AS c{i}{j}" for i, j in _PAIRS])
    for i in range(_P):  # a column of the factor at a time
        rest = lambda r, i=i: "".join(f" - l{r}{k} * l{i}{k}" for k in range(i))
        m = m.selectExpr("*", f"sqrt(greatest({CONSISTENCY}D * c{i}{i} + {(FLOOR[i] * UNIT) ** 2}D{rest(i)}, 1D)) AS l{i}{i}")
        if i + 1 < _P:
            m = m.selectExpr("*", *[f"({CONSISTENCY}D * c{r}{i}{rest(r)}) / l{i}{i} AS l{r}{i}" for r in range(i + 1, _P)])
    return m.selectExpr(*keys, *_FIT, *_COV, f"round({' + '.join(f'ln(l{i}{i})' for i in range(_P))}, 9) AS det")


def _distances(x: DataFrame, keep: list[str]) -> DataFrame:
    """The columns to keep, and distance: the squared Mahalanobis distance by forward substitution."""
    for i, f in enumerate(FEATURES):
        x = x.selectExpr("*", f"(cast({f} AS DOUBLE) - m{i}{''.join(f' - l{i}{k} * _y{k}' for k in range(i))}) / l{i}{i} AS _y{i}")
    return x.selectExpr(*keep, f"{' + '.join(f'_y{i} * _y{i}' for i in range(_P))} AS distance")


def _with(x: DataFrame, small: DataFrame, key: str = "g") -> DataFrame:
    """x joined with a few rows a group. A hot group's rows carry SALTS salts, and so come in as many parts."""
    return x.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), [key, "_salt"])


#: The group of all rows.
ALL = "*"


def _nearest(x: DataFrame, fit: DataFrame, around: bool) -> DataFrame:
    """Sums over the nearest rows, the share H, of every group and start: one pass over the rows. around: PRIOR rows are added later.

    Rows are added up by bin of their distance; the bins of a group number at most 64 for each
    power of e between the least and the largest distance.
    """
    d = _distances(_with(x, fit.select("g", "start", *_FIT)), ["g", "start", *FEATURES])
    least = f"_all * {H}" if not around else f"if(g = '{ALL}', _all * {H}, (_all + {PRIOR}) * {H} - {PRIOR})"
    return x.sparkSession.sql(
        f"""WITH d AS (SELECT *, cast(floor(ln(distance + 1e-3) * 64) AS INT) AS b FROM {{d}}),
        bins AS (SELECT g, start, b, {_OF_ROWS} FROM d GROUP BY g, start, b),
        c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY g, start ORDER BY b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS _before, sum(n) OVER (PARTITION BY g, start) AS _all FROM bins)
        SELECT g, start, {", ".join(f"sum(if(_before < {least}, {c}, 0)) AS {c}" for c in ("n", *_SUMS))} FROM c GROUP BY g, start""",
        d=d,
    )


def _starts(x: DataFrame) -> DataFrame:
    """STARTS first estimates a group: medians and median absolute deviations, and subsets of about START_ROWS rows by hash."""
    wide = 16
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.floor(F.col(c) / wide).cast("int").alias("b")) for i, c in enumerate(FEATURES)])).alias("v")
    counts = x.select("g", each).groupBy("g", "v.f", "v.b").agg(F.count("*").alias("n"))
    # bins of 1/64 unit: as many as a feature's range has, whatever the number of rows
    h = counts.groupBy("g", "f").agg(F.collect_list(F.struct(F.col("b").alias("b"), F.col("n").alias("n"))).alias("v"), F.sum("n").alias("all"))
    half = lambda v: F.aggregate(F.array_sort(v), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("b")), lambda a, y: F.when(a["n"] * 2 >= F.col("all"), a).otherwise(F.struct((a["n"] + y["n"]).alias("n"), y["b"].alias("b"))))["b"]
    h = h.withColumn("m", half(F.col("v")))
    h = h.withColumn("a", half(F.transform("v", lambda y: F.struct(F.abs(y["b"] - F.col("m")).alias("b"), y["n"].alias("n")))))
    h = materialize(h.select("g", "f", F.col("all").alias("n"), (F.col("m") * wide + wide / 2).alias("m"), (F.col("a") * wide * 1.4826).alias("a")))
    pick = lambda f, c: F.max(F.when(F.col("f") == f, F.col(c)))
    sd = lambda i: F.sqrt(pick(i, "a") ** 2 + F.lit((FLOOR[i] * UNIT) ** 2))
    robust = h.groupBy("g").agg(*[pick(i, "m").alias(f"m{i}") for i in range(_P)], *[(sd(i) if i == j else F.lit(0.0)).alias(f"l{i}{j}") for i, j in _PAIRS])
    robust = robust.select("g", F.lit(0).alias("start"), *_FIT)
    n = h.where("f = 0").select("g", F.col("n").alias("_n"))
    some = _with(x, n).withColumn("start", F.explode(F.array(*[F.lit(i) for i in range(1, STARTS)])))
    some = some.where(F.pmod(F.xxhash64("_id", "start"), F.col("_n")) < START_ROWS)
    sums = x.sparkSession.sql(f"SELECT g, start, {_OF_ROWS} FROM {{some}} GROUP BY g, start", some=some)
    return robust.unionByName(_estimate(sums, None, "g", "start").select("g", "start", *_FIT))


def determinants(x: DataFrame, around: DataFrame | None = None) -> DataFrame:
    """For every g of x (g, _salt, _id, FEATURES): the estimate of least determinant, with mean m_i, covariance c_ij and factor l_ij.

    around, if any, has g and _up, the larger group whose estimate PRIOR rows add.
    """
    x = x.select("g", "_salt", "_id", *FEATURES)
    fit = materialize(_starts(x))
    rest = [*_FIT, *_COV, "det", "start"]
    least = lambda f: f.groupBy("g").agg(F.min_by(F.struct(*rest), F.struct("det", "start")).alias("z")).select("g", "z.*")

    def prior(f: DataFrame) -> DataFrame | None:
        if around is None:
            return None
        return around.join(f.select(F.col("g").alias("_up"), *[F.col(f"m{i}").alias(f"pm{i}") for i in range(_P)], *[F.col(f"c{i}{j}").alias(f"pc{i}{j}") for i, j in _PAIRS]), "_up").drop("_up")

    for step in range(FIRST):
        old = prior(least(fit)) if step else None
        fit = materialize(_estimate(_nearest(x, fit, old is not None), old, "g", "start"))
    best = materialize(least(fit))
    for _ in range(MOST):
        new = _estimate(_nearest(x, best, around is not None), prior(best), "g", "start").join(best.select("g", F.col("det").alias("_det")), "g")
        best = materialize(new)
        if best.where(f"abs(det - _det) > {STILL}").isEmpty():
            break
    return best


def robust_outliers(stats: DataFrame, key: str = "doc_id") -> DataFrame:
    """stats (with lang, source) plus distance (DOUBLE) and outlier (BOOLEAN)."""
    name = lambda level, *c: F.concat_ws("\x01", F.lit(level), *[F.coalesce(F.concat(F.lit("="), x), F.lit("-")) for x in c])
    x = features(stats).withColumns({"_lang": name("lang", "lang"), "_own": name("own", "lang", "source"), "_id": F.xxhash64(key, *FEATURES)})
    x = materialize(x.withColumn("_salt", F.pmod("_id", F.lit(SALTS)).cast("int")))
    levels = materialize(x.select(F.explode(F.array(F.lit(ALL), "_lang", "_own")).alias("g"), "_salt", "_id", *FEATURES))
    around = x.select(F.col("_own").alias("g"), F.col("_lang").alias("_up")).distinct().unionByName(x.select(F.col("_lang").alias("g"), F.lit(ALL).alias("_up")).distinct())
    fit = determinants(levels, materialize(around)).select(F.col("g").alias("_own"), *_FIT)
    own = [c for c in x.columns if c not in ("_own", "_lang", "_salt", "_id")]
    return _distances(_with(x, fit, "_own"), [f"`{c}`" for c in own]).withColumn("outlier", F.col("distance") > CUT)


@tidied
def quality_rules(docs: DataFrame) -> DataFrame:
    """doc_id, statistics, base_failed, distance, kept. The estimates use documents that pass the base rules."""
    s = materialize(text_stats(docs, "doc_id", "lang", "source").withColumn("base_failed", base_failed()))
    good = robust_outliers(s.where(~F.col("base_failed"))).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance", (~F.col("outlier")).alias("kept"))
    bad = s.where("base_failed").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.lit(None).cast("double").alias("distance"), F.lit(False).alias("kept"))
    return good.unionByName(bad)


def op8_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document with its base statistics and the verdict."""
    return quality_rules(table(spark, sf_dir, "documents"))
