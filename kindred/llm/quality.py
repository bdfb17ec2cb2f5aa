r"""Quality rules: fixed base rules, then robust multivariate outliers.

Base rules: a document fails with fewer than 10 words, or if more than 20 % of its words lie in
five-word windows that occur twice or more in it.

Outliers: per language and source, the minimum covariance determinant (MCD) estimate of location and
scatter of a vector of transformed statistics; documents whose Mahalanobis distance is beyond a
chi-squared quantile are rejected. The estimate uses the documents that pass the base rules:

1. Two starts: all documents of the group, and those without symbols, repeated lines or windows.
2. Concentration steps: distances to the present estimate, keep the nearest ``CORE`` share, estimate
   again; the determinant never rises by more than the width of a bin, and the steps end when the
   logarithms of the determinants fall by less than ``SETTLED`` on average (or after ``MAX_STEPS``).
3. The start with the smaller determinant wins; its scatter is scaled to be consistent for normal
   data, and every coordinate gets a least variance (``FLOOR``): a ridge for the first three. Repeats are
   zero in nine of ten documents, so that the core has no spread of them at all; their least deviation is
   such that alone they reject from about 18 % of the lines or words, below the base rule's 20 %.

This is done for all documents together first. The estimate of each language and source is then
regularised towards that pooled one, by the same formula at every size: with n documents in the core its
location and scatter weigh n / (n + ``PRIOR``), the pooled ones the rest.

Everything is DataFrame operations. Statistics are rounded to 1/``SCALE`` and summed as integers,
so the estimates do not depend on the order of rows. The nearest share is found from counts per
distance bin (bins of 1/``BINS`` in the logarithm of the squared distance), with the moments of
each bin summed in the same aggregate: a group with a third of all rows is summed in part by every
task, and what is shuffled is one row per group and bin. The statistics are computed once and written.

Defined cases: null text has no words and fails; null language or source is a group of its own;
repeated rows count each; ties fall in one bin and are kept together; an empty table gives an empty
result; extra columns pass through ``keep`` untouched (internal columns carry the prefix ``_q_``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .common import SPACE, WORD

MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT = 5

SCALE = 256
BINS = 32
CORE = 0.75
MAX_STEPS, SETTLED = 12, 0.01
BROADCAST_GROUPS = 50_000  #: estimates of so many groups (less than 1 KB each) are broadcast; more are joined as Spark sees fit
PRIOR = 50
TAIL = 1e-3
#: Least standard deviations: log words, log word length, then log(1 + percent) of symbols, repeated lines, repeated words.
FLOOR = (0.1, 0.05, 0.2, 0.65, 0.65)
P = len(FLOOR)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]


def chi_squared_cdf(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, half = k / 2, x / 2
    if half <= 0:
        return 0.0
    if half > 400:
        return 1.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= half / n
        total += term
    return min(1.0, total * math.exp(a * math.log(half) - half - math.lgamma(a)))


def chi_squared_quantile(p: float, k: int) -> float:
    low, high = 0.0, 700.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_squared_cdf(mid, k) < p else (low, mid)
    return high


CUTOFF = chi_squared_quantile(1 - TAIL, P)
CONSISTENCY = CORE / chi_squared_cdf(chi_squared_quantile(CORE, P), P + 2)


def base_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_q_words, _q_chars, _q_symbols, _q_lines, _q_dup_lines, _q_repeats`` (long)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select(
        "*",
        F.array_remove(F.split(text, SPACE + "+", -1), "").alias("_q_w"),
        F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)).alias("_q_l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("_q_symbols"),
    )
    n, h = F.size("_q_w"), F.col("_q_h")
    hashed = split.select(
        "*",
        n.cast("long").alias("_q_words"),
        F.length(F.array_join("_q_w", "")).cast("long").alias("_q_chars"),
        F.size("_q_l").cast("long").alias("_q_lines"),
        (F.size("_q_l") - F.size(F.array_distinct("_q_l"))).cast("long").alias("_q_dup_lines"),
        F.transform("_q_w", lambda x: F.xxhash64(x)).alias("_q_h"),
    ).drop("_q_l")
    # a window's hash from those of its words
    windows = F.transform(F.slice("_q_h", F.lit(1), F.greatest(n - REPEAT + 1, F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, REPEAT)]))
    hashed = hashed.withColumn("_q_x", windows).drop("_q_h")
    # only a text in which some window repeats is sorted
    x = F.col("_q_x")
    order = F.sort_array(F.transform(x, lambda x, i: F.struct(x.alias("h"), i.alias("at"))))
    ordered = hashed.withColumn("_q_o", F.when(F.size(F.array_distinct(x)) < F.size(x), order)).drop("_q_x")
    o, w = F.col("_q_o"), F.col("_q_w")
    same = lambda x, y: (x["h"] == y["h"]) & (F.slice(w, x["at"] + 1, REPEAT) == F.slice(w, y["at"] + 1, REPEAT))
    repeated = F.filter(o, lambda x, i: ((i > 0) & same(x, F.get(o, i - 1))) | ((i < F.size(o) - 1) & same(x, F.get(o, i + 1))))
    flagged = ordered.withColumn("_q_f", F.sort_array(F.transform(repeated, lambda x: x["at"]))).drop("_q_o", "_q_w")
    covered = F.aggregate(
        "_q_f",
        F.struct(F.lit(0).alias("n"), F.lit(-REPEAT).alias("last")),
        lambda acc, at: F.struct((acc["n"] + F.least(F.lit(REPEAT), at - acc["last"])).alias("n"), at.alias("last")),
    )["n"]
    return flagged.withColumn("_q_repeats", F.coalesce(covered, F.lit(0)).cast("long")).drop("_q_f")


def statistics(docs: DataFrame) -> DataFrame:
    """``base_statistics`` with ``_q_failed``, the group ``_q_g`` and the transformed vector ``_q_z0 ...`` in 1/SCALE. Write it before it is judged."""
    base = base_statistics(docs)
    words, chars = (F.col(c).cast("double") for c in ("_q_words", "_q_chars"))
    some = F.greatest(words, F.lit(1.0))
    vector = (
        F.log(some),
        F.log(F.greatest(chars, F.lit(1.0)) / some),
        F.log(1 + 100 * F.col("_q_symbols") / F.greatest(chars, F.lit(1.0))),
        F.log(1 + 100 * F.col("_q_dup_lines") / F.greatest(F.col("_q_lines"), F.lit(1))),
        F.log(1 + 100 * F.col("_q_repeats") / some),
    )
    failed = (F.col("_q_words") < MIN_WORDS) | (100 * F.col("_q_repeats") > MAX_REPEAT_PERCENT * F.col("_q_words"))
    none = F.lit("")
    group = F.concat(
        F.coalesce(F.length("lang"), F.lit(-1)).cast("string"), F.lit(":"), F.coalesce("lang", none), F.coalesce(F.concat(F.lit("="), "source"), none)
    )  # the length of the language, or -1, says where the source begins
    return base.select("*", failed.alias("_q_failed"), group.alias("_q_g"), *[F.round(v * SCALE).cast("long").alias(f"_q_z{i}") for i, v in enumerate(vector)])


MOMENTS = ["n", *[f"s{i}" for i in range(P)], *[f"s{i}{j}" for i, j in PAIRS]]


# The expressions below are SQL texts: each step builds them anew, and a text is one call where its Columns would be hundreds.
def _sums(where: str = "true") -> list[Column]:
    """Count and moments of the rows ``where``, as exact integers."""
    one = lambda x: f"sum(CASE WHEN {where} THEN {x} END)"
    return [F.expr(x) for x in (f"count_if({where}) AS n", *[f"{one(f'_q_z{i}')} AS s{i}" for i in range(P)], *[f"{one(f'_q_z{i} * _q_z{j}')} AS s{i}{j}" for i, j in PAIRS])]


#: ``a`` (inverse) and ``logdet`` of the positive definite matrix ``v``, P x P, given row by row: Gauss-Jordan steps in place.
_INVERSE = f"""aggregate(sequence(0, {P - 1}), named_struct('a', v, 'logdet', 0D), (acc, k) -> named_struct(
  'a', transform(acc.a, (x, at) -> CASE
    WHEN at div {P} = k AND at % {P} = k THEN 1 / acc.a[{P + 1} * k]
    WHEN at div {P} = k THEN x / acc.a[{P + 1} * k]
    WHEN at % {P} = k THEN -x / acc.a[{P + 1} * k]
    ELSE x - acc.a[int(at div {P}) * {P} + k] * acc.a[k * {P} + at % {P}] / acc.a[{P + 1} * k] END),
  'logdet', acc.logdet + ln(acc.a[{P + 1} * k])))"""


def _estimate(sums: DataFrame, consistency: float, pool: dict | None) -> DataFrame:
    """``g, start, n, m0 ..., c00 ..., q00 ..., logdet`` (means, scatter, its inverse) from the moments of cores.

    pool: the pooled means ``m0 ...`` and scatter ``c00 ...`` to regularise towards.
    """
    own = f"(n / (n + {PRIOR}D))" if pool else "1D"
    toward = lambda x, name: f"{x} * {own} + {pool[name]!r}D * (1 - {own})" if pool else x
    means = [f"s{i} / double(n) / {SCALE} AS r{i}" for i in range(P)]

    def scatter(i: int, j: int) -> str:
        c = f"(s{i}{j} / double(n) / {SCALE} / {SCALE} - r{i} * r{j})"
        c = f"(greatest({c}, 0D) * {consistency!r}D + {FLOOR[i] ** 2!r}D)" if i == j else f"({c} * {consistency!r}D)"
        return f"{toward(c, f'c{i}{j}')} AS c{i}{j}"

    found = sums.filter("n > 0").selectExpr("*", *means).selectExpr("g", "start", "n", *[f"{toward(f'r{i}', f'm{i}')} AS m{i}" for i in range(P)], *[scatter(i, j) for i, j in PAIRS])
    matrix = f"array({', '.join(f'c{min(i, j)}{max(i, j)}' for i in range(P) for j in range(P))}) AS v"
    inverse = found.selectExpr("*", matrix).selectExpr("*", f"{_INVERSE} AS x").drop("v")
    return inverse.selectExpr("*", *[f"x.a[{i * P + j}] AS q{i}{j}" for i, j in PAIRS], "x.logdet AS logdet").drop("x")


def distance(prefix: str = "") -> str:
    """Squared Mahalanobis distance of a row that is joined with its group's estimate."""
    d = [f"(_q_z{i} / {SCALE}D - {prefix}m{i})" for i in range(P)]
    return "(" + " + ".join(f"{prefix}q{i}{j} * {d[i]} * {d[j]} * {1 if i == j else 2}" for i, j in PAIRS) + ")"


def _held(estimates: DataFrame, groups: int) -> DataFrame:
    """Estimates to join with rows: broadcast if they are few, so that rows are not dealt by their group."""
    return F.broadcast(estimates) if groups <= BROADCAST_GROUPS else estimates


def _concentrate(rows: DataFrame, pool: dict | None) -> DataFrame:
    """The MCD estimate of each ``g`` of ``rows`` (``g, _q_z0 ...``), one row each: the columns of ``_estimate``."""
    plain = " AND ".join(f"_q_z{i} = 0" for i in range(2, P))
    both = rows.groupBy("g").agg(F.struct(*_sums()).alias("a"), F.struct(*_sums(plain)).alias("b"), F.count("*").alias("size"))
    both = materialise(both)
    sizes, n = both.select("g", "size"), both.count()
    sums = both.select("g", F.posexplode(F.array("a", "b")).alias("start", "x")).select("g", "start", "x.*")
    parts = ["n", *[f"m{i}" for i in range(P)], *[f"c{i}{j}" for i, j in PAIRS], *[f"q{i}{j}" for i, j in PAIRS], "logdet"]

    def settle(sums: DataFrame, consistency: float) -> DataFrame:
        """One row per group with the estimates ``a`` and ``b``, written."""
        one = [F.expr(f"max(CASE WHEN start = {k} THEN struct({', '.join(parts)}) END) AS {name}") for k, name in enumerate("ab")]
        return materialise(_estimate(sums, consistency, pool).groupBy("g").agg(*one))

    bins = [f"int(floor(ln({distance(f'{k}.')} + 1e-6D) * {BINS}))" for k in "ab"]
    upto = Window.partitionBy("g", "start").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    now, last = settle(sums, 1.0), None
    for _ in range(MAX_STEPS):
        tagged = rows.join(_held(now, n), "g").selectExpr("g", *[f"_q_z{i}" for i in range(P)], f"posexplode(array({', '.join(bins)})) AS (start, bin)").filter("bin IS NOT NULL")
        binned = tagged.groupBy("g", "start", "bin").agg(*_sums())
        nearest = binned.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0))).join(sizes, "g").filter(f"before < size * {CORE}D")
        now = settle(nearest.groupBy("g", "start").agg(*[F.expr(f"sum({m}) AS {m}") for m in MOMENTS]), CONSISTENCY)
        mean = now.selectExpr("avg(a.logdet) + coalesce(avg(b.logdet), 0D)").first()[0]
        if mean is None or (last is not None and last - mean < SETTLED):
            break
        last = mean
    return now.selectExpr("g", "CASE WHEN b.logdet < a.logdet THEN b ELSE a END AS e").select("g", "e.*")


def estimates(rows: DataFrame) -> DataFrame:
    """The estimate of each group ``g`` of ``rows`` (``statistics``, written)."""
    passed = materialise(rows.filter(~F.col("_q_failed")).select(F.col("_q_g").alias("g"), *[f"_q_z{i}" for i in range(P)]))  # a few numbers a row, read once per step
    pooled = _concentrate(passed.withColumn("g", F.lit("")), None).first()
    return materialise(_concentrate(passed, pooled.asDict() if pooled else None))


def judge(rows: DataFrame) -> DataFrame:
    """``statistics`` rows (written) with ``_q_distance`` (null if the base rules failed) and ``_q_kept``."""
    found = estimates(rows).select(F.col("g").alias("_q_of"), *[F.col(c).alias(f"_q_{c}") for c in (*[f"m{i}" for i in range(P)], *[f"q{i}{j}" for i, j in PAIRS])])
    joined = rows.join(_held(found, found.count()), rows["_q_g"] == found["_q_of"], "left")
    measured = joined.withColumn("_q_distance", F.when(~F.col("_q_failed"), F.expr(distance("_q_"))))
    return measured.withColumn("_q_kept", ~F.col("_q_failed") & (F.coalesce("_q_distance", F.lit(0.0)) <= CUTOFF)).drop(*found.columns)


def keep(docs: DataFrame) -> DataFrame:
    """The documents that pass, with the columns of ``docs``. Texts and statistics are written once, beside each other."""
    return judge(materialise(statistics(docs))).filter("_q_kept").select(*[f"`{c}`" for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang", "source")
    rows = materialise(statistics(docs).drop("text"))
    return judge(rows).select(
        "doc_id", F.col("_q_words").alias("n_words"), F.col("_q_chars").alias("word_chars"), F.col("_q_symbols").alias("n_symbols"),
        F.col("_q_dup_lines").alias("n_dup_lines"), F.col("_q_repeats").alias("n_repeat_words"),
        F.col("_q_failed").alias("base_failed"), F.col("_q_kept").alias("kept"), F.round("_q_distance", 2).alias("distance"),
    )
