"""Mixing sources to target weights.

Tokens per source are summed first (a partial aggregate per task, so a source with a third of all
rows costs no more than the rest). The budget is dealt out by weight; a source stops at ``max_rate``
times its size and its excess is dealt again. Each document is then emitted ``floor(rate)`` times,
plus once more if a draw seeded by its id falls below the rate's fraction. Rows of one id draw apart: rows
that are equal in id, text and source are numbered, and the number is part of the seed. Ids that occur once,
as is usual, need no number; a group of equal rows is numbered in ``SALTS`` parts, each shifted by the parts before it.

Defined cases: null text has size 0; the null source is a source of its own, last in order; sources
of size 0 get target 0 and rate 0; repeated rows draw each for itself, so that the mix as a whole is the same
in every run; an empty table gives an empty result; rows without an id draw by the digest of their text. Extra columns pass through ``mix`` untouched:
internal columns carry the prefix ``_mix_``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .common import row_key, unit_draw, word_count

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_RATE = 2
SALTS = 1024


def source_targets(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: int = MAX_RATE) -> DataFrame:
    """One row per source: ``source, source_size, target``.

    With sources sorted by cap / weight, level(i) is the water level if the first i-1 were capped
    and no other; it rises up to the true level and falls after it, so the level is the largest.
    The windows without a key run over one row per source.
    """
    sizes = docs.groupBy("source").agg(F.sum(word_count(F.col("text"))).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("rank", F.row_number().over(by_name)).select(
        "source",
        "source_size",
        "rank",
        F.element_at(cycle, (F.col("rank") - 1) % len(weights) + 1).cast("double").alias("w"),
        (F.col("source_size") * max_rate).cast("double").alias("cap"),
    )
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    everything = Window.partitionBy()
    level = (
        F.sum("source_size").over(everything) * share
        - F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ) / F.sum("w").over(by_ratio.rowsBetween(0, Window.unboundedFollowing))
    return ranked.withColumn("level", level).select(
        "source", "source_size", F.least(F.col("cap"), F.col("w") * F.max("level").over(everything)).alias("target")
    )


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_mix_seed``: the row's key, with its number among equal rows behind it unless that is 0."""
    key = row_key(F.col("doc_id"), F.col("text"))
    often = materialise(docs.groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias("_mix_id")))
    if often.isEmpty():
        return docs.withColumn("_mix_seed", key)
    same = docs["doc_id"].eqNullSafe(often["_mix_id"])
    once = docs.join(often, same, "left_anti").withColumn("_mix_seed", key)
    salt = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(SALTS)).cast("int")
    again = docs.join(often, same, "left_semi").select("*", key.alias("_mix_key"), F.md5("text").alias("_mix_text"), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")).alias("_mix_from"), salt.alias("_mix_salt"))
    again = materialise(again)  # the salts are read twice
    equal = ["_mix_key", "_mix_text", "_mix_from"]
    before = Window.partitionBy(*equal).orderBy("_mix_salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = again.groupBy(*equal, "_mix_salt").count().select(*[F.col(c).alias(f"{c}_of") for c in (*equal, "_mix_salt")], F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_mix_shift"))
    within = Window.partitionBy(*equal, "_mix_salt").orderBy(F.lit(0))
    on = [again[c].eqNullSafe(shifts[f"{c}_of"]) for c in (*equal, "_mix_salt")]
    rows = again.withColumn("_mix_row", F.row_number().over(within)).join(shifts, on)
    number = F.col("_mix_shift") + F.col("_mix_row") - 1
    seed = F.when(number > 0, F.concat_ws("|", "_mix_key", number.cast("string"))).otherwise(F.col("_mix_key"))
    return once.unionByName(rows.select(*[f"`{c}`" for c in docs.columns], seed.alias("_mix_seed")))


def copies(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, max_rate: int = MAX_RATE, seed: str = "mix") -> DataFrame:
    """``docs`` with ``_mix_size, _mix_source_size, _mix_target, _mix_copies`` added."""
    targets = materialise(source_targets(docs, weights, share, max_rate)).select(
        F.col("source").alias("_mix_source"), F.col("source_size").alias("_mix_source_size"), F.col("target").alias("_mix_target")
    )
    rate = F.when(F.col("_mix_source_size") > 0, F.col("_mix_target") / F.col("_mix_source_size")).otherwise(0.0)
    draw = unit_draw(F.col("_mix_seed"), seed)
    whole = F.floor(rate)
    rows = numbered(docs)
    return (
        rows.join(targets, rows["source"].eqNullSafe(targets["_mix_source"]))
        .drop("_mix_source")
        .withColumn("_mix_size", word_count(F.col("text")))
        .withColumn("_mix_copies", (whole + (draw < rate - whole).cast("long")).cast("int"))
        .drop("_mix_seed")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as its draw says, with the columns of ``docs``."""
    drawn = copies(docs, **options)
    repeated = drawn.withColumn("_mix_n", F.explode(F.array_repeat(F.lit(1), F.col("_mix_copies"))))
    return repeated.select(*[repeated[f"`{c}`"] for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return copies(docs).select(
        "doc_id",
        F.col("_mix_size").alias("size"),
        F.col("_mix_source_size").alias("source_size"),
        F.col("_mix_target").alias("target"),
        (F.col("_mix_size") * F.col("_mix_copies")).cast("long").alias("taken"),
        F.col("_mix_copies").alias("copies"),
    )


SQL = r"""
WITH d AS (
  SELECT doc_id, text, source, row_number() OVER (PARTITION BY doc_id, text, source) - 1 AS k, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), r AS (
  SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM s
), w AS (
  SELECT source, source_size, rank, (source_size * 2)::DOUBLE AS cap,
    (CASE (rank - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END)::DOUBLE AS w FROM r
), l AS (
  SELECT *, ((sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE
    - coalesce(sum(cap) OVER (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), t AS (
  SELECT source, source_size, least(cap, w * max(level) OVER ()) AS target FROM l
), x AS (
  SELECT doc_id, size, source_size, target,
    CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, md5(text), 'null') || CASE WHEN k > 0 THEN '|' || k ELSE '' END || '|mix'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT))::BIGINT AS taken,
  (floor(rate)::BIGINT + (u < rate - floor(rate))::BIGINT)::INTEGER AS copies
FROM x
"""
