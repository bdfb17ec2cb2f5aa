"""Pieces that the training-data operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_draw(key: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on ``key`` and ``seed`` only: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat(key, F.lit(f"|{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16**13))


def row_key(doc_id: Column, text: Column) -> Column:
    """A string to seed draws with: the id, or for rows without one the digest of their text."""
    return F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("null"))
