"""The driver's tables as track tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import conform


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def document_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as tracks: the text as title, the language as artist, the source as album, the length as duration."""
    d = table(spark, sf_dir, "documents")
    fmt = F.element_at(F.array(*[F.lit(f) for f in ("mp3", "aac", "alac", "flac", "aiff", "wav")]), (F.col("doc_id") % 6 + 1).cast("int"))
    empty = F.lit("")
    return conform(d.select(
        F.col("doc_id").alias("id"), F.concat(F.lit("/lib/"), F.coalesce("source", empty), F.lit("/"), F.col("doc_id"), F.lit("."), fmt).alias("path"),
        F.lit("/lib").alias("scan_root"), F.coalesce("text", empty).alias("title"), F.coalesce("lang", empty).alias("artist"),
        F.coalesce("source", empty).alias("album"), F.col("n_chars").cast("double").alias("duration"), fmt.alias("format"),
        (F.col("doc_id") * 1009 % 5_000_000).alias("file_size"), F.when(F.col("doc_id") % 4 != 0, F.col("doc_id") % 320).alias("bitrate"),
        F.map_from_arrays(F.array(F.lit("LANG"), F.lit("SOURCE")), F.array(F.coalesce("lang", empty), F.coalesce("source", empty))).alias("tags"),
    ))


def part_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as tracks: name, brand, type, size as track number, price as duration."""
    p = table(spark, sf_dir, "part")
    fmt = F.element_at(F.array(*[F.lit(f) for f in ("mp3", "flac", "wav")]), (F.col("p_partkey") % 3 + 1).cast("int"))
    return conform(p.select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("/lib/"), F.regexp_replace("p_brand", "[^A-Za-z0-9]", ""), F.lit("/"), F.col("p_partkey"), F.lit("."), fmt).alias("path"),
        F.lit("/lib").alias("scan_root"), F.col("p_name").alias("title"), F.col("p_brand").alias("artist"), F.col("p_type").alias("album"),
        F.col("p_size").alias("track_number"), (1950 + F.col("p_size")).alias("year"), F.col("p_retailprice").alias("duration"), fmt.alias("format"),
        (F.col("p_partkey") * 1000 + F.col("p_size")).alias("file_size"), (F.col("p_partkey") % 320).cast("int").alias("bitrate"),
    ))
