"""Waveforms: peaks and levels of equal slices of sampled audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICES = 1000
CACHE_VERSION = 1


def measure(frames: DataFrame, slices: int = SLICES) -> DataFrame:
    """``id, slice, peak, level`` from ``id, frame, samples`` (one row per frame, a value per channel).

    Slice of a frame: frame * S div N, the last slice taking what is beyond, with S slices at most one per frame. Peaks and sums
    of squares are partial aggregates, so a long recording is metered by many tasks.
    """
    lengths = frames.groupBy("id").agg(F.count("*").alias("n"))
    s = F.least(F.lit(slices), F.col("n")).cast("long")
    placed = frames.join(lengths, "id").select("id", F.least(F.floor(F.col("frame") * s / F.col("n")), s - 1).alias("slice"), F.explode("samples").alias("x"))
    return placed.groupBy("id", "slice").agg(F.max(F.abs("x")).alias("peak"), F.sqrt(F.avg(F.col("x").cast("double") * F.col("x"))).alias("level"))


def measure_arrays(rows: DataFrame, samples: str, slices: int = SLICES) -> DataFrame:
    """``id, slice, peak, level`` where a row holds all of its samples of one channel."""
    exploded = rows.select("id", F.posexplode(samples).alias("frame", "x"))
    return measure(exploded.select("id", "frame", F.array("x").alias("samples")), slices)


def quantise(value: Column) -> Column:
    """Clamped to 0..1 in steps of 1/255; NaN and null are 0."""
    clean = F.when(F.isnan(value) | value.isNull(), 0.0).otherwise(F.greatest(F.least(value, F.lit(1.0)), F.lit(0.0)))
    return F.round(clean * 255) / 255


def resample(values: Column, count: int) -> Column:
    """``count`` values, each the largest of its share of the slices; an empty waveform stays empty."""
    n = F.size(values)
    first = lambda i: F.floor(i * n / count).cast("int")
    share = lambda i: F.slice(values, first(i) + 1, F.greatest(F.lit(1), first(i + 1) - first(i)))
    out = F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: F.array_max(share(i)))
    return F.when((n == 0) | F.lit(count <= 0), F.slice(values, 1, 0)).when(n == count, values).otherwise(out)


def cache_key(path: Column, size: Column, modified: Column) -> Column:
    """What a cached waveform is stored under: a file that changes in path, size or time has another key."""
    return F.concat_ws("\n", path, size.cast("string"), F.unix_micros(modified).cast("string"))


def cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``path, peaks, levels`` of the files that the cache has, the files that it lacks).

    files: ``path, size, modified``. cache: ``key, version, peaks, levels``. Entries of another version do not count.
    """
    keyed = files.withColumn("key", cache_key(F.col("path"), F.col("size"), F.col("modified")))
    valid = cache.filter(F.col("version") == CACHE_VERSION)
    return keyed.join(valid, "key").select("path", "peaks", "levels"), keyed.join(valid, "key", "left_anti").drop("key")


def store(cache: DataFrame, files: DataFrame, measured: DataFrame) -> DataFrame:
    """The cache with the waveforms of ``files``, in steps of 1/255. measured: ``path, slice, peak, level``.

    A waveform has at most SLICES slices, so its row is bounded; an entry of the same key is replaced.
    """
    steps = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("slice", c))), lambda x: quantise(x[c].cast("double")))
    rows = measured.groupBy("path").agg(steps("peak").alias("peaks"), steps("level").alias("levels")).join(files, "path")
    new = rows.select(cache_key(F.col("path"), F.col("size"), F.col("modified")).alias("key"), F.lit(CACHE_VERSION).alias("version"), "peaks", "levels")
    return cache.join(new.select("key"), "key", "left_anti").unionByName(new)
