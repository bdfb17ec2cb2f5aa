"""Scanning folders into the track table, with an incremental cache.

Files are listed by Spark's ``binaryFile`` source, which reads any store that Spark reads; contents are not loaded. Tags come from a
metadata table (``path, properties, stream...``) that a tag reader of the caller's choice has produced.
"""

from __future__ import annotations

import os
import uuid
from functools import reduce

import pandas as pd
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import leading_number, year
from ..operators.grouping import number_rows
from ..operators.removal import in_folder
from ..schema import EXTENSIONS, extension, format_of
from ..storage import materialise, new_table

VALUE_SEPARATOR = "; "
CACHE_VERSION = 1
BUCKETS = 64
SIMPLE = (T.StringType, T.LongType, T.IntegerType, T.DoubleType, T.TimestampType)


def scan_roots(roots: list[tuple[str, str | None]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(kept roots, issues). roots: (path as chosen, real path or None if missing).

    Missing roots are issues; a root that equals another or lies in it goes, shortest real path first.
    """
    issues = [(path, "The folder couldn't be found.") for path, real in roots if real is None]
    kept: list[tuple[str, str]] = []
    for path, real in sorted((r for r in roots if r[1] is not None), key=lambda r: len(r[1])):
        if not any(real == k or real.startswith("/" if k == "/" else k + "/") for _, k in kept):
            kept.append((path, real))
    return kept, issues


def rebase(path: Column, real: str, chosen: str) -> Column:
    """A path below the real root as seen below the chosen one; other paths stay."""
    base = "" if chosen == "/" else chosen
    tail = path if real == "/" else F.substring(path, len(real) + 1, 1 << 30)
    return F.when(in_folder(path, F.lit(real)), F.concat(F.lit(base), tail)).otherwise(path)


# Folders that are shown as one file; what lies in them belongs to it.
PACKAGES = ("app", "bundle", "framework", "plugin", "component", "vst", "vst3", "logicx", "band", "fcpbundle", "imovielibrary", "photoslibrary", "musiclibrary", "tvlibrary", "rtfd", "pages", "key", "numbers")


@F.pandas_udf(T.BooleanType())
def _links(path: pd.Series, root: pd.Series) -> pd.Series:
    """Whether a file below ``root``, or a folder on its way there, is a symbolic link."""
    seen: dict[str, bool] = {}

    def linked(at: str, root: str) -> bool:
        if len(at) <= len(root):
            return False
        if at not in seen:
            seen[at] = os.path.islink(at) or linked(os.path.dirname(at), root)
        return seen[at]

    return pd.Series([linked(p, r.rstrip("/")) for p, r in zip(path, root, strict=True)], dtype="bool")


def list_files(spark: SparkSession, roots: list[tuple[str, str]]) -> DataFrame:
    """``path, scan_root, size, modified`` of the audio files below the roots.

    Known extensions in any case; no hidden files or folders, nothing inside of packages, no symbolic links (only local folders have
    any), so that a linked file is no copy of itself. A root that cannot be read raises; ``list_roots`` reports it.
    """
    found = None
    for chosen, real in roots:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(real).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
        plain = F.url_decode(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/+", "/"), r"\+", "%2B"))
        files = files.withColumn("path", plain)
        inner = F.substring("path", len(real.rstrip("/")) + 1, 1 << 30)
        files = files.filter(extension(F.col("path")).isin(*EXTENSIONS) & ~inner.rlike(r"/\.") & ~F.lower(inner).rlike(rf"\.({'|'.join(PACKAGES)})/"))
        if real.startswith("/"):
            files = files.filter(~_links(F.col("path"), F.lit(real)))
        files = files.select(rebase(F.col("path"), real, chosen).alias("path"), F.lit(chosen).alias("scan_root"), "size", "modified")
        found = files if found is None else found.union(files)
    return found if found is not None else spark.createDataFrame([], "path string, scan_root string, size long, modified timestamp")


def list_roots(spark: SparkSession, roots: list[tuple[str, str]]) -> tuple[DataFrame, list[tuple[str, str]]]:
    """(files of the roots that can be read, written; issues ``(root, message)`` of the others)."""
    found, problems = [], []
    for root in roots:
        try:
            found.append(materialise(list_files(spark, [root])))
        except (PySparkException, Py4JJavaError) as e:
            problems.append((root[0], f"Couldn't read this: {str(e).splitlines()[0]}"))
    return reduce(DataFrame.union, found) if found else list_files(spark, []), problems


def decoded_duration(frames: Column, rate: Column) -> Column:
    """Seconds, or null for a rate of 0 or less."""
    return F.when(rate > 0, frames / rate)


def codec_format(container: Column, codec: Column) -> Column:
    """The format of a stream: an MP4 container holds ALAC or AAC, the others say it by themselves."""
    c, k = F.lower(container), F.lower(codec)
    return (
        F.when(c.isin("mp4", "m4a"), F.when(k == "alac", "alac").when(k == "aac", "aac").otherwise("unknown"))
        .when(c == "mpeg", "mp3").when(c.isin("flac", "wav", "aiff"), c).otherwise("unknown")
    )


def bit_depth_of(fmt: Column, bits: Column) -> Column:
    """Bits per sample, for lossless formats only; 0 is unknown."""
    return F.when(fmt.isin("alac", "flac", "aiff", "wav") & (bits > 0), bits)


def build_tracks(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """Track rows (without id) and ``problems`` from files and what was read of them.

    metadata: ``path, properties map<string, array<string>>, stream struct<format, bitrate, sample_rate, bit_depth, channels>,
    decoded struct<duration, format, sample_rate, channels>, problems array<string>``; either part may be null. Format, sample
    rate and channels come from the stream, else the decoder; the format else from the extension. A stream's ``unknown`` stands.
    """
    joined = files.join(metadata, "path", "left")
    values = F.coalesce("properties", F.expr("cast(map() as map<string, array<string>>)"))
    tags = F.transform_values(values, lambda k, v: F.array_join(v, VALUE_SEPARATOR))
    tag = lambda key: F.coalesce(F.element_at("tags", F.lit(key)), F.lit(""))
    number = lambda key: F.element_at("tags", F.lit(key))
    none = F.expr("cast(array() as array<string>)")
    return joined.withColumn("tags", tags).select(
        "path", "scan_root", tag("TITLE").alias("title"), tag("ARTIST").alias("artist"), tag("ALBUM").alias("album"),
        tag("ALBUMARTIST").alias("album_artist"), tag("COMMENT").alias("comment"), tag("GENRE").alias("genre"),
        leading_number(number("TRACKNUMBER")).alias("track_number"), leading_number(number("DISCNUMBER")).alias("disc_number"), year(number("DATE")).alias("year"),
        F.col("decoded.duration").alias("duration"), F.coalesce("stream.format", "decoded.format", format_of(F.col("path"))).alias("format"),
        F.col("stream.bitrate").alias("bitrate"), F.coalesce("stream.sample_rate", "decoded.sample_rate").alias("sample_rate"),
        F.col("stream.bit_depth").alias("bit_depth"), F.coalesce("stream.channels", "decoded.channels").alias("channels"),
        F.col("size").alias("file_size"), "modified", "tags", F.coalesce("problems", none).alias("problems"),
    )


def assemble(tracks: DataFrame) -> DataFrame:
    """Track rows with ``id``: their place in path order, counted range by range."""
    out = number_rows(tracks.drop("problems"), ["path"], "id")
    return out.select("id", *[c for c in out.columns if c != "id"])


def issues(tracks: DataFrame) -> DataFrame:
    """``path, message``: one row per problem."""
    return tracks.select("path", F.explode("problems").alias("message"))


def bucketed(cache: DataFrame, folder: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """The cache as a table in ``buckets`` files by path, so that joins by path shuffle the files alone; ``folder`` must not exist yet."""
    spark = cache.sparkSession
    name, folder = f"kindred_cache_{uuid.uuid4().hex}", folder or new_table(spark)
    cache.repartition(buckets, "path").write.bucketBy(buckets, "path").sortBy("path").option("path", folder).saveAsTable(name)
    return spark.table(name)


def compared(files: DataFrame, cache: DataFrame) -> DataFrame:
    """One outer join by path: ``path, status, file, cached`` (structs, null where there is none).

    status: ``hit`` (size and time are equal), ``stale`` (they are not), ``new`` (not cached) or ``gone`` (not found).
    """
    f = files.select("path", F.struct(*[c for c in files.columns if c != "path"]).alias("file"))
    c = cache.select("path", F.struct(*[c for c in cache.columns if c != "path"]).alias("cached"))
    both = f.join(c, "path", "full_outer")
    equal = (F.col("file.size") == F.col("cached.file_size")) & (F.col("file.modified") == F.col("cached.modified"))
    status = F.when(F.col("cached").isNull(), "new").when(F.col("file").isNull(), "gone").when(equal, "hit").otherwise("stale")
    return both.select("path", status.alias("status"), "file", "cached")


def hits_of(both: DataFrame) -> DataFrame:
    """The cached rows that still hold, with the root of the file."""
    names = both.schema["cached"].dataType.fieldNames()
    return both.filter("status = 'hit'").select("path", *[F.col("file.scan_root" if c == "scan_root" else f"cached.{c}").alias(c) for c in names])


def misses_of(both: DataFrame) -> DataFrame:
    """The files that have to be read."""
    return both.filter("status IN ('new', 'stale')").select("path", "file.*")


def cache_hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Cached rows whose path, size and time all equal those of a file; the file's root is attached."""
    return hits_of(compared(files, cache))


def to_read(files: DataFrame, cache: DataFrame) -> DataFrame:
    return misses_of(compared(files, cache))


def updated(both: DataFrame, read: DataFrame, roots: list[str]) -> DataFrame:
    """The cache after a scan: without entries below the scanned roots that were not found, with newly read rows in place of older ones. Rows with problems are not cached, and what was cached of them stays."""
    names = both.schema["cached"].dataType.fieldNames()
    left = both.filter(F.col("cached").isNotNull() & ~((F.col("status") == "gone") & _below(roots))).select("path", *[F.col(f"cached.{c}").alias(c) for c in names])
    return upsert(left, read)


def _below(roots: list[str]) -> Column:
    return reduce(lambda a, r: a | in_folder(F.col("path"), F.lit(r)), roots, F.lit(False))


def upsert(cache: DataFrame, read: DataFrame) -> DataFrame:
    """The cache with newly read rows in place of older ones of the same path; rows with problems are not cached."""
    good = read.filter(F.size("problems") == 0).drop("problems")
    return cache.join(good.select("path"), "path", "left_anti").unionByName(good.select(*cache.columns))


def evict(cache: DataFrame, roots: list[str], files: DataFrame) -> DataFrame:
    """The cache without entries below the scanned roots that were not found; others stay."""
    found = files.select("path", F.lit(True).alias("_found")).distinct()
    return cache.join(found, "path", "left").filter(F.col("_found").isNotNull() | ~_below(roots)).select(*cache.columns)


def save_cache(cache: DataFrame, path: str) -> None:
    """Written beside the old one (from which it may be read) and put in its place by two renames: a stop in between leaves no cache, never a part of one."""
    spark = cache.sparkSession
    at = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    new, old = (f"{path.rstrip('/')}-{kind}-{uuid.uuid4().hex}" for kind in ("new", "old"))
    cache.withColumn("cache_version", F.lit(CACHE_VERSION)).write.parquet(new)
    files = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if files.exists(at(path)):
        files.rename(at(path), at(old))
    files.rename(at(new), at(path))
    files.delete(at(old), True)


def load_cache(spark: SparkSession, path: str, schema) -> DataFrame:
    """The cache; a missing, unreadable or older one is empty."""
    try:
        found = spark.read.parquet(path).filter(F.col("cache_version") == CACHE_VERSION).select(*schema.fieldNames())
        found.groupBy().agg(*[F.max(F.hash(c) if isinstance(f.dataType, SIMPLE) else F.lit(0)) for c, f in zip(found.columns, schema.fields, strict=True)]).collect()  # reads every page
        return found
    except (PySparkException, Py4JJavaError):
        return spark.createDataFrame([], schema)


def is_changed(before: DataFrame, after: DataFrame) -> bool:
    """Whether a cache differs from what was loaded, in paths, sizes or times: only then it is saved."""
    key = ["path", "file_size", "modified"]
    return not before.select(*key).exceptAll(after.select(*key)).isEmpty() or not after.select(*key).exceptAll(before.select(*key)).isEmpty()


def scan(files: DataFrame, cache: DataFrame, read, roots: list[str] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(tracks, issues, new cache). read: a function from the files that are not cached to ``build_tracks`` rows. Files and cache are joined once."""
    both = materialise(compared(files, cache))
    fresh = materialise(read(misses_of(both)))
    hits = hits_of(both)
    tracks = assemble(hits.unionByName(fresh.drop("problems").select(*hits.columns)))
    return tracks, issues(fresh), updated(both, fresh, list(roots)).select(*cache.columns)
