"""The track table and the audio formats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRACK = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("path", T.StringType(), False),
    T.StructField("scan_root", T.StringType()),
    *[T.StructField(c, T.StringType(), False) for c in ("title", "artist", "album", "album_artist", "comment", "genre")],
    *[T.StructField(c, T.IntegerType()) for c in ("track_number", "disc_number", "year")],
    T.StructField("duration", T.DoubleType()),
    T.StructField("format", T.StringType(), False),
    *[T.StructField(c, T.IntegerType()) for c in ("bitrate", "sample_rate", "bit_depth", "channels")],
    T.StructField("file_size", T.LongType(), False),
    T.StructField("modified", T.TimestampType(), False),
    T.StructField("tags", T.MapType(T.StringType(), T.StringType()), False),
])

# Fixed values.
FORMATS = ("mp3", "aac", "alac", "flac", "aiff", "wav", "unknown")
FORMAT_NAMES = {"mp3": "MP3", "aac": "AAC", "alac": "ALAC", "flac": "FLAC", "aiff": "AIFF", "wav": "WAV", "unknown": "Unknown"}
LOSSLESS = ("alac", "flac", "aiff", "wav")
EXTENSIONS = {"mp3": "mp3", "m4a": "aac", "aac": "aac", "mp4": "aac", "flac": "flac", "aif": "aiff", "aiff": "aiff", "aifc": "aiff", "wav": "wav", "wave": "wav"}


def lookup(table: dict[str, str], key: Column, otherwise: Column) -> Column:
    """A small constant table as a CASE expression."""
    out = otherwise
    for k, v in reversed(list(table.items())):
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def extension(path: Column) -> Column:
    """Lower-cased extension of the last path component; a leading dot alone is no extension."""
    return F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))


def format_of(path: Column) -> Column:
    return lookup(EXTENSIONS, extension(path), F.lit("unknown"))


def is_lossless(fmt: Column) -> Column:
    return fmt.isin(*LOSSLESS)


def conform(df: DataFrame) -> DataFrame:
    """``df`` with every track column: absent ones get the table's defaults, others pass through."""
    defaults = {"title": "", "artist": "", "album": "", "album_artist": "", "comment": "", "genre": "", "format": "unknown", "file_size": 0}
    columns = []
    for field in TRACK.fields:
        if field.name in df.columns:
            c = F.col(field.name).cast(field.dataType) if field.name != "tags" else F.col("tags")
            if field.name in defaults:
                c = F.coalesce(c, F.lit(defaults[field.name]).cast(field.dataType))
        elif field.name == "path":
            c = F.concat(F.lit("/music/"), F.col("id").cast("string"), F.lit(".mp3"))
        elif field.name == "modified":
            c = F.timestamp_seconds(F.lit(0))
        elif field.name == "tags":
            c = F.create_map().cast("map<string,string>")
        else:
            c = F.lit(defaults.get(field.name)).cast(field.dataType)
        columns.append(c.alias(field.name))
    return df.select(*columns)
