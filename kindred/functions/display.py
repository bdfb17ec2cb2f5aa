"""What a track's columns look like, and the keys they sort by."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import FORMAT_NAMES, lookup
from .text import natural_key

# Id and the name shown, for the built-in columns in their order.
COLUMNS = {
    "trackNumber": "Track Number", "title": "Title", "artist": "Artist", "albumArtist": "Album Artist", "album": "Album", "year": "Year",
    "comment": "Comment", "genre": "Genre", "discNumber": "Disc Number", "duration": "Duration", "bitrate": "Bitrate", "format": "Format",
    "sampleRate": "Sample Rate", "bitDepth": "Bit Depth", "channels": "Channels", "size": "Size", "modified": "Modified",
    "fileName": "File Name", "path": "Path",
}
SHORT_TITLES = {"trackNumber": "#", "discNumber": "Disc"}
DEFAULT_COLUMNS = ("trackNumber", "title", "artist", "albumArtist", "album", "year", "comment", "duration", "bitrate", "format", "size", "path")
NOT_HIGHLIGHTED = ("path", "fileName")
_PLAIN = {"title": "title", "artist": "artist", "albumArtist": "album_artist", "album": "album", "comment": "comment", "genre": "genre", "path": "path"}
_NUMBERS = {
    "trackNumber": "track_number", "year": "year", "discNumber": "disc_number", "duration": "duration", "bitrate": "bitrate",
    "sampleRate": "sample_rate", "bitDepth": "bit_depth", "channels": "channels", "size": "file_size",
}


def parse_column(column_id: str) -> str | None:
    """The id itself if it names a built-in column or ``tag:KEY``, else None."""
    return column_id if column_id in COLUMNS or (column_id.startswith("tag:") and len(column_id) > 4) else None


def column_title(column_id: str) -> str:
    return column_id[4:] if column_id.startswith("tag:") else SHORT_TITLES.get(column_id, COLUMNS[column_id])


@F.pandas_udf(StringType())
def fixed_digits(value: pd.Series, digits: pd.Series) -> pd.Series:
    """The exact binary value rounded half to even to so many digits, as C's printf does it; the JVM rounds the shortest decimal."""
    return pd.Series([None if pd.isna(v) else f"{v:.{int(d)}f}" for v, d in zip(value, digits, strict=True)], dtype="object")


def format_duration(seconds: Column) -> Column:
    """``m:ss`` or ``h:mm:ss``; halves round away from zero."""
    total = F.round(seconds).cast("long")
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    hours, minutes, rest = F.floor(total / 3600), F.floor(total / 60) % 60, total % 60
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), two(minutes), F.lit(":"), two(rest))).otherwise(F.concat(minutes.cast("string"), F.lit(":"), two(rest)))


def format_sample_rate(hertz: Column) -> Column:
    khz = hertz / 1000
    text = F.when(khz == F.round(khz), khz.cast("long").cast("string")).otherwise(fixed_digits(khz, F.lit(1)))
    return F.concat(text, F.lit(" kHz"))


def format_size(size: Column) -> Column:
    """Decimal units with 0, 0, 1 and 2 digits."""
    def scaled(power: int) -> Column:
        value = size.cast("double")
        for _ in range(power):
            value = value / 1000
        return value

    kb, mb, gb, tb = (scaled(p) for p in (1, 2, 3, 4))
    number = fixed_digits(F.when(mb < 1000, mb).when(gb < 1000, gb).otherwise(tb), F.when(mb < 1000, 1).otherwise(2))
    return (
        F.when(size < 1000, F.concat(size.cast("string"), F.lit(" bytes")))
        .when(kb < 1000, F.concat(F.round(kb).cast("long").cast("string"), F.lit(" KB")))
        .otherwise(F.concat(number, F.when(mb < 1000, " MB").when(gb < 1000, " GB").otherwise(" TB")))
    )


def format_date(at: Column, zone: str = "UTC") -> Column:
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit(zone), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm")


def file_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]*$", "")


def text_of(column_id: str, zone: str = "UTC") -> Column:
    """What the column shows for a track row; nothing for missing values."""
    if column_id.startswith("tag:"):
        return F.coalesce(F.element_at("tags", F.lit(column_id[4:])), F.lit(""))
    if column_id in _PLAIN:
        return F.col(_PLAIN[column_id])
    none = F.lit("")
    return {
        "duration": lambda: F.coalesce(format_duration(F.col("duration")), none),
        "bitrate": lambda: F.coalesce(F.concat(F.col("bitrate").cast("string"), F.lit(" kbps")), none),
        "format": lambda: lookup(FORMAT_NAMES, F.col("format"), F.lit("Unknown")),
        "sampleRate": lambda: F.coalesce(format_sample_rate(F.col("sample_rate")), none),
        "bitDepth": lambda: F.coalesce(F.concat(F.col("bit_depth").cast("string"), F.lit("-bit")), none),
        "size": lambda: format_size(F.col("file_size")),
        "modified": lambda: format_date(F.col("modified"), zone),
        "fileName": lambda: file_name(F.col("path")),
    }.get(column_id, lambda: F.coalesce(F.col(_NUMBERS[column_id]).cast("string"), none))()


def sort_key(column_id: str) -> Column:
    """``struct<kind, number, text>``: numbers before text; null for a missing value, so it can be put last both ways."""
    number = F.col("modified").cast("double") if column_id == "modified" else F.col(_NUMBERS[column_id]).cast("double") if column_id in _NUMBERS else None
    if number is not None:
        return F.when(number.isNotNull(), F.struct(F.lit(0).alias("kind"), number.alias("number"), F.lit("").alias("text")))
    text = text_of(column_id)
    return F.when(text != "", F.struct(F.lit(1).alias("kind"), F.lit(0.0).alias("number"), natural_key(text).alias("text")))


def display_name(title: Column, artist: Column, path: Column) -> Column:
    return F.when((artist != "") & (title != ""), F.concat(artist, F.lit(" – "), title)).when(title != "", title).when(artist != "", artist).otherwise(file_name(path))


def copy_summary() -> Column:
    """``FLAC · 1000 kbps · name.flac``."""
    parts = F.array(text_of("format"), text_of("bitrate"), text_of("fileName"))
    return F.array_join(F.filter(parts, lambda x: x != ""), " · ")


def group_detail(copies: Column, confidence: Column, reasons: Column) -> Column:
    """``3 copies · 97% · Same title``."""
    n = F.concat(copies.cast("string"), F.when(copies == 1, " copy").otherwise(" copies"))
    return F.array_join(F.concat(F.array(n, F.concat(F.round(confidence * 100).cast("int").cast("string"), F.lit("%"))), reasons), " · ")


def name_list(names: Column) -> Column:
    """``“A”``, ``“A” and “B”``, ``“A”, “B” and “C”`` or ``“A”, “B”, “C” and 4 more``."""
    shown = F.transform(F.slice(names, 1, 3), lambda x: F.concat(F.lit("“"), x, F.lit("”")))
    n, rest = F.size(shown), F.size(names) - 3
    return (
        F.when(rest > 0, F.concat(F.array_join(shown, ", "), F.lit(" and "), F.format_number(rest, 0), F.lit(" more")))
        .when(n > 1, F.concat(F.array_join(F.slice(shown, F.lit(1), n - 1), ", "), F.lit(" and "), F.get(shown, n - 1)))
        .otherwise(F.coalesce(F.get(shown, F.lit(0)), F.lit("")))
    )


def version_key(version: Column) -> Column:
    """Numbers of a dotted version without trailing zeros; arrays compare number by number, so 1.2 equals 1.2.0."""
    numbers = F.transform(F.filter(F.split(version, r"\."), lambda x: x != ""), lambda x: F.coalesce(F.regexp_extract(x, "^[0-9]+", 0).try_cast("bigint"), F.lit(0)))
    last = F.array_max(F.transform(numbers, lambda x, i: F.when(x != 0, i + 1).otherwise(0)))
    return F.slice(numbers, F.lit(1), F.coalesce(last, F.lit(0)))
