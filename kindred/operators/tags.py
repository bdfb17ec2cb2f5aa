"""Comparing and copying the tags of two copies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import materialise

# Descriptive tags in their order, with their names.
DESCRIPTIVE = {
    "TITLE": "Title", "ARTIST": "Artist", "ALBUMARTIST": "Album Artist", "ALBUM": "Album",
    "SUBTITLE": "Subtitle", "TRACKNUMBER": "Track Number", "DISCNUMBER": "Disc Number",
    "DATE": "Date", "ORIGINALDATE": "Original Date", "GENRE": "Genre", "COMMENT": "Comment",
    "COMPOSER": "Composer", "LYRICIST": "Lyricist", "CONDUCTOR": "Conductor", "REMIXER": "Remixer",
    "BPM": "BPM", "INITIALKEY": "Key", "MOOD": "Mood", "GROUPING": "Grouping",
    "LABEL": "Label", "CATALOGNUMBER": "Catalogue Number", "ISRC": "ISRC", "COPYRIGHT": "Copyright",
    "COMPILATION": "Compilation", "WORK": "Work", "MOVEMENTNAME": "Movement", "LYRICS": "Lyrics",
    "TITLESORT": "Sort Title", "ARTISTSORT": "Sort Artist", "ALBUMARTISTSORT": "Sort Album Artist",
    "ALBUMSORT": "Sort Album", "COMPOSERSORT": "Sort Composer",
}

NO_VALUES = "cast(array() as array<string>)"


def _filled(values: Column) -> Column:
    return F.exists(values, lambda x: x != "")


def compare(pairs: DataFrame) -> DataFrame:
    """``pair_id, pos, key, name, source, destination, can_copy, fills_gap`` for every tag of either copy.

    pairs: ``pair_id, source, destination`` (maps of key to values). A full outer join of the exploded maps; descriptive
    tags come first in their order, then the rest by key.
    """
    from pyspark.sql import Window

    side = lambda c: pairs.select("pair_id", F.explode(c).alias("key", c))
    empty = F.expr(NO_VALUES)
    both = side("source").join(side("destination"), ["pair_id", "key"], "full_outer").select(
        "pair_id", "key", F.coalesce("source", empty).alias("source"), F.coalesce("destination", empty).alias("destination")
    )
    place = F.array_position(F.array(*[F.lit(k) for k in DESCRIPTIVE]), F.col("key"))
    can = _filled(F.col("source")) & (F.col("source") != F.col("destination"))
    by = Window.partitionBy("pair_id").orderBy(F.when(place > 0, place).asc_nulls_last(), "key")
    names = F.coalesce(F.get(F.array(*[F.lit(v) for v in DESCRIPTIVE.values()]), (F.nullif(place, F.lit(0)) - 1).cast("int")), F.col("key"))
    return both.select(
        "pair_id", (F.row_number().over(by) - 1).alias("pos"), "key", names.alias("name"), "source", "destination",
        can.alias("can_copy"), (can & (place > 0) & ~_filled(F.col("destination"))).alias("fills_gap"),
    )


def changes(compared: DataFrame, keys: list[str]) -> DataFrame:
    """``pair_id, changes``: the values to write for the chosen keys that can be copied."""
    chosen = compared.filter(F.col("key").isin(*keys) & F.col("can_copy"))
    return chosen.groupBy("pair_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "source")))).alias("changes"))


def written(old: Column, new: Column) -> Column:
    """Tags after a write: values replaced per key, an empty list removes the key, other keys stay."""
    return F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), F.map_filter(new, lambda k, v: F.size(v) > 0))


def default_destination(copies: Column, marked: Column, source: Column) -> Column:
    """The only unmarked copy, or else the first unmarked other one, or else the first other one (arrays of ids)."""
    unmarked = F.filter(copies, lambda x: ~F.array_contains(marked, x))
    others = F.filter(copies, lambda x: x != source)
    free = F.filter(others, lambda x: ~F.array_contains(marked, x))
    only = F.when((F.size(unmarked) == 1) & (F.get(unmarked, F.lit(0)) != source), F.get(unmarked, F.lit(0)))
    return F.coalesce(only, F.get(free, F.lit(0)), F.get(others, F.lit(0)))


def write(metadata: DataFrame, wanted: DataFrame, save, reread) -> DataFrame:
    """Writes tags, reads them again and gives the log: ``path, before, after, failure``.

    metadata: ``path, properties``; wanted: ``path, changes`` (values per key, none to remove it), keys without a change are left out of
    the log. save(``path, properties``) stores the new tags; reread(``path``) gives ``path, properties`` of the files that open.
    failure: null, ``cannotOpen`` if a file is not read before or after, ``cannotStore`` if a value is not what was written.
    """
    some = wanted.filter(F.size("changes") > 0)
    planned = materialise(some.join(metadata, "path", "left").select("path", "changes", "properties", written(F.col("properties"), F.col("changes")).alias("expected")))
    save(planned.filter("properties IS NOT NULL").select("path", F.col("expected").alias("properties")))
    again = reread(planned.select("path")).select("path", F.col("properties").alias("now"))
    of = lambda tags: F.map_from_entries(F.transform(F.array_sort(F.map_keys("changes")), lambda k: F.struct(k, F.coalesce(F.element_at(tags, k), F.expr(NO_VALUES)))))
    sorted_tags = lambda tags: F.array_sort(F.map_entries(tags))
    failure = F.when(F.col("properties").isNull() | F.col("now").isNull(), "cannotOpen").when(sorted_tags("now") != sorted_tags("expected"), "cannotStore")
    return planned.join(again, "path", "left").select("path", of(F.col("properties")).alias("before"), of(F.col("now")).alias("after"), failure.alias("failure"))
