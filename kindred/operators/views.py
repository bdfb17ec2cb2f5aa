"""Filtering, ordering and comparing groups for display."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import display
from ..functions.text import search_fold
from .search import SearchIndex, search


def members(groups: DataFrame, tracks: DataFrame) -> DataFrame:
    """``group_id, pos`` and the track's columns, one row per copy; ids without a track are dropped."""
    return groups.select(F.col("id").alias("group_id"), F.posexplode("track_ids").alias("pos", "track_id")).join(tracks, F.col("track_id") == tracks["id"]).drop("track_id")


def search_text(tracks: DataFrame) -> DataFrame:
    """``id, search_text``: the folded text that filters look into."""
    return tracks.select("id", search_fold(F.concat_ws("\n", "title", "artist", "album", "album_artist", "path")).alias("search_text"))


def filter_groups(groups: DataFrame, tracks: DataFrame | SearchIndex, text: str = "", minimum_confidence: float = 0.0) -> DataFrame:
    """Groups of at least the confidence of which some copy contains the text, whatever its case and accents. A search index in place of the tracks is used and not built."""
    kept = groups.filter(F.col("confidence") >= minimum_confidence)
    if not (needle := text.strip()):
        return kept
    if isinstance(tracks, SearchIndex):
        hits = search(tracks, needle).select(F.col("id").alias("track_id"))
    else:
        hits = search_text(tracks).filter(F.contains("search_text", search_fold(F.lit(needle)))).select(F.col("id").alias("track_id"))
    found = kept.select("id", F.explode("track_ids").alias("track_id")).join(hits, "track_id", "left_semi").select("id").distinct()
    return kept.join(found, "id", "left_semi")


def arrange(groups: DataFrame, tracks: DataFrame, order: str = "confidence", ascending: bool = True) -> DataFrame:
    """``groups`` with ``rank`` from 0. order: ``confidence``, ``copies`` or a column id; earlier groups win ties.

    By column, the copies of each group are sorted first (missing values last either way) and groups go by their first copy.
    """
    from .grouping import number_rows

    if order in ("confidence", "copies"):
        by = F.col("confidence") if order == "confidence" else F.size("track_ids")
        return number_rows(groups, [by.desc(), F.col("id")], "rank")
    key = display.sort_key(order)
    directed = lambda c: F.asc_nulls_last(c) if ascending else F.desc_nulls_last(c)
    keyed = members(groups, tracks).select("group_id", "pos", F.col("id").alias("track_id"), key.alias("key"))
    place = Window.partitionBy("group_id").orderBy(directed("key"), "pos")
    sorted_copies = (
        keyed.withColumn("place", F.row_number().over(place)).groupBy("group_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "track_id"))), lambda x: x["track_id"]).alias("track_ids"), F.min_by("key", "place").alias("first"))
    )
    rest = groups.drop("track_ids").join(sorted_copies, groups["id"] == sorted_copies["group_id"]).drop("group_id")
    return number_rows(rest, [directed("first"), F.col("id")], "rank").drop("first").select(*groups.columns, "rank")


def differing_cells(groups: DataFrame, tracks: DataFrame, column_id: str) -> DataFrame:
    """``group_id, track_id`` of copies whose value is not the single most common one of their group.

    All copies differ if no value is the most common; none does if all are equal or the column is not highlighted.
    """
    values = members(groups, tracks).select("group_id", F.col("id").alias("track_id"), display.text_of(column_id).alias("value"))
    if column_id in display.NOT_HIGHLIGHTED:
        return values.select("group_id", "track_id").limit(0)
    counts = values.groupBy("group_id", "value").count()
    best = counts.groupBy("group_id").agg(F.max(F.struct("count", "value")).alias("top"), F.max("count").alias("most"), F.count("*").alias("n"))
    ties = counts.join(best.select("group_id", "most"), "group_id").filter(F.col("count") == F.col("most")).groupBy("group_id").agg(F.count("*").alias("tied"))
    common = best.join(ties, "group_id").filter("n > 1").select("group_id", F.when(F.col("tied") == 1, F.col("top.value")).alias("common"))
    return values.join(common, "group_id").filter(~F.col("value").eqNullSafe(F.col("common"))).select("group_id", "track_id")


def describe(groups: DataFrame, tracks: DataFrame) -> DataFrame:
    """``group_id, title, detail``: a group's heading from its first copy."""
    from .compare import REASON_TEXTS, REASONS
    from ..schema import lookup

    first = members(groups, tracks).filter("pos = 0").select("group_id", display.display_name(F.col("title"), F.col("artist"), F.col("path")).alias("heading"))
    texts = dict(zip(REASONS, REASON_TEXTS, strict=True))
    reasons = F.transform("reasons", lambda r: lookup(texts, r, r))
    detail = groups.select(F.col("id").alias("group_id"), display.group_detail(F.size("track_ids"), F.col("confidence"), reasons).alias("detail"))
    return detail.join(first, "group_id", "left").select("group_id", F.coalesce("heading", F.lit("")).alias("title"), "detail")


def format_counts(tracks: DataFrame) -> DataFrame:
    """``format, n`` with ``pos``, the format's place in the fixed order."""
    from ..schema import FORMATS

    place = F.array_position(F.array(*[F.lit(f) for f in FORMATS]), F.col("format"))
    return tracks.groupBy("format").agg(F.count("*").alias("n")).select("format", "n", (place - 1).cast("int").alias("pos"))


def tag_keys(tracks: DataFrame) -> DataFrame:
    return tracks.select(F.explode(F.map_keys("tags")).alias("key")).distinct()


def marked_summary(groups: DataFrame, tracks: DataFrame, marks: DataFrame) -> DataFrame:
    """Per group: ``group_id, copies, marked, marked_bytes, every_copy_marked``. marks: ``id``."""
    flagged = members(groups, tracks).join(marks.select(F.col("id").alias("marked_id")).distinct(), F.col("id") == F.col("marked_id"), "left")
    is_marked = F.col("marked_id").isNotNull()
    return flagged.groupBy("group_id").agg(
        F.count("*").alias("copies"), F.count_if(is_marked).alias("marked"), F.sum(F.when(is_marked, F.col("file_size")).otherwise(0)).alias("marked_bytes"), F.bool_and(is_marked).alias("every_copy_marked"),
    )


def drop_copies(groups: DataFrame, removed: DataFrame) -> DataFrame:
    """Groups without the removed tracks (``id``); groups left with one copy go."""
    kept = groups.select("id", F.posexplode("track_ids").alias("pos", "track_id")).join(removed.select(F.col("id").alias("track_id")), "track_id", "left_anti")
    lists = kept.groupBy("id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "track_id"))), lambda x: x["track_id"]).alias("track_ids")).filter(F.size("track_ids") > 1)
    return groups.drop("track_ids").join(lists, "id").select(*groups.columns)


def restore(tracks: DataFrame, removed: DataFrame, restored: DataFrame, criteria, max_bucket: int | None = None) -> DataFrame:
    """The groups after removed tracks (``id``) came back in part: those of ``removed`` that are not ``restored`` stay out, the rest is matched again."""
    from .engine import match

    out = removed.select("id").join(restored.select("id"), "id", "left_anti")
    return match(tracks.join(out, "id", "left_anti"), criteria, max_bucket)


def marked_choices(groups: DataFrame, marks: DataFrame) -> DataFrame:
    """``id, in_group``: every mark once, and whether it is of a track in some group."""
    inside = groups.select(F.explode("track_ids").alias("member")).distinct()
    return marks.select("id").distinct().join(inside, F.col("id") == F.col("member"), "left").select("id", F.col("member").isNotNull().alias("in_group"))
