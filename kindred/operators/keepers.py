"""Choosing which copy of a group stays."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import FORMAT_NAMES, is_lossless
from .views import members

# The rules without an argument and their texts.
PLAIN_RULES = {
    "prefer_lossless": "Prefer lossless", "higher_bitrate": "Higher bitrate", "higher_sample_rate": "Higher sample rate", "higher_bit_depth": "Higher bit depth",
    "longer_duration": "Longer duration", "more_tags_filled": "More tags filled in", "larger_file": "Larger file", "older_file": "Older file", "newer_file": "Newer file",
}
DURATION_TOLERANCE = 0.5


@dataclass(frozen=True)
class KeeperRule:
    """One of PLAIN_RULES, or path_contains, path_does_not_contain or prefer_format with an argument."""

    kind: str
    argument: str | None = None

    @property
    def description(self) -> str:
        if self.kind == "path_contains":
            return f"Path contains “{self.argument}”"
        if self.kind == "path_does_not_contain":
            return f"Path doesn't contain “{self.argument}”"
        return f"Prefer {FORMAT_NAMES[self.argument]}" if self.kind == "prefer_format" else PLAIN_RULES[self.kind]

    @property
    def tolerance(self) -> float:
        return DURATION_TOLERANCE if self.kind == "longer_duration" else 0.0

    def rank(self) -> Column:
        """Larger is better, null is worst."""
        one = lambda c: F.when(c, 1.0).otherwise(0.0)
        inside = F.contains(F.lower("path"), F.lit((self.argument or "").lower()))
        return {
            "prefer_lossless": lambda: one(is_lossless(F.col("format"))),
            "higher_bitrate": lambda: F.col("bitrate").cast("double"),
            "higher_sample_rate": lambda: F.col("sample_rate").cast("double"),
            "higher_bit_depth": lambda: F.col("bit_depth").cast("double"),
            "longer_duration": lambda: F.col("duration"),
            "more_tags_filled": lambda: filled_tags().cast("double"),
            "larger_file": lambda: F.col("file_size").cast("double"),
            "older_file": lambda: -F.col("modified").cast("double"),
            "newer_file": lambda: F.col("modified").cast("double"),
            "path_contains": lambda: one(inside),
            "path_does_not_contain": lambda: one(~inside),
            "prefer_format": lambda: one(F.col("format") == self.argument),
        }[self.kind]()


DEFAULT_RULES = tuple(KeeperRule(k) for k in ("prefer_lossless", "higher_bitrate", "higher_sample_rate", "higher_bit_depth", "longer_duration", "more_tags_filled"))


def filled_tags() -> Column:
    """How many of the texts, numbers and tags of a track are filled in."""
    texts = [F.when(F.col(c) != "", 1).otherwise(0) for c in ("title", "artist", "album", "album_artist", "comment", "genre")]
    numbers = [F.when(F.col(c).isNotNull(), 1).otherwise(0) for c in ("track_number", "disc_number", "year")]
    return sum([*texts, *numbers], F.lit(0)) + F.size(F.map_filter("tags", lambda k, v: v != ""))


def best_copies(copies: DataFrame, rules: tuple[KeeperRule, ...] = DEFAULT_RULES) -> DataFrame:
    """``group_id, keeper`` of copies (``group_id, pos`` and the tracks' columns), as a fold in order that holds no group.

    Up to the first rule with a tolerance the rules are an order, and only copies that come first in it can be kept: a maximum per group, summed in part. Without such a rule
    that is all. A tolerance makes "better" no order (of 1.0, 1.4 and 1.8 seconds none beats the one before it, but the last beats the first), so what is left is
    folded in order: copies of equal ranks count once, a task reads its groups sorted by place and carries the best copy so far. A group of any size takes one row of memory.
    """
    exact = next((k for k, r in enumerate(rules) if r.tolerance), len(rules))
    names = [f"r{k}" for k in range(len(rules))]
    ranked = copies.select("group_id", "pos", F.col("id").alias("track_id"), *[r.rank().cast("double").alias(n) for n, r in zip(names, rules, strict=True)])
    first = F.struct(*names[:exact], (-F.col("pos")).alias("place"), "track_id")  # nulls are smallest
    top = ranked.groupBy("group_id").agg(F.max(first).alias("top"))
    if exact == len(rules):
        return top.select("group_id", F.col("top.track_id").alias("keeper"))
    if exact:
        of = top.select(F.col("group_id").alias("of"), *[F.col(f"top.{n}").alias(f"t{n}") for n in names[:exact]])
        ranked = ranked.join(of, (F.col("group_id") == F.col("of")) & reduce(lambda a, b: a & b, [F.col(n).eqNullSafe(F.col(f"t{n}")) for n in names[:exact]]), "left_semi")
    rest = names[exact:]
    distinct = ranked.groupBy("group_id", *rest).agg(F.min(F.struct("pos", "track_id")).alias("first")).select("group_id", "first.pos", "first.track_id", *rest)
    tolerances = [r.tolerance for r in rules[exact:]]

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = keeper = best = None
        for batch in batches:
            done = []
            for g, track, *ranks in zip(*(batch.column(c).to_pylist() for c in ("group_id", "track_id", *rest)), strict=True):
                if g != group:
                    if best is not None:
                        done.append((group, keeper))
                    group, keeper, best = g, track, ranks
                elif beats(ranks, best, tolerances):
                    keeper, best = track, ranks
            yield _pairs(done)
        if best is not None:
            yield _pairs([(group, keeper)])

    return distinct.repartition("group_id").sortWithinPartitions("group_id", "pos").mapInArrow(fold, "group_id long, keeper long")


def _pairs(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=pa.int64()) for k in (0, 1)], names=["group_id", "keeper"])


def beats(ranks: list[float | None], best: list[float | None], tolerances: list[float]) -> bool:
    """Whether a copy beats the best one so far: the first rule that tells them apart decides."""
    for a, b, tolerance in zip(ranks, best, tolerances, strict=True):
        if a is None or b is None:
            if a is not b:
                return b is None
        elif abs(a - b) > tolerance:
            return a > b
    return False


def choices(groups: DataFrame, tracks: DataFrame, rules: tuple[KeeperRule, ...] = DEFAULT_RULES) -> DataFrame:
    """``group_id, keeper, others``: the best copy of each group and the rest as an array, in order."""
    copies = members(groups, tracks)
    best = best_copies(copies, rules)
    others = copies.select("group_id", "pos", "id").join(best, "group_id").groupBy("group_id", "keeper").agg(F.array_sort(F.collect_list(F.when(F.col("id") != F.col("keeper"), F.struct("pos", "id")))).alias("o"))
    return others.select("group_id", "keeper", F.transform("o", lambda x: x["id"]).alias("others"))


def auto_select(groups: DataFrame, tracks: DataFrame, rules: tuple[KeeperRule, ...] = DEFAULT_RULES) -> DataFrame:
    """``id`` of every copy that is not kept."""
    copies = members(groups, tracks)
    return copies.select("group_id", "id").join(best_copies(copies, rules), "group_id").filter("id <> keeper").select("id").distinct()


def apply_choices(marks: DataFrame, chosen: DataFrame) -> DataFrame:
    """Marks (``id``) without the keepers and with the others."""
    kept = chosen.select(F.col("keeper").alias("id"))
    return marks.select("id").join(kept, "id", "left_anti").union(chosen.select(F.explode("others").alias("id"))).distinct()


def valid_marks(marks: DataFrame, groups: DataFrame) -> DataFrame:
    """Marks of tracks that are still in some group."""
    return marks.select("id").distinct().join(groups.select(F.explode("track_ids").alias("id")), "id", "left_semi")


def toggle_marks(marks: DataFrame, ids: DataFrame) -> DataFrame:
    """Marks with those of ``ids`` switched over."""
    a, b = marks.select("id").distinct(), ids.select("id").distinct()
    return a.join(b, "id", "left_anti").union(b.join(a, "id", "left_anti"))
