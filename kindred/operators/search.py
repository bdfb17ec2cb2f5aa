"""A search index over the texts of tracks: postings of character grams, kept as tables and updated by what changes.

A text contains a needle only if it contains all of the needle's grams, so a search reads the postings of these grams alone, counts them per track, and looks into
the texts of the tracks that have them all. Texts are padded, so that every character begins a gram: a needle shorter than a gram is the beginning of one.

Postings are segments: each task sorts those of its own texts by gram, so nothing is shuffled and a scan skips the row groups and pages of other grams in every
segment. Removed tracks are a table of ids that searches leave out; ``compacted`` writes the postings without them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import search_fold
from ..storage import materialise, spread

GRAM = 3
PAD = "\u0001" * (GRAM - 1)


@dataclass(frozen=True)
class SearchIndex:
    postings: DataFrame  #: ``gram, id``
    texts: DataFrame  #: ``id, search_text``
    removed: DataFrame | None = None  #: ``id``


def grams(text: Column) -> Column:
    """The distinct grams of a text, padded behind."""
    return F.array_distinct(F.regexp_extract_all(F.concat(text, F.lit(PAD)), F.lit(f"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)))  # one pass, matches overlap


def build(texts: DataFrame) -> SearchIndex:
    """The index of ``id, search_text``; null texts are empty."""
    texts = materialise(texts.select("id", F.coalesce("search_text", F.lit("")).alias("search_text")))
    return SearchIndex(_postings(texts), texts)


def _postings(texts: DataFrame) -> DataFrame:
    return materialise(spread(texts).select(F.explode(grams(F.col("search_text"))).alias("gram"), "id").sortWithinPartitions("gram", "id"), "zstd")


def without(index: SearchIndex, ids: DataFrame) -> SearchIndex:
    """The index after tracks (``id``) went; nothing of it is written again."""
    gone = ids.select("id") if index.removed is None else index.removed.union(ids.select("id"))
    return replace(index, removed=materialise(gone.distinct()))


def with_texts(index: SearchIndex, texts: DataFrame) -> SearchIndex:
    """The index with further or changed tracks (``id, search_text``): only their postings are made. What was known of their ids before is compacted away."""
    old = compacted(without(index, texts))
    new = build(texts)
    return SearchIndex(old.postings.union(new.postings), old.texts.union(new.texts))


def compacted(index: SearchIndex) -> SearchIndex:
    if index.removed is None:
        return index
    left = [materialise(x.join(index.removed, "id", "left_anti").select(*x.columns)) for x in (index.postings.sortWithinPartitions("gram"), index.texts)]
    return SearchIndex(*left)


def search(index: SearchIndex, needle: str) -> DataFrame:
    """``id`` of the tracks whose text contains the needle, whatever its case and accents; all of them for an empty needle."""
    live = index.texts if index.removed is None else index.texts.join(index.removed, "id", "left_anti")
    folded = index.texts.sparkSession.range(1).select(search_fold(F.lit(needle.strip())).alias("s")).first().s
    if not folded:
        return live.select("id")
    if len(folded) < GRAM:
        held = index.postings.filter(F.startswith("gram", F.lit(folded))).select("id").distinct()
    else:
        wanted = sorted({folded[i : i + GRAM] for i in range(len(folded) - GRAM + 1)})
        held = index.postings.filter(F.col("gram").isin(wanted)).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select("id")
    return live.join(held, "id", "left_semi").filter(F.contains("search_text", F.lit(folded))).select("id")
