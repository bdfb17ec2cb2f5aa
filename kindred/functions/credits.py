"""Brackets, versions and artist credits as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, fold_diacritics, unify_punctuation

# Fixed values.
CLOSERS = {"(": ")", "[": "]", "{": "}"}
DISTINCT_WORDS = (
    "remix", "remixes", "rmx", "remixed", "dub", "vip", "rework", "reworked",
    "bootleg", "live", "acoustic", "instrumental", "acapella", "acappella",
    "cappella", "reprise", "demo", "flip", "refix", "reedit", "mashup",
    "karaoke", "unplugged", "cover", "orchestral", "sped", "slowed", "reverb",
    "nightcore", "megamix", "medley", "rerub", "remode", "redux",
)
NEUTRAL_WORDS = (
    "original", "extended", "radio", "single", "album", "lp", "ep", "edit",
    "version", "mix", "mixed", "remaster", "remastered", "remasters", "mastered",
    "digitally", "digital", "explicit", "clean", "dirty", "censored", "uncensored",
    "mono", "stereo", "main", "full", "length", "short", "long", "12", "7",
    "inch", "12inch", "7inch", "vinyl", "cd", "bonus", "track", "deluxe",
    "edition", "hq", "hd", "official", "audio", "the", "a",
)
VERSION_MARKERS = ("mix", "edit", "version", "remaster", "remastered")
FILLER_WORDS = ("the", "a")
COLLABORATION_SEPARATORS = ("&", "and", "x", "×", "vs", "vs.", "versus", "+", "/", ",", ";", "with")
FEATURED = r"(?i)^(\S+(?: \S+)*?) ([(\[{]?)(?:feat[.:]?|ft[.:]?|featuring:?)(?: (.*))?$"
#: 1-3 digits, perhaps with a disc number before them, and a separator; a dash needs a space on one side; a bare space needs a leading zero or a disc number.
TRACK_NUMBER_PREFIX = (
    r"^(?:[0-9]{1,3}+(?:[-.][0-9]{2,3}+)?+(?!\p{N}) *+(?:[.)_] *+|(?<= )[-–—] *+|[-–—] ++)"
    r"|(?:0[0-9]{1,2}+(?:[-.][0-9]{2,3}+)?+|[0-9]{1,3}+[-.][0-9]{2,3}+)(?!\p{N}) ++(?![.)_\-–—]))(?!\p{N})(?=.*\p{L})"
)


def bracket_segments(s: Column) -> Column:
    """Top-level bracketed segments as ``array<struct<first, last>>`` of 1-based positions of the brackets.

    A fold over the characters with the stack of open brackets: nested segments belong to the outermost one, a closer that
    does not fit is ignored, an opener that is never closed hides what follows it.
    """
    opener = lambda c: c.isin(*CLOSERS)
    closer = lambda c: F.translate(c, "([{", ")]}")
    start = F.struct(F.lit("").alias("stack"), F.lit(0).alias("first"), F.expr("cast(array() as array<struct<first:int,last:int>>)").alias("found"))

    def step(acc: Column, at: Column) -> Column:
        c = F.substring(s, at, F.lit(1))
        depth = F.length(acc["stack"])
        closes = (depth > 0) & (closer(F.substring(acc["stack"], depth, F.lit(1))) == c)
        opened = F.struct(F.concat(acc["stack"], c).alias("stack"), F.when(depth == 0, at).otherwise(acc["first"]).alias("first"), acc["found"].alias("found"))
        segment = F.array(F.struct(acc["first"].alias("first"), at.alias("last")))
        closed = F.struct(
            F.substring(acc["stack"], F.lit(1), depth - 1).alias("stack"), acc["first"].alias("first"),
            F.when(depth == 1, F.concat(acc["found"], segment)).otherwise(acc["found"]).alias("found"),
        )
        return F.when(opener(c), opened).when(closes, closed).otherwise(acc)

    found = F.aggregate(F.sequence(F.lit(1), F.length(s)), start, step)["found"]
    return F.when(s.rlike(r"[(\[{].*[)\]}]"), found).otherwise(F.expr("cast(array() as array<struct<first:int,last:int>>)"))


def segment_text(s: Column, segment: Column) -> Column:
    """The text between the brackets of a segment."""
    return F.substring(s, segment["first"] + 1, segment["last"] - segment["first"] - 1)


def without_segments(s: Column, segments: Column) -> Column:
    """``s`` with each segment replaced by a space and white space collapsed; untouched if there is none."""
    start = F.struct(F.lit("").alias("text"), F.lit(1).alias("at"))
    walked = F.aggregate(segments, start, lambda acc, x: F.struct(
        F.concat(acc["text"], F.substring(s, acc["at"], x["first"] - acc["at"]), F.lit(" ")).alias("text"), (x["last"] + 1).alias("at"),
    ), lambda acc: F.concat(acc["text"], F.substring(s, acc["at"], F.length(s))))
    return F.when(F.size(segments) == 0, s).otherwise(collapse(walked))


def version_tokens(s: Column) -> Column:
    low = F.regexp_replace(F.lower(fold_diacritics(unify_punctuation(s))), "[-'.]", "")
    return F.filter(F.split(F.regexp_replace(low, r"[^\p{IsAlphabetic}\p{M}\p{N}]", " "), " "), lambda x: x != "")


def version_class_of(words: Column) -> Column:
    """``neutral``, ``distinct`` or ``not_a_version`` of a fragment's tokens."""
    neutral = lambda w: w.isin(*NEUTRAL_WORDS) | w.rlike(r"^(19|20)[0-9]{2}$")
    return (
        F.when(F.size(words) == 0, F.lit("not_a_version"))
        .when(F.exists(words, lambda w: w.isin(*DISTINCT_WORDS)), F.lit("distinct"))
        .when(F.forall(words, neutral) & F.exists(words, lambda w: ~w.isin(*FILLER_WORDS)), F.lit("neutral"))
        .when(F.exists(words, lambda w: w.isin(*VERSION_MARKERS)), F.lit("distinct"))
        .otherwise(F.lit("not_a_version"))
    )


def version_class(s: Column) -> Column:
    """The class of a fragment; its tokens are computed once, as the only element of an array."""
    return F.transform(F.array(version_tokens(s)), version_class_of)[0]


def split_featured(s: Column) -> Column:
    """``struct<main, featured>``: the credit after a word such as ``feat.``, which cannot come first; featured is null without one."""
    text = collapse(s)
    part = lambda n: F.regexp_extract(text, FEATURED, n)
    opener, after = part(2), F.coalesce(part(3), F.lit(""))
    end = F.when(opener != "", F.position(F.translate(opener, "([{", ")]}"), after)).otherwise(F.regexp_instr(after, F.lit(r"[(\[{]")))
    credit = F.when(end > 0, F.substring(after, F.lit(1), end - 1)).otherwise(after)
    rest = F.when(end == 0, F.lit("")).when(opener != "", F.substring(after, end + 1, F.length(after))).otherwise(F.substring(after, end, F.length(after)))
    return F.when(
        text.rlike(FEATURED),
        F.struct(collapse(F.concat(part(1), F.lit(" "), rest)).alias("main"), F.nullif(collapse(credit), F.lit("")).alias("featured")),
    ).otherwise(F.struct(text.alias("main"), F.lit(None).cast("string").alias("featured")))


def split_collaborators(s: Column) -> Column:
    """Names between separators such as ``&``, ``x`` or a comma.

    A fold over the words: a leading separator belongs to the name, repeated ones count once, and a trailing one made of
    letters goes back to the name before it.
    """
    words = F.filter(F.split(collapse(F.regexp_replace(s, "([,;])", " $1 ")), " "), lambda w: w != "")
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("now"), F.lit("").alias("separator"))

    def step(acc: Column, w: Column) -> Column:
        is_separator = F.lower(w).isin(*COLLABORATION_SEPARATORS)
        ended = F.struct(F.concat(acc["done"], F.array(acc["now"])).alias("done"), F.lit("").alias("now"), w.alias("separator"))
        longer = F.struct(acc["done"].alias("done"), F.when(acc["now"] == "", w).otherwise(F.concat_ws(" ", acc["now"], w)).alias("now"), acc["separator"].alias("separator"))
        return F.when(is_separator & (acc["now"] != ""), ended).when(is_separator & (F.size(acc["done"]) > 0), acc).otherwise(longer)

    def finish(acc: Column) -> Column:
        done, n = acc["done"], F.size(acc["done"])
        last = F.when(acc["separator"].rlike(r"^\p{L}+$"), F.concat_ws(" ", F.get(done, n - 1), acc["separator"])).otherwise(F.get(done, n - 1))
        return F.when(acc["now"] != "", F.concat(done, F.array(acc["now"]))).when(n == 0, done).otherwise(F.concat(F.slice(done, F.lit(1), n - 1), F.array(last)))

    return F.aggregate(words, start, step, finish)


def remove_track_number(s: Column) -> Column:
    return F.regexp_replace(s, TRACK_NUMBER_PREFIX, "")
