"""Text folding as Column expressions."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
DASHES = "-‐‑‒–—―−"
SINGLE_QUOTES = "‘’‚‛′`´"
DOUBLE_QUOTES = "“”„‟″«»"
SPECIAL_LETTERS = {
    "ß": "ss", "ø": "o", "Ø": "O", "æ": "ae", "Æ": "AE", "œ": "oe", "Œ": "OE",
    "ł": "l", "Ł": "L", "đ": "d", "Đ": "D", "þ": "th", "Þ": "Th", "ı": "i",
}
SEPARATOR_JUNK = r"\s\-–—_.:|/"


def collapse(s: Column) -> Column:
    """Runs of Unicode white space become one space; the ends are trimmed."""
    return F.regexp_replace(F.regexp_replace(s, r"(?U)\s+", " "), "^ | $", "")


def unify_punctuation(s: Column) -> Column:
    """Typographic dashes and quotes become ASCII."""
    return F.translate(s, DASHES + SINGLE_QUOTES + DOUBLE_QUOTES, "-" * len(DASHES) + "'" * len(SINGLE_QUOTES) + '"' * len(DOUBLE_QUOTES))


@lru_cache(1)
def _bases() -> tuple[str, str]:
    """By rule: every character outside ASCII that decomposes to one base character and marks, and the full-width forms."""
    source, target = [], []
    for code in range(0xA1, 0xFFEF):
        c = chr(code)
        if c in SPECIAL_LETTERS or 0xAC00 <= code <= 0xD7A3 or 0xF900 <= code <= 0xFAFF or 0xD800 <= code <= 0xF8FF:
            continue
        wide = unicodedata.decomposition(c).startswith(("<wide>", "<narrow>"))
        parts = [x for x in unicodedata.normalize("NFKD" if wide else "NFD", c) if not unicodedata.combining(x)]
        if len(parts) == 1 and parts[0] != c:
            source.append(c)
            target.append(parts[0])
    return "".join(source), "".join(target)


def strip_marks(s: Column) -> Column:
    """Accented letters become their base letters and combining marks go; ASCII text passes untouched."""
    return F.when(s.rlike(r"^[\x00-\x7F]*$"), s).otherwise(F.regexp_replace(F.translate(s, *_bases()), r"\p{Mn}", ""))


def fold_diacritics(s: Column) -> Column:
    """Special letters are spelled out, then accents and width differences go."""
    single = {k: v for k, v in SPECIAL_LETTERS.items() if len(v) == 1}
    out = F.translate(s, "".join(single), "".join(single.values()))
    for letter, spelled in SPECIAL_LETTERS.items():
        if len(spelled) > 1:
            out = F.replace(out, F.lit(letter), F.lit(spelled))
    return strip_marks(out)


def ampersand_to_and(s: Column) -> Column:
    """``&`` and ``+`` that stand alone become ``and``."""
    words = F.split(collapse(s), " ")
    return F.array_join(F.transform(words, lambda w: F.when(w.isin("&", "+"), F.lit("and")).otherwise(w)), " ")


def strip_punctuation(s: Column) -> Column:
    """Apostrophes and full stops go, other non-letters and non-numbers become spaces."""
    kept = F.regexp_replace(s, f"['.{SINGLE_QUOTES}]", "")
    return collapse(F.regexp_replace(kept, r"[^\p{IsAlphabetic}\p{M}\p{N}]", " "))


def remove_the(s: Column) -> Column:
    """``The X`` and ``X, The`` become ``X``."""
    t = collapse(s)
    low = F.lower(t)
    return (
        F.when(low.startswith("the ") & (F.length(t) > 4), F.substring(t, F.lit(5), F.length(t)))
        .when(low.endswith(", the") & (F.length(t) > 5), F.substring(t, F.lit(1), F.length(t) - 5))
        .otherwise(t)
    )


def split_spaced_dash(s: Column) -> Column:
    """Parts between dashes that have white space on both sides; empty parts stay."""
    return F.transform(F.split(s, rf"(?U)(?<=\s)[{DASHES}](?=\s)".replace("[-", r"[\-"), -1), collapse)


def trim_separators(s: Column) -> Column:
    return F.regexp_replace(s, rf"(?U)^[{SEPARATOR_JUNK}]+|[{SEPARATOR_JUNK}]+$", "")


def unique_sorted(names: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(names, lambda x: x != "")))


def tokens(s: Column) -> Column:
    """The distinct words of the lower-cased text without punctuation."""
    return F.array_distinct(F.filter(F.split(strip_punctuation(F.lower(s)), " "), lambda x: x != ""))


def leading_number(s: Column) -> Column:
    """The ASCII digits a value starts with, if that is above 0."""
    return F.nullif(F.regexp_extract(s, r"(?U)^\s*([0-9]+)", 1).try_cast("int"), F.lit(0))


def year(s: Column) -> Column:
    """The first four digits of the first run of four or more."""
    return F.substring(F.regexp_extract(s, r"[0-9]{4,}", 0), 1, 4).try_cast("int")


def search_fold(s: Column) -> Column:
    """Case and accents go; special letters stay."""
    return strip_marks(F.lower(s))


def fold(s: Column, options) -> Column:
    """The folding rules of the options, in their fixed order."""
    if options.unify_punctuation or options.ignore_punctuation:
        s = unify_punctuation(s)
    if options.fold_diacritics:
        s = fold_diacritics(s)
    if options.ignore_case:
        s = F.lower(s)
    if options.ampersand_as_and:
        s = ampersand_to_and(s)
    if options.ignore_punctuation:
        s = strip_punctuation(s)
    s = collapse(s)
    return F.regexp_replace(s, r"(?U)\s", "") if options.ignore_spaces else s


def natural_key(s: Column) -> Column:
    """A string whose binary order is case- and accent-insensitive with runs of digits as numbers: a number is led by its length."""
    runs = F.regexp_extract_all(search_fold(s), F.lit(r"([0-9]+|[^0-9]+)"), F.lit(1))
    bare = F.transform(runs, lambda r: F.regexp_replace(r, "^0+(?=[0-9])", ""))
    return F.array_join(F.transform(bare, lambda r: F.when(r.rlike("^[0-9]"), F.concat(F.lpad(F.length(r).cast("string"), 6, "0"), r)).otherwise(r)), "")
