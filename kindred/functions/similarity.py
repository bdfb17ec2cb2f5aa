"""String similarity as expressions: edit distance, token order, Jaro-Winkler, and bounds that rule pairs out cheaply."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stands for a character that is taken already; not a character of any text (U+FFFF is none).
TAKEN = "￿"
PREFIX, BONUS = 4, 0.1

#: Kinds of characters that letter bags count, in two longs of 7 lanes of 8 bits each; the last kind is every other character. Any division gives a bound.
KINDS = ("e", "a", "t", "o", "n", "r", "i", "s", "lh", "dc", "um", "fpg", "wybvkxjqz")
LANES, BITS = 7, 8
HIGH = sum(0x80 << (BITS * k) for k in range(LANES))
MOST, LONGEST = 127, 254


def levenshtein_ratio(a: Column, b: Column, at_least: float | None = None) -> Column:
    """1 - distance / length of the longer text. With ``at_least`` the distance stops early and ratios below it are null."""
    longest = F.greatest(F.length(a), F.length(b))
    if at_least is None:
        return F.when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)
    bound = F.ceil((1 - at_least) * longest).cast("int")
    distance = F.call_function("levenshtein", a, b, bound)
    ratio = 1 - distance / longest
    return F.when(a == b, F.lit(1.0)).when((distance >= 0) & (ratio >= at_least), ratio)


def sorted_words(s: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(s, " "), lambda x: x != "")), " ")


def token_sort_ratio(a: Column, b: Column, at_least: float | None = None) -> Column:
    return levenshtein_ratio(sorted_words(a), sorted_words(b), at_least)


def characters(s: Column) -> Column:
    """The code points of a text, none for an empty one."""
    return F.regexp_extract_all(s, F.lit("(?s)(.)"), F.lit(1))


def jaro_winkler(a: Column, b: Column) -> Column:
    """Jaro-Winkler on code points: half transpositions count as halves, the prefix bonus (up to 4 characters, 0.1 each) always applies.

    A fold over the characters of ``a``: each takes the first equal character within reach in a copy of ``b`` and puts TAKEN there, so the
    search is the text search of the JVM. A null text gives null.
    """
    la, lb = F.length(a), F.length(b)
    reach = F.greatest(F.lit(0), (F.greatest(la, lb) / 2).cast("int") - 1)
    start = F.struct(b.alias("rest"), F.lit("").alias("left"), F.lit(0).alias("i"))

    def take(acc: Column, c: Column) -> Column:
        i = acc["i"]
        found = F.call_function("locate", c, acc["rest"], F.greatest(F.lit(1), i - reach + 1))
        hit = (found > 0) & (found <= i + reach + 1) & (c != TAKEN)
        return F.struct(
            F.when(hit, F.overlay(acc["rest"], F.lit(TAKEN), found, F.lit(1))).otherwise(acc["rest"]).alias("rest"),
            F.when(hit, F.concat(acc["left"], c)).otherwise(acc["left"]).alias("left"), (i + 1).alias("i"),
        )

    def score(acc: Column) -> Column:
        left = characters(acc["left"])
        right = F.filter(F.zip_with(characters(b), characters(acc["rest"]), lambda x, y: F.when((y == TAKEN) & (x != TAKEN), x)), lambda x: x.isNotNull())
        m = F.size(left)
        half = F.size(F.filter(F.zip_with(left, right, lambda x, y: x != y), lambda d: d)) / 2
        jaro = (m / la + m / lb + (m - half) / F.nullif(m, F.lit(0))) / 3
        same = F.lit(0)
        for k in range(1, PREFIX + 1):
            same = F.when((F.least(la, lb) >= k) & (F.left(a, F.lit(k)) == F.left(b, F.lit(k))), k).otherwise(same)
        return F.when(m == 0, 0.0).otherwise(jaro + same * BONUS * (1 - jaro))

    ratio = F.aggregate(characters(a), start, take, score)
    return F.when(a == b, 1.0).when((a == "") | (b == ""), 0.0).when(a.isNotNull() & b.isNotNull(), ratio)


def fuzzy_ratio(a: Column, b: Column) -> Column:
    return F.greatest(jaro_winkler(a, b), token_sort_ratio(a, b))


def bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def letter_bags(s: Column) -> Column:
    """``struct<b0, b1>``: how many characters of each kind a text has, as two longs; null if the text is too long for them."""
    kinds = F.array(*[F.lit(k) for k in KINDS])
    known = F.transform(kinds, lambda k: F.length(s) - F.length(F.call_function("translate", s, k, F.lit(""))))
    add = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda x, y: x + y)
    shifts = F.array(*[F.lit(1 << (BITS * k)) for k in range(LANES)])
    pack = lambda c, first: add(F.zip_with(F.slice(c, first + 1, LANES), shifts, lambda n, by: n * by))

    def packed(c: Column) -> Column:
        fits = (F.length(s) <= LONGEST) & (F.array_max(c) <= MOST)
        return F.struct(F.when(fits, pack(c, 0)).alias("b0"), F.when(fits, pack(c, LANES)).alias("b1"))

    return bound(bound(known, lambda c: F.concat(c, F.array((F.length(s) - add(c)).cast("int")))), packed)


def most_in_common(x: list[Column], y: list[Column]) -> Column:
    """At most so many characters are common to two texts with these bags: the sum of the lesser of each two lanes, all lanes at once.

    A lane's high bit survives ``(x | HIGH) - y`` if x is at least y there, and makes a mask; 256 leaves 1 when divided by 255, so a
    remainder adds the lanes up.
    """
    high = F.lit(HIGH)

    def least(p: Column, q: Column) -> Column:
        bit = (p.bitwiseOR(high) - q).bitwiseAND(high)
        mask = bit - F.shiftrightunsigned(bit, BITS - 1)
        return p.bitwiseXOR(p.bitwiseXOR(q).bitwiseAND(mask)) % 255

    return least(x[0], y[0]) + least(x[1], y[1])


def outline(s: Column) -> Column:
    """What the bounds look at: ``struct<hash, b0, b1, n, words, first>``; words is the length of the text with its words sorted."""
    return bound(letter_bags(s), lambda b: F.struct(F.xxhash64(s).alias("hash"), b["b0"].alias("b0"), b["b1"].alias("b1"), F.length(s).alias("n"), F.length(sorted_words(s)).alias("words"), F.left(s, F.lit(1)).alias("first")))


def may_reach(x: Column, y: Column, level: str, at_least: float) -> Column:
    """False only if two texts with these outlines are surely less alike than ``at_least``; level: ``similar`` (edit ratio) or ``fuzzy``.

    With c common characters at most, an edit ratio is at most c / the longer length, and Jaro is at most (c/n + c/m + 1) / 3; the
    bonus of Jaro-Winkler needs an equal first character. Each is a number of common characters that is needed.
    """
    if level == "similar":
        needed = F.greatest(x["n"], y["n"]) * at_least
    else:
        least = F.when(x["first"] == y["first"], (at_least - PREFIX * BONUS) / (1 - PREFIX * BONUS)).otherwise(at_least) * 3 - 1
        needed = F.least(least * x["n"] * y["n"] / F.greatest(x["n"] + y["n"], F.lit(1)), F.greatest(x["words"], y["words"]) * at_least)
    c = most_in_common([x["b0"], x["b1"]], [y["b0"], y["b1"]])
    return (x["hash"] == y["hash"]) | x["b0"].isNull() | y["b0"].isNull() | (c >= F.greatest(needed - 1e-6, F.lit(1.0)))
