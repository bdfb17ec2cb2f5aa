"""The normalisation pipeline: title and artist to their comparable form, one staged projection per rule that is switched on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import credits as C
from ..functions import text as X
from ..options import NormalisationOptions
from ..storage import spread

NO_NAMES = "cast(array() as array<string>)"


def _fold_name(name: Column, options: NormalisationOptions) -> Column:
    return X.fold(X.remove_the(name) if options.ignore_leading_the else name, options)


def _names(s: Column, options: NormalisationOptions) -> Column:
    return C.split_collaborators(s) if options.split_collaborations else F.array(s)


def normalise(df: DataFrame, options: NormalisationOptions, title: str = "title", artist: str = "artist", stem: Column | None = None, out: str = "n") -> DataFrame:
    """``df`` with a struct ``out``: raw_title, raw_artist, title, artist, primary, featured, removed.

    Each stage is a projection of its own, so an expression that later stages use several times is computed once.
    """
    t, a, removed, featured, aux = (f"_{out}_{x}" for x in ("title", "artist", "removed", "featured", "aux"))
    text, who, gone, guests, part = (F.col(x) for x in (t, a, removed, featured, aux))
    df = spread(df).withColumns({t: X.collapse(F.col(title)), a: X.collapse(F.col(artist)), removed: F.expr(NO_NAMES), featured: F.expr(NO_NAMES)})
    raw = {f"_{out}_raw_title": text, f"_{out}_raw_artist": who}
    df = df.withColumns(raw)

    if options.filename_fallback and stem is not None:
        df = df.withColumn(aux, F.when(text == "", X.split_spaced_dash(C.remove_track_number(X.collapse(stem)))))
        rest = F.when(F.size(part) >= 2, F.array_join(F.slice(part, F.lit(2), F.size(part)), " - ")).otherwise(C.remove_track_number(X.collapse(stem)))
        df = df.withColumns({
            t: F.when(text == "", rest).otherwise(text),
            a: F.when((text == "") & (F.size(part) >= 2) & (who == ""), F.get(part, F.lit(0))).otherwise(who),
        })
    if options.split_artist_from_title:
        df = df.withColumn(aux, X.split_spaced_dash(text))
        head = F.get(part, F.lit(0))
        splits = (F.size(part) >= 2) & (head != "") & ((who == "") | (X.fold(head, options) == X.fold(who, options)))
        rest = F.array_join(F.slice(part, F.lit(2), F.size(part)), " - ")
        df = df.withColumns({t: F.when(splits, rest).otherwise(text), a: F.when(splits & (who == ""), head).otherwise(who)})
    if options.strip_track_number_prefix:
        df = df.withColumn(aux, C.remove_track_number(text))
        prefix = X.trim_separators(F.substring(text, F.lit(1), F.length(text) - F.length(part)))
        df = df.withColumns({removed: F.when(part != text, F.concat(gone, F.array(prefix))).otherwise(gone), t: part})
    if options.strip_featured_from_title:
        df = df.withColumn(aux, C.split_featured(text))
        found = part["featured"].isNotNull() & (part["main"] != "")
        df = df.withColumns({
            featured: F.when(found, F.concat(guests, _names(part["featured"], options))).otherwise(guests),
            removed: F.when(found, F.concat(gone, F.array(F.concat(F.lit("feat. "), part["featured"])))).otherwise(gone),
            t: F.when(found, part["main"]).otherwise(text),
        })
    df = _strip_versions(df, options, t, removed, aux, out)

    if options.separate_featured_artists:
        df = df.withColumn(aux, C.split_featured(who))
        guest = F.when(part["featured"].isNotNull(), _names(part["featured"], options)).otherwise(F.expr(NO_NAMES))
        df = df.withColumns({featured: F.concat(guests, guest), f"_{out}_primary": _names(part["main"], options)})
    else:
        df = df.withColumn(f"_{out}_primary", _names(who, options))
    names = lambda c: X.unique_sorted(F.transform(c, lambda x: _fold_name(x, options)))
    df = df.withColumns({t: X.fold(text, options), featured: names(guests), f"_{out}_primary": names(F.col(f"_{out}_primary"))})
    primary = F.col(f"_{out}_primary")
    whole = F.struct(
        F.col(f"_{out}_raw_title").alias("raw_title"), F.col(f"_{out}_raw_artist").alias("raw_artist"), text.alias("title"),
        F.array_join(primary, " & ").alias("artist"), primary.alias("primary"), guests.alias("featured"), gone.alias("removed"),
    )
    return df.withColumn(out, whole).drop(t, a, removed, featured, aux, f"_{out}_primary", *raw)


def _strip_versions(df: DataFrame, options: NormalisationOptions, t: str, removed: str, aux: str, out: str) -> DataFrame:
    """Bracketed version text goes unless nothing would be left, then trailing `` - version`` parts."""
    by_class = options.version_stripping != "off"
    if not by_class and not options.strip_all_brackets:
        return df
    text, gone, part = F.col(t), F.col(removed), F.col(aux)
    before, cut = f"_{out}_before", f"_{out}_cut"
    wanted = ("neutral",) if options.version_stripping == "neutral_only" else ("neutral", "distinct")
    strips = lambda s: C.version_class(s).isin(*wanted)
    df = df.withColumns({before: F.size(gone), aux: C.bracket_segments(text)})
    if not options.strip_all_brackets:
        df = df.withColumn(aux, F.filter(part, lambda x: strips(C.segment_text(text, x))))
    df = df.withColumn(cut, C.without_segments(text, part))
    left = X.trim_separators(F.col(cut)) != ""
    # two projections: inside a lambda a name that the same projection replaces would be its new value
    df = df.withColumn(removed, F.when(left, F.concat(gone, F.transform(part, lambda x: C.segment_text(text, x)))).otherwise(gone))
    df = df.withColumn(t, F.when(left, F.col(cut)).otherwise(text))
    if by_class:
        df = df.withColumn(aux, X.split_spaced_dash(text))
        df = df.withColumn(cut, F.greatest(F.lit(1), F.coalesce(F.array_max(F.transform(part, lambda x, i: F.when(strips(x), 0).otherwise(i + 1))), F.lit(0))))
        kept = F.col(cut).cast("int")
        df = df.withColumns({
            removed: F.concat(gone, F.reverse(F.slice(part, kept + 1, F.greatest(F.size(part) - kept, F.lit(0))))),
            t: F.array_join(F.slice(part, F.lit(1), kept), " - "),
        })
    return df.withColumn(t, F.when(F.size(gone) > F.col(before), X.trim_separators(text)).otherwise(text)).drop(before, cut)
