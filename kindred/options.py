"""Normalisation options, match criteria and their presets, as frozen values that decide which expressions are built."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field, replace

LEVELS = ("identical", "same", "similar", "fuzzy", "ignore")
COMPARISONS = ("any", "same", "different")
VERSION_STRIPPING = ("off", "neutral_only", "all_versions")
EXTRA_FIELDS = ("album", "album_artist", "year", "genre", "comment")
DEFAULT_THRESHOLDS = {"similar": 0.9, "fuzzy": 0.8}


@dataclass(frozen=True)
class NormalisationOptions:
    ignore_case: bool = True
    fold_diacritics: bool = False
    unify_punctuation: bool = False
    ignore_punctuation: bool = False
    ampersand_as_and: bool = False
    ignore_spaces: bool = False
    version_stripping: str = "off"
    strip_all_brackets: bool = False
    strip_featured_from_title: bool = False
    strip_track_number_prefix: bool = False
    split_artist_from_title: bool = False
    filename_fallback: bool = False
    separate_featured_artists: bool = False
    split_collaborations: bool = False
    ignore_leading_the: bool = False

    def __post_init__(self) -> None:
        if self.version_stripping not in VERSION_STRIPPING:
            raise ValueError(f"version_stripping is one of {VERSION_STRIPPING}")


MINIMAL = NormalisationOptions()
TIDY = NormalisationOptions(fold_diacritics=True, unify_punctuation=True, ampersand_as_and=True)
DJ_LIBRARY = replace(
    TIDY, version_stripping="neutral_only", strip_featured_from_title=True, strip_track_number_prefix=True, split_artist_from_title=True,
    separate_featured_artists=True, split_collaborations=True, ignore_leading_the=True,
)
AGGRESSIVE = replace(DJ_LIBRARY, version_stripping="all_versions", ignore_punctuation=True, filename_fallback=True)


@dataclass(frozen=True)
class FieldRule:
    level: str = "same"
    threshold: float | None = None

    def __post_init__(self) -> None:
        if self.level not in LEVELS:
            raise ValueError(f"level is one of {LEVELS}")
        if self.threshold is None:
            object.__setattr__(self, "threshold", DEFAULT_THRESHOLDS.get(self.level, 1.0))

    @property
    def exact(self) -> bool:
        return self.level in ("identical", "same")


@dataclass(frozen=True)
class ExtraFieldRule:
    field: str
    rule: FieldRule

    def __post_init__(self) -> None:
        if self.field not in EXTRA_FIELDS:
            raise ValueError(f"field is one of {EXTRA_FIELDS}")


@dataclass(frozen=True)
class MatchCriteria:
    normalisation: NormalisationOptions = MINIMAL
    title: FieldRule = FieldRule("same")
    artist: FieldRule = FieldRule("same")
    artist_subset_matches: bool = False
    extra_fields: tuple[ExtraFieldRule, ...] = field(default=())
    duration_tolerance: float | None = 3.0
    track_number: str = "any"
    album: str = "any"
    format: str = "any"
    detect_swapped_fields: bool = False
    require_anchor_match: bool = True

    def __post_init__(self) -> None:
        for value in (self.track_number, self.album, self.format):
            if value not in COMPARISONS:
                raise ValueError(f"constraints are one of {COMPARISONS}")

    def to_json(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, indent=2)

    @staticmethod
    def from_json(text: str | None) -> MatchCriteria:
        """Unreadable settings give the standard criteria."""
        try:
            raw = json.loads(text or "")
            rule = lambda r: FieldRule(**r)
            return MatchCriteria(**{
                **raw,
                "normalisation": NormalisationOptions(**raw["normalisation"]), "title": rule(raw["title"]), "artist": rule(raw["artist"]),
                "extra_fields": tuple(ExtraFieldRule(e["field"], rule(e["rule"])) for e in raw["extra_fields"]),
            })
        except (ValueError, KeyError, TypeError):
            return STANDARD


STANDARD = MatchCriteria()
DJ = MatchCriteria(normalisation=DJ_LIBRARY, title=FieldRule("similar"))
LOOSE = MatchCriteria(
    normalisation=AGGRESSIVE, title=FieldRule("fuzzy"), artist=FieldRule("fuzzy"), artist_subset_matches=True, duration_tolerance=10.0, detect_swapped_fields=True,
)
PRESETS = {"standard": STANDARD, "dj_library": DJ, "loose": LOOSE}


def natural_key(name: str) -> list:
    """Case-insensitive order in which runs of digits compare as numbers."""
    import re

    return [(0, int(x), "") if x.isdigit() else (1, 0, x.casefold()) for x in re.findall(r"\d+|\D+", name)]


def save_preset(presets: list[tuple[str, MatchCriteria]], criteria: MatchCriteria, name: str) -> list[tuple[str, MatchCriteria]]:
    """The saved presets with one more, which replaces one of the same name; a blank name changes nothing."""
    if not (name := name.strip()):
        return presets
    return sorted([*(p for p in presets if p[0] != name), (name, criteria)], key=lambda p: natural_key(p[0]))


def recognise_preset(criteria: MatchCriteria, saved: list[tuple[str, MatchCriteria]]) -> str | None:
    """The name of the preset that the criteria equal, built-in ones first."""
    return next((name for name, c in [*PRESETS.items(), *saved] if c == criteria), None)


@dataclass(frozen=True)
class Settings:
    """What a user keeps between sessions; anything that cannot be read has its default."""

    criteria: MatchCriteria = STANDARD
    columns: tuple[str, ...] = ()
    keeper_rules: tuple[tuple[str, str | None], ...] = ()
    presets: tuple[tuple[str, MatchCriteria], ...] = ()
    order: tuple[str, bool] = ("confidence", True)
    minimum_confidence: float = 0.0

    def to_json(self) -> str:
        return json.dumps({
            "criteria": asdict(self.criteria), "columns": self.columns, "keeperRules": self.keeper_rules, "presets": [[n, asdict(c)] for n, c in self.presets],
            "order": order_text(*self.order), "minimumConfidence": self.minimum_confidence,
        }, sort_keys=True, indent=2)

    @staticmethod
    def from_json(text: str | None) -> Settings:
        from .functions.display import DEFAULT_COLUMNS, parse_column
        from .operators.keepers import DEFAULT_RULES

        def part(name, read, otherwise):
            try:
                return read(raw[name])
            except (KeyError, TypeError, ValueError):
                return otherwise

        try:
            raw = json.loads(text or "")
        except ValueError:
            raw = {}
        criteria = lambda c: MatchCriteria.from_json(json.dumps(c))
        return Settings(
            part("criteria", criteria, STANDARD), part("columns", lambda x: tuple(c for c in map(parse_column, x) if c), DEFAULT_COLUMNS),
            part("keeperRules", lambda x: tuple((k, a) for k, a in x), tuple((r.kind, r.argument) for r in DEFAULT_RULES)), part("presets", lambda x: tuple((n, criteria(c)) for n, c in x), ()),
            part("order", parse_order, ("confidence", True)), part("minimumConfidence", float, 0.0),
        )


def order_text(order: str, ascending: bool = True) -> str:
    """``confidence``, ``copies`` or ``column:<id>:ascending`` or ``:descending``."""
    return order if order in ("confidence", "copies") else f"column:{order}:{'ascending' if ascending else 'descending'}"


def parse_order(text: str) -> tuple[str, bool]:
    """(order, ascending) of such a text; anything else is the order by confidence."""
    from .functions.display import parse_column

    if text == "copies":
        return text, True
    kind, _, rest = text.partition(":")
    column, colon, direction = rest.rpartition(":")
    return (column, direction == "ascending") if kind == "column" and colon and parse_column(column) else ("confidence", True)
