"""Groups of fuzzy matches without a link per pair of tracks.

Whether two tracks match depends on the pair of their titles, the pair of their artists and how far their durations lie apart. Where few texts stand for many tracks, the pairs of texts are compared once
and the links stay implied: tracks of one title, artist and duration are a cell, and a component of cells is split by counting over ranges of durations. What is written grows with the tracks and the
different pairs of texts, not with the links.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import similarity as S
from ..options import MatchCriteria
from ..storage import materialise
from . import blocking, compare, grouping
from .components import components

#: At most so many different titles, and artists, are compared all with all; beyond, links are formed by pairs of tracks.
TEXTS = 2000
#: A component of at most so many cells is split in one task; beyond, links are formed.
CELLS = 2_000_000


def applies(criteria: MatchCriteria, max_bucket: int | None) -> bool:
    return (
        max_bucket is None and criteria.require_anchor_match and blocking.strategy(criteria) == "title words" and criteria.artist.level in ("similar", "fuzzy")
        and not criteria.extra_fields and (criteria.track_number, criteria.album, criteria.format) == ("any",) * 3
    )


def _numbered(texts: DataFrame, name: str) -> DataFrame:
    return materialise(grouping.number_rows(texts, [name], "number"))


def _titles_alike(tracks: DataFrame, titles: DataFrame, criteria: MatchCriteria) -> DataFrame:
    """``p, q, score, reason`` of titles (by number) of an earlier track and a later one, in its own or its swapped view, where some such tracks share a block key."""
    keyed = tracks.select("tn", "ts", F.explode(F.split("keys", " ")).alias("key"))
    own = materialise(keyed.select("tn", "key").distinct())
    other = own.select(F.col("tn").alias("q"), "key").union(keyed.select("ts", "key").distinct()).distinct() if criteria.detect_swapped_fields else own.withColumnRenamed("tn", "q")
    met = materialise(own.withColumnRenamed("tn", "p").join(other, "key").select("p", "q").distinct())
    outlined = materialise(titles.filter("title <> ''").select("number", "title", S.outline(F.col("title")).alias("o")))
    side = lambda n, x: outlined.select(F.col("number").alias(n), F.col("title").alias(x), F.col("o").alias(f"o{x}"))
    both = met.join(side("p", "x"), "p").join(side("q", "y"), "q").filter(S.may_reach(F.col("ox"), F.col("oy"), criteria.title.level, criteria.title.threshold))
    return _rated(both, compare.compare_text(criteria.title, (F.col("x"), F.col("y")), (F.col("x"), F.col("y")), False, (0, 1, 2, 3)))


def _artists_alike(first: DataFrame, second: DataFrame, criteria: MatchCriteria) -> DataFrame:
    """``p, q, score, reason`` of artists by number."""
    joined = F.array_join("artist", " & ")
    outlined = lambda a: materialise(a.select("number", F.struct(F.col("artist").alias("primary"), joined.alias("artist")).alias("v"), S.outline(joined).alias("o")))
    side = lambda a, n, x: outlined(a).select(F.col("number").alias(n), F.col("v").alias(x), F.col("o").alias(f"o{x}"))
    a, b = F.col("x"), F.col("y")
    may = S.may_reach(F.col("ox"), F.col("oy"), criteria.artist.level, criteria.artist.threshold)
    if criteria.artist_subset_matches:
        may |= (F.size(F.array_except(a["primary"], b["primary"])) == 0) | (F.size(F.array_except(b["primary"], a["primary"])) == 0)
    return _rated(side(first, "p", "x").crossJoin(side(second, "q", "y")).filter(may), compare.compare_artists(a, b, criteria))


def _rated(pairs: DataFrame, outcome: Column) -> DataFrame:
    dealt = materialise(pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism))
    return materialise(dealt.select("p", "q", outcome.alias("of")).filter("of IS NOT NULL").select("p", "q", "of.score", "of.reason"))


def _swaps(tracks: DataFrame, alike: DataFrame, own: str, other: str) -> bool:
    """Whether some text of an own view is like one of a swapped view."""
    first, second = tracks.select(F.col(own).alias("p")).distinct(), tracks.select(F.col(other).alias("q")).distinct()
    return not alike.join(first, "p", "left_semi").join(second, "q", "left_semi").isEmpty()


def _own(tracks: DataFrame, alike: DataFrame, own: str) -> DataFrame:
    """The pairs of texts of own views."""
    return materialise(alike.join(tracks.select(F.col(own).alias("q")).distinct(), "q", "left_semi").select("p", "q", "score", "reason"))


def _one_sided(alike: DataFrame) -> bool:
    """Whether some pair of texts is rated otherwise the other way round."""
    turned = alike.select(F.col("q").alias("p"), F.col("p").alias("q"), "score", "reason")
    return not alike.join(turned, ["p", "q", "score", "reason"], "left_anti").isEmpty()


def _of_parts(tracks: DataFrame, alike: DataFrame, own: str, other: str, swapped: bool, kind: int) -> DataFrame:
    """The pairs of texts that each part of the tracks may need."""
    first = tracks.select("part", F.col(own).alias("p")).distinct()
    second = first.select("part", F.col("p").alias("q")).union(tracks.select("part", F.col(other).alias("q"))).distinct() if swapped else first.select("part", F.col("p").alias("q"))
    return first.join(alike, "p").join(second, ["part", "q"]).select("part", F.lit(kind).alias("kind"), "p", "q", "score", "reason")


def members(prepared: DataFrame, criteria: MatchCriteria) -> tuple[DataFrame, DataFrame] | None:
    """(``anchor, idx, confidence, reasons`` of cells, confidence and reasons with the anchor's row alone; ``idx, rep`` of the tracks of cells). None if there are too many texts or cells for it."""
    both = criteria.detect_swapped_fields
    view = lambda v: F.struct(F.col(f"{v}.title").alias("title"), F.col(f"{v}.primary").alias("artist"), (F.size(f"{v}.removed") > 0).alias("cut"), F.to_json(f"{v}.featured").alias("guests"))
    keys = F.array_join(F.array_sort(blocking.all_keys(criteria)), " ")
    rows = materialise(prepared.select("idx", "duration", keys.alias("keys"), view("n").alias("n"), view("s" if both else "n").alias("s")).filter("keys <> ''"))
    distinct = lambda f: rows.select(F.col(f"n.{f}").alias(f)).union(rows.select(F.col(f"s.{f}").alias(f))).distinct() if both else rows.select(F.col(f"n.{f}").alias(f)).distinct()
    titles, artists = (materialise(distinct(f)) for f in ("title", "artist"))
    if titles.count() > TEXTS:
        return None
    titles, artists = _numbered(titles, "title"), _numbered(artists, "artist")
    number = lambda texts, f, v, name: texts.select(F.col(f).alias(f"_{name}"), F.col("number").cast("int").alias(name))
    tracks = rows
    for texts, f, v, name in ((titles, "title", "n", "tn"), (artists, "artist", "n", "an"), (titles, "title", "s", "ts"), (artists, "artist", "s", "as")):
        tracks = tracks.join(number(texts, f, v, name), F.col(f"{v}.{f}") == F.col(f"_{name}")).drop(f"_{name}")
    tracks = materialise(tracks.select("idx", "duration", "keys", "tn", "an", "ts", F.col("as").alias("sa"), F.col("n.cut").alias("cut"), F.col("n.guests").alias("guests"), F.col("s.cut").alias("scut"), F.col("s.guests").alias("sguests")))

    title_pairs = _titles_alike(tracks, titles, criteria)
    swapped = both and _swaps(tracks, title_pairs, "tn", "ts")
    first = tracks.select(F.col("an").alias("number")).distinct()
    second = first.union(tracks.select("sa")).distinct() if swapped else first
    if second.count() > TEXTS:
        return None
    artist_pairs = _artists_alike(artists.join(first, "number", "left_semi"), artists.join(second, "number", "left_semi"), criteria)
    swapped = swapped and _swaps(tracks, artist_pairs, "an", "sa")
    if not swapped:
        title_pairs, artist_pairs = _own(tracks, title_pairs, "tn"), _own(tracks, artist_pairs, "an")
    alone = swapped or _one_sided(title_pairs) or _one_sided(artist_pairs)  # the order of a pair counts, so that copies need not match others alike
    if not swapped:  # an empty title matches none
        tracks = tracks.join(titles.filter("title <> ''").select(F.col("number").cast("int").alias("tn")), "tn")
    # parts that no link leaves: titles that are linked, and runs of durations without a gap
    links = title_pairs.filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b"))
    links = links.union(tracks.filter("tn <> ts").select(F.col("tn").cast("long"), F.col("ts").cast("long")).distinct()) if swapped else links
    linked = materialise(components(links.select(F.col("a").cast("long"), F.col("b").cast("long"))))
    tracks = tracks.join(F.broadcast(linked.withColumnRenamed("node", "tn")), "tn", "left").withColumn("titles", F.coalesce("component", F.col("tn").cast("long"))).drop("component")
    if criteria.duration_tolerance is None:
        tracks = tracks.withColumn("run", F.lit(0).cast("long"))
    else:
        order = Window.partitionBy("titles").orderBy(F.col("duration").asc_nulls_first())
        known = tracks.select("titles", "duration").distinct()
        gap = (F.col("duration") - F.lag("duration").over(order) > criteria.duration_tolerance).cast("long")
        unbounded = F.max(F.col("duration").isNull()).over(Window.partitionBy("titles"))
        runs = materialise(known.withColumn("new", F.coalesce(gap, F.lit(0))).select("titles", "duration", F.when(unbounded, 0).otherwise(F.sum("new").over(order)).cast("long").alias("run")))
        tracks = tracks.alias("t").join(runs.alias("r"), F.col("t.titles").eqNullSafe(F.col("r.titles")) & F.col("t.duration").eqNullSafe(F.col("r.duration"))).select("t.*", "r.run")
    tracks = materialise(tracks.withColumn("part", F.struct("titles", "run")))
    cell = ["part", "tn", "an", "ts", "sa", "keys", "duration"] if swapped else ["part", "tn", "an", "keys", "duration"]
    cell += ["idx"] if alone else []
    named = [F.first(c).alias(c) for c in ("ts", "sa", "scut", "sguests") if c not in cell]
    cells = tracks.select("*", F.col("idx").alias("at")).groupBy(*cell).agg(
        F.min("at").alias("rep"), F.count("*").alias("weight"), F.max("cut").alias("any_cut"), F.min("guests").alias("least"), F.max("guests").alias("most"), *named,
    )
    cells = materialise(cells.select("part", "rep", "weight", "duration", "keys", "tn", "an", "ts", "sa", "any_cut", "least", "most", "scut", "sguests"))
    if not cells.groupBy("part").count().filter(F.col("count") > CELLS).isEmpty():
        return None
    pairs = materialise(_of_parts(cells, title_pairs, "tn", "ts", swapped, 0).union(_of_parts(cells, artist_pairs, "an", "sa", swapped, 1)))
    split = _splitter(criteria.duration_tolerance, swapped, alone, criteria.normalisation.separate_featured_artists)
    found = materialise(cells.groupBy("part").cogroup(pairs.groupBy("part")).applyInPandas(split, "anchor long, idx long, confidence double, reasons array<int>"))
    of = tracks.select("idx", F.col("idx").alias("rep")) if alone else tracks.alias("t").join(cells.alias("c"), [F.col(f"t.{c}").eqNullSafe(F.col(f"c.{c}")) for c in cell]).select("t.idx", "c.rep")
    return found, materialise(of)


def _splitter(tolerance: float | None, swapped: bool, alone: bool, guests: bool):
    def split(cells: pd.DataFrame, pairs: pd.DataFrame) -> pd.DataFrame:
        stars = Cells(cells, pairs, tolerance, swapped, alone, guests).stars() if len(cells) else []
        out = [(anchor, idx, *(score if idx == anchor else (None, None))) for anchor, taken, score in stars for idx in taken]
        return pd.DataFrame(out, columns=["anchor", "idx", "confidence", "reasons"])

    return split


class Cells:
    """A component of cells in the order of their durations, those without one last."""

    def __init__(self, cells: pd.DataFrame, pairs: pd.DataFrame, tolerance: float | None, swapped: bool, alone: bool, guests: bool):
        if tolerance is None:
            cells = cells.assign(duration=np.nan)
        cells = cells.sort_values(["duration", "rep"], na_position="last")
        self.tolerance, self.swapped, self.alone, self.guests = tolerance, swapped, alone, guests
        self.rep, self.weight = cells["rep"].to_numpy(np.int64), cells["weight"].to_numpy(np.int64)
        self.n, self.d = len(cells), cells["duration"].to_numpy(float)
        self.known = int(np.count_nonzero(~np.isnan(self.d)))
        (self.tn, self.ts), (self.title, self.title_score, self.title_reason) = _matrix(cells["tn"], cells["ts"], pairs[pairs["kind"] == 0])
        (self.an, self.sa), (self.artist, self.artist_score, self.artist_reason) = _matrix(cells["an"], cells["sa"], pairs[pairs["kind"] == 1])
        self.cut, self.scut = cells["any_cut"].to_numpy(bool), cells["scut"].to_numpy(bool)
        names = pd.factorize(pd.concat([cells["least"], cells["most"], cells["sguests"]]))[0].reshape(3, -1)
        self.least, self.most, self.sguests = names
        self._windows()
        # which cells share a block key: all of them if one key is everywhere
        kind, sets = pd.factorize(cells["keys"])
        words = [s.split(" ") for s in sets]
        holds = pd.Series(np.repeat(np.arange(len(words)), [len(w) for w in words]), index=[x for w in words for x in w])
        self.keys = None
        if holds.index.value_counts().max() < len(words):
            self.keys, self.words, self.holding = kind, words, {k: v.to_numpy() for k, v in holds.groupby(level=0)}

    def _windows(self) -> None:
        """``low, high``: the range of cells with a duration within the tolerance of each one's, exactly."""
        self.low, self.high = np.zeros(self.n, np.int64), np.full(self.n, self.known)
        if self.known:
            own, at = np.unique(self.d[: self.known], return_inverse=True)
            low = np.searchsorted(own, own - self.tolerance)
            high = np.searchsorted(own, own + self.tolerance, "right")
            last = len(own) - 1
            for _ in range(2):  # sums may round across the bound, differences decide
                low = np.where((low > 0) & (own - own[np.maximum(low - 1, 0)] <= self.tolerance), low - 1, low)
                low = np.where(own - own[np.minimum(low, last)] > self.tolerance, low + 1, low)
                high = np.where((high <= last) & (own[np.minimum(high, last)] - own <= self.tolerance), high + 1, high)
                high = np.where(own[high - 1] - own > self.tolerance, high - 1, high)
            first = np.append(np.searchsorted(at, np.arange(len(own))), self.known)
            self.low[: self.known], self.high[: self.known] = first[low][at], first[high][at]

    def _shared(self, x: int) -> np.ndarray | None:
        """By kind of key set: whether it shares a key with that of x."""
        if self.keys is None:
            return None
        out = np.zeros(len(self.words), bool)
        for word in self.words[self.keys[x]]:
            out[self.holding[word]] = True
        return out

    def _views(self, x: int, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the cells ``at``: which match x, in their own views, and with the later one's view swapped, leaving durations aside."""
        later = self.rep[at] > self.rep[x] if self.alone else None
        t, a = self.tn[at], self.an[at]
        own = self.title[self.tn[x], t] & self.artist[self.an[x], a]
        if self.alone:
            own = np.where(later, own, self.title[t, self.tn[x]] & self.artist[a, self.an[x]])
        turned = np.zeros(len(at), bool)
        if self.swapped:
            turned = np.where(later, self.title[self.tn[x], self.ts[at]] & self.artist[self.an[x], self.sa[at]], self.title[t, self.ts[x]] & self.artist[a, self.sa[x]])
        if (shared := self._shared(x)) is not None:
            own, turned = own & shared[self.keys[at]], turned & shared[self.keys[at]]
        return own, turned

    def _near(self, x: int, alive: np.ndarray) -> np.ndarray:
        """The other cells that are left and match x."""
        ranges = [np.arange(self.low[x], self.high[x]), np.arange(self.known, self.n)] if x < self.known else [np.arange(self.n)]
        at = np.concatenate(ranges)
        at = at[alive[at]]
        own, turned = self._views(x, at)
        return at[(own | turned) & (at != x)]

    def _ways(self) -> np.ndarray:
        """Cells of one way match the same cells, durations aside: by the classes of texts that are alike to the same ones, and the key sets."""
        alike = lambda m, used: np.unique(m, axis=0, return_inverse=True)[1].reshape(-1)[used]
        keys = np.zeros(self.n, np.int64) if self.keys is None else self.keys
        return np.unique(np.stack([alike(self.title, self.tn), alike(self.artist, self.an), keys]), axis=1, return_inverse=True)[1].reshape(-1)

    def _sums(self, weight: np.ndarray, at: slice) -> np.ndarray:
        """For the cells ``at``: the sum of the weights of the cells within their reach."""
        total = np.concatenate([[0], np.cumsum(weight)])
        out = total[self.high[at]] - total[self.low[at]] + total[-1] - total[self.known]
        out[np.arange(at.start, at.stop) >= self.known] = total[-1]
        return out

    def stars(self):
        """(anchor, cells taken, (confidence, reasons)) in the order in which they are taken: the cell with the most tracks left that match it, lowest track on ties, takes them."""
        every = np.arange(self.n)
        alive = np.ones(self.n, bool)
        count = self.weight - 1
        if self.alone:
            count = count + np.array([self.weight[self._near(x, alive)].sum() for x in every], np.int64)
        else:
            way = self._ways()
            first = {w: x for x, w in zip(every[::-1], way[::-1], strict=True)}  # some cell of each way
            mask = {}
            for w, x in first.items():
                own = self._views(x, every)[0]
                mask[w] = np.packbits(own)
                mine = way == w
                reach = self._sums(np.where(own, self.weight, 0), slice(0, self.n))
                # a cell of the way counts itself if the way matches itself, and its copies are in its weight already
                count = np.where(mine, count + reach - np.where(own, self.weight, 0), count)
        size = self.n + 1
        rank = np.empty(self.n, np.int64)
        rank[np.argsort(self.rep)] = every
        order = count * size + self.n - rank  # the most neighbours, the lowest track
        while (x := int(np.argmax(order))) >= 0 and order[x] >= size:
            taken = np.concatenate([[x], self._near(x, alive)]).astype(np.int64)
            alive[taken], order[taken] = False, -1
            if self.alone:
                for m in taken:
                    order[self._near(m, alive)] -= self.weight[m] * size
            else:
                for w in np.unique(way[taken]):
                    gone = taken[way[taken] == w]
                    weight = np.zeros(self.n, np.int64)
                    weight[gone] = self.weight[gone]
                    inside = gone.max() < self.known
                    at = slice(int(self.low[gone].min()), int(self.high[gone].max())) if inside else slice(0, self.n)
                    hit = np.unpackbits(mask[w], count=self.n).astype(bool) & alive
                    for part in [at, slice(self.known, self.n)] if inside else [at]:
                        if part.start < part.stop:
                            order[part] -= np.where(hit[part], self._sums(weight, part), 0) * size
            if len(taken) > 1 or self.weight[x] > 1:
                yield int(self.rep[x]), self.rep[taken].tolist(), self._scored(np.sort(taken))

    def _scored(self, star: np.ndarray) -> tuple[float, list[int]]:
        """The mean score of the matching pairs of tracks in a star, and their reasons."""
        code = {name: k for k, name in enumerate(compare.REASONS)}
        total, number, reasons = 0.0, 0, set()
        several = self.weight[star] * (self.weight[star] - 1) // 2  # copies match each other in all
        if several.any():
            inner = star[several > 0]
            total, number = float(several.sum()), int(several.sum())
            reasons |= {code["sameTitle"], code["sameArtist"]} | ({code["durationWithinTolerance"]} if (inner < self.known).any() else set())
            reasons |= {code["versionTextIgnored"]} if self.cut[inner].any() else set()
            reasons |= {code["featuredArtistIgnored"]} if self.guests and (self.least[inner] != self.most[inner]).any() else set()
        seen = np.zeros(len(code), bool)
        for k, x in enumerate(star[:-1]):
            at = star[k + 1 :]
            apart = np.abs(self.d[at] - self.d[x])
            near = np.isnan(apart) | (apart <= (np.inf if self.tolerance is None else self.tolerance))
            at, apart = at[near], apart[near]
            own, turned = self._views(x, at)
            pass_any = own | turned
            if not pass_any.any():
                continue
            at, apart, own, turned = at[pass_any], apart[pass_any], own[pass_any], turned[pass_any]
            ahead = (self.rep[at] > self.rep[x]) if self.alone else np.ones(len(at), bool)
            one, two = np.where(ahead, x, at), np.where(ahead, at, x)  # the earlier and the later one
            weighted = np.where(own, self._weighted(one, two, self.tn, self.an), -1.0)
            use = np.zeros(len(at), bool)
            if self.swapped:
                other = np.where(turned, self._weighted(one, two, self.ts, self.sa), -1.0)
                use = turned & (~own | (other / (compare.TITLE_WEIGHT + compare.ARTIST_WEIGHT) > weighted / (compare.TITLE_WEIGHT + compare.ARTIST_WEIGHT)))
                weighted = np.where(use, other, weighted)
            known = ~np.isnan(apart)
            close = np.where(known, (1 - 0.5 * apart / self.tolerance if self.tolerance else 1.0) * compare.DURATION_WEIGHT, 0.0)
            weights = self.weight[x] * self.weight[at]
            total += float((weights * (weighted + close) / (compare.TITLE_WEIGHT + compare.ARTIST_WEIGHT + np.where(known, compare.DURATION_WEIGHT, 0.0))).sum())
            number += int(weights.sum())
            t, a = np.where(use, self.ts[two], self.tn[two]), np.where(use, self.sa[two], self.an[two])
            seen[self.title_reason[self.tn[one], t]] = True
            seen[self.artist_reason[self.an[one], a]] = True
            seen[code["versionTextIgnored"]] |= bool((self.cut[one] | np.where(use, self.scut[two], self.cut[two])).any())
            if self.guests:
                least, most = np.where(use, self.sguests[two], self.least[two]), np.where(use, self.sguests[two], self.most[two])
                seen[code["featuredArtistIgnored"]] |= bool(((self.least[one] != least) | (self.most[one] != most) | (least != most)).any())
            seen[code["durationWithinTolerance"]] |= bool(known.any())
            seen[code["swappedTitleAndArtist"]] |= bool(use.any())
        return (total / number if number else 0.0), sorted(reasons | set(np.flatnonzero(seen).tolist()))

    def _weighted(self, one: np.ndarray, two: np.ndarray, titles: np.ndarray, artists: np.ndarray) -> np.ndarray:
        return self.title_score[self.tn[one], titles[two]] * compare.TITLE_WEIGHT + self.artist_score[self.an[one], artists[two]] * compare.ARTIST_WEIGHT


def _matrix(own: pd.Series, other: pd.Series, pairs: pd.DataFrame):
    """The texts as places in (alike, score, reason) tables of these texts."""
    texts = np.unique(np.concatenate([own.to_numpy(), other.to_numpy()]))
    place = lambda x: np.searchsorted(texts, x.to_numpy())
    alike, score, reason = np.zeros((len(texts),) * 2, bool), np.zeros((len(texts),) * 2), np.zeros((len(texts),) * 2, np.int8)
    p, q = place(pairs["p"]), place(pairs["q"])
    alike[p, q], score[p, q], reason[p, q] = True, pairs["score"].to_numpy(float), pairs["reason"].to_numpy(np.int8)
    return (place(own), place(other)), (alike, score, reason)
