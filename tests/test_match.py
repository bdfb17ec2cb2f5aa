import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kindred.operators import blocking, engine, grouping, incremental
from kindred.operators.components import components
from kindred.options import AGGRESSIVE, DJ, DJ_LIBRARY, LOOSE, STANDARD, ExtraFieldRule, FieldRule, MatchCriteria, recognise_preset, save_preset
from kindred.schema import conform
from kindred.storage import materialise

from . import model


def library(spark, seed, n=70):
    rng = random.Random(seed)
    words = ["sun", "sunn", "moon", "star", "stars", "blue"]
    rows = []
    for i in range(n):
        title = " ".join(rng.choice(words) for _ in range(rng.randint(0, 3))) + rng.choice(["", "", " (Original Mix)", " feat. Q", " - Live", " [Part 2]"])
        artist = rng.choice(["P", "P & Q", "The P", "Q ft. R", "", "sun", "moon star"])
        if rng.random() < 0.15:
            title, artist = artist, title
        rows.append((i, title, artist, rng.choice(["x", "X", "y"]), rng.choice([None, 1, 2]), rng.choice([None, 100.0, 101.5, 103.0, 109.0]), rng.choice(["mp3", "flac"]), rng.choice([None, 1999, 2000])))
    planted = [("blue star (Original Mix)", "x"), ("blue star", "y"), ("blue star", "X")]  # one group or more for every case
    rows += [(n + k, title, "P & Q", album, 1, 100.0, "mp3", 1999) for k, (title, album) in enumerate(planted)]
    return conform(spark.createDataFrame(rows, "id long, title string, artist string, album string, track_number int, duration double, format string, year int")).repartition(3)


CASES = {
    "standard": STANDARD, "dj": DJ, "loose": LOOSE, "components": replace(LOOSE, require_anchor_match=False),
    "constraints": MatchCriteria(track_number="same", album="different", format="same", normalisation=DJ_LIBRARY, duration_tolerance=None),
    "identical": MatchCriteria(title=FieldRule("identical"), artist=FieldRule("identical"), duration_tolerance=0.0),
    "artist only": MatchCriteria(title=FieldRule("ignore"), artist=FieldRule("same"), artist_subset_matches=True, normalisation=DJ_LIBRARY, detect_swapped_fields=True),
    "title only": MatchCriteria(title=FieldRule("fuzzy"), artist=FieldRule("ignore"), normalisation=AGGRESSIVE), "artist words": MatchCriteria(title=FieldRule("ignore"), artist=FieldRule("fuzzy", 0.7)),
}


@pytest.mark.parametrize("name", CASES)
def test_groups_equal_the_model(spark, name):
    criteria = CASES[name]
    for cap in (400, 4):
        tracks = library(spark, len(name))
        rows = [r.asDict(recursive=True) for r in engine.prepare(tracks, criteria).collect()]
        got = [(g.track_ids, round(g.confidence, 9), g.reasons) for g in engine.match(tracks, criteria, cap).orderBy("id").collect()]
        assert got == model.groups(rows, criteria, cap)
        if cap == 400:
            assert got


@pytest.mark.parametrize("options", [STANDARD.normalisation, DJ_LIBRARY])
def test_equivalence_shortcut_equals_the_general_path(spark, options):
    criteria = MatchCriteria(normalisation=options, duration_tolerance=None, album="same")
    assert engine.is_equivalence(criteria) and not engine.is_equivalence(STANDARD)
    tracks = library(spark, 5)
    fast, slow = (sorted((g.id, g.track_ids, g.confidence, g.reasons) for g in engine.match(tracks, criteria, cap).collect()) for cap in (None, 400))
    assert fast == slow and fast


def test_nothing_compared_matches_nothing(spark):
    assert engine.match(library(spark, 1), MatchCriteria(title=FieldRule("ignore"), artist=FieldRule("ignore"))).count() == 0
    assert engine.match(library(spark, 1).limit(0), STANDARD).count() == 0


def test_extra_fields_and_single_pairs(spark):
    a = {"title": "Tune", "artist": "P", "album": "One", "year": 1999, "duration": 100.0}
    criteria = MatchCriteria(extra_fields=(ExtraFieldRule("year", FieldRule("same")), ExtraFieldRule("album", FieldRule("similar", 0.6))))
    score, reasons = engine.match_pair(spark, a, {**a, "album": "Ond", "duration": 103.0}, criteria)
    assert score == pytest.approx((0.5 + 0.35 + 0.15 * 0.5 + 0.1 + 0.1 * 2 / 3) / 1.2) and reasons == ["sameTitle", "sameArtist", "durationWithinTolerance", "extraFieldsMatched"]
    assert engine.match_pair(spark, a, {**a, "year": None}, criteria) is None
    assert engine.match_pair(spark, a, {**a, "duration": 103.1}, STANDARD) is None


def test_large_components_split_like_small_ones(spark):
    rng = random.Random(9)
    links = sorted({tuple(sorted(rng.sample(range(120), 2))) for _ in range(260)})
    edges = spark.createDataFrame([(i, j, 1.0, [1]) for i, j in links], "i long, j long, score double, reasons array<int>")
    small, large = (sorted(map(tuple, grouping.anchored_members(edges, small=limit).collect())) for limit in (10**6, 0))
    assert small == large and small
    assert {r.node: r.component for r in components(spark.createDataFrame([(i, i + 1) for i in range(150)], "a long, b long")).collect()} == {i: 0 for i in range(151)}


@pytest.mark.parametrize("name", ["standard", "dj"])
def test_kept_matching_equals_a_full_match(spark, name):
    criteria = CASES[name]
    tracks = materialise(library(spark, 8, 90))
    flat = lambda out: [(g.track_ids, round(g.confidence, 9), g.reasons) for g in out.orderBy("id").collect()]
    full = lambda rows: flat(engine.match(rows, criteria, None))
    kept = incremental.build(tracks.filter("id < 80"), criteria)
    assert flat(incremental.groups_of(kept)) == full(tracks.filter("id < 80"))
    kept = incremental.remove(kept, tracks.filter("id % 3 = 0 AND id < 80"))
    kept = incremental.restore(kept, tracks.filter("id % 6 = 0"))
    assert flat(incremental.groups_of(kept)) == full(tracks.filter("id < 80 AND id % 6 <> 3"))
    kept = incremental.add(kept, tracks.filter("id >= 80"))
    assert flat(incremental.groups_of(kept)) == full(tracks.filter("id % 6 <> 3 OR id >= 80"))
    kept = incremental.restore(kept, tracks)
    assert flat(incremental.groups_of(kept)) == full(tracks)


def test_a_change_reads_the_folders_that_it_touches(spark):
    kept = incremental.build(conform(spark.range(2000).selectExpr("id", "concat('t', id div 2) AS title", "'a' AS artist")), STANDARD)
    some = incremental._of(kept.links, "component", spark.createDataFrame([(10,)], "component long"))
    plan = some._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [" in plan and plan.split("PartitionFilters: [")[1].split("]")[0].strip() and some.count() == 1


def test_kept_matching_keeps_no_link_per_pair_of_copies(spark):
    """Copies are one class with one link to itself, through removals of its lowest track and additions too."""
    copied = conform(spark.range(300).selectExpr("id", "concat('t', id % 3) AS title", "'a' AS artist"))
    kept = incremental.build(copied.filter("id < 200"), STANDARD)
    kept = incremental.add(incremental.remove(kept, copied.filter("id = 0")), copied.filter("id >= 200"))
    assert kept.links.count() == 3
    assert [len(g.track_ids) for g in incremental.groups_of(kept).orderBy("id").collect()] == [99, 100, 100]
    assert [(g.track_ids, g.confidence) for g in incremental.groups_of(kept).orderBy("id").collect()] == [(g.track_ids, g.confidence) for g in engine.match(copied.filter("id > 0"), STANDARD, None).orderBy("id").collect()]


def plain_stars(links, weight):
    """The sequential split of nodes that stand for several, each copy written out."""
    near = {}
    for i, j in links:
        for x, y in ((i, j), (j, i)):
            near.setdefault(x, set()).add(y)
    left, out = set(near), []
    while left:
        anchor = min(left, key=lambda n: (-sum(weight.get(m, 1) for m in near[n] & left) - weight.get(n, 1) + 1, n))
        members = sorted(near[anchor] & left)
        left -= {anchor, *members}
        out += [(anchor, m) for m in [anchor, *members]] if members else []
    return sorted(out)


def test_queue_split_equals_the_plain_one():
    for seed in range(60):
        rng = random.Random(seed)
        links = [tuple(sorted(rng.sample(range(30), 2))) for _ in range(rng.randint(0, 90))]
        weight = {n: rng.randint(2, 9) for n in rng.sample(range(30), rng.choice([0, 5, 20]))}
        assert sorted(grouping.greedy_stars(links, weight)) == plain_stars(links, weight)
    chain = [(i, i + 1) for i in range(200_000)]
    assert grouping.greedy_stars(chain)[:6] == [(1, 1), (1, 0), (1, 2), (4, 4), (4, 3), (4, 5)]


def test_chain_in_order(spark):
    """200,000 links whose ids are in order: contracted where they lie and split in one task."""
    n = 200_000
    edges = spark.range(n).selectExpr("id AS i", "id + 1 AS j", "1.0D AS score", "array(1) AS reasons")
    found = components(edges.selectExpr("i AS a", "j AS b"))
    assert found.filter("component <> 0").isEmpty() and found.count() == n + 1
    sizes = {(r.anchor % 3, r["count"]) for r in grouping.anchored_members(edges).groupBy("anchor").count().collect()}
    assert sizes == {(1, 3)} or sizes == {(1, 3), (1, 2)}


@pytest.mark.parametrize("name", ["standard", "dj", "loose", "artist only", "title only", "constraints", "identical"])
def test_large_cells_dealt_in_blocks(spark, name):
    criteria = CASES[name]
    prepared = materialise(engine.prepare(library(spark, 3), criteria))
    whole, dealt = (sorted(map(tuple, blocking.candidate_pairs(prepared, criteria, 400, block).distinct().collect())) for block in (10**6, 3))
    assert whole == dealt and whole
    once = blocking.candidate_pairs(prepared, criteria, 400, 3).groupBy("i", "j").count().filter("count > 1 OR i >= j")
    assert once.isEmpty()
    kept = {tuple(r)[:2] for r in engine.edges(prepared, criteria).collect()}
    assert kept <= set(whole)


@pytest.mark.parametrize("name", ["standard", "constraints", "artist only", "extra"])
def test_links_of_classes_stand_for_all_links(spark, name):
    """With copies in the library, the links of classes, written out, are the links of tracks; copies of one track add none."""
    criteria = {**CASES, "extra": MatchCriteria(duration_tolerance=None, extra_fields=(ExtraFieldRule("year", FieldRule("similar", 0.7)),))}[name]
    some = library(spark, 4, 40)
    tracks = some.union(some.filter("id % 3 = 0").withColumn("id", F.col("id") + 100)).union(some.filter("id % 9 = 0").withColumn("id", F.col("id") + 200))
    for cap in (400, 4):
        prepared = materialise(engine.prepare(tracks, criteria))
        want = {(r.i, r.j): (round(r.score, 9), tuple(r.reasons)) for r in engine.edges(prepared, criteria, cap).collect()}
        links, of = (x.collect() for x in engine.class_edges(prepared, criteria, cap))
        members = {}
        for r in of:
            members.setdefault(r.rep, []).append(r.idx)
        got = {(x, y): (round(r.score, 9), tuple(r.reasons)) for r in links for x in members[r.i] for y in members[r.j] if x < y}
        assert got == want and want and len(of) == tracks.count() and all(min(m) == k for k, m in members.items())
    many = conform(spark.range(3000).selectExpr("id", "'t' AS title", "'a' AS artist", "id % 2 * 1.0D AS duration"))
    links, _ = engine.class_edges(materialise(engine.prepare(many, STANDARD)), STANDARD)
    assert sorted((r.i, r.j) for r in links.collect()) == [(0, 0), (0, 1), (1, 0), (1, 1)]  # not 4,498,500


def test_pairs_are_found_and_compared_without_python(spark):
    prepared = materialise(engine.prepare(library(spark, 2, 20), LOOSE))
    plan = engine.edges(prepared, LOOSE)._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("extended"))
    assert not any(word in plan for word in ("ArrowEvalPython", "BatchEvalPython", "MapInArrow", "MapInPandas", "pythonUDF"))


def test_a_third_of_all_rows_in_one_cell(spark):
    """One title on a third of the tracks: units of its pairs are dealt evenly, and copies of one track form no pairs."""
    rows = [(i, "Intro" if i % 3 == 0 else f"t {i}", f"a{i % 7}", float(i % 900)) for i in range(6000)]
    tracks = conform(spark.createDataFrame(rows, "id long, title string, artist string, duration double"))
    criteria = MatchCriteria(artist=FieldRule("similar"), duration_tolerance=3.0)
    prepared = materialise(engine.prepare(tracks, criteria))
    units = engine.edges(prepared, criteria, None)
    assert units.count() == sum(abs(a[3] - b[3]) <= 3.0 and a[2] == b[2] for k, a in enumerate(r for r in rows if r[1] == "Intro") for b in [r for r in rows if r[1] == "Intro"][k + 1 :])
    same = conform(spark.range(30_000).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'Intro' ELSE concat('t ', id) END AS title", "'a' AS artist", "10.0D AS duration"))
    ready = materialise(engine.prepare(same, STANDARD))
    rows, of, classes = engine.copies(ready, STANDARD)
    assert rows.count() == 20_001 and of.count() == 10_000 == classes.first().weight
    assert engine.edges(rows, STANDARD).isEmpty()
    group = engine.match(same, STANDARD).collect()
    assert len(group) == 1 and list(group[0].track_ids) == list(range(0, 30_000, 3)) and group[0].confidence == 1.0 and group[0].reasons == ["sameTitle", "sameArtist", "durationWithinTolerance"]


def test_number_rows_is_global(spark):
    out = grouping.number_rows(spark.range(1000).repartition(7), [F.col("id").desc()], "n").collect()
    assert sorted((r.n, r.id) for r in out) == [(i, 999 - i) for i in range(1000)]


def test_criteria_round_trip_and_presets():
    criteria = replace(LOOSE, extra_fields=(ExtraFieldRule("genre", FieldRule("similar")),))
    assert MatchCriteria.from_json(criteria.to_json()) == criteria and MatchCriteria.from_json("{") == STANDARD
    saved = save_preset(save_preset(save_preset([], criteria, " set 10 "), STANDARD, "set 9"), LOOSE, "  ")
    assert [n for n, _ in saved] == ["set 9", "set 10"] and recognise_preset(criteria, saved) == "set 10" and recognise_preset(LOOSE, saved) == "loose"
    assert recognise_preset(replace(LOOSE, album="same"), saved) is None and blocking.strategy(LOOSE) == "title words"
