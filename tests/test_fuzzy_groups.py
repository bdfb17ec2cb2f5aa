"""Groups of fuzzy matches whose links stay implied equal those of a plain model, whole blocks compared."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from kindred.operators import engine, fuzzy_groups
from kindred.options import LOOSE, FieldRule
from kindred.storage import materialise

from . import model
from .test_match import library

PLAIN = replace(LOOSE, detect_swapped_fields=False)
CASES = {
    "loose": LOOSE, "plain": PLAIN, "any duration": replace(PLAIN, duration_tolerance=None), "similar": replace(PLAIN, title=FieldRule("similar", 0.6), artist=FieldRule("similar", 0.5), duration_tolerance=1.5),
    "exact duration": replace(LOOSE, duration_tolerance=0.0),
}


@pytest.mark.parametrize("name", CASES)
def test_groups_of_implied_links_equal_the_model(spark, name):
    criteria = CASES[name]
    some = library(spark, len(name), 60)
    tracks = materialise(some.union(some.filter("id % 3 = 0").withColumn("id", F.col("id") + 100)).union(some.filter("id % 9 = 0").withColumn("id", F.col("id") + 200)))
    prepared = materialise(engine.prepare(tracks, criteria))
    assert fuzzy_groups.applies(criteria, None) and fuzzy_groups.members(prepared, criteria) is not None
    got = [(list(g.track_ids), round(g.confidence, 9), list(g.reasons)) for g in engine.grouped(prepared, criteria, None).orderBy("id").collect()]
    assert got == model.groups([r.asDict(recursive=True) for r in prepared.collect()], criteria, 10**9) and got


def test_copies_of_a_track_are_one_cell(spark):
    some = library(spark, 2, 30).filter("title <> ''").withColumn("artist", F.lit("P"))
    tracks = some.crossJoin(spark.range(50).withColumnRenamed("id", "k")).withColumn("id", F.col("id") * 50 + F.col("k")).drop("k")
    prepared = materialise(engine.prepare(tracks, PLAIN))
    found, of = fuzzy_groups.members(prepared, PLAIN)
    assert of.select("rep").distinct().count() <= 33 and of.count() > 1000
    assert found.count() <= 33
