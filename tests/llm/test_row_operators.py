"""Quality, contamination, mixing and sharding against plain Python, with odd rows."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from kindred.llm import contamination, mixing, quality, sharding
from kindred.storage import materialise

from . import brute

ODD = [
    (None, None, None, None), (None, "no id here at all, really none of them", "en", "a"), (1, "", "en", "a"), (2, " \n\t ", None, "a"), (3, None, "en", None),
    (4, "é ü 漢字 \x0b ends\x0c", "de", ""), (5, "a b c d e f g h i j\n" * 3, "en", "a"), (6, "long words " * 30000, "en", "a"), (7, "#*$% &|<> x" * 9, "en", "b"),
    (8, "The Quick brown fox jumps over the lazy dog and runs away from all of the hounds", "en", "b"),
]


def corpus(seed=3, n=150):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(80)]
    rows = list(ODD)
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(12, 60))]
        if i % 11 == 0:
            words = [w + "%%%" for w in words]
        if i % 13 == 0:
            words += words[:7]
        rows.append((100 + i, "\n".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)), ("en", "de")[i % 2], ("a", "b", "c")[i % 3]))
    return [*rows, rows[20], rows[21], rows[21]]


def frame(spark, rows, extra=True):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    # extra columns with the names that results use
    return docs.withColumns({"size": F.lit("x"), "shard": F.lit(-5), "n": F.lit(1), "g": F.lit(2), "row": F.lit(3)}) if extra else docs


@pytest.mark.parametrize("prior", [50, 5])
def test_quality(spark, monkeypatch, prior):
    monkeypatch.setattr(quality, "PRIOR", prior)
    rows = corpus()
    out = quality.judge(materialise(quality.statistics(frame(spark, rows)))).select("doc_id", "text", "_q_words", "_q_chars", "_q_symbols", "_q_lines", "_q_dup_lines", "_q_repeats", "_q_failed", "_q_kept")
    want = [(d, t, *s, f, k) for (d, t, _, _), (s, f, k) in zip(rows, brute.quality([r[1:] for r in rows], quality))]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert any(f for *_, f, _ in want) and any(not f and not k for *_, f, k in want)
    if prior == 5:
        return
    kept = quality.keep(frame(spark, rows))
    assert kept.columns == frame(spark, rows).columns and kept.count() == sum(k for *_, k in want)
    assert quality.keep(frame(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("bounds", [(2_000_000, 2_000_000), (40, 5)])
def test_contamination(spark, monkeypatch, bounds):
    monkeypatch.setattr(contamination, "MAX_TERMS", bounds[0])
    monkeypatch.setattr(contamination, "MAX_PHRASES", bounds[1])
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    items = [(1, passage), (2, "Short item, here!"), (3, passage.upper()), (4, ""), (5, None), (6, "w1"), (None, "w2 w2 w2"), (2, "w3 w4")]
    texts = [None, "", "nothing of it", "a short-item HERE now", "x w1 y " * 30, "w2 w2 w2 w2 w2", passage, "pre " * 20 + passage, "pre " * 2000 + passage, " ".join(passage.split()[:12]), " ".join(passage.split()[3:17]), "w3 w4 w3 w4"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 200))) for _ in range(60)] + [passage, passage]
    docs = frame(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("phrase", F.lit("clash"))
    plain = docs.select("doc_id", "text")
    index, verdicts = contamination.judge(plain, bench, ["doc_id"])
    got = {r.doc_id: (r._con_n, r._con_hit, r._con_items, r._con_sha, r._con_bad) for r in contamination._verdict(index, verdicts).collect()}
    want = brute.contamination(texts, items)
    assert got == {i: (n, h, len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest(), bad) for i, (n, h, ids, bad) in enumerate(want)}
    assert any("" in ids for _, _, ids, _ in want)
    if bounds == (40, 5):
        assert len(contamination._slices(bench)) > 2
        return
    clean = contamination.remove(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id for r in clean.collect()) == [i for i, w in enumerate(want) if not w[3]]
    assert contamination.remove(docs, bench.limit(0)).count() == len(texts)
    assert contamination.remove(docs.limit(0), bench).count() == 0


def test_mixing(spark):
    rows = corpus()
    out = mixing.copies(frame(spark, rows))
    got = sorted(((r.doc_id, r.source, r._mix_size, r._mix_source_size, round(r._mix_target, 6), r._mix_copies) for r in out.collect()), key=repr)
    want = sorted(((d, s, n, total, round(target, 6), k) for (d, _, _, s), (n, total, target, k) in zip(rows, brute.mixing([(d, t, s) for d, t, _, s in rows]))), key=repr)
    assert got == want
    mixed = mixing.mix(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns and mixed.count() == sum(w[-1] for w in want)
    assert mixing.mix(frame(spark, rows).limit(0)).count() == 0
    assert max(w[-1] for w in want) <= 2
    hot = spark.range(3000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("one of many equal rows").alias("text"), F.lit("a").alias("source"))
    hot = hot.union(spark.range(100, 1100).selectExpr("id", "concat('words of ', id)", "'b'"))
    for r in mixing.copies(hot).groupBy("source").agg(F.sum(F.col("_mix_size") * F.col("_mix_copies")).alias("taken"), F.first("_mix_target").alias("target")).collect():
        assert abs(r.taken - r.target) < 0.05 * r.target


def test_sharding(spark):
    rows = corpus()
    tree = sharding.uniform_tree()
    out = sharding.number(sharding.place(frame(spark, rows))).collect()
    for r in out:
        assert r._shard_shard == brute.shard(r.doc_id, tree) and r._shard_grown == brute.shard(r.doc_id, sharding.grow(tree))
        assert r._shard_size == len((r.text or "").encode()) + 1 and r._shard_crc == brute.crc(r.text)
        assert r._shard_grown in (r._shard_shard, 16)
    by_shard = {}
    for r in out:
        by_shard.setdefault(r._shard_shard, []).append(r._shard_slot)
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assigned = sharding.assign(frame(spark, rows))
    assert assigned.columns == [c for c in frame(spark, rows).columns if c != "shard"] + ["shard", "slot"] and assigned.count() == len(rows)
    assert sharding.assign(frame(spark, rows).limit(0)).count() == 0


def test_weights_move_rows_only_below_what_changed(spark):
    tree = sharding.uniform_tree()
    lighter = tuple(tuple(tuple((s, 0.5 if s == 5 else w) for s, w in rack) for rack in region) for region in tree)
    ids = spark.range(4000)
    both = ids.select(sharding.shard_of(F.col("id"), tree).alias("a"), sharding.shard_of(F.col("id"), lighter).alias("b")).collect()
    region, rack = (lambda s: s // 8), (lambda s: s // 4)
    moved = [(a, b) for a, b in both if a != b]
    for a, b in moved:  # shard 5 in rack 1 in region 0 got lighter: at the level where the paths part, the child that is left is one of these
        assert region(a) == 0 if region(a) != region(b) else rack(a) == 1 if rack(a) != rack(b) else a == 5
    assert not any(b == 5 for _, b in moved) and any(a == 5 for a, _ in moved)
    assert {region(a) for a, _ in both} == {0, 1} and len(moved) < 0.1 * len(both)
    back = [(b, a) for a, b in moved]  # heavier again: the same rows come back
    assert all(region(b) == 0 if region(a) != region(b) else rack(b) == 1 if rack(a) != rack(b) else b == 5 for a, b in back)


def test_proximity(spark):
    rows = [(1, 0, 5), (1, 3, 6), (1, 9, 7), (2, 0, 5), (2, 1, 7), (2, 2, 6), (3, 4, 5), (3, 5, 5), (3, 6, 6)]
    postings = spark.createDataFrame(rows, "row long, pos int, term int")
    near = lambda terms, width: sorted(map(tuple, contamination.proximity(postings, terms, width).collect()))
    assert near([5, 6, 7], 3) == [(2, 0)] and near([5, 6, 7], 10) == [(1, 0), (2, 0)] and near([5, 6], 2) == [(3, 5)]


def test_each_statistic_rejects_alone(spark):
    rng = random.Random(8)
    word = lambda low=2, high=9: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(low, high)))
    lines = lambda n, *size: [" ".join(word(*size) for _ in range(9)) for _ in range(n)]
    rows = [(i, "\n".join(lines(rng.randint(8, 16))), "en", "a") for i in range(120)]
    again = lines(1)[0]
    planted = [
        (200, "\n".join(lines(2000)), "en", "a"),
        (201, "\n".join(lines(12, 25, 30)), "en", "a"),
        (202, "\n".join(lines(12)).replace("a", "#").replace("b", "%").replace("c", "|").replace("d", "#"), "en", "a"),
        (203, "\n".join(x for line in lines(12) for x in (line, "see more here")), "en", "a"),
        (204, "\n".join([f"first {again}", *lines(8), f"second {again}"]), "en", "a"),
    ]
    got = {r.doc_id: r for r in quality.judge(materialise(quality.statistics(frame(spark, rows + planted, False)))).collect()}
    assert not any(got[i]._q_failed for i, *_ in rows + planted)
    assert [i for i, *_ in planted if got[i]._q_kept] == []
    assert sum(got[i]._q_kept for i, *_ in rows) >= 0.97 * len(rows)
    assert got[204]._q_repeats == 18 and got[204]._q_dup_lines == 0 and got[203]._q_repeats == 0


@pytest.mark.parametrize("most", [2_000_000, 2])
def test_near_phrases(spark, monkeypatch, most):
    monkeypatch.setattr(contamination, "MAX_PHRASES", most)
    rng = random.Random(12)
    words = [f"w{i}" for i in range(24)]
    items = [(1, " ".join(words[:15])), (2, "w3 w9 w3"), (3, ""), (4, "w20")]
    spread = " ".join(f"{w} other" if i % 3 == 0 else w for i, w in enumerate(words[:13]))
    texts = [None, "", spread, " ".join(words[12::-1]), " ".join(f"{w} x y" for w in words[:13]), "w3 w9", "w9 " + "x " * 25 + "w3", "w9 " + "x " * 24 + "w3"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 120))) for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: (r.n_words, r.n_near, r.n_near_items) for r in contamination.near(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    phrases = [(i, frozenset(w[k : k + 13])) for i, t in items for w in [t.split()] for k in range(max(len(w) - 12, 1 if w else 0))]
    for i, t in enumerate(texts):
        w = (t or "").split()
        hit = [(item, k) for k, (item, p) in enumerate(phrases) if any(p <= set(w[s : s + 26]) for s in range(len(w)))]
        assert got[i] == (len(w), len(hit), len({item for item, _ in hit})), (i, t)
    assert got[2][1] == got[3][1] >= 1 and got[4][1] == 1 and got[6][1] == 0 and got[7][1] == 1
