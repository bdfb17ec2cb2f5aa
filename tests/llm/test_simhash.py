import itertools
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from kindred.llm import simhash
from kindred.operators.components import components


def brute_fingerprint(text):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows):
    """rows of (id, fingerprint) -> id of each row's component."""
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 4:
            parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_anchors_are_a_perfect_covering():
    table = simhash.anchors()
    assert (table.home >= 0).all()
    distance = np.bitwise_count((np.arange(1 << 23) ^ table.home).astype(np.uint32))
    assert distance.max() == simhash.RADIUS
    point = np.uint64(0x12345)
    index, cell, home = simhash.visits(np.array([point], dtype=np.uint64))
    words = simhash.golay_words()
    want = {int(w) for w in words if (int(w) ^ (0x12345 & ((1 << 22) - 1))).bit_count() <= 4}
    assert {int(c) & ((1 << 23) - 1) for c in cell[cell >> 23 == 0]} == want
    assert home.sum() == 3


def test_every_pair_within_four_bits_meets():
    rng = random.Random(1)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 4)):
            b ^= 1 << bit
        (_, ca, ha), (_, cb, hb) = (simhash.visits(np.array([x], dtype=np.uint64)) for x in (a, b))
        assert set(ca[ha]) & set(cb) and set(cb[hb]) & set(ca)


def test_fingerprints_and_components_match_brute_force(spark, monkeypatch):
    rng = random.Random(7)
    vocabulary = [f"w{i}é" for i in range(400)]
    texts = []
    for _ in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(1, 200))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 3)):
            copy = list(words)
            copy[rng.randrange(len(copy))] = "CHANGED"
            texts.append("\t".join(copy).upper())
    texts += [None, "", "  \n", "a", "A", "long " * 70000, texts[0], texts[0]]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, texts[5]), (None, "alone without id")]
    for chunk in (4096, 3):
        monkeypatch.setattr(simhash, "CHUNK", chunk)
        docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("fingerprint", F.lit("clash"))
        got = sorted(map(tuple, simhash.assign(docs).collect()), key=repr)
        fps = [brute_fingerprint(t) for _, t in rows]
        ids = brute_components([(d, f) for (d, _), f in zip(rows, fps, strict=True)])
        want = sorted([(d, f"{f:016x}", c) for (d, _), f, c in zip(rows, fps, ids, strict=True)], key=repr)
        assert got == want


def test_deduplicate_keeps_one_of_each(spark):
    rows = [(5, "one two three four five", "x"), (2, "one two three four five", "y"), (2, "one two three four five", "z"), (9, "something else is here now", "x"), (7, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string")
    out = simhash.deduplicate(docs)
    assert out.columns == docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [2, 7, 9]
    assert simhash.deduplicate(docs.limit(0)).count() == 0
    assert simhash.assign(docs.limit(0)).count() == 0


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{i: 0 for i in range(201)}, 500: 500, 501: 500}
