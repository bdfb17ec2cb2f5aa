"""The pipeline against the composition of the plain versions, and the registry's guard."""

import random

import corpus_pipeline
from kindred.llm import quality, sharding

from . import brute


def test_pipeline(spark, tmp_path):
    rng = random.Random(8)
    words = [f"{a}{b}" for a in ("ka", "ko", "tu", "mel") for b in ("ra", "sin", "t", "", "obe")]
    passage = " ".join(rng.choice(words) for _ in range(30))
    rows = []
    for i in range(160):
        text = " ".join(rng.choice(words) + rng.choice(["", "e", "x"]) for _ in range(rng.randint(11, 90)))
        if i % 10 == 3:
            text = rows[-1][1]
        if i % 17 == 5:
            text = text[: len(text) // 3] + " " + passage
        if i % 19 == 7:
            text = " ".join(w + "###" for w in text.split())
        rows.append((i, text, ("en", "de")[i % 2], ("a", "b", None)[i % 3], len(text)))
    rows += [(500, None, None, None, 0), (501, "", "en", "a", 0), (502, "few words", "en", "a", 9), (rows[12][0] + 1000, *rows[12][1:])]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    items = [(1, passage), (2, " ".join(words))]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = [r for r, (_, _, k) in zip(rows, brute.quality([r[1:4] for r in rows], quality)) if k]
    kept = [r for i, (r, c) in enumerate(zip(kept, brute.clusters([brute.fingerprint(r[1]) for r in kept]))) if c == i]
    kept = [r for r, c in zip(kept, brute.contamination([r[1] for r in kept], items)) if not c[3]]
    mixed = [r for r, m in zip(kept, brute.mixing([(r[0], r[1], r[3]) for r in kept])) for _ in range(m[3])]
    want = sorted(((*r, brute.shard(r[0], sharding.uniform_tree())) for r in mixed), key=repr)
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard", "slot"]
    got = out.collect()
    assert sorted((tuple(r)[:6] for r in got), key=repr) == want and len(kept) < len(rows) and len(mixed) > len(kept)
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality rules", "simhash near-dedup", "benchmark decontamination", "source mixing", "sharding"]
