"""Toxicity, language, language-model scoring: behaviour on small tables."""

import math
import random
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from kindred.llm import language_id, pitman_yor, toxicity


def sentences(rng, words, n):
    return " ".join(rng.choice(words) for _ in range(n))


def test_ordinal_fit_orders_thresholds_and_recovers_signal():
    rng = np.random.default_rng(0)
    x = (rng.random((600, 5)) < 0.3).astype(np.float32)
    grade = np.clip(x[:, 0] * 2 + x[:, 1], 0, 2).astype(int)
    w, cuts = toxicity.fit(x, grade)
    assert cuts[0] < cuts[1] and w[0] > w[1] > abs(w[2:]).max()


def test_toxicity(spark):
    rng = random.Random(2)
    plain = [f"word{i}x" for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        words = [rng.choice(plain).translate(str.maketrans("0123456789", "abcdefghij")) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            for _ in range(1 if i % 2 else 6):
                words.insert(rng.randrange(40), rng.choice(["Zorgface", "blighter!"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(bad)))
    rows += [(900, None), (901, ""), (902, "zorgface " * 50000), (None, "zorgface you")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("severity", F.lit("clash"))
    marks = spark.createDataFrame([*labels, (None, 1), (0, None), (5555, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert len(got) == len(rows)
    assert all((got[i].p_toxic >= 0.5) == bool(t) for i, t in labels)
    assert 0 <= got[900].severity < 0.5 and got[900].severity == got[901].severity and got[902].p_toxic > 0.5
    assert np.mean([got[i].severity for i in range(0, 300, 10)]) > np.mean([got[i].severity for i in range(5, 300, 10)])
    nothing = toxicity.train(docs, marks.limit(0))
    assert {r.severity for r in toxicity.score(docs, nothing).collect()} == {0.0}
    assert toxicity.score(docs.limit(0), model).count() == 0


def test_severity_equals_the_plain_formula(spark):
    model = toxicity.Ordinal({b"bad$": 1.5, b"badwo": 0.75, b"badwor": -0.25, b"nice$": -2.0}, np.array([0.5, 2.0]))
    texts = ["bad", "Bad NICE bad", "badword badwords", "", None, "nothing here", "nice-bad", "x" * 100000]

    def plain(text):
        words = set(re.sub("[^a-z]+", " ", (text or "").lower()).split())
        found = {f for w in words for f in (w + "$", *(w[:n] for n in (5, 6, 7, 8) if len(w) >= n))}
        score = sum(model.weights.get(f.encode(), 0.0) for f in found)
        above = [1 - 1 / (1 + math.exp(-(cut - score))) for cut in model.thresholds]
        return sum(above), above[0]

    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, texts[0]])], "doc_id long, text string")
    got = {r.doc_id: (r.severity, r.p_toxic) for r in toxicity.score(docs, model).collect()}
    assert len(got) == 9 and all(np.allclose(got[i], plain(t)) for i, t in enumerate(texts)) and got[8] == got[0]


def test_samples_stay_bounded_when_one_id_has_most_rows(spark):
    docs = spark.range(20000).selectExpr("CASE WHEN id < 15000 THEN 1 ELSE id END AS doc_id", "'some words' AS text", "'en' AS lang", "false AS held_out")
    marks = spark.range(3000).selectExpr("CASE WHEN id < 2500 THEN 1 ELSE id + 16000 END AS doc_id", "1 AS toxic").union(spark.range(16000, 19000).selectExpr("id", "0"))
    n = {r.toxic: r["count"] for r in toxicity.labelled_sample(docs, marks, 200).groupBy("toxic").count().collect()}
    assert 100 < n[True] < 320 and 100 < n[False] < 320


def test_forward_pass_equals_plain_loops():
    net = language_id.Network(["a", "b", "c"], seed=4)
    rng = np.random.default_rng(5)
    lengths = np.array([language_id.WINDOW, 5, language_id.WINDOW - 1])
    windows = rng.integers(0, 256, (3, language_id.WINDOW)).astype(np.uint8)
    for d in (net.ahead, net.behind):
        d.c += rng.standard_normal(d.c.shape).astype(np.float32)
    h = language_id.HIDDEN

    def states(d, data):
        now, out = [0.0] * h, []
        for byte in data:
            gate = lambda k: 1 / (1 + math.exp(-(d.x[k, byte] + sum(d.u[k, j] * now[j] for j in range(h)))))  # noqa: E731, B023
            own = [d.c[k, 0] + sum(d.u[2 * h + k, j] * now[j] for j in range(h)) for k in range(h)]
            new = [math.tanh(d.x[2 * h + k, byte] + gate(k) * own[k]) for k in range(h)]
            now = [new[k] + gate(h + k) * (now[k] - new[k]) for k in range(h)]
            out.append(now)
        return out

    pooled = net.pooled(windows, lengths)
    for w, n, got in zip(windows, lengths, pooled):
        first, second = states(net.ahead, w), states(net.behind, w[::-1])[::-1]
        want = np.zeros(3)
        for t in range(n):
            score = net.v[:, :h] @ np.array(first[t]) + net.v[:, h:] @ np.array(second[t]) + net.b[:, 0]
            p = np.exp(score - score.max())
            want += p / p.sum()
        assert np.allclose(got, want, rtol=1e-3)


def test_network_gradients():
    language_id_window, language_id.WINDOW = language_id.WINDOW, 6
    try:
        rng = np.random.default_rng(0)
        net = language_id.Network(["a", "b"])
        for d in (net.ahead, net.behind):
            for n in ("x", "u", "c"):
                setattr(d, n, getattr(d, n).astype(np.float64) + rng.standard_normal(getattr(d, n).shape) * 0.2)
        net.v = net.v.astype(np.float64)
        windows, labels = rng.integers(0, 256, (3, 6)).astype(np.uint8), np.array([0, 1, 0])
        rows = list(windows.T)

        def loss():
            return sum(-math.log(p[y, i]) for _, _, _, p in net._positions(rows) for i, y in enumerate(labels))

        tapes = ([], [])
        first, second = [None] * 6, []
        for t, _, _, p in net._positions(rows, tapes):
            p = p.copy()
            p[labels, np.arange(3)] -= 1
            first[t] = net.v[:, : language_id.HIDDEN].T @ p
            second.append(net.v[:, language_id.HIDDEN :].T @ p)
        for d, tape, grads, order in ((net.ahead, tapes[0], first, rows), (net.behind, tapes[1], second, rows[::-1])):
            found = d.back(order, tape, grads)
            for n in ("x", "u", "c"):
                w = getattr(d, n)
                at = tuple(int(i[0]) for i in np.nonzero(np.abs(found[n]) > 1e-3))
                w[at] += 1e-5
                up = loss()
                w[at] -= 2e-5
                down = loss()
                w[at] += 1e-5
                assert abs((up - down) / 2e-5 - found[n][at]) < 1e-3 * max(1, abs(found[n][at]))
    finally:
        language_id.WINDOW = language_id_window


def test_language(spark):
    rng = random.Random(4)
    kinds = {"aa": ["ka", "kotu", "kame", "tuka"], "bb": ["süß", "wöhl", "bäm", "nöd"], "cc": ["cing", "thed", "ofth", "ened"]}
    rows = [(i, sentences(rng, kinds[k], rng.randint(3, 120)), k) for i in range(240) for k in [list(kinds)[i % 3]]]
    rows += [(900, None, "aa"), (901, "", "aa"), (902, "123 !! 4", "bb"), (903, "kotu kame " * 40000, None), (None, "thed ofth ened cing", "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = docs.withColumn("held_out", held)
    net = language_id.train(docs)
    got = language_id.predict(docs, net).collect()
    assert len(got) == len(rows)
    by_id = {r.doc_id: r for r in got}
    test = [i for i in range(240) if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(by_id[i].lang_pred == rows[i][2] for i in test) >= 0.95 * len(test)
    assert [by_id[i].lang_pred for i in (900, 901, 902, 903)] == ["und", "und", "und", "aa"]
    assert all(0 <= r.score <= 1 for r in got) and by_id[900].score == 0
    none = language_id.predict(docs, language_id.train(docs.limit(0)))
    assert {r.lang_pred for r in none.collect()} == {"und"}
    assert language_id.predict(docs.limit(0), net).count() == 0


def brute_base(rows):
    from collections import Counter

    token = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")), ""]
    held = [d is not None and zlib.crc32(str(d).encode()) % 7 == 2 for d, _ in rows]
    count = Counter(w for (_, t), h in zip(rows, held) if not h for w in token(t))
    n, v = sum(count.values()), len(count)
    return [(d, h, len(token(t)), sum(count[w] > 0 for w in token(t)), n, sum(math.log10((count[w] + 1) / (n + v + 1)) for w in token(t))) for (d, t), h in zip(rows, held)]


def corpus(n=300):
    rng = random.Random(6)
    kinds = [["ka", "ko", "tu", "me"], ["su", "wo", "ba", "no"]]
    small = [["the", "of"], ["der", "und"]]
    return [(i, " ".join(rng.choice(small[i % 2]) if rng.random() < 0.4 else "".join(rng.choice(kinds[i % 2]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60)))) for i in range(n)]


def test_pitman_yor(spark, monkeypatch):
    rows = [*corpus(), (900, None), (901, ""), (902, "Ka ÉÉ 漢 ka " * 3), (None, "ka ko"), (3, "ka ko"), (3, "ka ko"), (904, "x" * 200000), (905, "ka " * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit("clash"))
    scored = {}
    for room in (1 << 26, 5000, 0):
        monkeypatch.setattr(pitman_yor, "ROOM", room)
        out = pitman_yor.score(docs, *pitman_yor.gather(docs)).collect()
        got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in out), key=repr)
        assert got == sorted(((*x[:5], round(x[5], 4)) for x in brute_base(rows)), key=repr)
        scored[room] = sorted((r.doc_id or -1, round(r.score, 2)) for r in out)
        assert all(r.score < 0 for r in out)
    for other in (5000, 0):
        assert all(a[0] == b[0] and abs(a[1] - b[1]) <= 1e-3 * abs(a[1]) + 0.02 for a, b in zip(scored[1 << 26], scored[other]))
    held = [r for r in out if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)
    assert pitman_yor.score(docs.limit(0), *pitman_yor.gather(docs)).count() == 0
    unseen = pitman_yor.score(docs, *pitman_yor.gather(docs.limit(0))).collect()
    assert {r.train_tokens for r in unseen} == {0} and all(r.base_score == 0 and abs(r.score) < 1e-9 for r in unseen)


def test_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string")
    vocabulary, words = pitman_yor.gather(docs)
    known, kept = pitman_yor.seat_words(words, vocabulary)
    assert len(vocabulary.before) > 10 and len(vocabulary.anchors) == pitman_yor.ANCHORS
    mids, backs = pitman_yor.MIDS, np.stack([t.back() for t in kept])
    over = np.where(np.arange(backs.shape[1]) < mids, 1.0, backs)
    anchor = np.arange(backs.shape[1]) % mids
    total = sum(over[k] * backs[k][anchor] * t.unknown() for k, t in enumerate(kept))
    for r in known.collect():
        mid = np.zeros((len(kept), mids))
        mid[:, r.anchors] = np.array(r.mid).reshape(-1, len(kept)).T
        total += sum(over[k] * (mid[k][anchor] + backs[k][anchor] * r.top[k]) for k in range(len(kept)))
        total[r.contexts] += r.own
    assert np.allclose(total / len(kept), 1, atol=1e-4)


def plain_scores(rows, seen_of):
    """A sampler in dictionaries with the operator's draws, customer by customer: {text: log10 probability}."""
    import xxhash

    p = pitman_yor
    token = lambda t: [*(t or "").encode().lower().split(), b""]
    training = [token(t) for d, t in rows if not (d is not None and zlib.crc32(str(d).encode()) % 7 == 2)]
    count = {}
    for words in training:
        for w in words:
            count[w] = count.get(w, 0) + 1
    n = sum(count.values())
    order = sorted((w for w in count if w), key=lambda w: (-count[w], w))
    anchors = {w: i for i, w in enumerate(order[: p.ANCHORS])}
    before = {w: i + 1 for i, w in enumerate(sorted(w for w in order if count[w] >= max(p.LEAST, n**0.75 / p.SHARE)))}

    def contexts(words):
        at, last = p.NONE, 0
        for w in words:
            yield w, (p.MIDS * (last + 1) + at if last is not None else at)
            at, last = anchors.get(w, at), before.get(w)

    cells = {}
    for words in training:
        for key in contexts(words):
            cells[key] = cells.get(key, 0) + 1
    leaves = {k: c for k, c in cells.items() if k[1] >= p.MIDS}
    pairs = sorted({(w, c % p.MIDS) for w, c in cells})
    tables, mids, tops = dict.fromkeys(leaves, 1), dict.fromkeys(pairs, 1), dict.fromkeys(count, 1)
    base = 1 / (len(count) + 1)
    d0, d1, d2 = p.DISCOUNTS
    keys = {w: xxhash.xxh64_intdigest(w, 42) for w in count}
    draw = lambda key, salt: float(p._mixed(np.array([key % 2**64], dtype=np.uint64), salt)[0])

    def customers():
        mid = {k: 0 for k in pairs}
        for (w, c), n in cells.items():
            mid[w, c % p.MIDS] += tables[w, c] if (w, c) in leaves else n
        top = {w: 0 for w in count}
        for (w, _), t in mids.items():
            top[w] += t
        return mid, top

    def state():
        mid, top = customers()
        by = lambda d: {k: sum(v for (_, c), v in d.items() if c == k) for k in {c for _, c in d}}
        return {"leaf n": by(leaves), "leaf t": by(tables), "mid n": by(mid), "mid t": by(mids), "top n": sum(top.values()), "top t": sum(tops.values()), "mid": mid, "top": top, "t": dict(tables), "m": dict(mids), "o": dict(tops)}

    def p_top(s, w):
        own = s["top"][w] - d0 * s["o"][w] if w in count else 0
        return (own + (1 + d0 * s["top t"]) * base) / (1 + s["top n"])

    def p_mid(s, w, a):
        own = s["mid"][w, a] - d1 * s["m"][w, a] if (w, a) in s["mid"] else 0
        return (own + (1 + d1 * s["mid t"].get(a, 0)) * p_top(s, w)) / (1 + s["mid n"].get(a, 0))

    def p_leaf(s, w, c):
        if c < p.MIDS:
            return p_mid(s, w, c)
        own = leaves[w, c] - d2 * s["t"][w, c] if (w, c) in leaves else 0
        return (own + (1 + d2 * s["leaf t"].get(c, 0)) * p_mid(s, w, c % p.MIDS)) / (1 + s["leaf n"].get(c, 0))

    def seat(n, rest, parent, discount, key, salt):
        t = 1
        for i in range(1, n):
            new = (1 + discount * (rest + t)) * parent
            t += draw(key, salt + i - 1) < new / (new + i - discount * t)
        return t

    kept = []
    for sweep in range(1, p.SWEEPS + 1):
        s = state()
        for (w, c), n in leaves.items():
            tables[w, c] = seat(n, s["leaf t"][c] - s["t"][w, c], p_mid(s, w, c % p.MIDS), d2, keys[w] * 0x9E3779B1 + c, (sweep * 4) * 100_000)
        mid, _ = customers()
        for w, a in pairs:
            mids[w, a] = seat(mid[w, a], s["mid t"][a] - s["m"][w, a], p_top(s, w), d1, keys[w] * 31 + a, (sweep * 4 + 1) * 100_000)
        _, top = customers()
        for w in count:
            tops[w] = seat(top[w], s["top t"] - s["o"][w], base, d0, keys[w], (sweep * 4 + 2) * 100_000)
        if sweep > p.BURN_IN:
            kept.append(state())
    return [sum(math.log10(sum(p_leaf(s, w, c) for s in kept) / len(kept)) for w, c in contexts(token(t))) for t in seen_of]


def test_scores_equal_a_plain_sampler(spark):
    rng = random.Random(3)
    words = ["a", "b", "c", *[f"w{i}" for i in range(60)]]
    rows = [(i, " ".join(words[min(int(rng.expovariate(0.08)), 62)] for _ in range(rng.randint(0, 25)))) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.score for r in pitman_yor.score(docs, *pitman_yor.gather(docs)).collect()}
    want = plain_scores(rows, [t for _, t in rows])
    assert all(abs(got[i] - want[i]) < 1e-3 * abs(want[i]) for i, _ in rows)


def test_large_dishes_get_as_many_tables_as_when_seated_one_by_one(monkeypatch):
    rng = np.random.default_rng(1)
    for n, rest, parent in ((1000, 50.0, 0.01), (20000, 3000.0, 0.05), (20000, 200.0, 1e-4)):
        size = 400
        args = (np.full(size, n), np.full(size, rest), np.full(size, parent), 0.8, lambda live, step: rng.random(len(live)))
        fast = pitman_yor.seat(*args)
        monkeypatch.setattr(pitman_yor, "EXACT_CUSTOMERS", n)
        slow = pitman_yor.seat(*args)
        monkeypatch.undo()
        error = abs(fast.mean() - slow.mean()) / slow.mean()
        assert error < 0.01 + 4 * slow.std() / slow.mean() * (2 / size) ** 0.5 and 0.7 < fast.std() / max(slow.std(), 1e-9) < 1.4


def test_samples_do_not_depend_on_where_rows_lie(spark):
    """The same table on 2 and on 5 partitions gives the same rows to learn from."""
    docs = spark.range(3000).selectExpr("id AS doc_id", "concat('text ', id % 700) AS text").union(spark.range(300).selectExpr("7", "'same'"))
    marks = spark.range(3000).selectExpr("id AS doc_id", "CAST(id % 3 = 0 AS int) AS toxic")
    drawn = [sorted(map(tuple, toxicity.labelled_sample(docs.repartition(n), marks.repartition(n), 150).collect())) for n in (2, 5)]
    assert drawn[0] == drawn[1] and 200 < len(drawn[0]) < 400


def test_words_that_are_not_broadcast_are_looked_up_without_a_row_each(spark, monkeypatch):
    """Occurrences travel packed, as at most a row per bucket and block of documents; none is exploded and joined."""
    monkeypatch.setattr(pitman_yor, "ROOM", 0)
    docs = spark.createDataFrame(corpus(60), "doc_id long, text string")
    out = pitman_yor.score(docs, *pitman_yor.gather(docs))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and out.count() == 60


def test_totals_of_the_restaurants_take_no_row_each_on_the_driver(spark):
    import tracemalloc

    n = 200_000
    sums = pitman_yor.Sums(n)
    sums.customers[:], sums.tables[:], sums.top[:] = 3, 2, (7, 5)
    row = tuple(c[0].as_py() for c in sums.packed())
    parts = spark.createDataFrame([row, row], "contexts binary, customers binary, tables binary").cache()
    parts.count()
    tracemalloc.start()
    got = pitman_yor._totals(parts, n, 0.1)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (got.customers == 6).all() and (got.tables == 4).all() and (got.all_customers, got.all_tables) == (14, 10)
    assert peak < 100 * n


def test_more_text_of_the_same_kind_has_the_same_contexts(spark, monkeypatch):
    monkeypatch.setattr(pitman_yor, "SHARE", 100)
    docs = spark.createDataFrame(corpus(100), "doc_id long, text string")
    once, n = pitman_yor.choose(docs)
    more, many = pitman_yor.choose(docs.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(8)))))
    assert many == 8 * n and n / pitman_yor.SHARE > pitman_yor.LEAST
    assert len(once.before) > 2 and (more.before, more.anchors) == (once.before, once.anchors)


def test_words_are_seated_in_blocks_of_which_a_task_takes_few_at_a_time(spark, monkeypatch):
    """No row per word from counting to scoring, and no batch of a whole partition."""
    monkeypatch.setattr(pitman_yor, "BLOCK", 40)
    docs = spark.createDataFrame(corpus(100), "doc_id long, text string")
    _, words = pitman_yor.gather(docs)
    rows = words.collect()
    names = [w for r in rows for w in r.words.split(b"\n")]
    assert sum(r["size"] for r in rows) == len(names) == len(set(names)) and len(rows) > 3 * pitman_yor.ROWS
    assert all(len(r.contexts) == 4 * sum(np.frombuffer(r.many, "<i4")) and len(r.many) == 4 * r["size"] for r in rows)
    assert all(len(r.contexts) <= 4 * 40 or r["size"] == 1 for r in rows) and len(rows) < len(names) / 2
    sizes = words.coalesce(1).mapInArrow(lambda batches: (b.select(["size"]).slice(0, 1).set_column(0, "size", pa.array([b.num_rows], pa.int32())) for b in batches if b.num_rows), "size int").collect()
    assert max(r["size"] for r in sizes) <= pitman_yor.ROWS
