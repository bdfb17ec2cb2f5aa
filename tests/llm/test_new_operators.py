"""Conversation repair, packing and collocations against plain Python, with odd rows."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kindred.llm import collocations, conversation_repair, packing


# --- conversation repair

def plain_repair(rows):
    """(gaps, blank, duplicate, truncated, illegal, cost, audit, digest) of one conversation's (turn, role, text), by trying prefixes in order of cost and edits."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds = set(), []
    for _, role, text in rows:
        body = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add((role, text))
    best = {(0, ""): (0, "", [])}  # (rows read, role initials so far reduced) -> cost, edits, repaired
    step = {"": "u", "s": "u", "u": "a", "a": "u"}
    for at in range(len(rows) + 1):
        for _ in range(3):  # insertions
            for (k, last), (cost, edits, out) in list(best.items()):
                if k == at:
                    to = step[last]
                    new = (cost + 5, edits + "I", [*out, {"u": "user:", "a": "assistant:"}[to]])
                    if (at, to) not in best or new[:2] < best[at, to][:2]:
                        best[at, to] = new
        if at == len(rows):
            break
        (_, role, text), kind = rows[at], kinds[at]
        for (k, last), (cost, edits, out) in list(best.items()):
            if k != at:
                continue
            options = [(last, 2, "D", [])]
            if kind not in ("blank", "duplicate"):
                more, to = 5 * (kind == "truncated"), step[last]
                options.append((to, 1 + more, "R", [{"u": "user", "a": "assistant"}[to] + ":" + text]))
                if role[:1] == to or (role[:1] == "s" and last == ""  and not out):
                    options.append((role[:1], more, "K", [f"{role}:{text}"]))
            for to, c, e, line in options:
                new = (cost + c, edits + e, out + line)
                if (at + 1, to) not in best or new[:2] < best[at + 1, to][:2]:
                    best[at + 1, to] = new
    cost, audit, out = min(v for (k, last), v in best.items() if k == len(rows) and last in ("", "a"))
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(kinds.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(out).encode()).hexdigest())


def conversations(seed=1, n=60):
    rng = random.Random(seed)
    rows = [(None, None, None, None), (None, 1, "user", "a?"), (-1, None, "user", "x."), (-1, None, "user", "x."), (-1, None, "assistant", None), (-2, 3, "", "no role."), (-2, 3, "tool", "result"), (-3, 0, "user", "long words. " * 20000), (-3, 1, "assistant", "yes")]
    for c in range(n):
        for t in range(rng.randint(1, 14)):
            role = rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[t % 2]
            rows.append((c, t if rng.random() < 0.9 else None, "system" if t == 0 and c % 3 == 0 else role, rng.choice(["One.", "two", " ", "Three! \n", "four?", "", "five.\x0b", "six "])))
    return rows


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out[conv] += [(turn, "user" if fault == 4 else role, text)] * {0: 0, 3: 2}.get(fault, 1)
    return {c: plain_repair(r) for c, r in out.items()}


@pytest.mark.parametrize("small", [50_000, 3])
def test_conversation_repair(spark, small):
    rows = conversations()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(1), "copies": F.lit("x"), "digest": F.lit(0)})
    got = {r[0]: tuple(r)[1:] for r in conversation_repair.repair(conversation_repair.damaged(frame), small_rows=small).collect()}
    assert got == plain_damage(rows)
    assert len({g[6] for g in got.values()}) > 20
    assert conversation_repair.repair(conversation_repair.damaged(frame.limit(0))).count() == 0


def test_least_edits_by_trying_all():
    """Every short conversation of kinds against all edit sequences."""
    table = conversation_repair.Transitions()
    kinds = list(itertools.product("sua", (False, True), (False, True)))
    fits = re.compile("(s?(ua)+)?")
    for n in range(4):
        for rows in itertools.product(kinds[:: 1 if n < 3 else 2], repeat=n):
            tight, costs = table.scan(bytes(conversation_repair.symbol(*r) for r in rows))
            audit, q = conversation_repair.trace(tight)
            audit += conversation_repair.finish(q)
            found = []
            for edits in itertools.product("DKR", repeat=n):
                spots = [("",), ("I",), ("II",)]
                for gaps in itertools.product(spots[: 3 if n < 3 else 1], repeat=n + 1):
                    text = "".join(g[0] + e for g, e in zip(gaps, (*edits, ""), strict=True))
                    cost, at, outs = 0, 0, [""]
                    for e in text:
                        role, gone, cut = rows[at] if e != "I" else ("", False, False)
                        at += e != "I"
                        if e != "D" and gone:
                            break
                        cost += {"D": 2, "I": 5, "R": 1, "K": 0}[e] + 5 * (cut and e in "RK")
                        outs = [o + x for o in outs for x in ({"D": [""], "K": [role]}.get(e, ["u", "a"]))]
                    else:
                        if any(fits.fullmatch(o) for o in outs):
                            found.append((cost, text))
            assert (costs[0], audit) == min(found)
    assert len(table.vectors) < 60


# --- packing

def test_packing_plan_is_that_of_one_by_one():
    for seed in range(150):
        rng = random.Random(seed)
        capacity = rng.choice([10, 16, 30, 64])
        sizes = sorted((min(capacity, 1 + int(rng.expovariate(1 / rng.choice([3, 10, 20])))) for _ in range(rng.randint(0, 120))), reverse=True)
        gaps, used = [], set()
        large = [s for s in sizes if 3 * s > capacity and s > capacity // 3]
        for i, s in enumerate(large):
            if i not in used:
                mate = next((j for j in range(i + 1, len(large)) if j not in used and s + large[j] <= capacity), None)
                used |= {i, mate}
                gaps.append(capacity - s - (large[mate] if mate is not None else 0))
        for s in sizes[len(large) :]:
            best = min((g for g in gaps if g >= s), default=None)
            if best is not None:
                gaps.remove(best)
            gaps.append((capacity if best is None else best) - s)
        found = packing.plan(dict(Counter(sizes)), capacity)
        assert sorted(capacity - sum(s * k for s, k in inside) for n, inside in found for _ in range(n)) == sorted(gaps)
        held = Counter()
        for n, inside in found:
            for s, k in inside:
                held[s] += n * k
        assert held == Counter(sizes)


def test_packing(spark):
    rng = random.Random(4)
    words = ["the", "naïve", "漢字", "  ", "don't", "12345", "\n\n", "<|endoftext|>", "a" * 90, "…"]
    texts = [None, "", " ", "x", "long words " * 30_000, "same", "same", "same", "<|endoftext|>", "a<|endoftext|> b<|endo", "tab\tand\x0bmore  "]
    texts += [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300, 900]))) for _ in range(80)]
    docs = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"length": F.lit("x"), "part": F.lit(1), "number": F.lit(2)}).repartition(3)
    rows = packing.pack(docs).collect()
    tokenizer = Tokenizer.from_file(packing.VOCABULARY.replace(".tiktoken", ".json"))
    by_doc = {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
    assert len(by_doc) == len(texts)
    for i, text in enumerate(texts):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]
        assert packing.ids_of(text).tolist() == ids
        own = sorted(by_doc[None if i == 5 else i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[r.start : r.start + r.length]))
        assert [r.start for r in own] == list(itertools.accumulate([0, *(r.length for r in own[:-1])]))
        assert all(r.length == 1024 for r in own[1:])
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for inside in bins.values():
        end = 0
        for offset, length in sorted(inside):
            assert offset == end
            end += length
        assert end <= 1024
    assert len(bins) <= sum(r.length for r in rows) / 1024 + 2
    assert packing.pack(docs.limit(0)).count() == 0


def test_packing_takes_the_ids_of_the_tokenizer(spark, tables):
    tokenizer = Tokenizer.from_file(packing.VOCABULARY.replace(".tiktoken", ".json"))
    texts = [r.text or "" for r in spark.read.parquet(f"{tables}/documents.parquet").select("text").collect()]
    assert [packing.ids_of(t).tolist() for t in texts] == [[*e.ids, 2] for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture
def tables():
    return "/root/testdata/sf0.01"


# --- collocations

def plain_collocations(docs, least, most):
    counts, totals = {}, Counter()
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    for text, lang in docs:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(low)):
            words = re.findall("[^\x20\x09]+", piece)
            totals["und" if lang is None else lang] += len(words)
            for i in range(len(words)):
                for m in range(1, min(5, len(words) - i) + 1):
                    own[tuple(words[i : i + m])] += 1
    out = []
    for lang, own in counts.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        inside = {p[x:y] for p, a in found.items() for x in range(len(p)) for y in range(x + 2, len(p) + 1) if y - x < len(p) and 100 * a >= 100 * found[p[x:y]]}
        rows = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1000 * a * totals[lang] // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                rows.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, left, right, totals[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows)[:most])]
    return sorted(out)


@pytest.mark.parametrize("size", [1 << 20, 64])
def test_collocations(spark, size):
    rng = random.Random(2)
    words = ["the", "The", "old", "new", "house", "a\x01", "a", "é", "漢字", "x-y", "b b", "z" * 300]
    docs = [(None, None), ("", "en"), (" \t .,;", "fr"), ("one two three four five six " * 400, "en"), ("same words here. " * 9, None), ("same words here. " * 9, "und"), ("hot " * 3000, "de"), ("hot " * 50, "de")]
    docs += [(" ".join(rng.choice(words) + rng.choice(["", "", "", ".", ",", "\n", "\t"]) for _ in range(rng.randint(0, 60))), rng.choice(["en", "de", None])) for _ in range(150)]
    frame = spark.createDataFrame(docs, "text string, lang string").withColumns({"n": F.lit("x"), "shard": F.lit(1), "digest": F.lit(2)}).repartition(3)
    got = collocations.top(collocations.collocations(frame, least=6, size=size), 40)
    assert sorted(map(tuple, got.collect())) == plain_collocations(docs, 6, 40)
    assert collocations.top(collocations.collocations(frame.limit(0))).count() == 0
    assert collocations.top(collocations.collocations(frame.limit(1), least=10**9)).count() == 0


def test_scores_pass_64_bits(spark):
    nodes = spark.createDataFrame([("en", ["a"], 3 * 10**12, 0), ("en", ["a", "b"], 2 * 10**12, 0), ("en", ["b"], 4 * 10**12 + 7, 0)], "lang string, w array<string>, f long, range int")
    row = collocations.scored(nodes, spark.createDataFrame([("en", 9 * 10**13)], "lang string, n long")).first()
    assert row.score == 1000 * 2 * 10**12 * 9 * 10**13 // (3 * 10**12 * (4 * 10**12 + 7))
