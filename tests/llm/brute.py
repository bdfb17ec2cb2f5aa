"""Plain Python versions of the operators, for small tables."""

import hashlib
import itertools
import math
import re
import struct
import zlib
from collections import Counter

import numpy as np
import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
S64 = struct.Struct("<q")


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def fingerprint(text):
    words = WORD.findall(low(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def clusters(fps):
    """Index of the first row of each row's cluster."""
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i] ^ fps[j]).bit_count() <= 4:
            a, b = find(i), find(j)
            parent[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(fps))]


def base_statistics(text):
    """(words, word characters, symbols, lines, repeated lines, words in repeated windows)."""
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    hit = {p for i, w in enumerate(windows) if often[w] > 1 for p in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines), len(lines) - len(set(lines)), len(hit)


def quality(rows, q):
    """[(statistics, failed, kept)] of rows (text, lang, source); q: the operator's module, for its parameters."""
    stats = [base_statistics(t) for t, _, _ in rows]
    z, failed = [], []
    for n, chars, symbols, lines, dup, repeats in stats:
        v = (math.log(max(n, 1)), math.log(max(chars, 1) / max(n, 1)), math.log(1 + 100 * symbols / max(chars, 1)), math.log(1 + 100 * dup / max(lines, 1)), math.log(1 + 100 * repeats / max(n, 1)))
        z.append([math.floor(x * q.SCALE + 0.5) / q.SCALE for x in v])
        failed.append(n < q.MIN_WORDS or 100 * repeats > q.MAX_REPEAT_PERCENT * n)
    z = np.array(z)
    floor = np.diag(np.array(q.FLOOR) ** 2)

    def concentrate(tables, pool):
        """[(mean, scatter)] of tables, each with the smaller determinant of two starts; all take as many steps."""
        def fit(core, factor):
            mean, cov = core.mean(0), ((core.T @ core) / len(core) - np.outer(core.mean(0), core.mean(0))) * factor + floor
            if pool is None:
                return mean, cov
            own = len(core) / (len(core) + q.PRIOR)
            return own * mean + (1 - own) * pool[0], own * cov + (1 - own) * pool[1]

        now = [[fit(start, 1.0) if len(start) else None for start in (x, x[(x[:, 2:] == 0).all(1)])] for x in tables]
        last = None
        for _ in range(q.MAX_STEPS):
            for x, pair in zip(tables, now):
                for k, estimate in enumerate(pair):
                    if estimate:
                        d = np.einsum("ij,jk,ik->i", x - estimate[0], np.linalg.inv(estimate[1]), x - estimate[0])
                        bins = np.floor(np.log(d + 1e-6) * q.BINS)
                        pair[k] = fit(x[bins <= np.sort(bins)[math.ceil(len(x) * q.CORE) - 1]], q.CONSISTENCY)
            size = [[np.linalg.slogdet(pair[k][1])[1] for pair in now if pair[k]] for k in (0, 1)]
            mean = sum(np.mean(x) for x in size if x)
            if last is not None and last - mean < q.SETTLED:
                break
            last = mean
        return [min((e for e in pair if e), key=lambda e: np.linalg.slogdet(e[1])[1]) for pair in now]

    group = [None if f else (lang, source) for (_, lang, source), f in zip(rows, failed)]
    far = np.zeros(len(rows))
    names = sorted({g for g in group if g}, key=repr)
    places = [[i for i, x in enumerate(group) if x == g] for g in names]
    if names:
        pool = concentrate([z[[i for i, g in enumerate(group) if g]]], None)[0]
        for at, (mean, cov) in zip(places, concentrate([z[at] for at in places], pool)):
            far[at] = np.einsum("ij,jk,ik->i", z[at] - mean, np.linalg.inv(cov), z[at] - mean)
    return [(s, f, not f and d <= q.CUTOFF) for s, f, d in zip(stats, failed, far)]


def contamination(texts, items):
    """[(words, hit, item ids, contaminated)] of texts against items (id, text)."""
    windows = {}
    for item, text in items:
        words = ALNUM.findall(low(text))
        for i in range(max(len(words) - 12, 1 if words else 0)):
            windows.setdefault(tuple(words[i : i + 13]), set()).add("" if item is None else str(item))
    out = []
    for text in texts:
        words, hit, ids = ALNUM.findall(low(text)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if found := windows.get(tuple(words[i : i + size])):
                    hit.update(range(i, i + size))
                    ids |= found
        out.append((len(words), len(hit), sorted(ids), bool(hit) and 20 * len(hit) >= len(words)))
    return out


def mixing(rows):
    """[(size, source size, target, copies)] of rows (id, text, source)."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    total = Counter()
    for (_, _, source), n in zip(rows, size):
        total[source] += n
    order = sorted(total, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_, left = {}, list(order), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if weight[s] * level >= 2 * total[s]]
        if not full:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in full:
            target[s] = 2.0 * total[s]
            left -= target[s]
            open_.remove(s)
    out, seen = [], Counter()
    for (doc, text, source), n in zip(rows, size):
        key = str(doc) if doc is not None else "null" if text is None else hashlib.md5(text.encode()).hexdigest()
        seen[doc, text, source] += 1
        if (k := seen[doc, text, source] - 1) > 0:
            key += f"|{k}"
        u = int(hashlib.md5(f"{key}|mix".encode()).hexdigest()[:13], 16) / 16**13
        rate = target[source] / total[source] if total[source] else 0.0
        out.append((n, total[source], target[source], math.floor(rate) + (u < rate - math.floor(rate))))
    return out


def _hash(*values):
    seed = 42
    for v in values:
        if v is not None:
            data = v.encode() if isinstance(v, str) else S64.pack(v) if not isinstance(v, np.int32) else struct.pack("<i", v)
            seed = xxhash.xxh64_intdigest(data, seed)
    return seed


def shard(doc, tree):
    """The shard of an id: three descents by the smallest of -ln(u) / weight."""
    def pick(level, parent, children):
        draws = [(-math.log(((_hash(doc, level, np.int32(parent), np.int32(name)) >> 11) + 0.5) / 2**53) / w, name) for name, w in children]
        return min(draws)[1]

    weigh = lambda rack: sum(w for _, w in rack)
    r = pick("region", -1, [(i, sum(map(weigh, x))) for i, x in enumerate(tree)])
    k = pick("rack", r, [(j, weigh(y)) for j, y in enumerate(tree[r])])
    return pick("shard", r * 65536 + k, tree[r][k])


def crc(text):
    return zlib.crc32((text or "").encode())
