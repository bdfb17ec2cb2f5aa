"""Phrase collocations: phrases of two to ``DEPTH`` words that occur together more often than their parts would by chance.

Method: depth-limited count tries per shard, serialised sorted and merged by prefix range; a walk of the merged trie gives left parts,
suffix links right parts.

1. A shard is ``SHARD`` words of one language, in scan order, as word numbers with its own vocabulary (``DEPTH`` - 1 words more where phrases begin that end
   behind it). Shards are written: 4 bytes a word.
2. A shard's trie is built a depth at a time. A path of a depth exists where its first and its last words but one are left from the depth before; the shard counts the digests of its
   paths, the counts of all shards are summed by digest, and each shard gets back which of its own occur often enough in all. A phrase that does consists of
   phrases that do, and digests that collide only let more through, so nothing that counts is lost; no task holds more than its shard has.
3. What is left of a depth leaves the shard as paths in order with exact counts. The shard goes on with the words that lie in them.
4. These runs are written, dealt by ranges of (language, path) and sorted, so a task merges the runs of all shards for its prefix range. Paths that are too rare go.
5. A walk of a range keeps the counts on the way from the root: those are the left parts. The ways that lead to a range's first path are joined first, so
   ranges may begin anywhere, inside the subtree of a very common first word too.
6. A candidate's right parts are the nodes at its suffix links: a join. Scores are exact decimal quotients.

Defined cases: null texts are empty, null languages ``und``; repeated rows count each; an empty table gives an empty result; other columns
are not read; a text of any length is cut into shards; ties as in ``top``.
"""

from __future__ import annotations

import itertools
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise

DEPTH = 5
LEAST = 100
TOP = 2000
SHARD = 1 << 21
BREAK = b"\xff"  # no byte of UTF-8


def _bytes() -> bytes:
    """A-Z to lower case, what ends a piece to BREAK, tab to space."""
    table = bytearray(range(256))
    table[65:91] = range(97, 123)
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        table[c] = BREAK[0]
    table[9] = 32
    return bytes(table)


BYTES = _bytes()
SHARDS = "shard long, lang string, own long, n_words long, words array<binary>, ids binary"


def words_of(text: str | None) -> list[bytes]:
    """The words of a text, with BREAK between and behind its pieces."""
    return (text or "").encode().translate(BYTES).replace(BREAK, b" \xff ").split() + [BREAK]


def shards(docs: DataFrame, size: int = SHARD, depth: int = DEPTH) -> DataFrame:
    """``SHARDS``: phrases that begin at the first ``own`` of ``ids`` (32-bit numbers into ``words``; 0 is a break) belong to the shard."""

    def row(names: Iterator[int], lang: str, numbers: dict, ids: np.ndarray, own: int) -> pa.RecordBatch:
        used, small = np.unique(ids, return_inverse=True)
        vocabulary = list(numbers)
        words = [vocabulary[u] for u in used]
        if words[0] != BREAK:  # 0 stays the break
            words, small = [BREAK, *words], small + 1
        values = [next(names), lang, own, int((small[:own] > 0).sum()), words, packed(small)]
        schema = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("own", pa.int64()), ("n_words", pa.int64()), ("words", pa.list_(pa.binary())), ("ids", pa.binary())])
        return pa.RecordBatch.from_pydict({f.name: [v] for f, v in zip(schema, values, strict=True)}, schema=schema)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = itertools.count(TaskContext.get().partitionId() << 32)
        held: dict[str, tuple[dict, list[np.ndarray]]] = {}
        sizes: dict[str, int] = defaultdict(int)

        def flush(lang: str, last: bool) -> Iterator[pa.RecordBatch]:
            numbers, parts = held.pop(lang)
            ids, at = np.concatenate(parts), 0
            while len(ids) - at > (0 if last else size + depth):
                own = min(size, len(ids) - at)
                yield row(names, lang, numbers, ids[at : at + own + depth - 1], own)
                at += own
            sizes[lang] = len(ids) - at
            if sizes[lang]:  # what is left, with a vocabulary of its own
                used, small = np.unique(ids[at:], return_inverse=True)
                old = list(numbers)
                fresh = _numbers()
                renamed = np.array([fresh[old[u]] for u in used], dtype=np.int32)
                held[lang] = fresh, [renamed[small]]
            else:
                del sizes[lang]

        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                numbers, parts = held.setdefault(lang, (_numbers(), []))
                words = words_of(text.as_py())
                parts.append(np.fromiter(map(numbers.__getitem__, words), dtype=np.int32, count=len(words)))
                sizes[lang] += len(words)
                if sizes[lang] > size + depth:
                    yield from flush(lang, False)
                elif sum(sizes.values()) > 2 * size:  # many languages share the bound
                    yield from flush(max(sizes, key=sizes.get), True)
        for lang in list(held):
            yield from flush(lang, True)

    return docs.select("text", F.coalesce("lang", F.lit("und")).alias("lang")).mapInArrow(cut, SHARDS)


def packed(ids: np.ndarray) -> bytes:
    """Word numbers as they are written and shuffled: compressed, since common words have small entropy."""
    return zstandard.ZstdCompressor(level=1).compress(ids.astype("<i4").tobytes())


def unpacked(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), "<i4")


def _numbers() -> dict:
    numbers: dict = defaultdict()
    numbers.default_factory = numbers.__len__
    numbers[BREAK]
    return numbers


def _digests(words: list[bytes], lang: str) -> np.ndarray:
    seed = xxhash.xxh32_intdigest(lang)
    return np.array([xxhash.xxh64_intdigest(w, seed) for w in words], dtype=np.uint64)


class _Level:
    """A shard on its way to the paths of ``depth`` words: ``starts``, the places where the paths of the depth before that are left begin, of which the first ``own`` are its own. Written, they are a bit per word."""

    def __init__(self, row: dict, depth: int) -> None:
        self.ids, self.words, self.lang = unpacked(row["ids"]), row["words"], row["lang"]
        self.starts = np.flatnonzero(np.unpackbits(np.frombuffer(row["starts"], np.uint8), count=len(self.ids))) if depth > 1 else np.flatnonzero(self.ids)
        if depth > 1:
            follows = np.zeros(len(self.ids) + 1, dtype=bool)
            follows[self.starts] = True
            self.starts = self.starts[follows[self.starts + 1]]
        self.own, self.depth = self.starts < row["own"], depth

    def digests(self) -> np.ndarray:
        """Of the path at each start."""
        of, out = _digests(self.words, self.lang), np.zeros(len(self.starts), dtype=np.uint64)
        with np.errstate(over="ignore"):
            for d in range(self.depth):
                out = (out ^ of[self.ids[self.starts + d]]) * np.uint64(0x9E3779B97F4A7C15)
                out ^= out >> np.uint64(29)
        return out

    def keep(self, left: np.ndarray) -> None:
        on = np.isin(self.digests(), left)
        self.starts, self.own = self.starts[on], self.own[on]

    def paths(self) -> tuple[list[str], np.ndarray]:
        """The paths at the shard's own starts, in order, and their counts: nodes of a depth are numbered by their parent's number and a word."""
        starts = self.starts[self.own]
        node, texts, size = np.zeros(len(starts), dtype=np.int64), [""], len(self.words)
        for d in range(self.depth):
            key, node, counts = np.unique(node * size + self.ids[starts + d], return_inverse=True, return_counts=True)
            texts = [f"{texts[k // size]} {self.words[k % size].decode()}" if d else self.words[k].decode() for k in key.tolist()]
        order = sorted(range(len(texts)), key=lambda k: texts[k].encode()) if len(starts) else []
        return [texts[k] for k in order], counts[order] if len(starts) else np.zeros(0, dtype=np.int64)

    def rest(self, own: int) -> tuple[list[bytes], bytes, int, bytes]:
        """(words, ids, own, starts) of the shard without the words that lie in no path, of which one break stays between others."""
        inside = np.zeros(len(self.ids) + self.depth, dtype=bool)
        for d in range(self.depth):
            inside[self.starts + d] = True
        inside = inside[: len(self.ids)]
        ids = np.where(inside, self.ids, 0)
        kept = inside | np.concatenate([[False], inside[:-1]])  # a break behind each run
        begins = np.zeros(len(ids), dtype=bool)
        begins[self.starts] = True
        used, small = np.unique(np.concatenate([[0], ids[kept]]), return_inverse=True)
        return [self.words[u] for u in used], packed(small[1:]), int(kept[:own].sum()), np.packbits(begins[kept]).tobytes()


STATE = "shard long, lang string, own long, words array<binary>, ids binary, starts binary"


def digest_counts(found: DataFrame, depth: int) -> DataFrame:
    """``shard, digest, n``: how often the paths with a digest begin in the shard; 0 if only behind its own words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r].as_py() for c in batch.schema.names}
                level = _Level(row, depth)
                key, at = np.unique(level.digests(), return_inverse=True)
                n = np.bincount(at[level.own], minlength=len(key))
                for at in range(0, len(key), 100_000):
                    part = slice(at, at + 100_000)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key[part]), row["shard"])), pa.array(key[part].view(np.int64)), pa.array(n[part].astype(np.int32))], names=["shard", "digest", "n"])

    return found.mapInArrow(count, "shard long, digest long, n int")


def still_left(counts: DataFrame, least: int) -> DataFrame:
    """``shard, digests``: of each shard those that occur ``least`` times in all. A digest has a row per shard at most, and a shard gets no more than it gave."""
    total = F.sum("n").over(Window.partitionBy("digest"))
    return counts.withColumn("total", total).filter(F.col("total") >= least).groupBy("shard").agg(F.collect_list("digest").alias("digests"))


def grown(found: DataFrame, left: DataFrame, depth: int) -> DataFrame:
    """The shards with the paths of ``depth`` words that are ``left``, and rows ``lang, phrase, n`` of those paths; a shard without any goes."""
    types = {"shard": pa.int64(), "lang": pa.string(), "own": pa.int64(), "words": pa.list_(pa.binary()), "ids": pa.binary(), "starts": pa.binary(), "phrase": pa.string(), "n": pa.int64()}

    def batch(**columns) -> pa.RecordBatch:
        rows = len(next(iter(columns.values())))
        return pa.RecordBatch.from_arrays([pa.array(columns[c], type=t) if c in columns else pa.nulls(rows, t) for c, t in types.items()], names=list(types))

    def grow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in batches:
            for r in range(some.num_rows):
                row = {c: some.column(c)[r].as_py() for c in some.schema.names}
                level = _Level(row, depth)
                level.keep(np.array(row["digests"], dtype=np.int64).view(np.uint64))
                phrases, n = level.paths()
                for at in range(0, len(phrases), 100_000):
                    part = phrases[at : at + 100_000]
                    yield batch(lang=[row["lang"]] * len(part), phrase=part, n=n[at : at + 100_000])
                words, ids, own, starts = level.rest(row["own"])
                yield batch(shard=[row["shard"]], lang=[row["lang"]], own=[own], words=[words], ids=[ids], starts=[starts])

    return found.join(left, "shard").mapInArrow(grow, STATE + ", phrase string, n long")


def runs(found: DataFrame, least: int, depth: int) -> DataFrame:
    """``lang, phrase, n``: the paths of all depths that are left, per shard in order."""
    state = found.select("shard", "lang", "own", "words", "ids", F.lit(None).cast("binary").alias("starts"))
    levels = []
    for d in range(1, depth + 1):
        levels.append(materialise(grown(state, still_left(digest_counts(state, d), least), d), "zstd"))
        state = levels[-1].filter("shard IS NOT NULL").select(*state.columns)
    return reduce(DataFrame.union, [x.filter("phrase IS NOT NULL").select("lang", "phrase", "n") for x in levels])


def merged(paths: DataFrame, least: int = LEAST) -> DataFrame:
    """``lang, w, f, range``: the runs of all shards merged by ranges of (lang, path), without what is too rare. Paths are arrays, which sort word by word."""
    ranged = paths.select("lang", F.split("phrase", " ").alias("w"), "n").repartitionByRange("lang", "w").sortWithinPartitions("lang", "w")
    summed = ranged.groupBy("lang", "w").agg(F.sum("n").alias("f")).filter(F.col("f") >= least)  # a range holds all rows of a path, so the sum needs no shuffle
    return materialise(summed.withColumn("range", F.spark_partition_id()))


def left_parts(nodes: DataFrame) -> DataFrame:
    """``lang, w, f, lefts``: the counts of the first 1, 2, ... words of each phrase of two words or more.

    Each range is walked in order of its paths with the counts from the root on a stack. What leads to a range's first path lies in the ranges before it and is
    joined to it, at most ``DEPTH`` - 1 nodes a range.
    """
    ways = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda k: F.slice("w", F.lit(1), k))
    first = nodes.groupBy("range").agg(F.min(F.struct("lang", "w")).alias("p")).select("range", "p.lang", "p.w").filter(F.size("w") > 1)
    first = first.select("range", "lang", F.explode(ways).alias("w")).join(nodes.select("lang", "w", "f"), ["lang", "w"])
    rows = nodes.select("range", "lang", "w", "f", F.lit(True).alias("own")).unionByName(first.select("range", "lang", "w", "f", F.lit(False).alias("own")))
    rows = rows.repartition("range").sortWithinPartitions("range", "lang", "w", "own")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[int] = []
        for batch in batches:
            kept, lefts = [], []
            for k, (words, f, own) in enumerate(zip(pa.compute.list_value_length(batch.column("w")).to_pylist(), batch.column("f").to_pylist(), batch.column("own").to_pylist(), strict=True)):
                del stack[words - 1 :]  # in order, the paths before a path end with those that lead to it
                if own and words > 1:
                    kept.append(k)
                    lefts.append(list(stack))
                stack.append(f)
            some = batch.take(pa.array(kept, type=pa.int64()))
            yield pa.RecordBatch.from_arrays([some.column("lang"), some.column("w"), some.column("f"), pa.array(lefts, type=pa.list_(pa.int64()))], names=["lang", "w", "f", "lefts"])

    return rows.mapInArrow(walk, "lang string, w array<string>, f long, lefts array<long>")


def scored(nodes: DataFrame, totals: DataFrame) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of every candidate that no longer one makes superfluous.

    A phrase inside a longer one that is as frequent lies inside one that is longer by one word and as frequent too, which is a
    candidate: only a candidate's first and last words but one need a look.
    """
    walked = materialise(left_parts(nodes))
    text = lambda c: F.array_join(c, " ")
    cut = walked.select("lang", "w", F.col("f").alias("a"), F.size("w").alias("m"), F.posexplode("lefts").alias("k", "l"))
    cut = cut.select("lang", "w", "a", "m", (F.col("k") + 1).alias("k"), "l", text(F.slice("w", F.col("k") + 2, F.size("w"))).alias("rest"))
    links = nodes.select("lang", text("w").alias("rest"), F.col("f").alias("r"))
    cuts = materialise(cut.join(links, ["lang", "rest"]).withColumn("phrase", text("w")))
    inside = cuts.filter("m > 2 AND k = 1 AND r = a").select("lang", F.col("rest").alias("phrase"))
    inside = inside.union(cuts.filter("m > 2 AND k = m - 1 AND l = a").select("lang", text(F.slice("w", F.lit(1), F.col("m") - 1)))).distinct()
    big = lambda c: F.col(c).cast("decimal(15,0)")
    exact = cuts.join(totals, "lang").withColumns({"over": big("a") * big("n") * F.lit(1000).cast("decimal(4,0)"), "under": big("l") * big("r")})
    exact = exact.withColumn("score", F.expr("over DIV under"))
    best = exact.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    return best.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score").join(inside, ["lang", "phrase"], "left_anti")


def top(candidates: DataFrame, most: int = TOP) -> DataFrame:
    """The first ``most`` of each language with ``rank``: by score, then count, both falling, then phrase in order of its bytes."""
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    return candidates.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= most).select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def collocations(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, size: int = SHARD) -> DataFrame:
    """``lang, phrase, a, l, r, n, score`` of all candidates that are not superfluous."""
    found = materialise(shards(docs, size, depth), "zstd")
    nodes = merged(runs(found, least, depth), least)
    totals = found.groupBy("lang").agg(F.sum("n_words").alias("n"))
    return scored(nodes, totals)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top(collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")))
