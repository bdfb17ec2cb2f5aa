"""Best-fit packing of documents into sequences of ``CAPACITY`` tokens, each closed by an end token.

Lengths are whole numbers up to the capacity, so the packing of any corpus is decided on its histogram: one counter per length.
Large items, above a third of the capacity, share a sequence two at most: from the longest down each is matched with the longest one
that still fits beside it, all items of a length at once. The smaller ones follow by length and best fit: the sequences with the
smallest sufficient gap are filled first, again a whole class of equal sequences at once, so the result is that of
taking the documents one by one. The plan is a list of intervals: the items of length s whose number is in [from, to) lie k a
sequence in the sequences from ``base`` on. It has at most a few per length and gap class, whatever the corpus holds.

Scale: texts are tokenised where they are read and only (id, place, length, digest) per piece is written. A task numbers its own pieces of
each length; counts per task and length shift these numbers, so no length is gathered in one place, a hot one neither. The driver
holds ``CAPACITY`` counters and the plan.

Token ids are those of the vocabulary file for ``tokenizers``: its pairs of bytes in the faster of two libraries for it (a test holds the
two equal); an end-of-text mark inside a text is the one special token there.

Defined cases: null text is an empty one, the end token alone; repeated rows are packed each; a document longer than the capacity
is cut into full pieces, of which the first may be shorter; texts are tokenised in pieces of bounded size that have the same tokens
apart; an empty table gives an empty result; rows without an id keep null; other columns are not read.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import materialise
from .training_order import END_ID as SPECIAL_ID
from .training_order import VOCABULARY, encoder, pieces

CAPACITY = 1024
END_ID = 2
SPECIAL = "<|endoftext|>"


def ids_of(text: str | None, path: str = VOCABULARY) -> array:
    """The ids of a text and the end token, as unsigned 32-bit numbers."""
    encode = encoder(path).encode_ordinary
    out = array("I")
    for k, part in enumerate((text or "").split(SPECIAL)):
        if k:
            out.append(SPECIAL_ID)
        for piece in pieces(part):
            out.extend(encode(piece))
    out.append(END_ID)
    return out


def cuts(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, end) of the pieces of ``n`` tokens: full ones, behind a first one that has the rest."""
    first = n % capacity or capacity
    return [(max(end - capacity, 0), end) for end in range(first, n + 1, capacity)]


def cut_pieces(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32`` per piece, and ``part, nth``: its number among the pieces of its length in the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), [0] * (capacity + 1)
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                rows = []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                    ids = ids_of(text.as_py(), path)
                    blob, width = ids.tobytes(), ids.itemsize
                    for k, (a, b) in enumerate(cuts(len(ids), capacity)):
                        rows.append((doc_id, k, a, b - a, zlib.crc32(blob[a * width : b * width]), part, seen[b - a]))
                        seen[b - a] += 1
                columns = zip(*rows, strict=True)
                types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long, part int, nth long")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """Classes of equal sequences, (how many, [(length, how many of it in each), ...]), for ``counts`` items of each length."""
    left = [0] * (capacity + 1)
    for length, n in counts.items():
        left[length] = n
    third = capacity // 3
    classes: list[tuple[int, int, list]] = []  # gap, how many, contents
    partner = capacity
    for s in range(capacity, third, -1):
        partner = min(capacity - s, s)
        while left[s]:
            while partner > third and not left[partner]:
                partner -= 1
            if partner <= third or (partner == s and left[s] == 1):
                if partner == s:  # the last one of its length: a shorter one may fit
                    partner -= 1
                    continue
                classes.append((capacity - s, left[s], [(s, 1)]))
                left[s] = 0
            elif partner == s:
                classes.append((capacity - 2 * s, left[s] // 2, [(s, 2)]))
                left[s] %= 2
            else:
                n = min(left[s], left[partner])
                classes.append((capacity - s - partner, n, [(s, 1), (partner, 1)]))
                left[s] -= n
                left[partner] -= n
    by_gap: list[list[tuple[int, list]]] = [[] for _ in range(capacity + 1)]
    for gap, n, inside in classes:
        by_gap[gap].append((n, inside))
    for s in range(third, 0, -1):
        gap = s
        while left[s]:
            while gap < capacity and not by_gap[gap]:
                gap += 1
            k = gap // s
            if gap == capacity:  # none has room: new sequences
                n, inside = -(-left[s] // k), []
            else:
                n, inside = by_gap[gap].pop()
            full = min(n, left[s] // k)
            rest = left[s] - full * k if full < n else 0
            if full:
                by_gap[gap - k * s].append((full, [*inside, (s, k)]))
            if rest:
                by_gap[gap - rest * s].append((1, [*inside, (s, rest)]))
            if inside and (untouched := n - full - (rest > 0)):
                by_gap[gap].append((untouched, inside))
            left[s] -= full * k + rest
    return [group for groups in by_gap for group in groups]


def intervals(classes: list[tuple[int, list[tuple[int, int]]]]) -> dict[str, np.ndarray]:
    """The plan by item: ``length, first`` (number of the interval's first item), ``base`` (sequence), ``offset`` in it and ``k`` items a sequence, sorted."""
    taken: dict[int, int] = {}
    rows, base = [], 0
    for n, inside in classes:
        offset = 0
        for length, k in inside:
            first = taken.get(length, 0)
            rows.append((length, first, base, offset, k))
            taken[length] = first + n * k
            offset += length * k
        base += n
    table = np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)
    return dict(zip(("length", "first", "base", "offset", "k"), table.T, strict=True))


def pack(docs: DataFrame, capacity: int = CAPACITY, path: str = VOCABULARY) -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32, sequence_id, offset`` per piece."""
    cut = materialise(cut_pieces(docs, capacity, path), "zstd")
    some = cut.groupBy("part", "length").count()
    counts = materialise(some)
    total = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most one row per length
    by = intervals(plan(total, capacity))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = np.searchsorted(by["length"], np.arange(capacity + 2))
        for batch in batches:
            length, number = (batch.column(c).to_numpy() for c in ("length", "number"))
            at = np.empty(len(length), dtype=np.int64)
            for s in np.unique(length):
                own = length == s
                first = by["first"][starts[s] : starts[s + 1]]
                at[own] = starts[s] + np.searchsorted(first, number[own], side="right") - 1
            nth = number - by["first"][at]
            sequence, offset = by["base"][at] + nth // by["k"][at], by["offset"][at] + nth % by["k"][at] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    kept = ["doc_id", "piece", "start", "length", "ids_crc32"]
    numbered = cut.join(shifts, ["part", "length"]).select(*kept, (F.col("shift") + F.col("nth")).alias("number"))
    return numbered.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"))
