"""SimHash near-duplicates by anchor-point covering.

Fingerprints: words of the lower-cased text, 4-word shingles with repeats, XXH64 of each; a bit is
set where more than half of the hashes have it.

Covering: the 64 bits are cut into three fields of 22, 21 and 21 bits. Each field is read as a
point of the 23-bit space, whose anchors are the 4096 words of the binary Golay code. That code is
perfect: every point has exactly one anchor within its covering radius 3, its home. If two
fingerprints differ in at most 4 bits, they differ in at most 1 bit in one field, so there the home
of either lies within 3 + 1 of the other. Hence each fingerprint is sent, per field, to every anchor
within the covering radius plus that field's threshold (1 or 6 anchors, 5.3 on average), and per
anchor the fingerprints at home there are compared on all 64 bits with every fingerprint sent there.
No pair within the threshold is missed and none beyond it is linked.

Scale: equal fingerprints are folded into one first, so a group of exact copies costs one row.
There are at most 3 x 4096 anchors, so their counts can be broadcast; an anchor with more than
``CHUNK`` fingerprints is dealt out as blocks of homes against blocks of visitors, each block a unit
of its own. A unit returns a spanning forest of its links, at most one row per fingerprint, never
all pairs.

Defined cases: null text and text without words have fingerprint 0, linked like any other; fewer than
four words make one shingle; repeated rows share a component; rows without an id link like others and
never name a component (a component without any id is null); an empty table gives an empty result.
Only ``doc_id`` and ``text`` are read; columns of any other name pass through ``deduplicate``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.components import components
from ..storage import materialise

THRESHOLD = 4
SHINGLE = 4
CHUNK = 4096
FIELDS = ((0, 22), (22, 21), (43, 21))  #: (first bit, bits)
RADIUS = 3
GOLAY_POLYNOMIAL = 0b101011100011  #: fixed value: generator of the cyclic [23, 12, 7] code


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False))
    hashed = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in shingles), dtype=np.uint64)
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashed), 65536):  # bounds the unpacked bits of very long texts
        part = hashed[at : at + 65536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits((2 * ones > len(hashed)).astype(np.uint8), bitorder="little")
    return int(bits.view(np.uint64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``docs`` with ``_sim_fp`` (the fingerprint's bits as a signed long)."""
    at = docs.columns.index("text")
    schema = docs.select("*", F.lit(0).cast("long").alias("_sim_fp")).schema

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(at)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps)], names=[*batch.schema.names, "_sim_fp"])

    return docs.mapInArrow(add, schema)


def golay_words() -> np.ndarray:
    """The 4096 anchors: all multiples of the generator polynomial."""
    found = np.zeros(1, dtype=np.int64)
    for i in range(12):
        found = np.concatenate([found, found ^ (GOLAY_POLYNOMIAL << i)])
    return found


class Anchors:
    """Nearest anchors of 23-bit points, by the difference between a point and its home."""

    def __init__(self) -> None:
        words = golay_words()
        weight = np.bitwise_count(words.astype(np.uint32))
        sevens = words[weight == 7]
        single = 1 << np.arange(23)
        errors = [0, *single]
        errors += [a | b for i, a in enumerate(single) for b in single[i + 1 :]]
        errors += [a | b | c for i, a in enumerate(single) for j, b in enumerate(single[i + 1 :], i + 1) for c in single[j + 1 :]]
        self.home = np.full(1 << 23, -1, dtype=np.int32)
        for e in errors:
            self.home[words ^ e] = words
        # a point at distance 3 from home has the other anchors at distance 4: home + a word of weight 7 that covers the error
        self.others = {int(e): sevens[(sevens & e) == e] for e in errors if int(e).bit_count() == RADIUS}


_ANCHORS: list[Anchors] = []


def anchors() -> Anchors:
    if not _ANCHORS:
        _ANCHORS.append(Anchors())
    return _ANCHORS[0]


def visits(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each fingerprint its visits: (index of the fingerprint, field and anchor in one number, is it at home)."""
    table = anchors()
    index, cell, home = [], [], []
    for f, (first, bits) in enumerate(FIELDS):
        points = ((fps >> np.uint64(first)) & np.uint64((1 << bits) - 1)).astype(np.int64)
        homes = table.home[points].astype(np.int64)
        index.append(np.arange(len(fps)))
        cell.append((f << 23) | homes)
        home.append(np.ones(len(fps), dtype=bool))
        error = points ^ homes
        far = np.flatnonzero(np.bitwise_count(error.astype(np.uint32)) == RADIUS)
        if len(far):
            others = np.stack([table.others[int(e)] for e in error[far]])
            index.append(np.repeat(far, others.shape[1]))
            cell.append((f << 23) | (homes[far, None] ^ others).ravel())
            home.append(np.zeros(others.size, dtype=bool))
    return np.concatenate(index), np.concatenate(cell), np.concatenate(home)


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        index, cell, home = visits(fps)
        yield pa.RecordBatch.from_arrays(
            [pa.array(fps[index].view(np.int64)), pa.array(cell.astype(np.int32)), pa.array(home)], names=["fp", "cell", "home"]
        )


def forest(homes: np.ndarray, visitors: np.ndarray, threshold: int = THRESHOLD) -> np.ndarray:
    """Links between roots that connect whatever homes and visitors within the threshold connect: at most one a fingerprint."""
    points, index = np.unique(np.concatenate([homes, visitors]), return_inverse=True)
    home_at, visitor_at = index[: len(homes)], index[len(homes) :]
    label = np.arange(len(points))
    kept = []
    for at in range(0, len(homes), 256):
        near = np.bitwise_count(homes[at : at + 256, None] ^ visitors[None, :]) <= threshold
        for i in np.flatnonzero(near.sum(axis=1)):
            labels = np.unique(np.append(label[visitor_at[near[i]]], label[home_at[at + i]]))
            for other in labels[1:]:
                kept.append((points[other], points[labels[0]]))
            if len(labels) > 1:
                label[np.isin(label, labels[1:])] = labels[0]
    return np.array(kept, dtype=np.uint64).reshape(-1, 2)


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by unit; one unit at a time is held, of at most CHUNK homes and CHUNK visitors."""
    held: list[pa.RecordBatch] = []
    unit = None

    def links() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        fp, home = rows.column("fp").to_numpy().view(np.uint64), rows.column("home").to_numpy()
        out = forest(fp[home], fp[~home]).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        units = batch.column("unit").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(units)) + 1).tolist(), len(units)]
        for lo, hi in zip(cuts, cuts[1:], strict=False):
            if unit is not None and units[lo] != unit and held:
                yield links()
                held = []
            unit = units[lo]
            held.append(batch.slice(lo, hi - lo))
    if held:
        yield links()


def near_links(fps: DataFrame) -> DataFrame:
    """Links ``a, b`` that connect all of the distinct ``fp`` within the threshold of one another."""
    sent = materialise(fps.select("fp").mapInArrow(_send, "fp long, cell int, home boolean"))
    blocks = (
        sent.groupBy("cell")
        .agg(F.count_if("home").alias("homes"), F.count("*").alias("all"))
        .filter("homes > 0 AND all > 1")
        .select("cell", *[F.ceil(F.col(c) / CHUNK).cast("int").alias(c) for c in ("homes", "all")])
    )
    rows = sent.join(F.broadcast(blocks), "cell")  # at most 3 x 4096 rows: one per field and anchor
    block = lambda n: F.pmod(F.xxhash64("fp"), F.col(n)).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # a row at home is a home in every block of its row, and like every other row a visitor in every block of its column
    as_home = rows.filter("home").select("fp", "cell", "home", block("homes").alias("r"), all_of("all").alias("c"))
    as_visitor = rows.select("fp", "cell", F.lit(False).alias("home"), all_of("homes").alias("r"), block("all").alias("c"))
    parts = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return (
        as_home.union(as_visitor)
        .select("fp", "home", F.xxhash64("cell", "r", "c").alias("unit"))
        .repartition(parts, "unit")
        .sortWithinPartitions("unit")
        .mapInArrow(_compare, "a long, b long")
    )


def grouped(marked: DataFrame) -> DataFrame:
    """``fp, root, best`` per distinct fingerprint of ``marked`` (``doc_id, _sim_fp, _sim_key``).

    ``root`` names the component; ``best`` is the fingerprint's first row, as (no id, id, key).
    """
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"), F.col("_sim_key").alias("key"))
    fps = materialise(marked.groupBy(F.col("_sim_fp").alias("fp")).agg(F.min(first).alias("best")))
    roots = components(near_links(fps))
    return fps.join(roots, fps["fp"] == roots["node"], "left").select(
        "fp", F.coalesce(F.col("component"), F.col("fp")).alias("root"), "best"
    )


def _marked(docs: DataFrame) -> DataFrame:
    """``doc_id, _sim_fp, _sim_key`` of every row, written; the key is the digest of the text."""
    return materialise(fingerprints(docs.select("doc_id", "text")).select("doc_id", "_sim_fp", F.md5("text").alias("_sim_key")))


def assign(docs: DataFrame) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row of ``docs``."""
    marked = _marked(docs)
    by_fp = materialise(grouped(marked))
    smallest = by_fp.groupBy("root").agg(F.min("best").alias("least"))
    named = by_fp.join(smallest, "root").select("fp", F.col("least.doc_id").alias("component_id"))
    return marked.join(named, marked["_sim_fp"] == named["fp"]).select(
        "doc_id", F.lower(F.lpad(F.hex("_sim_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def deduplicate(docs: DataFrame) -> DataFrame:
    """The first row (smallest id) of each component, with the columns of ``docs``.

    A row is known by its id and the digest of its text, so texts are not written but shuffled once, whatever the size. Rows
    that share both are copies of one row: of a keeper that has some, one is kept by an aggregate that combines before it shuffles.
    """
    marked = _marked(docs)
    first = grouped(marked).groupBy("root").agg(F.min("best").alias("least"))
    rows = marked.groupBy("doc_id", "_sim_key").agg(F.count("*").alias("_sim_n"))
    same = rows["doc_id"].eqNullSafe(F.col("least.doc_id")) & rows["_sim_key"].eqNullSafe(F.col("least.key"))
    keepers = materialise(rows.join(first, same).select(F.col("doc_id").alias("_sim_id"), F.col("_sim_key").alias("_sim_text"), "_sim_n"))
    keyed = docs.withColumn("_sim_key", F.md5("text"))

    def of(found: DataFrame) -> DataFrame:
        here = keyed["doc_id"].eqNullSafe(found["_sim_id"]) & keyed["_sim_key"].eqNullSafe(found["_sim_text"])
        return keyed.join(found.hint("merge"), here, "left_semi")

    out = of(keepers.filter("_sim_n = 1"))
    copied = keepers.filter("_sim_n > 1")
    if not copied.isEmpty():
        out = out.union(of(copied).dropDuplicates(["doc_id", "_sim_key"]))
    return out.select(*[f"`{c}`" for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet"))
