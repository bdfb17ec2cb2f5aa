"""Sharding by a hierarchical weighted hash tree.

The tree has three levels: regions, racks, shards. A document descends it: at each level every
child draws ``-ln(u) / weight`` with ``u`` hashed from the document's id and the child's name, and
the smallest draw wins, so children are chosen in proportion to the weight below them. A child that
gets lighter only loses rows: if a shard's weight falls, a row that moves leaves that shard, or its
rack, or its region, for another child of the same parent; no row moves between two children whose
weights stayed, and none comes in (a heavier child only gains, likewise). ``grow`` adds
a shard in a region of its own: no older draw changes, so rows move into the new shard only (the
law ``key``).

Slots number the rows of each shard from 0 without gaps. Rows of a shard are split over
``SLOT_BUCKETS`` hashed buckets, each numbered by itself and shifted by the count of the buckets
before it, so no task numbers a whole shard.

Defined cases: null text counts as no bytes (size 1, checksum 0); a null id draws as one key of its
own; exactly repeated rows share a shard and take neighbouring slots; ties of draws fall to the
lower child; an empty table gives an empty result. Extra columns pass through ``place`` untouched:
internal columns carry the prefix ``_shard_``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialise

Tree = tuple[tuple[tuple[tuple[int, float], ...], ...], ...]  #: regions of racks of (shard, weight)

SHARDS = 16
SLOT_BUCKETS = 1024


def uniform_tree(shards: int = SHARDS, rack: int = 4, region: int = 2) -> Tree:
    """Shards of weight 1, ``rack`` to a rack, ``region`` racks to a region."""
    racks = [tuple((s, 1.0) for s in range(at, min(at + rack, shards))) for at in range(0, shards, rack)]
    return tuple(tuple(racks[at : at + region]) for at in range(0, len(racks), region))


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """One more shard, in a new region."""
    new = 1 + max(s for region in tree for rack in region for s, _ in rack)
    return (*tree, (((new, weight),),))


def _literal(rows: list[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(w)).alias("weight")) for n, w in rows])


def _descend(key: Column, level: str, parent: Column, children: Column) -> Column:
    def draw(child: Column) -> Column:
        bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(level), parent, child["name"]), 11)
        u = (bits.cast("double") + 0.5) / float(2**53)
        return F.struct((-F.log(u) / child["weight"]).alias("draw"), child["name"].alias("name"))

    return F.array_min(F.transform(children, draw))["name"]


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard of ``key``."""
    rack_weight = lambda rack: sum(w for _, w in rack)
    region = _descend(key, "region", F.lit(-1), _literal([(i, sum(map(rack_weight, x))) for i, x in enumerate(tree)]))
    racks = F.array(*[_literal([(j, rack_weight(y)) for j, y in enumerate(x)]) for x in tree])
    shards = F.array(*[F.array(*[_literal(list(y)) for y in x]) for x in tree])

    def place(path: Column) -> Column:
        rack = F.element_at(F.element_at(shards, path["region"] + 1), path["rack"] + 1)
        return _descend(key, "shard", path["region"] * 65536 + path["rack"], rack)

    # one-element arrays name the result of a level, so that the next level does not repeat its draws
    with_rack = F.transform(
        F.array(region),
        lambda r: F.struct(r.alias("region"), _descend(key, "rack", r, F.element_at(racks, r + 1)).alias("rack")),
    )
    return F.element_at(F.transform(with_rack, place), 1)


def place(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``docs`` with ``_shard_size, _shard_crc, _shard_shard, _shard_grown, _shard_bucket`` added."""
    tree = tree or uniform_tree()
    text = F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8")
    return (
        docs.withColumn("_shard_size", (F.octet_length(text) + 1).cast("long"))
        .withColumn("_shard_crc", F.crc32(text))
        .withColumn("_shard_shard", shard_of(F.col("doc_id"), tree))
        .withColumn("_shard_grown", shard_of(F.col("doc_id"), grow(tree)))
        .withColumn("_shard_bucket", F.pmod(F.xxhash64("doc_id", "_shard_crc", "_shard_size"), F.lit(SLOT_BUCKETS)).cast("int"))
    )


def number(placed: DataFrame) -> DataFrame:
    """Adds ``_shard_slot``. The table of offsets has at most shards x SLOT_BUCKETS rows, so it may be broadcast."""
    before = Window.partitionBy("_shard_shard").orderBy("_shard_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        placed.groupBy("_shard_shard", "_shard_bucket")
        .count()
        .select("_shard_shard", "_shard_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_shard_offset"))
    )
    within = Window.partitionBy("_shard_shard", "_shard_bucket").orderBy("doc_id", "_shard_crc", "_shard_size")
    return (
        placed.withColumn("_shard_row", F.row_number().over(within))
        .join(F.broadcast(offsets), ["_shard_shard", "_shard_bucket"])
        .withColumn("_shard_slot", (F.col("_shard_offset") + F.col("_shard_row") - 1).cast("long"))
    )


def assign(docs: DataFrame, tree: Tree | None = None) -> DataFrame:
    """``docs`` with ``shard`` and ``slot``; columns of those names in ``docs`` are replaced."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    out = number(place(docs.select(*[f"`{c}`" for c in kept]), tree))
    return out.select(*[f"`{c}`" for c in kept], F.col("_shard_shard").alias("shard"), F.col("_shard_slot").alias("slot"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return number(materialise(place(docs).drop("text"))).select(
        "doc_id",
        F.col("_shard_size").alias("size"),
        F.col("_shard_crc").alias("text_crc32"),
        F.lit("key").alias("law"),
        F.col("_shard_shard").alias("shard"),
        F.col("_shard_slot").alias("slot"),
        F.col("_shard_grown").alias("grown_shard"),
    )
