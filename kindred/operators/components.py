"""Connected components of a link table, as joins and aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import materialise


def forest(links: list[tuple[int, int]]) -> dict[int, int]:
    """The smallest node that each node reaches, by union-find with halved paths."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = root[up]
            x = up
        return x

    for a, b in links:
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
    return {x: find(x) for x in list(root)}


def contracted(links: DataFrame) -> DataFrame:
    """Links of the same components (``a > b``): ranges of links, each reduced to a star per component that it sees.

    A task holds the nodes of its range. Ids that lie close together are often linked, so most of a component is joined here.
    """

    def contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = forest([pair for batch in batches for pair in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)])
        kept = [(a, b) for a, b in seen.items() if a != b]
        for at in range(0, len(kept), 100_000):
            a, b = zip(*kept[at : at + 100_000], strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])

    return links.repartitionByRange("b", "a").mapInArrow(contract, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``links`` (longs ``a``, ``b``); component is the smallest node.

    Links are contracted where they lie, then alternating stars run until every node hangs on a root: the large star hangs each node's larger neighbours on
    the smallest node it sees, the small star does so with the smaller ones. Minima are summed in part before each shuffle, and
    each round is written to the shared folder. The minima are written too: a join of two written tables is broadcast if one
    is small and otherwise an exchange per side, which adaptive execution splits where a root has very many nodes. Self links are kept out, repeated links and both directions are
    accepted, no links give no rows. The number of rounds grows with the logarithm of the longest path between ranges; there is no bound that ends them.
    """
    links = materialise(contracted(links.filter("a <> b").select(F.greatest("a", "b").cast("long").alias("a"), F.least("a", "b").cast("long").alias("b"))).distinct())
    while not settled(links):
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        least = materialise(least)
        large = materialise(both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct())
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")))
        pair = lambda x: F.struct(F.col(x).alias("a"), F.col("m").alias("b"))
        links = materialise(large.join(least, "a").select(F.explode(F.array(pair("a"), pair("b"))).alias("l")).select("l.a", "l.b").filter("a <> b").distinct())
    roots = links.select(F.col("b").alias("node")).distinct()
    return links.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def settled(links: DataFrame) -> bool:
    """Whether every node has one parent, and no parent has one."""
    roles = links.select(F.col("a").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).union(links.select("b", F.lit(0), F.lit(1)))
    nodes = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent"))
    return nodes.filter("child > 1 OR child = 1 AND parent = 1").isEmpty()
