"""Connected components of many graphs at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from viaduct.session import drop_stored, observed

MOST_ROUNDS = 100
#: Edges whose components a task finds at once before the first round.
TASK_EDGES = 1 << 18


def connected_components(edges: DataFrame, nodes: DataFrame | None = None, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(graph_id, node, comp) of undirected ``edges(graph_id, src, dst)``; ``comp`` is the least node of a component.

    Large-star and small-star rounds (Kiveris et al. 2014): each attaches the neighbours of a node to the least of
    them, so long paths shrink quickly and a node with very many neighbours is only ever aggregated, never collected.
    ``nodes(graph_id, node)`` adds isolated nodes. Self-loops and rows with null ends are ignored.
    """
    own = component_stars(edges, most_rounds)
    ends = edges.filter(F.col("src").isNotNull() & F.col("dst").isNotNull())
    every = ends.select("graph_id", F.col("src").alias("node")).union(ends.select("graph_id", "dst"))
    if nodes is not None:
        every = every.union(nodes.select("graph_id", "node"))
    every = every.distinct()
    return every.join(own.withColumnRenamed("a", "node"), ["graph_id", "node"], "left").select(
        "graph_id", "node", F.coalesce("b", "node").alias("comp")
    )


def component_stars(edges: DataFrame, most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(graph_id, a, b): every node but the least of its component, with that least node.

    A node that very many edges share is split by Spark's own handling of skewed joins; nothing gathers its neighbours.
    """
    own = edges.filter("src <> dst").select("graph_id", F.greatest("src", "dst").alias("a"), F.least("src", "dst").alias("b"))
    own, mark = _marked(_starred(own))
    for _ in range(most_rounds):
        before, last = own, mark
        own, mark = _marked(_small_star(_large_star(own)))
        drop_stored(before)
        if mark == last:
            return own
    raise RuntimeError(f"components did not settle within {most_rounds} rounds")


def _starred(edges: DataFrame) -> DataFrame:
    """Edges with the same components, found among those of nearby nodes: each of these nodes with the least it reaches.

    Tasks get ranges of nodes, so of a network whose ids follow its streets little but the borders of ranges is left.
    """
    shape = edges.schema

    def star(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= TASK_EDGES:
                yield from _stars(pa.Table.from_batches(held)).cast(to_arrow_schema(shape)).to_batches()
                held = []
        if held:
            yield from _stars(pa.Table.from_batches(held)).cast(to_arrow_schema(shape)).to_batches()

    return edges.repartitionByRange("graph_id", "b").sortWithinPartitions("graph_id", "b").mapInArrow(star, shape)


def _stars(edges: pa.Table) -> pa.Table:
    ends = [pa.table({"graph_id": edges.column("graph_id"), "v": edges.column(c)}) for c in ("a", "b")]
    nodes = pa.concat_tables(ends).combine_chunks().group_by(["graph_id", "v"]).aggregate([]).sort_by([("graph_id", "ascending"), ("v", "ascending")])
    nodes = nodes.append_column("i", pa.array(np.arange(len(nodes))))
    place = edges.append_column("row", pa.array(np.arange(len(edges))))
    u, v = (place.join(nodes, ["graph_id", c], ["graph_id", "v"]).sort_by("row").column("i").to_numpy() for c in ("a", "b"))
    root = np.arange(len(nodes))
    while True:
        u, v = root[u], root[v]
        apart = u != v
        if not apart.any():
            break
        u, v = u[apart], v[apart]
        np.minimum.at(root, np.maximum(u, v), np.minimum(u, v))
        while not np.array_equal(up := root[root], root):
            root = up
    low = np.flatnonzero(root != np.arange(len(nodes)))
    far, near = nodes.take(pa.array(low)), nodes.take(pa.array(root[low]))
    return pa.table({"graph_id": far.column("graph_id"), "a": far.column("v"), "b": near.column("v")})


def _marked(edges: DataFrame) -> tuple[DataFrame, dict]:
    """``edges``, stored, and their number and a hash of them all."""
    return observed(edges, "edges", n=F.count(F.lit(1)), hash=F.bit_xor(F.xxhash64("graph_id", "a", "b")))


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("graph_id", "b", "a"))
    least = both.groupBy("graph_id", "a").agg(F.min("b").alias("m"))
    larger = both.filter(F.col("b") > F.col("a")).join(least, ["graph_id", "a"])
    return larger.select("graph_id", F.col("b").alias("a"), F.least("m", "a").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("graph_id", "a").agg(F.min("b").alias("m"))
    moved = edges.join(least, ["graph_id", "a"]).filter(F.col("b") != F.col("m")).select("graph_id", F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least).distinct()
