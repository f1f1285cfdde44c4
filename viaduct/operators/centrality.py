"""Weighted betweenness of nodes and edges (Brandes 2001) on DataFrames.

The edges on shortest paths from a source form an acyclic graph. Path counts are pushed forward along it, by blocks of
nodes (``block_flows``); the dependencies, divided by path counts, are a linear sum that is pushed backward in the same
way. Each target is worth 1, or what a table of demand says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.operators.block_flows import Flows
from viaduct.operators.exact_sums import all_loads
from viaduct.operators.paths import all_pairs, both_ways, shortest_paths
from viaduct.session import stored

KEY = ["graph_id", "s"]


def tight_steps(edges: DataFrame, dist: DataFrame, weight: str = "w") -> DataFrame:
    """(graph_id, s, src, dst), stored: the steps on shortest paths from each source; weights must be positive."""
    steps = both_ways(positive(edges, weight), weight)
    here = dist.select("graph_id", "s", F.col("v").alias("src"), F.col("dist").alias("d0"))
    there = dist.select("graph_id", "s", F.col("v").alias("dst"), F.col("dist").alias("d1"))
    tight = here.join(steps, ["graph_id", "src"]).join(there, [*KEY, "dst"]).filter("d0 + w = d1").select(*KEY, "src", "dst")
    return stored(tight, "tight")


def positive(edges: DataFrame, weight: str = "w") -> DataFrame:
    """``edges``, whose weights must be positive."""
    zero = edges.filter(F.col(weight) <= 0)
    if not zero.isEmpty():
        raise ValueError(f"betweenness needs positive weights; the first edge without is {zero.first()}")
    return edges


def _loads(edges: DataFrame, dist: DataFrame, weight: str, demand: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    flows = Flows(stored(both_ways(positive(edges, weight), weight), "steps"), dist)
    found = flows.loads(demand)
    flows.drop()
    return found


def betweenness(nodes: DataFrame, edges: DataFrame, dist: DataFrame | None = None, weight: str = "w") -> tuple[DataFrame, DataFrame]:
    """(graph_id, node, betweenness) and (graph_id, src, dst, betweenness) from every node as a source, or from those of ``dist``.

    Normalised as for undirected graphs; endpoints do not count. Nodes and edges on no path have 0. From ``dist`` of
    sampled sources the sums are scaled up to all. Without it tasks share the network, if it fits there, and no distances
    become rows.
    """
    n = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).cast("double").alias("n"))
    found = all_loads(positive(edges, weight), weight) if dist is None else None
    if found:
        passed, used, _ = found
        up = F.lit(1.0)
    else:
        dist = stored(all_pairs(nodes, edges, weight) if dist is None else dist, "dist")
        passed, used = _loads(edges, dist, weight)
        n = n.join(dist.filter("s = v").groupBy("graph_id").agg(F.count(F.lit(1)).alias("k")), "graph_id", "left")
        up = F.col("n") / F.coalesce(F.col("k"), F.col("n"))
    scale = F.when(F.col("n") > 2, 1 / ((F.col("n") - 1) * (F.col("n") - 2))).otherwise(0.0)
    of_nodes = nodes.select("graph_id", "node").join(passed, ["graph_id", "node"], "left").join(n, "graph_id")
    of_nodes = of_nodes.select("graph_id", "node", (F.coalesce("raw", F.lit(0.0)) * scale * up).alias("betweenness"))
    pairs = edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    scale = F.when(F.col("n") > 1, 1 / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
    of_edges = pairs.join(used, ["graph_id", "src", "dst"], "left").join(n, "graph_id")
    return of_nodes, of_edges.select("graph_id", "src", "dst", (F.coalesce("raw", F.lit(0.0)) * scale * up).alias("betweenness"))


def demand_loads(nodes: DataFrame, edges: DataFrame, demand: DataFrame, weight: str = "w") -> tuple[DataFrame, DataFrame]:
    """(graph_id, node, load, share) and (graph_id, src, dst, load, share): what of ``demand`` passes a node or an edge.

    ``demand(graph_id, s, t, demand)`` is split evenly over all shortest paths of a pair; rows of one pair are added up,
    rows of a pair that no path joins, of s = t, or not above 0 carry nothing. ``share`` is of all that is carried, so
    for a demand of 1 for every ordered pair of a connected network it is the normalised betweenness of edges. The ends of
    a trip do not load themselves. Paths start only where demand does.
    """
    own = demand.filter("s <> t and demand > 0").groupBy("graph_id", "s", F.col("t").alias("v")).agg(F.sum("demand").cast("double").alias("demand"))
    own = stored(own, "demand")
    found = all_loads(positive(edges, weight), weight, own)
    if found:
        return _shared(nodes, edges, *(t.withColumnRenamed("raw", "load") for t in found))
    dist = stored(shortest_paths(edges, own.select("graph_id", "s").distinct(), weight), "dist")
    carried = stored(own.join(dist, [*KEY, "v"]).select(*KEY, "v", "demand"), "carried")
    passed, used = (t.withColumnRenamed("raw", "load") for t in _loads(edges, dist, weight, carried))
    total = carried.groupBy("graph_id").agg(F.sum("demand").alias("total"))
    return _shared(nodes, edges, passed, used, total)


def _shared(nodes: DataFrame, edges: DataFrame, passed: DataFrame, used: DataFrame, total: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Loads of all nodes and edges, and their shares of all that is carried."""
    pairs = edges.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    out = []
    for rows, found, names in ((nodes.select("graph_id", "node"), passed, ["node"]), (pairs, used, ["src", "dst"])):
        loaded = rows.join(found, ["graph_id", *names], "left").join(total, "graph_id", "left").withColumn("load", F.coalesce("load", F.lit(0.0)))
        out.append(loaded.select("graph_id", *names, "load", F.when(F.col("total") > 0, F.col("load") / F.col("total")).otherwise(0.0).alias("share")))
    return out[0], out[1]
