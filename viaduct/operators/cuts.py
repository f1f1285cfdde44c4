"""Bridges and articulation points by blocks of a spanning tree (Tarjan and Vishkin 1985).

The tree is any spanning tree, found by hooking and rooted by its Euler tour, so no step follows the network's diameter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.operators.components import connected_components
from viaduct.operators.forest import euler_tour, simple_pairs, spanning_forest
from viaduct.session import drop_stored, observed, stored

K = "graph_id"


def _jumps(tree: DataFrame) -> list[DataFrame]:
    """(graph_id, v, j) with j the ancestor 1, 2, 4, ... levels above, one stored table for each, until there is none."""
    jump, seen = observed(tree.filter("parent is not null").select(K, "v", F.col("parent").alias("j")), "jump")
    jumps: list[DataFrame] = []
    while seen["n"]:
        jumps.append(jump)
        jump, seen = observed(jump.join(jump.select(K, F.col("v").alias("j"), F.col("j").alias("k")), [K, "j"]).select(K, "v", F.col("k").alias("j")), "jump")
    return jumps


def _from_below(values: DataFrame, jumps: list[DataFrame], how: dict) -> DataFrame:
    """``values(graph_id, v, ...)`` aggregated over all descendants of v and v itself.

    What covers 2^i levels below every node, taken at v and at the nodes 2^i levels below v, covers 2^(i+1); so there
    are as many rounds as the depth has bits, and never more rows than nodes.
    """
    for jump in jumps:
        below = values.join(jump, [K, "v"]).select(K, F.col("j").alias("v"), *how)
        before, values = values, stored(values.unionByName(below).groupBy(K, "v").agg(*[f(c).alias(c) for c, f in how.items()]), "below")
        drop_stored(before)
    return values


def blocks(edges: DataFrame) -> DataFrame:
    """(graph_id, src, dst, block) of every simple edge; a block is named by the least lower end of its tree edges."""
    simple = stored(simple_pairs(edges), "simple")
    forest, labels = spanning_forest(simple)
    nodes = euler_tour(forest, labels)
    jumps = _jumps(nodes)
    others = simple.join(forest, [K, "src", "dst"], "left_anti")
    ends = nodes.select(K, "v", "first", "last")
    spans = others.join(ends.toDF(K, "src", "first_a", "last_a"), [K, "src"]).join(ends.toDF(K, "dst", "first_b", "last_b"), [K, "dst"])
    # u is the end that the tour meets first; times of different trees are never compared, as an edge lies in one
    ahead = F.col("first_a") < F.col("first_b")
    spans = spans.select(
        K, F.when(ahead, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(ahead, F.col("dst")).otherwise(F.col("src")).alias("x"),
        F.least("first_a", "first_b").alias("first_u"), F.when(ahead, F.col("last_a")).otherwise(F.col("last_b")).alias("last_u"),
        F.greatest("first_a", "first_b").alias("first_x"),
    )
    spans = stored(spans, "spans")
    touched = spans.select(K, F.col("u").alias("v"), F.col("first_x").alias("t")).union(spans.select(K, "x", "first_u")).union(nodes.select(K, "v", "first"))
    touched = stored(touched.groupBy(K, "v").agg(F.min("t").alias("low"), F.max("t").alias("high")), "touched")
    reach = _from_below(touched, jumps, {"low": F.min, "high": F.max})
    apart = spans.filter("last_u < first_x").select(K, F.col("u").alias("src"), F.col("x").alias("dst"))
    upper = nodes.select(K, F.col("v").alias("parent"), F.col("first").alias("first_p"), F.col("last").alias("last_p"), F.col("parent").alias("top"))
    leaves = nodes.filter("parent is not null").join(reach, [K, "v"]).join(upper, [K, "parent"]).filter("top is not null")
    past = leaves.filter("low < first_p or high > last_p").select(K, F.col("v").alias("src"), F.col("parent").alias("dst"))
    lower = nodes.filter("parent is not null").select(K, F.col("v").alias("node"))
    named = connected_components(apart.union(past), lower)
    own = nodes.filter("parent is not null").select(K, F.col("v").alias("node"), F.least("v", "parent").alias("src"), F.greatest("v", "parent").alias("dst"))
    own = own.unionByName(spans.select(K, F.col("x").alias("node"), F.least("u", "x").alias("src"), F.greatest("u", "x").alias("dst")))
    found = stored(own.join(named, [K, "node"]).select(K, "src", "dst", F.col("comp").alias("block")), "blocks")
    drop_stored(*jumps)
    return found


def bridges(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(graph_id, src, dst) of the edges whose removal parts a component; parallel edges count as one."""
    own = found if found is not None else blocks(edges)
    alone = own.groupBy(K, "block").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return own.join(alone, [K, "block"]).select(K, "src", "dst")


def articulation_points(edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(graph_id, node) of the nodes in two blocks or more."""
    own = found if found is not None else blocks(edges)
    ends = own.select(K, F.col("src").alias("node"), "block").union(own.select(K, "dst", "block"))
    return ends.groupBy(K, "node").agg(F.count_distinct("block").alias("n")).filter("n > 1").select(K, "node")
