"""Repair of gaps between dangling ends by a minimum spanning forest over components."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.functions.scalars import travel_time_s, weight_ds
from viaduct.operators.components import connected_components
from viaduct.operators.spatial import degrees, within_distance
from viaduct.session import stored

TOLERANCE_M, WIDE_TOLERANCE_M = 35.0, 250.0


def endpoint_pairs(nodes: DataFrame, edges: DataFrame, within_m: float = TOLERANCE_M, fallback_all: bool = False) -> DataFrame:
    """(graph_id, a, b, dist_m), a < b, of ends (degree of 1 at most) near each other.

    With ``fallback_all`` all nodes of a graph that has no end are taken.
    """
    found = degrees(nodes, edges)
    ends = found.filter("degree <= 1").select("graph_id", "node")
    if fallback_all:
        ends = ends.union(found.join(ends.select("graph_id").distinct(), "graph_id", "left_anti").select("graph_id", "node"))
    points = stored(nodes.join(ends, ["graph_id", "node"]).select("graph_id", "node", "lat", "lng"), "ends")
    return within_distance(points, points, within_m).filter("a < b")


def spanning_links(nodes: DataFrame, edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs that a shortest-first pass over components would add, by rounds of Boruvka.

    In each round every component takes its shortest pair to another one. The order (dist_m, a, b) is total, so the
    rounds give the same forest as taking all pairs in that order.
    """
    pairs = stored(pairs, "pairs")
    taken = pairs.limit(0)
    label = stored(connected_components(edges, nodes).withColumnRenamed("comp", "c"), "labels")
    while True:
        open_pairs = pairs.join(label.select("graph_id", F.col("node").alias("a"), F.col("c").alias("ca")), ["graph_id", "a"])
        open_pairs = open_pairs.join(label.select("graph_id", F.col("node").alias("b"), F.col("c").alias("cb")), ["graph_id", "b"]).filter("ca <> cb")
        sides = open_pairs.select("graph_id", F.col("ca").alias("c"), "dist_m", "a", "b").union(open_pairs.select("graph_id", "cb", "dist_m", "a", "b"))
        best = sides.groupBy("graph_id", "c").agg(F.min(F.struct("dist_m", "a", "b")).alias("x"))
        best = stored(best.select("graph_id", "x.a", "x.b", "x.dist_m").distinct(), "links")
        if best.isEmpty():
            return taken
        taken = stored(taken.unionByName(best), "taken")
        merged = best.join(label.select("graph_id", F.col("node").alias("a"), F.col("c").alias("src")), ["graph_id", "a"])
        merged = merged.join(label.select("graph_id", F.col("node").alias("b"), F.col("c").alias("dst")), ["graph_id", "b"])
        moved = connected_components(merged.select("graph_id", "src", "dst")).withColumnRenamed("node", "c")
        label = label.join(moved, ["graph_id", "c"], "left").select("graph_id", "node", F.coalesce("comp", "c").alias("c"))
        label = stored(label, "labels")


def heal_network(
    nodes: DataFrame, edges: DataFrame, within_m: float = TOLERANCE_M, road_class: str = "local", fallback_all: bool = False, enabled: bool = True,
    views: DataFrame | None = None,
) -> DataFrame:
    """``edges`` and the healing ones, with ``healed``; ids are heal-a-b.

    Not ``enabled`` adds none; ``views(graph_id, enabled)`` says so for each graph, and graphs it lacks are left as they are.
    """
    base = edges.withColumn("healed", F.lit(False))
    if not enabled:
        return base
    if views is not None:
        own = views.filter("enabled").select("graph_id").distinct()
        nodes, edges = nodes.join(own, "graph_id", "left_semi"), edges.join(own, "graph_id", "left_semi")
    links = spanning_links(nodes, edges, endpoint_pairs(nodes, edges, within_m, fallback_all))
    length = F.bround("dist_m", 1)
    new = links.select(
        "graph_id", F.concat_ws("-", F.lit("heal"), "a", "b").alias("edge_id"), F.col("a").alias("src"), F.col("b").alias("dst"),
        length.alias("length_m"), F.lit(road_class).alias("road_class"),
    ).withColumn("travel_time", travel_time_s("length_m", "road_class"))
    new = new.withColumn("w", weight_ds("travel_time")).withColumn("healed", F.lit(True))
    return base.unionByName(new, allowMissingColumns=True)
