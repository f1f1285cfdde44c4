"""Average path length similarity of two networks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.operators.paths import shortest_paths
from viaduct.operators.sampling import sample_pairs
from viaduct.operators.spatial import nearest_snap

PAIRS, SNAP_M, SEED = 500, 50.0, 0


def one_way(truth_nodes, truth_edges, nodes, edges, pairs: int, snap_m: float, seed: int, weight: str) -> DataFrame:
    """(graph_id, score, scored, routable): paths of sampled pairs of the truth against those between the snapped nodes.

    A pair scores max(0, 1 - |difference| / length); 0 if an end has no node nearby or the path is broken; 1 if the
    truth's length is 0. Pairs the truth does not join are skipped; a graph without any scores 0. ``routable`` counts the
    pairs that are joined here too.
    """
    drawn = sample_pairs(truth_nodes, 4 * pairs, seed, pairs)
    want = shortest_paths(truth_edges, drawn.select("graph_id", "s"), weight).withColumnRenamed("dist", "want")
    want = drawn.join(want.withColumnRenamed("v", "t"), ["graph_id", "s", "t"])
    snap = nearest_snap(truth_nodes, nodes, snap_m).select("graph_id", "node", "snapped")
    placed = want.join(snap.toDF("graph_id", "s", "ps"), ["graph_id", "s"]).join(snap.toDF("graph_id", "t", "pt"), ["graph_id", "t"])
    starts = placed.filter("ps is not null").select("graph_id", F.col("ps").alias("s"))
    have = shortest_paths(edges, starts, weight).toDF("graph_id", "ps", "pt", "have")
    scored = placed.join(have, ["graph_id", "ps", "pt"], "left")
    score = F.when(F.col("have").isNull(), 0.0).when(F.col("want") <= 0, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - F.abs(F.col("have") - F.col("want")) / F.col("want")))
    found = scored.groupBy("graph_id").agg(F.avg(score).alias("score"), F.count(F.lit(1)).alias("scored"), F.count("have").alias("routable"))
    graphs = truth_nodes.select("graph_id").distinct()
    return graphs.join(found, "graph_id", "left").select("graph_id", F.coalesce("score", F.lit(0.0)).alias("score"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("scored", "routable")])


def apls(truth_nodes, truth_edges, nodes, edges, pairs: int = PAIRS, snap_m: float = SNAP_M, symmetric: bool = True, seed: int = SEED, weight: str = "mm") -> DataFrame:
    """(graph_id, apls): one way, or the mean of both ways; ``weight`` holds whole millimetres."""
    there = one_way(truth_nodes, truth_edges, nodes, edges, pairs, snap_m, seed, weight)
    if not symmetric:
        return there.select("graph_id", F.col("score").alias("apls"))
    back = one_way(nodes, edges, truth_nodes, truth_edges, pairs, snap_m, seed, weight)
    return there.join(back.select("graph_id", F.col("score").alias("other")), "graph_id", "left").select("graph_id", ((F.col("score") + F.coalesce("other", F.lit(0.0))) / 2).alias("apls"))


def routable_share(truth_nodes, truth_edges, nodes, edges, pairs: int = PAIRS, snap_m: float = SNAP_M, seed: int = SEED, weight: str = "mm") -> DataFrame:
    """(graph_id, routes, routable, share): how many of the truth's sampled routes have any way here; null without routes."""
    found = one_way(truth_nodes, truth_edges, nodes, edges, pairs, snap_m, seed, weight)
    return found.select("graph_id", F.col("scored").alias("routes"), "routable", F.when(F.col("scored") > 0, F.col("routable") / F.col("scored")).alias("share"))
