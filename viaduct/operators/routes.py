"""Shortest routes themselves, edge by edge, and the routes that closures break."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.operators.block_flows import Flows
from viaduct.operators.centrality import positive
from viaduct.operators.paths import both_ways, shortest_paths
from viaduct.session import drop_stored, observed, stored

KEY = ["graph_id", "s"]


def predecessors(edges: DataFrame, dist: DataFrame, pairs: DataFrame, weight: str = "w") -> DataFrame:
    """(graph_id, s, v, parent, edge_id), stored: the steps on one shortest path to each of ``pairs(graph_id, s, t)``.

    Of all steps on shortest paths into a node the one from the least node counts, and of its parallel edges the least id
    among the lightest; so the steps of a source form a tree. They are followed back by blocks (``block_flows``), so only
    those that routes use become rows.
    """
    flows = Flows(stored(both_ways(positive(edges, weight), weight), "steps"), dist, least=True)
    parent = flows.ways_to(pairs.join(dist.select(*KEY, F.col("v").alias("t")), [*KEY, "t"], "left_semi").select(*KEY, F.col("t").alias("v")))
    flows.drop()
    ends = edges.select("graph_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), F.struct(F.col(weight).alias("w"), F.col("edge_id")).alias("x"))
    keyed = parent.withColumns({"a": F.least("v", "parent"), "b": F.greatest("v", "parent")})
    ends = ends.join(keyed.select("graph_id", "a", "b").distinct(), ["graph_id", "a", "b"], "left_semi")
    best = ends.groupBy("graph_id", "a", "b").agg(F.min("x").alias("x")).select("graph_id", "a", "b", "x.edge_id")
    return stored(keyed.join(best, ["graph_id", "a", "b"]).select(*KEY, "v", "parent", "edge_id"), "parents")


def route_steps(pairs: DataFrame, parents: DataFrame) -> DataFrame:
    """(route, graph_id, step, src, dst, edge_id), stored: the steps of ``pairs(route, graph_id, s, t)``, from 1.

    Routes are unrolled by doubling: with the ancestors 1, 2, 4, ... steps up at hand, those of a route are found from
    the farthest jump down, each jump doubling how many are known. So there are as many rounds as the longest route has
    bits, and as many rows at the end as there are steps. A pair without a path, or of one node, has no steps.
    """
    up, seen = observed(parents.select(*KEY, "v", F.col("parent").alias("j")), "up")
    jumps = []
    while seen["n"]:
        jumps.append(up)
        up, seen = observed(up.join(up.select(*KEY, F.col("v").alias("j"), F.col("j").alias("k")), [*KEY, "j"]).select(*KEY, "v", F.col("k").alias("j")), "up")
    known = stored(pairs.select("route", *KEY, F.col("t").alias("v"), F.lit(0).cast("long").alias("back")), "route")
    for k, jump in reversed(list(enumerate(jumps))):
        more = known.join(jump, [*KEY, "v"]).select("route", *KEY, F.col("j").alias("v"), (F.col("back") + (1 << k)).alias("back"))
        before, known = known, stored(known.unionByName(more), "route")
        drop_stored(before)
    steps = known.join(parents, [*KEY, "v"])
    length = steps.groupBy("route", "graph_id").agg(F.max("back").alias("last"))
    found = steps.join(length, ["route", "graph_id"]).select("route", "graph_id", (F.col("last") - F.col("back") + 1).alias("step"), F.col("parent").alias("src"), F.col("v").alias("dst"), "edge_id")
    found = stored(found, "routes")
    drop_stored(known, *jumps)
    return found


def routes(edges: DataFrame, pairs: DataFrame, weight: str = "w") -> DataFrame:
    """``route_steps`` of ``pairs(route, graph_id, s, t)`` over ``edges(graph_id, edge_id, src, dst, w)``."""
    dist = stored(shortest_paths(edges, pairs.select("graph_id", "s").distinct(), weight), "dist")
    return route_steps(pairs, predecessors(edges, dist, pairs, weight))


def listed(steps: DataFrame) -> DataFrame:
    """(route, graph_id, edge_ids): each route as one array, in order; for routes that fit into a row."""
    own = steps.groupBy("route", "graph_id").agg(F.sort_array(F.collect_list(F.struct("step", "edge_id"))).alias("x"))
    return own.select("route", "graph_id", F.col("x.edge_id").alias("edge_ids"))


def broken_routes(steps: DataFrame, pairs: DataFrame, closures: DataFrame) -> DataFrame:
    """(scenario_id, graph_id, route, first_step): routes that run over a closed edge or node, and where they do first.

    ``closures(scenario_id, graph_id, kind, id)`` has kind edge or node; a closed node breaks the routes that begin, end
    or pass there. Unknown ids break nothing, and a pair without a route has none to break.
    """
    shut = closures.select("scenario_id", "graph_id", "kind", F.col("id").cast("string").alias("id")).distinct()
    over = steps.select("graph_id", "route", "step", F.explode(F.array(
        F.struct(F.lit("edge").alias("kind"), F.col("edge_id").cast("string").alias("id")),
        F.struct(F.lit("node").alias("kind"), F.col("src").cast("string").alias("id")),
        F.struct(F.lit("node").alias("kind"), F.col("dst").cast("string").alias("id")),
    )).alias("x")).select("graph_id", "route", "step", "x.kind", "x.id")
    hit = over.join(shut, ["graph_id", "kind", "id"]).groupBy("scenario_id", "graph_id", "route").agg(F.min("step").alias("first_step"))
    return hit.join(pairs.select("graph_id", "route"), ["graph_id", "route"], "left_semi").select("scenario_id", "graph_id", "route", "first_step")
