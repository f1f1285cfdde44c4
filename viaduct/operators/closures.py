"""Distances after closures, found from those before: only what a closure touches is looked at again.

A node keeps its distance from a source as long as one step on a shortest path into it stays. So closures spread along
these steps: a node is touched once all such steps into it are closed or come from touched nodes. Touched nodes start
anew from their neighbours that are not, and settle among themselves. No network is copied for a case.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.operators.centrality import tight_steps
from viaduct.operators.paths import all_pairs, both_ways, relaxed
from viaduct.session import drop_stored, observed, stored

CASE = ["case", "graph_id"]
KEY = [*CASE, "s"]
MOST_ROUNDS = 10_000


#: Bits below a weight that count the steps of a path, where some weights are 0.
STEP_BITS = 20


def above_zero(edges: DataFrame, weight: str = "w") -> tuple[DataFrame, int]:
    """``edges`` with positive weights, and by how many bits distances over them are to be shifted back.

    Where some weight is 0 all are shifted and each step adds 1, so of paths of one length that of fewest steps counts.
    """
    if edges.filter(F.col(weight) <= 0).isEmpty():
        return edges, 0
    return edges.withColumn(weight, F.shiftleft(F.col(weight).cast("long"), STEP_BITS) + 1), STEP_BITS


def slower_steps(edges: DataFrame, removed: DataFrame, weight: str = "w") -> DataFrame:
    """(case, graph_id, src, dst, w), stored, both ways: steps that ``removed(case, graph_id, edge_id)`` makes longer.

    ``w`` is that of the lightest parallel edge that is left, or null. Self-loops and unknown ids change nothing.
    """
    own = edges.select("graph_id", "edge_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), F.col(weight).cast("long").alias("w")).filter("src <> dst")
    gone = removed.select(*CASE, "edge_id").distinct()
    hit = gone.join(own, ["graph_id", "edge_id"]).select(*CASE, "src", "dst").distinct()
    all_ = hit.join(own, ["graph_id", "src", "dst"]).join(gone.withColumn("_gone", F.lit(True)), [*CASE, "edge_id"], "left")
    after = all_.groupBy(*CASE, "src", "dst").agg(F.min("w").alias("before"), F.min(F.when(F.col("_gone").isNull(), F.col("w"))).alias("w"))
    after = after.filter("w is null or w > before").select(*CASE, "src", "dst", "w")
    return stored(after.union(after.select(*CASE, F.col("dst").alias("src"), F.col("src").alias("dst"), "w")), "slower")


def touched_nodes(tight: DataFrame, slower: DataFrame) -> DataFrame:
    """(case, graph_id, s, v): nodes all of whose steps on shortest paths from s are slower or come from touched nodes."""
    into = stored(tight.groupBy("graph_id", "s", F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("ways")), "ways")
    shut = slower.select(*CASE, "src", "dst")
    hits = tight.join(shut, ["graph_id", "src", "dst"]).groupBy(*KEY, F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("hits"))
    held = stored(hits.join(into, ["graph_id", "s", "v"]).withColumn("new", F.lit(True)), "hits")
    found = []
    for _ in range(MOST_ROUNDS):
        front, seen = observed(held.filter("new and hits = ways").select(*KEY, "v"), "touched")
        if not seen["n"]:
            break
        found.append(front)
        on = front.withColumnRenamed("v", "src").join(tight, ["graph_id", "s", "src"]).join(shut, [*CASE, "src", "dst"], "left_anti")
        more = on.groupBy(*KEY, F.col("dst").alias("v")).agg(F.count(F.lit(1)).alias("hits")).join(into, ["graph_id", "s", "v"]).withColumn("new", F.lit(True))
        open_ = held.filter("hits < ways").withColumn("new", F.lit(False))
        both = open_.unionByName(more).groupBy(*KEY, "v").agg(F.sum("hits").alias("hits"), F.first("ways").alias("ways"), F.max("new").alias("new"))
        before, held = held, stored(both, "hits")
        drop_stored(before)
    else:
        raise RuntimeError(f"closures did not settle within {MOST_ROUNDS} rounds")
    drop_stored(into)
    whole = front
    for part in found:
        whole = whole.unionByName(part)
    return whole


def changed_distances(edges: DataFrame, dist: DataFrame, removed: DataFrame, weight: str = "w") -> DataFrame:
    """(case, graph_id, s, v, old, dist), stored: the distances that cases change; ``dist`` is null where none is left.

    ``dist(graph_id, s, v, dist)`` are those over all ``edges``, of any sources; ``removed`` as in ``slower_steps``.
    Weights are whole and positive.
    """
    steps, tight, slower = stored(both_ways(edges, weight), "steps"), tight_steps(edges, dist, weight), slower_steps(edges, removed, weight)
    touched = stored(touched_nodes(tight, slower).join(dist.withColumnRenamed("dist", "old"), ["graph_id", "s", "v"]), "touched")
    ways = touched.select(*KEY, F.col("v").alias("dst")).join(steps, ["graph_id", "dst"])
    ways = ways.join(slower.select(*CASE, "src", "dst", F.col("w").alias("_w"), F.lit(True).alias("_slow")), [*CASE, "src", "dst"], "left")
    ways = ways.filter("_slow is null or _w is not null").select(*KEY, "src", "dst", F.coalesce("_w", "w").alias("w"))
    marks = touched.select(*KEY, F.col("v").alias("src"), F.lit(True).alias("inner"))
    ways = stored(ways.join(marks, [*KEY, "src"], "left"), "ways")
    rim = ways.filter("inner is null").join(dist.select("graph_id", "s", F.col("v").alias("src"), "dist"), ["graph_id", "s", "src"])
    start = rim.groupBy(*KEY, F.col("dst").alias("v")).agg(F.min(F.col("dist") + F.col("w")).alias("dist"))
    found = relaxed(start, ways.filter("inner").drop("inner"), KEY, KEY)
    done = stored(touched.select(*KEY, "v", "old").join(found, [*KEY, "v"], "left"), "changed")
    drop_stored(steps, tight, slower, ways)
    return done


def leave_one_out(nodes: DataFrame, edges: DataFrame, weight: str = "w", unit: float = 10.0, most_sources: int | None = None) -> DataFrame:
    """(graph_id, edge_id, efficiency_loss, slower_pairs, delay, cut_pairs) of every edge, were it alone removed.

    ``efficiency_loss`` is what the network's efficiency falls by; ``slower_pairs`` and ``cut_pairs`` count ordered pairs
    that take longer, by ``delay`` together, or have no path left. From all nodes as sources, or from ``most_sources``
    sampled ones. ``unit`` of the weight make one second.
    """
    edges, bits = above_zero(edges, weight)
    dist = stored(all_pairs(nodes, edges, weight, most_sources), "dist")
    cases = edges.select(F.col("edge_id").alias("case"), "graph_id", "edge_id")
    changed = changed_distances(edges, dist, cases, weight).withColumns({c: F.shiftright(c, bits) for c in ("old", "dist")}).filter("dist is null or dist > old")
    size = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).join(dist.filter("s = v").groupBy("graph_id").agg(F.count(F.lit(1)).alias("k")), "graph_id")
    near = lambda d: F.when(F.col(d) > 0, F.lit(unit) / F.col(d)).otherwise(0.0)
    lost = changed.groupBy("graph_id", F.col("case").alias("edge_id")).agg(
        F.sum(near("old") - near("dist")).alias("loss"), F.count("dist").alias("slower_pairs"),
        F.sum(F.col("dist") - F.col("old")).alias("delay"), F.count_if(F.col("dist").isNull()).alias("cut_pairs"),
    )
    out = edges.select("graph_id", "edge_id").join(lost, ["graph_id", "edge_id"], "left").join(size, "graph_id")
    return out.select(
        "graph_id", "edge_id", F.when(F.col("n") > 1, F.coalesce("loss", F.lit(0.0)) / (F.col("k") * (F.col("n") - 1))).otherwise(0.0).alias("efficiency_loss"),
        *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("slower_pairs", "delay", "cut_pairs")],
    )
