"""Resilience index, attack curves and what-if closures, for many graphs in one pass.

Steps of a curve and scenarios become graphs of their own, rows of one key, so one run of each kernel serves all.
Components of all steps of a curve come from one spanning forest; paths after closures are sought in tasks that hold the network,
or, of larger networks, follow from those before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.operators.closures import above_zero, changed_distances
from viaduct.operators.components import connected_components
from viaduct.operators.exact_sums import all_nearness, reached
from viaduct.operators.forest import spanning_forest
from viaduct.operators.paths import all_pairs, global_efficiency, sampled_sources, shortest_paths
from viaduct.operators.sampling import ranked, sample_pairs
from viaduct.session import stored

STEPS, MOST_FRACTION, SAMPLES, SEED = 10, 0.5, 60, 7


def connectivity(nodes: DataFrame, comps: DataFrame) -> DataFrame:
    """(graph_id, n, components, giant): the share of nodes in the largest component; 0 for an empty graph."""
    sizes = comps.groupBy("graph_id", "comp").agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("graph_id").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("components"), (F.max("size") / F.sum("size")).alias("giant"))


def index_of(efficiency, base, giant):
    """round(100 (0.6 min(eff / base, 1) + 0.4 giant)), 0 where the base is not positive."""
    value = 100 * (0.6 * F.least(efficiency / base, F.lit(1.0)) + 0.4 * giant)
    return F.when(base > 0, F.bround(F.round(value, 9), 0)).otherwise(0).cast("int")


def graph_state(nodes: DataFrame, edges: DataFrame, most_sources: int | None = None) -> DataFrame:
    """(graph_id, n, efficiency, components, giant) of every graph; efficiency from all nodes or sampled sources."""
    sources = None if most_sources is None else stored(sampled_sources(nodes, most_sources), "sources")
    near = None if sources is None else reached(edges, sources.withColumn("t", F.lit(None).cast("long")))
    if near:
        total = near.groupBy("graph_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("k"))
        value = F.when(F.col("n") > 1, F.col("total") / (F.col("k") * (F.col("n") - 1))).otherwise(0.0)
        eff = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n")).join(total, "graph_id").select("graph_id", "n", value.alias("efficiency"))
    else:
        eff = global_efficiency(nodes, all_pairs(nodes, edges, most_sources=most_sources))
    conn = connectivity(nodes, connected_components(edges, nodes)).drop("n")
    return stored(eff.join(conn, "graph_id"), "state")


def resilience_index(state: DataFrame, base: DataFrame) -> DataFrame:
    """``state`` with ``resilience_index`` against ``base(graph_id, base_efficiency)``."""
    return state.join(base, "graph_id").withColumn("resilience_index", index_of(F.col("efficiency"), F.col("base_efficiency"), F.col("giant")))


def attack_order(edges: DataFrame) -> DataFrame:
    """Edges ranked by raw betweenness, once, ties by id."""
    return ranked(edges, ["graph_id"], F.desc("raw"), "edge_id")


def resilience_curve(
    nodes: DataFrame, edges: DataFrame, base: DataFrame, steps: int = STEPS, most: float = MOST_FRACTION, most_sources: int | None = None
) -> DataFrame:
    """(graph_id, step, removed_fraction, efficiency, giant) while the most critical edges are taken out.

    Efficiency is relative to ``base(graph_id, base_efficiency)``, or, where that is missing or not positive, to the graph's
    own, from all nodes (as sums over pairs, where a network fits into a task) or sampled sources of each step. The last step may be the one that takes the last edge; a graph without
    edges has one point, step 0. The components of a step are those of the edges of one forest, the last to go, that are
    left then: an edge that closes a circle of edges that go later joins nothing at any step.
    """
    m = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("m")).withColumn("per", F.greatest(F.lit(1), F.floor(F.col("m") * most / steps)))
    order = attack_order(edges).join(m, "graph_id").withColumn("gone_at", F.ceil(F.col("rank") / F.col("per")))
    order = stored(order.select("graph_id", "src", "dst", "w", "m", "per", "gone_at"), "order")
    sizes = order.groupBy("graph_id").agg(F.first("m").alias("m"), F.first("per").alias("per"))
    every = nodes.select("graph_id").distinct().join(sizes, "graph_id", "left").fillna(0, ["m", "per"])
    grid = every.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("removed", F.col("step") * F.col("per"))
    grid = grid.filter("step = 0 or (m > 0 and removed - per < m)")
    key = F.concat_ws("#", "graph_id", F.col("step").cast("string"))
    grid = stored(grid.withColumn("key", key), "steps")
    at = grid.select("graph_id", "step", "key")
    left = lambda own, *more: own.join(at, "graph_id").filter(F.col("gone_at") > F.col("step")).select(F.col("key").alias("graph_id"), "src", "dst", *more)
    there = stored(nodes.select("graph_id", "node").join(at, "graph_id").select(F.col("key").alias("graph_id"), "node"), "nodes")
    near = all_nearness(order, at) if most_sources is None else None
    if near:
        size = there.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
        total = at.join(near, ["graph_id", "step"], "left").select(F.col("key").alias("graph_id"), "total")
        value = F.when(F.col("n") > 1, F.coalesce("total", F.lit(0.0)) / (F.col("n") * (F.col("n") - 1))).otherwise(0.0)
        eff = size.join(total, "graph_id").select("graph_id", "n", value.alias("efficiency"))
    else:
        eff = global_efficiency(there, all_pairs(there, stored(left(order, "w"), "edges"), most_sources=most_sources))
    last = order.withColumn("early", -F.col("gone_at"))
    forest = spanning_forest(last, "early")[0].join(_pairs_gone(order), ["graph_id", "src", "dst"])
    conn = connectivity(there, connected_components(stored(left(forest), "forest"), there)).drop("n")
    found = stored(eff.join(conn, "graph_id").withColumnRenamed("graph_id", "key").join(grid, "key"), "found")
    own = found.filter("step = 0").select("graph_id", F.col("efficiency").alias("_own"))
    whole = F.when(F.col("base_efficiency") > 0, F.col("base_efficiency")).otherwise(F.col("_own"))
    share = F.when(F.col("m") > 0, F.bround(F.col("removed") / F.col("m"), 3)).otherwise(0.0)
    relative = F.when((F.col("m") > 0) & (F.col("_whole") > 0), F.bround(F.round(F.col("efficiency") / F.col("_whole"), 9), 3)).otherwise(0.0)
    giant = F.when(F.col("step") == 0, F.col("giant")).otherwise(F.bround("giant", 3))
    found = found.join(base, "graph_id", "left").join(own, "graph_id").withColumn("_whole", whole)
    return found.select("graph_id", "step", share.alias("removed_fraction"), relative.alias("efficiency"), giant.alias("giant"))


def _pairs_gone(order: DataFrame) -> DataFrame:
    """When the last edge between two nodes goes."""
    own = order.select("graph_id", F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "gone_at")
    return own.groupBy("graph_id", "src", "dst").agg(F.max("gone_at").alias("gone_at"))


def closed_networks(nodes: DataFrame, edges: DataFrame, scenarios: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A graph for each scenario: without its edges, and without its nodes and all edges at them.

    ``scenarios(scenario_id, graph_id, kind, id)`` has kind edge or node; unknown ids remove nothing.
    """
    cases = scenarios.select("scenario_id", "graph_id").distinct()
    gone = scenarios.select("scenario_id", "graph_id", "kind", F.col("id").cast("string").alias("id"))
    off_nodes = gone.filter("kind = 'node'").select("scenario_id", "graph_id", F.col("id").alias("_n"))
    off_edges = gone.filter("kind = 'edge'").select("scenario_id", "graph_id", F.col("id").alias("_e"))
    n = nodes.join(cases, "graph_id").withColumn("_n", F.col("node").cast("string")).join(off_nodes, ["scenario_id", "graph_id", "_n"], "left_anti").drop("_n")
    e = edges.join(cases, "graph_id").withColumn("_e", F.col("edge_id").cast("string")).join(off_edges, ["scenario_id", "graph_id", "_e"], "left_anti").drop("_e")
    for end in ("src", "dst"):
        e = e.withColumn("_n", F.col(end).cast("string")).join(off_nodes, ["scenario_id", "graph_id", "_n"], "left_anti").drop("_n")
    return n, e


def _edges_gone(edges: DataFrame, scenarios: DataFrame) -> DataFrame:
    """(case, graph_id, edge_id): the edges that scenarios close, those at closed nodes too."""
    gone = scenarios.select(F.col("scenario_id").alias("case"), "graph_id", "kind", F.col("id").cast("string").alias("id"))
    own = edges.select("graph_id", "edge_id", F.col("edge_id").cast("string").alias("id"))
    ends = edges.select("graph_id", "edge_id", F.explode(F.array(F.col("src").cast("string"), F.col("dst").cast("string"))).alias("id"))
    by_id = gone.filter("kind = 'edge'").join(own, ["graph_id", "id"])
    by_end = gone.filter("kind = 'node'").join(ends, ["graph_id", "id"])
    return by_id.unionByName(by_end).select("case", "graph_id", "edge_id").distinct()


def _after(
    nodes: DataFrame, edges: DataFrame, after_nodes: DataFrame, after_edges: DataFrame, scenarios: DataFrame, cases: DataFrame, starts: DataFrame, drawn: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """(scenario_id, sum, k): what paths from ``starts(scenario_id, graph_id, s)`` add up to, and their number; and of routes
    ``drawn(graph_id, s, t)`` that are joined before (scenario_id, graph_id, s, t, old, new), how long they take, null if closed.

    Networks that fit into a task are sought anew there for each scenario; of larger ones only what closures change.
    """
    alive = after_nodes.select(F.col("graph_id").alias("scenario_id"), F.col("node").alias("s"))
    at = F.col("scenario_id").alias("graph_id")
    kept = drawn.join(cases, "graph_id").join(alive, ["scenario_id", "s"], "left_semi")
    asked = starts.select(at, "s", F.lit(None).cast(nodes.schema["node"].dataType).alias("t")).union(kept.select(at, "s", "t").distinct())
    before, after = reached(edges, drawn.select("graph_id", "s", "t").distinct()), reached(after_edges, stored(asked, "asked"))
    if before and after:
        own = after.withColumnRenamed("graph_id", "scenario_id")
        total = own.filter("t is null").groupBy("scenario_id").agg(F.sum("value").alias("sum"), F.count(F.lit(1)).alias("k"))
        routes = drawn.join(before.select("graph_id", "s", "t", F.col("value").cast("long").alias("old")), ["graph_id", "s", "t"]).filter("old is not null")
        new = own.filter("t is not null").select("scenario_id", "s", "t", F.col("value").cast("long").alias("new"))
        return total, cases.join(routes, "graph_id").join(new, ["scenario_id", "s", "t"], "left")
    sources = starts.select("graph_id", "s").union(drawn.select("graph_id", "s")).distinct()
    positive, bits = above_zero(edges)
    dist = stored(shortest_paths(positive, sources), "dist")
    changed = changed_distances(positive, dist, _edges_gone(edges, scenarios)).withColumnRenamed("case", "scenario_id")
    dist = dist.withColumn("dist", F.shiftright("dist", bits))
    changed = changed.withColumns({c: F.shiftright(c, bits) for c in ("old", "dist")})
    near = lambda d: F.when(F.col(d) > 0, 10.0 / F.col(d)).otherwise(0.0)
    whole = dist.groupBy("graph_id", "s").agg(F.sum(near("dist")).alias("sum"))
    less = changed.groupBy("scenario_id", "graph_id", "s").agg(F.sum(F.coalesce(near("dist"), F.lit(0.0)) - near("old")).alias("change"))
    total = starts.join(whole, ["graph_id", "s"]).join(less, ["scenario_id", "graph_id", "s"], "left").groupBy("scenario_id").agg(
        F.sum(F.col("sum") + F.coalesce("change", F.lit(0.0))).alias("sum"), F.count(F.lit(1)).alias("k"))
    old = dist.select("graph_id", "s", F.col("v").alias("t"), F.col("dist").alias("old"))
    routes = drawn.join(old, ["graph_id", "s", "t"])
    new = changed.select("scenario_id", "graph_id", "s", F.col("v").alias("t"), F.col("dist").alias("_new"), F.lit(True).alias("_changed"))
    both = cases.join(routes, "graph_id").join(new, ["scenario_id", "graph_id", "s", "t"], "left").join(alive.withColumn("_alive", F.lit(True)), ["scenario_id", "s"], "left")
    return total, both.withColumn("new", F.when(F.col("_alive").isNull(), None).when(F.col("_changed"), F.col("_new")).otherwise(F.col("old")))


def simulate_removal(
    nodes: DataFrame, edges: DataFrame, scenarios: DataFrame, base: DataFrame, samples: int = SAMPLES, seed: int = SEED, most_sources: int | None = None
) -> DataFrame:
    """Per scenario: resilience_index_after, time_increase_pct, newly_disconnected_zones, broken_routes, sampled_routes.

    Routes between sampled pairs, joined before, are compared; one whose end is closed or cut off is broken. Efficiency is
    from all nodes, or from ``most_sources`` sampled ones where ``base`` is too.
    """
    n, e = closed_networks(nodes, edges, scenarios)
    key = F.col("scenario_id").alias("graph_id")
    after_nodes, after_edges = stored(n.select(key, "node"), "nodes"), stored(e.select(key, "src", "dst", "w"), "edges")
    cases = stored(scenarios.select("scenario_id", "graph_id").distinct(), "cases")
    drawn = stored(sample_pairs(nodes, samples, seed), "routes")
    # paths of a scenario start at nodes that it leaves, and at those where its routes do
    starts = after_nodes.select("graph_id", F.col("node").alias("s")) if most_sources is None else sampled_sources(after_nodes, most_sources)
    starts = stored(starts.withColumnRenamed("graph_id", "scenario_id").join(cases, "scenario_id"), "starts")
    total, both = _after(nodes, edges, after_nodes, after_edges, scenarios, cases, starts, drawn)
    size = after_nodes.groupBy(F.col("graph_id").alias("scenario_id")).agg(F.count(F.lit(1)).alias("n"))
    value = F.when((F.col("n") > 1) & (F.col("k") > 0), F.coalesce("sum", F.lit(0.0)) / (F.col("k") * (F.col("n") - 1))).otherwise(0.0)
    conn = connectivity(after_nodes, connected_components(after_edges, after_nodes)).drop("n").withColumnRenamed("graph_id", "scenario_id")
    after = cases.join(size, "scenario_id").join(total, "scenario_id", "left").join(conn, "scenario_id").select("scenario_id", value.alias("efficiency"), "components", "giant")
    before = connectivity(nodes, connected_components(edges, nodes)).select("graph_id", F.col("components").alias("zones"))
    slower = F.when(F.col("old") > 0, (F.col("new") - F.col("old")) / F.col("old") * 100)
    routed = both.groupBy("scenario_id").agg(F.avg(slower).alias("pct"), F.count_if(F.col("new").isNull()).alias("broken_routes"))
    out = cases.join(after, "scenario_id").join(base, "graph_id").join(before, "graph_id").join(routed, "scenario_id", "left")
    return out.select(
        "scenario_id", "graph_id",
        index_of(F.col("efficiency"), F.col("base_efficiency"), F.col("giant")).alias("resilience_index_after"),
        F.bround(F.round(F.coalesce("pct", F.lit(0.0)), 9), 1).alias("time_increase_pct"),
        F.greatest(F.lit(0), F.col("components") - F.col("zones")).cast("int").alias("newly_disconnected_zones"),
        F.coalesce("broken_routes", F.lit(0)).cast("int").alias("broken_routes"), F.lit(samples).alias("sampled_routes"),
    )


def impact_estimate(edges: DataFrame, scenarios: DataFrame, index: DataFrame) -> DataFrame:
    """A quick estimate from the summed criticality of closed edges, without a path run.

    ``index(graph_id, resilience_index)`` holds the index before.
    """
    own = scenarios.filter("kind = 'edge'").join(edges.select("graph_id", F.col("edge_id").alias("id"), "criticality"), ["graph_id", "id"], "left")
    total = own.groupBy("scenario_id", "graph_id").agg(F.round(F.sum(F.coalesce("criticality", F.lit(0.0))), 9).alias("total"))
    cut = F.round(F.col("resilience_index") - 22 * F.col("total"), 0)
    return total.join(index, "graph_id").select(
        "scenario_id", F.greatest(F.lit(8), cut).cast("int").alias("index_after"), F.round(14 * F.col("total"), 1).alias("time_pct"),
        F.least(F.lit(5), F.floor(1.8 * F.col("total"))).cast("int").alias("zones"), F.round(6 * F.col("total"), 0).cast("int").alias("broken"), F.lit(50).alias("sampled"),
    )
