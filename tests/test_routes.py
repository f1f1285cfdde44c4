"""Routes, demand, single removals, long chains and forests against brute force on small random networks."""

import heapq
import itertools
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from test_graphs import network, pieces

from viaduct.operators import closures, cuts, forest, paths, reports, resilience, routes
from viaduct.operators.apls import routable_share
from viaduct.operators.centrality import betweenness, demand_loads


def random_graphs(seed, count=4, n=9, extra=5, weights=(10, 20, 30)):
    rng = random.Random(seed)
    out = {}
    for k in range(count):
        every = list(itertools.combinations(range(n), 2))
        out[f"r{k}"] = (n, [(a, b, rng.choice(weights)) for a, b in rng.sample(every, n - 2 + rng.randint(0, extra))])
    return out


def distances(n, edges, s, gone=()):
    near = defaultdict(list)
    for k, (a, b, w) in enumerate(edges):
        if k not in gone:
            near[a].append((b, w))
            near[b].append((a, w))
    done, heap = {}, [(0, s)]
    while heap:
        d, v = heapq.heappop(heap)
        if v not in done:
            done[v] = d
            for u, w in near[v]:
                heapq.heappush(heap, (d + w, u))
    return done


def test_routes_and_what_closures_break(spark):
    graphs = random_graphs(2)
    _, edges = network(spark, graphs)
    asked = [(f"{g}-{s}-{t}", g, s, t) for g in graphs for s in (0, 3) for t in range(9)]
    pairs = spark.createDataFrame(asked, "route string, graph_id string, s long, t long")
    steps = routes.routes(edges, pairs)
    listed = {r.route: r.edge_ids for r in routes.listed(steps).collect()}
    over = {}
    for name, g, s, t in asked:
        n, es = graphs[g]
        d = distances(n, es, s)
        want, v = [], t
        while v != s and t in d:
            u, k = min((a if b == v else b, k) for k, (a, b, w) in enumerate(es) if v in (a, b) and d.get(a if b == v else b, 1e9) + w == d[v])
            want.append((f"e{es[k][0]}_{es[k][1]}", u, v))
            v = u
        assert listed.get(name, []) == [e for e, _, _ in reversed(want)]
        over[name] = list(reversed(want))
    shut = [("one", g, "edge", f"e{es[0][0]}_{es[0][1]}") for g, (_, es) in graphs.items()] + [("two", g, "node", "5") for g in graphs] + [("one", "r0", "edge", "none")]
    found = {(r.scenario_id, r.route): r.first_step for r in routes.broken_routes(steps, pairs, spark.createDataFrame(shut, "scenario_id string, graph_id string, kind string, id string")).collect()}
    want = {}
    for name, g, _, _ in asked:
        for k, (e, u, v) in enumerate(over[name], 1):
            if e == shut[list(graphs).index(g)][3]:
                want.setdefault(("one", name), k)
            if 5 in (u, v):
                want.setdefault(("two", name), k)
    assert found == want and want


def test_loads_of_unit_demand_are_betweenness(spark):
    nodes, edges = network(spark, random_graphs(3, extra=9))
    dist = paths.all_pairs(nodes, edges)
    _, of_edges = betweenness(nodes, edges, dist)
    unit = nodes.select("graph_id", F.col("node").alias("s")).join(nodes.select("graph_id", F.col("node").alias("t")), "graph_id").withColumn("demand", F.lit(1))
    loads = {(r.graph_id, r.src, r.dst): r.load for r in demand_loads(nodes, edges, unit)[1].collect()}
    assert loads == pytest.approx({(r.graph_id, r.src, r.dst): r.betweenness * 9 * 8 for r in of_edges.collect()})


def test_loads_of_uneven_demand(spark):
    """A square with two equal ways, and a tail: ends do not load themselves, odd rows carry nothing."""
    nodes, edges = network(spark, {"g": (6, [(0, 1, 1), (1, 2, 1), (0, 3, 1), (3, 2, 1), (2, 4, 1)])})
    asked = [("g", 0, 4, 6.0), ("g", 0, 4, 2.0), ("g", 0, 5, 3.0), ("g", 1, 1, 9.0), ("g", 4, 2, -1.0), ("g", 4, 2, None)]
    of_nodes, of_edges = demand_loads(nodes, edges, spark.createDataFrame(asked, "graph_id string, s long, t long, demand double"))
    assert {r.node: (r.load, r.share) for r in of_nodes.collect()} == {0: (0, 0), 1: (4, 0.5), 2: (8, 1), 3: (4, 0.5), 4: (0, 0), 5: (0, 0)}
    assert {(r.src, r.dst): r.load for r in of_edges.collect()} == {(0, 1): 4, (1, 2): 4, (0, 3): 4, (2, 3): 4, (2, 4): 8}


@pytest.mark.parametrize("weights", [(10, 20, 30), (0, 10)])
def test_leave_one_out(spark, weights):
    graphs = random_graphs(4, weights=weights)
    nodes, edges = network(spark, graphs)
    found = {(r.graph_id, r.edge_id): (r.efficiency_loss, r.slower_pairs, r.delay, r.cut_pairs) for r in closures.leave_one_out(nodes, edges).collect()}
    for g, (n, es) in graphs.items():
        old = [distances(n, es, s) for s in range(n)]
        for k, (a, b, _) in enumerate(es):
            loss, slower, delay, cut = 0.0, 0, 0, 0
            for s in range(n):
                new = distances(n, es, s, (k,))
                for v, d in old[s].items():
                    loss += (10 / d if d else 0) - (10 / new[v] if new.get(v) else 0)
                    slower, delay, cut = slower + (new.get(v, d) > d), delay + new.get(v, d) - d, cut + (v not in new)
            assert found[g, f"e{a}_{b}"] == (pytest.approx(loss / (n * (n - 1))), slower, delay, cut)


def test_changed_distances_of_many_closures(spark):
    """Cases that close several edges, parallel ones among them, of which the other stays."""
    rng = random.Random(6)
    graphs = random_graphs(5, count=3, extra=9)
    n, es = graphs["r0"]
    graphs["r0"] = (n, [*es, (es[0][1], es[0][0], es[0][2] + 10)])
    nodes, edges = network(spark, graphs)
    cases = [(f"c{k}", g, i) for g, (_, es) in graphs.items() for k in range(5) for i in rng.sample(range(len(es)), 4)] + [("c9", "r0", 0)]
    gone = spark.createDataFrame([(c, g, f"e{graphs[g][1][i][0]}_{graphs[g][1][i][1]}") for c, g, i in cases], "case string, graph_id string, edge_id string")
    dist = paths.all_pairs(nodes, edges)
    found = {(r.case, r.graph_id, r.s, r.v): (r.old, r.dist) for r in closures.changed_distances(edges, dist, gone).collect()}
    want = {}
    for c, g in {(c, g) for c, g, _ in cases}:
        n, es = graphs[g]
        out = {i for d, h, i in cases if (d, h) == (c, g)}
        for s in range(n):
            old, new = distances(n, es, s), distances(n, es, s, out)
            want |= {(c, g, s, v): (d, new.get(v)) for v, d in old.items() if new.get(v) != d}
    assert {k: x for k, x in found.items() if x[0] != x[1]} == want


@pytest.mark.parametrize("least", [0.0, 2.0])
def test_chains_keep_distances(spark, least):
    """Chains, one around a circle, one between the same two junctions twice, with sources inside, beside a circle apart."""
    rng = random.Random(7)
    es = [(i, i + 1, rng.randint(1, 9)) for i in range(11)] + [(4, 12, 2), (12, 13, 3), (13, 9, 4), (9, 14, 1), (14, 15, 1), (15, 9, 1), (20, 21, 1), (21, 22, 1), (22, 20, 1)]
    graphs = {"a": (23, es), "b": (5, [(0, 1, 3), (1, 2, 0), (2, 3, 4), (3, 4, 1), (4, 0, 1)])}
    _, edges = network(spark, graphs)
    sources = spark.createDataFrame([("a", 0), ("a", 7), ("a", 14), ("b", 2)], "graph_id string, s long")
    found = {(r.graph_id, r.s, r.v): r.dist for r in paths.shortest_paths(edges, sources, least_inside=least).collect()}
    assert found == {(g, s, v): d for g, s in (("a", 0), ("a", 7), ("a", 14), ("b", 2)) for v, d in distances(*graphs[g], s).items()}


def test_a_path_takes_few_rounds(spark, monkeypatch):
    """Ten thousand nodes in a row: fewer than 30 tables of rounds, distances exact."""
    n, made = 10_000, []
    observed = paths.observed

    def counted(df, name="table", **metrics):
        made.append(name)
        return observed(df, name, **metrics)

    monkeypatch.setattr(paths, "observed", counted)
    monkeypatch.setattr(forest, "observed", counted)
    edges = spark.range(n - 1).select(F.lit("p").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst"), F.lit(2).alias("w"))
    dist = paths.shortest_paths(edges, spark.createDataFrame([("p", 0)], "graph_id string, s long"))
    assert dist.filter("dist = 2 * v").count() == n == dist.count() and len(made) < 30


def test_forests_and_cuts_of_long_and_odd_shapes(spark):
    n = 3000
    shapes = {"path": [(i, i + 1) for i in range(n - 1)], "star": [(0, i) for i in range(1, n)], "ring": [(i, (i + 1) % n) for i in range(n)]}
    rows = [(g, a, b) for g, es in shapes.items() for a, b in es]
    edges = spark.createDataFrame(rows, "graph_id string, src long, dst long")
    own = cuts.blocks(edges)
    assert {r.graph_id: r["count"] for r in cuts.bridges(edges, own).groupBy("graph_id").count().collect()} == {"path": n - 1, "star": n - 1}
    assert {r.graph_id: r["count"] for r in cuts.articulation_points(edges, own).groupBy("graph_id").count().collect()} == {"path": n - 2, "star": 1}
    assert cuts.blocks(edges.limit(0)).count() == 0


def test_forest_is_kruskals(spark):
    graphs = random_graphs(8, count=6, n=10, extra=12)
    _, edges = network(spark, graphs)
    tree, labels = forest.spanning_forest(edges, "w")
    found = {(r.graph_id, r.src, r.dst) for r in tree.collect()}
    for g, (n, es) in graphs.items():
        own = []
        for w, a, b in sorted((w, a, b) for a, b, w in es):
            part = pieces(n, own)
            if part[a] != part[b]:
                own.append((a, b, w))
        assert {(a, b) for h, a, b in found if h == g} == {(a, b) for a, b, _ in own}
        part = pieces(n, es)
        roots = {r.c: r.root for r in labels.filter(F.col("graph_id") == g).collect()}
        assert all((part[x] == part[y]) == (roots[x] == roots[y]) for x in roots for y in roots)


def test_curve_keeps_its_last_step(spark):
    """Few edges: the step that takes the last one is a point, and a base of 0 gives way to the network's own."""
    nodes, edges = network(spark, {"one": (2, [(0, 1, 10)]), "three": (4, [(0, 1, 10), (1, 2, 10), (2, 3, 10)]), "none": (2, [])})
    base = spark.createDataFrame([("one", 0.0), ("three", 100.0), ("none", 1.0)], "graph_id string, base_efficiency double")
    found = defaultdict(list)
    for r in resilience.resilience_curve(nodes, edges.withColumn("raw", -F.col("src").cast("double")), base).orderBy("step").collect():
        found[r.graph_id].append((r.removed_fraction, r.efficiency, r.giant))
    assert found["one"] == [(0.0, 1.0, 1.0), (1.0, 0.0, 0.5)] and found["none"] == [(0.0, 0.0, 0.5)]
    assert [x[0] for x in found["three"]] == [0.0, 0.333, 0.667, 1.0] and [x[2] for x in found["three"]] == [1.0, 0.75, 0.5, 0.25]


def test_area_retention_and_routable_share(spark):
    curve = spark.createDataFrame([("g", 0, 0.0, 1.0, 1.0), ("g", 1, 0.1, 0.5, 1.0), ("g", 2, 0.3, 0.0, 0.5), ("h", 0, 0.0, 1.0, 1.0)], "graph_id string, step int, removed_fraction double, efficiency double, giant double")
    assert {r.graph_id: (round(r.efficiency_area, 9), round(r.giant_area, 9)) for r in reports.curve_area(curve).collect()} == {"g": (0.125, 0.25), "h": (0, 0)}
    a = spark.createDataFrame([("g", f"e{i}", i / 9) for i in range(10)] + [("h", "x", 1.0)], "graph_id string, edge_id string, criticality double")
    b = a.withColumn("criticality", F.when(F.col("edge_id").isin("e9", "e8"), 0.0).otherwise(F.col("criticality"))).filter("graph_id = 'g'")
    assert {r.graph_id: (r.k, r.kept, r.retention) for r in reports.top_retention(a, b, 4).collect()} == {"g": (4, 2, 0.5), "h": (1, 0, 0.0)}
    nodes, edges = network(spark, {"g": (4, [(0, 1, 10), (1, 2, 10), (2, 3, 10)])})
    share = routable_share(nodes, edges, nodes, edges.filter("src <> 1"), pairs=50, weight="w").first()
    assert (share.routes, share.routable, share.share) == (6, 2, pytest.approx(1 / 3))
