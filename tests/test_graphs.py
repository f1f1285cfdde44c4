"""Hand-computed networks, and brute force on small random ones."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from viaduct.operators.annotate import annotate_network, criticality_histogram, gatekeepers
from viaduct.operators.apls import apls
from viaduct.operators.components import connected_components
from viaduct.operators.cuts import articulation_points, blocks, bridges
from viaduct.operators.healing import heal_network
from viaduct.operators.paths import all_pairs, global_efficiency
from viaduct.operators.resilience import connectivity, graph_state, resilience_index, simulate_removal
from viaduct.sources.networks import grid_network


def network(spark, graphs):
    """``graphs``: name -> (number of nodes, [(a, b, w)])."""
    nodes = [(g, i, 12.0 + 0.001 * i, 77.0) for g, (n, _) in graphs.items() for i in range(n)]
    edges = [(g, f"e{a}_{b}", a, b, w, w * 10.0, "local", w / 10) for g, (_, es) in graphs.items() for a, b, w in es]
    return (
        spark.createDataFrame(nodes, "graph_id string, node long, lat double, lng double"),
        spark.createDataFrame(edges, "graph_id string, edge_id string, src long, dst long, w long, length_m double, road_class string, travel_time double"),
    )


def pieces(n, edges, without=None):
    parent = list(range(n))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, b, _) in enumerate(edges):
        if k != without:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return [find(x) for x in range(n)]


FIXED = {
    "p3": (3, [(0, 1, 10), (1, 2, 10)]),
    "two_edges": (4, [(0, 1, 10), (2, 3, 10)]),
    "triangles": (6, [(0, 1, 10), (1, 2, 10), (0, 2, 10), (3, 4, 10), (4, 5, 10), (3, 5, 10), (2, 3, 10)]),
    "cycle3": (3, [(0, 1, 10), (1, 2, 10), (0, 2, 10)]),
    "isolated": (3, [(0, 1, 10)]),
    "single": (1, []),
}


def test_efficiency_giant_and_index(spark):
    nodes, edges = network(spark, FIXED)
    eff = {r.graph_id: r.efficiency for r in global_efficiency(nodes, all_pairs(nodes, edges)).collect()}
    assert eff["p3"] == pytest.approx(5 / 6) and eff["two_edges"] == pytest.approx(4 / 12) and eff["single"] == 0
    giant = {r.graph_id: r.giant for r in connectivity(nodes, connected_components(edges, nodes)).collect()}
    assert giant["isolated"] == pytest.approx(2 / 3) and giant["cycle3"] == 1
    state = graph_state(nodes, edges)
    base = state.select("graph_id", F.when(F.col("graph_id") == "cycle3", 0.0).otherwise(F.col("efficiency")).alias("base_efficiency"))
    found = {r.graph_id: r.resilience_index for r in resilience_index(state, base).collect()}
    assert found["p3"] == 100 and found["cycle3"] == 0


def test_cuts_of_fixed_and_random_networks(spark):
    rng = random.Random(3)
    graphs = dict(FIXED)
    for k in range(12):
        n = rng.randint(3, 9)
        every = list(itertools.combinations(range(n), 2))
        graphs[f"r{k}"] = (n, [(a, b, 10) for a, b in rng.sample(every, min(len(every), rng.randint(1, n + 3)))])
    _, edges = network(spark, graphs)
    cut = blocks(edges)
    have_b = {(r.graph_id, r.src, r.dst) for r in bridges(edges, cut).collect()}
    have_a = {(r.graph_id, r.node) for r in articulation_points(edges, cut).collect()}
    want_b, want_a = set(), set()
    for g, (n, es) in graphs.items():
        whole = len(set(pieces(n, es)))
        want_b |= {(g, a, b) for k, (a, b, _) in enumerate(es) if len(set(pieces(n, es, k))) > whole}
        for x in range(n):
            left = [e for e in es if x not in e[:2]]
            if any(x in e[:2] for e in es) and len(set(pieces(n, left))) - 1 > whole:
                want_a.add((g, x))
    assert have_b == want_b and have_a == want_a


def test_betweenness_against_enumeration(spark):
    rng = random.Random(5)
    graphs = {f"r{k}": (6, [(a, b, rng.randint(1, 3) * 10) for a, b in rng.sample(list(itertools.combinations(range(6), 2)), 8)]) for k in range(3)}
    nodes, edges = network(spark, graphs)
    of_nodes, of_edges = annotate_network(nodes, edges)
    raw = {(r.graph_id, r.src, r.dst): r.raw for r in of_edges.collect()}
    for g, (n, es) in graphs.items():
        w = {frozenset(e[:2]): e[2] for e in es}
        flow = dict.fromkeys(w, 0.0)
        for s, t in itertools.permutations(range(n), 2):
            best, paths = None, []
            for k in range(n - 1):
                for mid in itertools.permutations([x for x in range(n) if x not in (s, t)], k):
                    p = [s, *mid, t]
                    steps = [frozenset(x) for x in itertools.pairwise(p)]
                    if all(x in w for x in steps):
                        cost = sum(w[x] for x in steps)
                        if best is None or cost < best:
                            best, paths = cost, []
                        if cost == best:
                            paths.append(steps)
            for p in paths:
                for x in p:
                    flow[x] += 1 / len(paths)
        for x, v in flow.items():
            a, b = sorted(x)
            assert raw[(g, a, b)] == pytest.approx(v / (n * (n - 1)))
    assert max(r.betweenness for r in of_nodes.collect()) == 1
    assert sum(r.edges for r in criticality_histogram(of_edges).filter("graph_id = 'r0'").collect()) == 8
    assert {r.label for r in gatekeepers(of_nodes, 2).filter("graph_id = 'r0'").collect()} == {"GK-1", "GK-2"}


def test_components_of_long_path_and_empty(spark):
    nodes, edges = network(spark, {"path": (200, [(i, i + 1, 1) for i in range(199)])})
    assert {r.comp for r in connected_components(edges, nodes).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def test_heal_bridges_the_gap_only(spark):
    points = [("s", i, 12.0, 77.0 + d) for i, d in enumerate((0.0, 0.001, 0.0012, 0.0022, 0.5, 0.501))]
    nodes = spark.createDataFrame(points, "graph_id string, node long, lat double, lng double")
    edges = spark.createDataFrame([("s", "e0", 0, 1), ("s", "e1", 2, 3), ("s", "e2", 4, 5)], "graph_id string, edge_id string, src long, dst long")
    healed = heal_network(nodes, edges, 35.0)
    assert [r.edge_id for r in healed.filter("healed").collect()] == ["heal-1-2"]
    assert connected_components(healed, nodes).select("comp").distinct().count() == 2
    assert heal_network(nodes, edges, enabled=False).filter("healed").count() == 0


def test_grid_network_and_removal(spark):
    nodes, edges = grid_network(spark)
    assert (nodes.count(), edges.count()) == (85, 148)
    state = graph_state(nodes, edges)
    base = state.select("graph_id", F.col("efficiency").alias("base_efficiency"))
    cases = spark.createDataFrame([("spur", "grid", "edge", "e_n8_6__s_north"), ("hub", "grid", "node", "n4_4"), ("none", "grid", "edge", "unknown")], "scenario_id string, graph_id string, kind string, id string")
    found = {r.scenario_id: r for r in simulate_removal(nodes, edges, cases, base).collect()}
    assert found["spur"].newly_disconnected_zones == 1 and found["hub"].resilience_index_after < 100
    assert found["none"].resilience_index_after == 100 and found["none"].broken_routes == 0


def test_apls_of_equal_and_cut_networks(spark):
    n = [("a", r * 5 + c, 12.0 + 0.002 * r, 77.0 + 0.002 * c) for r in range(5) for c in range(5)]
    e = [("a", x, x + d, 1000) for x in range(25) for d in (1, 5) if x + d < 25 and (d == 5 or x % 5 < 4)]
    nodes = spark.createDataFrame(n, "graph_id string, node long, lat double, lng double")
    edges = spark.createDataFrame(e, "graph_id string, src long, dst long, mm long")
    assert apls(nodes, edges, nodes, edges, pairs=60).first().apls == pytest.approx(1)
    cut = edges.filter("not (src = 12 and dst = 13)")
    assert 0.9 < apls(nodes, edges, nodes, cut, pairs=200).first().apls < 1
