"""Exact flows and distances of networks cut into chains against Brandes' algorithm node by node."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_graphs import network

from viaduct.operators import chain_flows, resilience
from viaduct.plans import route_queries, user_queries
from viaduct.plans.derived import user_demand, user_network
from viaduct.session import made


def brandes(n, edges, sources, demand=None):
    """What passes nodes and edges, and distances; each target counts 1, or as ``demand`` by (source, target) says."""
    near = [[] for _ in range(n)]
    for i, (a, b, w) in enumerate(edges):
        near[a].append((b, w, i))
        near[b].append((a, w, i))
    node, edge, far = [0.0] * n, [0.0] * len(edges), {}
    for s in sources:
        dist, done, todo = {s: 0}, [], [(0, s)]
        while todo:
            x, v = heapq.heappop(todo)
            if x > dist[v] or v in done:
                continue
            done.append(v)
            for t, w, _ in near[v]:
                if x + w < dist.get(t, x + w + 1):
                    dist[t] = x + w
                    heapq.heappush(todo, (x + w, t))
        paths, share = dict.fromkeys(done, 0.0), dict.fromkeys(done, 0.0)
        paths[s] = 1.0
        for v in done:
            for t, w, _ in near[v]:
                if dist[v] + w == dist[t]:
                    paths[t] += paths[v]
        for v in reversed(done):
            for t, w, i in near[v]:
                if dist[t] + w == dist[v]:
                    flow = paths[t] / paths[v] * (share[v] + (1.0 if demand is None else demand.get((s, v), 0.0)))
                    share[t] += flow
                    edge[i] += flow
            node[v] += share[v] if v != s else 0.0
        far[s] = dist
    return node, edge, far


def roads(rng):
    """A few junctions, a street or a circle, whose links are cut into chains; some lead nowhere."""
    n, kind = rng.randint(2, 20), rng.choice(["street", "circle", "mixed", "mixed", "mixed"])
    links = {(i, i + 1) for i in range(n - 1)} if kind != "mixed" else set()
    links |= {(0, n - 1)} if kind == "circle" and n > 2 else set()
    links |= {tuple(sorted(rng.sample(range(n), 2))) for _ in range(rng.randint(1, 2 * n) if kind == "mixed" else rng.randint(0, 1))}
    edges = []
    for a, b in sorted(links):
        for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
            edges.append((a, n, rng.randint(1, 2)))
            a, n = n, n + 1
        edges.append((a, b, rng.randint(1, 3)))
    names = sorted({x for a, b, _ in edges for x in (a, b)})
    number = dict(zip(rng.sample(names, len(names)), range(len(names)), strict=True))
    return len(names), [(number[a], number[b], w) for a, b, w in edges]


@pytest.mark.parametrize("seed", range(60))
def test_chains_keep_distances_and_flows(monkeypatch, seed):
    rng = random.Random(seed)
    n, edges = roads(rng)
    monkeypatch.setattr(chain_flows, "MOST_SOURCES", rng.choice([1, 3, 64]))
    monkeypatch.setattr(chain_flows, "MOST_RANKS", rng.choice([1, 256]))
    net = chain_flows.Chains(*(np.array(x) for x in zip(*edges, strict=True)))
    sources = sorted(rng.sample(range(n), rng.randint(1, n)))
    demand = {(s, t): rng.randint(1, 4) for s in sources for t in rng.sample(range(n), min(n, 4)) if s != t} if seed % 2 else None
    node, edge, far = brandes(n, edges, sources, demand)
    sums = chain_flows.Sums(net)
    for own in net.batches(np.array(sources)):
        batch = chain_flows.Batch(net, own)
        for j, s in enumerate(own.tolist()):
            found = batch.to(np.full(n, j), np.arange(n))
            assert {v: d for v, d in enumerate(found.tolist()) if d < net.far} == far[s]
            assert batch.nearness(10.0)[j] == pytest.approx(sum(10 / d for d in far[s].values() if d))
        sent = [(j, t, x) for j, s in enumerate(own.tolist()) for (a, t), x in (demand or {}).items() if a == s]
        batch.loads(sums, tuple(np.array([x[k] for x in sent], float if k == 2 else int) for k in range(3)) if demand is not None else None)
    assert np.allclose(sums.nodes, node) and np.allclose(sums.edges, edge)
    assert demand is None or sums.carried == sum(x for (s, t), x in demand.items() if t in far[s])


@pytest.fixture(scope="module")
def users(spark, tmp_path_factory):
    """The events of 100 users, and their network."""
    folder, rng = str(tmp_path_factory.mktemp("users")), random.Random(5)
    rows = [(k, rng.randrange(100), rng.choice("ab"), 60 * k) for k in range(900)]
    events = spark.createDataFrame(rows, "event_id long, user_id long, event_type string, t long")
    events.withColumn("ts", F.timestamp_seconds("t")).write.parquet(f"{folder}/events.parquet")
    nodes, edges = user_network(spark, folder)
    names = sorted(r.node for r in nodes.collect())
    return folder, names, [(names.index(r.src), names.index(r.dst), r.w) for r in edges.collect()]


def test_all_users_count_for_betweenness_of_nodes(spark, users):
    folder, names, edges = users
    n = len(names)
    want = brandes(n, edges, range(n))[0]
    found = {r.node: r.betweenness for r in user_queries.user_node_betweenness(spark, folder).collect()}
    assert n > 64 and found == {v: pytest.approx(x / (n - 1) / (n - 2), abs=1e-8) for v, x in zip(names, want, strict=True)}


def test_all_users_count_for_loads_of_nodes(spark, users):
    folder, names, edges = users
    sent = {(names.index(r.s), names.index(r.t)): float(r.demand) for r in user_demand(spark, folder).collect()}
    want, _, far = brandes(len(names), edges, range(len(names)), sent)
    total = sum(x for (s, t), x in sent.items() if t in far[s])
    found = {r.node: (r.load, r.share) for r in route_queries.user_node_loads(spark, folder).collect()}
    assert found == {v: (pytest.approx(x, abs=1e-5), pytest.approx(x / total, abs=1e-8)) for v, x in zip(names, want, strict=True)}


def test_all_users_count_for_the_curve(spark, users):
    """Betweenness that ranks the links, and the efficiency of each step."""
    folder, names, edges = users
    n = len(names)
    raw = [round(x / n / (n - 1), 9) for x in brandes(n, edges, range(n))[1]]
    order = sorted(range(len(edges)), key=lambda i: (-raw[i], f"u_{names[edges[i][0]]}_{names[edges[i][1]]}"))
    per = max(1, int(len(edges) * 0.5 / 10))
    near = []
    for step in range(11):
        far = brandes(n, [edges[i] for i in order[step * per :]], range(n))[2]
        near.append(sum(10 / d for found in far.values() for d in found.values() if d))
    found = {r.step: r.efficiency for r in user_queries.user_curve(spark, folder).collect()}
    assert found == {step: pytest.approx(x / near[0], abs=0.00051) for step, x in enumerate(near)}


def test_closures_take_no_round_a_node(spark, monkeypatch):
    """A street of 40 nodes closed near one end wrote tables for each node behind; large networks still get the same that way."""
    nodes, edges = network(spark, {"street": (40, [(k, k + 1, 1 + k % 3) for k in range(39)] + [(3, 30, 9)])})
    edges = edges.withColumn("edge_id", F.concat("src", F.lit("_"), "dst"))
    cases = spark.createDataFrame([("a", "street", "node", "2"), ("b", "street", "edge", "3_30"), ("c", "street", "node", "20"), ("c", "street", "node", "39")], "scenario_id string, graph_id string, kind string, id string")
    tables, found = [], []
    for most in (chain_flows.MOST_EDGES, 0):
        monkeypatch.setattr(chain_flows, "MOST_EDGES", most)
        since = made(spark)
        base = resilience.graph_state(nodes, edges, 5).select("graph_id", F.col("efficiency").alias("base_efficiency"))
        found.append(sorted(resilience.simulate_removal(nodes, edges, cases, base, most_sources=5).collect()))
        tables.append(made(spark) - since)
    assert found[0] == found[1] and len(found[0]) == 3 and any(r.broken_routes for r in found[0])
    assert tables[0] < 45 < tables[1], tables
