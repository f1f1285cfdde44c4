"""Flows along shortest paths by blocks: small blocks against one block, and rounds by blocks, not by nodes."""

import random

import pytest
from pyspark.sql import functions as F
from test_graphs import network

from viaduct.operators import block_flows
from viaduct.operators.centrality import _loads, betweenness
from viaduct.operators.paths import all_pairs
from viaduct.operators.routes import predecessors
from viaduct.session import stored


@pytest.fixture
def graphs(spark):
    rng = random.Random(3)
    grid = [(4 * y + x, 4 * y + x + d) for y in range(3) for x in range(4) for d in (1, 4) if (d == 4 or x < 3) and 4 * y + x + d < 12]
    return network(spark, {"grid": (12, [(a, b, rng.randint(1, 2)) for a, b in grid]), "ring": (5, [(k, (k + 1) % 5, 1) for k in range(5)])})


def rows(df):
    return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect())


def test_small_blocks_carry_the_same(spark, graphs, monkeypatch):
    nodes, edges = graphs
    dist = stored(all_pairs(nodes, edges), "dist")
    pairs = spark.createDataFrame([(k, g, s, t) for k, (g, s, t) in enumerate([("grid", 0, 11), ("grid", 0, 7), ("ring", 3, 0), ("ring", 2, 2)])], "route int, graph_id string, s long, t long")
    demand = dist.filter("s < 3 and s <> v").select("graph_id", "s", "v", (F.col("v") + 1.0).alias("demand"))
    every = lambda: [rows(t) for t in (*betweenness(nodes, edges, dist), *_loads(edges, dist, "w", demand), predecessors(edges, dist, pairs))]
    want = every()
    assert all(want) and any(r[2] > 0 for r in want[0])
    monkeypatch.setattr(block_flows, "BLOCK_NODES", 7)
    monkeypatch.setattr(block_flows, "BLOCK_SOURCES", 6)
    assert every() == want


def test_a_street_of_one_block_takes_a_round_each_way(spark, monkeypatch):
    """A street of 60 nodes took a round a node, forward and back."""
    made, observed = [], block_flows.observed
    monkeypatch.setattr(block_flows, "observed", lambda df, name="table", **m: made.append(name) or observed(df, name, **m))
    nodes, edges = network(spark, {"street": (60, [(k, k + 1, 1) for k in range(59)])})
    found = {r.node: r.betweenness for r in betweenness(nodes, edges, all_pairs(nodes, edges, most_sources=2))[0].collect()}
    assert made.count("pushed") == 2 and len(found) == 60 and found[0] == 0
