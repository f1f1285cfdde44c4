"""Distances by blocks against a search from each source, with blocks so small that paths cross many."""

import random

import pytest
from test_graphs import network
from test_routes import distances

from viaduct.operators.block_paths import block_paths
from viaduct.operators.paths import both_ways


@pytest.mark.parametrize(("nodes", "sources"), [(1, 1), (5, 2), (64, 16)])
def test_blocks_keep_distances(spark, nodes, sources):
    rng = random.Random(nodes)
    grid = [(7 * y + x, 7 * y + x + d, rng.randint(0, 9)) for y in range(6) for x in range(7) for d in (1, 7) if rng.random() < 0.8 and (d == 7 or x < 6) and 7 * y + x + d < 42]
    graphs = {"grid": (42, grid), "mixed": (30, [(*rng.sample(range(30), 2), rng.randint(1, 40)) for _ in range(45)])}
    graphs["mixed"] = (30, list({(min(a, b), max(a, b)): (min(a, b), max(a, b), w) for a, b, w in graphs["mixed"][1]}.values()))
    _, edges = network(spark, graphs)
    starts = [("grid", 0), ("grid", 17), ("grid", 41), ("mixed", 3), ("mixed", 29), ("alone", 8)]
    start = spark.createDataFrame([(g, s, s, 0) for g, s in starts], "graph_id string, s long, v long, dist long")
    found = block_paths(start, both_ways(edges), 1000, nodes, sources).collect()
    want = {(g, s, v): d for g, s in starts[:-1] for v, d in distances(*graphs[g], s).items()}
    assert len(found) == len(want) + 1 and {(r.graph_id, r.s, r.v): r.dist for r in found} == want | {("alone", 8, 8): 0}


def test_a_grid_of_one_block_takes_one_round(spark, monkeypatch):
    """A path of 200 junctions: the tables of rounds were as many as its junctions."""
    from viaduct.operators import block_paths as own

    made, observed = [], own.observed
    monkeypatch.setattr(own, "observed", lambda df, name="table", **m: made.append(name) or observed(df, name, **m))
    side = 100
    edges = [("g", side * y + x, side * y + x + d, 1) for y in range(side) for x in range(side) for d in (1, side) if (d == 1 and x < side - 1) or (d == side and y < side - 1)]
    steps = both_ways(spark.createDataFrame(edges, "graph_id string, src long, dst long, w long"))
    found = own.block_paths(spark.createDataFrame([("g", 0, 0, 0)], "graph_id string, s long, v long, dist long"), steps, 10)
    assert made.count("dist") == 1 and found.filter(f"dist = v % {side} + floor(v / {side})").count() == side * side


@pytest.mark.parametrize("most", [3, 1 << 18])
def test_components_start_from_stars_of_ranges(spark, monkeypatch, most):
    """A street of 3,000 nodes with names or numbers: one round and the one that sees no change, where it fits a range."""
    from pyspark.sql import functions as F

    from viaduct.operators import components

    made, observed = [], components.observed
    monkeypatch.setattr(components, "TASK_EDGES", most)
    monkeypatch.setattr(components, "observed", lambda df, name="table", **m: made.append(name) or observed(df, name, **m))
    edges = spark.range(3000).select(F.lit("p").alias("graph_id"), F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).filter("src <> 1499")
    edges = edges.union(spark.createDataFrame([("q", 7, 1499), ("q", 1500, 7)], edges.schema))
    found = components.connected_components(edges)
    want = F.when(F.col("graph_id") == "q", 7).when(F.col("node") <= 1499, 0).otherwise(1500)
    assert found.count() == 3004 and found.filter(F.col("comp") != want).isEmpty()
    assert most == 3 or len(made) <= 5
    named = edges.select("graph_id", *[F.format_string("%04d", c).alias(c) for c in ("src", "dst")])
    found = components.connected_components(named)
    assert found.count() == 3004 and found.filter(F.col("comp").cast("long") != want).isEmpty()
