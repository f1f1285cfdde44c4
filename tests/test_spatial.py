"""Joins in space against brute force: crowded cells, points in one place, the antimeridian and the poles."""

import math
import random

import pytest
from pyspark.sql import functions as F

from viaduct.operators import spatial


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return round(2 * 6371000.0 * math.asin(min(1.0, math.sqrt(h))), 6)


def table(spark, points, first=0):
    return spark.createDataFrame([("g", first + i, float(y), float(x)) for i, (y, x) in enumerate(points)], "graph_id string, node long, lat double, lng double")


def around(rng, lat, lng, n, spread):
    return [(lat + rng.uniform(-spread, spread), (lng + rng.uniform(-spread, spread) + 540) % 360 - 180) for _ in range(n)]


@pytest.mark.parametrize("part", [1024, 5])
@pytest.mark.parametrize("place", [(12.0, 77.0), (0.0, 180.0), (-60.0, -179.9999), (89.9995, 10.0), (-90.0, 0.0)])
def test_pairs_and_nearest(spark, monkeypatch, place, part):
    monkeypatch.setattr(spatial, "PART_POINTS", part)
    monkeypatch.setattr(spatial, "FEW_TARGETS", 2)
    rng = random.Random(3)
    clip = lambda ps: [(max(-90.0, min(90.0, y)), x) for y, x in ps]
    a = clip(around(rng, *place, 40, 0.001) + around(rng, *place, 15, 0.00001) + [place] * 4)
    b = clip(around(rng, *place, 40, 0.001) + around(rng, *place, 25, 0.00001) + [place] * 3)
    found = {(r.a, r.b): r.dist_m for r in spatial.within_distance(table(spark, a), table(spark, b, 1000), 40.0).collect()}
    want = {(i, 1000 + j): metres(p, q) for i, p in enumerate(a) for j, q in enumerate(b) if metres(p, q) <= 40}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(d, abs=2e-6) for k, d in want.items())
    near = {r.node: (r.dist_m, r.snapped) for r in spatial.nearest_snap(table(spark, a), table(spark, b, 1000), 40.0).collect()}
    assert len(near) == len(a)
    for i, p in enumerate(a):
        own = [(metres(p, q), 1000 + j) for j, q in enumerate(b) if metres(p, q) <= 40]
        if own:
            assert near[i][0] == pytest.approx(min(own)[0], abs=2e-6) and metres(p, b[near[i][1] - 1000]) == pytest.approx(min(own)[0], abs=2e-6)
        else:
            assert near[i] == (None, None)


def test_a_crowded_cell_is_dealt_to_many_tasks(spark):
    """Forty thousand points within fifty metres: the search starts small, and no task compares a whole side."""
    n = 40_000
    spread = lambda seed: (F.rand(seed) - 0.5) * 0.0004
    points = spark.range(n).select(F.lit("g").alias("graph_id"), F.col("id").alias("node"), (12 + spread(1)).alias("lat"), (77 + spread(2)).alias("lng"))
    targets = spark.range(n).select(F.lit("g").alias("graph_id"), (F.col("id") + n).alias("node"), (12 + spread(3)).alias("lat"), (77 + spread(4)).alias("lng"))
    found = spatial.nearest_snap(points, targets, 50.0)
    seen = found.agg(F.count("snapped").alias("n"), F.max("dist_m").alias("m"), F.avg("dist_m").alias("a")).first()
    assert seen.n == n and seen.m < 5 and seen.a < 0.3
    assert spatial.nearest_snap(points.limit(0), targets).count() == 0
    assert spatial.nearest_snap(points.limit(3), targets.limit(0)).filter("snapped is null").count() == 3
