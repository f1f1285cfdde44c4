"""From masks to networks against plain numpy walks, and helpers that split hot keys."""

import heapq
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.operators import raster, vectorize
from viaduct.operators.apls import one_way
from viaduct.operators.components import connected_components
from viaduct.operators.occlusion import OCCLUDERS, random_occlude
from viaduct.operators.reports import changes, curve_rows, highest_edge, toggle_impact
from viaduct.operators.sampling import ranked, sample_pairs
from viaduct.plans.table_queries import QUERIES
from viaduct.session import join_counted, shared_dir
from viaduct.sources import files

EIGHT = raster.EIGHT


def frame(spark, masks, value=None):
    rows = [(name, int(r), int(c), *([float(value)] if value is not None else [])) for name, m in masks.items() for r, c in zip(*np.nonzero(m), strict=True)]
    return spark.createDataFrame(rows, "tile_id string, r int, c int" + (", prob double" if value is not None else ""))


def around(m, r, c):
    return [bool(0 <= r + y < len(m) and 0 <= c + x < len(m[0]) and m[r + y, c + x]) for y, x in EIGHT]


def thinned(m):
    m, changed = m.copy(), True
    while changed:
        changed = False
        for half in (0, 1):
            gone = []
            for r, c in zip(*np.nonzero(m), strict=True):
                p = around(m, r, c)
                turns = sum(not p[k] and p[(k + 1) % 8] for k in range(8))
                a, b = ((0, 2, 4), (2, 4, 6)) if half == 0 else ((0, 2, 6), (0, 4, 6))
                if 2 <= sum(p) <= 6 and turns == 1 and not all(p[k] for k in a) and not all(p[k] for k in b):
                    gone.append((r, c))
            for r, c in gone:
                m[r, c], changed = False, True
    return m


def walked(m):
    """(nodes, edges) of a skeleton by walking its chains: representatives and the longest chain of each pair of them."""
    degree = {(int(r), int(c)): sum(around(m, r, c)) for r, c in zip(*np.nonzero(m), strict=True)}
    ends = {p for p, n in degree.items() if n == 1 or n >= 3}
    cluster, groups = {}, []
    for p in sorted(ends):
        if p not in cluster:
            group, todo = [], [p]
            while todo:
                q = todo.pop()
                if q in cluster:
                    continue
                cluster[q] = len(groups)
                group.append(q)
                todo += [(q[0] + y, q[1] + x) for y, x in EIGHT if (q[0] + y, q[1] + x) in ends]
            groups.append(group)
    middle = [min(g, key=lambda p: (round((p[0] - np.mean([q[0] for q in g])) ** 2 + (p[1] - np.mean([q[1] for q in g])) ** 2, 9), p)) for g in groups]
    edges = {}
    for p in sorted(ends):
        for y, x in EIGHT:
            chain, before, at = [], p, (p[0] + y, p[1] + x)
            while at in degree and degree[at] == 2:
                chain.append(at)
                on = [(at[0] + b, at[1] + a) for b, a in EIGHT if (at[0] + b, at[1] + a) in degree and (at[0] + b, at[1] + a) not in (before, *chain)]
                before = at
                if not on:
                    break
                at = on[0]
            if chain and at in ends and cluster[at] != cluster[p]:
                line = [middle[cluster[p]], *chain, middle[cluster[at]]]
                length = sum(math.dist(a, b) for a, b in zip(line, line[1:], strict=False))
                key = tuple(sorted((cluster[p], cluster[at])))
                edges[key] = max(edges.get(key, 0.0), length)
    return set(middle), sorted(round(v, 3) for v in edges.values())


@pytest.fixture(scope="module")
def masks():
    rng = np.random.default_rng(5)
    found = {}
    for k in range(6):
        m = np.zeros((28, 28), bool)
        for _ in range(4):
            a, b = rng.integers(2, 26, 2), rng.integers(2, 26, 2)
            for t in np.linspace(0, 1, 60):
                m[tuple(np.round(a + (b - a) * t).astype(int))] = True
        found[f"m{k}"] = m
    found["tee"] = np.zeros((28, 28), bool)
    found["tee"][5, 1:10] = found["tee"][5:10, 5] = True
    return found


def test_thinning_equals_the_published_rules(spark, masks):
    thick = {k: m | np.roll(m, 1, 0) | np.roll(m, 1, 1) for k, m in masks.items()}
    found = {(r.tile_id, r.r, r.c) for r in raster.thin(frame(spark, thick)).collect()}
    assert found == {(k, int(r), int(c)) for k, m in thick.items() for r, c in zip(*np.nonzero(thinned(m)), strict=True)}


def test_networks_equal_walked_chains(spark, masks):
    lines = {k: thinned(m) for k, m in masks.items()}
    nodes, edges = vectorize.skeleton_to_network(frame(spark, lines))
    at, lengths = {}, {}
    for r in nodes.collect():
        at.setdefault(r.graph_id, set()).add((r.r, r.c))
    for r in edges.collect():
        lengths.setdefault(r.graph_id, []).append(r.length_m)
    for k, m in lines.items():
        middle, want = walked(m)
        assert at.get(k, set()) == middle
        assert sorted(lengths.get(k, [])) == pytest.approx([round(x, 1) for x in want], abs=0.051)
    assert len(lengths["tee"]) == 3 and len(at["tee"]) == 4


def test_projections_and_classes(spark):
    m = {"t": np.zeros((6, 60), bool)}
    m["t"][3, 2:58] = True
    tiles = spark.createDataFrame([("t", 6, 60, 12.0, 12.05, 77.0, 77.59, [0.01, 0.0, 77.0, 0.0, -0.01, 12.05])], "tile_id string, h int, w int, lat_min double, lat_max double, lng_min double, lng_max double, affine array<double>")
    own = frame(spark, m)
    for projection in (vectorize.Projection.bbox(), vectorize.Projection.affine()):
        nodes, edges = vectorize.skeleton_to_network(own, projection, tiles)
        row, places = edges.first(), sorted((r.lat, r.lng) for r in nodes.collect())
        assert row.road_class == "arterial" and row.length_m == pytest.approx(row.straight_m) and places[0] == pytest.approx((12.02, 77.02), abs=1e-6)
        assert row.length_m == pytest.approx(0.55 * 111_195 * math.cos(math.radians(12.02)), rel=1e-3) and row.travel_time == pytest.approx(row.length_m / (50 / 3.6), abs=0.06)
    custom = vectorize.skeleton_to_network(own, vectorize.Projection.pixels(2.0))[1].first()
    assert (custom.length_m, custom.road_class, custom.edge_id) == (110.0, "local", "e_px_3_2__px_3_57")


def test_healing_is_a_switch_of_the_view(spark):
    m = np.zeros((64, 64), bool)
    m[32, :] = m[:, 32] = True
    m[32, 18:27] = False
    wide = m | np.roll(m, 1, 0) | np.roll(m, 1, 1)
    pixels = frame(spark, {"on": wide, "off": wide}, 1.0)
    tiles = spark.createDataFrame([(k, 64, 64, 12.0, 12.0063, 77.0, 77.0063) for k in ("on", "off")], "tile_id string, h int, w int, lat_min double, lat_max double, lng_min double, lng_max double")
    flags = spark.createDataFrame([("on", True), ("off", False)], "graph_id string, enabled boolean")
    nodes, edges = vectorize.graph_from_mask(pixels, 64, vectorize.Projection.bbox(), tiles, flags, within_m=150.0, least=8)
    comps = connected_components(edges, nodes).groupBy("graph_id").agg(F.count_distinct("comp").alias("n"))
    found = {r.graph_id: r.n for r in comps.collect()}
    assert found["off"] == found["on"] + 1 and edges.filter("healed").select("graph_id").distinct().collect()[0][0] == "on"
    assert {"criticality", "is_bridge"} <= set(edges.columns) and edges.filter("criticality = 1").count() >= 2


def test_skeletons_with_otsu_and_width(spark):
    m = np.zeros((40, 40), bool)
    m[10:15, :] = True
    whole = np.ones((40, 40), bool)
    noisy = frame(spark, {"a": whole}, 0.0).withColumn("prob", F.when(F.col("r").between(10, 14), 0.9).otherwise(0.1)).unionByName(frame(spark, {"flat": whole}, 0.3))
    lines = vectorize.skeletonize(noisy, 40, with_width=True)
    assert {r.tile_id for r in lines.collect()} == {"a"} and max(r.d for r in lines.collect()) == 3.0
    stats = vectorize.skeleton_stats(frame(spark, {"a": m}), lines, spark.createDataFrame([], "graph_id string, road_class string"), spark.createDataFrame([("a", 40, 40), ("b", 4, 4)], "tile_id string, h int, w int"))
    found = {r.tile_id: r for r in stats.collect()}
    assert found["a"].road_fraction == 0.125 and found["a"].skeleton_pixels == lines.count() and found["b"].road_fraction == 0


def test_the_query_cleans_masks_before_it_thins_them(spark, tmp_path):
    """A road of five rows with a gap of two columns is one edge, and a speck beside it none; both were as they came."""
    road = [(r, c) for r in range(40, 45) for c in range(10, 80) if c not in (40, 41)] + [(70, c) for c in range(10, 18)]
    rows = [(r + 96 * k, 7, c, 0.09 if k else 0.05) for r, c in road for k in (0, 1)] + [(5, 8, 5, 0.01)]
    spark.createDataFrame(rows, "l_orderkey long, l_suppkey long, l_partkey long, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    found = QUERIES["mask_to_network"](spark, str(tmp_path)).collect()
    assert len(found) == 1 and found[0].graph_id == "t7"
    y1, x1, y2, x2 = (int(x) for x in re.findall(r"\d+", found[0].edge_id))
    assert 40 <= y1 <= 44 and 40 <= y2 <= 44 and min(x1, x2) < 16 and max(x1, x2) > 73


def dijkstra(edges, s):
    near, best, todo = {}, {}, [(0, s)]
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    while todo:
        d, v = heapq.heappop(todo)
        if v not in best:
            best[v] = d
            for o, w in near.get(v, ()):
                heapq.heappush(todo, (d + w, o))
    return best


def test_path_similarity_against_dijkstra(spark):
    rng = random.Random(4)
    points = [(12 + rng.random() / 50, 77 + rng.random() / 50) for _ in range(25)]
    truth = [(a, b, rng.randint(1, 90) * 1000) for a in range(25) for b in range(a) if rng.random() < 0.12]
    other = [e for e in truth if rng.random() < 0.8]
    nodes = spark.createDataFrame([("g", i, *p) for i, p in enumerate(points)], "graph_id string, node long, lat double, lng double")
    far = nodes.filter("node <> 3").withColumn("lat", F.col("lat") + 0.0001)
    made = [spark.createDataFrame([("g", a, b, w) for a, b, w in x], "graph_id string, src long, dst long, mm long") for x in (truth, other)]
    found = one_way(nodes, made[0], far, made[1], 60, 20.0, 1, "mm").first()
    scores = []
    for r in sample_pairs(nodes, 240, 1, 60).collect():
        want, have = dijkstra(truth, r.s).get(r.t), dijkstra([e for e in other if 3 not in e[:2]] + [e for e in other if 3 in e[:2]], r.s).get(r.t)
        if want is not None:
            scores.append(0.0 if 3 in (r.s, r.t) or have is None else max(0.0, 1 - abs(have - want) / want))
    assert found.scored == len(scores) and found.score == pytest.approx(sum(scores) / len(scores))


def test_ranks_and_counted_joins_split_hot_keys(spark):
    rows = [("hot", i * 7 % 5000) for i in range(5000)] + [(f"g{i % 9}", i) for i in range(90)]
    df = spark.createDataFrame(rows, "g string, v int")
    by = {}
    for r in ranked(df, ["g"], F.desc("v")).collect():
        by.setdefault(r.g, []).append((r.rank, r.v))
    for own in by.values():
        own.sort()
        assert [k for k, _ in own] == list(range(1, len(own) + 1)) and [v for _, v in own] == sorted((v for _, v in own), reverse=True)
    sizes = df.groupBy("g").agg(F.count(F.lit(1)).alias("n")).filter("g <> 'g0'").withColumn("name", F.upper("g"))
    found = join_counted(df, sizes, "g", "n")
    assert found.count() == len(rows) and found.filter("name is null").select("g").distinct().collect()[0][0] == "g0"
    assert found.filter("g = 'hot'").filter("name = 'HOT' and n = 5000").count() == 5000
    assert ranked(df.limit(0), ["g"], "v").count() == 0 and shared_dir(spark).startswith("file:")


def test_reports(spark):
    curves = spark.createDataFrame([(1, [0.0, 0.5, 1.0], [1.2, 0.25], [0.3337, -1.0, 0.1])], "k int, removed_fraction array<double>, efficiency array<double>, giant array<double>")
    assert [tuple(r) for r in curve_rows(curves, ["k"]).collect()] == [(1, 0, 0.0, 100.0, 33.4), (1, 1, 50.0, 25.0, 0.0)]
    edges = spark.createDataFrame([("g", "b", 0.9), ("g", "a", 0.9), ("g", "c", 0.1)], "graph_id string, edge_id string, criticality double")
    assert highest_edge(edges).first().edge_id == "a"
    assert {tuple(r) for r in changes(edges, edges.filter("edge_id <> 'a'"), "edge", "edge_id").collect()} == {("edge", "a", "lost")}
    results = spark.createDataFrame([("s", "g", 70, 15, 60), ("t", "g", 80, 0, 0)], "scenario_id string, graph_id string, resilience_index_after int, broken_routes int, sampled_routes int")
    found = toggle_impact(results, spark.createDataFrame([("g", 79)], "graph_id string, resilience_index int")).orderBy("scenario_id").collect()
    assert [(r.index_change, r.cut_pct) for r in found] == [(-9, 25), (1, None)]


def test_tiles_and_masks(spark):
    scenes = spark.createDataFrame([("a", 70, 33), ("b", 20, 20)], "scene_id string, h int, w int")
    pixels = scenes.withColumn("r", F.explode(F.sequence(F.lit(0), F.col("h") - 1))).withColumn("c", F.explode(F.sequence(F.lit(0), F.col("w") - 1))).select("scene_id", "r", "c")
    offsets = raster.tile_offsets(scenes, 32, 8)
    near = pixels.join(offsets, "scene_id").filter("r between y0 and y0 + 31 and c between x0 and x0 + 31")
    want = {(raster_row.scene_id, raster_row.row, raster_row.col, raster_row.r - raster_row.y0, raster_row.c - raster_row.x0) for raster_row in near.collect()}
    assert {(r.scene_id, r.row, r.col, r.r, r.c) for r in raster.cut_tiles(pixels, scenes, 32, 8).collect()} == want
    assert all(r.covered for r in raster.coverage(scenes, offsets, 32).collect())
    tiles = spark.createDataFrame([("t", 4, 4)], "tile_id string, h int, w int")
    one = spark.createDataFrame([("t", 0, 0), ("t", 0, 1)], "tile_id string, r int, c int")
    assert raster.join_masks(one, one.filter("c = 1"), None, tiles, tiles).filter("pred and not target").count() == 1
    with pytest.raises(ValueError, match="extent"):
        raster.join_masks(one, one, None, tiles, tiles.withColumn("h", F.lit(5)))
    listing = spark.createDataFrame([("/d/train/images/a.npy",), ("/d/train/masks/a.npy",), ("/d/train/images/b.npy",)], "path string")
    assert [tuple(r) for r in files.pair_by_name(listing, "train").collect()] == [("/d/train/images/a.npy", "/d/train/masks/a.npy")]


def test_cover_darkens_and_hides(spark):
    grid = np.ones((30, 30), bool)
    pixels = frame(spark, {f"t{k}": grid for k in range(8)}).withColumns({"red": F.lit(120), "green": F.lit(130), "blue": F.lit(140)})
    tiles = pixels.select("tile_id").distinct().withColumns({"h": F.lit(30), "w": F.lit(30)})
    mean = lambda df: df.agg(*[F.avg(c) for c in ("red", "green", "blue")]).first()
    assert min(mean(OCCLUDERS["cloud"](pixels, tiles))) > 140 and max(mean(OCCLUDERS["shadow"](pixels, tiles))) < 135
    covered = OCCLUDERS["building"](pixels, tiles)
    assert covered.filter("red = 77 and green = 80").count() > 0 and covered.count() == pixels.count()
    again = [random_occlude(pixels, tiles, 3).agg(F.sum(F.xxhash64("tile_id", "r", "c", "red", "green", "blue") % 1000)).first()[0] for _ in range(2)]
    assert again[0] == again[1] and random_occlude(pixels, tiles, 3).count() == pixels.count()
