import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.functions.scalars import assign_split, foreground, percent_text, scene_id, unit_interval
from viaduct.operators import raster, vectorize
from viaduct.operators.sampling import hold_out, sample_rows
from viaduct.sources import files, networks


def mask(spark, cells, tile="t"):
    return spark.createDataFrame([(tile, r, c) for r, c in cells], "tile_id string, r int, c int")


def cells(df):
    return {(r.r, r.c) for r in df.collect()}


TEE = [(5, c) for c in range(1, 10)] + [(r, 5) for r in range(6, 10)]


def test_tee_becomes_four_nodes_and_three_edges(spark):
    tee = mask(spark, TEE)
    nodes, edges = vectorize.skeleton_to_network(tee)
    assert {(5, 1), (5, 9), (9, 5)} <= cells(nodes) and (nodes.count(), edges.count()) == (4, 3)


def test_thinning_keeps_lines_and_thins_bars(spark):
    assert cells(raster.thin(mask(spark, [(3, c) for c in range(8)]))) == {(3, c) for c in range(8)}
    bar = raster.thin(mask(spark, [(r, c) for r in range(2, 7) for c in range(30)]))
    assert 20 <= bar.count() <= 32


def test_morphology_against_numpy(spark):
    rng = np.random.default_rng(1)
    a = rng.random((20, 20)) < 0.2
    own = mask(spark, list(zip(*(x.tolist() for x in np.nonzero(a)), strict=True)))

    def moved(b, fill):
        big = np.full((24, 24), fill)
        big[2:22, 2:22] = b
        return [big[2 + y : 22 + y, 2 + x : 22 + x] for y, x in raster.DISK2]

    dilated = np.logical_or.reduce(moved(a, False))
    closed = np.logical_and.reduce(moved(dilated, True))
    assert cells(raster.closing(own, 20)) == set(zip(*(x.tolist() for x in np.nonzero(closed)), strict=True))
    assert cells(raster.drop_small(mask(spark, [(0, 0), (5, 5), (5, 6), (6, 6)]), 2)) == {(5, 5), (5, 6), (6, 6)}
    ring = [(r, c) for r in range(3, 8) for c in range(3, 8) if (r, c) != (5, 5)]
    assert (5, 5) in cells(raster.fill_holes(mask(spark, ring), 12, 4))
    assert {r.d for r in raster.half_width(mask(spark, [(5, 5)]), 12).collect()} == {1.0}


def test_metrics_of_empty_and_occluded_masks(spark):
    rows = [("empty", 0, 0, False, False, False), ("half", 0, 0, True, True, False), ("half", 0, 1, False, True, True)]
    found = {r.tile_id: r for r in raster.overlap_metrics(spark.createDataFrame(rows, "tile_id string, r int, c int, pred boolean, target boolean, occluded boolean"), ["tile_id"]).collect()}
    assert (found["empty"].iou, found["empty"].dice, found["empty"].occlusion_recall) == (1, 1, 1)
    assert found["half"].iou == pytest.approx(0.5, abs=1e-6) and found["half"].occlusion_recall == 0


def test_tiles_cover_the_scene(spark):
    scenes = spark.createDataFrame([("a", 1000, 1300), ("b", 300, 200)], "scene_id string, h long, w long")
    found = raster.tile_offsets(scenes)
    top = found.groupBy("scene_id").agg(F.max("y0").alias("y"), F.max("x0").alias("x"), F.count("*").alias("n"))
    assert {r.scene_id: (r.y, r.x) for r in top.collect()} == {"a": (488, 788), "b": (0, 0)}


def test_scalars(spark):
    rows = spark.createDataFrame([("/x/a_b_sat.tif", float("nan")), ("c_mask.png", None)], "p string, v double")
    found = rows.select(scene_id("p").alias("s"), foreground("v").alias("f"), percent_text("v").alias("t")).collect()
    assert [r.s for r in found] == ["a_b", "c"] and not any(r.f for r in found) and found[1].t == "—"
    split = spark.range(1000).select(assign_split(unit_interval(F.concat(F.lit("scene_"), "id"))).alias("s")).groupBy("s").count()
    share = {r.s: r["count"] / 1000 for r in split.collect()}
    assert 0.74 < share["train"] < 0.86 and 0.05 < share["val"] < 0.16


def test_samples_are_exact_in_size(spark):
    rows = spark.range(50).select((F.col("id") % 2).alias("g"), "id")
    assert sample_rows(rows, ["g"], "id", 0.3, 1).count() == 14  # a share is cut to a whole number: 7 of 25 in each group
    assert hold_out(rows, "id", 0.1, 1).filter("split = 'val'").count() == 5
    assert hold_out(rows.limit(0), "id", 0.1, 1).count() == 0


def test_npy_and_default_scorer(spark, tmp_path):
    np.save(tmp_path / "one_sat.npy", np.eye(4))
    np.save(tmp_path / "two.npy", np.ones((3, 5, 3)))
    rows = files.read_raster_npy(spark, str(tmp_path))
    assert {(r.tile_id, r.n) for r in files.to_pixels(rows).groupBy("tile_id").agg(F.count("*").alias("n")).collect()} == {("one", 16), ("two", 15)}
    assert cells(files.score_tiles(rows).filter("tile_id = 'one'")) == {(i, i) for i in range(4)}


def test_default_scorer_means_are_doubles(spark):
    """The mean of floats as a float rounds up to the last value here; the last value lies above it."""
    rows = spark.createDataFrame([("t", 0, [0.269786, 0.307829, 0.28880751])], "tile_id string, r int, vals array<float>")
    assert cells(files.score_tiles(rows)) == {(0, 1), (0, 2)}


def test_pairs_and_manifest(spark, tmp_path):
    paths = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    found = {r.scene_id: r.mask_path for r in files.pair_by_scene(paths("a_sat.tif", "b_sat.tif"), paths("m/a_mask.png", "z/a_mask.png")).collect()}
    assert found == {"a": "z/a_mask.png", "b": None}
    assert files.pair_by_suffix(paths("x/1_sat.jpg", "x/1_mask.png", "x/2_sat.jpg")).count() == 1
    named = ("/A/roads/q_img10.geojson", "/A/roads/y_img1.geojson", "/A/roads/z_img9.geojson", "/C/roads/y_img2.geojson", "/B/other/x_img1.geojson", "roads/a_img3.txt", "roads/b_img3.geojson", "/A/roads/rgb_img5.geojson")
    asked = {"/A/rgb/x_img1.tif": "/A/roads/q_img10.geojson", "/B/rgb/x_img1.tif": None, "/C/rgb/img9_x_img2.tif": "/C/roads/y_img2.geojson", "rgb/u_img3.tif": "roads/b_img3.geojson", "/A/rgb/y_img1.tif": "/A/roads/y_img1.geojson", "/A/rgb/v_img77.tif": None}
    labels = files.match_labels(paths(*asked), paths(*named), "rgb", "roads")
    assert {r.path: r.label_path for r in labels.collect()} == asked
    chips = spark.createDataFrame([("a", "train", 0, 1, "i", None)], "scene_id string, split string, row int, col int, image_path string, mask_path string")
    files.write_manifest(chips, str(tmp_path / "m"))
    assert files.scan_manifest(spark, str(tmp_path / "m"), "train").count() == 1


def test_geojson_keeps_first_edge_and_all_ends(spark, tmp_path):
    def feature(kind, xy, **p):
        return {"type": "Feature", "geometry": {"type": kind, "coordinates": xy}, "properties": p}

    doc = {"type": "FeatureCollection", "features": [
        feature("LineString", [[77.0, 12.0], [77.1, 12.0]], id="x", source="a", target="b"),
        feature("LineString", [[77.1, 12.0], [77.0, 12.0]], id="y", source="b", target="a"),
        feature("LineString", [[77.3, 12.0], [77.3, 12.0]], source="c", target="c"),
        feature("MultiLineString", [[[1, 2], [3, 4]], [[5, 6], [7, 8]]]),
    ]}
    (tmp_path / "n.json").write_text(json.dumps(doc))
    lines = networks.read_geojson(spark, str(tmp_path / "n.json"), "g")
    nodes, edges = networks.geojson_network(lines)
    assert [r.edge_id for r in edges.collect()] == ["x"] and {r.node for r in nodes.collect()} == {"a", "b", "c"}
    assert networks.centerlines(lines).count() == 5 and networks.geojson_chain(lines).count() == 1


def test_osm_junctions_split_ways(spark, tmp_path):
    doc = {"elements": [{"type": "node", "id": i, "lat": 12.0 + i / 1000, "lon": 77.0} for i in range(5)] + [
        {"type": "way", "id": 9, "nodes": [0, 1, 2, 3], "tags": {"highway": "primary"}}, {"type": "way", "id": 8, "nodes": [2, 4], "tags": {}}, {"type": "way", "id": 7, "nodes": [1]},
    ]}
    (tmp_path / "o.json").write_text(json.dumps(doc))
    nodes, ways = networks.read_osm(spark, str(tmp_path / "o.json"))
    _, edges = networks.osm_to_network(nodes, ways)
    assert {(min(r.src, r.dst), max(r.src, r.dst), r.road_class) for r in edges.collect()} == {(0, 2, "arterial"), (2, 3, "arterial"), (2, 4, "local")}


def test_half_width_reaches_across_the_tile(spark):
    near = [("one", r, c) for r in range(0, 96, 5) for c in range(0, 96, 5) if (r, c) != (0, 0)]
    full = [(t, r, c) for t in ("one", "none") for r in range(96) for c in range(96) if t == "none" or (r, c) != (0, 0)]
    found = {(x.tile_id, x.r, x.c): x.d for x in raster.half_width(spark.createDataFrame(full, "tile_id string, r int, c int"), 96).collect()}
    assert len(found) == len(full)
    assert all(found[t, r, c] == pytest.approx((r * r + c * c) ** 0.5) for t, r, c in near)
    assert found["one", 95, 95] == pytest.approx(95 * 2**0.5) and found["none", 50, 50] is None


def test_half_width_and_tolerance_against_brute_force(spark):
    """Masks with holes, full rows and full tiles, searched in pieces of any size."""
    rng = np.random.default_rng(9)
    size = 23
    tiles = {"a": rng.random((size, size)) < 0.9, "b": rng.random((size, size)) < 0.3, "full": np.ones((size, size), bool), "bar": np.pad(np.ones((size, 5), bool), ((0, 0), (9, 9)))}
    rows = [(t, int(r), int(c)) for t, m in tiles.items() for r, c in zip(*np.nonzero(m), strict=True)]
    frame = spark.createDataFrame(rows, "tile_id string, r int, c int")
    for columns in (1, 100, 1 << 16):
        found = {(x.tile_id, x.r, x.c): x.d for x in raster.half_width(frame, size, columns).collect()}
        assert len(found) == len(rows)
        for t, m in tiles.items():
            y, x = np.nonzero(~m)
            for r, c in zip(*np.nonzero(m), strict=True):
                want = np.sqrt(((y - r) ** 2 + (x - c) ** 2).min()) if len(y) else None
                assert found[t, r, c] == (pytest.approx(want) if want else None)
    masks = {k: spark.createDataFrame([x for x in rows if x[0] == "b" and (x[1] + x[2]) % 3 == i] + [(f"only{k}", 1, 1)], "tile_id string, r int, c int") for k, i in (("p", 0), ("t", 1))}
    cells_of = {k: {tuple(x) for x in df.collect() if x.tile_id == "b"} for k, df in masks.items()}
    for tolerance in (0, 1, 2, 3):
        near = {k: {a for a in cells_of[k] if any((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= tolerance**2 for b in cells_of[o])} for k, o in (("p", "t"), ("t", "p"))}
        found = {r.tile_id: (r.precision, r.recall, r.relaxed_iou) for r in raster.relaxed_iou(masks["p"], masks["t"], tolerance).collect()}
        p, t, m, k = len(cells_of["p"]), len(cells_of["t"]), len(near["p"]), len(near["t"])
        assert found == {"b": (pytest.approx(m / p), pytest.approx(k / t), pytest.approx(m / (p + t - k))), "onlyp": (0.0, 1.0, 0.0), "onlyt": (1.0, 0.0, 0.0)}


@pytest.mark.parametrize(("block", "halo"), [(64, 16), (5, 2), (7, 6), (256, 4)])
def test_thinning_in_blocks(spark, block, halo):
    """The same lines however tiles are cut, with shapes that take many exchanges, and places below 0."""
    shapes = {"disk": {(r, c) for r in range(-20, 21) for c in range(-20, 21) if r * r + c * c <= 380}, "bar": {(r, c) for r in range(9) for c in range(60)}, "dot": {(3, 3)}}
    rows = [(t, r, c) for t, s in shapes.items() for r, c in s]
    found = {(x.tile_id, x.r, x.c) for x in raster.thin(spark.createDataFrame(rows, "tile_id string, r int, c int"), block=block, halo=halo).collect()}
    for t, s in shapes.items():
        here = np.zeros((100, 100), bool)
        for r, c in s:
            here[r + 25, c + 25] = True
        while True:
            before = here.sum()
            for half in (0, 1):
                here &= ~raster._thinned(here, half)
            if here.sum() == before:
                break
        assert {(r, c) for u, r, c in found if u == t} == {(int(r) - 25, int(c) - 25) for r, c in zip(*np.nonzero(here), strict=True)}


def test_one_collection(spark, tmp_path):
    nodes = spark.createDataFrame([("g", i, 12.0 + i, 77.0) for i in range(4)], "graph_id string, node long, lat double, lng double")
    edges = spark.createDataFrame([("g", f"e{i}", i, i + 1) for i in range(3)], "graph_id string, edge_id string, src long, dst long")
    networks.write_geojson(nodes, edges, str(tmp_path / "whole"), collection=True)
    parts = [p for p in (tmp_path / "whole").iterdir() if p.suffix == ".txt"]
    assert len(parts) == 1 and [f["properties"]["id"] for f in json.loads(parts[0].read_text())["features"]] == ["e0", "e1", "e2"]
    networks.write_geojson(nodes, edges.limit(0), str(tmp_path / "none"), collection=True)
    assert networks.read_geojson(spark, str(tmp_path / "none"), "g").count() == 0
    assert networks.read_geojson(spark, str(tmp_path / "whole"), "g").count() == 3


def test_cover_takes_the_share_of_cover_first_as_its_sql_does(spark):
    own = spark.createDataFrame([(110.0, 0.150237)], "v double, alpha double")
    assert own.select(raster.cover(F.col("v"), F.col("alpha"), "canopy", 0.7).alias("x")).first().x == 110


def test_resized_tiles_are_not_joined_and_match_numpy(spark):
    rng = np.random.default_rng(3)
    a = rng.random((10, 6))
    own = spark.createDataFrame([("t", r, c, float(a[r, c])) for r in range(10) for c in range(6)], "tile_id string, r int, c int, v double")
    for to in (4, 6, 9, 17):
        near, smooth = raster.resize_nearest(own, 10, 6, to), raster.resize_bilinear(own, 10, 6, to)
        assert all("Join" not in df._jdf.queryExecution().executedPlan().toString() for df in (near, smooth))
        got = {(r.r, r.c): r.v for r in near.collect()}
        assert got == {(y, x): a[y * 10 // to, x * 6 // to] for y in range(to) for x in range(to)}

        def at(n, i):
            place = min(max((i + 0.5) * n / to - 0.5, 0), n - 1)
            return int(place), min(n - 1, int(place) + 1), place - int(place)

        got = {(r.r, r.c): r.v for r in smooth.collect()}
        assert len(got) == to * to
        for (y, x), v in got.items():
            (r0, r1, p), (c0, c1, q) = at(10, y), at(6, x)
            assert v == pytest.approx((1 - p) * ((1 - q) * a[r0, c0] + q * a[r0, c1]) + p * ((1 - q) * a[r1, c0] + q * a[r1, c1]), abs=1e-8)
