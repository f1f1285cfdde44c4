"""Documents of any layout read in ranges, and chips as files."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.sources import files, networks
from viaduct.sources.json_items import read_items


def feature(i):
    name = 'odd "{[\\' + "\\" * (i % 3) + "]}" + "é漢" * (i % 5)
    return {"type": "Feature", "properties": {"id": f"f{i}", "name": name, "tags": [{"a": 1}, {"b": [2]}], "source": f"n{i}", "target": f"n{i + 1}"}, "geometry": {"type": "LineString", "coordinates": [[77 + i / 1000, 12], [77 + i / 1000, 12.5]]}}


LAYOUTS = {
    "one_line": lambda fs: json.dumps({"type": "FeatureCollection", "features": fs}),
    "indented": lambda fs: json.dumps({"crs": {"type": "name", "properties": {"name": "x"}}, "features": fs, "type": "FeatureCollection"}, indent=4, ensure_ascii=False),
    "lines": lambda fs: "\n".join(json.dumps(f) for f in fs),
    "collections": lambda fs: " ".join(json.dumps({"type": "FeatureCollection", "features": fs[k : k + 7]}) for k in range(0, len(fs), 7)),
    "one_each": lambda fs: "\n\n".join(json.dumps(f, indent=1) for f in fs),
}


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("size", [61, 700, 8 << 20])
def test_any_layout_gives_the_same_features(spark, tmp_path, layout, size):
    """Ranges end inside of strings, escapes and characters; each feature is read once."""
    fs = [feature(i) for i in range(23)]
    (tmp_path / "n.geojson").write_text(LAYOUTS[layout](fs), encoding="utf-8")
    found = networks.read_geojson(spark, str(tmp_path / "n.geojson"), "g", size).orderBy("line").collect()
    assert [json.loads(r.value) for r in found] == fs
    if layout in ("one_line", "indented", "collections"):
        assert [r.pos for r in found] == list(range(23))
    edges = networks.geojson_network(networks.read_geojson(spark, str(tmp_path / "n.geojson"), "g", size))[1]
    assert {r.edge_id for r in edges.collect()} == {f"f{i}" for i in range(23)}


def test_a_large_document_keeps_many_tasks_busy(spark, tmp_path):
    fs = [feature(i) for i in range(4000)]
    (tmp_path / "n.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": fs}))
    found = networks.read_geojson(spark, str(tmp_path / "n.geojson"), "g", 1 << 16).withColumn("task", F.spark_partition_id())
    tasks = found.groupBy("task").count().collect()
    assert sum(r["count"] for r in tasks) == 4000 and len(tasks) > 4


@pytest.mark.parametrize(("text", "wrong"), [
    ('{"type": "FeatureCollection", "features": [{"type": "Feature"}', "ends inside"), ('{"a": "b}', "ends inside"), ("]", "closes"),
    ('{"type": "Topology", "objects": {}}', "no GeoJSON"), ('{"some": "thing"}', "no GeoJSON"), ("", "empty"),
])
def test_what_is_no_geojson_is_an_error(spark, tmp_path, text, wrong):
    (tmp_path / "n.json").write_text(text)
    with pytest.raises(Exception, match=wrong):
        networks.read_geojson(spark, str(tmp_path / "n.json"), "g").collect()


def test_empty_collections_and_missing_files(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"type": "FeatureCollection", "features": []}')
    assert networks.read_geojson(spark, str(tmp_path / "n.json"), "g").count() == 0
    with pytest.raises(FileNotFoundError):
        read_items(spark, str(tmp_path / "none.json"))


@pytest.mark.parametrize("indent", [None, 2])
def test_osm_documents_in_ranges(spark, tmp_path, indent):
    doc = {"version": 0.6, "osm3s": {"note": "[{"}, "elements": [{"type": "node", "id": i, "lat": 12.0 + i / 1000, "lon": 77.0} for i in range(300)] + [{"type": "way", "id": 9, "nodes": list(range(300)), "tags": {"highway": "primary", "name": 'x"}'}}]}
    (tmp_path / "o.json").write_text(json.dumps(doc, indent=indent))
    nodes, ways = networks.read_osm(spark, str(tmp_path / "o.json"), 500)
    assert {r.id for r in nodes.collect()} == set(range(300)) and [(r.id, len(r.nodes), r.tags["name"]) for r in ways.collect()] == [(9, 300, 'x"}')]


def chips(spark):
    rng = random.Random(1)
    scenes = spark.createDataFrame([(f"s{k}", 40 + k, 30) for k in range(6)], "scene_id string, h int, w int")
    pixels = [(f"s{k}", r, c, round(rng.random(), 3)) for k in range(6) for r in range(40 + k) for c in range(30)]
    images = spark.createDataFrame(pixels, "scene_id string, r int, c int, v double")
    return scenes, images, images.filter("scene_id <> 's5' and v > 0.7").withColumn("v", F.lit(1.0)), {x[:3]: x[3] for x in pixels}


def test_chips_are_files_that_a_loader_opens(spark, tmp_path):
    scenes, images, masks, value = chips(spark)
    path = str(tmp_path / "chips")
    for again in (False, True):
        rows = files.build_chips(images, masks, scenes, path, 16, 4).collect()
        there = {str(p.relative_to(tmp_path)) for p in (tmp_path / "chips").rglob("*.npy")}
        named = {p[len(str(tmp_path)) + 1 :] for r in rows for p in (r.image_path, r.mask_path) if p}
        assert there == named and sum(r.mask_path is None for r in rows) == sum(r.scene_id == "s5" for r in rows) > 0
    offsets = {(r.scene_id, r.row, r.col): (r.y0, r.x0) for r in files.tile_offsets(scenes, 16, 4).collect()}
    for r in rows[::7]:
        y, x = offsets[r.scene_id, r.row, r.col]
        a = np.load(r.image_path)
        assert a.shape == (16, 16) and a[3, 5] == np.float32(value[r.scene_id, y + 3, x + 5])
    pairs = {s: {(p.image_path, p.mask_path) for p in files.training_pairs(spark, path, s).collect()} for s in ("train", "val", "test")}
    assert set.union(*pairs.values()) == {(r.image_path, r.mask_path) for r in rows if r.mask_path}
    for r in files.split_summary(spark.createDataFrame(rows)).collect():
        assert r.chips == sum(x.split == r.split for x in rows)
    gone = next(r for r in rows if r.mask_path)
    (tmp_path / gone.image_path).unlink()
    assert (gone.image_path, gone.mask_path) not in {(p.image_path, p.mask_path) for p in files.training_pairs(spark, path, gone.split).collect()}
    files.remove_manifest(spark, path)  # without one, names pair files
    assert {(p.image_path, p.mask_path) for p in files.training_pairs(spark, path, gone.split).collect()} == pairs[gone.split] - {(gone.image_path, gone.mask_path)}


@pytest.mark.parametrize("piece", [1, 1000, 8 << 20])
def test_rasters_in_pieces(spark, tmp_path, piece):
    a, b = np.arange(600, dtype="<i2").reshape(30, 20), np.random.default_rng(1).random((9, 7, 4))
    np.save(tmp_path / "a.npy", a)
    np.save(tmp_path / "b.npy", b)
    np.save(tmp_path / "c.npy", np.asfortranarray(a))
    found = {(r.tile_id, r.r): r.vals for r in files.read_raster_npy(spark, str(tmp_path), piece).collect()}
    assert len(found) == 69
    assert all(found[n, r] == a[r].tolist() for n in "ac" for r in range(30)) and all(found["b", r] == pytest.approx(b[r, :, :3].mean(axis=1).tolist(), rel=1e-6) for r in range(9))
    np.save(tmp_path / "d.npy", np.zeros(4))
    with pytest.raises(Exception, match="no raster"):
        files.read_raster_npy(spark, str(tmp_path)).collect()


def test_small_rasters_share_a_task(spark, tmp_path):
    """Every file was a task of its own."""
    for i in range(40):
        np.save(tmp_path / f"t{i}.npy", np.full((2, 3), i, np.float32))
    before = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("rasters", "rasters")
    found = files.read_raster_npy(spark, str(tmp_path)).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    stages = [before.getStageInfo(k) for j in before.getJobIdsForGroup("rasters") for k in before.getJobInfo(j).stageIds]
    assert max(s.numTasks for s in stages if s) < 40
    assert sorted((r.tile_id, r.r, r.vals) for r in found) == sorted((f"t{i}", r, [float(i)] * 3) for i in range(40) for r in (0, 1))


def test_labels_are_dealt_out(spark, monkeypatch):
    """The pieces of all names were sorted by the tasks that read them, however few these were."""
    own, dealt = type(spark.range(1)), []
    repartition = own.repartition
    monkeypatch.setattr(files, "TASK_LABELS", 5)
    monkeypatch.setattr(own, "repartition", lambda df, *a: dealt.append(a) or repartition(df, *a))
    images = spark.createDataFrame([(f"/d/PS-RGB/a_PS-RGB_img{k}.tif",) for k in range(40)], "path string").coalesce(1)
    labels = spark.createDataFrame([(f"/d/geojson_roads/b_img{k}.geojson",) for k in range(40)], "path string").coalesce(1)
    found = {r.path: r.label_path for r in files.match_labels(images, labels).collect()}
    assert dealt == [(8, "label_path")] and found["/d/PS-RGB/a_PS-RGB_img17.tif"] == "/d/geojson_roads/b_img17.geojson" and len(found) == 40
