"""Further queries: files written and read again, views of a network side by side, reports, chips and covered images."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import scalars as S
from viaduct.operators import annotate, healing, occlusion, raster, reports, resilience, sampling, vectorize
from viaduct.plans.derived import EMB_SQL, GRID_SQL, TRADE_SQL, USER_SQL, _hav, customer_grid, embedding_pixels, line_pixels, table, trade_network, user_network
from viaduct.plans.graph_queries import CUT_SQL, DIST_SQL, FLOW_SQL, SIMULATE_SQL, VIEW_SQL, _DEG, _scenarios, _scored, _state, _views
from viaduct.plans.table_queries import _SC, _TILES, SIZE, WAYS_SQL, _pairs, _scenes, _ways
from viaduct.session import scratch, stored
from viaduct.sources import files, networks

# --- files ---------------------------------------------------------------------------------------------------------


def osm_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ways and their nodes written as OSM JSON, a document a way, and read again; motorways to primary roads only."""
    nodes, ways = _ways(spark, sf_dir)
    at = ways.select(F.col("id").alias("way"), F.explode(F.array_distinct("nodes")).alias("id")).join(nodes, "id")
    points = at.groupBy("way").agg(F.collect_list(F.struct(F.lit("node").alias("type"), "id", "lat", "lon")).alias("points"))  # bounded, as ways are
    way = F.struct(F.lit("way").alias("type"), F.xxhash64("id").alias("id"), "nodes", "tags")
    text = F.concat(F.lit('{"elements":['), F.array_join(F.transform("points", lambda p: F.to_json(p)), ","), F.lit(","), F.to_json(way), F.lit("]}"))
    path = scratch(spark, "osm")
    ways.join(points, F.col("id") == F.col("way")).select(text.alias("value")).write.text(path)
    _, found = networks.read_osm(spark, path)
    return networks.allowed_ways(found, ("motorway", "trunk", "primary", "primary_link")).select(F.element_at("nodes", 1).alias("first"), F.element_at("nodes", -1).alias("last"), F.size("nodes").alias("nodes"))


def area_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = customer_grid(spark, sf_dir)
    return networks.within_area(nodes.withColumnRenamed("lng", "lon"), 12.005, 12.02, 77.003, 77.03).select("node", "lat", "lon")


def npy_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding tiles written as .npy files and read again: the sum of each row."""
    px = embedding_pixels(spark, sf_dir)
    rows = px.groupBy("tile_id", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "prob"))), lambda x: x["prob"].cast("float")).alias("vals"))
    path = scratch(spark, "npy")
    files.write_raster_npy(rows, path)
    back = files.to_pixels(files.read_raster_npy(spark, path))
    return back.groupBy("tile_id", "r").agg(F.round(F.sum("v"), 4).alias("total"), F.count(F.lit(1)).alias("n"))


def suffix_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("/d/"), "source", F.lit("_"), "doc_id").alias("stem"))
    every = own.select(F.concat("stem", F.lit("_sat.jpg")).alias("path")).union(own.filter("doc_id % 3 <> 0").select(F.concat("stem", F.lit("_mask.png"))))
    return files.pair_by_suffix(every)


def label_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Areas by source; every second image has a label of its name, some others one that only shares the number's beginning.

    Each area has labels for all numbers of the next one too, which are not for its own images, and one outside its folder.
    """
    own = table(spark, sf_dir, "documents").select("doc_id", "source")
    images = own.select(F.concat(F.lit("/d/"), "source", F.lit("/PS-RGB/a_PS-RGB_img"), "doc_id", F.lit(".tif")).alias("path"))
    direct = own.filter("doc_id % 2 = 0").select(F.concat(F.lit("/d/"), "source", F.lit("/geojson_roads/a_geojson_roads_img"), "doc_id", F.lit(".geojson")).alias("path"))
    near = own.filter("doc_id % 10 = 1").select(F.concat(F.lit("/d/"), "source", F.lit("/geojson_roads/b_img"), "doc_id", F.lit("7.geojson")))
    apart = own.filter("doc_id % 10 = 3").select(F.concat(F.lit("/d/"), "source", F.lit("/old/c_img"), "doc_id", F.lit(".geojson")))
    alien = own.select(F.concat(F.lit("/d/x"), "source", F.lit("/geojson_roads/a_geojson_roads_img"), "doc_id", F.lit(".geojson")))
    return files.match_labels(images, direct.union(near).union(apart).union(alien))


def chip_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The training rows of a manifest whose files are there: every fifth image is not."""
    chips = files.manifest(_pairs(spark, sf_dir), raster.tile_offsets(_scenes(spark, sf_dir)))
    listing = chips.filter("row % 5 <> 4").select(F.explode(F.array("image_path", "mask_path")).alias("path"))
    return files.scan_chip_pairs(chips, listing, "train").groupBy("image_path", "mask_path").agg(F.count(F.lit(1)).alias("chips"))


def manifest_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest written as CSV and the rows of one split read again."""
    path = scratch(spark, "manifest")
    files.write_manifest(files.manifest(_pairs(spark, sf_dir), raster.tile_offsets(_scenes(spark, sf_dir))), path)
    return files.scan_manifest(spark, path, "val").select("scene_id", "row", "col", "image_path", F.coalesce("mask_path", F.lit("")).alias("mask_path"))


def hold_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hold_out(_scenes(spark, sf_dir).select("scene_id"), "scene_id", 0.1, 3)


def tile_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    scenes = _scenes(spark, sf_dir)
    return raster.coverage(scenes, raster.tile_offsets(scenes))


def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A lattice with as many rows and columns as it takes to hold all customers, with its dead ends."""
    side = int(table(spark, sf_dir, "customer").agg(F.ceil(F.sqrt(F.count(F.lit(1))))).first()[0])
    return networks.grid_network(spark, side, side)[1].select("edge_id", "src", "dst", "length_m", "road_class", "travel_time")


def plain_multigraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as parallel roads; the last of each pair stays."""
    nodes, _ = trade_network(spark, sf_dir)
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    own = own.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = own.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    own = own.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = own.select(F.lit("trade").alias("graph_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("key"), F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.col("l_quantity").alias("length"))
    points, simple = networks.multigraph_plain(nodes, edges)
    return simple.join(points.select(F.col("node").alias("src"), "x", "y"), "src").select("src", "dst", "length", F.round("x", 6).alias("x"), F.round("y", 6).alias("y"))


def node_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links of the trade network's JSON object."""
    nodes, edges = trade_network(spark, sf_dir)
    parsed = networks.node_link(nodes, edges).select(F.from_json("value", "nodes array<struct<id:bigint>>, links array<struct<source:bigint,target:bigint,id:string>>").alias("g"))
    return parsed.select(F.size("g.nodes").alias("nodes"), F.explode("g.links").alias("l")).select("nodes", F.col("l.source").alias("source"), F.col("l.target").alias("target"), F.col("l.id").alias("id"))


def distinct_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = user_network(spark, sf_dir)
    return sampling.sample_pairs(nodes, 2000, 11, 500).select("draw", "s", "t")


# --- views and reports -----------------------------------------------------------------------------------------------

# The views by input and model, their network, and IoU, Dice and occlusion recall of their segmentation.
VIEWS = (
    ("clean", "robust", "intact", 0.526, 0.689, 0.665),
    ("clean", "baseline", "intact", 0.528, 0.691, 0.671),
    ("occluded", "robust", "intact", 0.511, 0.676, 0.648),
    ("occluded", "baseline", "fragmented", 0.439, 0.610, 0.528),
)


def views_table(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(VIEWS, "input string, model string, graph_id string, iou double, dice double, occlusion_recall double"))


def view_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all four views with the constants of segmentation quality that belong to them."""
    _, edges, state, base = _state(spark, sf_dir)
    size = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    found = resilience.resilience_index(state, base).join(size, "graph_id").join(views_table(spark), "graph_id")
    return found.select("input", "model", "iou", "dice", "occlusion_recall", "resilience_index", "n", "edges")


def catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The views that can be asked for, with the size of their networks."""
    _, edges = _views(spark, sf_dir)
    size = edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"))
    return size.join(views_table(spark), "graph_id").select(F.lit("trade").alias("city"), "input", "model", "edges").distinct()


def _annotated_views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return annotate.annotate_network(*_views(spark, sf_dir))


def view_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotated edges of all four views; networks that views share are annotated once."""
    edges = _annotated_views(spark, sf_dir)[1].join(views_table(spark), "graph_id")
    return edges.select("input", "model", "edge_id", "src", "dst", "length_m", "road_class", "travel_time", "criticality", "is_bridge")


def view_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curves of all four views, against the efficiency of the whole network."""
    nodes, edges = annotate.scored_network(*_views(spark, sf_dir))
    whole = resilience.graph_state(nodes.filter("graph_id = 'intact'"), edges.filter("graph_id = 'intact'")).select(F.col("efficiency").alias("base_efficiency"))
    base = stored(nodes.select("graph_id").distinct().crossJoin(F.broadcast(whole)), "base")  # one row
    found = resilience.resilience_curve(nodes, edges.withColumn("raw", F.round("raw", 9)), base).join(views_table(spark), "graph_id")
    return found.select("input", "model", "step", "removed_fraction", "efficiency", F.round("giant", 3).alias("giant"))


def view_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the fragmented view loses of the whole network's links and gatekeepers, and what stands there in their place."""
    nodes, edges = _annotated_views(spark, sf_dir)
    of = lambda df, view: df.filter(F.col("graph_id") == view)
    top = stored(annotate.gatekeepers(nodes), "gatekeepers")
    return reports.changes(of(edges, "intact"), of(edges, "fragmented"), "link", "edge_id").unionByName(reports.changes(of(top, "intact"), of(top, "fragmented"), "gatekeeper", "node"))


def toggle_impact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of the index and share of routes cut, for each closure of one node or edge of the trade network."""
    nodes, edges = trade_network(spark, sf_dir)
    state = resilience.graph_state(nodes, edges)
    base = stored(state.select("graph_id", F.col("efficiency").alias("base_efficiency")), "base")
    index = resilience.resilience_index(state, base).select("graph_id", "resilience_index")
    return reports.toggle_impact(resilience.simulate_removal(nodes, edges, _scenarios(nodes, edges), base), index).drop("graph_id")


def critical_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = _scored(spark, sf_dir)[1]
    return reports.critical_edges(scored).join(reports.critical_counts(scored), "graph_id").select("edge_id", "criticality", "edges", "critical")


def highest_edge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.highest_edge(_scored(spark, sf_dir)[1]).select("edge_id", "criticality")


def curve_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Discounts, taxes and quantities of an order as three arrays, the last one shorter by one."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_discount", "l_tax", "l_quantity"))).alias("x"))
    share = lambda c, k: F.transform("x", lambda x: x[c] * k)
    curves = lines.select("l_orderkey", share("l_discount", 11.0).alias("removed_fraction"), share("l_tax", 10.0).alias("efficiency"), F.slice(share("l_quantity", 0.02), F.lit(1), F.size("x") - 1).alias("giant"))
    return reports.curve_rows(curves, ["l_orderkey"])


def kpi_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.when(F.col("l_linenumber") == 3, None).otherwise(F.col("l_discount") * 12)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", S.percent_text(v).alias("text"), F.round(S.clamp(v), 6).alias("share"), F.round(S.clamp(v * 100, 0.0, 100.0), 6).alias("percent"))


def heal_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two views of the grid of customers, of which one is healed, over wider gaps."""
    nodes, edges = customer_grid(spark, sf_dir)
    views = [df.withColumn("graph_id", F.lit(v)) for df in (nodes, edges) for v in ("open", "closed")]
    flags = spark.createDataFrame([("open", False), ("closed", True)], "graph_id string, enabled boolean")
    healed = healing.heal_network(stored(views[0].union(views[1]), "nodes"), stored(views[2].union(views[3]), "edges"), 200.0, fallback_all=True, views=flags)
    return healed.filter("healed").select("graph_id", "edge_id", "src", "dst", "length_m")


# --- chips and images --------------------------------------------------------------------------------------------------


def _scene_pixels(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Embedding tiles as scenes of 100 x 64 pixels."""
    px = embedding_pixels(spark, sf_dir).withColumnRenamed("tile_id", "scene_id")
    scenes = px.groupBy("scene_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    return px, stored(scenes, "scenes")


def tile_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, scenes = _scene_pixels(spark, sf_dir)
    return raster.cut_tiles(px.select("scene_id", "r", "c", "prob"), scenes, 32, 8).select("tile_id", "r", "c", "prob")


def build_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of images and masks written by split and read again."""
    px, scenes = _scene_pixels(spark, sf_dir)
    path = scratch(spark, "chips")
    masks = px.filter("target").select("scene_id", "r", "c", F.lit(1.0).alias("v"))
    files.build_chips(px.select("scene_id", "r", "c", F.col("prob").alias("v")), masks, scenes, path, 32, 8)
    found = files.read_chips(spark, path).filter("kind = 'images' or v > 0").groupBy("split", "kind", "tile_id")
    return found.agg(F.count(F.lit(1)).alias("pixels"), F.round(F.sum(F.col("v").cast("double")), 3).alias("total"))


def training_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chips of scenes of which every second has a mask, written, and the pairs that a training run would find."""
    px, scenes = _scene_pixels(spark, sf_dir)
    path = scratch(spark, "chips")
    masks = px.filter("target").filter(F.substring("scene_id", -1, 1).cast("int") % 2 == 0).select("scene_id", "r", "c", F.lit(1.0).alias("v"))
    files.build_chips(px.select("scene_id", "r", "c", F.col("prob").alias("v")), masks, scenes, path, 32, 8)
    found = reduce(DataFrame.unionByName, [files.training_pairs(spark, path, split).withColumn("split", F.lit(split)) for split in ("train", "val", "test")])
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    return found.select("split", name("image_path").alias("image"), name("mask_path").alias("mask"))


def padded(spark: SparkSession, sf_dir: str) -> DataFrame:
    px, _ = _scene_pixels(spark, sf_dir)
    own = px.select(F.col("scene_id").alias("tile_id"), "r", "c", F.col("prob").alias("v"))
    return raster.padded(own, own.select("tile_id").distinct(), 112)


def resized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of 100 x 64 resampled to 40 x 40, by the nearest pixel and by four neighbours."""
    own = embedding_pixels(spark, sf_dir).select("tile_id", "r", "c", F.col("prob").alias("v"))
    near, smooth = raster.resize_nearest(own, 100, 64, 40), raster.resize_bilinear(own, 100, 64, 40)
    none = F.lit(None).cast("double")
    both = near.select(*raster.AT, F.col("v").alias("nearest"), none.alias("bilinear")).unionByName(smooth.select(*raster.AT, none.alias("nearest"), F.col("v").alias("bilinear")))
    # grouped, not joined: what Spark guesses of exploded pixels lets it broadcast them
    return both.groupBy(*raster.AT).agg(F.max("nearest").alias("nearest"), F.max("bilinear").alias("bilinear")).filter("nearest is not null and bilinear is not null")


def normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Mean and deviation of the red channel of common image models.
    own = embedding_pixels(spark, sf_dir)
    return own.select("tile_id", "r", "c", F.round(S.normalise_channel(F.col("prob") * 255, 0.485, 0.229), 6).alias("v"))


def masks_joined(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = embedding_pixels(spark, sf_dir)
    tiles = px.groupBy("tile_id").agg((F.max("r") + 1).alias("h"), (F.max("c") + 1).alias("w"))
    return raster.join_masks(px.filter("pred >= 0.55"), px.filter("target"), px.filter("occluded"), tiles, tiles)


def scaled_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of whole numbers: what reaches half of the tile's largest value, and eight-bit masks above 127."""
    own = embedding_pixels(spark, sf_dir).select("tile_id", "r", "c", F.floor(F.col("prob") * 200).cast("int").alias("v"))
    half = raster.scaled_foreground(own).groupBy("tile_id").agg(F.count(F.lit(1)).alias("half"))
    eight = own.filter(S.foreground("v", 127, strict=True)).groupBy("tile_id").agg(F.count(F.lit(1)).alias("above_127"))
    return half.join(eight, "tile_id", "full")


def transform_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images and masks of the embedding tiles mirrored together."""
    px = embedding_pixels(spark, sf_dir)
    rows = lambda c: px.groupBy("tile_id", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", F.col(c).cast("float").alias("v")))), lambda x: x["v"]).alias("vals"))
    found = files.transform_pairs(rows("prob"), rows("target"), lambda image, mask: (image[:, ::-1], mask[:, ::-1]))
    return found.select("tile_id", "r", "c", F.round("v", 5).alias("v"), F.col("mask").cast("int").alias("mask"))


def skeleton_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masks of lineitem, widened, as skeletons and networks: share of road, pixels of skeleton, edges by class."""
    px = line_pixels(spark, sf_dir).filter(S.foreground("prob", 0.8))
    mask = stored(raster.dilate(px, SIZE), "mask")
    lines = stored(vectorize.skeletonize(mask.withColumn("prob", F.lit(1.0)), SIZE, 0.5, 16), "skeleton")
    edges = vectorize.skeleton_to_network(lines, vectorize.Projection.pixels(30.0))[1]
    tiles = mask.select("tile_id").distinct().withColumns({"h": F.lit(SIZE), "w": F.lit(SIZE)})
    return vectorize.skeleton_stats(mask, lines, edges, tiles).withColumn("road_fraction", F.round("road_fraction", 9))


def _image(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    px = embedding_pixels(spark, sf_dir)
    grey = F.floor(F.col("prob") * 255).cast("int")
    tiles = px.select("tile_id").distinct().withColumns({"h": F.lit(100), "w": F.lit(64)})
    return px.select("tile_id", "r", "c", grey.alias("red"), (255 - grey).alias("green"), grey.alias("blue")), tiles


def occluded_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embedding tiles as images under all the effects that are drawn for them."""
    pixels, tiles = _image(spark, sf_dir)
    return occlusion.random_occlude(pixels, tiles, 4)


def building_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    pixels, tiles = _image(spark, sf_dir)
    return occlusion.OCCLUDERS["building"](pixels, tiles, 2)


QUERIES = {
    "osm_scan": osm_scan, "area_filter": area_filter, "npy_scan": npy_scan, "suffix_pairs": suffix_pairs, "label_match": label_match,
    "chip_pairs": chip_pairs, "manifest_csv": manifest_csv, "hold_out": hold_out, "tile_coverage": tile_coverage, "lattice": lattice,
    "plain_multigraph": plain_multigraph, "node_link": node_link, "distinct_pairs": distinct_pairs, "view_metrics": view_metrics,
    "view_network": view_network, "view_curve": view_curve, "view_changes": view_changes, "toggle_impact": toggle_impact,
    "critical_edges": critical_edges, "highest_edge": highest_edge, "curve_rows": curve_rows, "kpi_text": kpi_text, "heal_views": heal_views,
    "tile_pixels": tile_pixels, "build_chips": build_chips, "training_pairs": training_pairs, "padded": padded, "resized": resized, "normalised": normalised,
    "masks_joined": masks_joined, "scaled_masks": scaled_masks, "skeleton_stats": skeleton_stats, "catalogue": catalogue, "transform_pairs": transform_pairs, "occluded_images": occluded_images,
    "building_cover": building_cover,
}

_T = f"WITH RECURSIVE {TRADE_SQL}"
_E = f"WITH RECURSIVE {EMB_SQL}"
_PR = "pr AS (SELECT scene_id, path AS image_path, CASE WHEN doc_id%3<>0 THEN '/masks/'||scene_id||'_mask.png' END AS mask_path FROM sc)"
_CHIPS = f"WITH {_SC}, {_TILES}, {_PR}, ch AS (SELECT tl.scene_id, sp.split, tl.row, tl.col, image_path, mask_path FROM tl JOIN sp USING (scene_id) JOIN pr ON pr.scene_id=tl.scene_id)"
# The trade network as one view leaves it: ``edges`` and ``sym`` are those of the view.
_VIEWED = TRADE_SQL.replace("\nedges AS", "\nedges0 AS").split("sym AS (SELECT src, dst, w, edge_id")[0].rstrip().rstrip(",") + "," + VIEW_SQL.replace("FROM edges)", "FROM edges0)").replace("SELECT 'intact' AS view, * FROM edges ", "SELECT 'intact' AS view, * FROM edges0 ")


def _view(view: str, *more: str) -> str:
    """A query over one view; its tables come under their usual names."""
    own = f"edges AS (SELECT * EXCLUDE (view) FROM vedges WHERE view='{view}'), sym AS (SELECT src, dst, w, edge_id FROM edges UNION ALL SELECT dst, src, w, edge_id FROM edges)"
    return "WITH RECURSIVE " + ",".join([_VIEWED, own, *more])


_V = "(VALUES " + ",".join(f"('{i}','{m}','{g}',{a}::DOUBLE,{b}::DOUBLE,{c}::DOUBLE)" for i, m, g, a, b, c in VIEWS) + ") q(input,model,view,iou,dice,occlusion_recall)"
_NOTED = "SELECT e.edge_id, e.src, e.dst, e.length_m, e.road_class, e.travel_time, x.criticality, e.edge_id IN (SELECT edge_id FROM bridge) AS is_bridge FROM edges e JOIN eb2 x ON x.edge_id=e.edge_id"
_TOP = "SELECT node FROM (SELECT node, row_number() OVER (ORDER BY betweenness DESC, node) AS rk FROM nb2) WHERE rk<=8"
_VCURVE = """
ao AS (SELECT *, row_number() OVER (ORDER BY round(raw,9) DESC, edge_id) AS rank, count(*) OVER () AS m FROM eb2),
steps AS (SELECT s.step, greatest(1, floor(m*0.5/10)) AS per, m FROM (SELECT unnest(generate_series(0,10)) AS step) s, (SELECT DISTINCT m FROM ao) WHERE s.step=0 OR (s.step-1)*greatest(1, floor(m*0.5/10))<m),
cs AS (SELECT t.step, e.src, e.dst, x.w FROM steps t JOIN ao e ON ceil(e.rank/t.per)>t.step JOIN edges x ON x.edge_id=e.edge_id),
csym AS (SELECT step, src, dst, w FROM cs UNION ALL SELECT step, dst, src, w FROM cs),
cd(step, s, v, d) USING KEY (step, s, v) AS (SELECT t.step, n.node, n.node, 0::BIGINT FROM steps t, nodes n
  UNION SELECT x.step, x.s, e.dst, min(x.d+e.w) FROM cd x JOIN csym e ON e.step=x.step AND e.src=x.v LEFT JOIN recurring.cd r ON r.step=x.step AND r.s=x.s AND r.v=e.dst
  WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.step, x.s, e.dst),
ce AS (SELECT step, sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END)/(SELECT count(*)*(count(*)-1) FROM nodes) AS eff FROM cd GROUP BY step),
cg AS (SELECT step, max(size)/sum(size) AS giant FROM (SELECT step, comp, count(*) AS size FROM (SELECT step, s, min(v) AS comp FROM cd GROUP BY ALL) GROUP BY ALL) GROUP BY step),
res AS (SELECT t.step::INT AS step, round_even(t.step*per/m,3) AS removed_fraction, round_even(round(eff/(SELECT efficiency FROM vstate WHERE view='intact'),9),3) AS efficiency, round(CASE WHEN t.step=0 THEN giant ELSE round_even(giant,3) END,3) AS giant FROM steps t JOIN ce ON ce.step=t.step JOIN cg ON cg.step=t.step)
"""
_OFF32 = "CASE WHEN {n}>32 THEN list_sort(list_distinct(list_concat(generate_series(0,{n}-32,24),[{n}-32]))) ELSE [0::BIGINT] END"
_CUT32 = f"""
ss AS (SELECT tile_id AS scene_id, max(r)+1 AS h, max(c)+1 AS w FROM px GROUP BY 1),
ya AS (SELECT scene_id, w, unnest({_OFF32.format(n='h')}) AS y0, unnest(generate_series(0, len({_OFF32.format(n='h')})-1)) AS row FROM ss),
tt AS (SELECT scene_id, row, y0, unnest({_OFF32.format(n='w')}) AS x0, unnest(generate_series(0, len({_OFF32.format(n='w')})-1)) AS col FROM ya),
tp AS (SELECT scene_id||'_r'||row||'_c'||col AS tile_id, scene_id, (r-y0)::INT AS r, (c-x0)::INT AS c, prob, target FROM px JOIN tt ON scene_id=px.tile_id AND r BETWEEN y0 AND y0+31 AND c BETWEEN x0 AND x0+31)
"""


def _unit(seed: int, effect: str, name: str, i: str = "") -> str:
    return f"('0x'||substr(sha256('{seed}|'||tile_id||'|{effect}|{name}'{i and f'||{chr(39)}|{chr(39)}||{i}'}),1,8))::BIGINT/4294967296.0"


def _soft_sql(seed: int, before: str, after: str, effect: str, drawn: str) -> str:
    """CTEs that lay the blobs of an effect over the pixels ``before``."""
    least, most, low, high, strength, colour = occlusion.SOFT[effect]
    blend = ", ".join(f"floor(round({c}*(1-a)+{to}*a,6))::INT AS {c}" for c, to in zip(occlusion.CHANNELS, colour, strict=True))
    return f"""
{after}n AS (SELECT tile_id, unnest(generate_series(0, {least}+floor({_unit(seed, effect, 'n')}*{most - least + 1})::INT-1)) AS i FROM {drawn}),
{after}b AS (SELECT tile_id, {_unit(seed, effect, 'y', 'i')}*100 AS y, {_unit(seed, effect, 'x', 'i')}*64 AS x, ({low}+{_unit(seed, effect, 'radius', 'i')}*({high}-{low}))*64 AS sg FROM {after}n),
{after}a AS (SELECT p.tile_id, p.r, p.c, round(greatest(0.0,least(1.0,max(exp(-(pow(p.r-y,2)+pow(p.c-x,2))/(2*sg*sg))))),6)*{strength} AS a FROM {before} p JOIN {after}b USING (tile_id) GROUP BY ALL),
{after} AS (SELECT tile_id, r, c, {blend} FROM (SELECT p.*, coalesce(q.a,0.0) AS a FROM {before} p LEFT JOIN {after}a q ON q.tile_id=p.tile_id AND q.r=p.r AND q.c=p.c))"""


def _building_sql(seed: int, before: str, after: str, drawn: str) -> str:
    (least, most), (low, high) = occlusion.BUILDINGS, occlusion.SIDES
    u = lambda name: _unit(seed, "building", name, "i")
    steps = [f"""
{after}n AS (SELECT tile_id, unnest(generate_series(0, {least}+floor({_unit(seed, 'building', 'n')}*{most - least + 1})::INT-1)) AS i FROM {drawn}),
{after}s AS (SELECT tile_id, i, floor(({low}+{u('height')}*({high}-{low}))*100)::INT AS bh, floor(({low}+{u('width')}*({high}-{low}))*64)::INT AS bw FROM {after}n),
{after}y AS (SELECT *, floor({u('y')}*greatest(1,100-bh))::INT AS y0, floor({u('x')}*greatest(1,64-bw))::INT AS x0, floor(round(bh*{occlusion.OFFSET},6))::INT AS dy, floor(round(bw*{occlusion.OFFSET},6))::INT AS dx FROM {after}s)"""]
    last = f"{after}0"
    steps.append(f"{last} AS (SELECT tile_id, r, c, {', '.join(f'{c}::DOUBLE AS {c}' for c in occlusion.CHANNELS)} FROM {before})")
    for k in range(most):
        shade = ", ".join(f"CASE WHEN q.i IS NOT NULL AND p.r BETWEEN y0+dy AND y0+dy+bh-1 AND p.c BETWEEN x0+dx AND x0+dx+bw-1 THEN {c}*{1 - occlusion.SHADE} ELSE {c} END AS {c}" for c in occlusion.CHANNELS)
        solid = ", ".join(f"CASE WHEN q.i IS NOT NULL AND p.r BETWEEN y0 AND y0+bh-1 AND p.c BETWEEN x0 AND x0+bw-1 THEN {c}*(1-{occlusion.SOLID})+{to}*{occlusion.SOLID} ELSE {c} END AS {c}" for c, to in zip(occlusion.CHANNELS, occlusion.CONCRETE, strict=True))
        for part, columns in (("h", shade), ("k", solid)):
            name = f"{after}{part}{k}"
            steps.append(f"{name} AS (SELECT p.tile_id, p.r, p.c, {columns} FROM {last} p LEFT JOIN {after}y q ON q.tile_id=p.tile_id AND q.i={k})")
            last = name
    whole = ", ".join(f"floor(round(greatest(0.0,least(255.0,{c})),6))::INT AS {c}" for c in occlusion.CHANNELS)
    steps.append(f"{after} AS (SELECT tile_id, r, c, {whole} FROM {last})")
    return ",".join(steps)


_IMAGE = "im AS (SELECT tile_id, r, c, floor(prob*255)::INT AS red, 255-floor(prob*255)::INT AS green, floor(prob*255)::INT AS blue FROM px), ts AS (SELECT DISTINCT tile_id FROM px)"


def _gate(seed: int, effect: str) -> str:
    own = f"('0x'||substr(sha256('{seed}|'||tile_id||'|{{}}'),1,8))::BIGINT/4294967296.0"
    return f"g{effect} AS (SELECT tile_id FROM ts WHERE {own.format('any')}<{raster.ANY_GATE} AND {own.format(effect)}<{raster.GATES[effect]})"


ORACLE_SQL = {
    "osm_scan": f"WITH RECURSIVE {WAYS_SQL} SELECT arg_min(k,i) AS first, arg_max(k,i) AS last, count(*)::INT AS nodes FROM st GROUP BY way HAVING length(way)%2=0",
    "area_filter": f"WITH RECURSIVE {GRID_SQL} SELECT node, lat, lng AS lon FROM nodes WHERE lat BETWEEN 12.005::DOUBLE AND 12.02::DOUBLE AND lng BETWEEN 77.003::DOUBLE AND 77.03::DOUBLE",
    "npy_scan": _E + "SELECT tile_id, r, round(sum(prob::FLOAT::DOUBLE),4) AS total, count(*) AS n FROM px GROUP BY ALL",
    "suffix_pairs": "SELECT '/d/'||source||'_'||doc_id AS key, '/d/'||source||'_'||doc_id||'_sat.jpg' AS image_path, '/d/'||source||'_'||doc_id||'_mask.png' AS mask_path FROM documents WHERE doc_id%3<>0",
    "label_match": "WITH lb AS (SELECT source, '/d/'||source||'/geojson_roads/a_geojson_roads_img'||doc_id||'.geojson' AS p FROM documents WHERE doc_id%2=0 UNION ALL SELECT source, '/d/'||source||'/geojson_roads/b_img'||doc_id||'7.geojson' FROM documents WHERE doc_id%10=1) SELECT '/d/'||d.source||'/PS-RGB/a_PS-RGB_img'||doc_id||'.tif' AS path, coalesce((SELECT p FROM lb WHERE p='/d/'||d.source||'/geojson_roads/a_geojson_roads_img'||doc_id||'.geojson'), (SELECT min(p) FROM lb WHERE lb.source=d.source AND contains(p, 'img'||doc_id))) AS label_path FROM documents d",
    "chip_pairs": _CHIPS + " SELECT image_path, mask_path, count(*) AS chips FROM ch WHERE split='train' AND mask_path IS NOT NULL GROUP BY ALL",
    "manifest_csv": _CHIPS + " SELECT scene_id, row, col, image_path, coalesce(mask_path,'') AS mask_path FROM ch WHERE split='val'",
    "hold_out": f"WITH {_SC} SELECT scene_id, CASE WHEN row_number() OVER (ORDER BY ('0x'||substr(sha256('3|'||scene_id),1,8))::BIGINT, scene_id)<=greatest(1,round_even(count(*) OVER ()*0.1,0)) THEN 'val' ELSE 'train' END AS split FROM sc",
    "tile_coverage": f"WITH {_SC}, {_TILES}, mx AS (SELECT scene_id, max(y0) AS y, max(x0) AS x FROM tl GROUP BY 1) SELECT sc.scene_id, greatest(y+512,512)=greatest(h,512) AND greatest(x+512,512)=greatest(w,512) AS covered FROM sc JOIN mx USING (scene_id)",
    "lattice": f"""WITH s AS (SELECT ceil(sqrt(count(*)))::BIGINT AS m FROM customer), a AS (SELECT m, unnest(generate_series(0,m-1)) AS r FROM s), g AS (SELECT m, r, unnest(generate_series(0,m-1)) AS c FROM a),
n0 AS (SELECT 'n'||r||'_'||c AS node, round_even(12.90::DOUBLE+(13.04::DOUBLE-12.90::DOUBLE)*r/(m-1),6) AS lat, round_even(77.52::DOUBLE+(77.66::DOUBLE-77.52::DOUBLE)*c/(m-1),6) AS lng FROM g),
sp AS (SELECT 's_south' AS node, 'n0_2' AS base, -0.012::DOUBLE AS dy, 0.0::DOUBLE AS dx UNION ALL SELECT 's_north', 'n'||(m-1)||'_'||(m-3), 0.012, 0.0 FROM s UNION ALL SELECT 's_west', 'n2_0', 0.0, -0.012 UNION ALL SELECT 's_east', 'n'||(m-3)||'_'||(m-1), 0.0, 0.012 FROM s),
n AS (SELECT * FROM n0 UNION ALL SELECT sp.node, round_even(lat+dy,6), round_even(lng+dx,6) FROM sp JOIN n0 ON n0.node=base),
l AS (SELECT 'n'||r||'_'||c AS src, 'n'||r||'_'||(c+1) AS dst, r=m//2 AS main FROM g WHERE c<m-1 UNION ALL SELECT 'n'||r||'_'||c, 'n'||(r+1)||'_'||c, c=m//2 FROM g WHERE r<m-1 UNION ALL SELECT base, node, false FROM sp),
e AS (SELECT 'e_'||src||'__'||dst AS edge_id, src, dst, round_even(round({_hav('a.lat', 'a.lng', 'b.lat', 'b.lng')},6),1) AS length_m, CASE WHEN main THEN 'arterial' ELSE 'local' END AS road_class FROM l JOIN n a ON a.node=src JOIN n b ON b.node=dst)
SELECT *, round_even(length_m/((CASE WHEN road_class='arterial' THEN 50.0 ELSE 30.0 END)*1000/3600),1) AS travel_time FROM e""",
    "plain_multigraph": _T + ", mg AS (SELECT c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, l_quantity AS length, row_number() OVER (PARTITION BY least(c_nationkey,s_nationkey), greatest(c_nationkey,s_nationkey) ORDER BY l_orderkey DESC, l_linenumber DESC, l_suppkey DESC, l_quantity DESC) AS k FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE c_nationkey<>s_nationkey) SELECT src, dst, length, round(lng,6) AS x, round(lat,6) AS y FROM mg JOIN nodes ON node=src WHERE k=1",
    "node_link": _T + "SELECT (SELECT count(*) FROM nodes)::INT AS nodes, src AS source, dst AS target, edge_id AS id FROM edges",
    "distinct_pairs": f"WITH RECURSIVE {USER_SQL}, dr AS (SELECT i AS draw, floor(('0x'||substr(sha256('11|users|'||i||'|s'),1,8))::BIGINT/4294967296.0*(SELECT count(*) FROM nodes))::BIGINT AS a, floor(('0x'||substr(sha256('11|users|'||i||'|t'),1,8))::BIGINT/4294967296.0*(SELECT count(*) FROM nodes))::BIGINT AS b FROM (SELECT unnest(generate_series(0,1999)) AS i)), ix AS (SELECT node, row_number() OVER (ORDER BY node)-1 AS i FROM nodes), pr AS (SELECT least(p.node,q.node) AS s, greatest(p.node,q.node) AS t, min(draw) AS draw FROM dr JOIN ix p ON p.i=a JOIN ix q ON q.i=b WHERE a<>b GROUP BY ALL) SELECT draw::INT AS draw, s, t FROM (SELECT *, row_number() OVER (ORDER BY draw) AS rk FROM pr) WHERE rk<=500",
    "view_metrics": _T + f",{VIEW_SQL} SELECT q.input, q.model, q.iou, q.dice, q.occlusion_recall, resilience_index, n::BIGINT AS n, (SELECT count(*) FROM vedges e WHERE e.view=v.view) AS edges FROM vindex v JOIN {_V} ON q.view=v.view",
    "view_network": f"SELECT input, model, edge_id, src, dst, length_m, road_class, travel_time, criticality, is_bridge FROM (SELECT 'intact' AS view, * FROM ({_view('intact', FLOW_SQL, CUT_SQL)} {_NOTED}) UNION ALL SELECT 'fragmented', * FROM ({_view('fragmented', FLOW_SQL, CUT_SQL)} {_NOTED})) JOIN {_V} USING (view)",
    "view_curve": f"SELECT input, model, step, removed_fraction, efficiency, giant FROM (SELECT 'intact' AS view, * FROM ({_view('intact', FLOW_SQL, _VCURVE)} SELECT * FROM res) UNION ALL SELECT 'fragmented', * FROM ({_view('fragmented', FLOW_SQL, _VCURVE)} SELECT * FROM res)) JOIN {_V} USING (view)",
    "view_changes": f"WITH whole AS ({_view('intact', FLOW_SQL)} {_TOP}), part AS ({_view('fragmented', FLOW_SQL)} {_TOP}), links AS ({_view('intact')} SELECT edge_id FROM edges WHERE edge_id NOT IN (SELECT edge_id FROM vedges WHERE view='fragmented')) SELECT 'link' AS kind, edge_id AS id, 'lost' AS change FROM links UNION ALL SELECT 'gatekeeper', node::VARCHAR, 'lost' FROM whole WHERE node NOT IN (SELECT node FROM part) UNION ALL SELECT 'gatekeeper', node::VARCHAR, 'recovered' FROM part WHERE node NOT IN (SELECT node FROM whole)",
    "toggle_impact": _T + f",{DIST_SQL},{SIMULATE_SQL}, fin AS (SELECT sc.id, round_even(round(100*(0.6*least(total/(n*(n-1))/(SELECT eff FROM base),1.0)+0.4*giant),9),0)::INT AS a, broken FROM sc JOIN ne USING (id) JOIN se USING (id) JOIN sg USING (id) JOIN rt USING (id)), own AS (SELECT max(size)/sum(size) AS g FROM (SELECT comp, count(*) AS size FROM (SELECT s, min(v) AS comp FROM dist GROUP BY s) GROUP BY comp)) SELECT id AS scenario_id, a AS resilience_index_after, a-round_even(round(100*(0.6+0.4*(SELECT g FROM own)),9),0)::INT AS index_change, round(broken/60*100,0)::INT AS cut_pct FROM fin",
    "catalogue": _T + f",{VIEW_SQL} SELECT 'trade' AS city, q.input, q.model, count(*) AS edges FROM vedges e JOIN {_V} ON q.view=e.view GROUP BY ALL",
    "critical_edges": _T + f",{FLOW_SQL} SELECT edge_id, criticality, (SELECT count(*) FROM eb2) AS edges, (SELECT count(*) FROM eb2 WHERE criticality>=0.75) AS critical FROM eb2 WHERE criticality>=0.75",
    "highest_edge": _T + f",{FLOW_SQL} SELECT edge_id, criticality FROM eb2 ORDER BY criticality DESC, edge_id LIMIT 1",
    "curve_rows": "SELECT l_orderkey, (i-1)::INT AS i, round(least(1.0,greatest(0.0,l_discount*11))*100,1) AS removed, round(least(1.0,greatest(0.0,l_tax*10))*100,1) AS efficiency, round(least(1.0,greatest(0.0,l_quantity*0.02))*100,1) AS giant FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_discount, l_tax, l_quantity) AS i, count(*) OVER (PARTITION BY l_orderkey) AS m FROM lineitem) WHERE i<m",
    "kpi_text": "WITH q AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber<>3 THEN l_discount*12 END AS v FROM lineitem) SELECT l_orderkey, l_linenumber, CASE WHEN v IS NULL THEN '—' ELSE round(least(1.0,greatest(0.0,v))*100,0)::INT||'%' END AS text, CASE WHEN v IS NOT NULL THEN round(least(1.0,greatest(0.0,v)),6) END AS share, CASE WHEN v IS NOT NULL THEN round(least(100.0,greatest(0.0,v*100)),6) END AS percent FROM q",
    "heal_views": f"""WITH RECURSIVE {GRID_SQL}, {_DEG}, near AS (SELECT x.node AS a, y.node AS b, round(2*6371000.0*asin(least(1.0,sqrt(pow(sin(radians(y.lat-x.lat)/2),2)+cos(radians(x.lat))*cos(radians(y.lat))*pow(sin(radians(y.lng-x.lng)/2),2)))),6) AS dist_m FROM deg x JOIN deg y ON x.node<y.node AND abs(x.lat-y.lat)<0.003 WHERE x.degree<=1 AND y.degree<=1),
cand AS (SELECT a, b, dist_m, x.comp AS ca, y.comp AS cb, row_number() OVER (ORDER BY dist_m, a, b) AS k FROM near JOIN lab x ON x.node=a JOIN lab y ON y.node=b WHERE dist_m<=200 AND x.comp<>y.comp),
reach(k, comp) AS (SELECT k, ca FROM cand UNION SELECT r.k, CASE WHEN c.ca=r.comp THEN c.cb ELSE c.ca END FROM reach r JOIN cand c ON c.k<r.k AND (c.ca=r.comp OR c.cb=r.comp)),
won AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.k=c.k AND r.comp=c.cb))
SELECT 'closed' AS graph_id, 'heal-'||a||'-'||b AS edge_id, a AS src, b AS dst, round_even(dist_m,1) AS length_m FROM won""",
    "tile_pixels": _E + f",{_CUT32} SELECT tile_id, r, c, prob FROM tp",
    "build_chips": _E + f",{_CUT32}, un AS (SELECT scene_id, ('0x'||substr(sha256(':'||scene_id),1,16))::UBIGINT::DOUBLE/18446744073709551616.0 AS u FROM ss), sl AS (SELECT scene_id, CASE WHEN u<0.8 THEN 'train' WHEN u<0.9 THEN 'val' ELSE 'test' END AS split FROM un) SELECT split, 'images' AS kind, tile_id, count(*) AS pixels, round(sum(prob::FLOAT::DOUBLE),3) AS total FROM tp JOIN sl USING (scene_id) GROUP BY ALL UNION ALL SELECT split, 'masks', tile_id, count(*), round(count(*)::DOUBLE,3) FROM tp JOIN sl USING (scene_id) WHERE target GROUP BY ALL",
    "training_pairs": _E + f",{_CUT32}, un AS (SELECT scene_id, ('0x'||substr(sha256(':'||scene_id),1,16))::UBIGINT::DOUBLE/18446744073709551616.0 AS u FROM ss) SELECT DISTINCT CASE WHEN u<0.8 THEN 'train' WHEN u<0.9 THEN 'val' ELSE 'test' END AS split, tp.tile_id||'.npy' AS image, tp.tile_id||'.npy' AS mask FROM tp JOIN un USING (scene_id) WHERE right(scene_id,1)::INT%2=0",
    "padded": _E + "SELECT g.tile_id, y::INT AS r, x::INT AS c, coalesce(prob,0.0) AS v FROM (SELECT DISTINCT tile_id FROM px) g CROSS JOIN (SELECT unnest(generate_series(0,111)) AS y) CROSS JOIN (SELECT unnest(generate_series(0,111)) AS x) LEFT JOIN px ON px.tile_id=g.tile_id AND px.r=y AND px.c=x",
    "resized": _E + """, g AS (SELECT tile_id, y, x, greatest(0.0,least(99.0,(y+0.5)*100/40-0.5)) AS py, greatest(0.0,least(63.0,(x+0.5)*64/40-0.5)) AS qx FROM (SELECT DISTINCT tile_id FROM px) CROSS JOIN (SELECT unnest(generate_series(0,39)) AS y) CROSS JOIN (SELECT unnest(generate_series(0,39)) AS x)),
f AS (SELECT *, floor(py)::INT AS y0, floor(qx)::INT AS x0 FROM g), c4 AS (SELECT tile_id, y, x, least(99,y0+dy)::INT AS r, least(63,x0+dx)::INT AS c, (CASE WHEN dy=0 THEN 1-(py-y0) ELSE py-y0 END)*(CASE WHEN dx=0 THEN 1-(qx-x0) ELSE qx-x0 END) AS s FROM f CROSS JOIN (VALUES (0,0),(0,1),(1,0),(1,1)) o(dy,dx)),
b AS (SELECT c4.tile_id, y, x, round(sum(prob*s),9) AS v FROM c4 JOIN px USING (tile_id, r, c) GROUP BY ALL)
SELECT b.tile_id, y::INT AS r, x::INT AS c, px.prob AS nearest, v AS bilinear FROM b JOIN px ON px.tile_id=b.tile_id AND px.r=floor(y*100/40) AND px.c=floor(x*64/40)""",
    "normalised": _E + "SELECT tile_id, r, c, round((prob*255/255.0-0.485)/0.229,6) AS v FROM px",
    "masks_joined": _E + "SELECT tile_id, r, c, pred>=0.55 AS pred, target, occluded FROM px WHERE pred>=0.55 OR target OR occluded",
    "scaled_masks": _E + ", v AS (SELECT tile_id, floor(prob*200)::INT AS v FROM px), t AS (SELECT tile_id, max(v) AS m FROM v GROUP BY 1) SELECT tile_id, nullif(count(*) FILTER (WHERE m>0 AND v/m>=0.5),0) AS half, nullif(count(*) FILTER (WHERE v>127),0) AS above_127 FROM v JOIN t USING (tile_id) GROUP BY tile_id",
    "transform_pairs": _E + "SELECT tile_id, r, (63-c)::INT AS c, round(prob::FLOAT::DOUBLE,5) AS v, target::INT AS mask FROM px",
    "occluded_images": _E + f",{_IMAGE},{','.join(_gate(4, k) for k in raster.GATES)},{_soft_sql(4, 'im', 'p1', 'cloud', 'gcloud')},{_soft_sql(4, 'p1', 'p2', 'shadow', 'gshadow')},{_soft_sql(4, 'p2', 'p3', 'canopy', 'gcanopy')},{_building_sql(4, 'p3', 'p4', 'gbuilding')} SELECT * FROM p4",
    "building_cover": _E + f",{_IMAGE},{_building_sql(2, 'im', 'p1', 'ts')} SELECT * FROM p1",
}
