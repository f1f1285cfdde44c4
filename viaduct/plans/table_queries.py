"""Queries over sources, scalars, tiles and rasters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions import scalars as S
from viaduct.operators import raster, vectorize
from viaduct.plans.derived import EMB_SQL, GRID_SQL, LINES_SQL, TRADE_SQL, _hav, customer_grid, embedding_pixels, line_pixels, table, trade_network
from viaduct.session import scratch, stored
from viaduct.sources import files, networks

SIZE = 96


# --- sources -------------------------------------------------------------------------------------------------------


def _json(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_network(spark, sf_dir)
    named = edges.withColumn("src", F.concat(F.lit("n"), "src")).withColumn("dst", F.concat(F.lit("n"), "dst"))
    nodes = nodes.withColumn("node", F.concat(F.lit("n"), "node"))
    return networks.features_of(nodes, named).select("graph_id", F.xxhash64("value").alias("line"), "value")


def geojson_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trade network written to files of GeoJSON features and read again."""
    nodes, edges = trade_network(spark, sf_dir)
    named = edges.withColumn("src", F.concat(F.lit("n"), "src")).withColumn("dst", F.concat(F.lit("n"), "dst"))
    path = scratch(spark, "geojson")
    networks.write_geojson(nodes.withColumn("node", F.concat(F.lit("n"), "node")), named, path)
    _, edges = networks.geojson_network(networks.read_geojson(spark, path, "trade"))
    return edges.select("edge_id", F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "length_m", "road_class", "travel_time", "is_bridge")


def geojson_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = networks.geojson_chain(_json(spark, sf_dir))
    return found.select(F.round("length_m", 3).alias("length_m"), "weight")


def centerlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = networks.centerlines(_json(spark, sf_dir))
    return found.select("part", F.size("points").alias("points"), F.round(F.col("points")[0]["x"], 6).alias("x0"), F.round(F.col("points")[0]["y"], 6).alias("y0"))


def _ways(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """OSM-like ways: customers of a nation and segment, in order; each tenth customer also ends the next nation's way."""
    nodes, _ = customer_grid(spark, sf_dir)
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), F.col("c_nationkey").alias("n"), "c_mktsegment")
    cross = own.filter("k % 10 = 0").select("k", (F.col("n") + 1).alias("n"), "c_mktsegment")
    both = own.withColumn("late", F.lit(0)).unionByName(cross.withColumn("late", F.lit(1)))
    # a way has a bounded number of nodes: of 5000 keys, those of one of 125 nations and segments
    both = both.withColumn("block", F.floor(F.col("k") / 5000))
    way = F.concat_ws("-", "n", "c_mktsegment", "block")
    ways = both.groupBy(way.alias("id")).agg(F.transform(F.sort_array(F.collect_list(F.struct("late", "k"))), lambda x: x["k"]).alias("nodes"))
    tags = F.create_map(F.lit("highway"), F.when(F.length("id") % 2 == 0, "primary_link").otherwise("residential"))
    return nodes.select(F.col("node").alias("id"), "lat", F.col("lng").alias("lon")), ways.filter(F.size("nodes") >= 2).withColumn("tags", tags)


def osm_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return networks.node_usage(_ways(spark, sf_dir)[1])


def osm_intersections(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, ways = _ways(spark, sf_dir)
    _, edges = networks.osm_to_network(nodes, ways)
    return edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "length_m", "road_class", "travel_time")


WAYS_SQL = f"""
{GRID_SQL},
ow AS (SELECT c_custkey::BIGINT AS k, c_nationkey AS n, c_mktsegment AS s, 0 AS late FROM customer UNION ALL SELECT c_custkey, c_nationkey+1, c_mktsegment, 1 FROM customer WHERE c_custkey%10=0),
st0 AS (SELECT n||'-'||s||'-'||(k//5000) AS way, k, late, row_number() OVER (PARTITION BY n, s, k//5000 ORDER BY late, k) AS i, count(*) OVER (PARTITION BY n, s, k//5000) AS m FROM ow),
st AS (SELECT * FROM st0 WHERE m>=2),
us AS (SELECT k, count(*) AS uses, bool_or(i=1 OR i=m) AS is_end FROM st GROUP BY k)
"""


def multigraph_simplify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of orders as parallel directed roads between nations of customer and supplier, made simple."""
    nodes, _ = trade_network(spark, sf_dir)
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    own = own.join(table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    own = own.join(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    own = own.join(table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    tag = F.when(F.col("l_orderkey") % 3 == 0, "secondary").otherwise("service")
    edges = own.select(F.lit("trade").alias("graph_id"), F.struct("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity").alias("key"), F.col("c_nationkey").cast("long").alias("src"), F.col("s_nationkey").cast("long").alias("dst"), F.array(tag, F.lit("x")).alias("highway"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_quantity") * 100).alias("length"))
    _, simple = networks.multigraph_to_network(nodes.select("graph_id", "node", F.col("lat").alias("y"), F.col("lng").alias("x")), edges)
    return simple.select("src", "dst", "length_m", "road_class", "travel_time")


# --- scalars and tiles -----------------------------------------------------------------------------------------------


def road_class_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rule of road classes over orders, with total prices as lengths."""
    own = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 100).alias("path"), (F.col("o_orderkey") % 7 * 100.0).alias("straight"), F.lower(F.regexp_replace("o_orderpriority", "^[0-9]-", "primary_")).alias("tag"))
    c = F.col("o_orderkey") % 101 / 100
    return own.select("o_orderkey", S.class_by_tag("tag").alias("a"), S.class_by_stem("tag").alias("b"), S.class_by_geometry("path", "straight").alias("g"), S.class_by_length("path").alias("l"), S.class_by_criticality(c).alias("c"), F.round(S.tortuosity("path", "straight"), 3).alias("tortuosity"))


def pixel_to_geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_partkey") % 100).alias("r"), (F.col("l_suppkey") % 100).alias("c"))
    lat, lng = S.geo_by_bbox("r", "c", F.lit(100), F.lit(100), F.lit(12.9), F.lit(13.04), F.lit(77.52), F.lit(77.66))
    y, x = S.geo_by_affine("r", "c", F.array(*[F.lit(v) for v in (0.5, 0.0, 10.0, 0.0, -0.5, 90.0)]))
    return own.select("l_orderkey", "l_linenumber", F.round(lat, 9).alias("lat"), F.round(lng, 9).alias("lng"), y.alias("y"), x.alias("x"))


def tiers_colors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity") * 2).alias("index"), (F.round(F.col("l_discount") * 10, 2)).alias("v"))
    return own.select("l_orderkey", "l_linenumber", S.resilience_tier("index").alias("tier"), S.ramp_colour("v").alias("colour"), F.round(S.edge_weight_px("v", F.col("l_linenumber") == 1), 6).alias("px"), (F.col("v") >= 0.75).alias("critical"), S.resilience_colour("index").alias("index_colour"))


def _scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n_chars")
    name = F.concat("source", F.lit("_"), "doc_id")
    return table(spark, sf_dir, "documents").select(name.alias("scene_id"), (300 + n % 1500).alias("h"), (300 + 7 * n % 1500).alias("w"), F.concat(F.lit("/data/"), name, F.lit("_sat.tif")).alias("path"), "doc_id")


def scene_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scenes(spark, sf_dir).select(S.scene_id("path").alias("scene"))
    return own.select("scene", F.round(S.unit_interval("scene"), 9).alias("u"), S.assign_split(S.unit_interval("scene")).alias("split"))


def tile_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.tile_offsets(_scenes(spark, sf_dir))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _scenes(spark, sf_dir)
    masks = own.filter("doc_id % 3 <> 0").select(F.concat(F.lit("/masks/"), "scene_id", F.lit("_mask.png")).alias("path"))
    return files.pair_by_scene(own.select("path"), masks)


def scene_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.split_summary(files.manifest(_pairs(spark, sf_dir), tile_offsets(spark, sf_dir)))


# --- rasters ---------------------------------------------------------------------------------------------------------


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = embedding_pixels(spark, sf_dir)
    return px.select("tile_id", "r", "c", S.foreground("pred", 0.55).alias("pred"), "target", "occluded")


def iou_dice_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.overlap_metrics(_marks(spark, sf_dir), ["tile_id"])
    return found.select("tile_id", *[F.round(c, 9).alias(c) for c in ("iou", "dice", "occlusion_recall")])


def micro_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _marks(spark, sf_dir).withColumn("input", F.when(F.col("occluded"), "occluded").otherwise("clean"))
    micro = raster.micro_metrics(own, ["input"]).withColumn("kind", F.lit("micro"))
    macro = raster.overlap_metrics(own, ["tile_id", "input"]).groupBy("input").agg(*[F.round(F.avg(a), 9).alias(b) for a, b in (("iou", "iou"), ("dice", "dice"))], F.lit(None).cast("double").alias("recall"))
    return micro.unionByName(macro.withColumn("kind", F.lit("macro")))


def soft_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = raster.soft_losses(embedding_pixels(spark, sf_dir))
    return found.select("tile_id", F.round("dice_loss", 8).alias("dice_loss"), F.round("bce", 8).alias("bce"))


def consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of the clean and of the occluded prediction, and how far they agree."""
    px = embedding_pixels(spark, sf_dir)
    kept = raster.consistency(px)
    found = raster.robust_score(raster.soft_losses(px), raster.soft_losses(px.withColumn("prob", F.col("pred"))), kept)
    return found.join(kept, "tile_id").select("tile_id", *[F.round(c, 8).alias(c) for c in ("mse", "kl", "mean_abs", "sup_clean", "sup_occluded", "total")])


def otsu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Otsu's threshold of each tile, and how many pixels reach it."""
    px = embedding_pixels(spark, sf_dir)
    own = raster.otsu_foreground(px).groupBy("tile_id").agg(F.count(F.lit(1)).alias("pixels"))
    found = raster.otsu_threshold(px).join(own, "tile_id", "left")
    return found.select("tile_id", F.round("threshold", 6).alias("threshold"), F.coalesce("pixels", F.lit(0)).cast("long").alias("pixels"))


def seam_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles of lineitem laid over each other by half their width."""
    px = line_pixels(spark, sf_dir)
    tiles = px.select("tile_id").distinct().withColumn("k", F.substring("tile_id", 2, 9).cast("int"))
    tiles = tiles.select("tile_id", F.lit("scene").alias("scene_id"), F.lit(0).alias("y0"), (F.col("k") * (SIZE // 2)).alias("x0"))
    return raster.seam_blend(px, tiles).drop("scene_id")


def neighbour_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.neighbour_count(line_pixels(spark, sf_dir).filter(S.foreground("prob", 0.5)))


def node_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.node_pixels(line_pixels(spark, sf_dir).filter(S.foreground("prob", 0.5)))


def connectivity_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.connectivity_labels(line_pixels(spark, sf_dir).filter(S.foreground("prob", 0.5)))


def closing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.closing(line_pixels(spark, sf_dir).filter(S.foreground("prob", 0.5)), SIZE)


def small_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.drop_small(line_pixels(spark, sf_dir).filter(S.foreground("prob", 0.5)), 3)


def fill_holes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.fill_holes(line_pixels(spark, sf_dir), SIZE, 6, raster.DISK2)


def thinning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.thin(raster.closing(line_pixels(spark, sf_dir).filter(S.foreground("prob", 0.5)), SIZE))


def half_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    mask = line_pixels(spark, sf_dir).filter(S.foreground("prob", 0.5))
    return raster.half_width(mask, SIZE, widen=raster.DISK2).select("tile_id", "r", "c", F.round("d", 9).alias("d"))


def relaxed_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels from one half up against those from six tenths up, moved a row down, with a tolerance of three pixels."""
    px = line_pixels(spark, sf_dir)
    target = px.filter("prob >= 0.6 and r < 95").select("tile_id", (F.col("r") + 1).cast("int").alias("r"), "c")
    found = raster.relaxed_iou(px.filter("prob >= 0.5"), target)
    return found.select("tile_id", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "relaxed_iou")])


def logit_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-entropy of each vector's values, taken as logits, against their sign with a margin."""
    own = table(spark, sf_dir, "embeddings").select("vec_id", F.explode("embedding").alias("v")).select("vec_id", (8 * F.col("v").cast("double")).alias("x"), (F.col("v").cast("double") >= 0.05).cast("double").alias("t"))
    return own.groupBy("vec_id").agg(F.round(F.avg(raster.bce_with_logits(F.col("x"), F.col("t"))), 9).alias("bce"))


def junction_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raster.junction_clusters(line_pixels(spark, sf_dir).filter(S.foreground("prob", 0.5)))


def mask_to_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Networks of all tiles of lineitem, each in a box of its own on earth: closed, cleaned, thinned and traced.

    Objects and holes of fewer than 16 pixels go, as in ``skeleton_stats``; of the default, 64, these sparse tiles have none.
    """
    px = stored(line_pixels(spark, sf_dir), "pixels")
    edges = vectorize.mask_to_network(px, SIZE, vectorize.Projection.bbox(), stored(_boxes(px), "boxes"), 0.5, 16)[1]
    return edges.select("graph_id", "edge_id", "length_m", "straight_m", "road_class", "travel_time")


def _boxes(pixels: DataFrame) -> DataFrame:
    """(tile_id, h, w, lat_min, ...): a box of a tenth of a degree for each tile."""
    k = F.substring("tile_id", 2, 12).cast("int") % 100
    own = pixels.select("tile_id").distinct().withColumns({"h": F.lit(SIZE), "w": F.lit(SIZE), "lat_min": 12.0 + k / 10, "lng_min": 77.0 + k / 10})
    return own.withColumns({"lat_max": F.col("lat_min") + 0.1, "lng_max": F.col("lng_min") + 0.1})


def _blobs(tiles: DataFrame) -> DataFrame:
    k = F.substring("tile_id", 5, 9).cast("int")
    return tiles.select("tile_id", (k * 7 % 100).alias("y"), (k * 11 % 64).alias("x"), F.lit(9.0).alias("sigma"), F.lit(1.0).alias("peak")).union(tiles.select("tile_id", F.lit(50), F.lit(32), F.lit(6.0), F.lit(0.8)))


def blob_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = embedding_pixels(spark, sf_dir)
    found = raster.soft_blobs(px.select("tile_id", "r", "c"), _blobs(px.select("tile_id").distinct()))
    return found.select("tile_id", "r", "c", F.round("alpha", 9).alias("alpha"), (F.round("alpha", 9) >= 0.5).alias("occluded"))


def overlay(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = embedding_pixels(spark, sf_dir)
    found = raster.soft_blobs(px.select("tile_id", "r", "c", (F.col("prob") * 255).alias("v")), _blobs(px.select("tile_id").distinct()))
    a = F.round("alpha", 6)
    v = F.round(F.col("v") * 1000) / 1000  # as SQL rounds: ties go by the product, not by the shortest decimals
    return found.select("tile_id", "r", "c", *[raster.cover(v, a, k, 0.7).alias(k) for k in ("cloud", "shadow", "canopy")])


def random_occlude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The effects drawn for each scene."""
    return raster.occlusion_plan(_scenes(spark, sf_dir).select(F.col("scene_id").alias("tile_id")))


def score_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default scorer over the embedding tiles."""
    px = embedding_pixels(spark, sf_dir)
    rows = px.groupBy("tile_id", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "prob"))), lambda x: x["prob"].cast("float")).alias("vals"))
    return files.score_tiles(rows).groupBy("tile_id").agg(F.count(F.lit(1)).alias("pixels"))


QUERIES = {
    "geojson_roundtrip": geojson_roundtrip, "geojson_chain": geojson_chain, "centerlines": centerlines, "osm_usage": osm_usage,
    "osm_intersections": osm_intersections, "multigraph_simplify": multigraph_simplify, "road_class_rules": road_class_rules,
    "pixel_to_geo": pixel_to_geo, "tiers_colors": tiers_colors, "scene_split": scene_split, "tile_offsets": tile_offsets,
    "scene_pairs": scene_pairs, "split_summary": split_summary, "iou_dice_recall": iou_dice_recall, "micro_macro_metrics": micro_macro_metrics,
    "soft_losses": soft_losses, "consistency": consistency, "otsu": otsu, "seam_blend": seam_blend, "neighbour_count": neighbour_count,
    "node_pixels": node_pixels, "connectivity_labels": connectivity_labels, "closing": closing, "small_objects": small_objects,
    "fill_holes": fill_holes, "thinning": thinning, "half_width": half_width, "relaxed_iou": relaxed_iou, "logit_loss": logit_loss, "junction_clusters": junction_clusters,
    "mask_to_network": mask_to_network, "blob_mask": blob_mask, "overlay": overlay, "random_occlude": random_occlude, "score_tiles": score_tiles,
}

def _colour(v: str) -> str:
    """The colour ramp of a clamped value, as SQL."""
    half = lambda low, high, t: "'rgb('||" + "||', '||".join(f"round({x}.0+({y}-{x})*({t}))::INT" for x, y in zip(low, high, strict=True)) + "||')'"
    (_, a), (_, b), (_, c) = S.RAMP
    return f"CASE WHEN {v}<=0.5 THEN {half(a, b, f'{v}/0.5')} ELSE {half(b, c, f'({v}-0.5)/0.5')} END"


_T = f"WITH RECURSIVE {TRADE_SQL} "
_E = f"WITH {EMB_SQL}"
_L = f"WITH RECURSIVE {LINES_SQL}, mask AS (SELECT tile_id, r, c FROM px WHERE prob>=0.5)"
_MARK = f"{_E}, mk AS (SELECT tile_id, r, c, pred>=0.55 AS p, target AS t, occluded AS o FROM px)"
_OV = "CASE WHEN count(*) FILTER (WHERE p OR t)=0 THEN 1.0 ELSE count(*) FILTER (WHERE p AND t)/(count(*) FILTER (WHERE p OR t)+1e-7) END"
_DI = "CASE WHEN count(*) FILTER (WHERE p)+count(*) FILTER (WHERE t)=0 THEN 1.0 ELSE 2*count(*) FILTER (WHERE p AND t)/(count(*) FILTER (WHERE p)+count(*) FILTER (WHERE t)+1e-7) END"
_RE = "CASE WHEN count(*) FILTER (WHERE t AND o)=0 THEN 1.0 ELSE count(*) FILTER (WHERE p AND t AND o)/(count(*) FILTER (WHERE t AND o)+1e-7) END"
_EIGHT = "(VALUES (-1,0,0),(-1,1,1),(0,1,2),(1,1,3),(1,0,4),(1,-1,5),(0,-1,6),(-1,-1,7)) o(dy,dx,k)"
_DISK = "(SELECT y AS dy, x AS dx FROM (SELECT unnest(generate_series(-2,2)) AS y), (SELECT unnest(generate_series(-2,2)) AS x) WHERE y*y+x*x<=4) o"
_GRID96 = "(SELECT tile_id, y::INT AS r, x::INT AS c FROM (SELECT DISTINCT tile_id FROM mask), (SELECT unnest(generate_series(0,95)) AS y), (SELECT unnest(generate_series(0,95)) AS x))"
_SC = "sc AS (SELECT source||'_'||doc_id AS scene_id, 300+n_chars%1500 AS h, 300+7*n_chars%1500 AS w, '/data/'||source||'_'||doc_id||'_sat.tif' AS path, doc_id FROM documents), un AS (SELECT *, ('0x'||substr(sha256(':'||scene_id),1,16))::UBIGINT::DOUBLE/18446744073709551616.0 AS u FROM sc), sp AS (SELECT *, CASE WHEN u<0.8 THEN 'train' WHEN u<0.9 THEN 'val' ELSE 'test' END AS split FROM un)"
_OFF = "CASE WHEN {n}>512 THEN list_sort(list_distinct(list_concat(generate_series(0,{n}-512,448),[{n}-512]))) ELSE [0::BIGINT] END"
_TILES = f"ta AS (SELECT scene_id, w, unnest({_OFF.format(n='h')}) AS y0, unnest(generate_series(0, len({_OFF.format(n='h')})-1)) AS row FROM sc), tl AS (SELECT scene_id, row::INT AS row, y0, unnest({_OFF.format(n='w')}) AS x0, unnest(generate_series(0, len({_OFF.format(n='w')})-1))::INT AS col FROM ta)"
_PR = "pr AS (SELECT scene_id, path AS image_path, CASE WHEN doc_id%3<>0 THEN '/masks/'||scene_id||'_mask.png' END AS mask_path FROM sc)"
_SUP = "0.5*avg(-(t*ln({q})+(1-t)*ln(1-{q})))+0.5*(1-(2*sum({p}*t)+1)/(sum({p})+sum(t)+1))"
_BL = "tls AS (SELECT DISTINCT tile_id, substr(tile_id,5)::INT AS k FROM px), bl AS (SELECT tile_id, k*7%100 AS y, k*11%64 AS x, 9.0::DOUBLE AS sigma, 1.0::DOUBLE AS peak FROM tls UNION ALL SELECT tile_id, 50, 32, 6.0, 0.8 FROM tls), al AS (SELECT px.tile_id, r, c, any_value(prob) AS prob, least(1.0,greatest(0.0,max(peak*exp(-(pow(r-y,2)+pow(c-x,2))/(2*sigma*sigma))))) AS alpha FROM px JOIN bl USING (tile_id) GROUP BY ALL)"
ORACLE_SQL = {
    "geojson_roundtrip": _T + "SELECT edge_id, least('n'||src,'n'||dst) AS a, greatest('n'||src,'n'||dst) AS b, length_m, road_class, travel_time, false AS is_bridge FROM edges",
    "geojson_chain": _T + f"SELECT round(round({_hav('a.lat', 'a.lng', 'b.lat', 'b.lng')},6),3) AS length_m, e.length_m AS weight FROM edges e JOIN nodes a ON a.node=e.src JOIN nodes b ON b.node=e.dst",
    "centerlines": _T + "SELECT 0::INT AS part, 2::INT AS points, round(a.lng,6) AS x0, round(a.lat,6) AS y0 FROM edges e JOIN nodes a ON a.node=e.src",
    "osm_usage": f"WITH RECURSIVE {WAYS_SQL} SELECT k AS id, uses, is_end FROM us",
    "osm_intersections": f"""WITH RECURSIVE {WAYS_SQL}, sj AS (SELECT st.*, lat, lng, (is_end OR uses>1) AS j, coalesce(sum((is_end OR uses>1)::INT) OVER (PARTITION BY way ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS seg FROM st JOIN nodes ON node=st.k JOIN us ON us.k=st.k),
sd AS (SELECT *, coalesce({_hav("lag(lat) OVER (PARTITION BY way ORDER BY i)", "lag(lng) OVER (PARTITION BY way ORDER BY i)", "lat", "lng")},0) AS d FROM sj),
cl AS (SELECT way, seg, sum(d) AS len, arg_max(k,i) AS dst, arg_max(j,i) AS e FROM sd GROUP BY ALL), op AS (SELECT way, seg+1 AS seg, k AS src FROM sj WHERE j),
ed AS (SELECT least(src,dst) AS a, greatest(src,dst) AS b, round_even(round(len,6),1) AS length_m, CASE WHEN length(cl.way)%2=0 THEN 'arterial' ELSE 'local' END AS road_class, row_number() OVER (PARTITION BY least(src,dst), greatest(src,dst) ORDER BY cl.way, cl.seg) AS rk FROM cl JOIN op USING (way, seg) WHERE e AND len>0 AND src<>dst)
SELECT a, b, length_m, road_class, round_even(length_m/((CASE WHEN road_class='arterial' THEN 50.0 ELSE 30.0 END)*1000/3600),1) AS travel_time FROM ed WHERE rk=1""",
    "multigraph_simplify": f"""WITH RECURSIVE {TRADE_SQL}, mg AS (SELECT (l_orderkey, l_linenumber, l_suppkey, l_quantity) AS key, c_nationkey::BIGINT AS src, s_nationkey::BIGINT AS dst, CASE WHEN l_orderkey%3=0 THEN 'arterial' ELSE 'local' END AS road_class, CASE WHEN l_orderkey%2=0 THEN l_quantity*100 END AS len FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE c_nationkey<>s_nationkey),
rk AS (SELECT mg.*, row_number() OVER (PARTITION BY least(src,dst), greatest(src,dst) ORDER BY key) AS k FROM mg), ln AS (SELECT src, dst, road_class, round_even(round(coalesce(len, {_hav("round_even(a.lat,6)", "round_even(a.lng,6)", "round_even(b.lat,6)", "round_even(b.lng,6)")}),6),1) AS length_m FROM rk JOIN nodes a ON a.node=src JOIN nodes b ON b.node=dst WHERE k=1)
SELECT src, dst, length_m, road_class, round_even(length_m/((CASE WHEN road_class='arterial' THEN 50.0 ELSE 30.0 END)*1000/3600),1) AS travel_time FROM ln""",
    "road_class_rules": """WITH o AS (SELECT o_orderkey, o_totalprice/100 AS path, o_orderkey%7*100.0::DOUBLE AS straight, lower(regexp_replace(o_orderpriority,'^[0-9]-','primary_')) AS tag, o_orderkey%101/100 AS c FROM orders), t AS (SELECT *, CASE WHEN straight>0 THEN path/straight ELSE 1.0 END AS tt FROM o)
SELECT o_orderkey, CASE WHEN tag IN ('motorway','motorway_link','trunk','trunk_link','primary','primary_link','secondary','secondary_link') THEN 'arterial' ELSE 'local' END AS a, CASE WHEN string_split(tag,'_')[1] IN ('motorway','trunk','primary') THEN 'arterial' ELSE 'local' END AS b, CASE WHEN path>=400 AND tt<=1.15 THEN 'arterial' ELSE 'local' END AS g, CASE WHEN path>=400 THEN 'arterial' ELSE 'local' END AS l, CASE WHEN c>=0.8 THEN 'highway' WHEN c>=0.6 THEN 'primary' WHEN c>=0.35 THEN 'secondary' ELSE 'residential' END AS c, round(tt,3) AS tortuosity FROM t""",
    "pixel_to_geo": "SELECT l_orderkey, l_linenumber, round(13.04::DOUBLE-(13.04::DOUBLE-12.9::DOUBLE)*(l_partkey%100)/99,9) AS lat, round(77.52::DOUBLE+(77.66::DOUBLE-77.52::DOUBLE)*(l_suppkey%100)/99,9) AS lng, (-0.5::DOUBLE*(l_partkey%100)+90.0::DOUBLE) AS y, (0.5::DOUBLE*(l_suppkey%100)+10.0::DOUBLE) AS x FROM lineitem",
    "tiers_colors": f"""WITH q AS (SELECT l_orderkey, l_linenumber, l_quantity*2 AS i, round(l_discount*10,2) AS v0 FROM lineitem), w AS (SELECT *, greatest(0.0,least(1.0,v0)) AS v FROM q)
SELECT l_orderkey, l_linenumber, CASE WHEN i>=80 THEN 'Resilient' WHEN i>=60 THEN 'Moderate' ELSE 'Fragile' END AS tier, {_colour('v')} AS colour, round(CASE WHEN l_linenumber=1 THEN 1.5 ELSE 1.5+3.5*v0 END,6) AS px, v0>=0.75 AS critical, {_colour('greatest(0.0,least(1.0,1-i/100))')} AS index_colour FROM w""",
    "scene_split": f"WITH {_SC} SELECT scene_id AS scene, round(u,9) AS u, split FROM sp",
    "tile_offsets": f"WITH {_SC}, {_TILES} SELECT scene_id, row, col, y0, x0 FROM tl",
    "scene_pairs": f"WITH {_SC}, {_PR} SELECT scene_id, image_path, mask_path FROM pr",
    "split_summary": f"WITH {_SC}, {_TILES} SELECT s.split, count(tl.scene_id) AS chips, count(DISTINCT tl.scene_id) AS scenes FROM (VALUES ('train'),('val'),('test')) s(split) LEFT JOIN sp ON sp.split=s.split LEFT JOIN tl ON tl.scene_id=sp.scene_id GROUP BY s.split",
    "iou_dice_recall": _MARK + f" SELECT tile_id, round({_OV},9) AS iou, round({_DI},9) AS dice, round({_RE},9) AS occlusion_recall FROM mk GROUP BY tile_id",
    "micro_macro_metrics": _MARK + f", g AS (SELECT *, CASE WHEN o THEN 'occluded' ELSE 'clean' END AS input FROM mk) SELECT input, round(count(*) FILTER (WHERE p AND t)/(count(*) FILTER (WHERE p OR t)+1e-6),3) AS iou, round(2*count(*) FILTER (WHERE p AND t)/(count(*) FILTER (WHERE p)+count(*) FILTER (WHERE t)+1e-6),3) AS dice, round(count(*) FILTER (WHERE p AND t)/(count(*) FILTER (WHERE t)+1e-6),3) AS recall, 'micro' AS kind FROM g GROUP BY input UNION ALL SELECT input, round(avg(iou),9), round(avg(dice),9), NULL, 'macro' FROM (SELECT tile_id, input, {_OV} AS iou, {_DI} AS dice FROM g GROUP BY ALL) GROUP BY input",
    "soft_losses": _E + " SELECT tile_id, round(1-(2*sum(prob*target::INT)+1)/(sum(prob)+sum(target::INT)+1),8) AS dice_loss, round(avg(-(target::INT*ln(q)+(1-target::INT)*ln(1-q))),8) AS bce FROM (SELECT *, greatest(1e-6,least(1-1e-6,prob)) AS q FROM px) GROUP BY tile_id",
    "consistency": _E + f", z AS (SELECT *, greatest(1e-6,least(1-1e-6,prob)) AS a, greatest(1e-6,least(1-1e-6,pred)) AS b, occluded::INT AS m, target::INT AS t FROM px) SELECT tile_id, round(sum((prob-pred)*(prob-pred)*m)/greatest(sum(m),1),8) AS mse, round(sum(0.5*(a*ln(a/b)+(1-a)*ln((1-a)/(1-b))+b*ln(b/a)+(1-b)*ln((1-b)/(1-a)))*m)/greatest(sum(m),1),8) AS kl, round(avg(abs(prob-pred)),8) AS mean_abs, round({_SUP.format(p='prob', q='a')},8) AS sup_clean, round({_SUP.format(p='pred', q='b')},8) AS sup_occluded, round(0.5*({_SUP.format(p='prob', q='a')}+{_SUP.format(p='pred', q='b')})+0.1*sum((prob-pred)*(prob-pred)*m)/greatest(sum(m),1),8) AS total FROM z GROUP BY tile_id",
    "otsu": _E + ", rg AS (SELECT tile_id, min(prob) AS lo, max(prob) AS hi FROM px GROUP BY 1), hs AS (SELECT px.tile_id, lo, hi, least(floor((prob-lo)/(hi-lo)*256),255) AS b, count(*)::DOUBLE AS n FROM px JOIN rg USING (tile_id) WHERE hi>lo GROUP BY ALL), hx AS (SELECT *, lo+(b+0.5)*(hi-lo)/256 AS x FROM hs), cu AS (SELECT *, sum(n) OVER w AS n1, sum(n*x) OVER w AS s1, sum(n) OVER (PARTITION BY tile_id) AS n0, sum(n*x) OVER (PARTITION BY tile_id) AS s0 FROM hx WINDOW w AS (PARTITION BY tile_id ORDER BY b ROWS UNBOUNDED PRECEDING)), vr AS (SELECT *, row_number() OVER (PARTITION BY tile_id ORDER BY round(n1*(n0-n1)*pow(s1/n1-(s0-s1)/(n0-n1),2),6) DESC, b) AS k FROM cu WHERE n0>n1) SELECT rg.tile_id, round(x,6) AS threshold, (SELECT count(*) FROM px WHERE px.tile_id=rg.tile_id AND prob>=x) AS pixels FROM rg LEFT JOIN vr ON vr.tile_id=rg.tile_id AND k=1",
    "seam_blend": _L + ", z AS (SELECT r, c+substr(tile_id,2)::INT*48 AS c, round(avg(prob),6) AS prob FROM px GROUP BY ALL) SELECT r, c, prob, prob>0.5 AS road FROM z",
    "neighbour_count": _L + f" SELECT m.tile_id, m.r, m.c, count(n.r) AS n FROM mask m CROSS JOIN {_EIGHT} LEFT JOIN mask n ON n.tile_id=m.tile_id AND n.r=m.r+dy AND n.c=m.c+dx GROUP BY ALL",
    "node_pixels": _L + f", nc AS (SELECT m.tile_id, m.r, m.c, count(n.r) AS n FROM mask m CROSS JOIN {_EIGHT} LEFT JOIN mask n ON n.tile_id=m.tile_id AND n.r=m.r+dy AND n.c=m.c+dx GROUP BY ALL) SELECT * FROM nc WHERE n=1 OR n>=3",
    "connectivity_labels": _L + f" SELECT m.tile_id, m.r, m.c, bool_or(k=0 AND n.r IS NOT NULL) AS n, bool_or(k=1 AND n.r IS NOT NULL) AS ne, bool_or(k=2 AND n.r IS NOT NULL) AS e, bool_or(k=3 AND n.r IS NOT NULL) AS se, bool_or(k=4 AND n.r IS NOT NULL) AS s, bool_or(k=5 AND n.r IS NOT NULL) AS sw, bool_or(k=6 AND n.r IS NOT NULL) AS w, bool_or(k=7 AND n.r IS NOT NULL) AS nw FROM mask m CROSS JOIN {_EIGHT} LEFT JOIN mask n ON n.tile_id=m.tile_id AND n.r=m.r+dy AND n.c=m.c+dx GROUP BY ALL",
    "closing": _L + f", dl AS (SELECT DISTINCT tile_id, (r+dy)::INT AS r, (c+dx)::INT AS c FROM mask CROSS JOIN {_DISK} WHERE r+dy BETWEEN 0 AND 95 AND c+dx BETWEEN 0 AND 95) SELECT m.tile_id, m.r, m.c FROM dl m CROSS JOIN {_DISK} LEFT JOIN dl n ON n.tile_id=m.tile_id AND n.r=m.r+dy AND n.c=m.c+dx GROUP BY ALL HAVING count(*) FILTER (WHERE n.r IS NULL AND m.r+dy BETWEEN 0 AND 95 AND m.c+dx BETWEEN 0 AND 95)=0",
    "small_objects": _L + ", lab(tile_id, r, c, comp) USING KEY (tile_id, r, c) AS (SELECT tile_id, r, c, r*100000+c FROM mask UNION SELECT m.tile_id, m.r, m.c, min(l.comp) FROM lab l JOIN (VALUES (-1,0),(0,1),(1,0),(0,-1)) o(dy,dx) ON true JOIN recurring.lab m ON m.tile_id=l.tile_id AND m.r=l.r+dy AND m.c=l.c+dx WHERE l.comp<m.comp GROUP BY ALL) SELECT tile_id, r, c FROM (SELECT *, count(*) OVER (PARTITION BY tile_id, comp) AS n FROM lab) WHERE n>=3",
    "fill_holes": _L.replace("prob>=0.5", "prob>=0") + f", dl AS (SELECT DISTINCT tile_id, (r+dy)::INT AS r, (c+dx)::INT AS c FROM mask CROSS JOIN {_DISK} WHERE r+dy BETWEEN 0 AND 95 AND c+dx BETWEEN 0 AND 95), bg AS (SELECT * FROM {_GRID96} EXCEPT SELECT * FROM dl), lab(tile_id, r, c, comp) USING KEY (tile_id, r, c) AS (SELECT tile_id, r, c, r*100000+c FROM bg UNION SELECT m.tile_id, m.r, m.c, min(l.comp) FROM lab l JOIN (VALUES (-1,0),(0,1),(1,0),(0,-1)) o(dy,dx) ON true JOIN recurring.lab m ON m.tile_id=l.tile_id AND m.r=l.r+dy AND m.c=l.c+dx WHERE l.comp<m.comp GROUP BY ALL) SELECT tile_id, r, c FROM dl UNION ALL SELECT tile_id, r, c FROM (SELECT *, count(*) OVER (PARTITION BY tile_id, comp) AS n FROM lab) WHERE n<6",
    "half_width": _L + f", dl AS (SELECT DISTINCT tile_id, (r+dy)::INT AS r, (c+dx)::INT AS c FROM mask CROSS JOIN {_DISK} WHERE r+dy BETWEEN 0 AND 95 AND c+dx BETWEEN 0 AND 95), bg AS (SELECT * FROM {_GRID96} EXCEPT SELECT * FROM dl) SELECT dl.tile_id, dl.r, dl.c, round(sqrt(min(pow(dl.r-bg.r,2)+pow(dl.c-bg.c,2))),9) AS d FROM dl JOIN bg ON bg.tile_id=dl.tile_id AND bg.r BETWEEN dl.r-24 AND dl.r+24 GROUP BY dl.tile_id, dl.r, dl.c",
    "relaxed_iou": f"WITH {LINES_SQL}, p AS (SELECT tile_id, r, c FROM px WHERE prob>=0.5), t AS (SELECT tile_id, r+1 AS r, c FROM px WHERE prob>=0.6 AND r<95), o AS (SELECT y AS dy, x AS dx FROM (SELECT unnest(generate_series(-3,3)) AS y), (SELECT unnest(generate_series(-3,3)) AS x) WHERE y*y+x*x<=9), m AS (SELECT tile_id, count(*) AS m FROM (SELECT DISTINCT p.* FROM p CROSS JOIN o JOIN t ON t.tile_id=p.tile_id AND t.r=p.r+dy AND t.c=p.c+dx) GROUP BY 1), k AS (SELECT tile_id, count(*) AS k FROM (SELECT DISTINCT t.* FROM t CROSS JOIN o JOIN p ON p.tile_id=t.tile_id AND p.r=t.r+dy AND p.c=t.c+dx) GROUP BY 1), a AS (SELECT tile_id, coalesce(p,0) AS p, coalesce(t,0) AS t, coalesce(m,0) AS m, coalesce(k,0) AS k FROM (SELECT tile_id, count(*) AS p FROM p GROUP BY 1) FULL JOIN (SELECT tile_id, count(*) AS t FROM t GROUP BY 1) USING (tile_id) LEFT JOIN m USING (tile_id) LEFT JOIN k USING (tile_id)) SELECT tile_id, round(CASE WHEN p=0 THEN 1.0::DOUBLE ELSE m/p::DOUBLE END,9) AS precision, round(CASE WHEN t=0 THEN 1.0::DOUBLE ELSE k/t::DOUBLE END,9) AS recall, round(CASE WHEN p+t-k=0 THEN 1.0::DOUBLE ELSE m/(p+t-k)::DOUBLE END,9) AS relaxed_iou FROM a",
    "logit_loss": "SELECT vec_id, round(avg(greatest(x,0)-x*t+ln(1+exp(-abs(x)))),9) AS bce FROM (SELECT vec_id, 8*v AS x, (v>=0.05)::INT::DOUBLE AS t FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v FROM embeddings)) GROUP BY vec_id",
    "junction_clusters": _L + f", nc AS (SELECT m.tile_id, m.r, m.c, count(n.r) AS n FROM mask m CROSS JOIN {_EIGHT} LEFT JOIN mask n ON n.tile_id=m.tile_id AND n.r=m.r+dy AND n.c=m.c+dx GROUP BY ALL), np AS (SELECT tile_id, r, c FROM nc WHERE n=1 OR n>=3), lab(tile_id, r, c, comp) USING KEY (tile_id, r, c) AS (SELECT tile_id, r, c, r::BIGINT*2147483648+c FROM np UNION SELECT m.tile_id, m.r, m.c, min(l.comp) FROM lab l JOIN {_EIGHT} ON true JOIN recurring.lab m ON m.tile_id=l.tile_id AND m.r=l.r+dy AND m.c=l.c+dx WHERE l.comp<m.comp GROUP BY ALL), mi AS (SELECT tile_id, comp, avg(r) AS my, avg(c) AS mx, count(*) AS size FROM lab GROUP BY ALL), dd AS (SELECT lab.tile_id, comp, r, c, size, row_number() OVER (PARTITION BY lab.tile_id, comp ORDER BY round(pow(r-my,2)+pow(c-mx,2),9), r, c) AS k FROM lab JOIN mi USING (tile_id, comp)) SELECT tile_id, comp AS cluster, r, c, size FROM dd WHERE k=1",
    "blob_mask": _E + f", {_BL} SELECT tile_id, r, c, round(alpha,9) AS alpha, round(alpha,9)>=0.5 AS occluded FROM al",
    "overlay": _E + f", {_BL}, ov AS (SELECT tile_id, r, c, round(prob*255,3) AS v, round(alpha,6)*0.7 AS a FROM al) SELECT tile_id, r, c, floor(v*(1-a)+255*a)::INT AS cloud, floor(v*(1-a)+0*a)::INT AS shadow, floor(v*(1-a)+110*a)::INT AS canopy FROM ov",
    "random_occlude": f"WITH {_SC}, g AS (SELECT scene_id AS tile_id, unnest(['cloud','shadow','canopy','building']) AS effect, unnest([0.6,0.7,0.7,0.3]) AS p FROM sc) SELECT tile_id, effect FROM g WHERE ('0x'||substr(sha256('0|'||tile_id||'|any'),1,8))::BIGINT/4294967296.0<0.9 AND ('0x'||substr(sha256('0|'||tile_id||'|'||effect),1,8))::BIGINT/4294967296.0<p",
    "score_tiles": _E + ", mn AS (SELECT tile_id, avg(prob::FLOAT) AS m FROM px GROUP BY tile_id) SELECT tile_id, count(*) AS pixels FROM px JOIN mn USING (tile_id) WHERE prob::FLOAT>m GROUP BY tile_id",
}
