"""From masks of roads to networks: skeletons, junctions, chains, lengths, healing and criticality.

No walk is made: connected components of chain pixels are the edges, and the clusters next to them their ends.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions.scalars import class_by_geometry, class_by_length, foreground, geo_by_affine, geo_by_bbox, haversine_m, pixel_metres, place_by_pixel, tortuosity, travel_time_s, weight_ds
from viaduct.operators.annotate import annotate_network
from viaduct.operators.healing import WIDE_TOLERANCE_M, heal_network
from viaduct.operators.raster import AT, BIG, EIGHT, cleaned, half_width, junction_clusters, neighbour_count, node_pixels, otsu_foreground, pixel_components, shifted, thin
from viaduct.session import stored


@dataclass(frozen=True)
class Projection:
    """How pixels lie on the ground: ``place(r, c)`` gives (y, x) columns, ``metres(r1, c1, r2, c2)`` a distance.

    The columns may use those of the table of tiles.
    """

    place: Callable[[Column, Column], tuple[Column, Column]]
    metres: Callable[[Column, Column, Column, Column], Column]
    digits: int = 6

    @staticmethod
    def pixels(metres_per_pixel: float = 1.0) -> Projection:
        """Pixels as they are, each of a fixed size."""
        return Projection(place_by_pixel, lambda a, b, c, d: pixel_metres(a, b, c, d, metres_per_pixel))

    @staticmethod
    def of_place(place: Callable[[Column, Column], tuple[Column, Column]]) -> Projection:
        """Any (lat, lng) of pixels; distances are great circles."""
        return Projection(place, lambda a, b, c, d: haversine_m(*place(a, b), *place(c, d)))

    @staticmethod
    def bbox(h="h", w="w", lat_min="lat_min", lat_max="lat_max", lng_min="lng_min", lng_max="lng_max") -> Projection:
        """Tiles with columns for their extent and box."""
        return Projection.of_place(lambda r, c: geo_by_bbox(r, c, h, w, lat_min, lat_max, lng_min, lng_max))

    @staticmethod
    def affine(column: str = "affine") -> Projection:
        """Tiles with an array of six coefficients; y is the latitude."""
        return Projection.of_place(lambda r, c: geo_by_affine(r, c, column))


def skeletonize(pixels: DataFrame, size: int, threshold: float | None = None, least: int = 64, with_width: bool = False) -> DataFrame:
    """Skeletons (tile_id, r, c) of ``pixels(tile_id, r, c, prob)``, with ``d``, the half-width of the road, if asked.

    Foreground is what reaches ``threshold``, or lies above each tile's Otsu threshold; then closing, removal of small
    objects and small holes, thinning. Masks without a road give nothing.
    """
    marked = otsu_foreground(pixels) if threshold is None else pixels.filter(foreground("prob", threshold))
    whole = stored(cleaned(marked.select(*AT), size, least), "mask")
    lines = thin(whole)
    return lines.join(half_width(whole, size), AT) if with_width else lines


def _backwards(dirs: str) -> tuple[Column, Column]:
    """Where a shifted pixel came from."""
    y, x = (F.element_at(F.array(*[F.lit(-s[i]) for s in EIGHT]), F.col(dirs) + 1) for i in (0, 1))
    return F.col("r") + y, F.col("c") + x


def skeleton_to_network(
    mask: DataFrame, projection: Projection | None = None, tiles: DataFrame | None = None, cluster: bool = True, by_length: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node, r, c, lat, lng) and edges of thinned lines; each tile is a graph.

    ``tiles(tile_id, ...)`` has the columns that the projection uses, one row a tile. Edges have edge_id, src, dst,
    length_m, straight_m, road_class by length and tortuosity (or ``by_length`` alone), travel_time and w. The length
    runs along the chain and from its ends to the nodes, which stand for clusters of adjacent pixels where lines end or
    meet. Without ``cluster`` each such pixel is a node, and neighbours among them are joined by edges. Loops are
    dropped; of parallel chains the longest stays.
    """
    projection = projection or Projection.pixels()
    ends_at = stored(node_pixels(mask, cluster), "ends")
    if cluster:
        nodes = stored(junction_clusters(mask), "junctions")
        members = stored(pixel_components(ends_at, EIGHT).withColumnRenamed("comp", "cluster"), "members")
    else:
        members = stored(ends_at.select(*AT, (F.col("r").cast("long") * F.lit(BIG).cast("long") + F.col("c")).alias("cluster")), "members")
        nodes = members.withColumn("size", F.lit(1).cast("long"))
    placed = lambda df: df.join(tiles, "tile_id") if tiles is not None else df
    shuffled = lambda df: df.hint("merge")  # noqa: E731 (pixels pack so well in files that Spark would broadcast them)
    metres = lambda a, b, c, d: projection.metres(F.col(a), F.col(b), F.col(c), F.col(d))

    chain_mask = stored(neighbour_count(mask).filter("n = 2").select(*AT), "chains")
    chains = stored(pixel_components(chain_mask, EIGHT).withColumnRenamed("comp", "chain"), "chains")
    y, x = _backwards("k")
    touch = shifted(chain_mask, EIGHT).withColumns({"py": y, "px": x}).drop("k")
    ids = chains.select("tile_id", F.col("r").alias("py"), F.col("c").alias("px"), "chain")
    steps = touch.join(shuffled(chain_mask), AT, "left_semi").filter("r > py or (r = py and c > px)").join(shuffled(ids), ["tile_id", "py", "px"])
    inner = placed(steps).groupBy("tile_id", "chain").agg(F.sum(metres("py", "px", "r", "c")).alias("inner"))
    at = nodes.select("tile_id", "cluster", F.col("r").alias("y"), F.col("c").alias("x"))
    hops = touch.join(shuffled(members.select(*AT, "cluster")), AT).join(shuffled(ids), ["tile_id", "py", "px"]).join(shuffled(at), ["tile_id", "cluster"])
    hops = placed(hops).groupBy("tile_id", "chain", "cluster", "y", "x").agg(F.min(metres("py", "px", "y", "x")).alias("hop"))
    two = hops.groupBy("tile_id", "chain").agg(F.min(F.struct("cluster", "y", "x")).alias("a"), F.max(F.struct("cluster", "y", "x")).alias("b"), F.sum("hop").alias("hops")).filter("a.cluster < b.cluster")
    made = two.join(shuffled(inner), ["tile_id", "chain"], "left").withColumn("length", F.coalesce("inner", F.lit(0.0)) + F.col("hops"))
    made = made.select("tile_id", F.col("a.cluster").alias("src"), F.col("b.cluster").alias("dst"), F.col("a.y").alias("y1"), F.col("a.x").alias("x1"), F.col("b.y").alias("y2"), F.col("b.x").alias("x2"), "length", "chain")
    if not cluster:
        y, x = _backwards("k")
        half = shifted(ends_at, EIGHT).withColumns({"py": y, "px": x}).filter("r > py or (r = py and c > px)")
        near = half.join(shuffled(ends_at.select(*AT)), AT, "left_semi")
        number = lambda r, c: F.col(r).cast("long") * F.lit(BIG).cast("long") + F.col(c)
        near = placed(near).select("tile_id", number("py", "px").alias("src"), number("r", "c").alias("dst"), F.col("py").alias("y1"), F.col("px").alias("x1"), F.col("r").alias("y2"), F.col("c").alias("x2"), metres("py", "px", "r", "c").alias("length"), F.lit(-1).cast("long").alias("chain"))
        made = made.unionByName(near)
    best = made.groupBy("tile_id", "src", "dst").agg(F.max_by(F.struct("y1", "x1", "y2", "x2", "length"), F.struct(F.round("length", 6), -F.col("chain"))).alias("x"))
    best = placed(best.select("tile_id", "src", "dst", "x.*")).withColumn("straight", metres("y1", "x1", "y2", "x2"))
    length, straight = F.round("length", 6), F.round("straight", 6)
    kind = class_by_length(length) if by_length else class_by_geometry(length, straight)
    edges = best.select(
        F.col("tile_id").alias("graph_id"), F.format_string("e_px_%d_%d__px_%d_%d", "y1", "x1", "y2", "x2").alias("edge_id"), "src", "dst",
        F.bround(length, 1).alias("length_m"), F.bround(straight, 1).alias("straight_m"), F.round(tortuosity(length, straight), 6).alias("tortuosity"),
        kind.alias("road_class"), travel_time_s(length, kind).alias("travel_time"),
    ).withColumn("w", weight_ds("travel_time"))
    lat, lng = projection.place(F.col("r"), F.col("c"))
    named = placed(nodes).select(F.col("tile_id").alias("graph_id"), F.col("cluster").alias("node"), "r", "c", F.bround(lat, projection.digits).alias("lat"), F.bround(lng, projection.digits).alias("lng"))
    return named, stored(edges, "edges")


def mask_to_network(pixels: DataFrame, size: int, projection: Projection | None = None, tiles: DataFrame | None = None, threshold: float | None = None, least: int = 64) -> tuple[DataFrame, DataFrame]:
    """The network of each tile of ``pixels(tile_id, r, c, prob)``: its skeleton, then junctions and chains."""
    return skeleton_to_network(skeletonize(pixels, size, threshold, least), projection, tiles)


def graph_from_mask(
    pixels: DataFrame, size: int, projection: Projection, tiles: DataFrame, heal: DataFrame, threshold: float = 0.5, within_m: float = WIDE_TOLERANCE_M, least: int = 64
) -> tuple[DataFrame, DataFrame]:
    """Annotated networks of masks: skeleton, network of single pixels classed by length, healing, criticality.

    ``heal(graph_id, enabled)`` names the views whose gaps are closed, from ends or, if there is none, from all nodes.
    """
    nodes, edges = skeleton_to_network(skeletonize(pixels, size, threshold, least), projection, tiles, cluster=False, by_length=True)
    nodes = stored(nodes, "nodes")
    healed = heal_network(nodes, edges, within_m, fallback_all=True, views=heal)
    healed = stored(healed.filter("travel_time > 0"), "healed")  # paths need positive weights
    return annotate_network(nodes, healed)


def skeleton_stats(mask: DataFrame, skeleton: DataFrame, edges: DataFrame, tiles: DataFrame) -> DataFrame:
    """(tile_id, road_fraction, skeleton_pixels, arterial, local) of ``tiles(tile_id, h, w)``; counts of nothing are 0."""
    road = mask.groupBy("tile_id").agg(F.count(F.lit(1)).alias("road"))
    lines = skeleton.groupBy("tile_id").agg(F.count(F.lit(1)).alias("skeleton_pixels"))
    classes = edges.groupBy(F.col("graph_id").alias("tile_id")).agg(*[F.count_if(F.col("road_class") == k).alias(k) for k in ("arterial", "local")])
    own = tiles.join(road, "tile_id", "left").join(lines, "tile_id", "left").join(classes, "tile_id", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("skeleton_pixels", "arterial", "local")]
    return own.select("tile_id", (F.coalesce("road", F.lit(0)) / (F.col("h") * F.col("w"))).alias("road_fraction"), *counts)
