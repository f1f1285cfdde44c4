"""Readers and writers of road networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.functions.scalars import class_by_stem, class_by_tag, first_present, haversine_m, travel_time_s
from viaduct.session import ready
from viaduct.sources.json_items import RANGE_BYTES, read_items

FEATURE = (
    "type string, geometry struct<type:string,coordinates:string>, properties struct<id:string,source:string,target:string,"
    "criticality:double,travelTimeSec:double,lengthM:double,roadClass:string,isBridge:boolean>"
)
COORDINATES = "array<array<double>>"
OSM_ELEMENT = "type string, id bigint, lat double, lon double, nodes array<bigint>, tags map<string,string>"


def _features(lines: DataFrame) -> DataFrame:
    """(graph_id, feature, pos, f): features of ``lines(graph_id, line, value)``, each a collection or one feature.

    ``pos`` is the place in a collection, or what ``lines`` say; ``line`` is anything that orders them.
    """
    own = F.col("pos") if "pos" in lines.columns else F.lit(0)
    whole = F.from_json("value", f"type string, features array<struct<{_typed(FEATURE)}>>")
    parsed = lines.withColumn("c", whole).withColumn("one", F.from_json("value", FEATURE))
    many = parsed.filter("c.features is not null").select("graph_id", "line", F.posexplode("c.features").alias("pos", "f"))
    single = parsed.filter("c.features is null and one.geometry is not null").select("graph_id", "line", own.cast("int").alias("pos"), F.col("one").alias("f"))
    return many.unionByName(single).withColumn("feature", F.struct("line", "pos"))


def _typed(ddl: str) -> str:
    """A field list as it stands inside struct<>."""
    out, depth, word = [], 0, ""
    for ch in ddl:
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(word.strip())
            word = ""
        else:
            word += ch
    return ",".join(x.replace(" ", ":", 1) for x in [*out, word.strip()])


def read_geojson(spark: SparkSession, path: str, graph_id: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(graph_id, line, pos, value): the features of GeoJSON files as one graph, in the order of path and place.

    Collections and single features, indented or not, one or many in a file; a large file is read by many tasks
    (``json_items``). What is neither is an error when it is read; an empty collection has no features.
    """
    items = read_items(spark, path, range_bytes)
    kind = F.get_json_object("value", "$.type")
    stray = (F.col("level") == 1) & ~F.coalesce(kind.isin("Feature", "FeatureCollection"), F.lit(False))
    checked = items.withColumn("type", F.when(stray, F.raise_error(F.concat(F.col("path"), F.lit(" is no GeoJSON: byte "), F.col("at").cast("string")))).otherwise(kind))
    return checked.filter("type = 'Feature'").select(F.lit(graph_id).alias("graph_id"), F.struct("path", "at").alias("line"), "pos", "value")


def _lines_of(features: DataFrame) -> DataFrame:
    xy = F.from_json("f.geometry.coordinates", COORDINATES)
    return features.filter("f.geometry.type = 'LineString'").withColumn("xy", xy).filter(F.size("xy") >= 2)


def _first_pair(edges: DataFrame, order: str = "feature", last: bool = False) -> DataFrame:
    """One edge for each unordered pair: the first, or the last."""
    keep = F.max_by if last else F.min_by
    names = [c for c in edges.columns if c not in ("graph_id", "src", "dst")]
    row = F.struct("src", "dst", *names)
    own = edges.filter("src <> dst").groupBy("graph_id", F.least("src", "dst").alias("_a"), F.greatest("src", "dst").alias("_b"))
    return own.agg(keep(row, order).alias("x")).select("graph_id", "x.*")


def geojson_network(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of GeoJSON LineStrings with two vertices at least; other features are skipped.

    Ends are the named source and target, else n_lat_lng of the end vertices; the first edge of a pair wins, and ends
    of edges that lose, or loop, are nodes all the same. Missing numbers are 0, the class is local, ids are e_position.
    """
    own = _lines_of(_features(lines))
    p = F.col("f.properties")
    first, last = F.element_at("xy", 1), F.element_at("xy", -1)

    def key(named, v):
        return F.coalesce(named, F.concat_ws("_", F.lit("n"), F.bround(v[1], 6).cast("string"), F.bround(v[0], 6).cast("string")))

    edges = own.select(
        "graph_id", "feature", F.coalesce(p["id"], F.concat(F.lit("e_"), F.col("pos"))).alias("edge_id"),
        key(p["source"], first).alias("src"), key(p["target"], last).alias("dst"), first.alias("p0"), last.alias("p1"),
        F.coalesce(p["lengthM"], F.lit(0.0)).alias("length_m"), F.coalesce(p["roadClass"], F.lit("local")).alias("road_class"),
        F.coalesce(p["travelTimeSec"], F.lit(0.0)).alias("travel_time"), F.coalesce(p["criticality"], F.lit(0.0)).alias("criticality"),
        F.coalesce(p["isBridge"], F.lit(False)).alias("is_bridge"),
    )
    ends = edges.select("graph_id", "feature", F.explode(F.array(F.struct(F.col("src").alias("node"), F.col("p0").alias("v")), F.struct(F.col("dst").alias("node"), F.col("p1").alias("v")))).alias("e"))
    nodes = ends.groupBy("graph_id", "e.node").agg(F.min_by("e.v", "feature").alias("v"))
    nodes = nodes.select("graph_id", "node", F.col("v")[1].alias("lat"), F.col("v")[0].alias("lng"))
    return nodes, _first_pair(edges.drop("p0", "p1")).drop("feature")


def geojson_chain(lines: DataFrame, weight: str = "lengthM") -> DataFrame:
    """(graph_id, src, dst, length_m, weight): every step between neighbouring vertices; keys are rounded to 7.

    The weight of a feature stands on each of its steps; the last feature with a pair wins.
    """
    own = _lines_of(_features(lines)).select("graph_id", "feature", F.col(f"f.properties.{weight}").alias("weight"), F.posexplode("xy").alias("i", "v"))
    here = own.select("graph_id", "feature", "weight", "i", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))
    w = Window.partitionBy("graph_id", "feature").orderBy("i")
    here = here.withColumn("x2", F.lead("x").over(w)).withColumn("y2", F.lead("y").over(w)).filter("x2 is not null")
    key = [F.concat_ws(",", F.bround(a, 7).cast("string"), F.bround(b, 7).cast("string")) for a, b in (("x", "y"), ("x2", "y2"))]
    steps = here.select("graph_id", F.struct("feature", "i").alias("feature"), key[0].alias("src"), key[1].alias("dst"), F.round(haversine_m("y", "x", "y2", "x2"), 6).alias("length_m"), "weight")
    return _first_pair(steps, last=True).drop("feature")


def read_osm(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> tuple[DataFrame, DataFrame]:
    """(id, lat, lon) of the nodes and (id, nodes, tags) of the ways, with two nodes at least, of OSM JSON documents.

    A file holds one document or many, of any layout; a large one is read by many tasks (``json_items``). A document
    without elements has neither nodes nor ways.
    """
    e = read_items(spark, path, range_bytes).filter("level = 3").select(F.from_json("value", OSM_ELEMENT).alias("e")).select("e.*")
    return e.filter("type = 'node'").select("id", "lat", "lon"), e.filter("type = 'way' and size(nodes) >= 2").select("id", "nodes", "tags")


def within_area(nodes: DataFrame, lat_min: float, lat_max: float, lng_min: float, lng_max: float) -> DataFrame:
    return nodes.filter(F.col("lat").between(lat_min, lat_max) & F.col("lon").between(lng_min, lng_max))


def allowed_ways(ways: DataFrame, highways: tuple[str, ...]) -> DataFrame:
    return ways.filter(F.col("tags")["highway"].isin(*highways))


def node_usage(ways: DataFrame) -> DataFrame:
    """(id, uses): visits by ways, repeated visits of one way too, and whether a way ends there."""
    steps = ways.select(F.posexplode("nodes").alias("i", "id"), F.size("nodes").alias("n"))
    end = (F.col("i") == 0) | (F.col("i") == F.col("n") - 1)
    return steps.groupBy("id").agg(F.count(F.lit(1)).alias("uses"), F.max(end).alias("is_end"))


def osm_to_network(nodes: DataFrame, ways: DataFrame, graph_id: str = "osm") -> tuple[DataFrame, DataFrame]:
    """Nodes and edges between junctions: way ends and nodes used more than once. Distances along a way are summed.

    Loops, edges of no length and steps at unknown nodes are dropped; the first edge of a pair wins.
    """
    usage = node_usage(ways).select("id", (F.col("is_end") | (F.col("uses") > 1)).alias("junction"))
    steps = ways.select(F.col("id").alias("way"), F.coalesce(F.col("tags")["highway"], F.lit("")).alias("highway"), F.posexplode("nodes").alias("i", "id"))
    steps = steps.join(nodes, "id").join(usage, "id")
    w = Window.partitionBy("way").orderBy("i")
    steps = steps.withColumn("d", F.coalesce(haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), "lat", "lon"), F.lit(0.0)))
    steps = steps.withColumn("from", F.lag(F.when(F.col("junction"), F.col("id"))).over(w)).withColumn("seg", F.coalesce(F.sum(F.col("junction").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a segment runs from the junction that opens it to the one that closes it
    closing = steps.groupBy("way", "highway", "seg").agg(F.sum("d").alias("length"), F.max_by("id", "i").alias("dst"), F.max("i").alias("i"), F.max_by("junction", "i").alias("ends"))
    opening = steps.filter("junction").select("way", (F.col("seg") + 1).alias("seg"), F.col("id").alias("src"))
    found = closing.filter("ends").join(opening, ["way", "seg"]).filter("length > 0")
    named = found.select(F.lit(graph_id).alias("graph_id"), F.struct("way", "seg").alias("feature"), "src", "dst", F.bround(F.round("length", 6), 1).alias("length_m"), class_by_stem("highway").alias("road_class"))
    edges = _first_pair(named).withColumn("travel_time", travel_time_s("length_m", "road_class")).drop("feature")
    used = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    return nodes.join(used, "id").select(F.lit(graph_id).alias("graph_id"), F.col("id").alias("node"), "lat", F.col("lon").alias("lng")), edges


def multigraph_to_network(nodes: DataFrame, edges: DataFrame, last: bool = False) -> tuple[DataFrame, DataFrame]:
    """A simple network of ``nodes(graph_id, node, y, x)`` and directed ``edges(graph_id, key, src, dst, highway, length)``.

    Of parallel edges the first by key wins, or the last; the first highway tag counts; a missing length is measured.
    """
    points = nodes.select("graph_id", "node", F.bround("y", 6).alias("lat"), F.bround("x", 6).alias("lng"))
    a = points.toDF("graph_id", "src", "lat_a", "lng_a")
    b = points.toDF("graph_id", "dst", "lat_b", "lng_b")
    own = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    length = F.bround(F.round(F.coalesce("length", haversine_m("lat_a", "lng_a", "lat_b", "lng_b")), 6), 1)
    own = own.select("graph_id", "key", "src", "dst", length.alias("length_m"), class_by_tag(F.element_at("highway", 1)).alias("road_class"))
    simple = _first_pair(own, "key", last).drop("key")
    return points, simple.withColumn("travel_time", travel_time_s("length_m", "road_class"))


def multigraph_plain(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (graph_id, node, x, y) and edges (graph_id, src, dst, length) of a multigraph, as path similarity needs them.

    Coordinates may be named x and y, lng and lat, or lon and lat. The last of parallel edges by key stays, without
    another length than its own.
    """
    x, y = first_present(nodes.columns, "x", "lng", "lon"), first_present(nodes.columns, "y", "lat")
    simple = _first_pair(edges.select("graph_id", "key", "src", "dst", "length"), "key", last=True).drop("key")
    return nodes.select("graph_id", "node", x.alias("x"), y.alias("y")), simple


def centerlines(lines: DataFrame) -> DataFrame:
    """(graph_id, feature, part, points array<struct<x,y>>) of LineStrings and of each part of MultiLineStrings."""
    own = _features(lines).select("graph_id", "feature", F.col("f.geometry.type").alias("type"), F.col("f.geometry.coordinates").alias("raw"))
    single = own.filter("type = 'LineString'").select("graph_id", "feature", F.lit(0).alias("part"), F.from_json("raw", COORDINATES).alias("xy"))
    multi = own.filter("type = 'MultiLineString'").select("graph_id", "feature", F.posexplode(F.from_json("raw", f"array<{COORDINATES}>")).alias("part", "xy"))
    return single.union(multi).withColumn("points", F.transform("xy", lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))).drop("xy")


def grid_network(spark: SparkSession, rows: int = 9, cols: int = 9, bbox=(12.90, 13.04, 77.52, 77.66), spurs: bool = True, offset: float = 0.012) -> tuple[DataFrame, DataFrame]:
    """A lattice whose middle row and column are arterial, with four dead ends at its sides."""
    lat0, lat1, lng0, lng1 = bbox
    cell = ready(spark).range(rows * cols).select(F.floor(F.col("id") / cols).alias("r"), (F.col("id") % cols).alias("c"))
    name = lambda r, c: F.concat_ws("_", F.concat(F.lit("n"), r.cast("string")), c.cast("string"))
    nodes = cell.select(F.lit("grid").alias("graph_id"), name(F.col("r"), F.col("c")).alias("node"), F.bround(lat0 + (lat1 - lat0) * F.col("r") / (rows - 1), 6).alias("lat"), F.bround(lng0 + (lng1 - lng0) * F.col("c") / (cols - 1), 6).alias("lng"))
    steps = cell.withColumn("s", F.explode(F.array(F.struct(F.lit(0).alias("dr"), F.lit(1).alias("dc")), F.struct(F.lit(1).alias("dr"), F.lit(0).alias("dc")))))
    steps = steps.withColumn("r2", F.col("r") + F.col("s.dr")).withColumn("c2", F.col("c") + F.col("s.dc")).filter((F.col("r2") < rows) & (F.col("c2") < cols))
    main = ((F.col("s.dc") == 1) & (F.col("r") == rows // 2)) | ((F.col("s.dr") == 1) & (F.col("c") == cols // 2))
    edges = steps.select(name(F.col("r"), F.col("c")).alias("src"), name(F.col("r2"), F.col("c2")).alias("dst"), F.when(main, "arterial").otherwise("local").alias("road_class"))
    if spurs:
        # Where the dead ends hang and to which side they point.
        ends = [("s_south", 0, 2, -offset, 0.0), ("s_north", rows - 1, cols - 3, offset, 0.0), ("s_west", 2, 0, 0.0, -offset), ("s_east", rows - 3, cols - 1, 0.0, offset)]
        made = spark.createDataFrame([(n, f"n{r}_{c}", dy, dx) for n, r, c, dy, dx in ends], "node string, at string, dy double, dx double")
        hung = made.join(nodes.withColumnRenamed("node", "at"), "at").select("graph_id", "node", F.bround(F.col("lat") + F.col("dy"), 6).alias("lat"), F.bround(F.col("lng") + F.col("dx"), 6).alias("lng"))
        nodes = nodes.unionByName(hung)
        edges = edges.union(made.select("at", "node", F.lit("local")))
    a, b = nodes.drop("graph_id").toDF("src", "lat_a", "lng_a"), nodes.drop("graph_id").toDF("dst", "lat_b", "lng_b")
    edges = edges.join(a, "src").join(b, "dst").withColumn("length_m", F.bround(F.round(haversine_m("lat_a", "lng_a", "lat_b", "lng_b"), 6), 1))
    edges = edges.withColumn("travel_time", travel_time_s("length_m", "road_class")).withColumn("w", F.round(F.col("travel_time") * 10).cast("long"))
    return nodes, edges.select(F.lit("grid").alias("graph_id"), F.concat_ws("__", F.concat(F.lit("e_"), "src"), "dst").alias("edge_id"), "src", "dst", "length_m", "road_class", "travel_time", "w")


def features_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, value): each edge as a GeoJSON feature on a line of its own."""
    at = nodes.select("graph_id", "node", F.array("lng", "lat").alias("xy"))
    own = edges.join(at.toDF("graph_id", "src", "xy_a"), ["graph_id", "src"]).join(at.toDF("graph_id", "dst", "xy_b"), ["graph_id", "dst"])

    def or_else(name: str, default):
        return F.coalesce(F.col(name), F.lit(default)) if name in edges.columns else F.lit(default)

    properties = F.struct(
        F.col("edge_id").cast("string").alias("id"), F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"),
        or_else("criticality", 0.0).alias("criticality"), or_else("travel_time", 0.0).alias("travelTimeSec"), or_else("length_m", 0.0).alias("lengthM"),
        or_else("road_class", "local").alias("roadClass"), or_else("is_bridge", False).alias("isBridge"),
    )
    geometry = F.struct(F.lit("LineString").alias("type"), F.array("xy_a", "xy_b").alias("coordinates"))
    return own.select("graph_id", F.to_json(F.struct(F.lit("Feature").alias("type"), geometry.alias("geometry"), properties.alias("properties"))).alias("value"))


def write_geojson(nodes: DataFrame, edges: DataFrame, path: str, collection: bool = False) -> None:
    """Features as lines of text (GeoJSON text sequence), or, as one ``collection``, a single document of a single file.

    A collection passes through one task, feature by feature, in the order of graphs and texts; lines are written by all.
    """
    lines = features_of(nodes, edges)
    if not collection:
        lines.select("value").write.text(path)
        return
    head, tail = '{"type":"FeatureCollection","features":[', "]}"
    spark = nodes.sparkSession
    first = lines.select(F.min(F.struct("graph_id", "value")).alias("x"))
    listed = lines.select(F.lit(1).alias("place"), "graph_id", "value").join(F.broadcast(first), F.lit(True), "left")  # one row
    listed = listed.select("place", "graph_id", F.when(F.struct("graph_id", "value") == F.col("x"), F.col("value")).otherwise(F.concat(F.lit(","), "value")).alias("value"), F.col("value").alias("by"))
    ends = spark.createDataFrame([(0, "", head, ""), (2, "", tail, "")], "place int, graph_id string, value string, by string")
    listed.unionByName(ends).repartition(1).sortWithinPartitions("place", "graph_id", "by").select("value").write.text(path)


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, value): each graph as one JSON object of nodes and links; for graphs of city size."""
    n = nodes.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(F.col("node").alias("id"), "lat", "lng"))).alias("nodes"))
    e = edges.groupBy("graph_id").agg(F.sort_array(F.collect_list(F.struct(F.col("src").alias("source"), F.col("dst").alias("target"), F.col("edge_id").alias("id")))).alias("links"))
    return n.join(e, "graph_id", "left").select("graph_id", F.to_json(F.struct("nodes", "links")).alias("value"))
