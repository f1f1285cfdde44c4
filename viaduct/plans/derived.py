"""Road networks and rasters derived from the star-schema tables, in Spark and as SQL with the same names.

``trade``: nations joined by their strongest trade; ``grid``: customers on a lattice with gaps; ``users``: users who follow
each other in the events. Rasters: ``emb`` from embeddings and ``lines`` from lineitem. Each SQL constant is a list of common table expressions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.functions.scalars import haversine_m, sigmoid, travel_time_s, weight_ds
from viaduct.session import ready, stored


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def with_geometry(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with length_m from the coordinates of their ends."""
    a = nodes.select("graph_id", F.col("node").alias("src"), F.col("lat").alias("lat_a"), F.col("lng").alias("lng_a"))
    b = nodes.select("graph_id", F.col("node").alias("dst"), F.col("lat").alias("lat_b"), F.col("lng").alias("lng_b"))
    both = edges.join(a, ["graph_id", "src"]).join(b, ["graph_id", "dst"])
    length = F.round(F.round(haversine_m("lat_a", "lng_a", "lat_b", "lng_b"), 6), 1)
    return both.withColumn("length_m", length).drop("lat_a", "lng_a", "lat_b", "lng_b")


def trade_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``trade``; the work grows with lineitem, which is summed up before anything else."""
    key = F.col("n_nationkey").cast("long")
    nodes = table(spark, sf_dir, "nation").select(
        F.lit("trade").alias("graph_id"), key.alias("node"), (12.90 + 0.035 * F.floor(key / 5)).alias("lat"), (77.52 + 0.035 * (key % 5)).alias("lng")
    )
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("c"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("s"))
    flows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    flows = flows.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).filter("c <> s")
    pairs = flows.groupBy(F.least("c", "s").alias("src"), F.greatest("c", "s").alias("dst")).agg(F.sum("k").alias("volume"))
    both = pairs.select(F.col("src").alias("n"), F.col("dst").alias("o"), "*").union(pairs.select("dst", "src", "*"))
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("volume"), "o"))
    kept = both.withColumn("rank", rank).filter(F.col("rank") <= 1 + F.col("n") % 2).select("src", "dst", "volume").distinct()
    mean = kept.agg(F.avg("volume").alias("mean"))
    kept = kept.crossJoin(F.broadcast(mean)).select(  # one row
        F.lit("trade").alias("graph_id"), F.concat(F.lit("e_"), "src", F.lit("_"), "dst").alias("edge_id"), "src", "dst",
        F.when(F.col("volume") >= F.col("mean"), "arterial").otherwise("local").alias("road_class"),
    )
    edges = with_geometry(kept, nodes).withColumn("travel_time", travel_time_s("length_m", "road_class")).withColumn("w", weight_ds("travel_time"))
    return stored(nodes, "nodes"), stored(edges.select("graph_id", "edge_id", "src", "dst", "length_m", "road_class", "travel_time", "w"), "edges")


HAVERSINE_SQL = "2*6371000.0*asin(least(1.0,sqrt(pow(sin(radians({c}-{a})/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-{b})/2),2))))"


def _hav(a: str, b: str, c: str, d: str) -> str:
    return HAVERSINE_SQL.format(a=a, b=b, c=c, d=d)


TRADE_SQL = f"""
nodes AS (SELECT 'trade' AS graph_id, n_nationkey::BIGINT AS node, 12.90::DOUBLE+0.035::DOUBLE*(n_nationkey//5) AS lat, 77.52::DOUBLE+0.035::DOUBLE*(n_nationkey%5) AS lng FROM nation),
pairs AS (SELECT least(c_nationkey,s_nationkey)::BIGINT AS src, greatest(c_nationkey,s_nationkey)::BIGINT AS dst, count(*) AS volume
  FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey
  WHERE c_nationkey<>s_nationkey GROUP BY ALL),
sym0 AS (SELECT src AS n, dst AS o, * FROM pairs UNION ALL SELECT dst, src, * FROM pairs),
kept AS (SELECT DISTINCT src, dst, volume FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY volume DESC, o) AS rk FROM sym0) WHERE rk <= 1 + n % 2),
edges AS (SELECT *, round(travel_time*10)::BIGINT AS w FROM (
  SELECT *, round_even(length_m/((CASE WHEN road_class='arterial' THEN 50.0 ELSE 30.0 END)*1000/3600),1) AS travel_time FROM (
    SELECT 'trade' AS graph_id, 'e_'||src||'_'||dst AS edge_id, src, dst, round(round({_hav("a.lat", "a.lng", "b.lat", "b.lng")},6),1) AS length_m,
      CASE WHEN volume >= (SELECT avg(volume) FROM kept) THEN 'arterial' ELSE 'local' END AS road_class
    FROM kept JOIN nodes a ON a.node=src JOIN nodes b ON b.node=dst))),
sym AS (SELECT src, dst, w, edge_id FROM edges UNION ALL SELECT dst, src, w, edge_id FROM edges)
"""


def customer_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``grid``: customers on a lattice; account balances decide which links are there."""
    own = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k"), "c_acctbal")
    size = own.agg(F.ceil(F.sqrt(F.count(F.lit(1)))).alias("m"))
    own = own.crossJoin(F.broadcast(size))  # one row
    nodes = own.select(F.lit("grid").alias("graph_id"), F.col("k").alias("node"), (12.0 + 0.001 * F.floor(F.col("k") / F.col("m"))).alias("lat"), (77.0 + 0.001 * (F.col("k") % F.col("m"))).alias("lng"))
    n = F.col("c_acctbal") >= 0
    right = own.filter(n & (F.col("k") % F.col("m") < F.col("m") - 1)).select("k", (F.col("k") + 1).alias("o"))
    down = own.filter(n & (F.floor("c_acctbal") % 2 == 0)).select("k", (F.col("k") + F.col("m")).alias("o"))
    links = right.union(down).join(own.select(F.col("k").alias("o")), "o", "left_semi")
    edges = links.select(F.lit("grid").alias("graph_id"), F.concat(F.lit("e_"), "k", F.lit("_"), "o").alias("edge_id"), F.col("k").alias("src"), F.col("o").alias("dst"), F.lit("local").alias("road_class"))
    edges = with_geometry(edges, nodes).withColumn("travel_time", travel_time_s("length_m", "road_class")).withColumn("w", weight_ds("travel_time"))
    return stored(nodes, "nodes"), stored(edges.select("graph_id", "edge_id", "src", "dst", "length_m", "road_class", "travel_time", "w"), "edges")


GRID_SQL = f"""
m AS (SELECT ceil(sqrt(count(*)))::BIGINT AS m FROM customer),
own AS (SELECT c_custkey::BIGINT AS k, c_acctbal, m FROM customer, m),
nodes AS (SELECT 'grid' AS graph_id, k AS node, 12.0::DOUBLE+0.001::DOUBLE*(k//m) AS lat, 77.0::DOUBLE+0.001::DOUBLE*(k%m) AS lng FROM own),
links AS (SELECT k AS src, k+1 AS dst FROM own WHERE c_acctbal>=0 AND k%m<m-1 UNION ALL SELECT k, k+m FROM own WHERE c_acctbal>=0 AND floor(c_acctbal)::BIGINT%2=0),
edges AS (SELECT 'grid' AS graph_id, 'e_'||src||'_'||dst AS edge_id, src, dst, round(round({_hav("a.lat", "a.lng", "b.lat", "b.lng")},6),1) AS length_m FROM links JOIN nodes a ON a.node=src JOIN nodes b ON b.node=dst),
sym AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges),
lab(node, comp) USING KEY (node) AS (SELECT node, node FROM nodes
  UNION SELECT e.dst, min(l.comp) FROM lab l JOIN sym e ON l.node=e.src JOIN recurring.lab r ON r.node=e.dst WHERE l.comp<r.comp GROUP BY e.dst)
"""


def embedding_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tile_id, r, c, prob, target, occluded, pred): one tile of a row per vector and a column per value.

    Vectors are dealt out before they become pixels, as a table in one piece would be cut by one task.
    """
    own = table(spark, sf_dir, "embeddings").select("vec_id", "embedding").repartition("vec_id").select(F.col("vec_id").cast("int").alias("r"), F.posexplode("embedding").alias("c", "v"))
    v = F.col("v").cast("double")
    own = own.select(F.concat(F.lit("emb_"), F.floor(F.col("r") / 100).cast("string")).alias("tile_id"), (F.col("r") % 100).alias("r"), "c", v.alias("v"), F.col("r").alias("row"))
    prob = F.round(sigmoid(8 * F.col("v")), 6)
    own = own.select("tile_id", "r", "c", prob.alias("prob"), (F.col("v") >= 0.05).alias("target"), (F.col("c") >= 40).alias("occluded"), "row")
    dim = F.when(F.col("occluded") & (F.col("row") % 2 == 1), F.lit(0.5)).otherwise(1.0)
    return own.select("tile_id", "r", "c", "prob", "target", "occluded", F.round(F.col("prob") * dim, 6).alias("pred"))


EMB_SQL = """
raw AS (SELECT vec_id::INT AS row, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding,1)-1 AS c FROM embeddings),
px0 AS (SELECT 'emb_'||(row//100) AS tile_id, (row%100)::INT AS r, c::INT AS c, round(1/(1+exp(-8*v)),6) AS prob, v>=0.05 AS target, c>=40 AS occluded, row FROM raw),
px AS (SELECT tile_id, r, c, prob, target, occluded, round(prob*(CASE WHEN occluded AND row%2=1 THEN 0.5 ELSE 1.0 END),6) AS pred FROM px0)
"""


def line_pixels(spark: SparkSession, sf_dir: str, size: int = 96) -> DataFrame:
    """(tile_id, r, c, prob): lineitem counted into a tile for each supplier; tiles and pixels grow with the fact table."""
    own = table(spark, sf_dir, "lineitem").groupBy(
        F.concat(F.lit("t"), F.col("l_suppkey").cast("string")).alias("tile_id"), (F.col("l_orderkey") % size).cast("int").alias("r"), (F.col("l_partkey") % size).cast("int").alias("c")
    )
    return own.agg(F.round(F.avg(F.col("l_discount") * 10), 6).alias("prob"))


LINES_SQL = """
px AS (SELECT 't'||l_suppkey AS tile_id, (l_orderkey%96)::INT AS r, (l_partkey%96)::INT AS c, round(avg(l_discount*10),6) AS prob FROM lineitem GROUP BY ALL)
"""


def user_network(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of ``users``: who follows whom within an hour and type of event, the two most frequent of each."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("a"), "event_type", "ts", "event_id")
    nodes = own.select(F.lit("users").alias("graph_id"), F.col("a").alias("node")).distinct()
    hour = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    steps = own.select("a", F.lead("a").over(hour).alias("b")).filter("a <> b")
    pairs = steps.groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst")).agg(F.count(F.lit(1)).alias("volume"))
    both = pairs.select(F.col("src").alias("n"), F.col("dst").alias("o"), "*").union(pairs.select("dst", "src", "*"))
    rank = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("volume"), "o"))
    kept = both.withColumn("rank", rank).filter("rank <= 2").select("src", "dst", "volume").distinct()
    edges = kept.select(F.lit("users").alias("graph_id"), F.concat(F.lit("u_"), "src", F.lit("_"), "dst").alias("edge_id"), "src", "dst", (1 + F.floor(F.lit(100) / F.col("volume"))).cast("long").alias("w"))
    return stored(nodes, "nodes"), stored(edges, "edges")


def user_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, s, t, demand): how often t follows s within an hour and type of event."""
    own = table(spark, sf_dir, "events").select(F.col("user_id").cast("long").alias("s"), "event_type", "ts", "event_id")
    hour = Window.partitionBy("event_type", F.date_trunc("hour", "ts")).orderBy("ts", "event_id")
    steps = own.select("s", F.lead("s").over(hour).alias("t")).filter("s <> t")
    return steps.groupBy(F.lit("users").alias("graph_id"), "s", "t").agg(F.count(F.lit(1)).alias("demand"))


def trade_demand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(graph_id, s, t, demand): order lines of customers of nation s from suppliers of nation t."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.count(F.lit(1)).alias("k"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").cast("long").alias("s"))
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("long").alias("t"))
    flows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    flows = flows.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).filter("s <> t")
    return flows.groupBy(F.lit("trade").alias("graph_id"), "s", "t").agg(F.sum("k").alias("demand"))


USER_SQL = """
nodes AS (SELECT DISTINCT 'users' AS graph_id, user_id::BIGINT AS node FROM events),
sq AS (SELECT user_id::BIGINT AS a, lead(user_id::BIGINT) OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS b FROM events),
pairs AS (SELECT least(a,b) AS src, greatest(a,b) AS dst, count(*) AS volume FROM sq WHERE a<>b GROUP BY ALL),
sym0 AS (SELECT src AS n, dst AS o, * FROM pairs UNION ALL SELECT dst, src, * FROM pairs),
edges AS (SELECT DISTINCT 'users' AS graph_id, 'u_'||src||'_'||dst AS edge_id, src, dst, 1+100//volume AS w FROM (SELECT *, row_number() OVER (PARTITION BY n ORDER BY volume DESC, o) AS rk FROM sym0) WHERE rk<=2),
sym AS (SELECT src, dst, w, edge_id FROM edges UNION ALL SELECT dst, src, w, edge_id FROM edges),
source AS (SELECT node AS s FROM nodes ORDER BY ('0x'||substr(sha256('5|'||node),1,8))::BIGINT, node LIMIT 64)
"""
#: The same with all users as sources.
ALL_USER_SQL = USER_SQL[: USER_SQL.index("source AS")] + "source AS (SELECT node AS s FROM nodes)\n"
