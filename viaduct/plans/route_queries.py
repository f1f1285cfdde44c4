"""Queries on routes themselves, demand on edges, single removals, and cuts of the grid."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import annotate, apls, closures, cuts, reports, resilience, routes
from viaduct.operators.centrality import demand_loads
from viaduct.operators.paths import SAMPLED_SOURCES, all_pairs, sampled_sources
from viaduct.operators.sampling import sample_pairs
from viaduct.plans.derived import ALL_USER_SQL, GRID_SQL, TRADE_SQL, USER_SQL, customer_grid, trade_demand, trade_network, user_demand, user_network
from viaduct.plans.extra_queries import _view
from viaduct.plans.graph_queries import APLS_SQL, CURVE_SQL, FLOW_SQL, VIEW_SQL, _scored, _views
from viaduct.plans.user_queries import _PASS
from viaduct.session import stored

SOURCES = SAMPLED_SOURCES
#: Routes drawn, their seed, and classes of closures.
DRAWS, SEED, CLASSES = 200, 7, 29


def _routes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    nodes, edges = user_network(spark, sf_dir)
    pairs = stored(sample_pairs(nodes, DRAWS, SEED).withColumnRenamed("draw", "route"), "pairs")
    return nodes, edges, pairs, routes.routes(edges, pairs)


def user_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes between drawn pairs of users, edge by edge."""
    _, edges, pairs, steps = _routes(spark, sf_dir)
    length = steps.join(edges.select("graph_id", "edge_id", "w"), ["graph_id", "edge_id"]).groupBy("route").agg(F.sum("w").alias("dist"), F.count(F.lit(1)).alias("steps"))
    found = pairs.join(routes.listed(steps), ["route", "graph_id"]).join(length, "route")
    return found.select("route", "s", "t", "dist", "steps", F.array_join("edge_ids", ",").alias("edge_ids"))


def user_broken_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The routes that closures of classes of edges, and of classes of users, break."""
    nodes, edges, pairs, steps = _routes(spark, sf_dir)
    by_edge = edges.select(F.concat(F.lit("e"), (F.col("src") + F.col("dst")) % CLASSES).alias("scenario_id"), "graph_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id"))
    by_node = nodes.select(F.concat(F.lit("n"), F.col("node") % CLASSES).alias("scenario_id"), "graph_id", F.lit("node").alias("kind"), F.col("node").cast("string").alias("id"))
    return routes.broken_routes(steps, pairs, by_edge.union(by_node)).drop("graph_id")


def trade_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines that each trade link carries."""
    found = demand_loads(*trade_network(spark, sf_dir), trade_demand(spark, sf_dir))[1]
    return found.select("src", "dst", F.round("load", 6).alias("load"), F.round("share", 9).alias("share"))


def user_edge_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows sampled users, on the edges that carry it."""
    nodes, edges = user_network(spark, sf_dir)
    found = demand_loads(nodes, edges, user_demand(spark, sf_dir).join(sampled_sources(nodes, SOURCES), ["graph_id", "s"]))[1]
    return found.select("src", "dst", F.round("load", 6).alias("load"), F.round("share", 9).alias("share"))


def user_node_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows any user, on the users between."""
    found = demand_loads(*user_network(spark, sf_dir), user_demand(spark, sf_dir))[0]
    return found.select("node", F.round("load", 6).alias("load"), F.round("share", 9).alias("share"))


def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the trade network loses with each single link."""
    found = closures.leave_one_out(*trade_network(spark, sf_dir))
    return found.select("edge_id", F.round("efficiency_loss", 9).alias("efficiency_loss"), "slower_pairs", "delay", "cut_pairs")


def user_leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of the network of users, from sampled sources."""
    found = closures.leave_one_out(*user_network(spark, sf_dir), most_sources=SOURCES)
    return found.select("edge_id", F.round("efficiency_loss", 9).alias("efficiency_loss"), "slower_pairs", "delay", "cut_pairs")


def grid_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.bridges(customer_grid(spark, sf_dir)[1]).select("src", "dst")


def grid_articulation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.articulation_points(customer_grid(spark, sf_dir)[1]).select("node")


def grid_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances from sampled nodes of the grid, which has long chains."""
    nodes, edges = customer_grid(spark, sf_dir)
    return all_pairs(nodes, edges, most_sources=SOURCES).select("s", "v", "dist")


def curve_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The area under the resilience curve of the trade network."""
    nodes, edges = _scored(spark, sf_dir)
    edges = edges.withColumn("raw", F.round("raw", 9))
    base = resilience.graph_state(nodes, edges).select("graph_id", F.col("efficiency").alias("base_efficiency"))
    found = reports.curve_area(resilience.resilience_curve(nodes, edges, stored(base, "base")))
    return found.select("graph_id", F.round("efficiency_area", 9).alias("efficiency_area"), F.round("giant_area", 9).alias("giant_area"))


def top_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of the whole network's most critical links that the fragmented view ranks among its own."""
    _, edges = annotate.scored_network(*_views(spark, sf_dir))
    of = lambda view: edges.filter(F.col("graph_id") == view).withColumn("graph_id", F.lit("trade"))
    return reports.top_retention(of("intact"), of("fragmented")).select("k", "kept", F.round("retention", 9).alias("retention"))


def routable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of routes of the whole network that the fragmented view can still drive."""
    nodes, edges = _views(spark, sf_dir)
    of = lambda df, view: stored(df.filter(F.col("graph_id") == view).withColumn("graph_id", F.lit("trade")), "view")
    found = apls.routable_share(of(nodes, "intact"), of(edges, "intact"), of(nodes, "fragmented"), of(edges, "fragmented"), pairs=100, weight="w")
    return found.select("routes", "routable", F.round("share", 9).alias("share"))


QUERIES = {
    "user_routes": user_routes, "user_broken_routes": user_broken_routes, "trade_loads": trade_loads, "user_edge_loads": user_edge_loads,
    "user_node_loads": user_node_loads, "leave_one_out": leave_one_out, "user_leave_one_out": user_leave_one_out, "grid_bridges": grid_bridges,
    "grid_articulation_points": grid_articulation_points, "grid_paths": grid_paths, "curve_area": curve_area, "top_retention": top_retention,
    "routable_share": routable_share,
}


def _draws(graph: str, n: int = DRAWS) -> str:
    unit = lambda end: f"floor(('0x'||substr(sha256('{SEED}|{graph}|'||i||'|{end}'),1,8))::BIGINT/4294967296.0*(SELECT count(*) FROM nodes))::INT"
    return f"""
draws AS (SELECT i AS draw, {unit('s')} AS a, {unit('t')} AS b FROM (SELECT unnest(generate_series(0,{n - 1})) AS i)),
idx AS (SELECT node, row_number() OVER (ORDER BY node)-1 AS i FROM nodes),
pairs_drawn AS (SELECT draw::INT AS route, p.node AS s, q.node AS t FROM draws JOIN idx p ON p.i=a JOIN idx q ON q.i=b WHERE a<>b)
"""


# Routes walked back from their ends over the least predecessor of each node.
_ROUTES = f"""
{_draws('users')},
rd(s, v, d) USING KEY (s, v) AS (SELECT DISTINCT s, s, 0::BIGINT FROM pairs_drawn
  UNION SELECT x.s, e.dst, min(x.d+e.w) FROM rd x JOIN sym e ON e.src=x.v LEFT JOIN recurring.rd r ON r.s=x.s AND r.v=e.dst WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.s, e.dst),
par AS (SELECT b.s, b.v, min(e.src) AS p FROM rd b JOIN sym e ON e.dst=b.v JOIN rd a ON a.s=b.s AND a.v=e.src AND a.d+e.w=b.d GROUP BY ALL),
back(route, s, v, k) AS (SELECT route, s, t, 0 FROM pairs_drawn UNION ALL SELECT x.route, x.s, par.p, x.k+1 FROM back x JOIN par ON par.s=x.s AND par.v=x.v),
walked AS (SELECT x.route, par.p AS src, x.v AS dst, e.edge_id, e.w, max(x.k) OVER (PARTITION BY x.route)-x.k+1 AS step FROM back x JOIN par ON par.s=x.s AND par.v=x.v JOIN sym e ON e.src=par.p AND e.dst=x.v)
"""
# Loads by definition: of each pair the paths over an edge or node, out of all of them, times its demand.
_LOAD = """
hold AS (SELECT q.s, q.t, q.demand, sg.p, ds0.d FROM demand q JOIN sigma sg ON sg.s=q.s AND sg.v=q.t JOIN dist ds0 ON ds0.s=q.s AND ds0.v=q.t),
whole AS (SELECT sum(demand) AS total FROM hold),
le AS (SELECT e.edge_id, sum(h.demand*x.p*y.p/h.p) AS load FROM hold h JOIN dist a ON a.s=h.s JOIN sigma x ON x.s=a.s AND x.v=a.v JOIN sym e ON e.src=a.v
  JOIN dist b ON b.s=e.dst AND b.v=h.t AND a.d+e.w+b.d=h.d JOIN sigma y ON y.s=b.s AND y.v=b.v GROUP BY e.edge_id),
ln AS (SELECT a.v AS node, sum(h.demand*x.p*y.p/h.p) AS load FROM hold h JOIN dist a ON a.s=h.s AND a.v<>h.s AND a.v<>h.t JOIN sigma x ON x.s=a.s AND x.v=a.v
  JOIN dist b ON b.s=a.v AND b.v=h.t AND a.d+b.d=h.d JOIN sigma y ON y.s=b.s AND y.v=b.v GROUP BY a.v)
"""
_EDGE_LOADS = "SELECT edges.src, edges.dst, round(coalesce(load,0),6) AS load, round(coalesce(load,0)/(SELECT total FROM whole),9) AS share FROM edges LEFT JOIN le USING (edge_id)"
_TRADE_DEMAND = "demand AS (SELECT c_nationkey::BIGINT AS s, s_nationkey::BIGINT AS t, count(*)::DOUBLE AS demand FROM lineitem JOIN orders ON l_orderkey=o_orderkey JOIN customer ON o_custkey=c_custkey JOIN supplier ON l_suppkey=s_suppkey WHERE c_nationkey<>s_nationkey GROUP BY ALL)"
_USER_DEMAND = "demand AS (SELECT a AS s, b AS t, count(*)::DOUBLE AS demand FROM sq WHERE a<>b AND a IN (SELECT s FROM source) GROUP BY ALL)"
# Each edge taken out by itself, and all distances found anew.
_WITHOUT = """
cases AS (SELECT edge_id AS gone FROM edges),
od(s, v, d) USING KEY (s, v) AS (SELECT s, s, 0::BIGINT FROM source
  UNION SELECT x.s, e.dst, min(x.d+e.w) FROM od x JOIN sym e ON e.src=x.v LEFT JOIN recurring.od r ON r.s=x.s AND r.v=e.dst WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.s, e.dst),
wd(gone, s, v, d) USING KEY (gone, s, v) AS (SELECT gone, s, s, 0::BIGINT FROM cases, source
  UNION SELECT x.gone, x.s, e.dst, min(x.d+e.w) FROM wd x JOIN sym e ON e.src=x.v AND e.edge_id<>x.gone LEFT JOIN recurring.wd r ON r.gone=x.gone AND r.s=x.s AND r.v=e.dst
  WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.gone, x.s, e.dst),
lost AS (SELECT c.gone, sum(CASE WHEN o.d>0 THEN 10.0/o.d ELSE 0 END)-sum(CASE WHEN w.d>0 THEN 10.0/w.d ELSE 0 END) AS loss, count(*) FILTER (WHERE w.d>o.d) AS slower_pairs,
  coalesce(sum(w.d-o.d),0)::BIGINT AS delay, count(*) FILTER (WHERE w.d IS NULL) AS cut_pairs FROM cases c CROSS JOIN od o LEFT JOIN wd w ON w.gone=c.gone AND w.s=o.s AND w.v=o.v GROUP BY c.gone)
"""
_LOST = "SELECT gone AS edge_id, round(loss/((SELECT count(*) FROM source)*((SELECT count(*) FROM nodes)-1)),9) AS efficiency_loss, slower_pairs, delay, cut_pairs FROM lost"
_ALL = "source AS (SELECT node AS s FROM nodes)"
# Cuts of the grid by a breadth-first tree: an edge off the tree covers the tree edges between its ends, and joins, around each
# node above one of its ends, the parts that the ends lie in.
_CUTS = """
lv(node, d) USING KEY (node) AS (SELECT DISTINCT comp, 0 FROM lab
  UNION SELECT e.dst, min(l.d+1) FROM lv l JOIN sym e ON e.src=l.node LEFT JOIN recurring.lv r ON r.node=e.dst WHERE r.d IS NULL OR l.d+1<r.d GROUP BY e.dst),
par AS (SELECT l.node, min(e.dst) AS p FROM lv l JOIN sym e ON e.src=l.node JOIN lv k ON k.node=e.dst AND k.d=l.d-1 GROUP BY l.node),
anc(v, a, c) AS (SELECT node, p, node FROM par UNION ALL SELECT anc.v, par.p, anc.a FROM anc JOIN par ON par.node=anc.a),
off AS (SELECT src, dst FROM edges WHERE NOT EXISTS (SELECT 1 FROM par WHERE (par.node=src AND par.p=dst) OR (par.node=dst AND par.p=src))),
up AS (SELECT v, a AS x FROM anc UNION ALL SELECT node, node FROM par),
cov AS (SELECT x FROM (SELECT u.x, off.src, off.dst FROM off JOIN up u ON u.v=off.src UNION ALL SELECT w.x, off.src, off.dst FROM off JOIN up w ON w.v=off.dst) GROUP BY x, src, dst HAVING count(*)=1),
ja AS (SELECT off.src, off.dst, a, c FROM off JOIN anc ON anc.v=off.src WHERE a<>off.dst),
jb AS (SELECT off.src, off.dst, a, c FROM off JOIN anc ON anc.v=off.dst WHERE a<>off.src),
jn AS (SELECT a, coalesce(ja.c,-1) AS x, coalesce(jb.c,-1) AS y FROM ja FULL JOIN jb USING (src, dst, a)),
js AS (SELECT a, x, y FROM jn UNION SELECT a, y, x FROM jn),
grp(a, x, g) USING KEY (a, x) AS (SELECT a, x, x FROM (SELECT p AS a, node AS x FROM par UNION SELECT node, -1 FROM par)
  UNION SELECT l.a, e.y, min(l.g) FROM grp l JOIN js e ON e.a=l.a AND e.x=l.x JOIN recurring.grp r ON r.a=l.a AND r.x=e.y WHERE l.g<r.g GROUP BY l.a, e.y)
"""


def _sql(base: str, *more: str) -> str:
    return "WITH RECURSIVE " + ",".join([base, *more])


_TOP = "SELECT edge_id, row_number() OVER (ORDER BY criticality DESC, edge_id) AS rk FROM eb2"
ORACLE_SQL = {
    "user_routes": _sql(USER_SQL, _ROUTES) + "SELECT route, s, t, sum(w)::BIGINT AS dist, count(*) AS steps, string_agg(edge_id, ',' ORDER BY step) AS edge_ids FROM walked JOIN pairs_drawn USING (route) GROUP BY ALL",
    "user_broken_routes": _sql(USER_SQL, _ROUTES) + f"SELECT scenario_id, route, min(step)::BIGINT AS first_step FROM (SELECT 'e'||(x.src+x.dst)%{CLASSES} AS scenario_id, route, step FROM walked JOIN edges x USING (edge_id) UNION ALL SELECT 'n'||walked.src%{CLASSES}, route, step FROM walked UNION ALL SELECT 'n'||walked.dst%{CLASSES}, route, step FROM walked) GROUP BY ALL",
    "trade_loads": _sql(TRADE_SQL, FLOW_SQL, _TRADE_DEMAND, _LOAD) + _EDGE_LOADS,
    "user_edge_loads": _sql(USER_SQL, _PASS, _USER_DEMAND, _LOAD) + _EDGE_LOADS,
    "user_node_loads": _sql(ALL_USER_SQL, _PASS, _USER_DEMAND, _LOAD) + "SELECT node, round(coalesce(load,0),6) AS load, round(coalesce(load,0)/(SELECT total FROM whole),9) AS share FROM nodes LEFT JOIN ln USING (node)",
    "leave_one_out": _sql(TRADE_SQL, _ALL, _WITHOUT) + _LOST,
    "user_leave_one_out": _sql(USER_SQL, _WITHOUT) + _LOST,
    "grid_bridges": _sql(GRID_SQL, _CUTS) + "SELECT least(node,p) AS src, greatest(node,p) AS dst FROM par WHERE node NOT IN (SELECT x FROM cov)",
    "grid_articulation_points": _sql(GRID_SQL, _CUTS) + "SELECT a AS node FROM grp GROUP BY a HAVING count(DISTINCT g)>1",
    "grid_paths": _sql(
        GRID_SQL,
        "wide AS (SELECT src, dst, round(round_even(length_m/(30.0*1000/3600),1)*10)::BIGINT AS w FROM edges), wsym AS (SELECT src, dst, w FROM wide UNION ALL SELECT dst, src, w FROM wide)",
        "source AS (SELECT node AS s FROM nodes ORDER BY ('0x'||substr(sha256('5|'||node),1,8))::BIGINT, node LIMIT 64)",
        "near(s, v, d) USING KEY (s, v) AS (SELECT s, s, 0::BIGINT FROM source UNION SELECT x.s, e.dst, min(x.d+e.w) FROM near x JOIN wsym e ON e.src=x.v LEFT JOIN recurring.near r ON r.s=x.s AND r.v=e.dst WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.s, e.dst)",
    ) + "SELECT s, v, d AS dist FROM near",
    "curve_area": _sql(TRADE_SQL, FLOW_SQL, CURVE_SQL) + "SELECT 'trade' AS graph_id, round(coalesce(sum((x2-x)*(e+e2)/2),0),9) AS efficiency_area, round(coalesce(sum((x2-x)*(g+g2)/2),0),9) AS giant_area FROM (SELECT x, e, g, lead(x) OVER w AS x2, lead(e) OVER w AS e2, lead(g) OVER w AS g2 FROM (SELECT t.step, round_even(t.step*per/m,3) AS x, round_even(round(eff/(SELECT eff FROM ce WHERE step=0),9),3) AS e, CASE WHEN t.step=0 THEN giant ELSE round_even(giant,3) END AS g FROM steps t JOIN ce ON ce.step=t.step JOIN cg ON cg.step=t.step) WINDOW w AS (ORDER BY step))",
    "top_retention": f"SELECT 8::BIGINT AS k, count(*) AS kept, round(count(*)/8.0::DOUBLE,9) AS retention FROM ({_view('intact', FLOW_SQL)} {_TOP}) a JOIN ({_view('fragmented', FLOW_SQL)} {_TOP}) b USING (edge_id) WHERE a.rk<=8 AND b.rk<=8",
    "routable_share": _sql(TRADE_SQL, VIEW_SQL, APLS_SQL) + "SELECT count(*) AS routes, count(f.d) AS routable, round(count(f.d)/count(*)::DOUBLE,9) AS share FROM pk JOIN ad w ON w.view='intact' AND w.s=pk.s AND w.v=pk.t LEFT JOIN ad f ON f.view='fragmented' AND f.s=pk.s AND f.v=pk.t",
}
