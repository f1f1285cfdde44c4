"""Path, centrality, cut and curve queries over the network of users, which grows with the events.

Paths start at all users where a query sums over them (betweenness of nodes, the curve, loads of nodes); that work grows with
the square of the network, and is shared out by sources. The other queries start at 64 sampled sources (``sampled_sources``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import annotate, cuts, resilience
from viaduct.operators.centrality import betweenness
from viaduct.operators.paths import SAMPLED_SOURCES, all_pairs, global_efficiency
from viaduct.plans.derived import ALL_USER_SQL, USER_SQL, user_network
from viaduct.plans.graph_queries import CUT_SQL, DIST_SQL
from viaduct.session import stored

SOURCES = SAMPLED_SOURCES
CLOSED = 10


def user_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return user_network(spark, sf_dir)[1].select("edge_id", "src", "dst", "w")


def user_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = user_network(spark, sf_dir)
    return all_pairs(nodes, edges, most_sources=SOURCES).select("s", "v", "dist")


def user_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = user_network(spark, sf_dir)
    return global_efficiency(nodes, all_pairs(nodes, edges, most_sources=SOURCES)).select("n", F.round("efficiency", 9).alias("efficiency"))


def _flow(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nodes, edges = user_network(spark, sf_dir)
    return betweenness(nodes, edges, all_pairs(nodes, edges, most_sources=SOURCES))


def user_node_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What passes each user on the shortest paths from all users."""
    return betweenness(*user_network(spark, sf_dir))[0].select("node", F.round("betweenness", 9).alias("betweenness"))


def user_edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flow(spark, sf_dir)[1].select("src", "dst", F.round("betweenness", 9).alias("betweenness"))


def user_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.bridges(user_network(spark, sf_dir)[1]).select("src", "dst")


def user_articulation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.articulation_points(user_network(spark, sf_dir)[1]).select("node")


def user_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The curve of the network of users, from all of them at each step, relative to its own efficiency."""
    nodes, edges = user_network(spark, sf_dir)
    edges = annotate.scored_network(nodes, edges)[1].withColumn("raw", F.round("raw", 9))
    base = spark.createDataFrame([], "graph_id string, base_efficiency double")
    found = resilience.resilience_curve(nodes, edges, base)
    return found.select("step", "removed_fraction", "efficiency", F.round("giant", 9).alias("giant"))


def user_closures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten closures, each of a tenth of all users."""
    nodes, edges = user_network(spark, sf_dir)
    base = stored(resilience.graph_state(nodes, edges, SOURCES).select("graph_id", F.col("efficiency").alias("base_efficiency")), "base")
    cases = nodes.select(F.concat(F.lit("c"), F.col("node") % CLOSED).alias("scenario_id"), "graph_id", F.lit("node").alias("kind"), F.col("node").cast("string").alias("id"))
    return resilience.simulate_removal(nodes, edges, stored(cases, "scenarios"), base, most_sources=SOURCES).drop("graph_id")


QUERIES = {
    "user_edges": user_edges, "user_paths": user_paths, "user_efficiency": user_efficiency, "user_node_betweenness": user_node_betweenness,
    "user_edge_betweenness": user_edge_betweenness, "user_bridges": user_bridges, "user_articulation_points": user_articulation_points,
    "user_curve": user_curve, "user_closures": user_closures,
}

# Distances from the sampled sources; and what passes a node or an edge on shortest paths from them, by definition.
_FROM = """
near(s, v, d) USING KEY (s, v) AS (SELECT s, s, 0::BIGINT FROM source
  UNION SELECT x.s, e.dst, min(x.d+e.w) FROM near x JOIN sym e ON e.src=x.v LEFT JOIN recurring.near r ON r.s=x.s AND r.v=e.dst
  WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.s, e.dst)
"""
_PASS = f"""
{DIST_SQL},
tight AS (SELECT a.s, e.src, e.dst FROM dist a JOIN sym e ON e.src=a.v JOIN dist b ON b.s=a.s AND b.v=e.dst AND b.d=a.d+e.w),
walks(s, v, hop, p) AS (SELECT node, node, 0, 1.0::DOUBLE FROM nodes UNION ALL SELECT x.s, t.dst, x.hop+1, sum(x.p) FROM walks x JOIN tight t ON t.s=x.s AND t.src=x.v GROUP BY x.s, t.dst, x.hop+1),
sigma AS (SELECT s, v, sum(p) AS p FROM walks GROUP BY ALL),
ds AS (SELECT dist.s, dist.v, d, p FROM dist JOIN sigma ON sigma.s=dist.s AND sigma.v=dist.v),
big AS (SELECT count(*)::DOUBLE AS n, (SELECT count(*) FROM source)::DOUBLE AS k FROM nodes),
nbv AS (SELECT a.v AS node, sum(a.p*b.p/c.p) AS raw FROM ds a JOIN source ON source.s=a.s JOIN ds b ON b.s=a.v JOIN ds c ON c.s=a.s AND c.v=b.v AND c.d=a.d+b.d WHERE a.v<>a.s AND b.v<>a.v AND b.v<>a.s GROUP BY a.v),
nb AS (SELECT nodes.node, coalesce(raw,0)*n/k/(n-1)/(n-2) AS betweenness FROM nodes CROSS JOIN big LEFT JOIN nbv ON nbv.node=nodes.node),
ebv AS (SELECT e.edge_id, sum(a.p*b.p/c.p) AS raw FROM sym e JOIN ds a ON a.v=e.src JOIN source ON source.s=a.s JOIN ds b ON b.s=e.dst JOIN ds c ON c.s=a.s AND c.v=b.v AND c.d=a.d+e.w+b.d GROUP BY e.edge_id),
eb AS (SELECT edges.*, coalesce(raw,0)*n/k/n/(n-1) AS raw FROM edges CROSS JOIN big LEFT JOIN ebv ON ebv.edge_id=edges.edge_id)
"""
_CURVE = """
ao AS (SELECT *, row_number() OVER (ORDER BY round(raw,9) DESC, edge_id) AS rank, count(*) OVER () AS m FROM eb),
steps AS (SELECT s.step, greatest(1, floor(m*0.5/10)) AS per, m FROM (SELECT unnest(generate_series(0,10)) AS step) s, (SELECT DISTINCT m FROM ao) WHERE s.step=0 OR (s.step-1)*greatest(1, floor(m*0.5/10))<m),
cs AS (SELECT t.step, e.src, e.dst, e.w FROM steps t JOIN ao e ON ceil(e.rank/t.per)>t.step),
csym AS (SELECT step, src, dst, w FROM cs UNION ALL SELECT step, dst, src, w FROM cs),
cd(step, s, v, d) USING KEY (step, s, v) AS (SELECT t.step, s, s, 0::BIGINT FROM steps t, source
  UNION SELECT x.step, x.s, e.dst, min(x.d+e.w) FROM cd x JOIN csym e ON e.step=x.step AND e.src=x.v LEFT JOIN recurring.cd r ON r.step=x.step AND r.s=x.s AND r.v=e.dst
  WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.step, x.s, e.dst),
cl(step, node, comp) USING KEY (step, node) AS (SELECT t.step, node, node FROM steps t, nodes
  UNION SELECT l.step, e.dst, min(l.comp) FROM cl l JOIN csym e ON e.step=l.step AND e.src=l.node JOIN recurring.cl r ON r.step=l.step AND r.node=e.dst WHERE l.comp<r.comp GROUP BY l.step, e.dst),
ce AS (SELECT step, sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END)/(SELECT k*(n-1) FROM big) AS eff FROM cd GROUP BY step),
cg AS (SELECT step, max(size)/sum(size) AS giant FROM (SELECT step, comp, count(*) AS size FROM cl GROUP BY ALL) GROUP BY step)
"""
_CLOSE = """
cn AS (SELECT q.x, n.node FROM (SELECT DISTINCT node%10 AS x FROM nodes) q JOIN nodes n ON n.node%10<>q.x),
cy AS (SELECT q.x, e.src, e.dst, e.w FROM (SELECT DISTINCT node%10 AS x FROM nodes) q JOIN sym e ON e.src%10<>q.x AND e.dst%10<>q.x),
cu AS (SELECT x, node AS s FROM (SELECT *, row_number() OVER (PARTITION BY x ORDER BY ('0x'||substr(sha256('5|'||node),1,8))::BIGINT, node) AS rk FROM cn) WHERE rk<=64),
draws AS (SELECT i AS draw, floor(('0x'||substr(sha256('7|users|'||i||'|s'),1,8))::BIGINT/4294967296.0*(SELECT count(*) FROM nodes))::INT AS a, floor(('0x'||substr(sha256('7|users|'||i||'|t'),1,8))::BIGINT/4294967296.0*(SELECT count(*) FROM nodes))::INT AS b FROM (SELECT unnest(generate_series(0,59)) AS i)),
idx AS (SELECT node, row_number() OVER (ORDER BY node)-1 AS i FROM nodes),
routes AS (SELECT draw, p.node AS s, q.node AS t FROM draws JOIN idx p ON p.i=a JOIN idx q ON q.i=b WHERE a<>b),
rd(s, v, d) USING KEY (s, v) AS (SELECT DISTINCT s, s, 0::BIGINT FROM routes
  UNION SELECT x.s, e.dst, min(x.d+e.w) FROM rd x JOIN sym e ON e.src=x.v LEFT JOIN recurring.rd r ON r.s=x.s AND r.v=e.dst WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.s, e.dst),
starts AS (SELECT x, s FROM cu UNION SELECT cn.x, routes.s FROM cn JOIN routes ON routes.s=cn.node),
sd(x, s, v, d) USING KEY (x, s, v) AS (SELECT x, s, s, 0::BIGINT FROM starts
  UNION SELECT z.x, z.s, e.dst, min(z.d+e.w) FROM sd z JOIN cy e ON e.x=z.x AND e.src=z.v LEFT JOIN recurring.sd r ON r.x=z.x AND r.s=z.s AND r.v=e.dst WHERE r.d IS NULL OR z.d+e.w<r.d GROUP BY z.x, z.s, e.dst),
cc(x, node, comp) USING KEY (x, node) AS (SELECT x, node, node FROM cn
  UNION SELECT l.x, e.dst, min(l.comp) FROM cc l JOIN cy e ON e.x=l.x AND e.src=l.node JOIN recurring.cc r ON r.x=l.x AND r.node=e.dst WHERE l.comp<r.comp GROUP BY l.x, e.dst),
wc(node, comp) USING KEY (node) AS (SELECT node, node FROM nodes
  UNION SELECT e.dst, min(l.comp) FROM wc l JOIN sym e ON e.src=l.node JOIN recurring.wc r ON r.node=e.dst WHERE l.comp<r.comp GROUP BY e.dst),
base AS (SELECT sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END)/((SELECT count(*) FROM source)*((SELECT count(*) FROM nodes)-1)) AS eff FROM near),
se AS (SELECT sd.x, sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END) AS total FROM sd JOIN cu ON cu.x=sd.x AND cu.s=sd.s GROUP BY sd.x),
sk AS (SELECT x, (SELECT count(*) FROM cu c WHERE c.x=cn.x) AS k, count(*) AS n FROM cn GROUP BY x),
sg AS (SELECT x, count(*) AS zones, max(size)/sum(size) AS giant FROM (SELECT x, comp, count(*) AS size FROM cc GROUP BY ALL) GROUP BY x),
rt AS (SELECT q.x, avg(CASE WHEN rd.d>0 THEN (sd.d-rd.d)/rd.d*100 END) AS pct, count(*) FILTER (WHERE sd.d IS NULL) AS broken
  FROM (SELECT DISTINCT node%10 AS x FROM nodes) q CROSS JOIN routes JOIN rd ON rd.s=routes.s AND rd.v=routes.t LEFT JOIN sd ON sd.x=q.x AND sd.s=routes.s AND sd.v=routes.t GROUP BY q.x)
"""


def _sql(*more: str) -> str:
    return "WITH RECURSIVE " + ",".join([USER_SQL, *more])


def _all_sql(*more: str) -> str:
    """As ``_sql``, with all users as sources."""
    return "WITH RECURSIVE " + ",".join([ALL_USER_SQL, *more])


ORACLE_SQL = {
    "user_edges": _sql() + "SELECT edge_id, src, dst, w FROM edges",
    "user_paths": _sql(_FROM) + "SELECT s, v, d AS dist FROM near",
    "user_efficiency": _sql(_FROM) + "SELECT (SELECT count(*) FROM nodes) AS n, round(sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END)/((SELECT count(*) FROM source)*((SELECT count(*) FROM nodes)-1)),9) AS efficiency FROM near",
    "user_node_betweenness": _all_sql(_PASS) + "SELECT node, round(betweenness,9) AS betweenness FROM nb",
    "user_edge_betweenness": _sql(_PASS) + "SELECT src, dst, round(raw,9) AS betweenness FROM eb",
    "user_bridges": _sql(CUT_SQL) + "SELECT src, dst FROM edges WHERE edge_id IN (SELECT edge_id FROM bridge)",
    "user_articulation_points": _sql(CUT_SQL) + "SELECT node FROM joint",
    "user_curve": _all_sql(_PASS, _CURVE) + "SELECT t.step::INT AS step, round_even(t.step*per/m,3) AS removed_fraction, round_even(round(eff/(SELECT eff FROM ce WHERE step=0),9),3) AS efficiency, CASE WHEN t.step=0 THEN round(giant,9) ELSE round_even(giant,3) END AS giant FROM steps t JOIN ce ON ce.step=t.step JOIN cg ON cg.step=t.step",
    "user_closures": _sql(_FROM, _CLOSE) + "SELECT 'c'||sk.x AS scenario_id, round_even(round(100*(0.6*least(total/(k*(n-1))/(SELECT eff FROM base),1.0)+0.4*giant),9),0)::INT AS resilience_index_after, round_even(round(coalesce(pct,0.0),9),1) AS time_increase_pct, greatest(0,zones-(SELECT count(DISTINCT comp) FROM wc))::INT AS newly_disconnected_zones, broken::INT AS broken_routes, 60::INT AS sampled_routes FROM sk JOIN se USING (x) JOIN sg USING (x) JOIN rt USING (x)",
}
