"""Queries over road networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.operators import annotate, cuts, healing, resilience, spatial
from viaduct.operators.apls import apls as path_similarity
from viaduct.operators.centrality import betweenness
from viaduct.operators.components import connected_components
from viaduct.operators.paths import all_pairs, global_efficiency
from viaduct.operators.sampling import sample_pairs, sample_rows
from viaduct.plans.derived import GRID_SQL, TRADE_SQL, _hav, customer_grid, trade_network
from viaduct.session import stored

# Path CTEs over ``sym``: distances, tight edges, path counts and the two betweenness values by their definition.
DIST_SQL = """
dist(s, v, d) USING KEY (s, v) AS (SELECT node, node, 0::BIGINT FROM nodes
  UNION SELECT x.s, e.dst, min(x.d+e.w) FROM dist x JOIN sym e ON e.src=x.v LEFT JOIN recurring.dist r ON r.s=x.s AND r.v=e.dst
  WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.s, e.dst)
"""
FLOW_SQL = f"""
{DIST_SQL},
tight AS (SELECT a.s, e.src, e.dst FROM dist a JOIN sym e ON e.src=a.v JOIN dist b ON b.s=a.s AND b.v=e.dst AND b.d=a.d+e.w),
walks(s, v, hop, p) AS (SELECT node, node, 0, 1.0::DOUBLE FROM nodes UNION ALL SELECT x.s, t.dst, x.hop+1, sum(x.p) FROM walks x JOIN tight t ON t.s=x.s AND t.src=x.v GROUP BY x.s, t.dst, x.hop+1),
sigma AS (SELECT s, v, sum(p) AS p FROM walks GROUP BY ALL),
big AS (SELECT count(*)::DOUBLE AS n FROM nodes),
nb AS (SELECT n.node, coalesce(sum(x.p*y.p/z.p),0)/((SELECT n FROM big)-1)/((SELECT n FROM big)-2) AS betweenness
  FROM nodes n LEFT JOIN (dist a JOIN sigma x ON x.s=a.s AND x.v=a.v JOIN dist b ON b.s=a.v JOIN sigma y ON y.s=b.s AND y.v=b.v
    JOIN dist c ON c.s=a.s AND c.v=b.v AND c.d=a.d+b.d JOIN sigma z ON z.s=c.s AND z.v=c.v) ON a.v=n.node AND a.s<>n.node AND b.v<>n.node AND a.s<>b.v
  GROUP BY n.node),
eb AS (SELECT e.graph_id, e.edge_id, e.src, e.dst, coalesce((SELECT sum(x.p*y.p/z.p) FROM dist a JOIN sigma x ON x.s=a.s AND x.v=a.v, dist b JOIN sigma y ON y.s=b.s AND y.v=b.v, dist c JOIN sigma z ON z.s=c.s AND z.v=c.v
    WHERE c.s=a.s AND c.v=b.v AND c.d=a.d+e.w+b.d AND ((a.v=e.src AND b.s=e.dst) OR (a.v=e.dst AND b.s=e.src))),0)/(SELECT n*(n-1) FROM big) AS raw FROM edges e),
eb2 AS (SELECT *, CASE WHEN max(raw) OVER ()>0 THEN round_even(round(raw/max(raw) OVER (),9),4) ELSE 0 END AS criticality FROM eb),
nb2 AS (SELECT node, CASE WHEN max(betweenness) OVER ()>0 THEN round_even(round(betweenness/max(betweenness) OVER (),9),4) ELSE 0 END AS betweenness FROM nb)
"""
CUT_SQL = """
cut(gone, node, comp) USING KEY (gone, node) AS (SELECT g.edge_id, n.node, n.node FROM edges g, nodes n
  UNION SELECT l.gone, e.dst, min(l.comp) FROM cut l JOIN sym e ON l.node=e.src AND e.edge_id<>l.gone JOIN recurring.cut r ON r.gone=l.gone AND r.node=e.dst WHERE l.comp<r.comp GROUP BY l.gone, e.dst),
off(gone, node, comp) USING KEY (gone, node) AS (SELECT g.node, n.node, n.node FROM nodes g, nodes n WHERE g.node<>n.node
  UNION SELECT l.gone, e.dst, min(l.comp) FROM off l JOIN sym e ON l.node=e.src AND e.dst<>l.gone JOIN recurring.off r ON r.gone=l.gone AND r.node=e.dst WHERE l.comp<r.comp GROUP BY l.gone, e.dst),
whole(node, comp) USING KEY (node) AS (SELECT node, node FROM nodes
  UNION SELECT e.dst, min(l.comp) FROM whole l JOIN sym e ON l.node=e.src JOIN recurring.whole r ON r.node=e.dst WHERE l.comp<r.comp GROUP BY e.dst),
parts AS (SELECT count(DISTINCT comp) AS k FROM whole),
bridge AS (SELECT gone AS edge_id FROM cut GROUP BY gone HAVING count(DISTINCT comp)>(SELECT k FROM parts)),
lone AS (SELECT node FROM whole WHERE node NOT IN (SELECT src FROM sym)),
joint AS (SELECT gone AS node FROM off GROUP BY gone HAVING count(DISTINCT comp)>(SELECT k FROM parts)-(CASE WHEN gone IN (SELECT node FROM lone) THEN 1 ELSE 0 END))
"""


def _trade_sql(*more: str) -> str:
    return "WITH RECURSIVE " + ",".join([TRADE_SQL, *more])


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trade_network(spark, sf_dir)[1]


def network_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of nodes and edges of both networks."""
    parts = []
    for build in (trade_network, customer_grid):
        nodes, edges = build(spark, sf_dir)
        counted = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("nodes"))
        parts.append(counted.join(edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges")), "graph_id", "left").fillna(0))
    return parts[0].unionByName(parts[1])


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = customer_grid(spark, sf_dir)
    return connected_components(edges, nodes).select("node", "comp")


def connectivity_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = customer_grid(spark, sf_dir)
    found = resilience.connectivity(nodes, connected_components(edges, nodes))
    return found.select("n", "components", F.round("giant", 9).alias("giant"))


def largest_component(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes of the largest component, ties to the least."""
    nodes, edges = customer_grid(spark, sf_dir)
    comps = stored(connected_components(edges, nodes), "comps")
    best = comps.groupBy("graph_id", "comp").agg(F.count(F.lit(1)).alias("size")).groupBy("graph_id").agg(F.max_by("comp", F.struct("size", -F.col("comp"))).alias("comp"))
    return comps.join(best, ["graph_id", "comp"]).select("node")


def degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = customer_grid(spark, sf_dir)
    return spatial.degrees(nodes, edges).select("node", "degree")


def endpoint_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = customer_grid(spark, sf_dir)
    return healing.endpoint_pairs(nodes, edges, 160.0).select("a", "b", F.round("dist_m", 4).alias("dist_m"))


def nearest_snap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each even node of the grid, shifted, snapped to the odd nodes."""
    nodes, _ = customer_grid(spark, sf_dir)
    moved = nodes.filter("node % 2 = 0").select("graph_id", "node", (F.col("lat") + 0.0003).alias("lat"), (F.col("lng") + 0.0002).alias("lng"))
    return spatial.nearest_snap(moved, nodes.filter("node % 2 = 1"), 100.0).select("node", "snapped", F.round("dist_m", 4).alias("dist_m"))


def heal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that healing adds to the grid."""
    nodes, edges = customer_grid(spark, sf_dir)
    return healing.heal_network(nodes, edges, 160.0).filter("healed").select("edge_id", "src", "dst", "length_m", "travel_time")


def shortest_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_pairs(*trade_network(spark, sf_dir)).select("s", "v", "dist")


def efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_network(spark, sf_dir)
    return global_efficiency(nodes, all_pairs(nodes, edges)).select("n", F.round("efficiency", 9).alias("efficiency"))


def _views(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two views: the whole network, and one without 30 % of its local and two of its arterial roads."""
    nodes, edges = trade_network(spark, sf_dir)
    local = sample_rows(edges.filter("road_class = 'local'"), ["graph_id"], "edge_id", 0.3, 13)
    main = sample_rows(edges.filter("road_class = 'arterial'"), ["graph_id"], "edge_id", 2, 13)
    left = edges.join(local.unionByName(main).select("edge_id"), "edge_id", "left_anti")
    label = [df.withColumn("graph_id", F.lit(v)) for df, v in ((nodes, "intact"), (nodes, "fragmented"), (edges, "intact"), (left, "fragmented"))]
    return stored(label[0].unionByName(label[1]), "nodes"), stored(label[2].unionByName(label[3]), "edges")


_UNIT = "('0x'||substr(sha256('13|'||edge_id),1,8))::BIGINT/4294967296.0"
VIEW_SQL = f"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY road_class ORDER BY {_UNIT}, edge_id) AS rk, count(*) OVER (PARTITION BY road_class) AS total FROM edges),
vedges AS (SELECT 'intact' AS view, * FROM edges UNION ALL SELECT 'fragmented', * EXCLUDE (rk, total) FROM ranked WHERE rk > CASE WHEN road_class='local' THEN floor(total*0.3::DOUBLE) ELSE 2 END),
vsym AS (SELECT view, src, dst, w FROM vedges UNION ALL SELECT view, dst, src, w FROM vedges),
vnodes AS (SELECT v.view, n.node FROM nodes n, (VALUES ('intact'), ('fragmented')) v(view)),
vdist(view, s, v, d) USING KEY (view, s, v) AS (SELECT view, node, node, 0::BIGINT FROM vnodes
  UNION SELECT x.view, x.s, e.dst, min(x.d+e.w) FROM vdist x JOIN vsym e ON e.view=x.view AND e.src=x.v LEFT JOIN recurring.vdist r ON r.view=x.view AND r.s=x.s AND r.v=e.dst
  WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.view, x.s, e.dst),
vcomp AS (SELECT view, s AS node, min(v) AS comp FROM vdist GROUP BY ALL),
vsize AS (SELECT view, comp, count(*) AS size FROM vcomp GROUP BY ALL),
vstate AS (SELECT view, n, efficiency, components, giant FROM (SELECT view, count(*) AS components, max(size)/sum(size) AS giant, sum(size) AS n FROM vsize GROUP BY view)
  JOIN (SELECT view AS v2, sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END)/(SELECT count(*)*(count(*)-1) FROM nodes) AS efficiency FROM vdist GROUP BY view) ON v2=view),
vindex AS (SELECT *, round_even(round(100*(0.6*least(efficiency/(SELECT efficiency FROM vstate WHERE view='intact'),1.0)+0.4*giant),9),0)::INT AS resilience_index FROM vstate)
"""


def _state(spark: SparkSession, sf_dir: str):
    nodes, edges = _views(spark, sf_dir)
    state = resilience.graph_state(nodes, edges)
    base = state.filter("graph_id = 'intact'").select(F.col("efficiency").alias("base_efficiency"))
    base = stored(state.select("graph_id").crossJoin(F.broadcast(base)), "base")  # one row
    return nodes, edges, state, base


def resilience_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, state, base = _state(spark, sf_dir)
    found = resilience.resilience_index(state, base)
    return found.select(F.col("graph_id").alias("view"), F.round("efficiency", 9).alias("efficiency"), "components", F.round("giant", 9).alias("giant"), "resilience_index")


def view_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The links that the fragmented view lost."""
    _, edges = _views(spark, sf_dir)
    return edges.filter("graph_id = 'intact'").select("edge_id", "road_class").exceptAll(edges.filter("graph_id = 'fragmented'").select("edge_id", "road_class"))


def fragment(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges = _views(spark, sf_dir)
    return edges.filter("graph_id = 'fragmented'").select("edge_id", "src", "dst", "road_class", "w")


def health(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, state, _ = _state(spark, sf_dir)
    return state.filter("graph_id = 'intact'").select(F.lit("trade").alias("source"), F.bround(F.round("efficiency", 9), 6).alias("base_efficiency"))


def node_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_network(spark, sf_dir)
    return betweenness(nodes, edges, all_pairs(nodes, edges))[0].select("node", F.round("betweenness", 9).alias("betweenness"))


def edge_betweenness(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = trade_network(spark, sf_dir)
    return betweenness(nodes, edges, all_pairs(nodes, edges))[1].select("src", "dst", F.round("betweenness", 9).alias("betweenness"))


def _annotated(spark: SparkSession, sf_dir: str):
    return annotate.annotate_network(*trade_network(spark, sf_dir))


def _scored(spark: SparkSession, sf_dir: str):
    return annotate.scored_network(*trade_network(spark, sf_dir))


def annotate_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _annotated(spark, sf_dir)[1].select("edge_id", "src", "dst", "length_m", "travel_time", "road_class", "criticality", "is_bridge")


def gatekeepers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.gatekeepers(_annotated(spark, sf_dir)[0]).drop("graph_id")


def top_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.top_edges(_scored(spark, sf_dir)[1]).select("edge_id", "criticality", "rank")


def criticality_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return annotate.criticality_histogram(_scored(spark, sf_dir)[1]).select("bin", "edges")


def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.bridges(trade_network(spark, sf_dir)[1]).select("src", "dst")


def articulation_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuts.articulation_points(trade_network(spark, sf_dir)[1]).select("node")


def attack_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _scored(spark, sf_dir)[1].withColumn("raw", F.round("raw", 9))
    return resilience.attack_order(edges).select("edge_id", "rank")


def resilience_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _scored(spark, sf_dir)
    edges = edges.withColumn("raw", F.round("raw", 9))
    base = resilience.graph_state(nodes, edges).select("graph_id", F.col("efficiency").alias("base_efficiency"))
    found = resilience.resilience_curve(nodes, edges, stored(base, "base"))
    return found.select("step", "removed_fraction", "efficiency", F.round("giant", 9).alias("giant"))


CURVE_SQL = """
ao AS (SELECT *, row_number() OVER (ORDER BY round(raw,9) DESC, edge_id) AS rank, count(*) OVER () AS m FROM eb2),
steps AS (SELECT s.step, greatest(1, floor(m*0.5/10)) AS per, m FROM (SELECT unnest(generate_series(0,10)) AS step) s, (SELECT DISTINCT m FROM ao) WHERE s.step=0 OR (s.step-1)*greatest(1, floor(m*0.5/10))<m),
cs AS (SELECT t.step, e.src, e.dst, x.w FROM steps t JOIN ao e ON ceil(e.rank/t.per)>t.step JOIN edges x ON x.edge_id=e.edge_id),
csym AS (SELECT step, src, dst, w FROM cs UNION ALL SELECT step, dst, src, w FROM cs),
cd(step, s, v, d) USING KEY (step, s, v) AS (SELECT t.step, n.node, n.node, 0::BIGINT FROM steps t, nodes n
  UNION SELECT x.step, x.s, e.dst, min(x.d+e.w) FROM cd x JOIN csym e ON e.step=x.step AND e.src=x.v LEFT JOIN recurring.cd r ON r.step=x.step AND r.s=x.s AND r.v=e.dst
  WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.step, x.s, e.dst),
ce AS (SELECT step, sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END)/(SELECT count(*)*(count(*)-1) FROM nodes) AS eff FROM cd GROUP BY step),
cg AS (SELECT step, max(size)/sum(size) AS giant FROM (SELECT step, comp, count(*) AS size FROM (SELECT step, s, min(v) AS comp FROM cd GROUP BY ALL) GROUP BY ALL) GROUP BY step)
"""


def _scenarios(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One scenario for each node, closing it, and one for each edge."""
    by_node = nodes.select(F.concat(F.lit("n"), "node").alias("scenario_id"), "graph_id", F.lit("node").alias("kind"), F.col("node").cast("string").alias("id"))
    by_edge = edges.select(F.col("edge_id").alias("scenario_id"), "graph_id", F.lit("edge").alias("kind"), F.col("edge_id").alias("id"))
    return stored(by_node.union(by_edge), "scenarios")


def simulate_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All single closures of the trade network in one batch."""
    nodes, edges = trade_network(spark, sf_dir)
    base = stored(resilience.graph_state(nodes, edges).select("graph_id", F.col("efficiency").alias("base_efficiency")), "base")
    return resilience.simulate_removal(nodes, edges, _scenarios(nodes, edges), base).drop("graph_id")


SIMULATE_SQL = """
sc AS (SELECT 'n'||node AS id, node AS off, NULL::VARCHAR AS cut FROM nodes UNION ALL SELECT edge_id, NULL::BIGINT, edge_id FROM edges),
sn AS (SELECT sc.id, n.node FROM sc, nodes n WHERE sc.off IS NULL OR n.node<>sc.off),
ss AS (SELECT sc.id, e.src, e.dst, e.w FROM sc, sym e WHERE (sc.cut IS NULL OR e.edge_id<>sc.cut) AND (sc.off IS NULL OR (e.src<>sc.off AND e.dst<>sc.off))),
sd(id, s, v, d) USING KEY (id, s, v) AS (SELECT id, node, node, 0::BIGINT FROM sn
  UNION SELECT x.id, x.s, e.dst, min(x.d+e.w) FROM sd x JOIN ss e ON e.id=x.id AND e.src=x.v LEFT JOIN recurring.sd r ON r.id=x.id AND r.s=x.s AND r.v=e.dst
  WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.id, x.s, e.dst),
base AS (SELECT sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END)/(SELECT count(*)*(count(*)-1) FROM nodes) AS eff FROM dist),
zones AS (SELECT count(DISTINCT comp) AS k FROM (SELECT s, min(v) AS comp FROM dist GROUP BY s)),
cnt AS (SELECT count(*) AS n FROM nodes),
draws AS (SELECT i AS draw, floor(('0x'||substr(sha256('7|trade|'||i||'|s'),1,8))::BIGINT/4294967296.0*(SELECT n FROM cnt))::INT AS a, floor(('0x'||substr(sha256('7|trade|'||i||'|t'),1,8))::BIGINT/4294967296.0*(SELECT n FROM cnt))::INT AS b
  FROM (SELECT unnest(generate_series(0,59)) AS i)),
idx AS (SELECT node, row_number() OVER (ORDER BY node)-1 AS i FROM nodes),
routes AS (SELECT draw, x.node AS s, y.node AS t, d AS old FROM draws JOIN idx x ON x.i=a JOIN idx y ON y.i=b JOIN dist ON dist.s=x.node AND dist.v=y.node WHERE a<>b),
rt AS (SELECT sc.id, avg(CASE WHEN old>0 THEN (d-old)/old*100 END) AS pct, count(*) FILTER (WHERE d IS NULL) AS broken FROM sc CROSS JOIN routes LEFT JOIN sd ON sd.id=sc.id AND sd.s=routes.s AND sd.v=routes.t GROUP BY sc.id),
ne AS (SELECT id, count(*) AS n FROM sn GROUP BY id),
se AS (SELECT id, sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END) AS total FROM sd GROUP BY id),
sg AS (SELECT id, count(*) AS k, max(size)/sum(size) AS giant FROM (SELECT id, comp, count(*) AS size FROM (SELECT id, s, min(v) AS comp FROM sd GROUP BY ALL) GROUP BY ALL) GROUP BY id)
"""


def impact_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, edges = _scored(spark, sf_dir)
    ends = edges.select("graph_id", F.col("edge_id").alias("id"), F.explode(F.array("src", "dst")).alias("node"))
    by_node = ends.select(F.concat(F.lit("n"), "node").alias("scenario_id"), "graph_id", F.lit("edge").alias("kind"), "id")
    index = nodes.select("graph_id").distinct().withColumn("resilience_index", F.lit(100))
    return resilience.impact_estimate(edges, by_node, index)


def apls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fragmented view against the whole network, by lengths."""
    nodes, edges = _views(spark, sf_dir)
    edges = edges.withColumn("mm", F.round(F.col("length_m") * 1000).cast("long"))
    one = [df.filter(f"graph_id = '{v}'").withColumn("graph_id", F.lit("trade")) for v in ("intact", "fragmented") for df in (nodes, edges)]
    return path_similarity(*[stored(x, "apls") for x in one], pairs=100).select("graph_id", F.round("apls", 9).alias("apls"))


def sampled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes, _ = trade_network(spark, sf_dir)
    return sample_pairs(nodes, 60, 7).select("draw", "s", "t")


APLS_SQL = """
asym AS (SELECT view, src, dst, round(length_m*1000)::BIGINT AS w FROM vedges UNION ALL SELECT view, dst, src, round(length_m*1000)::BIGINT FROM vedges),
ad(view, s, v, d) USING KEY (view, s, v) AS (SELECT view, node, node, 0::BIGINT FROM vnodes
  UNION SELECT x.view, x.s, e.dst, min(x.d+e.w) FROM ad x JOIN asym e ON e.view=x.view AND e.src=x.v LEFT JOIN recurring.ad r ON r.view=x.view AND r.s=x.s AND r.v=e.dst
  WHERE r.d IS NULL OR x.d+e.w<r.d GROUP BY x.view, x.s, e.dst),
ix AS (SELECT node, row_number() OVER (ORDER BY node)-1 AS i FROM nodes),
dr AS (SELECT i AS draw, floor(('0x'||substr(sha256('0|trade|'||i||'|s'),1,8))::BIGINT/4294967296.0*(SELECT count(*) FROM nodes))::BIGINT AS a, floor(('0x'||substr(sha256('0|trade|'||i||'|t'),1,8))::BIGINT/4294967296.0*(SELECT count(*) FROM nodes))::BIGINT AS b FROM (SELECT unnest(generate_series(0,399)) AS i)),
pq AS (SELECT least(p.node,q.node) AS s, greatest(p.node,q.node) AS t, min(draw) AS draw FROM dr JOIN ix p ON p.i=a JOIN ix q ON q.i=b WHERE a<>b GROUP BY ALL),
pk AS (SELECT s, t FROM (SELECT *, row_number() OVER (ORDER BY draw) AS rk FROM pq) WHERE rk<=100),
sc AS (SELECT w.view, avg(CASE WHEN h.d IS NULL THEN 0.0 WHEN w.d<=0 THEN 1.0 ELSE greatest(0.0,1-abs(h.d-w.d)/w.d) END) AS score FROM pk JOIN ad w ON w.s=pk.s AND w.v=pk.t LEFT JOIN ad h ON h.view<>w.view AND h.s=pk.s AND h.v=pk.t GROUP BY w.view)
"""


QUERIES = {
    "trade_edges": trade_edges, "network_meta": network_meta, "components": components, "connectivity_ratio": connectivity_ratio,
    "largest_component": largest_component, "degree": degree, "endpoint_pairs": endpoint_pairs, "nearest_snap": nearest_snap, "heal": heal,
    "shortest_paths": shortest_paths, "global_efficiency": efficiency, "resilience_index": resilience_index,
    "view_diff": view_diff, "fragment": fragment, "health": health, "node_betweenness": node_betweenness,
    "edge_betweenness": edge_betweenness, "annotate_network": annotate_network, "gatekeepers": gatekeepers, "top_edges": top_edges,
    "criticality_histogram": criticality_histogram, "bridges": bridges, "articulation_points": articulation_points, "attack_order": attack_order,
    "resilience_curve": resilience_curve, "simulate_removal": simulate_removal, "impact_estimate": impact_estimate, "apls": apls, "sampled_pairs": sampled_pairs,
}

_GRID = f"WITH RECURSIVE {GRID_SQL}"
_DEG = "deg AS (SELECT node, (SELECT count(*) FROM sym WHERE sym.src=nodes.node) AS degree, lat, lng FROM nodes)"
_NEAR = f"near AS (SELECT x.node AS a, y.node AS b, round({_hav('x.lat', 'x.lng', 'y.lat', 'y.lng')},6) AS dist_m FROM deg x JOIN deg y ON x.node<y.node AND abs(x.lat-y.lat)<0.002 WHERE x.degree<=1 AND y.degree<=1)"
ORACLE_SQL = {
    "trade_edges": _trade_sql() + "SELECT * FROM edges",
    "network_meta": f"WITH RECURSIVE {TRADE_SQL} SELECT 'trade' AS graph_id, (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges UNION ALL SELECT * FROM ({_GRID} SELECT 'grid', (SELECT count(*) FROM nodes), (SELECT count(*) FROM edges))",
    "components": _GRID + "SELECT node, comp FROM lab",
    "connectivity_ratio": _GRID + "SELECT sum(size)::BIGINT AS n, count(*) AS components, round(max(size)/sum(size),9) AS giant FROM (SELECT comp, count(*) AS size FROM lab GROUP BY comp)",
    "largest_component": _GRID + "SELECT node FROM lab WHERE comp=(SELECT comp FROM lab GROUP BY comp ORDER BY count(*) DESC, comp LIMIT 1)",
    "degree": _GRID + f", {_DEG} SELECT node, degree FROM deg",
    "endpoint_pairs": _GRID + f", {_DEG}, {_NEAR} SELECT a, b, round(dist_m,4) AS dist_m FROM near WHERE dist_m<=160",
    "nearest_snap": _GRID + f", q AS (SELECT node, lat+0.0003::DOUBLE AS lat, lng+0.0002::DOUBLE AS lng FROM nodes WHERE node%2=0), n2 AS (SELECT q.node, t.node AS b, round({_hav('q.lat', 'q.lng', 't.lat', 't.lng')},6) AS d FROM q JOIN nodes t ON t.node%2=1 AND abs(q.lat-t.lat)<0.002), n3 AS (SELECT node, arg_min(b, (d, b)) AS snapped, min(d) AS d FROM n2 WHERE d<=100 GROUP BY node) SELECT q.node, snapped, round(d,4) AS dist_m FROM q LEFT JOIN n3 ON n3.node=q.node",
    "heal": _GRID + f""", {_DEG}, {_NEAR}, cand AS (SELECT a, b, dist_m, x.comp AS ca, y.comp AS cb, row_number() OVER (ORDER BY dist_m, a, b) AS k FROM near JOIN lab x ON x.node=a JOIN lab y ON y.node=b WHERE dist_m<=160 AND x.comp<>y.comp),
reach(k, comp) AS (SELECT k, ca FROM cand UNION SELECT r.k, CASE WHEN c.ca=r.comp THEN c.cb ELSE c.ca END FROM reach r JOIN cand c ON c.k<r.k AND (c.ca=r.comp OR c.cb=r.comp)),
won AS (SELECT * FROM cand c WHERE NOT EXISTS (SELECT 1 FROM reach r WHERE r.k=c.k AND r.comp=c.cb))
SELECT 'heal-'||a||'-'||b AS edge_id, a AS src, b AS dst, round_even(dist_m,1) AS length_m, round_even(round_even(dist_m,1)/(30.0*1000/3600),1) AS travel_time FROM won""",
    "shortest_paths": _trade_sql(DIST_SQL) + "SELECT s, v, d AS dist FROM dist",
    "global_efficiency": _trade_sql(DIST_SQL) + "SELECT (SELECT count(*) FROM nodes) AS n, round(sum(CASE WHEN d>0 THEN 10.0/d ELSE 0 END)/(SELECT count(*)*(count(*)-1) FROM nodes),9) AS efficiency FROM dist",
    "resilience_index": _trade_sql(VIEW_SQL) + "SELECT view, round(efficiency,9) AS efficiency, components, round(giant,9) AS giant, resilience_index FROM vindex",
    "view_diff": _trade_sql(VIEW_SQL) + "SELECT edge_id, road_class FROM vedges WHERE view='intact' AND edge_id NOT IN (SELECT edge_id FROM vedges WHERE view='fragmented')",
    "fragment": _trade_sql(VIEW_SQL) + "SELECT edge_id, src, dst, road_class, w FROM vedges WHERE view='fragmented'",
    "health": _trade_sql(VIEW_SQL) + "SELECT 'trade' AS source, round_even(round(efficiency,9),6) AS base_efficiency FROM vstate WHERE view='intact'",
    "node_betweenness": _trade_sql(FLOW_SQL) + "SELECT node, round(betweenness,9) AS betweenness FROM nb",
    "edge_betweenness": _trade_sql(FLOW_SQL) + "SELECT src, dst, round(raw,9) AS betweenness FROM eb",
    "annotate_network": _trade_sql(FLOW_SQL, CUT_SQL) + "SELECT e.edge_id, e.src, e.dst, e.length_m, e.travel_time, e.road_class, x.criticality, e.edge_id IN (SELECT edge_id FROM bridge) AS is_bridge FROM edges e JOIN eb2 x ON x.edge_id=e.edge_id",
    "gatekeepers": _trade_sql(FLOW_SQL, CUT_SQL) + "SELECT node, lat, lng, betweenness, node IN (SELECT node FROM joint) AS is_articulation, 'GK-'||rk AS label FROM (SELECT n.node, n.lat, n.lng, b.betweenness, row_number() OVER (ORDER BY b.betweenness DESC, n.node) AS rk FROM nodes n JOIN nb2 b ON b.node=n.node) WHERE rk<=8",
    "top_edges": _trade_sql(FLOW_SQL) + "SELECT edge_id, criticality, rank::INT AS rank FROM (SELECT edge_id, criticality, row_number() OVER (ORDER BY criticality DESC, edge_id) AS rank FROM eb2) WHERE rank<=8",
    "criticality_histogram": _trade_sql(FLOW_SQL) + "SELECT b.bin::INT AS bin, count(e.edge_id) AS edges FROM (SELECT unnest(generate_series(0,4)) AS bin) b LEFT JOIN eb2 e ON floor(least(e.criticality,0.999999)*5)=b.bin GROUP BY b.bin",
    "bridges": _trade_sql(CUT_SQL) + "SELECT src, dst FROM edges WHERE edge_id IN (SELECT edge_id FROM bridge)",
    "articulation_points": _trade_sql(CUT_SQL) + "SELECT node FROM joint",
    "attack_order": _trade_sql(FLOW_SQL, CURVE_SQL) + "SELECT edge_id, rank::INT AS rank FROM ao",
    "resilience_curve": _trade_sql(FLOW_SQL, CURVE_SQL) + "SELECT t.step::INT AS step, round_even(t.step*per/m,3) AS removed_fraction, round_even(round(eff/(SELECT eff FROM ce WHERE step=0),9),3) AS efficiency, CASE WHEN t.step=0 THEN round(giant,9) ELSE round_even(giant,3) END AS giant FROM steps t JOIN ce ON ce.step=t.step JOIN cg ON cg.step=t.step",
    "simulate_removal": _trade_sql(DIST_SQL, SIMULATE_SQL) + "SELECT sc.id AS scenario_id, round_even(round(100*(0.6*least(total/(n*(n-1))/(SELECT eff FROM base),1.0)+0.4*giant),9),0)::INT AS resilience_index_after, round_even(round(coalesce(pct,0.0),9),1) AS time_increase_pct, greatest(0,k-(SELECT k FROM zones))::INT AS newly_disconnected_zones, broken::INT AS broken_routes, 60::INT AS sampled_routes FROM sc JOIN ne USING (id) JOIN se USING (id) JOIN sg USING (id) JOIN rt USING (id)",
    "impact_estimate": _trade_sql(FLOW_SQL) + "SELECT scenario_id, greatest(8, round(100-22*total,0))::INT AS index_after, round(14*total,1) AS time_pct, least(5, floor(1.8*total))::INT AS zones, round(6*total,0)::INT AS broken, 50::INT AS sampled FROM (SELECT 'n'||node AS scenario_id, round(sum(criticality),9) AS total FROM (SELECT src AS node, criticality FROM eb2 UNION ALL SELECT dst, criticality FROM eb2) GROUP BY node)",
    "apls": _trade_sql(VIEW_SQL, APLS_SQL) + "SELECT 'trade' AS graph_id, round((coalesce((SELECT score FROM sc WHERE view='intact'),0)+coalesce((SELECT score FROM sc WHERE view='fragmented'),0))/2,9) AS apls",
    "sampled_pairs": _trade_sql(DIST_SQL, SIMULATE_SQL) + "SELECT draw::INT AS draw, x.node AS s, y.node AS t FROM draws JOIN idx x ON x.i=a JOIN idx y ON y.i=b WHERE a<>b",
}
