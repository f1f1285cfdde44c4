"""Criticality of edges, betweenness of nodes, bridges and articulation points of networks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.operators.centrality import betweenness
from viaduct.operators.cuts import articulation_points, blocks, bridges
from viaduct.operators.paths import all_pairs
from viaduct.session import stored


def max_normalised(df: DataFrame, value: str, name: str, digits: int = 4) -> DataFrame:
    """``df`` with a value over the largest of its graph as ``name``; 0 where that is 0."""
    top = df.groupBy("graph_id").agg(F.max(value).alias("_top"))  # one row a graph
    share = F.when(F.col("_top") > 0, F.bround(F.col(value) / F.col("_top"), digits)).otherwise(0.0)
    return df.join(top, "graph_id").withColumn(name, share).drop("_top")


def scored_network(nodes: DataFrame, edges: DataFrame, weight: str = "w", most_sources: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes with ``betweenness`` (of 1 at most); edges with ``raw`` and ``criticality``.

    Paths start at all nodes, or at ``most_sources`` sampled ones of each graph.
    """
    of_nodes, of_edges = betweenness(nodes, edges, None if most_sources is None else all_pairs(nodes, edges, weight, most_sources), weight)
    marked = nodes.join(max_normalised(of_nodes, "betweenness", "betweenness"), ["graph_id", "node"])
    scored = max_normalised(of_edges.withColumnRenamed("betweenness", "raw"), "raw", "criticality").select("graph_id", F.col("src").alias("a"), F.col("dst").alias("b"), "raw", "criticality")
    keyed = edges.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    return stored(marked, "nodes"), stored(keyed.join(scored, ["graph_id", "a", "b"], "left").drop("a", "b"), "edges")


def annotate_network(nodes: DataFrame, edges: DataFrame, weight: str = "w", most_sources: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``scored_network`` with ``is_articulation`` of nodes and ``is_bridge`` of edges."""
    marked, scored = scored_network(nodes, edges, weight, most_sources)
    cuts = blocks(edges)
    points = articulation_points(edges, cuts).withColumn("is_articulation", F.lit(True))
    marked = marked.join(points, ["graph_id", "node"], "left").withColumn("is_articulation", F.coalesce("is_articulation", F.lit(False)))
    alone = bridges(edges, cuts).withColumn("is_bridge", F.lit(True)).toDF("graph_id", "a", "b", "is_bridge")
    keyed = scored.withColumn("a", F.least("src", "dst")).withColumn("b", F.greatest("src", "dst"))
    done = keyed.join(alone, ["graph_id", "a", "b"], "left").withColumn("is_bridge", F.coalesce("is_bridge", F.lit(False)))
    return stored(marked, "nodes"), stored(done.drop("a", "b"), "edges")


def gatekeepers(nodes: DataFrame, top_k: int = 8) -> DataFrame:
    """The ``top_k`` nodes of each graph by betweenness, ties by node, labelled GK-1, GK-2, ..."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("betweenness"), "node"))
    ranked = nodes.withColumn("rank", rank).filter(F.col("rank") <= top_k)
    return ranked.select("graph_id", "node", "lat", "lng", "betweenness", "is_articulation", F.concat(F.lit("GK-"), "rank").alias("label"))


def top_edges(edges: DataFrame, top_k: int = 8) -> DataFrame:
    """The ``top_k`` edges of each graph by criticality, ties by id."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(F.desc("criticality"), "edge_id"))
    return edges.withColumn("rank", rank).filter(F.col("rank") <= top_k)


def criticality_histogram(edges: DataFrame, bins: int = 5) -> DataFrame:
    """(graph_id, bin, edges) in equal bins over [0, 1]; empty bins are kept."""
    own = edges.withColumn("bin", F.floor(F.least(F.col("criticality"), F.lit(0.999999)) * bins).cast("int"))
    count = own.groupBy("graph_id", "bin").agg(F.count(F.lit(1)).alias("n"))
    every = edges.select("graph_id").distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return every.join(count, ["graph_id", "bin"], "left").select("graph_id", "bin", F.coalesce("n", F.lit(0)).cast("long").alias("edges"))
