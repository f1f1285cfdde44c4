"""Report tables behind a dashboard: critical edges, curves as rows, effects of closures, differences of views."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.scalars import clamp
from viaduct.operators.annotate import top_edges

CRITICAL = 0.75


def critical_edges(edges: DataFrame, least: float = CRITICAL) -> DataFrame:
    """The edges whose criticality is ``least`` or more."""
    return edges.filter(F.col("criticality") >= least)


def critical_counts(edges: DataFrame, least: float = CRITICAL) -> DataFrame:
    """(graph_id, edges, critical): how many edges each graph has, and how many critical ones."""
    return edges.groupBy("graph_id").agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("criticality") >= least).alias("critical"))


def highest_edge(edges: DataFrame) -> DataFrame:
    """(graph_id, edge_id, criticality) of the most critical edge, ties to the least id."""
    best = F.min(F.struct((-F.col("criticality")).alias("below"), "edge_id")).alias("x")
    return edges.groupBy("graph_id").agg(best).select("graph_id", "x.edge_id", (-F.col("x.below")).alias("criticality"))


def curve_rows(curves: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``curves(removed_fraction, efficiency, giant)``, three arrays of which the shortest counts.

    Shares are clamped to [0, 1] and shown as percentages to one decimal; ``i`` is the place in the arrays.
    """
    names = {"removed_fraction": "removed", "efficiency": "efficiency", "giant": "giant"}
    n = F.least(*[F.size(c) for c in names])
    own = curves.withColumn("_z", F.arrays_zip(*[F.slice(c, F.lit(1), F.greatest(n, F.lit(0))) for c in names]))
    own = own.select(*keys, F.posexplode("_z").alias("i", "_x"))
    return own.select(*keys, "i", *[F.round(clamp(F.col("_x")[str(k)]) * 100, 1).alias(name) for k, name in enumerate(names.values())])


def toggle_impact(results: DataFrame, index: DataFrame) -> DataFrame:
    """Effects of closures against ``index(graph_id, resilience_index)`` before: change of the index, routes cut in per cent.

    The share is null where no routes were sampled.
    """
    cut = F.when(F.col("sampled_routes") > 0, F.round(F.col("broken_routes") / F.col("sampled_routes") * 100, 0).cast("int"))
    change = F.col("resilience_index_after") - F.col("resilience_index")
    return results.join(index, "graph_id").select("scenario_id", "graph_id", "resilience_index_after", change.alias("index_change"), cut.alias("cut_pct"))


def changes(before: DataFrame, after: DataFrame, kind: str, id_column: str) -> DataFrame:
    """(kind, id, change): what one of two tables has and the other lacks, lost or recovered."""
    a, b = (df.select(F.col(id_column).cast("string").alias("id")) for df in (before, after))
    lost, back = a.exceptAll(b).withColumn("change", F.lit("lost")), b.exceptAll(a).withColumn("change", F.lit("recovered"))
    return lost.unionByName(back).select(F.lit(kind).alias("kind"), "id", "change")


def curve_area(curves: DataFrame) -> DataFrame:
    """(graph_id, efficiency_area, giant_area): areas under ``curves(graph_id, step, removed_fraction, efficiency, giant)``.

    Trapezoids over the share that is removed, so a network that keeps all until half of it is gone has 0.5; one point has 0.
    """
    on = Window.partitionBy("graph_id").orderBy("step")  # a row a step
    ahead = curves.withColumns({f"_{c}": F.lead(c).over(on) for c in ("removed_fraction", "efficiency", "giant")})
    width = F.col("_removed_fraction") - F.col("removed_fraction")
    area = lambda c: F.coalesce(F.sum(width * (F.col(c) + F.col(f"_{c}")) / 2), F.lit(0.0))
    return ahead.groupBy("graph_id").agg(area("efficiency").alias("efficiency_area"), area("giant").alias("giant_area"))


def top_retention(before: DataFrame, after: DataFrame, k: int = 8) -> DataFrame:
    """(graph_id, k, kept, retention): how many of a network's ``k`` most critical edges are among those of another view.

    Both have (graph_id, edge_id, criticality); ties go to the least id, and a network of fewer edges counts all it has.
    """
    one, two = (top_edges(df, k).select("graph_id", "edge_id") for df in (before, after))
    size = one.groupBy("graph_id").agg(F.count(F.lit(1)).alias("k"))
    kept = one.join(two, ["graph_id", "edge_id"]).groupBy("graph_id").agg(F.count(F.lit(1)).alias("kept"))
    both = size.join(kept, "graph_id", "left").withColumn("kept", F.coalesce("kept", F.lit(0)))
    return both.select("graph_id", "k", "kept", (F.col("kept") / F.col("k")).alias("retention"))
