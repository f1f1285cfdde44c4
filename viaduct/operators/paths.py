"""Shortest paths from many sources in many graphs at once.

Roads are long rows of nodes with two neighbours. Such rows are contracted to one weighted edge before paths are sought,
by doubling, and the distances inside them follow from those of their two ends; the search itself runs by blocks of nodes
(``block_paths``). So rounds follow the number of blocks that a path of junctions crosses, not that of its nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.scalars import hash_unit
from viaduct.operators.block_paths import BLOCK_NODES, block_paths
from viaduct.operators.forest import jumped
from viaduct.session import drop_stored, observed, stored

#: Rounds at most, and rounds after which what they improved is merged.
MOST_ROUNDS, MERGE = 10_000, 8
#: Nodes inside chains, as a share of all, from which chains are contracted: fewer are not worth the rounds it takes.
LEAST_INSIDE = 0.2
#: Sources that stand for all where a caller asks for a sample, and the seed of their draw.
SAMPLED_SOURCES, SOURCE_SEED = 64, 5


def both_ways(edges: DataFrame, weight: str = "w") -> DataFrame:
    """(graph_id, src, dst, w) in both directions, the lightest of parallel edges, without self-loops."""
    own = edges.select("graph_id", "src", "dst", F.col(weight).cast("long").alias("w")).filter("src <> dst")
    own = own.union(own.select("graph_id", "dst", "src", "w"))
    return own.groupBy("graph_id", "src", "dst").agg(F.min("w").alias("w"))


def shortest_paths(edges: DataFrame, sources: DataFrame, weight: str = "w", most_rounds: int = MOST_ROUNDS, least_inside: float | None = None) -> DataFrame:
    """(graph_id, s, v, dist) of all nodes that ``sources(graph_id, s)`` reach over undirected ``edges``.

    Weights are whole and not negative. Chains are contracted where ``least_inside`` of the nodes lie inside of some; by
    default where ``LEAST_INSIDE`` do and the nodes are more than a block holds.
    """
    steps = stored(both_ways(edges, weight), "steps")
    start = stored(sources.select("graph_id", "s", F.col("s").alias("v"), F.lit(0).cast("long").alias("dist")).distinct(), "sources")
    kept = start.select("graph_id", F.col("v").alias("src")).distinct().withColumn("_kept", F.lit(True))
    near = steps.groupBy("graph_id", "src").agg(F.count(F.lit(1)).alias("n")).join(kept, ["graph_id", "src"], "left")
    inside = near.select("graph_id", F.col("src").alias("v"), ((F.col("n") == 2) & F.col("_kept").isNull()).alias("inside"))
    marked, seen = observed(inside, "inside", n=F.count_if("inside"), all=F.count(F.lit(1)))
    if least_inside is None:
        least_inside = LEAST_INSIDE if seen["all"] > BLOCK_NODES else 2.0
    if seen["n"] == 0 or seen["n"] < least_inside * seen["all"]:
        found = block_paths(start, steps, most_rounds)
        drop_stored(steps, start, marked)
        return found
    inside = marked.filter("inside").select("graph_id", "v")
    arms = _chains(steps, inside)
    middle = inside.withColumn("_in", F.lit(True))
    outer = steps.join(middle.toDF("graph_id", "src", "_in"), ["graph_id", "src"], "left_anti")
    direct = outer.join(middle.toDF("graph_id", "dst", "_in"), ["graph_id", "dst"], "left_anti").select("graph_id", "src", "dst", "w")
    into = outer.join(arms.select("graph_id", F.col("at").alias("src"), F.col("v").alias("dst"), "to", "far"), ["graph_id", "src", "dst"])
    short = into.filter("src <> to").select("graph_id", "src", F.col("to").alias("dst"), (F.col("w") + F.col("far")).alias("w"))
    short = stored(direct.unionByName(short).groupBy("graph_id", "src", "dst").agg(F.min("w").alias("w")), "shortcuts")
    ends = block_paths(start, short, most_rounds)
    along = ends.withColumnRenamed("v", "to").join(arms.select("graph_id", "v", "to", "far"), ["graph_id", "to"])
    within = along.groupBy("graph_id", "s", "v").agg(F.min(F.col("dist") + F.col("far")).alias("dist"))
    return ends.select("graph_id", "s", "v", "dist").unionByName(within)


def _chains(steps: DataFrame, inside: DataFrame) -> DataFrame:
    """(graph_id, v, at, to, far), stored: for each node inside a chain and each neighbour ``at``, the end ``to`` that lies
    in the other direction, and how far.

    The arc from ``at`` to v leads on to v's other neighbour; arcs are followed to the last one by doubling. Circles
    without an end, which no source reaches, are left out.
    """
    pairs = steps.join(inside.withColumnRenamed("v", "src"), ["graph_id", "src"], "left_semi")
    other = pairs.groupBy("graph_id", "src").agg(F.min(F.struct("dst", "w")).alias("a"), F.max(F.struct("dst", "w")).alias("b"))
    turns = other.select("graph_id", F.col("src").alias("v"), F.explode(F.array(F.struct(F.col("a.dst").alias("at"), F.col("b.dst").alias("next"), F.col("b.w").alias("w")), F.struct(F.col("b.dst").alias("at"), F.col("a.dst").alias("next"), F.col("a.w").alias("w")))).alias("t"))
    arc = lambda a, b: F.struct("graph_id", F.col(a).alias("at"), F.col(b).alias("v"))
    links = turns.select(arc("t.at", "v").alias("arc"), arc("v", "t.next").alias("to"), F.col("t.w").alias("far"))
    done = jumped(links, "arc", "to", ("far",))
    return stored(done.select("arc.graph_id", "arc.v", "arc.at", F.col("to.v").alias("to"), "far"), "chains")


def relaxed(start: DataFrame, steps: DataFrame, key: list[str], on: list[str], most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(*key, v, dist): the least of ``start(*key, v, dist)`` and of what ``steps(*on, src, dst, w)`` lead to from there.

    Semi-naive Bellman-Ford: each round extends only what the last one improved, for all keys together, combines
    candidates before they are shuffled, and writes only what it improves. ``on`` are columns of the key.
    """
    known = [stored(start.select(*key, "v", "dist"), "dist")]
    for k in range(most_rounds):
        front = known[-1].withColumnRenamed("v", "src")
        found = front.join(steps, [*on, "src"]).select(*key, F.col("dst").alias("v"), (F.col("dist") + F.col("w")).alias("dist"))
        none = F.lit(None).cast("long")
        both = found.withColumn("before", none)
        for part in known:
            both = both.unionByName(part.select(*key, "v", none.alias("dist"), F.col("dist").alias("before")))
        both = both.groupBy(*key, "v").agg(F.min("dist").alias("dist"), F.min("before").alias("before"))
        fresh, seen = observed(both.filter("dist is not null and (before is null or dist < before)").drop("before"), "dist")
        known.append(fresh)
        if seen["n"] == 0:
            return _merged(known[:-1], key)
        if k % MERGE == MERGE - 1:
            whole = stored(_merged(known, key), "dist")
            drop_stored(*known[:-1])
            known = [whole, known[-1]]
    raise RuntimeError(f"paths did not settle within {most_rounds} rounds")


def _merged(known: list[DataFrame], key: list[str]) -> DataFrame:
    """The least distances of some tables."""
    whole = known[0]
    for part in known[1:]:
        whole = whole.unionByName(part)
    return whole.groupBy(*key, "v").agg(F.min("dist").alias("dist")) if len(known) > 1 else whole


def sampled_sources(nodes: DataFrame, most: int = SAMPLED_SOURCES, seed: int = SOURCE_SEED) -> DataFrame:
    """(graph_id, s): the ``most`` nodes of each graph, or all, with the least hashes of seed and node."""
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy(hash_unit(F.lit(seed), "node"), "node"))
    return nodes.select("graph_id", F.col("node").alias("s"), rank.alias("rank")).filter(F.col("rank") <= most).drop("rank")


def all_pairs(nodes: DataFrame, edges: DataFrame, weight: str = "w", most_sources: int | None = None) -> DataFrame:
    """Distances from all nodes, a row for each reachable pair; or, for large networks, from ``most_sources`` of each."""
    sources = nodes.select("graph_id", F.col("node").alias("s")) if most_sources is None else sampled_sources(nodes, most_sources)
    return shortest_paths(edges, sources, weight)


def global_efficiency(nodes: DataFrame, dist: DataFrame, unit: float = 10.0) -> DataFrame:
    """(graph_id, n, efficiency): mean of 1/d over ordered pairs; unreachable pairs add 0, n below 2 gives 0.

    ``unit`` of ``dist`` make one second. Of sampled sources it is the mean over their pairs.
    """
    near = F.when(F.col("dist") > 0, unit / F.col("dist"))
    total = dist.groupBy("graph_id").agg(F.sum(near).alias("total"), F.count_if(F.col("s") == F.col("v")).alias("sources"))
    count = nodes.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    pairs = F.col("sources") * (F.col("n") - 1)
    value = F.when((F.col("n") > 1) & (F.col("sources") > 0), F.coalesce("total", F.lit(0.0)) / pairs).otherwise(0.0)
    return count.join(total, "graph_id", "left").select("graph_id", "n", value.alias("efficiency"))
