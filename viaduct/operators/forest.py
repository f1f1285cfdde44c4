"""Spanning forests by hook and contract, and their Euler tours by list ranking: logarithmically many rounds for any shape."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.operators.sampling import ranked
from viaduct.session import drop_stored, observed, stored

K = "graph_id"
#: Rounds of hooking at most; each halves the number of components at least.
MOST_ROUNDS = 100
#: The times of roots: before and after all others.
FIRST, LAST = -(1 << 62), 1 << 62


def simple_pairs(edges: DataFrame, *order: str) -> DataFrame:
    """(graph_id, src, dst, *order) with src < dst, of parallel edges the first in order; no loops, no null ends."""
    own = edges.filter("src <> dst").select(K, F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), *order)
    return own.groupBy(K, "src", "dst").agg(*[F.min(c).alias(c) for c in order]) if len(order) == 1 else own.distinct()


def jumped(links: DataFrame, at: str, to: str, sums: tuple[str, ...] = ()) -> DataFrame:
    """``links(at, to, *sums, ...)`` with ``to`` moved to the end of its list, by doubling; ``sums`` are added up.

    ``at`` is unique; a list ends where ``to`` is no ``at`` or points to itself. Takes as many rounds as the longest list
    has bits. What still moves after as many rounds as the number of rows has bits runs in circles, and is left out.
    """
    own, seen = observed(links, "links")
    for _ in range(seen["n"].bit_length() + 1):
        beyond = own.select(F.col(at).alias(to), F.col(to).alias("_to"), *[F.col(c).alias(f"_{c}") for c in sums]).filter(F.col("_to") != F.col(to))
        step = own.join(beyond, to, "left").select(
            *[F.col(c) for c in links.columns if c not in (to, *sums)], F.coalesce("_to", to).alias(to),
            *[(F.col(c) + F.coalesce(f"_{c}", F.lit(0))).alias(c) for c in sums], F.col("_to").isNotNull().alias("_moved"),
        )
        done, seen = observed(step, "jump", n=F.count_if(F.col("_moved")))
        drop_stored(own)
        own = done
        if not seen["n"]:
            break
    return own.filter(~F.col("_moved")).select(*links.columns) if "_moved" in own.columns else own


def spanning_forest(edges: DataFrame, order: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(graph_id, src, dst), the edges that taking all in the order of ``order``, src and dst would keep, and (graph_id, c, root).

    Rounds of Boruvka: each component hooks to another by its first edge that leaves it. The order is total, so circles
    of hooks are pairs, whose lesser component becomes a root; hooks are then followed to their roots by doubling, and
    edges between two components shrink to the first. ``root`` is a node of the component of node ``c``, one for all.
    """
    own = simple_pairs(edges, order) if order else simple_pairs(edges)
    first = F.struct(*([order] if order else []), "src", "dst")
    own = stored(own.select(K, "src", "dst", F.col("src").alias("ca"), F.col("dst").alias("cb"), first.alias("o")), "pairs")
    taken, labels = [], None
    for _ in range(MOST_ROUNDS):
        sides = own.select(K, F.col("ca").alias("c"), F.col("cb").alias("to"), "o").union(own.select(K, "cb", "ca", "o"))
        best = sides.groupBy(K, "c").agg(F.min_by(F.struct("to", "o"), "o").alias("x")).select(K, "c", "x.to", F.col("x.o.src").alias("src"), F.col("x.o.dst").alias("dst"))
        best, seen = observed(best, "hooks")
        if not seen["n"]:
            break
        taken.append(best.select(K, "src", "dst").distinct())
        back = best.select(K, F.col("c").alias("to"), F.col("to").alias("_back"))
        mutual = (F.col("_back") == F.col("c")) & (F.col("c") < F.col("to"))
        hooks = best.join(back, [K, "to"]).select(K, "c", F.when(mutual, F.col("c")).otherwise(F.col("to")).alias("to"))
        key = [F.struct(K, F.col(c).alias("c")).alias(c) for c in ("c", "to")]
        roots = jumped(hooks.select(*key), "c", "to").select(F.col(f"c.{K}").alias(K), F.col("c.c").alias("c"), F.col("to.c").alias("root"))
        roots = stored(roots, "roots")
        if labels is None:
            labels = roots
        else:
            labels = stored(labels.join(roots.toDF(K, "root", "_r"), [K, "root"], "left").select(K, "c", F.coalesce("_r", "root").alias("root")), "labels")
        moved = own.join(roots.toDF(K, "ca", "_a"), [K, "ca"], "left").join(roots.toDF(K, "cb", "_b"), [K, "cb"], "left")
        a, b = F.coalesce("_a", "ca"), F.coalesce("_b", "cb")
        moved = moved.select(K, "src", "dst", F.least(a, b).alias("ca"), F.greatest(a, b).alias("cb"), "o").filter("ca <> cb")
        fewer = stored(moved.groupBy(K, "ca", "cb").agg(F.min("o").alias("o")).select(K, F.col("o.src").alias("src"), F.col("o.dst").alias("dst"), "ca", "cb", "o"), "pairs")
        drop_stored(own)
        own = fewer
    if labels is None:
        none = edges.select(K, "src", "dst").limit(0)
        return stored(none, "forest"), stored(none.select(K, F.col("src").alias("c"), F.col("dst").alias("root")), "labels")
    whole = taken[0]
    for more in taken[1:]:
        whole = whole.unionByName(more)
    return stored(whole, "forest"), labels


def euler_tour(forest: DataFrame, labels: DataFrame) -> DataFrame:
    """(graph_id, v, parent, first, last), stored: the forest, rooted, and when a walk around it enters and leaves a node.

    Behind the arc from u to v a walk takes the arc from v to the neighbour that follows u around v; it ends where it
    would take the root's first arc again. Arcs are numbered in the order of their ends, and ranked in that list by
    doubling. Of a tree, ``first`` and ``last`` of a node enclose those of all below it; times of different trees of a
    graph may be equal.
    """
    arcs = forest.select(K, F.col("src").alias("u"), F.col("dst").alias("v")).union(forest.select(K, "dst", "src"))
    arcs = stored(ranked(arcs, [], K, "u", "v", name="id"), "arcs")
    around = stored(arcs.groupBy(K, "u").agg(F.min("id").alias("low"), F.max("id").alias("high")), "around")
    twins = arcs.select(K, F.col("u").alias("v"), F.col("v").alias("u"), F.col("id").alias("twin"))
    after = arcs.join(twins, [K, "u", "v"]).join(around.withColumnRenamed("u", "v"), [K, "v"])
    after = after.withColumn("next", F.when(F.col("twin") == F.col("high"), F.col("low")).otherwise(F.col("twin") + 1))
    starts = around.join(labels.filter("c = root").select(K, F.col("c").alias("u")), [K, "u"]).select(F.col("low").alias("next"), F.lit(True).alias("_end"))
    after = after.join(starts, "next", "left")
    links = after.select("id", F.when(F.col("_end"), F.col("id")).otherwise(F.col("next")).alias("next"), F.when(F.col("_end"), 0).otherwise(1).cast("long").alias("left"))
    ranks = jumped(links, "id", "next", ("left",)).select("id", (-F.col("left")).alias("time"))
    timed = stored(arcs.join(ranks, "id").select(K, "u", "v", "time"), "timed")
    back = timed.select(K, F.col("u").alias("v"), F.col("v").alias("u"), F.col("time").alias("back"))
    below = timed.join(back, [K, "u", "v"]).filter("time < back").select(K, "v", F.col("u").alias("parent"), F.col("time").alias("first"), F.col("back").alias("last"))
    tops = labels.filter("c = root").select(K, F.col("c").alias("v"), F.lit(None).cast(forest.schema["src"].dataType).alias("parent"), F.lit(FIRST).alias("first"), F.lit(LAST).alias("last"))
    return stored(below.unionByName(tops), "tour")
