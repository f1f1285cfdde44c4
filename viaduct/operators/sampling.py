"""Seeded samples by SHA-256 of row ids, the same in any engine and on any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from viaduct.functions.scalars import hash_unit
from viaduct.session import stored


def ranked(df: DataFrame, by: list[str], *order, name: str = "rank") -> DataFrame:
    """``df``, stored, with the rank of each row, from 1, in the order of ``order`` within its group.

    Rows are dealt to tasks by ranges of group and order and sorted there; what stands before a task's first row is a sum
    over tasks, so a group that holds all rows is ranked by all tasks. ``order`` should leave no ties.
    """
    keys = [F.col(c) for c in by] + [F.col(c) if isinstance(c, str) else c for c in order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    place = F.monotonically_increasing_id()
    own = stored(dealt.withColumns({"_task": F.shiftright(place, 33), "_place": place.bitwiseAND((1 << 33) - 1)}), "ranked")
    sizes = own.groupBy("_task").agg(F.count(F.lit(1)).alias("_n"))  # one row a task
    before = sizes.select("_task", F.coalesce(F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = own.join(F.broadcast(before), "_task").withColumn("_at", F.col("_before") + F.col("_place"))
    if by:
        placed = placed.join(placed.groupBy(*by).agg(F.min("_at").alias("_first")), by)
    else:
        placed = placed.withColumn("_first", F.lit(0))
    return placed.select(*df.columns, (F.col("_at") - F.col("_first") + 1).alias(name))


def sample_rows(df: DataFrame, by: list[str], key: str, keep: float | int, seed: int) -> DataFrame:
    """Per group, ``keep`` rows, or that share of them cut to a whole number, without replacement."""
    own = ranked(df.withColumn("_u", hash_unit(F.lit(seed), key)), by, "_u", key, name="_rank")
    if isinstance(keep, int):
        return own.filter(F.col("_rank") <= keep).select(*df.columns)
    quota = own.groupBy(*by).agg(F.floor(F.count(F.lit(1)) * F.lit(float(keep))).alias("_quota"))
    return own.join(quota, by).filter(F.col("_rank") <= F.col("_quota")).select(*df.columns)


def hold_out(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """All rows with ``split``: of n rows max(1, round(n share)) are val, those with the least hashes of seed and key."""
    own = ranked(df.withColumn("_u", hash_unit(F.lit(seed), key)), [], "_u", key, name="_rank")
    n = own.count()
    quota = max(1, round(n * share)) if n else 0
    return own.select(*df.columns, F.when(F.col("_rank") <= quota, "val").otherwise("train").alias("split"))


def dense_index(nodes: DataFrame) -> DataFrame:
    """(graph_id, i, node), numbered from 0 by node within each graph."""
    return ranked(nodes.select("graph_id", "node"), ["graph_id"], "node").select("graph_id", "node", (F.col("rank") - 1).alias("i"))


def sample_pairs(nodes: DataFrame, draws: int, seed: int, distinct: int | None = None) -> DataFrame:
    """(graph_id, draw, s, t): pairs of nodes drawn with replacement, without s = t.

    With ``distinct`` the first that many different unordered pairs, s < t, are kept.
    """
    index = dense_index(nodes)
    sizes = index.groupBy("graph_id").agg(F.count(F.lit(1)).alias("n"))
    drawn = sizes.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    at = [F.floor(hash_unit(F.lit(seed), "graph_id", "draw", F.lit(x)) * F.col("n")).cast("long") for x in ("s", "t")]
    drawn = drawn.select("graph_id", "draw", at[0].alias("i"), at[1].alias("j")).filter("i <> j")
    pairs = drawn.join(index.select("graph_id", "i", F.col("node").alias("s")), ["graph_id", "i"])
    pairs = pairs.join(index.select("graph_id", F.col("i").alias("j"), F.col("node").alias("t")), ["graph_id", "j"])
    if distinct is None:
        return pairs.select("graph_id", "draw", "s", "t")
    own = pairs.groupBy("graph_id", F.least("s", "t").alias("s"), F.greatest("s", "t").alias("t")).agg(F.min("draw").alias("draw"))
    rank = F.row_number().over(Window.partitionBy("graph_id").orderBy("draw"))
    return own.withColumn("rank", rank).filter(F.col("rank") <= distinct).select("graph_id", "draw", "s", "t")
