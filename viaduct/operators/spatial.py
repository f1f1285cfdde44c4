"""Joins in space on a grid of cells that goes round the earth, so that only neighbouring cells are compared.

Cells hold very different numbers of points. Those of a crowded cell are dealt into parts of either side, and parts are
compared with parts, so no task gets a whole one; a search for the nearest starts with cells small enough to hold few
targets, and widens only for points that found none.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.functions.scalars import haversine_m
from viaduct.session import drop_stored, observed, stored

METRES_PER_DEGREE = 111_000.0
#: Points of a side of a cell that one task compares, and targets that the first cells of a search may hold.
PART_POINTS, FEW_TARGETS = 1024, 64


def _cells(df: DataFrame, within_m: float, most_lat: float, around: bool) -> DataFrame:
    """The cell of each point, or, ``around``, its cell and those beside it, as (cy, cx).

    Cells are as high as the distance, and at least as wide as it at the latitude farthest from the equator; a whole number
    of them goes round the earth. Where that is one, as at the poles, there are bands only.
    """
    d_lat = within_m / METRES_PER_DEGREE
    n = max(1, math.floor(360 * max(0.0, math.cos(math.radians(min(90.0, most_lat + d_lat)))) / d_lat))
    cy, cx = F.floor(F.col("lat") / d_lat), F.pmod(F.floor((F.col("lng") + 180) * (n / 360)), F.lit(n))
    if not around:
        return df.withColumns({"cy": cy, "cx": cx})
    beside = F.array_distinct(F.array(*[F.pmod(cx + k, F.lit(n)) for k in (-1, 0, 1)]))
    return df.withColumn("cy", F.explode(F.array(*[cy + k for k in (-1, 0, 1)]))).withColumn("cx", F.explode(beside))


def within_distance(left: DataFrame, right: DataFrame, within_m: float) -> DataFrame:
    """(graph_id, a, b, dist_m) of points ``(graph_id, node, lat, lng)`` of both sides at most ``within_m`` apart.

    The cell width needs one number of the data, the largest latitude. Distances are whole micrometres, so that equal ones
    tie whatever the direction.
    """
    most = max(left.agg(F.max(F.abs("lat"))).first()[0] or 0.0, right.agg(F.max(F.abs("lat"))).first()[0] or 0.0)
    cell = ["graph_id", "cy", "cx"]
    a = _cells(left.select("graph_id", F.col("node").alias("a"), "lat", "lng"), within_m, most, True).withColumnsRenamed({"lat": "lat_a", "lng": "lng_a"})
    b = _cells(right.select("graph_id", F.col("node").alias("b"), "lat", "lng"), within_m, most, False).withColumnsRenamed({"lat": "lat_b", "lng": "lng_b"})
    count = lambda df, name: df.groupBy(*cell).agg(F.ceil(F.count(F.lit(1)) / PART_POINTS).cast("int").alias(name))
    crowded = stored(count(a, "na").join(count(b, "nb"), cell).filter("na > 1 or nb > 1"), "crowded")
    parts = lambda df: df.join(crowded, cell, "left").withColumns({c: F.coalesce(c, F.lit(1)) for c in ("na", "nb")})
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda name, n: F.pmod(F.xxhash64(name), F.col(n)).cast("int")
    a = parts(a).withColumns({"pa": own("a", "na"), "pb": every("nb")}).drop("na", "nb")
    b = parts(b).withColumns({"pa": every("na"), "pb": own("b", "nb")}).drop("na", "nb")
    near = a.join(b, [*cell, "pa", "pb"]).withColumn("dist_m", F.round(haversine_m("lat_a", "lng_a", "lat_b", "lng_b"), 6))
    return near.filter(F.col("dist_m") <= within_m).select("graph_id", "a", "b", "dist_m")


def nearest_snap(points: DataFrame, targets: DataFrame, most_m: float = 50.0) -> DataFrame:
    """(graph_id, node, snapped, dist_m): the nearest target of each point, ties to the least; null beyond ``most_m``.

    Of targets in one place the least stands for all, and of points in one place the search is done once. It starts at a
    distance at which an even cell has few targets; who finds one is done, and the others go on with twice the distance.
    """
    place = ["graph_id", "lat", "lng"]
    spots = stored(targets.groupBy(*place).agg(F.min("node").alias("node")), "spots")
    asked = stored(points.groupBy(*place).agg(F.min("node").alias("node")), "asked")
    fullest = spots.groupBy("graph_id", F.floor(F.col("lat") * METRES_PER_DEGREE / most_m), F.floor(F.col("lng") * METRES_PER_DEGREE / most_m)).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    halves = max(0, math.ceil(math.log(max(1.0, fullest / FEW_TARGETS), 4)))
    left, found = asked, []
    for k in range(halves, -1, -1):
        near = within_distance(left, spots, most_m / 2**k)
        best, seen = observed(near.groupBy("graph_id", F.col("a").alias("node")).agg(F.min(F.struct("dist_m", "b")).alias("x")), "nearest")
        found.append(best)
        if k and seen["n"]:
            before, left = left, stored(left.join(best, ["graph_id", "node"], "left_anti"), "left")
            if before is not asked:
                drop_stored(before)
    whole = found[0]
    for more in found[1:]:
        whole = whole.unionByName(more)
    best = asked.join(whole, ["graph_id", "node"]).select(*place, F.col("x.b").alias("snapped"), F.col("x.dist_m").alias("dist_m"))
    return points.select(*place, "node").join(best, place, "left").select("graph_id", "node", "snapped", "dist_m")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(graph_id, node, degree) of all nodes, isolated ones too."""
    ends = edges.select("graph_id", F.col("src").alias("node")).union(edges.select("graph_id", "dst"))
    count = ends.groupBy("graph_id", "node").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("graph_id", "node").join(count, ["graph_id", "node"], "left").select("graph_id", "node", F.coalesce("n", F.lit(0)).cast("long").alias("degree"))
