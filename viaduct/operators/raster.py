"""Rasters as pixel rows (tile_id, r, c, ...): metrics, morphology, thinning and occlusion.

Masks hold foreground pixels only. Every step is a join or an aggregate keyed by tile and place, or works on blocks or
columns of tiles, so a large tile is spread over many tasks like many small ones.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from viaduct.functions.scalars import hash_unit
from viaduct.operators import blocks as B
from viaduct.operators.components import connected_components
from viaduct.session import drop_stored, observed, stored

AT = ["tile_id", "r", "c"]
EPS, MICRO_EPS = 1e-7, 1e-6
EIGHT = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
FOUR = [(-1, 0), (0, 1), (1, 0), (0, -1)]
DISK2 = [(y, x) for y in range(-2, 3) for x in range(-2, 3) if y * y + x * x <= 4]
#: Pixels around a block that is thinned, and pixels whose columns a task searches at once.
HALO, COLUMNS = 16, 1 << 16
#: Columns that a pixel's number leaves room for.
BIG = 1 << 31


def _offsets(steps) -> Column:
    return F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(y).alias("dy"), F.lit(x).alias("dx")) for i, (y, x) in enumerate(steps)]))


def shifted(mask: DataFrame, steps) -> DataFrame:
    """Each pixel once for each step, moved by it, with the step's number ``k``."""
    return mask.select(*AT, _offsets(steps).alias("o")).select("tile_id", (F.col("r") + F.col("o.dy")).alias("r"), (F.col("c") + F.col("o.dx")).alias("c"), F.col("o.k").alias("k"))


# --- metrics -------------------------------------------------------------------------------------------------------


def _count(cond: Column) -> Column:
    return F.sum(F.when(cond, 1).otherwise(0)).cast("double")


def overlap_metrics(pixels: DataFrame, by: list[str]) -> DataFrame:
    """IoU, Dice and recall under occlusion of boolean ``pred``, ``target``, ``occluded`` by group.

    Empty unions, two empty masks and no occluded target score 1; without a column ``occluded`` recall is null.
    """
    p, t = F.col("pred"), F.col("target")
    o = F.col("occluded") if "occluded" in pixels.columns else F.lit(False)
    s = pixels.groupBy(*by).agg(_count(p & t).alias("i"), _count(p | t).alias("u"), _count(p).alias("p"), _count(t).alias("t"), _count(p & t & o).alias("io"), _count(t & o).alias("to"))
    iou = F.when(F.col("u") == 0, 1.0).otherwise(F.col("i") / (F.col("u") + EPS))
    dice = F.when(F.col("p") + F.col("t") == 0, 1.0).otherwise(2 * F.col("i") / (F.col("p") + F.col("t") + EPS))
    recall = F.when(F.col("to") == 0, 1.0).otherwise(F.col("io") / (F.col("to") + EPS)) if "occluded" in pixels.columns else F.lit(None).cast("double")
    return s.select(*by, iou.alias("iou"), dice.alias("dice"), recall.alias("occlusion_recall"))


def micro_metrics(pixels: DataFrame, by: list[str]) -> DataFrame:
    """IoU, Dice and recall over all pixels of a group, to three decimals."""
    p, t = F.col("pred"), F.col("target")
    s = pixels.groupBy(*by).agg(_count(p & t).alias("i"), _count(p | t).alias("u"), _count(p).alias("p"), _count(t).alias("t"))
    r3 = lambda x: F.round(x, 3)
    return s.select(*by, r3(F.col("i") / (F.col("u") + MICRO_EPS)).alias("iou"), r3(2 * F.col("i") / (F.col("p") + F.col("t") + MICRO_EPS)).alias("dice"), r3(F.col("i") / (F.col("t") + MICRO_EPS)).alias("recall"))


def soft_losses(pixels: DataFrame, smooth: float = 1.0, clip: float = 1e-6, weight: float = 1.0) -> DataFrame:
    """(tile_id, dice_loss, bce) of ``prob`` against ``target``; ``weight`` is that of positives."""
    t = F.col("target").cast("double")
    p = F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col("prob")))
    s = pixels.groupBy("tile_id").agg(F.sum(F.col("prob") * t).alias("i"), F.sum("prob").alias("p"), F.sum(t).alias("t"), F.avg(-(weight * t * F.ln(p) + (1 - t) * F.ln(1 - p))).alias("bce"))
    return s.select("tile_id", (1 - (2 * F.col("i") + smooth) / (F.col("p") + F.col("t") + smooth)).alias("dice_loss"), "bce")


def bce_with_logits(x: Column, t: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) - x * t + F.log1p(F.exp(-F.abs(x)))


def consistency(pixels: DataFrame, clip: float = 1e-6) -> DataFrame:
    """(tile_id, mse, kl, mean_abs) between ``prob`` and ``pred``, where ``occluded`` masks; 0 where it masks nothing."""
    m = F.col("occluded").cast("double")
    a, b = (F.greatest(F.lit(clip), F.least(F.lit(1 - clip), F.col(x))) for x in ("prob", "pred"))
    kl = 0.5 * (a * F.ln(a / b) + (1 - a) * F.ln((1 - a) / (1 - b)) + b * F.ln(b / a) + (1 - b) * F.ln((1 - b) / (1 - a)))
    n = F.greatest(F.sum(m), F.lit(1.0))
    d = F.col("prob") - F.col("pred")
    return pixels.groupBy("tile_id").agg((F.sum(d * d * m) / n).alias("mse"), (F.sum(kl * m) / n).alias("kl"), F.avg(F.abs(d)).alias("mean_abs"))


def robust_score(clean: DataFrame, occluded: DataFrame, kept: DataFrame, weight: float = 0.1, dice_weight: float = 0.5) -> DataFrame:
    """(tile_id, sup_clean, sup_occluded, consistency, total): half of both supervised losses and weight x consistency.

    ``clean`` and ``occluded`` are ``soft_losses`` of the two predictions; a supervised loss is BCE and Dice, mixed by
    ``dice_weight``. ``kept`` is from ``consistency``.
    """
    mixed = (1 - dice_weight) * F.col("bce") + dice_weight * F.col("dice_loss")
    both = clean.select("tile_id", mixed.alias("sup_clean")).join(occluded.select("tile_id", mixed.alias("sup_occluded")), "tile_id")
    total = 0.5 * (F.col("sup_clean") + F.col("sup_occluded")) + weight * F.col("mse")
    return both.join(kept, "tile_id").select("tile_id", "sup_clean", "sup_occluded", F.col("mse").alias("consistency"), total.alias("total"))


def otsu_threshold(pixels: DataFrame, value: str = "prob", bins: int = 256) -> DataFrame:
    """(tile_id, threshold): the centre of the bin with the largest variance between classes; null for a constant tile."""
    rng = pixels.groupBy("tile_id").agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    at = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1))
    hist = pixels.join(rng.filter("hi > lo"), "tile_id").groupBy("tile_id", "lo", "hi", at.alias("bin")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    hist = hist.withColumn("x", F.col("lo") + (F.col("bin") + 0.5) * (F.col("hi") - F.col("lo")) / bins)
    w = Window.partitionBy("tile_id").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("tile_id")
    hist = hist.withColumn("n1", F.sum("n").over(w)).withColumn("s1", F.sum(F.col("n") * F.col("x")).over(w)).withColumn("n0", F.sum("n").over(every)).withColumn("s0", F.sum(F.col("n") * F.col("x")).over(every))
    n2, s2 = F.col("n0") - F.col("n1"), F.col("s0") - F.col("s1")
    between = F.col("n1") * n2 * F.pow(F.col("s1") / F.col("n1") - s2 / n2, 2)
    best = hist.filter(F.col("n0") > F.col("n1")).groupBy("tile_id").agg(F.max_by("x", F.struct(F.round(between, 6), -F.col("bin"))).alias("threshold"))
    return rng.select("tile_id").join(best, "tile_id", "left")


def otsu_foreground(pixels: DataFrame, value: str = "prob") -> DataFrame:
    """The pixels that reach Otsu's threshold of their tile; of a constant tile, those above its least value, so none."""
    low = pixels.groupBy("tile_id").agg(F.min(value).alias("_low"))  # one row a tile
    own = pixels.join(otsu_threshold(pixels, value).join(low, "tile_id"), "tile_id")
    return own.filter(F.coalesce(F.col(value) >= F.col("threshold"), F.col(value) > F.col("_low"))).drop("threshold", "_low")


def scaled_foreground(pixels: DataFrame, value: str = "v", threshold: float = 0.5) -> DataFrame:
    """The pixels of whole-number maps that reach ``threshold`` as a share of their tile's largest value; none of an all-zero tile."""
    top = pixels.groupBy("tile_id").agg(F.max(value).alias("_top")).filter("_top > 0")
    return pixels.join(top, "tile_id").filter(F.col(value) / F.col("_top") >= threshold).drop("_top")


def join_masks(pred: DataFrame, target: DataFrame, occluded: DataFrame | None, tiles: DataFrame, target_tiles: DataFrame) -> DataFrame:
    """(tile_id, r, c, pred, target, occluded) of sparse masks; pixels that are in none are left out.

    ``tiles`` and ``target_tiles`` hold (tile_id, h, w); a tile that only one of them has, or with another extent, is an
    error.
    """
    odd = tiles.select("tile_id", "h", "w").exceptAll(target_tiles.select("tile_id", "h", "w")).union(target_tiles.select("tile_id", "h", "w").exceptAll(tiles.select("tile_id", "h", "w")))
    first = odd.orderBy("tile_id").first()
    if first is not None:
        raise ValueError(f"prediction and target differ in extent, first at tile {first['tile_id']}")
    mark = lambda df, name: df.select(*AT).distinct().withColumn(name, F.lit(True))
    both = mark(pred, "pred").join(mark(target, "target"), AT, "full")
    if occluded is not None:
        both = both.join(mark(occluded, "occluded"), AT, "full")
    return both.select(*AT, *[F.coalesce(c, F.lit(False)).alias(c) for c in both.columns if c not in AT])


def seam_blend(pixels: DataFrame, tiles: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(scene_id, r, c, prob, road): overlapping tiles averaged; ``tiles(tile_id, scene_id, y0, x0)`` places them."""
    own = pixels.join(tiles, "tile_id").groupBy("scene_id", (F.col("r") + F.col("y0")).alias("r"), (F.col("c") + F.col("x0")).alias("c"))
    return own.agg(F.round(F.avg("prob"), 6).alias("prob")).withColumn("road", F.col("prob") > threshold)


# --- tiles ---------------------------------------------------------------------------------------------------------


def tile_offsets(scenes: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """(scene_id, row, col, y0, x0) of tiles that cover ``scenes(scene_id, h, w)``; the last ones end at the border."""

    def starts(n: str) -> Column:
        last = F.col(n) - size
        every = F.when(last > 0, F.array_distinct(F.concat(F.sequence(F.lit(0).cast("long"), F.greatest(last, F.lit(0)).cast("long"), F.lit(size - overlap).cast("long")), F.array(last.cast("long")))))
        return F.coalesce(every, F.array(F.lit(0).cast("long")))

    rows = scenes.select("scene_id", "w", F.posexplode(starts("h")).alias("row", "y0"))
    return rows.select("scene_id", "row", "y0", F.posexplode(starts("w")).alias("col", "x0")).select("scene_id", "row", "col", "y0", "x0")


def covering(place, extent, size: int = 512, overlap: int = 64) -> Column:
    """The tiles over a place on one axis as array<struct<i, start>>, by arithmetic: those of the step, and the last one."""
    p, n, step = F.col(place).cast("long"), F.col(extent).cast("long"), size - overlap
    last = F.greatest(F.lit(0).cast("long"), n - size)
    most = F.floor(last / step)
    low, high = F.greatest(F.lit(0).cast("long"), F.ceil((p - size + 1) / step)), F.least(F.floor(p / step), most)
    every = F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<bigint>"))
    flush = F.when((last % step != 0) & (p >= last), F.array(most + 1)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(F.concat(every, flush), lambda i: F.struct(i.cast("int").alias("i"), F.least(i * step, last).alias("start")))


def chip_name(scene="scene_id", row="row", col="col") -> Column:
    return F.format_string("%s_r%d_c%d", F.col(scene), F.col(row), F.col(col))


def cut_tiles(pixels: DataFrame, scenes: DataFrame, size: int = 512, overlap: int = 64) -> DataFrame:
    """Pixels (scene_id, r, c, ...) as pixels of tiles, with scene_id, row and col; a pixel under several tiles stands in each.

    ``scenes(scene_id, h, w)`` has the extents, one row a scene; a tile is named scene_rROW_cCOL.
    """
    rest = [c for c in pixels.columns if c not in ("scene_id", "r", "c")]
    own = pixels.join(scenes.select("scene_id", "h", "w"), "scene_id")
    own = own.withColumn("_y", F.explode(covering("r", "h", size, overlap))).withColumn("_x", F.explode(covering("c", "w", size, overlap)))
    own = own.select("scene_id", F.col("_y.i").alias("row"), F.col("_x.i").alias("col"), (F.col("r") - F.col("_y.start")).cast("int").alias("r"), (F.col("c") - F.col("_x.start")).cast("int").alias("c"), *rest)
    return own.select(chip_name().alias("tile_id"), "*")


def coverage(scenes: DataFrame, offsets: DataFrame, size: int = 512) -> DataFrame:
    """(scene_id, covered): whether the tiles of a scene end at its borders, or are as large as it."""
    ends = offsets.groupBy("scene_id").agg(F.max("y0").alias("y"), F.max("x0").alias("x"))
    flush = lambda at, n: F.greatest(F.col(at) + size, F.lit(size)) == F.greatest(F.col(n), F.lit(size))
    return scenes.join(ends, "scene_id", "left").select("scene_id", F.coalesce(flush("y", "h") & flush("x", "w"), F.lit(False)).alias("covered"))


def padded(pixels: DataFrame, tiles: DataFrame, size: int, fill: float = 0.0) -> DataFrame:
    """All size x size pixels of each tile; those that are missing hold ``fill``."""
    span = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = tiles.select("tile_id").withColumn("r", span).withColumn("c", span)
    return grid.join(pixels, AT, "left").withColumn("v", F.coalesce("v", F.lit(fill)))


def _targets(at: str, n: int, to: int, around: float) -> Column:
    """The places of an axis of ``to`` whose centres may lie within ``around`` of place ``at`` of one of ``n``."""
    low = F.when(F.col(at) <= 0, 0).otherwise(F.floor((F.col(at) + 0.5 - around) * to / n - 0.5))
    high = F.when(F.col(at) >= n - 1, to - 1).otherwise(F.ceil((F.col(at) + 0.5 + around) * to / n + 0.5))
    return F.sequence(F.greatest(low, F.lit(0)).cast("int"), F.least(high, F.lit(to - 1)).cast("int"))


def resize_nearest(pixels: DataFrame, height: int, width: int, to: int) -> DataFrame:
    """A height x width tile resampled to ``to`` x ``to`` by the nearest pixel.

    Each pixel goes to the places that take it, so nothing is joined.
    """
    own = pixels.filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1))
    own = own.withColumn("r2", F.explode(_targets("r", height, to, 0.5))).filter(F.floor(F.col("r2") * height / to) == F.col("r"))
    own = own.withColumn("c2", F.explode(_targets("c", width, to, 0.5))).filter(F.floor(F.col("c2") * width / to) == F.col("c"))
    return own.select("tile_id", F.col("r2").alias("r"), F.col("c2").alias("c"), "v")


def resize_bilinear(pixels: DataFrame, height: int, width: int, to: int) -> DataFrame:
    """A height x width tile resampled to ``to`` x ``to``: four neighbours of each pixel's centre, by nearness.

    Each pixel goes to the places that take a share of it, so nothing is joined.
    """

    def shares(at: str, target: str, n: int) -> Column:
        place = F.greatest(F.lit(0.0), F.least(F.lit(float(n - 1)), (F.col(target) + 0.5) * n / to - 0.5))
        low = F.floor(place).cast("int")
        first, second = F.col(at) == low, F.col(at) == F.least(F.lit(n - 1), low + 1)
        return F.when(first & second, 1.0).when(first, 1 - (place - low)).when(second, place - low)

    own = pixels.filter(F.col("r").between(0, height - 1) & F.col("c").between(0, width - 1)).select(*AT, "v")
    own = own.withColumn("r2", F.explode(_targets("r", height, to, 1))).withColumn("y", shares("r", "r2", height)).filter("y is not null")
    own = own.withColumn("c2", F.explode(_targets("c", width, to, 1))).withColumn("x", shares("c", "c2", width)).filter("x is not null")
    found = own.groupBy("tile_id", F.col("r2").alias("r"), F.col("c2").alias("c"))
    return found.agg(F.round(F.sum(F.col("v") * (F.col("y") * F.col("x"))), 9).alias("v"))


# --- morphology ----------------------------------------------------------------------------------------------------


def _at_fields(mask: DataFrame) -> list[tuple[str, T.DataType]]:
    return [(c, mask.schema[c].dataType) for c in ("r", "c")]


def _counts(here: np.ndarray) -> np.ndarray:
    """Of each pixel, how many of the eight around it are set."""
    return sum(B.moved(here, y, x).astype(np.uint8) for y, x in EIGHT)


def neighbour_count(mask: DataFrame) -> DataFrame:
    """(tile_id, r, c, n): foreground pixels among the eight around each foreground pixel."""

    def work(here, top, left):
        core = B.inner(here, 1)
        number, at = B.places(core, top, left)
        return number, [*at, B.inner(_counts(here), 1)[core].astype(np.int64)]

    return B.on_blocks(mask.select(*AT), 1, work, [*_at_fields(mask), ("n", T.LongType())])


def node_pixels(mask: DataFrame, cluster: bool = True) -> DataFrame:
    """Pixels where chains end or meet: degree 1, or 3 and more; without ``cluster`` all but degree 2."""
    n = F.col("n")
    return neighbour_count(mask).filter(((n == 1) | (n >= 3)) if cluster else (n != 2))


def _shapes(mask: DataFrame, size: int, halo: int, work) -> DataFrame:
    """What ``work(here, within)`` makes of blocks of tiles of side ``size``; ``within`` says which pixels lie in the tile."""

    def run(here, top, left):
        within = B.inside(here, top, left, halo, size)
        return B.places(B.inner(work(here & within, within) & within, halo), top, left)

    return B.on_blocks(mask.select(*AT), halo, run, _at_fields(mask))


def _reach(steps) -> int:
    return max(max(abs(y), abs(x)) for y, x in steps)


def dilate(mask: DataFrame, size: int, steps=None) -> DataFrame:
    steps = steps or DISK2
    return _shapes(mask, size, _reach(steps), lambda here, _: B.widened(here, steps))


def erode(mask: DataFrame, size: int, steps=None) -> DataFrame:
    """Pixels all of whose neighbours inside the tile are foreground."""
    steps = steps or DISK2
    return _shapes(mask, size, _reach(steps), lambda here, within: B.narrowed(here, within, steps))


def _closed(here: np.ndarray, within: np.ndarray) -> np.ndarray:
    return B.narrowed(B.widened(here, DISK2) & within, within, DISK2)


def closing(mask: DataFrame, size: int) -> DataFrame:
    """Dilation, then erosion, with a disk of radius 2, in one pass over blocks; ``size`` is the side of the tiles."""
    return _shapes(mask, size, 4, _closed)


def _labelled(mask: DataFrame, steps=None, nodes: bool = False) -> tuple[DataFrame, DataFrame | None]:
    """(tile_id, r, c, comp, n) of pixels connected in each block, stored, and (graph_id, node, comp) of the ones that go on.

    ``n`` counts the pixels of what ends in its block, and is null else. Blocks are linked by pixels on their borders only:
    the second table renames ``comp``; it is null where no block goes on. With ``nodes`` only ``node_pixels`` count.
    """
    half = [s for s in (steps or FOUR) if s > (0, 0)]
    around = half + [(-y, -x) for y, x in half]
    halo = 2 if nodes else 1

    def work(here, top, left):
        if nodes:
            n = _counts(here)
            here = B.inner(here & ((n == 1) | (n >= 3)), 1)
        core = B.inner(here, 1)
        flat, root = B.connected(core, half)
        block, place = np.divmod(flat, core.shape[1] * core.shape[2])
        r, c = place // core.shape[2] + top[block], place % core.shape[2] + left[block]
        node = r * BIG + c
        ring = here.copy()
        B.inner(ring, 1)[...] = False
        mine, other = [], []
        if ring.any():
            number = np.full(core.shape, -1, np.int64)
            number.ravel()[flat] = np.arange(len(flat))
            for y, x in around:
                on = core & B.inner(B.moved(ring, y, x), 1)
                found = number[on]
                mine.append(found)
                other.append(node[found] + y * BIG + x)
        mine, other = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (mine, other))
        going = np.zeros(len(flat), bool)
        going[root[mine]] = True
        size = np.bincount(root, minlength=len(flat))[root]
        k = len(flat)
        blank = np.zeros(len(mine), np.int64)
        gone = np.arange(k + len(mine)) >= k
        columns = [pa.array(np.append(x, blank), pa.int32(), mask=gone) for x in (r, c)]
        count = pa.array(np.append(size, blank), pa.int64(), mask=np.append(going[root], blank == 0))
        link = [pa.array(np.append(np.zeros(k, np.int64), x), pa.int64(), mask=~gone) for x in (node[mine], other)]
        return np.append(block, block[mine]), [*columns, np.append(node[root], node[root[mine]]), count, *link]

    integer, long = T.IntegerType(), T.LongType()
    fields = [("r", integer), ("c", integer), ("comp", long), ("n", long), ("src", long), ("dst", long)]
    found, seen = observed(B.on_blocks(mask.select(*AT), halo, work, fields), "objects", links=F.count("src"))
    pixels = found.filter("src is null").drop("src", "dst")
    if not seen["links"]:
        return pixels, None
    links = found.filter("src is not null")
    edges = links.select(F.col("tile_id").alias("graph_id"), F.col("comp").alias("src"), F.col("src").alias("dst")).union(links.select("tile_id", "src", "dst"))
    return pixels, stored(connected_components(edges.distinct()), "joined")


def _whole(pixels: DataFrame, joined: DataFrame | None) -> DataFrame:
    """``pixels`` of ``_labelled`` with the ``comp`` of their tile."""
    if joined is None:
        return pixels
    new = joined.select(F.col("graph_id").alias("tile_id"), F.col("node").alias("comp"), F.col("comp").alias("_comp"))
    return pixels.join(new.hint("merge"), ["tile_id", "comp"], "left").withColumn("comp", F.coalesce("_comp", "comp")).drop("_comp")


def pixel_components(mask: DataFrame, steps=None) -> DataFrame:
    """(tile_id, r, c, comp) of connected pixels, over four neighbours or the given steps, each with its opposite.

    Connected in blocks first; what goes on beyond a block is joined by components of the pixels on its border.
    """
    return _whole(*_labelled(mask, steps)).select(*AT, "comp")


def drop_small(mask: DataFrame, least: int = 64) -> DataFrame:
    """Without objects of fewer than ``least`` pixels."""
    pixels, joined = _labelled(mask)
    ended = pixels.filter(F.col("n") >= least).select(*AT)
    if joined is None:
        return ended
    going = stored(_whole(pixels.filter("n is null"), joined), "going")
    large = going.groupBy("tile_id", "comp").agg(F.count(F.lit(1)).alias("m")).filter(F.col("m") >= least)
    return ended.union(going.join(large.hint("merge"), ["tile_id", "comp"], "left_semi").select(*AT))


def _filled(here: np.ndarray, within: np.ndarray, least: int) -> np.ndarray:
    return here | (within & ~here & ~B.without_small(within & ~here, [(0, 1), (1, 0)], least))


def fill_holes(mask: DataFrame, size: int, least: int = 64, widen=()) -> DataFrame:
    """With background objects of fewer than ``least`` pixels filled; tiles that fit into a block are filled there.

    With steps ``widen`` the mask is dilated by them first, in the same pass.
    """
    if size <= B.BLOCK:
        return _shapes(mask, size, 0, lambda here, within: _filled(B.widened(here, widen) & within if widen else here, within, least))
    mask = stored(dilate(mask, size, widen), "mask") if widen else mask
    span = F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    grid = mask.select("tile_id").distinct().withColumn("r", span).withColumn("c", span)
    back = stored(grid.join(mask.select(*AT).hint("merge"), AT, "left_anti"), "background")
    return grid.join(drop_small(back, least).hint("merge"), AT, "left_anti")


def cleaned(mask: DataFrame, size: int, least: int = 64) -> DataFrame:
    """Closing, then removal of small objects and of small holes; in one pass for tiles that fit into a block."""
    if size > B.BLOCK:
        return fill_holes(stored(drop_small(closing(mask, size), least), "large"), size, least)
    return _shapes(mask, size, 0, lambda here, within: _filled_if(B.without_small(_closed(here, within), [(0, 1), (1, 0)], least), within, least))


def _filled_if(here: np.ndarray, within: np.ndarray, least: int) -> np.ndarray:
    """``_filled``, but tiles without a pixel stay empty."""
    return _filled(here, within, least) & here.any(axis=(1, 2), keepdims=True)


def thin(mask: DataFrame, most_rounds: int = 1000, block: int = B.BLOCK, halo: int = HALO) -> DataFrame:
    """Thinned to lines by the two sub-iterations of Zhang and Suen (1984) until nothing changes.

    Tiles are cut into blocks of ``block`` x ``block`` pixels, each with what lies around it, ``halo`` wide. What a pixel
    becomes in a sub-iteration depends on its neighbours only, so ``halo`` of them are right inside a block before its
    surroundings have to be dealt anew: ``halo`` / 2 rounds cost one exchange, whatever the size of tiles. Blocks with
    nothing around them are thinned to the end at once.
    """

    def work(here, top, left):
        here[~B.inner(here, halo).any(axis=(1, 2))] = False  # nothing to delete
        ring = here.copy()
        B.inner(ring, halo)[...] = False
        alone = ~ring.any(axis=(1, 2))
        here[alone] = B.settled(here[alone], _thinned)
        late = np.zeros(len(here), np.int64)
        open_ = here[~alone]
        for step in range(halo if len(open_) else 0):
            gone = _thinned(open_, step % 2)
            if step >= halo - 2:
                late[~alone] += B.inner(gone, halo).sum(axis=(1, 2))
            open_ &= ~gone
        here[~alone] = open_
        number, (r, c) = B.places(B.inner(here, halo), top, left)
        odd = np.flatnonzero(late)
        none = np.arange(len(r) + len(odd)) >= len(r)
        columns = [pa.array(np.append(x, odd), to_arrow_type(kinds[k]), mask=none) for k, x in (("r", r), ("c", c))]
        return np.append(number, odd), [*columns, np.append(np.zeros(len(r), np.int64), late[odd])]

    kinds = dict(_at_fields(mask))
    own = mask.select(*AT)
    for k in range(-(-2 * most_rounds // halo)):
        dealt = B.on_blocks(own, halo, work, [*_at_fields(mask), ("late", T.LongType())], block)
        marked, seen = observed(dealt, "thin", late=F.coalesce(F.sum("late"), F.lit(0)))
        if k:
            drop_stored(own)
        own = marked.filter("r is not null").drop("late")
        if not seen["late"]:
            return own
    raise RuntimeError("thinning did not settle")


def _thinned(here: np.ndarray, half: int) -> np.ndarray:
    """What one sub-iteration deletes; beyond the arrays there is nothing."""
    p = [B.moved(here, y, x) for y, x in EIGHT]  # from the north, clockwise
    count = sum(x.astype(np.uint8) for x in p)
    turns = sum((~p[k] & p[(k + 1) % 8]).astype(np.uint8) for k in range(8))
    north, east, south, west = p[0], p[2], p[4], p[6]
    free = ~(north & east & south) & ~(east & south & west) if half == 0 else ~(north & east & west) & ~(north & south & west)
    return here & (count >= 2) & (count <= 6) & (turns == 1) & free


def half_width(mask: DataFrame, size: int, columns: int = COLUMNS, widen=()) -> DataFrame:
    """(tile_id, r, c, d): Euclidean distance to the nearest background pixel of the tile, null if it has none.

    Exact, in two passes (as Felzenszwalb and Huttenlocher 2012): the nearest background of a pixel's row, by the ends of its
    run; then of each column the least of that, squared, and the squared distance of its row. Columns of many tiles are
    searched outward together, until no row that far could be nearer. Tiles that fit into a block take both passes there.
    With steps ``widen`` the mask is dilated by them first.
    """
    if size <= B.BLOCK:
        return _half_width_in_blocks(mask, size, widen)
    mask = stored(dilate(mask, size, widen), "mask") if widen else mask
    row = Window.partitionBy("tile_id", "r").orderBy("c")
    run = Window.partitionBy("tile_id", "r", "run")
    own = mask.select(*AT).distinct().withColumn("run", F.col("c") - F.row_number().over(row))
    before, behind = F.min("c").over(run) - 1, F.max("c").over(run) + 1
    ends = own.withColumns({"a": F.when(before >= 0, F.col("c") - before), "b": F.when(behind < size, behind - F.col("c"))})
    near = ends.select(*AT, F.least("a", "b").cast("double").alias("near")).repartition("tile_id", "c").sortWithinPartitions("tile_id", "c")
    kinds = {f.name: f.dataType for f in mask.schema.fields}
    schema = T.StructType([T.StructField(c, kinds[c]) for c in AT] + [T.StructField("d", T.DoubleType())])

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in B.whole_groups(batches, columns, ["tile_id", "c"]):
            tile, r, c = table.column("tile_id"), table.column("r").to_numpy(), table.column("c").to_numpy()
            near = table.column("near").to_numpy(zero_copy_only=False)
            new = np.append(True, (c[1:] != c[:-1]) | pc.not_equal(tile[1:], tile[:-1]).to_numpy(zero_copy_only=False))
            which = np.cumsum(new) - 1
            least = np.zeros((which[-1] + 1, size))  # background is 0 away
            least[which, r] = np.where(np.isnan(near), np.inf, near * near)
            first = least.copy()
            for step in range(1, size):
                if step * step >= least.max():
                    break
                np.minimum(least[:, step:], first[:, :-step] + step * step, out=least[:, step:])
                np.minimum(least[:, :-step], first[:, step:] + step * step, out=least[:, :-step])
            found = np.sqrt(least[which, r])
            yield pa.RecordBatch.from_arrays([*(table.column(x).combine_chunks() for x in AT), pa.array(found, pa.float64(), mask=np.isinf(found))], names=[*AT, "d"])

    return near.mapInArrow(search, schema)


def _half_width_in_blocks(mask: DataFrame, size: int, widen) -> DataFrame:
    def work(here, top, left):
        here = here[:, :size, :size]
        here = B.widened(here, widen) if widen else here
        at = np.arange(size)
        far = 4 * size
        before = np.maximum.accumulate(np.where(here, -far, at), axis=2)
        behind = np.minimum.accumulate(np.where(here, at + far, at)[:, :, ::-1], axis=2)[:, :, ::-1]
        behind = np.where(behind >= size, far + at, behind)
        near = np.minimum(at - before, behind - at)
        first = np.where(near >= size, 1 << 40, near * near)
        least = first.copy()
        for step in range(1, size):
            if step * step >= least.max():
                break
            np.minimum(least[:, step:], first[:, :-step] + step * step, out=least[:, step:])
            np.minimum(least[:, :-step], first[:, step:] + step * step, out=least[:, :-step])
        number, places = B.places(here, top, left)
        found = least[here]
        return number, [*places, pa.array(np.sqrt(found), pa.float64(), mask=found >= 1 << 40)]

    return B.on_blocks(mask.select(*AT), 0, work, [*_at_fields(mask), ("d", T.DoubleType())])


def within(mask: DataFrame, other: DataFrame, tolerance: int) -> DataFrame:
    """The pixels of ``mask`` that have a pixel of ``other`` at ``tolerance`` or less, as the crow flies.

    Each pixel asks the rows up to ``tolerance`` above and below for their nearest pixel to the left and to the right.
    """
    ask = mask.select(*AT).distinct().withColumn("dy", F.explode(F.sequence(F.lit(-tolerance), F.lit(tolerance))))
    ask = ask.select("tile_id", (F.col("r") + F.col("dy")).alias("r"), "c", F.col("dy").cast("int").alias("dy"))
    both = ask.union(other.select(*AT).distinct().withColumn("dy", F.lit(None).cast("int")))
    row = Window.partitionBy("tile_id", "r").orderBy("c", F.col("dy").isNotNull())
    there = F.when(F.col("dy").isNull(), F.col("c"))
    left = F.last(there, True).over(row.rowsBetween(Window.unboundedPreceding, 0))
    right = F.first(there, True).over(row.rowsBetween(0, Window.unboundedFollowing))
    away = F.least(F.col("c") - left, right - F.col("c"))
    near = both.withColumn("away", away).filter(F.col("dy").isNotNull() & (F.col("away") * F.col("away") + F.col("dy") * F.col("dy") <= tolerance * tolerance))
    return near.select("tile_id", (F.col("r") - F.col("dy")).alias("r"), "c").distinct()


def relaxed_iou(pred: DataFrame, target: DataFrame, tolerance: int = 3) -> DataFrame:
    """(tile_id, precision, recall, relaxed_iou) where a pixel is right if the other mask has one within ``tolerance``.

    With m and k the pixels of prediction and target that are right so, relaxed IoU is m / (predicted + target - k): all
    that is predicted, and what of the target is missed. Tiles that one mask lacks score 0; a share of nothing is 1.
    """
    layer = lambda df, k: df.select(*AT, F.lit(k).alias("layer"))
    disk = [(y, x) for y in range(-tolerance, tolerance + 1) for x in range(-tolerance, tolerance + 1) if y * y + x * x <= tolerance * tolerance]

    def work(here, top, left):
        own = B.inner(here, tolerance)
        near = B.inner(np.stack([B.widened(here[:, 1], disk), B.widened(here[:, 0], disk)], axis=1), tolerance)
        every, hits = own.sum(axis=(2, 3)), (own & near).sum(axis=(2, 3))
        return np.arange(len(here)), [every[:, 0], every[:, 1], hits[:, 0], hits[:, 1]]

    parts = B.on_blocks(layer(pred, 0).union(layer(target, 1)), tolerance, work, [(x, T.LongType()) for x in "ptmk"])
    both = parts.groupBy("tile_id").agg(*[F.sum(x).alias(x) for x in "ptmk"])
    share = lambda a, b: F.when(b == 0, 1.0).otherwise(a / b)
    p, t, m, k = (F.col(x) for x in "ptmk")
    return both.select("tile_id", share(m, p).alias("precision"), share(k, t).alias("recall"), share(m, p + t - k).alias("relaxed_iou"))


def connectivity_labels(mask: DataFrame) -> DataFrame:
    """(tile_id, r, c, n, ne, e, se, s, sw, w, nw): whether the neighbour in each direction is foreground too."""
    names = ["n", "ne", "e", "se", "s", "sw", "w", "nw"]

    def work(here, top, left):
        core = B.inner(here, 1)
        number, at = B.places(core, top, left)
        return number, [*at, *[B.inner(B.moved(here, y, x), 1)[core] for y, x in EIGHT]]

    return B.on_blocks(mask.select(*AT), 1, work, [*_at_fields(mask), *[(x, T.BooleanType()) for x in names]])


# --- from lines to networks ----------------------------------------------------------------------------------------


def junction_clusters(mask: DataFrame) -> DataFrame:
    """(tile_id, cluster, r, c, size): adjacent node pixels as one node, at the member nearest their centroid."""
    own = _whole(*_labelled(mask, EIGHT, nodes=True)).select(*AT, "comp")
    mid = own.groupBy("tile_id", "comp").agg(F.avg("r").alias("my"), F.avg("c").alias("mx"), F.count(F.lit(1)).alias("size"))
    d2 = F.round(F.pow(F.col("r") - F.col("my"), 2) + F.pow(F.col("c") - F.col("mx"), 2), 9)
    best = own.join(mid.hint("merge"), ["tile_id", "comp"]).groupBy("tile_id", F.col("comp").alias("cluster"), "size").agg(F.min(F.struct(d2, "r", "c")).alias("x"))
    return best.select("tile_id", "cluster", F.col("x.r").alias("r"), F.col("x.c").alias("c"), "size")


# --- occlusion -----------------------------------------------------------------------------------------------------


def soft_blobs(pixels: DataFrame, blobs: DataFrame) -> DataFrame:
    """``pixels`` with ``alpha``: the largest of Gaussian ``blobs(tile_id, y, x, sigma, peak)``, within [0, 1]."""
    d2 = F.pow(F.col("r") - F.col("y"), 2) + F.pow(F.col("c") - F.col("x"), 2)
    top = pixels.select(*AT).join(blobs, "tile_id").groupBy(*AT).agg(F.max(F.col("peak") * F.exp(-d2 / (2 * F.col("sigma") * F.col("sigma")))).alias("alpha"))
    return pixels.join(top, AT, "left").withColumn("alpha", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("alpha", F.lit(0.0)))))


# The grey that each kind of cover blends to.
COVER = {"cloud": 255.0, "shadow": 0.0, "canopy": 110.0}


def cover(value: Column, alpha: Column, kind: str, strength: float = 1.0) -> Column:
    """A channel under cover, cut to a whole number."""
    share = alpha * strength
    return F.floor(value * (1 - share) + COVER[kind] * share).cast("int")


# How often each effect is drawn, and any at all.
GATES = {"cloud": 0.6, "shadow": 0.7, "canopy": 0.7, "building": 0.3}
ANY_GATE = 0.9


def occlusion_plan(tiles: DataFrame, seed: int = 0) -> DataFrame:
    """(tile_id, effect) drawn for each tile by hashes of seed, tile and effect."""
    drawn = [F.when(hash_unit(F.lit(seed), "tile_id", F.lit(k)) < p, F.lit(k)) for k, p in GATES.items()]
    gated = tiles.filter(hash_unit(F.lit(seed), "tile_id", F.lit("any")) < ANY_GATE)
    return gated.select("tile_id", F.explode(F.array_compact(F.array(*drawn))).alias("effect"))
