"""Cover drawn over images: clouds, shadows, canopies and buildings, reproducible from seed, tile and effect.

Images are pixel rows (tile_id, r, c, red, green, blue). Every number drawn is a hash of its name, so that any engine
and any partitioning draws the same. A tile has a few blobs and buildings at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from viaduct.functions.scalars import hash_unit
from viaduct.operators.raster import AT, GATES, occlusion_plan, soft_blobs

CHANNELS = ("red", "green", "blue")
# Of soft covers least and most blobs, least and most radius as a share of the shorter side, strength, colour.
SOFT = {
    "cloud": (1, 3, 0.08, 0.22, 0.9, (255, 255, 255)),
    "shadow": (2, 5, 0.04, 0.12, 0.55, (0, 0, 0)),
    "canopy": (3, 7, 0.03, 0.09, 0.6, (0, 110, 0)),
}
# Of buildings least and most, sides as shares, strength, colour, offset of the shadow and what it leaves.
BUILDINGS, SIDES, SOLID, CONCRETE, OFFSET, SHADE = (2, 5), (0.06, 0.20), 0.85, (70, 72, 78), 0.4, 0.5


def _draw(seed: int, effect: str, name: str, i: Column | None = None) -> Column:
    parts = [F.lit(seed), F.col("tile_id"), F.lit(effect), F.lit(name), *([i] if i is not None else [])]
    return hash_unit(*parts)


def _numbered(tiles: DataFrame, seed: int, effect: str, least: int, most: int) -> DataFrame:
    """``tiles`` once for each of the things drawn on it, numbered from 0."""
    n = least + F.floor(_draw(seed, effect, "n") * (most - least + 1)).cast("int")
    return tiles.withColumn("i", F.explode(F.sequence(F.lit(0), n - 1)))


def draw_blobs(tiles: DataFrame, effect: str, seed: int = 0) -> DataFrame:
    """(tile_id, y, x, sigma, peak) of a soft cover over ``tiles(tile_id, h, w)``."""
    least, most, low, high, _, _ = SOFT[effect]
    own = _numbered(tiles, seed, effect, least, most)
    at = {name: _draw(seed, effect, name, F.col("i")) for name in ("y", "x", "radius")}
    sigma = (low + at["radius"] * (high - low)) * F.least("h", "w")
    return own.select("tile_id", (at["y"] * F.col("h")).alias("y"), (at["x"] * F.col("w")).alias("x"), sigma.alias("sigma"), F.lit(1.0).alias("peak"))


def soft_cover(pixels: DataFrame, tiles: DataFrame, effect: str, seed: int = 0) -> DataFrame:
    """``pixels`` under the blobs of an effect, each channel blended to its colour and cut to a whole number."""
    *_, strength, colour = SOFT[effect]
    found = soft_blobs(pixels, draw_blobs(tiles, effect, seed))
    a = F.round("alpha", 6) * strength
    blend = [F.floor(F.round(F.col(c) * (1 - a) + to * a, 6)).cast("int").alias(c) for c, to in zip(CHANNELS, colour, strict=True)]
    return found.select(*AT, *blend)


def draw_buildings(tiles: DataFrame, seed: int = 0) -> DataFrame:
    """(tile_id, ord, y0, x0, y1, x1, building): blocks and, each before its block, their shadows to the lower right."""
    own = _numbered(tiles, seed, "building", *BUILDINGS)
    u = {name: _draw(seed, "building", name, F.col("i")) for name in ("height", "width", "y", "x")}
    side = lambda name, n: F.floor((SIDES[0] + u[name] * (SIDES[1] - SIDES[0])) * F.col(n)).cast("int")
    own = own.withColumns({"bh": side("height", "h"), "bw": side("width", "w")})
    own = own.withColumns({"y0": F.floor(u["y"] * F.greatest(F.lit(1), F.col("h") - F.col("bh"))).cast("int"), "x0": F.floor(u["x"] * F.greatest(F.lit(1), F.col("w") - F.col("bw"))).cast("int")})
    dy, dx = (F.floor(F.round(F.col(c) * OFFSET, 6)).cast("int") for c in ("bh", "bw"))
    box = lambda k, y, x, solid: F.struct((2 * F.col("i") + k).alias("ord"), (F.col("y0") + y).alias("y0"), (F.col("x0") + x).alias("x0"), (F.col("y0") + y + F.col("bh")).alias("y1"), (F.col("x0") + x + F.col("bw")).alias("x1"), F.lit(solid).alias("building"))
    return own.select("tile_id", F.explode(F.array(box(0, dy, dx, False), box(1, F.lit(0), F.lit(0), True))).alias("b")).select("tile_id", "b.*")


def building_cover(pixels: DataFrame, tiles: DataFrame, seed: int = 0) -> DataFrame:
    """``pixels`` under buildings and their shadows, one after the other as they were drawn."""
    hit = pixels.join(draw_buildings(tiles, seed), "tile_id").filter(F.col("r").between(F.col("y0"), F.col("y1") - 1) & F.col("c").between(F.col("x0"), F.col("x1") - 1))
    layers = hit.groupBy(*AT).agg(F.sort_array(F.collect_list(F.struct("ord", "building"))).alias("layers"))  # ten at most
    own = pixels.join(layers, AT, "left")

    def covered(c: str, to: int) -> Column:
        solid = lambda v: v * (1 - SOLID) + to * SOLID
        out = F.aggregate("layers", F.col(c).cast("double"), lambda v, x: F.when(x["building"], solid(v)).otherwise(v * (1 - SHADE)))
        whole = F.floor(F.round(F.greatest(F.lit(0.0), F.least(F.lit(255.0), out)), 6)).cast("int")
        return F.when(F.col("layers").isNotNull(), whole).otherwise(F.col(c)).alias(c)

    return own.select(*AT, *[covered(c, to) for c, to in zip(CHANNELS, CONCRETE, strict=True)])


#: The effects by name; each takes pixels, the tiles to cover and a seed.
OCCLUDERS: dict[str, Callable[[DataFrame, DataFrame, int], DataFrame]] = {
    "cloud": lambda pixels, tiles, seed=0: soft_cover(pixels, tiles, "cloud", seed),
    "shadow": lambda pixels, tiles, seed=0: soft_cover(pixels, tiles, "shadow", seed),
    "canopy": lambda pixels, tiles, seed=0: soft_cover(pixels, tiles, "canopy", seed),
    "building": building_cover,
}


def random_occlude(pixels: DataFrame, tiles: DataFrame, seed: int = 0) -> DataFrame:
    """``pixels`` of ``tiles(tile_id, h, w)`` under the effects that ``occlusion_plan`` draws for each, in their order."""
    plan = occlusion_plan(tiles, seed)
    for effect in GATES:
        drawn = tiles.join(plan.filter(F.col("effect") == effect), "tile_id", "left_semi")
        pixels = OCCLUDERS[effect](pixels, drawn, seed)
    return pixels
