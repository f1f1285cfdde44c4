import numpy as np
import pytest
from pyspark.sql import functions as F

from viaduct.operators import blocks, raster, vectorize

TALL = 300


def mask(spark, a, tile="t"):
    return spark.createDataFrame([(tile, int(r), int(c)) for r, c in zip(*np.nonzero(a), strict=True)], "tile_id string, r int, c int")


def cells(df):
    return {(r.r, r.c) for r in df.collect()}


def drawn(share, side=TALL, seed=5):
    return np.random.default_rng(seed).random((side, side)) < share


def parts(a, steps):
    """Components by flood, as {pixel: least pixel}."""
    found, left = {}, set(zip(*(x.tolist() for x in np.nonzero(a)), strict=True))
    while left:
        todo, own = [left.pop()], set()
        while todo:
            at = todo.pop()
            own.add(at)
            for y, x in steps:
                to = (at[0] + y, at[1] + x)
                if to in left:
                    left.remove(to)
                    todo.append(to)
        found |= dict.fromkeys(own, min(own))
    return found


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_closing_shuffles_pixels_once_and_joins_nothing(spark):
    own = plan(raster.closing(mask(spark, drawn(0.05)), TALL))
    assert own.count("Exchange") == 1 and "Join" not in own and "HashAggregate" not in own


@pytest.mark.parametrize("steps", [raster.FOUR, raster.EIGHT])
def test_components_that_cross_blocks(spark, steps):
    a = drawn(0.55 if steps == raster.FOUR else 0.38)
    a[130, :] = True
    got = {(r.r, r.c): divmod(r.comp, raster.BIG) for r in raster.pixel_components(mask(spark, a), steps).collect()}
    assert got == parts(a, steps)


def test_small_objects_holes_and_clusters_across_blocks(spark):
    a = drawn(0.5)
    label = parts(a, raster.FOUR)
    sizes = {k: list(label.values()).count(k) for k in set(label.values())}
    assert cells(raster.drop_small(mask(spark, a), 9)) == {p for p, k in label.items() if sizes[k] >= 9}
    back = parts(~a, raster.FOUR)
    sizes = {k: list(back.values()).count(k) for k in set(back.values())}
    filled = {p for p, k in back.items() if sizes[k] < 9} | set(label)
    assert cells(raster.fill_holes(mask(spark, a), TALL, 9)) == filled
    n = sum(np.pad(a, 1)[1 + y : 301 + y, 1 + x : 301 + x].astype(int) for y, x in raster.EIGHT)
    ends = a & ((n == 1) | (n >= 3))
    assert cells(raster.node_pixels(mask(spark, a))) == set(zip(*(x.tolist() for x in np.nonzero(ends)), strict=True))
    nodes = raster.junction_clusters(mask(spark, a)).agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).first()
    assert (nodes.n, nodes.size) == (len(set(parts(ends, raster.EIGHT).values())), ends.sum())


def test_blocks_do_not_change_what_is_thinned_closed_or_measured(spark, monkeypatch):
    a = drawn(0.3, 100)
    own = mask(spark, a)
    closed, width = cells(raster.closing(own, 100)), {(r.r, r.c): r.d for r in raster.half_width(own, 100).collect()}
    thinned, clean = cells(raster.thin(own)), cells(raster.cleaned(own, 100, 9))
    near = raster.relaxed_iou(own, mask(spark, drawn(0.1, 100, 6))).first()
    for name in ("on_blocks", "BLOCK"):
        old = getattr(blocks, name)
        monkeypatch.setattr(blocks, name, 32 if name == "BLOCK" else lambda *x, old=old: old(*x[:4], 32))
    assert cells(raster.closing(own, 100)) == closed
    assert {(r.r, r.c): r.d for r in raster.half_width(own, 100).collect()} == pytest.approx(width)
    assert cells(raster.thin(own, block=32)) == thinned
    assert cells(raster.cleaned(own, 100, 9)) == clean
    assert raster.relaxed_iou(own, mask(spark, drawn(0.1, 100, 6))).first() == near


def test_pixels_are_never_broadcast_on_the_way_to_a_network(spark):
    a = np.zeros((40, 40), bool)
    a[20, 5:35] = a[5:35, 20] = True
    seen = []
    old = vectorize.stored
    vectorize.stored = lambda df, *x: (seen.append(plan(df)), old(df, *x))[1]
    try:
        nodes, edges = vectorize.skeleton_to_network(mask(spark, a))
    finally:
        vectorize.stored = old
    assert edges.count() == 4 and nodes.count() == 5
    assert not any("BroadcastHashJoin" in p for p in seen)
