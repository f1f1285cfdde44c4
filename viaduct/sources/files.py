"""Raster files, pairs of images and masks, and manifests."""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.functions.scalars import assign_split, scene_id, unit_interval
from viaduct.operators.raster import chip_name, cut_tiles, tile_offsets
from viaduct.session import has_files, ready, remove, stored
from viaduct.sources.json_items import list_files, read_range
from viaduct.sources.named_files import write_files

ROWS = "tile_id string, r int, vals array<float>"
#: Bytes of a raster that a task reads at once; the folder of the manifest; files whose headers a task reads.
PIECE_BYTES, MANIFEST, TASK_FILES = 8 << 20, "manifest.csv", 512
#: Labels whose names a task cuts into pieces, about.
TASK_LABELS = 10_000


def read_raster_npy(spark: SparkSession, path: str, piece_bytes: int = PIECE_BYTES) -> DataFrame:
    """(tile_id, r, vals): the rows of .npy rasters at or below ``path``; three-dimensional ones become the mean of three.

    A large raster is read by many tasks, some rows each; only one in column order is read by a single one. Of small ones
    a task reads many.
    """
    listed = [(name, size) for name, size in list_files(path) if name.endswith(".npy")]
    if not listed:
        return spark.createDataFrame([], ROWS)

    def pieces(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, size in zip(part["path"], part["size"], strict=True):
                shape, by_column, kind, start = _npy_header(name, size)
                width = int(np.prod(shape[1:])) * kind.itemsize
                step = shape[0] if by_column else max(1, piece_bytes // max(1, width))
                first = np.arange(0, shape[0], max(1, step), dtype=np.int64)
                yield pd.DataFrame({"path": name, "start": start, "first": first, "rows": np.minimum(step, shape[0] - first), "shape": [list(shape)] * len(first), "by_column": by_column, "kind": kind.str})

    def load(parts: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for row in part.to_dict("records"):
                shape, kind = tuple(int(n) for n in row["shape"]), np.dtype(row["kind"])
                width = int(np.prod(shape[1:])) * kind.itemsize
                at = row["start"] + (0 if row["by_column"] else row["first"] * width)
                flat = np.frombuffer(read_range(row["path"], at, at + row["rows"] * width), kind)
                a = flat.reshape(shape, order="F") if row["by_column"] else flat.reshape(row["rows"], *shape[1:])
                a = a[..., :3].mean(axis=2) if a.ndim == 3 else a
                r = np.arange(row["first"], row["first"] + len(a), dtype=np.int32)
                yield pd.DataFrame({"path": row["path"], "r": r, "vals": list(a.astype(np.float32))})

    files = ready(spark).createDataFrame(listed, "path string, size long").repartition(-(-len(listed) // TASK_FILES))
    cut = files.mapInPandas(pieces, "path string, start long, first long, rows long, shape array<long>, by_column boolean, kind string")
    rows = cut.repartition("path", "first").mapInPandas(load, "path string, r int, vals array<float>")
    return rows.select(scene_id("path").alias("tile_id"), "r", "vals")


def _npy_header(path: str, size: int) -> tuple[tuple[int, ...], bool, np.dtype, int]:
    """Shape, whether columns come first, type of the values, and where they start."""
    head = io.BytesIO(read_range(path, 0, min(size, 1 << 16)))
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    version = np.lib.format.read_magic(head)
    if version not in read:
        raise ValueError(f"{path}: unknown version {version} of .npy")
    shape, by_column, kind = read[version](head)
    if kind.hasobject or len(shape) not in (2, 3):
        raise ValueError(f"{path}: no raster of numbers, but {kind} of {len(shape)} dimensions")
    return shape, by_column, kind, head.tell()


def to_pixels(rows: DataFrame) -> DataFrame:
    """(tile_id, r, c, v) of raster rows."""
    return rows.select("tile_id", "r", F.posexplode("vals").alias("c", "v"))


def score_tiles(rows: DataFrame, predict: Callable[[np.ndarray], np.ndarray] | None = None) -> DataFrame:
    """Masks (tile_id, r, c) that ``predict(image)`` makes of each tile; by default what is brighter than its mean.

    The mean is a double: one in the values' own precision may round past a pixel next to it.
    """
    model = predict or (lambda image: image > image.mean(dtype=np.float64))

    def score(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r")
        y, x = np.nonzero(model(np.stack(part["vals"].to_list())))
        return pd.DataFrame({"tile_id": part["tile_id"].iloc[0], "r": y.astype(np.int32), "c": x.astype(np.int32)})

    return rows.groupBy("tile_id").applyInPandas(score, "tile_id string, r int, c int")  # one tile at a time


def pair_by_scene(images: DataFrame, masks: DataFrame) -> DataFrame:
    """(scene_id, image_path, mask_path): every image with the last mask, by path, of its scene, or null."""
    last = masks.select(scene_id("path").alias("scene_id"), "path").groupBy("scene_id").agg(F.max("path").alias("mask_path"))
    return images.select(scene_id("path").alias("scene_id"), F.col("path").alias("image_path")).join(last, "scene_id", "left")


def pair_by_suffix(files: DataFrame, image: str = "_sat.jpg", mask: str = "_mask.png") -> DataFrame:
    """(key, image_path, mask_path) of files that differ in their suffix; images without a mask are dropped."""
    a = files.filter(F.col("path").endswith(image)).select(F.expr(f"substr(path, 1, length(path) - {len(image)})").alias("key"), F.col("path").alias("image_path"))
    b = files.filter(F.col("path").endswith(mask)).select(F.expr(f"substr(path, 1, length(path) - {len(mask)})").alias("key"), F.col("path").alias("mask_path"))
    return a.join(b, "key")


def match_labels(images: DataFrame, labels: DataFrame, image_dir: str = "PS-RGB", label_dir: str = "geojson_roads") -> DataFrame:
    """(path, label_path): each image with its label in the folder ``label_dir`` beside the image's own folder, or null.

    That is the one whose name is the image's with ``image_dir`` in it replaced by ``label_dir``, else the least by path
    that has the token of the image, what follows the last bar of its name, anywhere before its suffix. Labels of other
    areas do not count. Tokens are found by the pieces of names that have the length of some token, not by comparing all
    images and labels of a folder.
    """
    name, folder = F.element_at(F.split("path", "/"), -1), F.regexp_replace("path", r"[^/]*/[^/]*$", "")
    stem = F.regexp_replace("_name", r"^(.+)\.[^.]+$", "$1")
    own = images.select("path", name.alias("_name"), F.concat(folder, F.lit(label_dir)).alias("_dir")).withColumn("_stem", stem)
    same = F.regexp_replace(F.replace("_stem", F.lit(image_dir), F.lit(label_dir)), r"^(.+)\.[^.]+$", "$1")
    own = own.select("path", "_dir", F.concat(same, F.lit(".geojson")).alias("_same"), F.element_at(F.split("_stem", "_"), -1).alias("_token"))
    there = labels.select(F.col("path").alias("label_path"), F.regexp_replace("path", r"/[^/]*$", "").alias("_dir"), name.alias("_label")).filter(F.col("_label").endswith(".geojson"))
    found = own.join(there.select("_dir", F.col("_label").alias("_same"), F.col("label_path").alias("_direct")), ["_dir", "_same"], "left")
    sizes = own.select(F.length("_token").alias("_size")).distinct()  # as many as names have lengths
    parts = max(int(images.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-there.count() // TASK_LABELS))
    dealt = there.repartition(parts, "label_path")  # a label has very many pieces, which are sorted in its task
    stems = dealt.crossJoin(F.broadcast(sizes)).withColumn("_stem", F.expr("substr(_label, 1, length(_label) - 8)")).filter("length(_stem) >= _size")
    starts = F.sequence(F.lit(1), F.length("_stem") - F.col("_size") + 1)
    pieces = stems.select("_dir", "label_path", F.explode(F.array_distinct(F.transform(starts, lambda i: F.col("_stem").substr(i, F.col("_size"))))).alias("_token"))
    other = pieces.groupBy("_dir", "_token").agg(F.min("label_path").alias("_other"))
    return found.join(other, ["_dir", "_token"], "left").select("path", F.coalesce("_direct", "_other").alias("label_path"))


def manifest(pairs: DataFrame, tiles: DataFrame, salt: str = "") -> DataFrame:
    """Chips by scene, row and column with their split; ``tiles`` are those of ``tile_offsets``."""
    own = pairs.join(tiles, "scene_id").withColumn("split", assign_split(unit_interval("scene_id", salt)))
    return own.select("scene_id", "split", "row", "col", "image_path", "mask_path")


def write_manifest(chips: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; a missing mask is an empty field."""
    chips.withColumn("mask_path", F.coalesce("mask_path", F.lit(""))).write.mode(mode).option("header", True).option("emptyValue", "").csv(path)


def scan_manifest(spark: SparkSession, path: str, split: str) -> DataFrame:
    rows = ready(spark).read.option("header", True).csv(path).filter(F.col("split") == split)
    return rows.withColumn("row", F.col("row").cast("int")).withColumn("col", F.col("col").cast("int"))


def scan_chip_pairs(chips: DataFrame, listing: DataFrame, split: str) -> DataFrame:
    """(image_path, mask_path) of a split's rows of a manifest whose image and mask are both in ``listing(path)``."""
    own = chips.filter((F.col("split") == split) & (F.col("image_path") != "") & (F.col("mask_path") != ""))
    there = listing.select("path").distinct()
    for name in ("image_path", "mask_path"):
        own = own.join(there.withColumnRenamed("path", name), name, "left_semi")
    return own.select("image_path", "mask_path")


def pair_by_name(listing: DataFrame, split: str) -> DataFrame:
    """(image_path, mask_path) of files of one name under ``split``/images and ``split``/masks, where there is no manifest."""
    of = lambda kind: F.regexp_extract("path", rf"/{split}/{kind}/([^/]+)$", 1)
    images = listing.select(of("images").alias("name"), F.col("path").alias("image_path")).filter("name <> ''")
    masks = listing.select(of("masks").alias("name"), F.col("path").alias("mask_path")).filter("name <> ''")
    return images.join(masks, "name").select("image_path", "mask_path")


def build_chips(images: DataFrame, masks: DataFrame, scenes: DataFrame, path: str, size: int = 512, overlap: int = 64, salt: str = "") -> DataFrame:
    """Cut scenes into chips, write a .npy file for each, and return the manifest, which is written too.

    ``images`` and ``masks`` are pixels (scene_id, r, c, v) of ``scenes(scene_id, h, w)``; a scene without a mask has a
    null ``mask_path``. Files are ``path``/SPLIT/images/SCENE_rROW_cCOL.npy, of ``size`` x ``size`` values, and the same
    under masks; pixels that are missing are 0. Written again, everything is in the same place with the same bytes.
    """
    own = tile_offsets(scenes, size, overlap).withColumns({"split": assign_split(unit_interval("scene_id", salt)), "chip": chip_name()})
    own = own.join(masks.select("scene_id", F.lit(True).alias("_has")).distinct(), "scene_id", "left")
    own = stored(own.select("scene_id", "split", "row", "col", "chip", F.coalesce("_has", F.lit(False)).alias("has")), "chips")
    name = lambda kind: F.concat_ws("/", "split", F.lit(kind), F.concat("chip", F.lit(".npy")))

    def save(chips: pa.Table, pixels: pa.Table) -> pa.Table:
        a = np.zeros((size, size), np.float32)
        a[pixels.column("r").to_numpy(), pixels.column("c").to_numpy()] = pixels.column("v").to_numpy()
        held = io.BytesIO()
        np.save(held, a)
        names = chips.column("name").slice(0, 1)
        return pa.table({"name": names, "content": pa.array([held.getvalue()] * len(names), pa.binary())})

    files = []
    for kind, pixels in (("images", images), ("masks", masks)):
        chips = own.filter("has" if kind == "masks" else "true").select("chip", name(kind).alias("name"))
        cut = cut_tiles(pixels, scenes, size, overlap).select(F.col("tile_id").alias("chip"), "r", "c", F.col("v").cast("float").alias("v"))
        files.append(chips.groupBy("chip").cogroup(cut.groupBy("chip")).applyInArrow(save, "name string, content binary"))  # one chip at a time
    write_files(files[0].unionByName(files[1]), path)
    at = lambda kind: F.concat(F.lit(path.rstrip("/") + "/"), name(kind))
    found = own.select("scene_id", "split", "row", "col", at("images").alias("image_path"), F.when(F.col("has"), at("masks")).alias("mask_path"))
    write_manifest(found, f"{path.rstrip('/')}/{MANIFEST}", mode="overwrite")
    return found


def list_paths(spark: SparkSession, path: str) -> DataFrame:
    """(path) of all files below a folder, listed by Spark without reading any."""
    found = ready(spark).read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return found.select(plain_path("path").alias("path"))


def plain_path(path) -> Column:
    """A local path without its scheme; other paths as they are."""
    return F.regexp_replace(path, "^file:/+", "/")


def training_pairs(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(image_path, mask_path) of a split of a folder of chips, of which both files are there.

    The manifest says which these are; without one, files of one name under images and masks of the split are pairs.
    """
    here = plain_path(F.lit(path.rstrip("/")))
    listing = list_paths(spark, path)
    if has_files(spark, f"{path.rstrip('/')}/{MANIFEST}"):
        rows = scan_manifest(spark, f"{path.rstrip('/')}/{MANIFEST}", split)
        rows = rows.withColumns({c: plain_path(c) for c in ("image_path", "mask_path")})
        return scan_chip_pairs(rows, listing, split)
    inside = listing.filter(F.col("path").startswith(F.concat(here, F.lit(f"/{split}/"))))
    return pair_by_name(inside, split)


def remove_manifest(spark: SparkSession, path: str) -> None:
    """Take the manifest of a folder of chips away."""
    remove(spark, f"{path.rstrip('/')}/{MANIFEST}")


def read_chips(spark: SparkSession, path: str) -> DataFrame:
    """Pixels (split, kind, tile_id, r, c, v) of the chips below a folder."""
    parts = []
    for split in ("train", "val", "test"):
        for kind in ("images", "masks"):
            if has_files(spark, f"{path.rstrip('/')}/{split}/{kind}"):
                own = to_pixels(read_raster_npy(spark, f"{path.rstrip('/')}/{split}/{kind}"))
                parts.append(own.select(F.lit(split).alias("split"), F.lit(kind).alias("kind"), "tile_id", "r", "c", "v"))
    if not parts:
        raise FileNotFoundError(f"no chips below {path}")
    return reduce(DataFrame.unionByName, parts)


def transform_pairs(images: DataFrame, masks: DataFrame, transform: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """``transform(image, mask)`` of each tile's arrays, as pixels (tile_id, r, c, v, mask).

    ``images`` and ``masks`` are raster rows (tile_id, r, vals) of the same extent; tiles that one lacks are left out.
    """
    both = images.select("tile_id", "r", "vals").join(masks.select("tile_id", "r", F.col("vals").alias("marks")), ["tile_id", "r"])

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("r")
        image, mask = transform(np.stack(part["vals"].to_list()), np.stack(part["marks"].to_list()))
        r, c = np.indices(image.shape)
        return pd.DataFrame({"tile_id": part["tile_id"].iloc[0], "r": r.ravel(), "c": c.ravel(), "v": image.ravel(), "mask": mask.ravel()})

    return both.groupBy("tile_id").applyInPandas(run, "tile_id string, r int, c int, v double, mask double")  # one tile at a time


def write_raster_npy(rows: DataFrame, path: str) -> None:
    """Each raster of ``rows(tile_id, r, vals)`` as a .npy file below ``path``."""
    def save(part: pd.DataFrame) -> pd.DataFrame:
        held = io.BytesIO()
        np.save(held, np.stack(part.sort_values("r")["vals"].to_list()))
        return pd.DataFrame({"name": [f"{part['tile_id'].iloc[0]}.npy"], "content": [held.getvalue()]})

    write_files(rows.groupBy("tile_id").applyInPandas(save, "name string, content binary"), path)  # one tile at a time


def split_summary(chips: DataFrame) -> DataFrame:
    """(split, chips, scenes), with a row for splits without any."""
    names = chips.sparkSession.createDataFrame([("train",), ("val",), ("test",)], "split string")
    count = chips.groupBy("split").agg(F.count(F.lit(1)).alias("chips"), F.count_distinct("scene_id").alias("scenes"))
    return names.join(count, "split", "left").fillna(0, ["chips", "scenes"])
