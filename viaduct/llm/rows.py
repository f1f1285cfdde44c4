"""An identity for each row of a table, for stages that find rows by their text and keep or drop them."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.session import observed, stored

#: Bits of a row's place in its file, and files whose names are broadcast.
PLACE_BITS, MOST_FILES = 38, 100_000
#: Dropped rows that are broadcast as they are, and the bits of the map that is broadcast beyond that.
MOST_DROPPED, LEAST_MAP_BITS, MOST_MAP_BITS = 1 << 20, 20, 29


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, or the first of name_, name__, ... that no column of ``docs`` has, whatever its case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` with a further column of distinct integers, the same in every run, and that column's name.

    Rows read from files are numbered by the rank of their file's name and their place in it. Other tables are written
    first. Names are broadcast only where they are few; there is one a file, as in the driver's own listing.
    """
    name = free_name(docs, "_row")
    path, place = free_name(docs, "_path"), free_name(docs, "_place")
    try:
        own = docs.withColumns({path: F.col("_metadata.file_path"), place: F.col("_metadata.row_index")})
        names = sorted(r[0] for r in own.select(path).distinct().collect())
    except AnalysisException:
        return stored(docs.withColumn(name, F.monotonically_increasing_id()), "numbered"), name
    files = docs.sparkSession.createDataFrame(list(zip(names, range(len(names)), strict=True)), f"`{path}` string, `{name}` long")
    if len(names) <= MOST_FILES:
        files = F.broadcast(files)
    number = F.shiftleft(F.col(name), PLACE_BITS) + F.col(place)
    return own.join(files, path).select(*[F.col(f"`{c}`") for c in docs.columns], number.alias(name)), name


def without(docs: DataFrame, row: str, dropped: DataFrame, most: int = MOST_DROPPED) -> DataFrame:
    """The rows of ``docs`` whose ``row`` is not in ``dropped(row)``, with all columns but ``row``; no text is shuffled.

    Up to ``most`` dropped rows are broadcast. Of more, a map of bits of bounded size is: rows whose bit is unset pass,
    and only the others are joined with the dropped ones.
    """
    gone, seen = observed(dropped.select(F.col("row").alias(row)), "dropped")
    columns = [F.col(f"`{c}`") for c in docs.columns if c != row]
    count = seen["n"]
    if count <= most:
        return docs.join(F.broadcast(gone), row, "left_anti").select(*columns)
    marked, held = _marked(docs, row, gone, count)
    flagged = marked.filter(held).join(gone, row, "left_anti")
    return marked.filter(~held).select(*columns).unionByName(flagged.select(*columns))


def only(docs: DataFrame, row: str, wanted: DataFrame, most: int = MOST_DROPPED) -> DataFrame:
    """The rows of ``docs`` whose ``row`` is in ``wanted(row)``, found in the same way."""
    kept, seen = observed(wanted.select(F.col("row").alias(row)), "kept")
    count = seen["n"]
    if count <= most:
        return docs.join(F.broadcast(kept), row, "left_semi")
    marked, held = _marked(docs, row, kept, count)
    return marked.filter(held).join(kept, row, "left_semi").select(*docs.columns)


def _marked(docs: DataFrame, row: str, rows: DataFrame, count: int):
    """``docs`` with a broadcast map of the hashes of ``rows``, of 64 MB at most, and whether a row's bit is set there."""
    bits = min(MOST_MAP_BITS, max(LEAST_MAP_BITS, (16 * count).bit_length()))
    part, marks = free_name(docs, "_part"), free_name(docs, "_marks")
    place = F.xxhash64(row).bitwiseAND((1 << bits) - 1) + 1  # Spark's bitmaps count from 1
    at = F.bitmap_bit_position(place)
    slices = rows.groupBy(F.bitmap_bucket_number(place).alias(part)).agg(F.bitmap_construct_agg(at).alias(marks))
    octet = F.conv(F.hex(F.substring(marks, F.shiftright(at, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = F.coalesce(F.getbit(octet, at.bitwiseAND(7).cast("int")) == 1, F.lit(False))
    return docs.withColumn(part, F.bitmap_bucket_number(place)).join(F.broadcast(stored(slices, "marks")), part, "left"), held


def with_row(docs: DataFrame, row: str | None) -> DataFrame:
    """(doc_id, text, row) of ``docs``; ``row`` is null where no column is named."""
    own = F.col(row) if row else F.lit(None).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), own.alias("row"))


def stored_rows(described: DataFrame, row: str | None, name: str) -> DataFrame:
    """The described rows, stored, with ``row`` set where none was given."""
    return stored(described if row else described.withColumn("row", F.monotonically_increasing_id()), name)
