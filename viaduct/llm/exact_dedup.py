"""Exact deduplication with counting quotient filters.

Each task builds filters of the fingerprints of its texts. Filters of the same range of fingerprints are merged,
without loss, by their sorted remainders. Fingerprints with a count above one send their texts to verification:
there texts are grouped by all their bytes, counted in each task before anything is shuffled. All other texts are
unique, as equal texts have equal fingerprints.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.arrow import byte_texts, slices, tidy
from viaduct.llm.rows import numbered, stored_rows, with_row, without
from viaduct.session import join_counted, ready, stored

#: Bits of a fingerprint; rows to a range of fingerprints whose filters one task merges.
FINGERPRINT_BITS, RANGE_ROWS = 48, 4 << 20
#: Bits of the map that spares unique texts the shuffle; once full it passes more texts, never fewer.
LEAST_MAP_BITS, MOST_MAP_BITS, SLICE_BITS = 16, 29, 16
#: The characters that do not count, space and 09 to 0D.
IGNORED = bytes([0x20, *range(0x09, 0x0E)])


class CountingQuotientFilter:
    """A multiset of ``bits``-bit fingerprints, kept exactly.

    A fingerprint's quotient, its first ``q`` bits, names its home slot; slots hold the remainders, sorted within the
    run of a quotient, and runs shift to the right of their home where it is taken. Three bit vectors tell them
    apart: ``occupied`` (a quotient has a run), ``run_end`` (the last slot of a run) and ``counter`` (the slot holds
    the count, less one, of the remainder before it; only counts above one have such a slot).
    """

    def __init__(self, q: int, bits: int, slots: np.ndarray, occupied: np.ndarray, run_end: np.ndarray, counter: np.ndarray, used: np.ndarray):
        self.q, self.bits, self.slots = q, bits, slots
        self.occupied, self.run_end, self.counter, self.used = occupied, run_end, counter, used

    @classmethod
    def build(cls, fingerprints: np.ndarray, bits: int = FINGERPRINT_BITS) -> CountingQuotientFilter:
        return cls.of_counts(*np.unique(fingerprints, return_counts=True), bits)

    @classmethod
    def of_counts(cls, keys: np.ndarray, counts: np.ndarray, bits: int = FINGERPRINT_BITS) -> CountingQuotientFilter:
        """From distinct fingerprints in ascending order and their counts."""
        need = len(keys) + int((counts > 1).sum())
        q = max(1, int(np.ceil(np.log2(max(2, need / 0.9)))))
        r = np.uint64(bits - q)
        width = 1 + (counts > 1)
        quotient = (keys >> r).astype(np.int64)
        runs, first = np.unique(quotient, return_index=True)
        size = np.add.reduceat(width, first) if len(keys) else np.zeros(0, np.int64)
        before = np.cumsum(size) - size
        start = np.maximum.accumulate(runs - before) + before if len(runs) else before
        total = int(max(1 << q, start[-1] + size[-1] if len(runs) else 0))
        run_of = np.repeat(np.arange(len(runs)), np.diff(np.append(first, len(keys))))
        at = start[run_of] + np.cumsum(width) - width - before[run_of]
        slots = np.zeros(total, np.uint64)
        occupied, run_end, counter, used = (np.zeros(total, bool) for _ in range(4))
        slots[at] = keys & ((np.uint64(1) << r) - np.uint64(1))
        many = counts > 1
        slots[at[many] + 1] = (counts[many] - 1).astype(np.uint64)
        counter[at[many] + 1] = True
        used[at] = used[at[many] + 1] = True
        occupied[runs] = True
        run_end[start + size - 1] = True
        return cls(q, bits, slots, occupied, run_end, counter, used)

    def items(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct fingerprints in ascending order and their counts."""
        at = np.flatnonzero(self.used)
        runs = np.flatnonzero(self.occupied)
        run_of = np.cumsum(self.run_end[at]) - self.run_end[at]
        keys = (runs[run_of].astype(np.uint64) << np.uint64(self.bits - self.q)) | self.slots[at]
        whose = self.counter[at]
        counts = np.ones(len(at), np.int64)
        counts[np.flatnonzero(whose) - 1] += self.slots[at[whose]].astype(np.int64)
        return keys[~whose], counts[~whose]

    def count(self, fingerprint: int) -> int:
        """How often one fingerprint was added, by rank and select on the bit vectors."""
        quotient, remainder = fingerprint >> (self.bits - self.q), fingerprint & ((1 << (self.bits - self.q)) - 1)
        if not self.occupied[quotient]:
            return 0
        rank = int(self.occupied[: quotient + 1].sum())
        ends = np.flatnonzero(self.run_end)
        low = max(quotient, int(ends[rank - 2]) + 1 if rank > 1 else 0)
        for at in range(low, int(ends[rank - 1]) + 1):
            if not self.counter[at] and int(self.slots[at]) == remainder:
                more = at + 1 < len(self.slots) and self.counter[at + 1]
                return 1 + int(self.slots[at + 1]) if more else 1
        return 0

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """One filter of all multisets; runs are merged in the order of quotients and remainders."""
        parts = [f.items() for f in (self, *others)]
        keys, counts = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(keys, kind="stable")  # merges the sorted parts
        keys, counts = keys[order], counts[order]
        first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        return self.of_counts(keys[first], np.add.reduceat(counts, first) if len(first) else counts, self.bits)

    def to_bytes(self) -> bytes:
        head = np.array([self.q, self.bits, len(self.slots)], "<i8").tobytes()
        marks = [np.packbits(x).tobytes() for x in (self.occupied, self.run_end, self.counter, self.used)]
        return head + b"".join(marks) + self.slots[self.used].astype("<u8").tobytes()

    @classmethod
    def from_bytes(cls, raw: bytes) -> CountingQuotientFilter:
        q, bits, total = (int(x) for x in np.frombuffer(raw, "<i8", 3))
        size = -(-total // 8)
        marks = [np.unpackbits(np.frombuffer(raw, np.uint8, size, 24 + k * size), count=total).astype(bool) for k in range(4)]
        slots = np.zeros(total, np.uint64)
        slots[marks[3]] = np.frombuffer(raw, "<u8", offset=24 + 4 * size)
        return cls(q, bits, slots, *marks)


def _normal(texts: list[bytes]) -> list[bytes]:
    return [t.translate(None, IGNORED) for t in texts]


def _prints(texts: list[bytes]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(t) >> (64 - FINGERPRINT_BITS) for t in texts], np.uint64)


def _described(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 4 << 20):
        texts = _normal(byte_texts(batch.column("text")))
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("row"),
                pa.array(_prints(texts).astype(np.int64)),
                pa.array([hashlib.sha256(t).digest() for t in texts], pa.binary()),
                pc.cast(pc.fill_null(pc.utf8_length(batch.column("text")), 0), pa.int64()),
            ],
            names=["doc_id", "row", "print", "sha", "n_chars"],
        )


def build_filters(prints: DataFrame, ranges: int) -> DataFrame:
    """Filters of ``print`` built in each task and merged by range of fingerprints: (range, filter)."""
    bits = (ranges - 1).bit_length()

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # eight bytes a document of this task; texts are not held
        held = [b.column("print").to_numpy().astype(np.uint64) for b in batches]
        if not held:
            return
        keys = np.sort(np.concatenate(held))
        where = (keys >> np.uint64(FINGERPRINT_BITS - bits)).astype(np.int64)
        edges = np.searchsorted(where, np.arange((1 << bits) + 1))
        for k in np.flatnonzero(np.diff(edges)):
            own = CountingQuotientFilter.build(keys[edges[k] : edges[k + 1]]).to_bytes()
            yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int64()), pa.array([own], pa.binary())], names=["range", "filter"])

    def merge(table: pa.Table) -> pa.Table:
        parts = [CountingQuotientFilter.from_bytes(x) for x in table.column("filter").to_pylist()]
        return pa.table({"range": table.column("range")[:1], "filter": pa.array([parts[0].merge(*parts[1:]).to_bytes()], pa.binary())})

    schema = "range long, filter binary"
    return prints.select("print").mapInArrow(build, schema).groupBy("range").applyInArrow(merge, schema)


def repeated(filters: DataFrame) -> DataFrame:
    """The fingerprints whose count is above one: (print, count)."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("filter").to_pylist():
                keys, counts = CountingQuotientFilter.from_bytes(raw).items()
                many = counts > 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[many].astype(np.int64)), pa.array(counts[many])], names=["print", "count"])

    return filters.mapInArrow(read, "print long, count long")


def bit_map(prints: DataFrame, bits: int | None = None):
    """A map of bits that are set for ``prints``, of bounded size, for all tasks; and its size in bits."""
    spark = prints.sparkSession
    bits = bits or min(MOST_MAP_BITS, max(LEAST_MAP_BITS, (16 * prints.count()).bit_length()))

    def put(table: pa.Table) -> pa.Table:
        marks = np.zeros(1 << SLICE_BITS, bool)
        marks[table.column("bit").to_numpy() & ((1 << SLICE_BITS) - 1)] = True
        return pa.table({"slice": table.column("slice")[:1], "marks": pa.array([np.packbits(marks).tobytes()], pa.binary())})

    places = prints.select(F.col("print").bitwiseAND((1 << bits) - 1).alias("bit")).distinct().withColumn("slice", F.expr(f"bit div {1 << SLICE_BITS}"))
    marks = np.zeros(1 << bits >> 3, np.uint8)
    for row in places.groupBy("slice").applyInArrow(put, "slice long, marks binary").collect():  # at most 64 MB
        at = row["slice"] << SLICE_BITS >> 3
        marks[at : at + (1 << SLICE_BITS >> 3)] = np.frombuffer(row["marks"], np.uint8)
    return spark.sparkContext.broadcast(marks), bits


def in_bit_map(prints: np.ndarray, marks: np.ndarray, bits: int) -> np.ndarray:
    """Which of ``prints`` have their bit set."""
    place = prints & np.uint64((1 << bits) - 1)
    return (marks[(place >> np.uint64(3)).astype(np.int64)] >> (7 - (place & np.uint64(7))).astype(np.uint8)) & 1


def find_copies(docs: DataFrame, range_rows: int = RANGE_ROWS, row: str | None = None) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, keep_id, group_size, kept, text_sha256, and ``row``.

    Texts are equal when identical after deleting space and the characters 09 to 0D; null counts as empty, and all
    empty texts are one group. Of equal texts the row with the most code points stays, then the smallest ``doc_id``
    (null last), then the first row; exactly one row of a group is kept. ``row`` is the column of that name, or numbers the rows.
    """
    ready(docs.sparkSession)
    rows = with_row(docs, row)
    described = rows.mapInArrow(tidy(_described), "doc_id long, row long, print long, sha binary, n_chars long")
    table = stored_rows(described, row, "fingerprints")
    ranges = 1 << max(4, (table.count() // range_rows).bit_length())
    twice = stored(repeated(build_filters(table, ranges)).select("print"), "repeated")
    marks, bits = bit_map(twice)

    def suspects(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = _normal(byte_texts(batch.column("text")))
            prints = _prints(texts)
            own = np.flatnonzero(in_bit_map(prints, marks.value, bits))
            if len(own):
                yield pa.RecordBatch.from_arrays([pa.array(prints[own].astype(np.int64)), pa.array([texts[i] for i in own], pa.binary())], names=["print", "bytes"])

    candidates = rows.select("text").mapInArrow(tidy(suspects), "print long, bytes binary")
    # verification: equal means the same bytes; copies within a task are counted before they are shuffled, so no text is hot
    verified = candidates.groupBy("print", "bytes").agg(F.count(F.lit(1)).alias("group_size"))
    groups = verified.filter("group_size > 1").select(F.unhex(F.sha2("bytes", 256)).alias("sha"), "group_size")
    groups = stored(groups, "groups")
    best = F.struct(F.col("n_chars"), (-F.coalesce("doc_id", F.lit(2**63 - 1))).alias("small"), (-F.col("row")).alias("first"))
    # the rows of a hash meet in their tasks first; then each hash has one row on either side
    firsts = table.groupBy("sha").agg(F.max_by(F.struct("doc_id", "row"), best).alias("keep"), F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    stays = firsts.join(groups, "sha").drop("rows")
    alone = F.col("keep").isNull()
    return join_counted(table, stays, "sha", "group_size").select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("keep.row") == F.col("row"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
        "row",
    )


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that stay; the others are found and dropped as ``find_copies`` says.

    A null ``doc_id`` gives way to any other, rows alike in all columns are one group, an empty table stays empty, and
    other columns, whatever their names, are only carried.
    """
    own, row = numbered(docs)
    return without(own, row, find_copies(own, row=row).filter(~F.col("kept")).select("row"))


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal texts in all ``documents``."""
    return find_copies(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
