"""Packing of token ids into sequences of a fixed window by non-negative least squares on the length histogram.

Full windows of a document become sequences of their own. For what is left of each document, shallow combinations
of lengths that fill a window are enumerated, repeat counts are solved against the histogram of lengths (min
|Ax - h|, x >= 0), rounded down, and laid out; the residue is packed greedily, cut where a window ends. This happens
block by block, each with a histogram of its own, so that no rows are shuffled and memory stays bounded.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.arrow import packed, slices, tidy
from viaduct.llm.tokens import default_vocabulary, encoder
from viaduct.session import ready

WINDOW, END_ID, BLOCK_DOCS, SOLVER_ROUNDS = 1024, 0, 20_000, 200
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


@lru_cache
def combinations(window: int) -> np.ndarray:
    """Up to three lengths that fill a window; 0 stands for none.

    Pairs cover each length once; triples of two equal lengths, and of halves and quarters with a pair of the rest,
    give the solver other ways to use up a length.
    """
    rows = [(a, window - a, 0) for a in range(1, window // 2 + 1)]
    rows += [(a, a, window - 2 * a) for a in range(1, (window + 1) // 2) if window - 2 * a != a]
    for part in (window // 2, window // 4, window // 8):
        rest = window - part
        rows += [(part, a, rest - a) for a in range(1, rest // 2 + 1) if part]
    return np.unique(np.sort(np.array(rows, np.int64), axis=1)[:, ::-1], axis=0)


def solve_repeats(histogram: np.ndarray, combos: np.ndarray, rounds: int = SOLVER_ROUNDS) -> np.ndarray:
    """Repeat counts x >= 0 of ``combos`` that come closest to ``histogram`` by least squares.

    Multiplicative updates x <- x * (A'h) / (A'Ax) keep x non-negative and never raise the error. A is sparse: three
    lengths a combination.
    """
    usable = np.all((combos == 0) | (histogram[combos] > 0), axis=1)
    x = np.zeros(len(combos))
    own = combos[usable]
    if not len(own):
        return x
    there = own > 0
    target = np.where(there, histogram[own], 0).sum(axis=1).astype(float)
    y = target / 4
    for _ in range(rounds):
        made = np.bincount(own.ravel(), np.repeat(y, 3), minlength=len(histogram))
        y *= target / np.maximum(np.where(there, made[own], 0).sum(axis=1), 1e-9)
    x[usable] = y
    return x


def whole_repeats(histogram: np.ndarray, combos: np.ndarray) -> np.ndarray:
    """Repeat counts rounded to whole numbers that never use more of a length than there is.

    Rounds down, then gives what is left to the combinations with the largest counts that still fit.
    """
    solved = solve_repeats(histogram, combos)
    counts = np.floor(solved).astype(np.int64)
    left = histogram - np.bincount(combos.ravel(), np.repeat(counts, 3), minlength=len(histogram)).astype(np.int64)
    left[0] = 0
    over = set(np.flatnonzero(left < 0).tolist())
    for j in np.argsort(solved, kind="stable") if over else ():
        while counts[j] and over.intersection(combos[j].tolist()):
            counts[j] -= 1
            for a in combos[j]:
                left[a] += a > 0
                if left[a] >= 0:
                    over.discard(int(a))
    for j in np.argsort(-solved, kind="stable"):
        if solved[j] <= 0:
            break
        need = [int(a) for a in combos[j] if a]
        fits = min(left[a] // need.count(a) for a in need)
        if fits > 0:
            counts[j] += fits
            for a in need:
                left[a] -= fits
    return counts


def lay_out(lengths: np.ndarray, window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (row, start in the row, length, sequence, offset) that hold each row's ``lengths`` tokens once.

    Lengths lie below ``window``. Only the last sequence can be padded.
    """
    histogram = np.bincount(lengths, minlength=window + 1)
    histogram[0] = 0
    combos = combinations(window)
    counts = whole_repeats(histogram, combos)
    order = np.argsort(lengths, kind="stable")
    first = np.searchsorted(lengths[order], np.arange(window + 2))
    next_of = first[:-1].copy()
    pieces: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    for j in np.flatnonzero(counts):
        need = [int(a) for a in combos[j] if a]
        for _ in range(int(counts[j])):
            at = 0
            for a in need:
                pieces.append((int(order[next_of[a]]), 0, a, sequence, at))
                next_of[a] += 1
                at += a
            sequence += 1
    at = 0
    for a in range(window - 1, 0, -1):  # the residue, longest first, cut at the end of a window
        for row in order[next_of[a] : first[a + 1]]:
            start = 0
            while start < a:
                length = min(a - start, window - at)
                pieces.append((int(row), start, length, sequence, at))
                start, at = start + length, at + length
                if at == window:
                    sequence, at = sequence + 1, 0
    return pieces


def _packer(vocabulary: str, window: int, end_id: int, block_docs: int, with_ids: bool):
    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequence = TaskContext.get().partitionId() << 33
        tails: list[np.ndarray] = []
        rows: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in slices(batches, "text", 1 << 20):
            ids, bounds = encoder(vocabulary).encode(batch.column("text"))
            ids = np.insert(ids, bounds[1:], end_id).astype("<u4")
            bounds = bounds + np.arange(len(bounds))
            sizes = np.diff(bounds)
            docs = batch.column("doc_id")
            full = sizes // window
            owner = np.repeat(np.arange(len(sizes)), full)
            start = (np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full)) * window
            if len(owner):
                at = bounds[owner] + start
                pieces = [ids[a : a + window] for a in at]
                own = sequence + np.arange(len(owner))
                sequence += len(owner)
                yield _pieces(docs.take(pa.array(owner)), start, pieces, sizes[owner], own, np.zeros(len(owner)), with_ids)
            rest = np.flatnonzero(sizes % window)
            tails += [ids[bounds[i] + full[i] * window : bounds[i + 1]].copy() for i in rest]
            rows.append((docs.take(pa.array(rest)), full[rest] * window, sizes[rest]))
            held += len(rest)
            if held >= block_docs:
                out, sequence = _block(tails, rows, sequence, window, with_ids)
                yield from out
                tails, rows, held = [], [], 0
        if held:
            yield from _block(tails, rows, sequence, window, with_ids)[0]

    return pack


def _block(tails, rows, sequence: int, window: int, with_ids: bool) -> tuple[list[pa.RecordBatch], int]:
    docs = pa.chunked_array([r[0] for r in rows]).combine_chunks()
    before, sizes = (np.concatenate([r[i] for r in rows]) for i in (1, 2))
    laid = np.array(lay_out(np.array([len(t) for t in tails]), window), np.int64).reshape(-1, 5)
    out = []
    for k in range(0, len(laid), 10_000):
        row, start, length, own, offset = laid[k : k + 10_000].T
        pieces = [tails[r][s : s + n] for r, s, n in zip(row, start, length, strict=True)]
        out.append(_pieces(docs.take(pa.array(row)), before[row] + start, pieces, sizes[row], sequence + own, offset, with_ids))
    return out, sequence + int(laid[:, 3].max(initial=-1)) + 1


def _pieces(docs, start, pieces, sizes, sequence, offset, with_ids: bool) -> pa.RecordBatch:
    lengths = [len(p) for p in pieces]
    columns = [docs, start, lengths, [zlib.crc32(p) for p in pieces], sizes, sequence, offset]
    arrays = [pa.array(c, pa.int64()) if not isinstance(c, np.ndarray) else pa.array(c.astype(np.int64)) for c in columns]
    names = [x.split()[0] for x in PIECE.split(", ")]
    if with_ids:
        arrays.append(packed(np.concatenate(pieces), np.concatenate(([0], np.cumsum(lengths))), pa.large_binary()).cast(pa.binary()))
        names.append("ids")
    return pa.RecordBatch.from_arrays(arrays, names=names)


def pack_documents(
    docs: DataFrame, window: int = WINDOW, vocabulary: str | None = None, end_id: int = END_ID,
    block_docs: int = BLOCK_DOCS, with_ids: bool = True,
) -> DataFrame:
    """Pieces of ``docs(doc_id, text)`` in sequences of at most ``window`` ids.

    A document's ids are those of its text and ``end_id``; null text counts as empty and yields ``end_id`` alone.
    Rows with a null or repeated ``doc_id`` are packed like any other; an empty table yields no piece; other columns
    are ignored. With ``with_ids`` a piece carries its ids as little-endian 32-bit integers; ``sequences`` puts them
    together. A sequence has at most one padded stretch, at its end, and only the last of a block has any. Sequence
    ids are unique, not consecutive.
    """
    ready(docs.sparkSession)
    pack = _packer(vocabulary or default_vocabulary(), window, end_id, block_docs, with_ids)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(pack), PIECE + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame, window: int = WINDOW, pad_id: int = 0) -> DataFrame:
    """Whole sequences (sequence_id, used, ids array<long>) from pieces with ids; padded unless a power of two long."""
    ready(pieces.sparkSession)
    schema = "sequence_id long, used long, ids array<long>"

    def put(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(p["ids"] for p in row), "<u4").astype(np.int64) for row in batch.column("parts").to_pylist()]
            used = [len(x) for x in ids]
            whole = [x if n & (n - 1) == 0 else np.concatenate((x, np.full(window - n, pad_id))) for x, n in zip(ids, used, strict=True)]
            arrays = [batch.column("sequence_id"), pa.array(used, pa.int64()), pa.array(whole, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(arrays, names=["sequence_id", "used", "ids"])

    parts = F.sort_array(F.collect_list(F.struct("offset", "ids"))).alias("parts")  # a window's pieces at most
    return pieces.groupBy("sequence_id").agg(parts).mapInArrow(put, schema)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All ``documents`` packed into sequences of 1024."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
