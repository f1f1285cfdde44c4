"""Benchmark decontamination with a distributed positional inverted index.

The corpus is indexed in segments, each a run of whole documents: for every term the sorted positions at which it
stands, as one row of packed arrays in a stored table. A search takes a block of query windows to every segment,
leaves out windows of which the segment lacks a term, starts from the term of a window with the fewest postings there,
and intersects the other lists, each shifted by its offset in the window, so that a phrase is found where all shifted
lists meet. Lists are met within ``slop`` of the expected place for proximity matches. Whole documents lie in one
segment, so a search shuffles no postings; the query windows are sent in blocks of bounded size, however large the
benchmark is. Matches name windows; which items a window belongs to is joined afterwards.

Words are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.arrow import byte_texts, slices, squeezed, tidy, unsqueezed, words
from viaduct.llm.rows import numbered, without
from viaduct.session import drop_stored, join_counted, ready, stored

WINDOW, SLOP = 10, 2
SEGMENT_BYTES = 4 << 20
#: Windows sent to all tasks at once, at four bytes a word some 10 MB and as much for their vocabulary at most.
BLOCK_WINDOWS = 1 << 18
#: Pairs of windows and items that are broadcast; more are joined in salted parts.
MOST_PAIRS, SALTS = 1 << 20, 16

SEGMENT = "segment long, doc_ids array<long>, bounds binary, terms binary, counts binary, positions binary"
WINDOWS = "item_id string, terms binary"
FOUND = (
    "segment long, row int, doc_id long, n_words long, spans array<struct<start:long,end:long>>, "
    "exact array<long>, near array<long>"
)
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_LONGS = pa.list_(pa.int64())


def index_documents(docs: DataFrame, path: str | None = None, segment_bytes: int = SEGMENT_BYTES) -> DataFrame:
    """The stored positional index of ``docs(doc_id, text)``, one row a segment; lists hold differences, compressed.

    Null text has no words; such and empty documents are kept with none. Rows with repeated or null ids are
    documents of their own.
    """
    spark = ready(docs.sparkSession)

    def build(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in slices(batches, "text", segment_bytes):
            hashes, bounds = words(byte_texts(batch.column("text")))
            terms, rank, counts = np.unique(hashes, return_inverse=True, return_counts=True)
            postings = np.sort((rank.astype(np.uint64) << np.uint64(32)) | np.arange(len(hashes), dtype=np.uint64))
            positions = np.diff((postings & np.uint64(0xFFFFFFFF)).astype("<u4"), prepend=np.uint32(0))
            arrays = [
                pa.array([number], pa.int64()),
                pa.array([batch.column("doc_id").to_pylist()], _LONGS),
                *(pa.array([squeezed(x)], pa.binary()) for x in (np.diff(bounds).astype("<u4"), np.diff(terms, prepend=np.uint64(0)), counts.astype("<u4"), positions)),
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in SEGMENT.split(", ")])
            number += 1

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return stored(rows.mapInArrow(tidy(build), SEGMENT), "postings", path)


def query_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows of ``items(item_id, text)``: ``window`` consecutive words, or all words of a shorter item."""
    ready(items.sparkSession)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            hashes, bounds = words(byte_texts(batch.column("text")))
            ids, terms = [], []
            for i, item in enumerate(batch.column("item_id").to_pylist()):
                own = hashes[bounds[i] : bounds[i + 1]].astype("<u8")
                for k in range(max(1, len(own) - window + 1) if len(own) else 0):
                    ids.append(item)
                    terms.append(own[k : k + window].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(terms, pa.binary())], names=["item_id", "terms"])

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, WINDOWS)


class Block:
    """Windows as rows of a matrix of numbers of terms; shorter windows are filled up with the number after the last."""

    def __init__(self, numbers: list[int], windows: list[bytes]):
        own = [np.frombuffer(w, "<u8") for w in windows]
        self.numbers = np.array(numbers, np.int64)
        self.sizes = np.array([len(w) for w in own], np.int64)
        self.vocabulary, rank = np.unique(np.concatenate([np.zeros(0, "<u8"), *own]), return_inverse=True)
        self.terms = np.full((len(own), int(self.sizes.max(initial=0))), len(self.vocabulary), np.int32)
        self.terms[np.arange(self.terms.shape[1]) < self.sizes[:, None]] = rank


class Segment:
    """The postings of one segment and the searches in them."""

    def __init__(self, row: dict):
        self.bounds = np.concatenate(([0], np.cumsum(unsqueezed(row["bounds"], "<u4"), dtype=np.int64)))
        self.terms = np.cumsum(unsqueezed(row["terms"]), dtype=np.uint64)
        self.edges = np.concatenate(([0], np.cumsum(unsqueezed(row["counts"], "<u4"), dtype=np.int64)))
        self.positions = np.cumsum(unsqueezed(row["positions"], "<u4"), dtype=np.uint32)

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.edges[term] : self.edges[term + 1]].astype(np.int64)

    def candidates(self, block: Block) -> Iterator[tuple[int, np.ndarray]]:
        """The windows all of whose terms stand in this segment, each with the numbers of its terms here."""
        if not len(self.terms) or not len(block.vocabulary):
            return
        at = np.minimum(np.searchsorted(self.terms, block.vocabulary), len(self.terms) - 1)
        there = np.append(self.terms[at] == block.vocabulary, True)
        for i in np.flatnonzero(there[block.terms].all(axis=1)):
            yield int(i), at[block.terms[i, : block.sizes[i]]]

    def search(self, terms: np.ndarray, slop: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts of exact and of proximity matches; each term of the latter stands within ``slop`` of its place."""
        lists = [self.postings(t) for t in terms]
        order = sorted(range(len(lists)), key=lambda k: len(lists[k]))
        starts = lists[order[0]] - order[0]
        doc = np.searchsorted(self.bounds, lists[order[0]], side="right")
        low, high = self.bounds[doc - 1], self.bounds[doc] - 1
        if slop == 0:
            inside = (starts >= low) & (starts + len(lists) - 1 <= high)
            starts, low, high = starts[inside], low[inside], high[inside]
        exact = (starts >= low) & (starts + len(lists) - 1 <= high)
        for k in order[1:]:
            if not len(starts):
                break
            expected, own = starts + k, lists[k]
            if slop:
                at = np.searchsorted(own, np.maximum(expected - slop, low))
                near = own[np.minimum(at, len(own) - 1)]
                keep = (at < len(own)) & (near <= np.minimum(expected + slop, high))
                if not keep.all():
                    starts, low, high, exact, expected = starts[keep], low[keep], high[keep], exact[keep], expected[keep]
                if not len(starts):
                    break
            at = np.minimum(np.searchsorted(own, expected), len(own) - 1)
            hit = own[at] == expected
            if slop:
                exact = exact & hit
            else:
                starts, low, high, exact = starts[hit], low[hit], high[hit], exact[hit]
        return starts[exact], starts


def _finder(shared, slop: int, every: bool):
    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                segment, n = Segment(row), len(row["doc_ids"])
                spans: dict[int, list] = {}
                names: tuple[dict[int, set], dict[int, set]] = ({}, {})
                for i, terms in segment.candidates(block):
                    for starts, own in zip(segment.search(terms, slop), names, strict=True):
                        docs = np.searchsorted(segment.bounds, np.maximum(starts, 0), side="right") - 1
                        for doc in np.unique(docs):
                            own.setdefault(int(doc), set()).add(int(block.numbers[i]))
                            if own is names[0]:
                                spans.setdefault(int(doc), []).append((starts[docs == doc] - segment.bounds[doc], len(terms)))
                shown = range(n) if every else sorted(names[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["segment"]] * len(shown), pa.int64()),
                        pa.array(list(shown), pa.int32()),
                        pa.array([row["doc_ids"][i] for i in shown], pa.int64()),
                        pa.array([int(segment.bounds[i + 1] - segment.bounds[i]) for i in shown], pa.int64()),
                        pa.array([_merged(spans.get(i, [])) for i in shown], _SPANS),
                        *(pa.array([sorted(own.get(i, ())) for i in shown], _LONGS) for own in names),
                    ],
                    names=["segment", "row", "doc_id", "n_words", "spans", "exact", "near"],
                )

    return find


def _merged(found: list[tuple[np.ndarray, int]]) -> list[dict]:
    spans = sorted((int(s), int(s) + n) for starts, n in found for s in starts)
    out: list[dict] = []
    for start, end in spans:
        if out and start <= out[-1]["end"]:
            out[-1]["end"] = max(out[-1]["end"], end)
        else:
            out.append({"start": start, "end": end})
    return out


def number_windows(windows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(win, terms) of the distinct windows, and (win, item_id) of the items that have them; both stored."""
    every = stored(windows.distinct(), "windows")
    distinct = every.groupBy("terms").agg(F.count(F.lit(1)).alias("items")).withColumn("win", F.monotonically_increasing_id())
    distinct = stored(distinct, "distinct")
    pairs = join_counted(every, distinct, "terms", "items").filter(F.col("item_id").isNotNull()).select("win", "item_id")
    return distinct.select("win", "terms"), stored(pairs, "pairs")


def search_index(index: DataFrame, windows: DataFrame, slop: int = 0, block_windows: int = BLOCK_WINDOWS, every: bool = True) -> DataFrame:
    """Matches of ``windows(win, terms)`` by indexed document: segment, row, doc_id, n_words, spans, exact, near.

    ``spans`` are the words in exact matches (starts and exclusive ends, ascending), ``exact`` and ``near`` the windows
    matched exactly, and exactly or nearby. Documents without a match are shown only if ``every``. Windows are dealt
    into blocks by a hash; each block is sent to all segments on its own.
    """
    spark = ready(index.sparkSession)
    blocks = max(1, -(-windows.count() // block_windows))
    parts = []
    for k in range(blocks):
        rows = windows.filter(F.pmod(F.xxhash64("terms"), F.lit(blocks)) == k).collect()  # one block
        shared = spark.sparkContext.broadcast(Block([r["win"] for r in rows], [bytes(r["terms"]) for r in rows]))
        parts.append(index.mapInArrow(tidy(_finder(shared, slop, every and k == 0)), FOUND))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    if blocks > 1:
        lists = [F.flatten(F.collect_list(c)).alias(c) for c in ("spans", "exact", "near")]
        found = found.groupBy("segment", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), *lists)
        found = found.withColumn("spans", F.array_sort("spans"))
    return found


def named_items(found: DataFrame, pairs: DataFrame, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """The stored matches ``found`` with items and near_items (those matched nearby only) by ``pairs(win, item_id)``."""
    some = F.size("near") > 0
    hits = found.filter(some)
    wins = hits.select("segment", "row", F.explode("near").alias("win"), "exact").withColumn("exact", F.array_contains("exact", F.col("win")))
    if pairs.count() <= most_pairs:
        named = wins.join(F.broadcast(pairs), "win")
    else:  # a window that many documents hold is dealt to several tasks
        salted = pairs.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
        named = wins.withColumn("salt", F.pmod(F.xxhash64("segment", "row"), F.lit(SALTS)).cast("int")).join(salted, ["win", "salt"])
    lists = [F.collect_set(F.when(which, F.col("item_id"))).alias(c) for which, c in ((F.col("exact"), "items"), (~F.col("exact"), "near_items"))]
    listed = named.groupBy("segment", "row").agg(*lists)
    none = F.array().cast("array<string>")
    items, near = (F.coalesce(c, none) for c in ("items", "near_items"))
    columns = ["doc_id", "n_words", "spans"]
    own = hits.join(listed, ["segment", "row"], "left").select(*columns, items.alias("items"), F.array_except(near, items).alias("near_items"))
    return found.filter(~some).select(*columns, none.alias("items"), none.alias("near_items")).unionByName(own)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW, slop: int = 0) -> DataFrame:
    """Per document: n_words, n_hit (words in any occurrence of a window), spans, items, near_items, contaminated.

    An empty benchmark or one without words leaves every document clean. Items without an id count for ``n_hit``
    but are not listed; rows with equal ids are one item.
    """
    windows, pairs = number_windows(query_windows(items, window))
    index = index_documents(docs)
    found = stored(search_index(index, windows, slop), "matches")
    drop_stored(index)
    union = F.aggregate(
        "spans",
        F.struct(F.lit(0).cast("long").alias("hit"), F.lit(0).cast("long").alias("end")),
        lambda a, s: F.struct(
            (a["hit"] + F.greatest(F.lit(0).cast("long"), s["end"] - F.greatest(a["end"], s["start"]))).alias("hit"),
            F.greatest(a["end"], s["end"]).alias("end"),
        ),
    )["hit"]
    return named_items(found, pairs).withColumn("n_hit", union).withColumn("contaminated", F.col("n_hit") > 0)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of ``benchmark`` in all ``documents``."""
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = decontaminate(docs, items, slop=SLOP)
    listed = F.concat_ws(",", F.array_sort("items"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"), "contaminated", F.size("near_items").cast("long").alias("n_near_items"),
    )


def clean_of_benchmark(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, with all their columns, that hold no window of the benchmark.

    Documents without words are clean, null and repeated ids are rows like any other, an empty table or benchmark drops
    nothing, and other columns, whatever their names, are only carried.
    """
    own, row = numbered(docs)
    windows = number_windows(query_windows(items, window))[0]
    index = index_documents(own.select(F.col(row).alias("doc_id"), "text"))
    dirty = stored(search_index(index, windows, every=False).filter(F.size("spans") > 0).select(F.col("doc_id").alias("row")).distinct(), "dirty")
    drop_stored(index)
    return without(own, row, dirty)
