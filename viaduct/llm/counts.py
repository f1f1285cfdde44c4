"""Tables of counts over a whole corpus, partitioned by hash and joined back to the blocks of text that asked for them.

The corpus is cut into blocks of whole documents. Each block sends its distinct keys (hashes of n-grams or shingles),
sorted and counted, to the parts of the table that their first bits name. A part sums up its keys and answers each block
with the totals of what it sent, in the same order. Keys travel as packed sorted differences, a few bytes each, rather
than as rows; a key that is everywhere is sent once a block. A block sends a row to each part that it touches. Were
blocks and parts of one size for any corpus, a row would hold fewer and fewer keys, down to one; so both grow with the
root of the corpus, and the bytes of a key stay the same. A part is summed up in ranges of keys, some at once, so it may
be larger than what a task can sort in memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.llm.arrow import WORD_BYTES, byte_texts, release, slices, spans_of, squeezed, tidy, unsqueezed
from viaduct.llm.rows import with_row
from viaduct.session import ready, stored

#: Bytes of a block, words to a part of a table, and parts at least, for small corpora.
BLOCK_BYTES, PART_WORDS, LEAST_PARTS = 4 << 20, 1 << 20, 16
#: Words of a corpus of which a row still holds some 80 keys, bytes of a word, and how much blocks and parts may grow.
#: Beyond 256 times these words, 17 TB of text, rows get shorter again.
EVEN_WORDS, WORD_SIZE, MOST_GROWTH = 10_000_000_000, 6.5, 16
#: Keys of a part that are sorted at once.
SORTED_KEYS = 1 << 22
#: Keys of a part and words of a block after which a worker gives memory back.
LARGE = 1 << 18
BLOCK = "block long, words long, doc_ids array<long>, rows array<long>, sizes array<int>, texts binary"
REQUEST = "part int, n int, block long, keys binary, counts binary"
REPLY = "block long, n int, part int, totals binary"
#: The keys of some texts, one array for each kind of key.
Keys = Callable[[list[bytes]], list[np.ndarray]]


def growth(words: float) -> float:
    """How many times larger blocks and parts are for a corpus of so many words."""
    return min(MOST_GROWTH, max(1.0, (words / EVEN_WORDS) ** 0.5))


def cut_blocks(docs: DataFrame, row: str | None = None, block_bytes: int | None = None) -> DataFrame:
    """The stored corpus ``docs(doc_id, text)`` in blocks of whole documents, texts compressed; null counts as empty.

    The size of blocks follows the optimiser's estimate of the size of ``docs``; no result depends on it.
    """
    ready(docs.sparkSession)
    if block_bytes is None:
        estimate = docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
        block_bytes = int(BLOCK_BYTES * growth(float(str(estimate)) / WORD_SIZE))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in slices(batches, "text", block_bytes):
            texts = byte_texts(batch.column("text"))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([number], pa.int64()),
                    pa.array([len(spans_of(np.frombuffer((b" ".join(texts) + b" ").translate(WORD_BYTES), np.uint8) != 32)[0])], pa.int64()),
                    *(pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("doc_id", "row")),
                    pa.array([[len(t) for t in texts]], pa.list_(pa.int32())),
                    pa.array([pack(b"".join(texts))], pa.binary()),
                ],
                names=[f.split()[0] for f in BLOCK.split(", ")],
            )
            number += 1

    return stored(with_row(docs, row).mapInArrow(tidy(cut), BLOCK), "blocks")


def block_texts(row: dict) -> list[bytes]:
    """The texts of one block."""
    whole = zstandard.ZstdDecompressor().decompress(row["texts"], max_output_size=sum(row["sizes"]) or 1)
    ends = np.cumsum(row["sizes"], dtype=np.int64).tolist()
    return [whole[e - n : e] for e, n in zip(ends, row["sizes"], strict=True)]


def count_keys(blocks: DataFrame, keys_of: Keys, bits: int, words: int, part_words: int | None = None) -> DataFrame:
    """The stored answers to all blocks: for each, kind n of key (from 1) and part, the totals of its keys in order.

    ``bits`` are those of a key; ``words`` those of the corpus.
    """
    spark = blocks.sparkSession
    part_words = part_words or int(PART_WORDS * growth(words))
    parts = max(LEAST_PARTS, int(spark.conf.get("spark.sql.shuffle.partitions")), words // part_words)
    parts = 1 << (parts - 1).bit_length()
    requests = blocks.select("block", "sizes", "texts").mapInArrow(tidy(_requester(keys_of, bits, parts)), REQUEST)
    return stored(requests.groupBy("part", "n").applyInArrow(_answer, REPLY), "counts")


def _requester(keys_of: Keys, bits: int, parts: int):
    shift = np.uint64(bits - (parts - 1).bit_length())

    def request(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                for n, own in enumerate(keys_of(block_texts(row)), 1):
                    keys, counts = np.unique(own, return_counts=True)
                    edges = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64))
                    some = np.flatnonzero(np.diff(edges))
                    cuts = [slice(edges[p], edges[p + 1]) for p in some]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(some.astype(np.int32)), pa.array([n] * len(some), pa.int32()), pa.array([row["block"]] * len(some), pa.int64()),
                            pa.array([squeezed(np.diff(keys[c], prepend=np.uint64(0))) for c in cuts], pa.binary()),
                            pa.array([squeezed(counts[c].astype("<u8")) for c in cuts], pa.binary()),
                        ],
                        names=["part", "n", "block", "keys", "counts"],
                    )

    return request


def _answer(table: pa.Table) -> pa.Table:
    """Sum one part of a count table and tell each block the totals of its keys, in its order.

    Keys are sorted in each block, so a range of them is a piece of each; ranges hold ``SORTED_KEYS`` at most but for
    what many blocks share.
    """
    keys = [np.cumsum(unsqueezed(k), dtype=np.uint64) for k in table.column("keys").to_pylist()]
    counts = [np.require(unsqueezed(c), requirements="W") for c in table.column("counts").to_pylist()]
    size = sum(map(len, keys))
    step = -(-size // SORTED_KEYS)
    # bounds of the ranges: quantiles of some keys of each block
    some = np.sort(np.concatenate([k[:: max(1, min(step, len(k)))] for k in keys]))
    bounds = some[(np.arange(1, step) * len(some)) // step]
    cuts = [np.concatenate(([0], np.searchsorted(k, bounds), [len(k)])) for k in keys]
    for r in range(step):
        edges = np.concatenate(([0], np.cumsum([c[r + 1] - c[r] for c in cuts])))
        flat = np.concatenate([k[c[r] : c[r + 1]] for k, c in zip(keys, cuts, strict=True)])
        if not len(flat):
            continue
        own = np.concatenate([n[c[r] : c[r + 1]] for n, c in zip(counts, cuts, strict=True)])
        order = np.argsort(flat, kind="stable")
        flat = flat[order]
        first = np.append(True, flat[1:] != flat[:-1])
        totals = np.empty(len(flat), np.uint64)
        totals[order] = np.add.reduceat(own[order], np.flatnonzero(first))[np.cumsum(first) - 1]
        for n, c, a, b in zip(counts, cuts, edges[:-1], edges[1:], strict=True):
            n[c[r] : c[r + 1]] = totals[a:b]
    packed = [squeezed(n) for n in counts]
    del keys, counts
    if size > LARGE:  # its worker outlives it
        release()
    return pa.table({"block": table.column("block"), "n": table.column("n"), "part": table.column("part"), "totals": pa.array(packed, pa.binary())})


def with_totals(blocks: DataFrame, replies: DataFrame, work: Callable, schema: str) -> DataFrame:
    """``work(row of a block, kind -> totals of its distinct keys in ascending order)``, a table, for every block."""

    def run(own: pa.Table, answers: pa.Table) -> pa.Table:
        told = answers.select(["n", "part", "totals"]).to_pylist()

        def totals(n: int) -> np.ndarray:
            some = sorted((a["part"], a["totals"]) for a in told if a["n"] == n)
            return np.concatenate([unsqueezed(t) for _, t in some]).astype(np.int64) if some else np.zeros(0, np.int64)

        rows = own.to_pylist()
        done = pa.concat_tables([work(row, totals) for row in rows])
        if any(row["words"] > LARGE for row in rows):
            release()
        return done

    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


def words_in(blocks: DataFrame) -> int:
    return blocks.agg(F.sum("words")).first()[0] or 0
