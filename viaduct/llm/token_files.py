"""Token files: independent zstandard frames, a document index and a trailing seek table with frame checksums.

A file holds the ids of documents in ascending ``doc_id`` order. Layout:

* data frames: each a complete zstandard frame of whole documents, or of one long document;
* an index frame (skippable, so plain zstandard readers pass over it): a compressed table of (doc_id, ids, frame);
* the seek table (skippable, last): compressed size, size and checksum of each frame, then a fixed footer.

The seek table follows the published "zstd seekable format", so other readers of that format can use it too. A
reader fetches the footer, the seek table and the index by ranged reads, and then only the frames that it needs.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from viaduct.llm.arrow import slices, tidy
from viaduct.llm.tokens import default_vocabulary, encoder
from viaduct.session import ready, scratch

# Fixed values of the zstd seekable format: magic of the skippable frames, of the footer, and the flag "checksums".
SKIPPABLE_INDEX = 0x184D2A5D
SKIPPABLE_SEEK = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
FOOTER = struct.Struct("<IBI")

FRAME_BYTES, LEVEL, END_ID = 1 << 18, 3, 2
MANIFEST = "file string, first_doc long, last_doc long, docs long, tokens long, frames long, bytes long, seek_crc32 long"
READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class FrameWriter:
    """Writes one token file; nothing but the current frame is held in memory."""

    def __init__(self, sink, level: int = LEVEL, frame_bytes: int = FRAME_BYTES):
        self.sink, self.frame_bytes = sink, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True).compress
        self.pending: list[bytes] = []
        self.held, self.size = 0, 0
        self.entries: list[tuple[int, int, int]] = []
        self.docs: list[int | None] = []
        self.counts: list[int] = []
        self.frames: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        raw = ids.astype("<u4").tobytes()
        if self.held and self.held + len(raw) > self.frame_bytes:
            self._flush()
        self.docs.append(doc_id)
        self.counts.append(len(ids))
        self.frames.append(len(self.entries))
        self.pending.append(raw)
        self.held += len(raw)

    def _flush(self) -> None:
        raw = b"".join(self.pending)
        frame = self.pack(raw)
        self.sink.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.size += len(frame)
        self.pending, self.held = [], 0

    def close(self) -> dict:
        if self.pending:
            self._flush()
        table = pa.table({"doc_id": pa.array(self.docs, pa.int64()), "n": pa.array(self.counts, pa.int64()), "frame": pa.array(self.frames, pa.int64())})
        held = pa.BufferOutputStream()
        with pa.ipc.new_stream(held, table.schema) as out:
            out.write_table(table)
        index = self.pack(held.getvalue().to_pybytes())
        index = struct.pack("<II", SKIPPABLE_INDEX, len(index)) + index
        entries = self.entries + [(len(index), 0, 0)]
        seek = b"".join(struct.pack("<III", *e) for e in entries) + FOOTER.pack(len(entries), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        seek = struct.pack("<II", SKIPPABLE_SEEK, len(seek)) + seek
        self.sink.write(index)
        self.sink.write(seek)
        return {
            "docs": len(self.docs), "tokens": sum(self.counts), "frames": len(self.entries),
            "bytes": self.size + len(index) + len(seek), "seek_crc32": zlib.crc32(seek),
        }


class FrameReader:
    """Reads single documents, or all, of one token file; each frame is checked against its checksum."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        count, flag, magic = FOOTER.unpack(self._at(size - FOOTER.size, FOOTER.size))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("not a token file: its seek table is missing")
        table = np.frombuffer(self._at(size - FOOTER.size - 12 * count, 12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.table = table[:-1]
        self.offsets = np.concatenate(([0], np.cumsum(table[:, 0])))
        index = self._at(int(self.offsets[-2]), int(table[-1, 0]))[8:]
        held = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(index)).read_all()
        self.docs = held.column("doc_id").to_pylist()
        self.counts, self.frame_of = (held.column(c).to_numpy() for c in ("n", "frame"))
        self.starts = np.concatenate(([0], np.cumsum(self.counts)))

    def _at(self, offset: int, size: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(size)

    def frame(self, k: int) -> np.ndarray:
        packed, size, check = self.table[k]
        raw = zstandard.ZstdDecompressor().decompress(self._at(int(self.offsets[k]), int(packed)), max_output_size=int(size) or 1)
        if len(raw) != size or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(raw, "<u4")

    def rows(self, wanted: set | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids before it in the file, its ids) of all or the wanted documents; other frames stay packed."""
        last, ids = -1, np.zeros(0, "<u4")
        begins: dict[int, int] = {}
        for i, k in enumerate(self.frame_of):
            begins.setdefault(int(k), i)
        for i, doc in enumerate(self.docs):
            if wanted is not None and doc not in wanted:
                continue
            k = int(self.frame_of[i])
            if k != last:
                last, ids = k, self.frame(k)
            at = int(self.starts[i] - self.starts[begins[k]])
            yield doc, int(self.starts[i]), ids[at : at + int(self.counts[i])]


def _writer(path: str, vocabulary: str, end_id: int, level: int, frame_bytes: int):
    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = None
        system, folder = _open(path)
        for batch in slices(batches, "text", 1 << 20):
            if out is None:
                # an attempt of its own name: a task that runs again never touches a file that another one wrote
                name = f"tokens-{TaskContext.get().partitionId():09d}-{uuid.uuid4().hex}.zst"
                system.create_dir(folder, recursive=True)
                sink = system.open_output_stream(f"{folder}/{name}", compression=None)
                out, first = FrameWriter(sink, level, frame_bytes), batch.column("doc_id")[0].as_py()
            ids, bounds = encoder(vocabulary).encode(batch.column("text"))
            for i, last in enumerate(batch.column("doc_id").to_pylist()):
                out.add(last, np.append(ids[bounds[i] : bounds[i + 1]], np.uint32(end_id)))
        if out is not None:
            done = out.close()
            sink.close()
            yield pa.RecordBatch.from_pylist([{"file": name, "first_doc": first, "last_doc": last, **done}], schema=_schema(MANIFEST))

    return write


def write_token_files(
    docs: DataFrame, path: str, vocabulary: str | None = None, end_id: int = END_ID, level: int = LEVEL, frame_bytes: int = FRAME_BYTES
) -> DataFrame:
    """Encode ``docs(doc_id, text)`` and write token files and their manifest below ``path``; returns the manifest.

    Documents are dealt by ranges of ``doc_id``, so files and documents in them ascend. Null text counts as empty
    and yields the end id alone; a null ``doc_id`` comes first; repeated ids are kept, ordered by text; an empty
    table yields an empty manifest. Other columns are ignored.
    """
    spark = ready(docs.sparkSession)
    write = _writer(path, vocabulary or default_vocabulary(), end_id, level, frame_bytes)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    dealt.mapInArrow(tidy(write), MANIFEST).write.parquet(f"{path}/_manifest")
    return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = False) -> DataFrame:
    """The documents in the files below ``path``: doc_id, start, n_tokens, ids_crc32 and, if asked, ids.

    ``start`` counts the ids of all documents before. ``doc_ids`` limits reading to the files whose range holds one of
    them, and there to the frames of those documents.
    """
    ready(spark)
    ddl = READ + (", ids array<long>" if with_ids else "")
    wanted = None if doc_ids is None else set(doc_ids)

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = _open(path)
        for batch in batches:
            for name, before in zip(*(batch.column(c).to_pylist() for c in ("file", "before")), strict=True):
                with system.open_input_file(f"{folder}/{name}") as source:
                    held: list[tuple] = []
                    size = 0
                    for doc, at, ids in FrameReader(source).rows(wanted):
                        held.append((doc, before + at, len(ids), zlib.crc32(ids), *([ids.astype(np.int64)] if with_ids else ())))
                        size += len(ids) * 8 * with_ids
                        if len(held) >= 20_000 or size > 16 << 20:
                            yield _batch(held, ddl)
                            held, size = [], 0
                    if held:
                        yield _batch(held, ddl)

    # one small row per file: what stands before a file is a running sum over them; then each file is read by one task
    manifest = spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    earlier = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("before"), "first_doc", "last_doc")
    if wanted is not None:
        least = F.lit(-(2**63)).cast("long")  # nulls come first
        ids = F.array(*[F.lit(-(2**63) if i is None else i).cast("long") for i in wanted]).cast("array<bigint>")
        files = files.filter(F.exists(ids, lambda i: i.between(F.coalesce("first_doc", least), F.coalesce("last_doc", least))))
    files = files.select("file", "before")
    return files.repartition(max(1, manifest.count())).mapInArrow(read, ddl)


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    schema = _schema(ddl)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the ids of all ``documents`` as token files and read the files back."""
    path = scratch(spark, "tokens")
    write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read_token_files(spark, path)
