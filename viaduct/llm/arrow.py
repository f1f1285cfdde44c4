"""Helpers on Arrow batches and byte buffers that tasks share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

#: ASCII letters in lower case, digits and every byte of a multi-byte character; all else becomes a space.
WORD_BYTES = bytes(
    b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256)
)
LONG_WORD = 64
#: glibc's call to return freed memory; other platforms do without.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def release() -> None:
    """Give unused memory of this process back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def tidy(work: Callable) -> Callable:
    """``work`` on batches; when a task ends, its worker gives unused memory back, as workers outlive tasks."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def slices(batches: Iterable[pa.RecordBatch], column: str, most: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each holds at most ``most`` bytes of ``column``, but one row at least."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
        row = 0
        while row < batch.num_rows:
            before = ends[row - 1] if row else 0
            end = max(row + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(row, end - row)
            row = end


def byte_texts(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of each text; null counts as empty."""
    return pc.fill_null(column.cast(pa.large_binary()), b"").to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values; the last value must be false."""
    edges = np.flatnonzero(flags[1:] != flags[:-1]) + 1
    if flags.size and flags[0]:
        edges = np.concatenate(([0], edges))
    return edges[0::2], edges[1::2]


def hash_spans(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray, factor: np.uint64 = _MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of each span of bytes, equal for equal bytes; another odd ``factor`` gives another hash."""
    lengths = ends - starts
    order = np.argsort(np.minimum(lengths, LONG_WORD + 1).astype(np.uint8), kind="stable")
    at, size = starts[order], lengths[order]
    out = np.zeros(len(order), np.uint64)
    longest = int(min(size[-1], LONG_WORD)) if len(size) else 0
    for k in range(longest):
        first = int(np.searchsorted(size, k, side="right"))
        out[first:] = out[first:] * factor + (buffer[at[first:] + k].astype(np.uint64) + np.uint64(1))
    for i in range(int(np.searchsorted(size, LONG_WORD, side="right")), len(size)):
        out[i] = xxhash.xxh3_64_intdigest(buffer[at[i] : at[i] + size[i]].tobytes(), seed=int(factor))
    hashes = np.empty_like(out)
    hashes[order] = mix(out)
    return hashes


def words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, one after the other, and the bounds of each text in them."""
    joined = (b" ".join(texts) + b" ").translate(WORD_BYTES)
    buffer = np.frombuffer(joined, np.uint8)
    starts, ends = spans_of(buffer != 32)
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    return hash_spans(buffer, starts, ends), np.searchsorted(starts, edges)


def ngrams(hashes: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``n`` consecutive words within each text, and their bounds."""
    total = max(0, len(hashes) - n + 1)
    out = np.zeros(total, np.uint64)
    for k in range(n):
        out = out * _MULTIPLIER + hashes[k : k + total]
    sizes = np.maximum(np.diff(bounds) - n + 1, 0)
    edges = np.concatenate(([0], np.cumsum(sizes)))
    index = np.repeat(bounds[:-1] - edges[:-1], sizes) + np.arange(edges[-1])
    return mix(out[index]), edges


def packed(values: np.ndarray, bounds: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    """A binary column: the bytes of ``values`` between neighbouring bounds."""
    width = values.dtype.itemsize
    offsets = pa.py_buffer((np.asarray(bounds, np.int64) * width).astype(np.int64))
    return pa.Array.from_buffers(
        kind or pa.large_binary(), len(bounds) - 1, [None, offsets, pa.py_buffer(np.ascontiguousarray(values))]
    )


def squeezed(values: np.ndarray) -> bytes:
    """Integers byte by byte of each place, compressed: the upper places, mostly zero, then take next to no room."""
    wide = values.dtype.itemsize
    planes = np.ascontiguousarray(np.ascontiguousarray(values).view(np.uint8).reshape(-1, wide).T)
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def unsqueezed(raw: bytes, kind: str = "<u8") -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), np.uint8)
    return np.ascontiguousarray(flat.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()
