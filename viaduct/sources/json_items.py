"""JSON documents of any size and layout, read by ranges of bytes: one FeatureCollection or OSM document keeps many tasks busy.

Where a range begins, only what stands before it tells whether that is inside a string, and how deep. So ranges are looked
at twice. First each tells, for either case, how it changes depth and whether it ends in a string; put together in order,
a row a range, that gives the state at the start of each. Then each range reads the items that begin in it, and on to the
end of the last one. Line breaks, indents and the order of keys do not matter.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from viaduct.session import ready

RANGE_BYTES = 8 << 20
#: Bytes that are read at once beyond a range or before it.
MORE_BYTES = 1 << 16
RANGE = "path string, start long, stop long, size long"
ITEM = "path string, at long, pos long, level int, value string"
_MARKS = np.zeros(256, bool)
_MARKS[np.frombuffer(b'"{}[]', np.uint8)] = True
_QUOTE, _OPEN, _SPACE = ord('"'), (ord("{"), ord("[")), frozenset(b" \t\r\n")


def _opened(path: str):
    """The file system and the name of ``path`` there."""
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def list_files(path: str) -> list[tuple[str, int]]:
    """The files at or below ``path``, but for hidden ones and marks of writers, with their sizes."""
    system, name = _opened(path)
    prefix = path[: len(path) - len(name)] if path.endswith(name) else ""
    info = system.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(name, recursive=True))
    return sorted((prefix + f.path, f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def read_range(path: str, start: int, stop: int) -> bytes:
    """Some bytes of a file."""
    system, name = _opened(path)
    with system.open_input_file(name) as file:
        file.seek(start)
        return file.read(stop - start)


def _before(path: str, start: int, skipped: frozenset[int]) -> tuple[int, int]:
    """How many bytes of ``skipped`` stand right before ``start``, and the byte before these, or -1."""
    count = 0
    while start > 0:
        low = max(0, start - MORE_BYTES)
        raw = read_range(path, low, start)
        left = len(raw)
        while left and raw[left - 1] in skipped:
            left -= 1
        count += len(raw) - left
        if left:
            return count, raw[left - 1]
        start = low
    return count, -1


def _structure(raw: bytes, slashes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where quotes that are not escaped and brackets stand, what they are, and how many quotes stand before each.

    ``slashes`` backslashes stand right before ``raw``.
    """
    data = np.frombuffer(raw, np.uint8)
    at = np.flatnonzero(_MARKS[data])
    what = data[at]
    escaped = np.zeros(len(at), bool)
    suspects = np.flatnonzero((what == _QUOTE) & ((at == 0) | (data[np.maximum(at - 1, 0)] == 92)))
    for k in suspects.tolist():
        p = int(at[k])
        q = p
        while q and data[q - 1] == 92:
            q -= 1
        escaped[k] = (p - q + (slashes if q == 0 else 0)) % 2 == 1
    at, what = at[~escaped], what[~escaped]
    quotes = np.cumsum(what == _QUOTE)
    return at, what, quotes


def _outside(raw: bytes, slashes: int, in_string: bool, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where brackets outside of strings stand, what they are, and the depth behind each."""
    at, what, quotes = _structure(raw, slashes)
    kept = (what != _QUOTE) & ((quotes + in_string) % 2 == 0)
    at, what = at[kept], what[kept]
    return at, what, depth + np.cumsum(np.where(np.isin(what, _OPEN), 1, -1))


def _element(path: str, start: int, raw: bytes, at: int) -> bool:
    """Whether the bracket at ``at`` opens an element of an array: an object's value follows a colon."""
    k = at - 1
    while k >= 0 and raw[k] in _SPACE:
        k -= 1
    last = raw[k] if k >= 0 else _before(path, start, _SPACE)[1]
    return last in (ord("["), ord(","))


def _elements(path: str, start: int, raw: bytes, at: np.ndarray, what: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Which brackets open an object that is an element of an array; ``before`` is the depth before each."""
    own = np.flatnonzero(what == ord("{"))
    return own[[_element(path, start, raw, int(p)) for p in at[own]]] if len(own) else own


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            raw = read_range(row["path"], row["start"], row["stop"])
            slashes = _before(row["path"], row["start"], frozenset(b"\\"))[0]
            quotes = _structure(raw, slashes)[2]
            told = {"path": [row["path"]], "start": [row["start"]], "stop": [row["stop"]], "size": [row["size"]], "flips": [bool(len(quotes) and quotes[-1] % 2)]}
            for name, inside in (("plain", False), ("quoted", True)):
                at, what, depth = _outside(raw, slashes, inside, 0)
                own = _elements(row["path"], row["start"], raw, at, what, depth - 1)
                levels, counts = np.unique(depth[own] - 1, return_counts=True)
                told |= {f"{name}_change": [int(depth[-1]) if len(depth) else 0], f"{name}_least": [int(depth.min()) if len(depth) else 0]}
                told |= {f"{name}_levels": [levels.tolist()], f"{name}_counts": [counts.tolist()]}
            yield pa.RecordBatch.from_pydict(told, pa.schema([(c, t) for c, t in _SCANNED]))


_LONGS = pa.list_(pa.int64())
_SCANNED = [("path", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("size", pa.int64()), ("flips", pa.bool_())] + [
    (f"{h}_{c}", t) for h in ("plain", "quoted") for c, t in (("change", pa.int64()), ("least", pa.int64()), ("levels", _LONGS), ("counts", _LONGS))
]
_SCAN = RANGE + ", flips boolean, " + ", ".join(f"{h}_change long, {h}_least long, {h}_levels array<long>, {h}_counts array<long>" for h in ("plain", "quoted"))


def _states(scanned: list) -> list[tuple]:
    """(path, start, stop, size, in_string, depth, pos) of each range; documents that do not end are errors."""
    out = []
    for path, own in groupby(sorted(scanned, key=lambda r: (r["path"], r["start"])), key=lambda r: r["path"]):
        in_string, depth, pos = False, 0, 0
        for r in own:
            out.append((path, r["start"], r["stop"], r["size"], in_string, depth, pos))
            h = "quoted" if in_string else "plain"
            if depth + r[f"{h}_least"] < 0:
                raise ValueError(f"{path} is no JSON: a bracket closes that none has opened, behind byte {r['start']}")
            pos += sum(n for level, n in zip(r[f"{h}_levels"], r[f"{h}_counts"], strict=True) if level + depth == 2)
            depth += r[f"{h}_change"]
            in_string ^= r["flips"]
        if in_string or depth:
            raise ValueError(f"{path} is no JSON: it ends inside of a {'string' if in_string else 'bracket'}")
    return out


def _items(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            found = list(_items_of(row))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ([row["path"]] * len(found), *zip(*found, strict=True))], schema=pa.schema([("path", pa.string()), ("at", pa.int64()), ("pos", pa.int64()), ("level", pa.int32()), ("value", pa.string())]))


def _items_of(row: dict) -> Iterator[tuple[int, int, int, str]]:
    """(at, pos, level, value) of the items that begin in a range."""
    path, start, stop = row["path"], row["start"], row["stop"]
    slashes = _before(path, start, frozenset(b"\\"))[0]
    end, more = stop, MORE_BYTES
    while True:
        raw = read_range(path, start, end)
        at, what, depth = _outside(raw, slashes, row["in_string"], row["depth"])
        before = depth - np.where(np.isin(what, _OPEN), 1, -1)
        high = np.flatnonzero((what == ord("{")) & (before == 2))
        elements = high[[_element(path, start, raw, int(p)) for p in at[high]]] if len(high) else high
        tops = np.flatnonzero((what == ord("{")) & (before == 0))
        shut2 = np.flatnonzero((what == ord("}")) & (depth == 2))
        shut0 = np.flatnonzero((what == ord("}")) & (depth == 0))
        mine, heads = elements[at[elements] < stop - start], tops[at[tops] < stop - start]
        closed = len(mine) == 0 or (len(shut2) and shut2[-1] > mine[-1])
        # a document on its own ends before an element begins; a collection does not
        known = len(heads) == 0 or (len(elements) and elements[-1] > heads[-1]) or (len(shut0) and shut0[-1] > heads[-1])
        if (closed and known) or end >= row["size"]:
            break
        end, more = min(row["size"], end + more), 2 * more
    for k, e in enumerate(mine):
        last = shut2[np.searchsorted(shut2, e)]
        yield start + int(at[e]), row["pos"] + k, 3, raw[at[e] : at[last] + 1].decode()
    for e in heads:
        k, n = np.searchsorted(shut0, e), np.searchsorted(elements, e)
        if k < len(shut0) and not (n < len(elements) and elements[n] < shut0[k]):
            yield start + int(at[e]), 0, 1, raw[at[e] : at[shut0[k]] + 1].decode()


def read_items(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(path, at, pos, level, value): the objects of arrays right below a document (level 3), and documents without such (1).

    ``at`` is the byte where an item begins, so (path, at) is the order of all items; ``pos`` counts a file's array elements
    from 0. ``path`` is a file or a folder, local or of a file system that pyarrow knows; a file may hold one document or
    many, on lines of their own or not. Files whose brackets or quotes do not match are errors, as is a path without
    a byte in it; empty files beside others are skipped. Each task holds a range of ``range_bytes`` and the item that it ends in.
    """
    files = list_files(path)
    if not any(size for _, size in files):
        raise ValueError(f"{path} is empty")
    ranges = [(name, at, min(size, at + range_bytes), size) for name, size in files for at in range(0, size, range_bytes)]
    dealt = lambda rows, schema: ready(spark).createDataFrame(rows, schema).repartition(max(1, min(len(rows), 10_000)), "path", "start")
    states = _states(dealt(ranges, RANGE).mapInArrow(_scan, _SCAN).collect())  # a row a range
    return dealt(states, RANGE + ", in_string boolean, depth long, pos long").mapInArrow(_items, ITEM)
