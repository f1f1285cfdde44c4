"""Shortest paths by blocks of nodes: a task settles a block for some sources, and only what crosses its border is sent on.

Nodes are numbered in their order, so neighbours in a road network, whose ids follow each other, mostly share a block. A
block gets what arrives at its nodes, spreads it inside as arrays, and sends what it improved at its border to the blocks
beyond. What is kept between rounds are the distances of sources and of border nodes; a last pass spreads them over the
insides. So rounds follow the number of blocks on a path, not that of its nodes, and no task holds more than a block.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from viaduct.operators.sampling import ranked
from viaduct.session import drop_stored, observed, stored

K = "graph_id"
#: Nodes of a block, sources that are worked on together, and rounds after which what they improved is merged.
BLOCK_NODES, BLOCK_SOURCES, MERGE = 1 << 15, 16, 8
KNOWN, NEW, ARCS, NODES, SOURCES = range(5)
ROW = "block long, chunk long, kind int, raw binary"
_FAR = np.iinfo(np.int64).max
_ZSTD = pa.ipc.IpcWriteOptions(compression="zstd")


def _raw(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=_ZSTD) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _rows(found: list[tuple[int, int, int, pa.Table]]) -> pa.Table:
    block, chunk, kind = (pa.array([f[i] for f in found], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int32())))
    return pa.table({"block": block, "chunk": chunk, "kind": kind, "raw": pa.array([_raw(f[3]) for f in found], pa.binary())})


def _read(table: pa.Table, kind: int) -> pa.Table | None:
    """All rows of one kind of a group, or None if there is none."""
    own = [pa.ipc.open_stream(raw).read_all() for k, raw in zip(table.column("kind").to_pylist(), table.column("raw").to_pylist(), strict=True) if k == kind]
    return pa.concat_tables(own).combine_chunks() if own else None


def _packer(kind: int, order: list[tuple[str, str]], columns: list[str]):
    def pack(table: pa.Table) -> pa.Table:
        key = [table.column(c)[0].as_py() if c in table.column_names else 0 for c in ("block", "chunk")]
        return _rows([(*key, kind, table.sort_by(order).select(columns))])

    return pack


def _entries(source: np.ndarray, at: np.ndarray, dist: np.ndarray, origin: np.ndarray) -> pa.Table:
    return pa.table({"source": pa.array(source, pa.int32()), "at": pa.array(at, pa.int32()), "dist": pa.array(dist, pa.int64()), "origin": pa.array(origin, pa.int64())})


def _arrays(table: pa.Table | None, *columns: str) -> list[np.ndarray]:
    return [np.zeros(0, np.int64) if table is None else table.column(c).to_numpy().astype(np.int64) for c in columns]


def _fan(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers from each ``first``, ``count`` of them, one after the other."""
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


def _spread(flat: np.ndarray, front: np.ndarray, n: int, first: np.ndarray, to: np.ndarray, w: np.ndarray) -> None:
    """Lower ``flat``, ``n`` distances a source, along arcs inside a block until nothing changes, from the places ``front``."""
    count = np.diff(first)
    while len(front):
        v = front % n
        many = count[v]
        arc = _fan(first[v], many)
        place, dist = np.repeat(front - v, many) + to[arc], np.repeat(flat[front], many) + w[arc]
        better = dist < flat[place]
        place = place[better]
        np.minimum.at(flat, place, dist[better])
        front = np.unique(place)


class _Block:
    """The arcs of a block, inside and across its border, and distances of some sources."""

    def __init__(self, table: pa.Table, sources: np.ndarray, known: list[np.ndarray], block: int):
        at, to_block, to, w = _arrays(_read(table, ARCS), "at", "to_block", "to", "w")
        self.n = int(max(at.max(initial=0), to[to_block == block].max(initial=0), known[1].max(initial=0))) + 1
        inside = to_block == block
        self.first = np.searchsorted(at[inside], np.arange(self.n + 1))
        self.to, self.w = to[inside], w[inside]
        self.out = [x[~inside] for x in (at, to_block, to, w)]
        self.sources = sources
        self.flat = np.full(len(sources) * self.n, _FAR)

    def places(self, source: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.sources, source) * self.n + at

    def spread(self, front: np.ndarray) -> None:
        _spread(self.flat, np.unique(front), self.n, self.first, self.to, self.w)


def _settler(nodes: int):
    """One round of a block of ``nodes`` nodes and a chunk of sources: what is new is spread; what improved goes on."""

    def settle(table: pa.Table) -> pa.Table:
        block, chunk = table.column("block")[0].as_py(), table.column("chunk")[0].as_py()
        source, at, dist, origin = _arrays(_read(table, NEW), "source", "at", "dist", "origin")
        active = np.unique(source)
        known = _arrays(_read(table, KNOWN), "source", "at", "dist")
        known = [x[np.isin(known[0], active)] for x in known]
        own = _Block(table, active, [None, np.concatenate((at, known[1]))], block)
        np.minimum.at(own.flat, own.places(*known[:2]), known[2])
        place = own.places(source, at)
        better = dist < own.flat[place]
        source, at, dist, origin, place = (x[better] for x in (source, at, dist, origin, place))
        if not len(place):
            return _rows([])
        border, first = np.unique(own.out[0], return_index=True)
        first = np.append(first, len(own.out[0]))
        grid = own.flat.reshape(len(active), own.n)
        before = grid[:, border]
        np.minimum.at(own.flat, place, dist)
        least = dist == own.flat[place]
        came = np.full(len(own.flat), -1)
        came[place[least]] = origin[least]
        arrived = own.flat.copy()
        own.spread(place[least])
        after = grid[:, border]
        i, j = np.nonzero(after < before)
        better = after[i, j]
        kept = _entries(np.concatenate((source[least], active[i])), np.concatenate((at[least], border[j])), np.concatenate((dist[least], better)), np.full(least.sum() + len(i), -1))
        found = [(block, chunk, KNOWN, kept)]
        # what came from beyond and was not improved here is not sent back there
        cell = i * own.n + border[j]
        back = np.where(arrived[cell] == better, came[cell], -1)
        many = np.diff(first)[j]
        arc = _fan(first[j], many)
        _, to_block, to, w = (x[arc] for x in own.out)
        source, dist, back, mine = (np.repeat(x, many) for x in (active[i], better, back, block * nodes + border[j]))
        on = np.flatnonzero(to_block * nodes + to != back)
        order = on[np.lexsort((dist[on] + w[on], to[on], source[on], to_block[on]))]
        to_block, to, source, dist, mine = to_block[order], to[order], source[order], dist[order] + w[order], mine[order]
        new = np.append(True, (to_block[1:] != to_block[:-1]) | (source[1:] != source[:-1]) | (to[1:] != to[:-1]))[: len(order)]
        to_block, to, source, dist, mine = (x[new] for x in (to_block, to, source, dist, mine))
        some, cuts = np.unique(to_block, return_index=True)
        for b, lo, hi in zip(some.tolist(), cuts, np.append(cuts, len(to_block))[1:], strict=True):
            found.append((b, chunk, NEW, _entries(source[lo:hi], to[lo:hi], dist[lo:hi], mine[lo:hi])))
        return _rows(found)

    return settle


def _merge(table: pa.Table) -> pa.Table:
    """The least of all known distances of a block and a chunk."""
    whole = _read(table, KNOWN).group_by(["source", "at"]).aggregate([("dist", "min")])
    kept = _entries(*_arrays(whole, "source", "at", "dist_min"), np.full(len(whole), -1))
    return _rows([(table.column("block")[0].as_py(), table.column("chunk")[0].as_py(), KNOWN, kept)])


def _finisher(schema: T.StructType):
    """All distances of a block from a chunk of sources, by their names."""

    def finish(table: pa.Table) -> pa.Table:
        shape = to_arrow_schema(schema)
        source, at, dist = _arrays(_read(table, KNOWN), "source", "at", "dist")
        own = _Block(table, np.unique(source), [None, at], table.column("block")[0].as_py())
        place = own.places(source, at)
        np.minimum.at(own.flat, place, dist)
        own.spread(place)
        found = np.flatnonzero(own.flat != _FAR)
        names, nodes = _read(table, SOURCES), _read(table, NODES)
        which = pa.array(own.sources[found // own.n])
        columns = [names.column(K).take(which), names.column("s").take(which), nodes.column("v").take(pa.array(found % own.n)), pa.array(own.flat[found])]
        return pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, shape, strict=True)], schema=shape)

    return finish


def block_paths(start: DataFrame, steps: DataFrame, most_rounds: int, block_nodes: int = BLOCK_NODES, block_sources: int = BLOCK_SOURCES) -> DataFrame:
    """(graph_id, s, v, dist), stored: the least of ``start(graph_id, s, v, dist)`` and of what ``steps`` lead to from there.

    ``steps(graph_id, src, dst, w)`` go both ways, with whole weights that are not negative. The steps of one node lie in
    one block.
    """
    spark = start.sparkSession
    index, size = observed(ranked(steps.select(K, F.col("src").alias("v")).union(start.select(K, "v")).distinct(), [], K, "v", name="_id"), "index")
    sources, many = observed(ranked(start.select(K, "s").distinct(), [], K, "s", name="_id"), "sources")
    groups = -(-size["n"] // block_nodes) * -(-many["n"] // block_sources)
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), groups))
    cut = lambda n: (F.floor((F.col("_id") - 1) / n).cast("long"), ((F.col("_id") - 1) % n).cast("int"))
    (block, at), (chunk, source) = cut(block_nodes), cut(block_sources)
    nodes = index.select(K, "v", block.alias("block"), at.alias("at"))
    of = sources.select(K, "s", chunk.alias("chunk"), source.alias("source"))
    ends = nodes.select(K, F.col("v").alias("dst"), F.col("block").alias("to_block"), F.col("at").alias("to"))
    arcs = steps.join(nodes.withColumnRenamed("v", "src"), [K, "src"]).join(ends, [K, "dst"]).select("block", "at", "to_block", "to", "w")
    arcs = stored(arcs.groupBy("block").applyInArrow(_packer(ARCS, [("at", "ascending")], ["at", "to_block", "to", "w"]), ROW).drop("chunk"), "arcs")
    first = start.join(nodes, [K, "v"]).join(of, [K, "s"]).select("block", "chunk", "source", "at", "dist", F.lit(-1).cast("long").alias("origin"))
    new = stored(first.groupBy("block", "chunk").applyInArrow(_packer(NEW, [("source", "ascending")], ["source", "at", "dist", "origin"]), ROW), "dist")
    key, columns = ["block", "chunk"], ["block", "chunk", "kind", "raw"]
    dealt = lambda df: df.repartition(parts, *key).groupBy(*key)  # noqa: E731 (few bytes, much work: not to be put together)
    made, known = [new], []
    for k in range(most_rounds):
        active = new.select(*key).distinct()
        own = new.unionByName(arcs.join(active, "block").select(*columns))
        for part in known:
            own = own.unionByName(part.join(active, key, "left_semi").select(*columns))
        out, seen = observed(dealt(own).applyInArrow(_settler(block_nodes), ROW), "dist", n=F.count_if(F.col("kind") == NEW))
        made.append(out)
        known.append(out.filter(F.col("kind") == KNOWN))
        new = out.filter(F.col("kind") == NEW)
        if not seen["n"]:
            break
        if k % MERGE == MERGE - 1:
            whole = stored(dealt(_all(known)).applyInArrow(_merge, ROW), "dist")
            drop_stored(*made[:-1])
            made, known = [whole, out], [whole]
    else:
        raise RuntimeError(f"paths did not settle within {most_rounds} rounds")
    held = _all(known)
    active = held.select(*key).distinct()
    named = nodes.groupBy("block").applyInArrow(_packer(NODES, [("at", "ascending")], ["v"]), ROW).drop("chunk")
    listed = of.groupBy("chunk").applyInArrow(_packer(SOURCES, [("source", "ascending")], [K, "s"]), ROW).drop("block")
    own = held
    for table, on in ((arcs, "block"), (named, "block"), (listed, "chunk")):
        own = own.unionByName(table.join(active, on).select(*columns))
    schema = T.StructType([start.schema[K], start.schema["s"], start.schema["v"], T.StructField("dist", T.LongType())])
    done = stored(dealt(own).applyInArrow(_finisher(schema), schema), "dist")
    drop_stored(index, sources, arcs, *made)
    return done


def _all(parts: list[DataFrame]) -> DataFrame:
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole
