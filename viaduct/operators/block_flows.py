"""What flows along shortest paths, by blocks of nodes: sums are pushed along their steps as arrays in tasks.

Blocks and groups of sources are those of ``block_paths``. Each block first learns how far its neighbours beyond the border
are, and so which of its arcs are steps of shortest paths from which source; these are kept packed. What is pushed along
them is a linear sum over an acyclic graph: a block spreads what arrives inside, and sends on what crosses its border. So
rounds follow the blocks that a path crosses, and a round reads packed steps, not rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.operators.block_paths import BLOCK_NODES, BLOCK_SOURCES, ROW, K, _all, _fan, _packer, _read, _rows
from viaduct.operators.sampling import ranked
from viaduct.session import drop_stored, observed, stored

GRID, BEYOND, ARCS, OUT, INTO, NEW, SUMS, START, DEMAND = range(9)
OF_NODES, OF_EDGES = range(2)
KEY, COLUMNS = ["block", "chunk"], ["block", "chunk", "kind", "raw"]
VISITED = "block long, chunk long, source int, at int, to_block long, to int"
FOUND = "kind int, block long, at int, to_block long, to int, value double"


def _columns(table: pa.Table, kind: int, *names: str) -> list[np.ndarray]:
    own = _read(table, kind)
    return [np.zeros(0, np.int64) if own is None else own.column(c).to_numpy() for c in names]


def _key(table: pa.Table) -> tuple[int, int]:
    return table.column("block")[0].as_py(), table.column("chunk")[0].as_py()


def _entries(source: np.ndarray, at: np.ndarray, value: np.ndarray) -> pa.Table:
    return pa.table({"source": pa.array(source, pa.int32()), "at": pa.array(at, pa.int32()), "value": pa.array(value)})


def _links(source: np.ndarray, at: np.ndarray, to_block: np.ndarray, to: np.ndarray) -> pa.Table:
    return pa.table({"source": pa.array(source, pa.int32()), "at": pa.array(at, pa.int32()), "to_block": pa.array(to_block, pa.int64()), "to": pa.array(to, pa.int32())})


def _sender(kind: int):
    """What entries of ``kind`` a block tells those beyond its border, its ``BEYOND``: at the nodes that they have arcs to."""

    def send(table: pa.Table) -> pa.Table:
        block, chunk = _key(table)
        source, at, value = _columns(table, kind, "source", "at", "value")
        own, to_block = _columns(table, ARCS, "at", "to_block")
        found = []
        for b in np.unique(to_block[to_block != block]).tolist():
            told = np.isin(at, own[to_block == b])
            if told.any():
                entries = _entries(source[told], at[told], value[told])
                found.append((b, chunk, BEYOND, entries.append_column("of", pa.array(np.full(len(entries), block, np.int64)))))
        return _rows(found)

    return send


class _Lookup:
    """Values at places (source, block, node) of a block and beyond its border, or ``missing``."""

    def __init__(self, table: pa.Table, kind: int, nodes: int, missing):
        self.nodes, self.missing = nodes, missing
        block, _ = _key(table)
        source, at, value = _columns(table, kind, "source", "at", "value")
        far, there, beyond, of = _columns(table, BEYOND, "source", "at", "value", "of")
        self.code = np.concatenate((block * nodes + at, of * nodes + there)).astype(np.int64)
        self.source, self.value = np.concatenate((source, far)), np.concatenate((value, beyond))
        order = np.lexsort((self.code, self.source))
        self.code, self.source, self.value = self.code[order], self.source[order], self.value[order]

    def of(self, source: int, block: np.ndarray, at: np.ndarray) -> np.ndarray:
        lo, hi = np.searchsorted(self.source, [source, source + 1])
        code, value = self.code[lo:hi], self.value[lo:hi]
        if not len(code):
            return np.full(len(at), self.missing)
        want = block * self.nodes + at
        place = np.minimum(np.searchsorted(code, want), len(code) - 1)
        return np.where(code[place] == want, value[place], self.missing)


def _stepper(nodes: int, least: bool):
    """The steps of shortest paths out of a block's nodes and into them; ``least``: only the one from the least node into each."""

    def find(table: pa.Table) -> pa.Table:
        block, chunk = _key(table)
        dist = _Lookup(table, GRID, nodes, -1)
        at, to_block, to, w = _columns(table, ARCS, "at", "to_block", "to", "w")
        out, into = [], []
        for source in np.unique(_columns(table, GRID, "source")[0]).tolist():
            here, there = dist.of(source, np.full(len(at), block), at), dist.of(source, to_block, to)
            both = (here >= 0) & (there >= 0)
            for held, mark in ((out, both & (here + w == there)), (into, both & (there + w == here))):
                k = np.flatnonzero(mark)
                if held is into and least:
                    k = k[np.lexsort((to[k], to_block[k], at[k]))]
                    k = k[np.append(True, at[k][1:] != at[k][:-1])[: len(k)]]
                held.append(_links(np.full(len(k), source), at[k], to_block[k], to[k]))
        found = [(block, chunk, INTO, pa.concat_tables(into))] if into else []
        if out and not least:
            found.append((block, chunk, OUT, pa.concat_tables(out)))
        return _rows(found)

    return find


def _pusher(kind: int):
    """One round: what is new at a block's nodes is spread along its steps of ``kind``, and sent on where they lead out."""

    def push(table: pa.Table) -> pa.Table:
        block, chunk = _key(table)
        source, at, value = _columns(table, NEW, "source", "at", "value")
        own, start, to_block, to = (x.astype(np.int64) for x in _columns(table, kind, "source", "at", "to_block", "to"))
        inside = to_block == block
        n = int(max(at.max(initial=0), start.max(initial=0), to[inside].max(initial=0))) + 1
        size = (int(max(source.max(initial=0), own.max(initial=0))) + 1) * n
        place = own * n + start
        order = np.argsort(place, kind="stable")
        place, own, to_block, to, inside = (x[order] for x in (place, own, to_block, to, inside))
        first = np.searchsorted(place, np.arange(size + 1))
        target = own * n + to
        total, fresh = np.zeros(size), np.zeros(size)
        np.add.at(fresh, source.astype(np.int64) * n + at, value)
        front = np.unique(source.astype(np.int64) * n + at)
        gone = np.zeros(len(place))
        while len(front):
            now = fresh[front]
            total[front] += now
            fresh[front] = 0.0
            many = first[front + 1] - first[front]
            arc, now = _fan(first[front], many), np.repeat(now, many)
            stays = inside[arc]
            gone[arc[~stays]] += now[~stays]
            np.add.at(fresh, target[arc[stays]], now[stays])
            front = np.unique(target[arc[stays]])
        k = np.flatnonzero(total)
        found = [(block, chunk, SUMS, _entries(k // n, k % n, total[k]))]
        k = np.flatnonzero(gone)
        sent = pa.table({"b": to_block[k], "source": own[k], "at": to[k], "value": gone[k]}).group_by(["b", "source", "at"]).aggregate([("value", "sum")]).sort_by("b")
        b, source, at, value = (sent.column(c).to_numpy() for c in ("b", "source", "at", "value_sum"))
        some, cuts = np.unique(b, return_index=True)
        for x, lo, hi in zip(some.tolist(), cuts, np.append(cuts, len(b))[1:], strict=True):
            found.append((x, chunk, NEW, _entries(source[lo:hi], at[lo:hi], value[lo:hi])))
        return _rows(found)

    return push


def _merge(table: pa.Table) -> pa.Table:
    """All sums of a block as one table."""
    whole = _read(table, SUMS).group_by(["source", "at"]).aggregate([("value", "sum")])
    return _rows([(*_key(table), SUMS, _entries(*(whole.column(c).to_numpy() for c in ("source", "at", "value_sum"))))])


def _backer(demanded: bool):
    """What each node that a source reaches is worth, divided by the number of paths there."""

    def back(table: pa.Table) -> pa.Table:
        source, at, paths = _columns(table, SUMS, "source", "at", "value")
        own, start = _columns(table, START, "source", "at")
        worth = np.ones(len(at))
        code = source.astype(np.int64) << 32 | at
        if demanded:
            wanted, there, demand = _columns(table, DEMAND, "source", "at", "value")
            key = wanted.astype(np.int64) << 32 | there.astype(np.int64)
            order = np.argsort(key)
            place = np.minimum(np.searchsorted(key[order], code), max(0, len(key) - 1))
            worth = np.where(key[order][place] == code, demand[order][place], 0.0) if len(key) else np.zeros(len(at))
        on = (worth > 0) & ~np.isin(code, own.astype(np.int64) << 32 | start.astype(np.int64))
        entries = _entries(source[on], at[on], worth[on])
        return _rows([(*_key(table), DEMAND, entries), (*_key(table), NEW, _entries(source[on], at[on], (worth / paths)[on]))])

    return back


def _summer(nodes: int):
    """What passes each node of a block and each step into one, over all sources of the group.

    GRID holds path counts here, SUMS the shares pushed back.
    """

    def total(table: pa.Table) -> pa.Table:
        block, _ = _key(table)
        paths = _Lookup(table, GRID, nodes, 0.0)
        source, at, share = _columns(table, SUMS, "source", "at", "value")
        worth_of, worth_at, worth = _columns(table, DEMAND, "source", "at", "value")
        own, start = _columns(table, START, "source", "at")
        out, v, to_block, to = _columns(table, INTO, "source", "at", "to_block", "to")
        n = int(max(x.max(initial=0) for x in (at, worth_at, start, v))) + 1
        passed = np.zeros(n)
        arcs = []
        for s in np.unique(source).tolist():
            shares = np.zeros(n)
            k = source == s
            shares[at[k]] = share[k]
            k = k.nonzero()[0]
            through = paths.of(s, np.full(len(k), block), at[k]) * share[k]
            through[np.isin(at[k], start[own == s])] = 0.0
            passed[at[k]] += through
            k = worth_of == s
            passed[worth_at[k]] -= worth[k]
            k = np.flatnonzero(out == s)
            used = paths.of(s, to_block[k], to[k]) * shares[v[k]]
            arcs.append(pa.table({"at": pa.array(v[k], pa.int32()), "to_block": pa.array(to_block[k], pa.int64()), "to": pa.array(to[k], pa.int32()), "value": pa.array(used, pa.float64())}))
        k = np.flatnonzero(passed)
        none = pa.table({"kind": pa.array(np.full(len(k), OF_NODES), pa.int32()), "block": pa.array(np.full(len(k), block), pa.int64()), "at": pa.array(k, pa.int32()),
                         "to_block": pa.array(np.full(len(k), block), pa.int64()), "to": pa.array(k, pa.int32()), "value": pa.array(passed[k])})
        if not arcs:
            return none
        e = pa.concat_tables(arcs).group_by(["at", "to_block", "to"]).aggregate([("value", "sum")])
        e = pa.table({"kind": pa.array(np.full(len(e), OF_EDGES), pa.int32()), "block": pa.array(np.full(len(e), block), pa.int64()), "at": e.column("at"), "to_block": e.column("to_block"), "to": e.column("to"), "value": e.column("value_sum")})
        return pa.concat_tables([none, e])

    return total


def _visits(table: pa.Table) -> pa.Table:
    """The steps into the nodes that something was pushed to."""
    source, at = _columns(table, SUMS, "source", "at")
    own = _read(table, INTO)
    seen = np.unique(source.astype(np.int64) << 32 | at.astype(np.int64))
    if own is None:
        own = _links(*[np.zeros(0, np.int64)] * 4)
    own = own.filter(pa.array(np.isin(own.column("source").to_numpy().astype(np.int64) << 32 | own.column("at").to_numpy().astype(np.int64), seen)))
    block, chunk = (pa.array(np.full(len(own), x), pa.int64()) for x in _key(table))
    return pa.table({"block": block, "chunk": chunk, **{c: own.column(c) for c in ("source", "at", "to_block", "to")}})


class Flows:
    """Steps of shortest paths by blocks, from ``dist(graph_id, s, v, dist)`` over ``steps(graph_id, src, dst, w)``, both ways.

    Weights are whole and positive. With ``least`` only one step into each node is kept, that from the least node.
    """

    def __init__(self, steps: DataFrame, dist: DataFrame, least: bool = False, block_nodes: int | None = None, block_sources: int | None = None):
        block_nodes, block_sources = block_nodes or BLOCK_NODES, block_sources or BLOCK_SOURCES
        spark, self.size = dist.sparkSession, block_nodes
        every = steps.select(K, F.col("src").alias("v")).union(dist.filter("s = v").select(K, "v")).distinct()
        self.index, size = observed(ranked(every, [], K, "v", name="_id"), "index")
        self.sources, many = observed(ranked(dist.filter("s = v").select(K, "s"), [], K, "s", name="_id"), "sources")
        groups = -(-size["n"] // block_nodes) * -(-many["n"] // block_sources)
        self.parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), groups))
        cut = lambda n: (F.floor((F.col("_id") - 1) / n).cast("long"), ((F.col("_id") - 1) % n).cast("int"))
        (block, at), (chunk, source) = cut(block_nodes), cut(block_sources)
        self.nodes, self.of = self.index.select(K, "v", block.alias("block"), at.alias("at")), self.sources.select(K, "s", chunk.alias("chunk"), source.alias("source"))
        ends = self.nodes.select(K, F.col("v").alias("dst"), F.col("block").alias("to_block"), F.col("at").alias("to"))
        arcs = steps.join(self.nodes.withColumnRenamed("v", "src"), [K, "src"]).join(ends, [K, "dst"]).select("block", "at", "to_block", "to", "w")
        self.arcs = stored(arcs.groupBy("block").applyInArrow(_packer(ARCS, [("at", "ascending")], ["at", "to_block", "to", "w"]), ROW).drop("chunk"), "arcs")
        grid = self.packed(dist.withColumn("value", F.col("dist").cast("long")), GRID)
        self.active = stored(grid.select(*KEY), "active")
        beyond = stored(self.run(_sender(GRID), grid, arcs=True), "beyond")
        self.steps = stored(self.run(_stepper(block_nodes, least), grid, beyond, arcs=True), "steps")
        drop_stored(grid, beyond)

    def packed(self, rows: DataFrame, kind: int) -> DataFrame:
        """Rows (graph_id, s, v, value), packed by block and group of sources, stored."""
        own = rows.join(self.nodes, [K, "v"]).join(self.of, [K, "s"]).select(*KEY, "source", "at", "value")
        return stored(own.groupBy(*KEY).applyInArrow(_packer(kind, [("source", "ascending"), ("at", "ascending")], ["source", "at", "value"]), ROW), "packed")

    def run(self, work, *tables: DataFrame, arcs: bool = False, shape: str = ROW) -> DataFrame:
        """``work`` on all rows of each block and group of sources, and on the arcs of the block."""
        own = _all([t.select(*COLUMNS) for t in tables])
        if arcs:
            own = own.unionByName(self.arcs.join(self.active, "block").select(*COLUMNS))
        return own.repartition(self.parts, *KEY).groupBy(*KEY).applyInArrow(work, shape)

    def kind(self, table: DataFrame, *kinds: int) -> DataFrame:
        return table.filter(F.col("kind").isin(*kinds))

    def pushed(self, start: DataFrame, kind: int, most_rounds: int = 10_000) -> DataFrame:
        """The sums of what ``start`` pushes along the steps of ``kind``, packed, stored."""
        own, new, made = self.kind(self.steps, kind), start, []
        for _ in range(most_rounds):
            here = own.join(new.select(*KEY).distinct(), KEY, "left_semi")
            out, seen = observed(self.run(_pusher(kind), new, here), "pushed", n=F.count_if(F.col("kind") == NEW))
            made.append(out)
            new = self.kind(out, NEW)
            if not seen["n"]:
                break
        else:
            raise RuntimeError(f"flows did not settle within {most_rounds} rounds")
        whole = stored(self.run(_merge, *[self.kind(t, SUMS) for t in made]), "sums")
        drop_stored(*made)
        return whole

    def starts(self, kind: int) -> DataFrame:
        return self.packed(self.of.select(K, "s", F.col("s").alias("v"), F.lit(1.0).alias("value")), kind)

    def as_kind(self, table: DataFrame, kind: int) -> DataFrame:
        return table.withColumn("kind", F.lit(kind))

    def named(self, rows: DataFrame, *ends: tuple[str, str, str]) -> DataFrame:
        """``rows`` with the names of nodes: for each (block, at, name) of ``ends`` a column of that name."""
        for block, at, name in ends:
            own = self.nodes.select(K, F.col("v").alias(name), F.col("block").alias(block), F.col("at").alias(at))
            rows = rows.join(own if K not in rows.columns else own.drop(K), [block, at]).drop(at)
        return rows

    def loads(self, demand: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """(graph_id, node, raw) and (graph_id, src, dst, raw), src < dst: what passes nodes and edges, stored.

        Each target counts 1, or as ``demand(graph_id, s, v, demand)`` says, and is split evenly over its shortest paths; the
        ends of a path do not count for themselves.
        """
        first = self.starts(NEW)
        begin = self.as_kind(first, START)
        paths = self.pushed(first, OUT)
        wanted = [] if demand is None else [self.packed(demand.withColumn("value", F.col("demand").cast("double")), DEMAND)]
        back = stored(self.run(_backer(demand is not None), paths, begin, *wanted), "back")
        share = self.pushed(self.kind(back, NEW), INTO)
        held = self.as_kind(paths, GRID)
        beyond = self.run(_sender(GRID), held, arcs=True)
        found = stored(self.run(_summer(self.size), held, beyond, share, self.kind(back, DEMAND), begin, self.kind(self.steps, INTO), shape=FOUND), "loads")
        found = found.groupBy("kind", "block", "at", "to_block", "to").agg(F.sum("value").alias("raw"))
        nodes = self.named(found.filter(F.col("kind") == OF_NODES), ("block", "at", "node")).select(K, "node", "raw")
        edges = self.named(found.filter(F.col("kind") == OF_EDGES).withColumnsRenamed({"to_block": "b"}), ("block", "at", "v"), ("b", "to", "u"))
        edges = edges.groupBy(K, F.least("u", "v").alias("src"), F.greatest("u", "v").alias("dst")).agg(F.sum("raw").alias("raw"))
        done = stored(nodes, "nodes"), stored(edges, "edges")
        drop_stored(first, paths, back, share, *wanted)
        return done

    def ways_to(self, ends: DataFrame) -> DataFrame:
        """(graph_id, s, v, parent), stored: the steps back from ``ends(graph_id, s, v)`` to their sources."""
        seen = self.pushed(self.packed(ends.select(K, "s", "v").distinct().withColumn("value", F.lit(1.0)), NEW), INTO)
        steps = self.run(_visits, seen, self.kind(self.steps, INTO), shape=VISITED)
        named = self.named(steps.withColumnsRenamed({"to_block": "b"}), ("block", "at", "v"), ("b", "to", "parent"))
        return stored(named.join(self.of, [K, "chunk", "source"]).select(K, "s", "v", "parent"), "ways")

    def drop(self) -> None:
        drop_stored(self.index, self.sources, self.arcs, self.active, self.steps)
