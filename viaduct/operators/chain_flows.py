"""Exact distances and flows from all nodes of a network that fits into a task: sources are dealt out, not the network.

Most nodes of a road network, or of one of users who name two others each, lie inside chains of nodes with two neighbours.
Only hubs, where chains end, and the sources of a batch are settled; what lies inside a chain is reached from its two ends,
and which end is nearer, and what flows along the chain, follow from their distances by counting. A task holds the network
and some sources' distances to hubs as arrays, so its memory is bounded by ``MOST_EDGES`` and ``CELLS``.
"""

from __future__ import annotations

import numpy as np

#: Edges at most of a network that a task holds, and cells (a chain or node and a source) that are worked on at once.
MOST_EDGES, CELLS, MOST_SOURCES = 1 << 22, 1 << 23, 64
#: Ends of pieces at a hub that are worked on one by one for all hubs; further ones are summed up by hub.
MOST_RANKS = 256


def _fan(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())


class Chains:
    """A network of ``src``, ``dst`` and whole ``w``, each pair of nodes once, cut into chains.

    A chain runs from a hub over nodes with two neighbours to a hub, or to a dead end (-1). All chains' inner nodes lie one
    after the other in ``order``, ``pos`` from their first hub; chain k has one edge more than inner nodes, in ``edge``.
    """

    def __init__(self, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
        self.names = np.unique(np.concatenate((src, dst)))
        u, v = np.searchsorted(self.names, src), np.searchsorted(self.names, dst)
        self.n, self.m = len(self.names), len(src)
        self.kind, self.far = (np.int32, 1 << 30) if int(w.sum()) < 1 << 28 else (np.int64, 1 << 61)
        ends, other, by = np.concatenate((u, v)), np.concatenate((v, u)), np.tile(np.arange(self.m), 2)
        sort = np.argsort(ends, kind="stable")
        degree = np.bincount(ends, minlength=self.n)
        first = np.append(0, np.cumsum(degree))
        hub = degree > 2
        self._walk(hub, degree, first.tolist(), other[sort].tolist(), by[sort].tolist(), w.tolist())
        self.hubs = np.flatnonzero(self.hub)
        self.flat = np.full(self.n, -1)
        self.flat[self.order] = np.arange(len(self.order))
        self.place = np.full(self.n + 1, -1)
        self.place[self.hubs] = np.arange(len(self.hubs))
        count = np.diff(self.nodes_from)
        self.chain = np.repeat(np.arange(len(count)), count)
        self.edges_from = self.nodes_from + np.arange(len(self.nodes_from))

    def _walk(self, hub: np.ndarray, degree: np.ndarray, first: list, other: list, by: list, w: list) -> None:
        self.hub = hub.copy()
        is_hub, deg, used, seen = hub.tolist(), degree.tolist(), bytearray(self.m), bytearray(self.n)
        order, pos, edge, begin, a, b, length = [], [], [], [0], [], [], []

        def walk(start: int) -> None:
            seen[start] = 1
            for i in range(first[start], first[start + 1]):
                if used[by[i]]:
                    continue
                at, e = other[i], by[i]
                used[e] = 1
                edge.append(e)
                d = w[e]
                while not is_hub[at]:
                    seen[at] = 1
                    order.append(at)
                    pos.append(d)
                    k = first[at]
                    if deg[at] == 1:
                        at = -1
                        edge.append(-1)
                        break
                    if by[k] == e:
                        k += 1
                    e, at = by[k], other[k]
                    used[e] = 1
                    edge.append(e)
                    d += w[e]
                begin.append(len(order))
                a.append(start)
                b.append(at)
                length.append(d)

        for start in np.flatnonzero(hub).tolist():
            walk(start)
        for most in (1, 2):  # paths and circles without a hub
            for start in np.flatnonzero(degree == most).tolist():
                if not seen[start]:
                    is_hub[start] = self.hub[start] = True
                    walk(start)
        self.order, self.edge, self.nodes_from = np.array(order, np.int64), np.array(edge, np.int64), np.array(begin, np.int64)
        self.pos, self.length = np.array(pos, np.int64), np.array(length, np.int64)
        self.a, self.b = np.array(a, np.int64), np.array(b, np.int64)

    def batches(self, sources: np.ndarray) -> list[np.ndarray]:
        """Numbers of nodes, neighbours together, in batches that keep arrays within ``CELLS``."""
        size = max(1, min(MOST_SOURCES, CELLS // max(1, len(self.a))))
        at = np.where(self.flat[sources] >= 0, self.flat[sources], len(self.order))
        near = sources[np.lexsort((sources, at))]
        return [near[i : i + size] for i in range(0, len(near), size)]


class Batch:
    """Distances of some sources to all hubs and to each other; chains are cut where a source lies inside."""

    def __init__(self, net: Chains, sources: np.ndarray):
        self.net, self.sources, self.s = net, sources, len(sources)
        self.cut = cut = np.sort(net.flat[sources][net.flat[sources] >= 0])
        self.core = np.concatenate((net.hubs, net.order[cut]))
        self.nc = len(self.core)
        self.place = net.place.copy()
        self.place[net.order[cut]] = len(net.hubs) + np.arange(len(cut))
        self.place[-1] = self.nc  # where dead ends lead: never reached
        begin = net.edges_from
        self.lo = np.sort(np.concatenate((begin[:-1], cut + net.chain[cut] + 1)))
        self.hi = np.append(self.lo[1:], begin[-1])
        k = np.searchsorted(begin, self.lo, side="right") - 1
        left, right = self.lo == begin[k], self.hi == begin[k + 1]
        before, after = np.where(left, 0, self.lo - k - 1), np.where(right, 0, self.hi - 1 - k)
        order, pos = (net.order, net.pos) if len(net.order) else (np.zeros(1, np.int64),) * 2
        a, b = np.where(left, net.a[k], order[before]), np.where(right, net.b[k], order[after])
        self.from_ = np.where(left, 0, pos[before])
        self.long = np.where(right, net.length[k], pos[after]) - self.from_
        self.many, self.node = self.hi - self.lo - 1, self.lo - k
        self._ranks(self.place[a], self.place[b])
        self.own = self.place[sources]
        self._settle()

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> None:
        """Number hubs by how many pieces end there, most first: the r-th ends of all are those of the first so many hubs."""
        pieces = np.arange(len(a))
        end, other, piece = np.concatenate((a, b)), np.concatenate((b, a)), np.concatenate((pieces, pieces + len(a)))
        count = np.bincount(end, minlength=self.nc + 1)[: self.nc]
        sort = np.argsort(-count, kind="stable")
        number = np.append(sort, self.nc)
        number[sort] = np.arange(self.nc)
        self.core, count = self.core[sort], count[sort]
        self.place = np.where(self.place >= 0, number[self.place], -1)
        self.a, self.b = number[a], number[b]
        end, other = number[end], number[other]
        by = np.argsort(end, kind="stable")[: count.sum()]  # without dead ends
        first = np.append(0, np.cumsum(count))
        w = np.tile(self.long, 2).astype(self.net.kind)
        w[other == end] = 0
        other = np.where(other == end, self.nc, other)  # a piece that comes back leads nowhere
        self.ranks = []
        for r in range(min(MOST_RANKS, int(count.max(initial=0)))):
            at = by[first[: np.searchsorted(-count, -r)] + r]
            self.ranks.append((len(at), other[at], w[at][:, None], piece[at]))
        rest = by[np.concatenate([np.arange(x + MOST_RANKS, y) for x, y in zip(first[:-1], first[1:], strict=True) if y - x > MOST_RANKS] or [np.zeros(0, np.int64)])]
        self.rest = (end[rest], other[rest], w[rest][:, None], piece[rest])
        self.arcs = (end[by], other[by], w[by][:, None])

    def _settle(self) -> None:
        dst, src, w = self.arcs
        self.dist = dist = np.full((self.nc + 1, self.s), self.net.far, self.net.kind)
        dist[self.own, np.arange(self.s)] = 0
        new = np.zeros(self.nc + 1, bool)
        new[self.own] = True
        while True:
            arc = np.flatnonzero(new[src])
            if not len(arc):
                return
            new[:] = False
            if 4 * len(arc) < len(src):
                self._lower(dst[arc], src[arc], w[arc], new)
                continue
            before = dist.copy()
            for many, other, far, _ in self.ranks:
                found = dist[other]
                found += far
                np.minimum(dist[:many], found, out=dist[:many])
            self._lower(*self.rest[:3], new)
            new |= (dist < before).any(axis=1)

    def _lower(self, dst: np.ndarray, src: np.ndarray, w: np.ndarray, new: np.ndarray) -> None:
        """Lower distances by arcs that are sorted by where they lead, and mark what is lower."""
        if not len(dst):
            return
        first = np.flatnonzero(np.append(True, dst[1:] != dst[:-1]))
        rows = dst[first]
        found = np.minimum.reduceat(self.dist[src] + w, first, axis=0)
        better = (found < self.dist[rows]).any(axis=1)
        rows = rows[better]
        self.dist[rows] = np.minimum(self.dist[rows], found[better])
        new[rows] = True

    def _ended(self, parts: np.ndarray) -> np.ndarray:
        """Of each hub the sum of ``parts``, rows for the first ends of all pieces, then for their last ones."""
        total = np.zeros((self.nc + 1, self.s), np.int64)
        for many, _, _, piece in self.ranks:
            total[:many] += parts[piece]
        end, _, _, piece = self.rest
        if len(end):
            first = np.flatnonzero(np.append(True, end[1:] != end[:-1]))
            total[end[first]] += np.add.reduceat(parts[piece], first, axis=0, dtype=np.int64)
        return total

    def locate(self, node: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of nodes inside chains their place in the order, the piece they lie in, and how far its ends are."""
        i = self.net.flat[node]
        k = np.searchsorted(self.lo, i + self.net.chain[i], side="right") - 1
        la = self.net.pos[i] - self.from_[k]
        return i, k, la, self.long[k] - la

    def to(self, source: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Distances from the sources numbered ``source`` to nodes, ``far`` or more where none is."""
        core = self.place[node]
        out = self.dist[np.where(core >= 0, core, 0), source].astype(np.int64)
        inner = np.flatnonzero(core < 0)
        _, k, la, lb = self.locate(node[inner])
        out[inner] = np.minimum(self.dist[self.a[k], source[inner]] + la, self.dist[self.b[k], source[inner]] + lb)
        return out

    def nearness(self, unit: float) -> np.ndarray:
        """Of each source the sum of ``unit`` over its distance to every node that it reaches, but for those at 0."""
        total = self._near(self.dist, unit)
        which = np.repeat(np.arange(len(self.lo)), self.many)
        inner = _fan(self.node, self.many)
        la = (self.net.pos[inner] - self.from_[which]).astype(self.net.kind)
        lb = (self.long[which] - la).astype(self.net.kind)
        step = max(1, CELLS // 4 // self.s)
        for i in range(0, len(which), step):
            at = which[i : i + step]
            d = self.dist[self.a[at]]
            d += la[i : i + step, None]
            other = self.dist[self.b[at]]
            other += lb[i : i + step, None]
            total += self._near(np.minimum(d, other, out=d), unit)
        return total

    def _near(self, d: np.ndarray, unit: float) -> np.ndarray:
        if (d <= 0).any() or (d >= self.net.far).any():
            on = (d > 0) & (d < self.net.far)
            return np.divide(unit, d, out=np.zeros(d.shape), where=on).sum(axis=0)
        return np.divide(unit, d).sum(axis=0)

    def loads(self, sums: Sums, demand: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None) -> None:
        """Add to ``sums`` what passes nodes and edges: 1 to each node a source reaches, or ``demand`` (source, node, value)."""
        net, s = self.net, self.s
        far, dist = net.far, self.dist
        dist_a = dist[self.a]
        gap = dist[self.b] - dist_a
        here = dist_a < far
        del dist_a
        whole = here.all()
        long = self.long.astype(net.kind)[:, None]
        (k, j), (k2, j2) = (np.divmod(np.flatnonzero(tight if whole else tight & here), s) for tight in (gap == long, gap == -long))
        src, dst = np.concatenate((self.a[k] * s + j, self.b[k2] * s + j2)), np.concatenate((self.b[k] * s + j, self.a[k2] * s + j2))
        piece = np.concatenate((k, k2 + len(self.lo)))
        sort = np.argsort(src)
        src, dst, piece = src[sort], dst[sort], piece[sort]
        size = (self.nc + 1) * s
        count = np.bincount(src, minlength=size)
        first = np.cumsum(count) - count
        wait = np.bincount(dst, minlength=size)
        paths = np.zeros(size)
        front = self.own * s + np.arange(s)
        paths[front] = 1.0
        rounds = []
        while len(front):
            arc = _fan(first[front], count[front])
            to = dst[arc]
            np.add.at(paths, to, paths[src[arc]])
            np.subtract.at(wait, to, 1)
            front = np.unique(to[wait[to] == 0])
            rounds.append(arc)
        edges = np.zeros((2, len(net.edge) + 1))  # away from a chain's first hub, and towards it
        mass, share = np.zeros(len(net.order)), np.zeros(size)
        if demand is None:
            worth = np.ones(size)
            ramp, (k, j, i) = self._halves(gap, here, whole, share)
            mass[_fan(self.node, self.many)] += np.repeat(here.sum(axis=1), self.many)
            value, nearer = np.ones(len(k)), np.full(len(k), 0)
        else:
            ramp, worth = None, np.zeros(size)
            j, node, value = demand
            ok = self.to(j, node) < far
            j, node, value = j[ok], node[ok], value[ok]
            sums.carried += value.sum()
            core = self.place[node]
            ok = core >= 0
            np.add.at(worth, core[ok] * s + j[ok], value[ok])
            j, node, value = j[~ok], node[~ok], value[~ok]
            i, k, la, lb = self.locate(node)
            d, other = dist[self.a[k], j] + la, dist[self.b[k], j] + lb
            nearer = np.sign(d - other)
            np.add.at(mass, i, value)
        a, b = self.a[k] * s + j, self.b[k] * s + j
        with np.errstate(divide="ignore", invalid="ignore"):
            part = np.where(nearer < 0, 1.0, np.where(nearer > 0, 0.0, paths[a] / (paths[a] + paths[b]))) * value
        np.add.at(share, a, part)
        np.add.at(share, b, value - part)
        passed = np.zeros(len(src))
        for arc in reversed(rounds):
            x, y = src[arc], dst[arc]
            passed[arc] = flow = paths[x] / paths[y] * (worth[y] + share[y])
            np.add.at(share, x, flow)
        share[self.own * s + np.arange(s)] = 0.0
        sums.nodes[self.core] += share.reshape(self.nc + 1, s)[: self.nc].sum(axis=1)
        through = np.bincount(piece, weights=passed, minlength=2 * len(self.lo))
        wide = self.hi - self.lo
        at = i + net.chain[i]  # the edge before the node
        for way, begin in enumerate((at, at + 1)):
            step = np.zeros(len(net.edge))
            np.add.at(step, begin, part if way == 0 else value - part)
            more = 0.0
            if ramp is not None:
                more = self._along(ramp[way], way, False)
            edges[way, :-1] = np.repeat(through[way * len(self.lo) :][: len(self.lo)], wide) + self._along(step + more, way, True)
        before = np.arange(len(net.order)) + net.chain
        inner = edges[0][before] + edges[1][before + 1] - mass
        inner[self.cut] = 0.0
        sums.nodes[net.order] += inner
        real = net.edge >= 0
        sums.edges[net.edge[real]] += (edges[0] + edges[1])[:-1][real]

    def _halves(self, gap: np.ndarray, here: np.ndarray, whole: bool, share: np.ndarray):
        """How many nodes inside each piece are reached from its ends: as counts by place, added to ``share``; and the ties."""
        size = len(self.net.edge)
        ramp, ties = np.zeros((2, size)), []
        most = int(self.many.max(initial=0))
        parts = np.zeros((2 * len(gap), self.s), np.uint8 if most < 256 else np.int64)
        for few in (True, False):
            own = np.flatnonzero(self.many == 1) if few else np.flatnonzero(self.many > 1)
            if not len(own):
                continue
            x = gap[own] if len(own) < len(gap) else gap
            on = here[own]
            if few:
                split = (2 * (self.net.pos[self.node[own]] - self.from_[own]) - self.long[own]).astype(self.net.kind)[:, None]
                left, tie = x > split, x == split
                if not whole:
                    left, tie = left & on, tie & on
                right = ~(left | tie) if whole else on & ~(left | tie)
                ramp[0, self.lo[own] + 1] += left.sum(axis=1)
                ramp[1, self.hi[own] - 2] += right.sum(axis=1)
                k, j = np.nonzero(tie)
                ties.append((own[k], j, self.node[own[k]]))
            else:
                many = self.many[own]
                inner = _fan(self.node[own], many)
                rank = np.repeat(np.arange(len(own)), many)
                big = 4 * int(self.long[own].max()) + 4
                twice = 2 * (self.net.pos[inner] - self.from_[own][rank])
                key = rank * big + twice
                want = np.minimum(np.maximum(x.astype(np.int64) + self.long[own][:, None], 0), big - 1) + (np.arange(len(own)) * big)[:, None]
                at = np.searchsorted(key, want)
                tie = key[np.minimum(at, len(key) - 1)] == want
                left = at - (np.cumsum(many) - many)[:, None]
                right = many[:, None] - left - tie
                if not whole:
                    left, right, tie = left * on, right * on, tie & on
                ramp[0] += np.bincount((self.lo[own][:, None] + left).ravel(), minlength=size)
                ramp[1] += np.bincount((self.hi[own][:, None] - 1 - right).ravel(), minlength=size)
                k, j = np.nonzero(tie)
                ties.append((own[k], j, self.node[own[k]] + left[k, j]))
            parts[: len(gap)][own], parts[len(gap) :][own] = left, right
        share += self._ended(parts).ravel()
        ties = [np.concatenate(x) for x in zip(*ties, strict=True)] if ties else [np.zeros(0, np.int64)] * 3
        return ramp, ties

    def _along(self, values: np.ndarray, way: int, with_own: bool) -> np.ndarray:
        """Of each edge the sum of what lies behind it in its piece: to the right going away, to the left coming back."""
        wide = self.hi - self.lo
        total = np.append(0.0, np.cumsum(values))
        at = np.arange(len(values))
        if way == 0:
            return np.repeat(total[self.hi], wide) - total[at + (0 if with_own else 1)]
        return total[at + (1 if with_own else 0)] - np.repeat(total[self.lo], wide)


class Sums:
    """What passes each node and edge of a network, and how much of a demand has a path."""

    def __init__(self, net: Chains):
        self.nodes, self.edges, self.carried = np.zeros(net.n), np.zeros(net.m), 0.0
