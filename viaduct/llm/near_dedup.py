"""Near-duplicate detection by improved consistent weighted sampling over TF-IDF shingles.

1. A table of counts, partitioned by hash, tells in how many documents each shingle of five words stands (``counts``).
2. Each document is a weighted set of shingles (term frequency times a scaled inverse document frequency); consistent
   weighted samples (Ioffe 2010) of two sets agree with the probability of their weighted Jaccard similarity.
3. Bands of samples are buckets. In a bucket, members are compared with one hub, not with each other; classes that
   stay apart are compared once more by members elected anew, several at a time. Of what is then still apart in some
   bucket, every pair is compared that an exact prefix filter cannot exclude; these pairs are never rows: they travel
   packed to cells of some hundred texts of the same large buckets, each of which comes there once, and only links leave
   a cell.
4. Each compared pair is verified on the whole texts; linked documents form classes (connected components).

Equal texts are one node throughout, so thousands of copies cost as much as one text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.arrow import mix, ngrams, slices, squeezed, tidy, unsqueezed, words
from viaduct.llm.counts import block_texts, count_keys, cut_blocks, with_totals, words_in
from viaduct.llm.rows import numbered, only, stored_rows, without
from viaduct.operators.components import component_stars
from viaduct.session import drop_stored, join_counted, observed, ready, stored

WORDS, SIMILAR = 5, 0.8
#: Samples in a band and bands: a pair at the threshold meets with a probability of 1 - (1 - 0.8^3)^12 = 0.9998.
ROWS, BANDS = 3, 12
#: Hubs elected in a round, rounds before all pairs that may be similar are compared, rows of a token and pairs of a hub in
#: a task, texts in a side of a cell, and what bounds are lowered by for rounding.
ELECTIONS, TURNS, TOKEN_ROWS, HUB_PAIRS, CELL_ROWS, SLACK = 3, 1, 256, 2000, 64, 1e-5
#: Pairs that a task holds at once.
HELD_PAIRS = 1 << 17
#: Rows of a table of pairs or nodes, and bytes of hubs' texts, up to which they are broadcast.
FEW_ROWS, FEW_BYTES = 200_000, 16 << 20
SIGNATURE = "doc_id long, row long, key binary, bands array<long>, packed binary, frequencies binary"
#: Bytes of texts whose samples are drawn at once.
DRAWN_BYTES = 1 << 19
_ONE = np.uint64(1)


def shingles(texts: list[bytes], n: int = WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text in ascending order, how often each stands there, and bounds by text.

    A text of fewer than ``n`` words, but one at least, is one shingle; a text without words has none.
    """
    hashes, bounds = words(texts)
    found, edges = ngrams(hashes, bounds, n)
    sizes = np.diff(bounds)
    doc = np.repeat(np.arange(len(texts)), np.diff(edges))
    short = np.flatnonzero((sizes > 0) & (sizes < n))
    if len(short):
        own = [xxhash.xxh3_64_intdigest(hashes[bounds[i] : bounds[i + 1]].tobytes()) for i in short]
        found, doc = np.concatenate((found, np.array(own, np.uint64))), np.concatenate((doc, short))
    order = np.argsort(found)
    narrow = doc[order].astype(np.uint16) if len(texts) <= 1 << 16 else doc[order]
    order = order[np.argsort(narrow, kind="stable")]
    found, doc = found[order], doc[order]
    first = np.flatnonzero(np.append(True, (found[1:] != found[:-1]) | (doc[1:] != doc[:-1]))) if len(found) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(found)))
    return found[first], counts, np.searchsorted(doc[first], np.arange(len(texts) + 1))


def inverse_frequency(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequency, scaled to 1 (in every document) to 2 (in one)."""
    top = np.log((documents + 1.0) / 2)
    return (1.0 + np.clip(np.log((documents + 1.0) / (frequencies + 1.0)) / max(top, 1e-9), 0, 1)).astype(np.float32)


@lru_cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Quantiles of the Gamma(2, 1) and the exponential distribution at 2^16 even places."""
    u = (np.arange(1 << 16) + 0.5) / (1 << 16)
    low, high = np.zeros_like(u), np.full_like(u, 40.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - (1 + mid) * np.exp(-mid) < u
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return low.astype(np.float32), (-np.log1p(-u)).astype(np.float32)


def samples(found: np.ndarray, weights: np.ndarray, starts: np.ndarray, count: int) -> np.ndarray:
    """``count`` consistent weighted samples of each set; sets start at ``starts`` and none is empty.

    For each element r, c ~ Gamma(2, 1) and b ~ U(0, 1) come from its hash; t = floor(ln w / r + b), and the element
    with the least ln c - r (t - b + 1) is taken, together with t.
    """
    gamma, exponential = _tables()
    sizes = np.diff(np.append(starts, len(found)))
    log_weight = np.log(weights)
    out = np.empty((len(starts), count), np.uint64)
    low16 = np.uint64(0xFFFF)
    for j in range(count):
        seed = np.uint64((0x9E3779B97F4A7C15 * (2 * j + 3)) & 0xFFFFFFFFFFFFFFFF)
        x = (found ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0x94D049BB133111EB)
        r = gamma[x >> np.uint64(48)]
        b = ((x >> np.uint64(32)) & low16).astype(np.float32) * np.float32(1 / 65536)
        c = exponential[(x >> np.uint64(16)) & low16] + exponential[x & low16]
        t = np.floor(log_weight / r + b)
        a = np.log(c) - r * (t - b + np.float32(1))
        least = np.repeat(np.minimum.reduceat(a, starts), sizes)
        at = np.flatnonzero(a == least)
        at = at[np.searchsorted(at, starts)]
        out[:, j] = mix(found[at] + seed * (t[at].astype(np.int64).astype(np.uint64) + _ONE))
    return out


def _describer(documents: int, bands: int, rows: int):
    """Bands, text and document frequencies of the shingles of every document of a block."""

    def describe(block: dict, totals_of) -> pa.Table:
        texts = block_texts(block)
        pack = zstandard.ZstdCompressor(level=1).compress
        totals, parts, held = totals_of(1), [], []
        every = None
        ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
        cuts = np.searchsorted(ends, np.arange(0, int(ends[-1]) + DRAWN_BYTES, DRAWN_BYTES)) if len(ends) else np.zeros(0, np.int64)
        edges = np.unique(np.concatenate(([0], cuts, [len(texts)])))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            held.append(shingles(texts[a:b]))
        every = np.unique(np.concatenate([found for found, _, _ in held])) if held else np.zeros(0, np.uint64)
        for (found, counts, bounds), a, b in zip(held, edges[:-1], edges[1:], strict=True):
            own = texts[a:b]
            frequencies = totals[np.searchsorted(every, found)]
            some = np.flatnonzero(np.diff(bounds))
            keys: list[list[int]] = [[] for _ in own]
            if len(some):
                weights = counts.astype(np.float32) * inverse_frequency(frequencies, documents)
                drawn = samples(found, weights, bounds[:-1][some], bands * rows)
                joint = np.zeros((len(some), bands), np.uint64)
                for k in range(rows):
                    joint = joint * np.uint64(0x9E3779B97F4A7C15) + drawn[:, k::rows]
                joint = mix(joint + np.arange(bands, dtype=np.uint64)).astype(np.int64)
                for i, listed in zip(some, joint.tolist(), strict=True):
                    keys[i] = listed
            narrow = np.minimum(frequencies, 2**32 - 1).astype("<u4")
            parts.append(
                pa.table({
                    "doc_id": pa.array(block["doc_ids"][a:b], pa.int64()), "row": pa.array(block["rows"][a:b], pa.int64()),
                    "key": pa.array([xxhash.xxh3_128_digest(t) for t in own], pa.binary()), "bands": pa.array(keys, pa.list_(pa.int64())),
                    "packed": pa.array([pack(t) for t in own], pa.binary()),
                    "frequencies": pa.array([squeezed(narrow[x:y]) for x, y in zip(bounds[:-1], bounds[1:], strict=True)], pa.binary()),
                })
            )
        return pa.concat_tables(parts)

    return describe


class Vectors:
    """Shingles, TF-IDF and TF weights and inverse frequencies of texts, of which the last are kept."""

    def __init__(self, documents: int, most: int = 256):
        self.documents, self.most, self.held = documents, most, {}
        self.unpack = zstandard.ZstdDecompressor().decompress

    def of(self, node: int, packed: bytes, frequencies: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        if node not in self.held:
            if len(self.held) >= self.most:
                self.held.clear()
            found, counts, _ = shingles([self.unpack(packed)])
            rarity = inverse_frequency(unsqueezed(frequencies, "<u4"), self.documents)
            self.held[node] = (found, counts.astype(np.float32) * rarity, counts.astype(np.float32), rarity)
        return self.held[node]


def _links(tested: DataFrame) -> DataFrame:
    return tested.filter("linked").select(F.lit(0).alias("graph_id"), F.col("a").alias("src"), F.col("b").alias("dst"))


def _apart(entries: DataFrame, classes: DataFrame) -> DataFrame:
    """(band, comp, node, n) of the members of buckets that hold two classes or more, n members each."""
    own = entries.join(classes, "node", "left").select("band", "node", F.coalesce("comp", "node").alias("comp"))
    spread = own.groupBy("band").agg(F.min("comp").alias("least"), F.max("comp").alias("last"), F.count(F.lit(1)).alias("n")).filter("least < last")
    return join_counted(own, spread.select("band", "n"), "band", "n", "inner")


def _homes(apart: DataFrame) -> DataFrame:
    """(node, comp, home) of the texts of ``apart``: a home is a block of some ``CELL_ROWS`` texts of one bucket.

    Of its buckets each text takes the largest, so the texts of one body, whose pairs no bound excludes, share few homes
    and their pairs fill few cells.
    """
    largest = apart.groupBy("node").agg(F.min("comp").alias("comp"), F.max(F.struct("n", "band")).alias("x"))
    own = stored(largest.select("node", "comp", F.col("x.band").alias("band")), "lone")
    sizes = own.groupBy("band").agg(F.count(F.lit(1)).alias("n"))
    part = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / CELL_ROWS))
    return join_counted(own, sizes, "band", "n", "inner").select("node", "comp", F.xxhash64("band", part).alias("home"))


def _class_pairs(apart: DataFrame, turn: int) -> DataFrame:
    """In each bucket one member of a class with one of another, both elected by chance, and anew ``ELECTIONS`` times."""
    chance = [F.xxhash64("node", F.lit(turn), F.lit(k)) for k in range(ELECTIONS)]
    own = stored(apart.groupBy("band", "comp").agg(*[F.min(F.struct(c.alias("chance"), "node")).alias(f"x{k}") for k, c in enumerate(chance)]), "elected")
    hubs = own.groupBy("band").agg(*[F.min(f"x{k}").alias(f"h{k}") for k in range(ELECTIONS)], F.count(F.lit(1)).alias("n"))
    both = join_counted(own, hubs, "band", "n", "inner")
    pairs = both.select(F.explode(F.array(*[F.struct(F.col(f"x{k}.node").alias("x"), F.col(f"h{k}.node").alias("y")) for k in range(ELECTIONS)])).alias("p"))
    return _ordered(pairs.select("p.x", "p.y").filter("x <> y"))


def _ordered(pairs: DataFrame) -> DataFrame:
    """``pairs(x, y)``, each once whatever its order, as (a, b, x, y) with a > b; y is what many pairs may share."""
    return pairs.withColumns({"a": F.greatest("x", "y"), "b": F.least("x", "y")}).dropDuplicates(["a", "b"])


def _prefixes(documents: int, threshold: float):
    """(node, comp, home, token, r1, w1, r2, w2): the shingles of which two similar texts share one at least.

    Shingles stand in one order for all texts, by falling inverse document frequency; w is the weight of the text by
    TF-IDF (1) and TF (2), r that of the shingle and all after it. Texts whose first common shingle is this one overlap
    by the lesser r at most, which bounds their similarity. Shingles of one document only are left out.
    """
    once = inverse_frequency(np.array([1.0, 2.0]), documents).mean()

    def prefix(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(documents, 1)
        for batch in slices(batches, "packed", 1 << 17):
            for node, comp, home, packed, frequencies in zip(*(batch.column(c).to_pylist() for c in ("node", "comp", "home", "packed", "frequencies")), strict=True):
                found, tf_idf, tf, idf = vectors.of(node, packed, frequencies)
                order = np.lexsort((found, -idf))
                rest, whole = [], []
                for w in (tf_idf.astype(np.float64), tf.astype(np.float64)):
                    rest.append(np.cumsum(w[order][::-1])[::-1])
                    whole.append(w.sum())
                kept = (rest[0] >= (threshold - SLACK) * whole[0]) | (rest[1] >= (threshold - SLACK) * whole[1])
                kept &= idf[order] < once
                n = int(kept.sum())
                if n:
                    numbers = [x for r, w in zip(rest, whole, strict=True) for x in (r[kept], np.full(n, w))]
                    columns = [pa.array(np.full(n, x)) for x in (node, comp, home)] + [pa.array(found[order][kept].view(np.int64))]
                    names = ["node", "comp", "home", "token", "r1", "w1", "r2", "w2"]
                    yield pa.RecordBatch.from_arrays(columns + [pa.array(x.astype(np.float32)) for x in numbers], names=names)

    return prefix


def _close_pairs(tokens: DataFrame, threshold: float) -> DataFrame:
    """(ca, cb, pairs): every pair of texts of different classes that the bounds of ``_prefixes`` cannot exclude, packed.

    Of the homes of a pair's two texts ca is the greater, cb the lesser; of the texts the greater comes first. A pair may
    come more than once. A token with many texts is dealt to tasks that compare two parts of them each.
    """
    tokens = stored(tokens, "tokens")
    groups = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("comp").alias("least"), F.max("comp").alias("last")).filter("least < last")
    own = join_counted(tokens, groups.select("token", "n"), "token", "n", "inner").withColumn("parts", F.ceil(F.col("n") / TOKEN_ROWS).cast("int"))
    own = own.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ends = {"i": F.least("part", "other"), "j": F.greatest("part", "other"), "side": (F.col("part") > F.col("other")).cast("int")}
    columns = ["token", "i", "j", "side", "node", "comp", "home", "r1", "w1", "r2", "w2"]
    # both parts meet in (i, j); which of them a row is of, side tells
    dealt = own.withColumns(ends).select(*columns).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return dealt.mapInArrow(tidy(_pairs_of(threshold / (1 + threshold) - SLACK)), "ca long, cb long, pairs binary")


def _pairs_of(share: float):
    def close(rows: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of the rows x and y those pairs that the bounds leave, as two columns of nodes."""
        same = rows["i"][x] == rows["j"][x]
        keep = (rows["comp"][x] != rows["comp"][y]) & (same | (rows["side"][x] != rows["side"][y]))
        x, y = x[keep], y[keep]
        near = np.zeros(len(x), bool)
        for k in ("1", "2"):
            w, r = rows["w" + k], rows["r" + k]
            near |= np.minimum(r[x], r[y]) >= share * (w[x].astype(np.float64) + w[y])
        a, b = rows["node"][x[near]], rows["node"][y[near]]
        return np.unique(np.stack((np.maximum(a, b), np.minimum(a, b)), 1), axis=0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        homes: list[np.ndarray] = []

        def flush() -> Iterator[pa.RecordBatch]:
            pairs = np.unique(np.concatenate(held), axis=0) if held else np.zeros((0, 2), np.int64)
            nodes, home = np.concatenate(homes, axis=1) if homes else np.zeros((2, 0), np.int64)
            held.clear(), homes.clear()
            if not len(pairs):
                return
            nodes, at = np.unique(nodes, return_index=True)
            both = home[at][np.searchsorted(nodes, pairs)]
            ca, cb = both.max(1), both.min(1)
            order = np.lexsort((cb, ca))
            pairs, ca, cb = pairs[order], ca[order], cb[order]
            cuts = np.flatnonzero(np.append(True, (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])))
            ends = np.append(cuts[1:], len(pairs))
            packed = [squeezed(pairs[s:e].ravel().view(np.uint64)) for s, e in zip(cuts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(ca[cuts]), pa.array(cb[cuts]), pa.array(packed, pa.binary())], names=["ca", "cb", "pairs"])

        for rows in _whole_groups(batches):
            first = np.flatnonzero(np.append(True, (rows["token"][1:] != rows["token"][:-1]) | (rows["i"][1:] != rows["i"][:-1]) | (rows["j"][1:] != rows["j"][:-1])))
            sizes = np.diff(np.append(first, len(rows["token"])))
            for size in np.unique(sizes[sizes > 1]):
                a, b = np.triu_indices(size, 1)
                starts = first[sizes == size]
                step = max(1, HELD_PAIRS // len(a))
                for k in range(0, len(starts), step):
                    own = starts[k : k + step, None]
                    held.append(close(rows, (own + a).ravel(), (own + b).ravel()))
                    some = np.unique((own + np.arange(size)).ravel())
                    homes.append(np.stack((rows["node"][some], rows["home"][some])))
                    if sum(map(len, held)) > HELD_PAIRS:
                        yield from flush()
        yield from flush()

    return run


def _whole_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, np.ndarray]]:
    """The rows of sorted batches, cut where a new group of token, i and j begins; a group has two parts of rows at most."""
    left: dict[str, np.ndarray] | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in batch.schema.names}
        if left is not None:
            rows = {c: np.concatenate((left[c], v)) for c, v in rows.items()}
        last = (rows["token"] == rows["token"][-1]) & (rows["i"] == rows["i"][-1]) & (rows["j"] == rows["j"][-1])
        cut = int(np.argmax(last))
        if cut:
            yield {c: v[:cut] for c, v in rows.items()}
        left = {c: v[cut:] for c, v in rows.items()}
    if left is not None:
        yield left


def _links_of_cells(cells: DataFrame, texts: DataFrame, documents: int, threshold: float) -> DataFrame:
    """(a, b, similarity, linked) of the linked ones among the packed pairs; a text comes once to each cell that needs it."""

    def merged(pairs: pa.Table) -> pa.Table:
        both = np.unique(np.concatenate([unsqueezed(r).reshape(-1, 2) for r in pairs.column("pairs").to_pylist()]), axis=0)
        return pa.table({"ca": pairs.column("ca")[:1], "cb": pairs.column("cb")[:1], "pairs": pa.array([squeezed(both.ravel())], pa.binary())})

    # tasks send parts of a cell; each is one row from here on
    cells = stored(cells.groupBy("ca", "cb").applyInArrow(merged, "ca long, cb long, pairs binary"), "cells")

    def nodes_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ca, cb, raw in zip(*(batch.column(c).to_pylist() for c in ("ca", "cb", "pairs")), strict=True):
                own = np.unique(unsqueezed(raw)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), ca)), pa.array(np.full(len(own), cb)), pa.array(own)], names=["ca", "cb", "node"])

    def verify(pairs: pa.Table, own: pa.Table) -> pa.Table:
        held = {n: (p, f) for n, p, f in zip(*(own.column(c).to_pylist() for c in ("node", "packed", "frequencies")), strict=True)}
        vectors = Vectors(documents, 2 * len(held) + 1)
        both = unsqueezed(pairs.column("pairs")[0].as_py()).reshape(-1, 2).view(np.int64)
        found = np.array([_similarity(vectors.of(a, *held[a]), vectors.of(b, *held[b])) for a, b in both.tolist()], float)
        linked = found >= threshold
        return pa.table({"a": both[linked, 0], "b": both[linked, 1], "similarity": found[linked], "linked": linked[linked]})

    needed = cells.mapInArrow(nodes_of, "ca long, cb long, node long").join(texts, "node")
    return cells.groupBy("ca", "cb").cogroup(needed.groupBy("ca", "cb")).applyInArrow(verify, "a long, b long, similarity double, linked boolean")


def _similarity(a: tuple, b: tuple) -> float:
    """The larger of the weighted Jaccard similarities by TF-IDF and by TF alone.

    In a large group of near copies IDF lowers the weight of what they share; TF alone keeps them together.
    """
    at = np.minimum(np.searchsorted(a[0], b[0]), max(len(a[0]) - 1, 0))
    if not len(a[0]) or not len(b[0]):
        return 0.0
    hit = a[0][at] == b[0]
    best = 0.0
    for k in (1, 2):
        both = np.minimum(a[k][at[hit]], b[k][hit]).sum(dtype=np.float64)
        best = max(best, both / (a[k].sum(dtype=np.float64) + b[k].sum(dtype=np.float64) - both))
    return float(best)


def _verifier(documents: int, threshold: float):
    def verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = Vectors(documents)  # hubs come again and again
        for batch in batches:
            x, y = (batch.column(c).to_numpy() for c in ("x", "y"))
            texts = zip(*(batch.column(c).to_pylist() for c in ("x", "packed_x", "frequencies_x", "y", "packed_y", "frequencies_y")), strict=True)
            found = np.array([_similarity(vectors.of(*t[:3]), vectors.of(*t[3:])) for t in texts], float)
            yield pa.RecordBatch.from_arrays([pa.array(np.maximum(x, y)), pa.array(np.minimum(x, y)), pa.array(found), pa.array(found >= threshold)], names=["a", "b", "similarity", "linked"])

    return verify


def _with_texts(pairs: DataFrame, texts: DataFrame, few_rows: int = FEW_ROWS) -> DataFrame:
    """``pairs(x, y)`` with the texts of both.

    Few pairs, and their hubs' texts if those are small, are broadcast to where the texts are. Of more, the pairs of a hub
    y are dealt to tasks of ``HUB_PAIRS``.
    """
    pairs, seen = observed(pairs, "untested")
    pairs = pairs.select("x", "y")
    left, right = (texts.select(F.col("node").alias(c), F.col("packed").alias(f"packed_{c}"), F.col("frequencies").alias(f"frequencies_{c}")) for c in ("x", "y"))
    if seen["n"] <= few_rows:
        hubs, size = observed(right.join(F.broadcast(pairs.select("y").distinct()), "y"), "hubs", bytes=F.sum(F.length("packed_y") + F.length("frequencies_y")))
        if (size["bytes"] or 0) <= FEW_BYTES:
            return left.join(F.broadcast(pairs), "x").join(F.broadcast(hubs), "y")
    hubs = stored(pairs.groupBy("y").agg(F.count(F.lit(1)).alias("n")), "hubs")
    parts = F.ceil(F.col("n") / HUB_PAIRS).cast("int")
    dealt = join_counted(pairs, hubs, "y", "n").select("x", "y", F.pmod(F.xxhash64("x"), parts).cast("int").alias("part"))
    right = right.join(hubs, "y").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("n")
    return dealt.join(left, "x").join(right, ["y", "part"])


def near_duplicates(
    docs: DataFrame, threshold: float = SIMILAR, bands: int = BANDS, rows: int = ROWS, row: str | None = None, few_rows: int = FEW_ROWS
) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, class_id, n_links, kept, class_size and ``row``.

    ``class_id`` is the least ``doc_id`` of the class (nulls last); ``n_links`` counts the other texts verified as
    similar to this one; exactly one row of a class is kept, that with the least ``doc_id``, then the first. Equal
    texts, empty and null ones among them, are one class; a text without words is similar to no other. Other columns
    are not read; an empty table has no classes.
    """
    ready(docs.sparkSession)
    blocks = cut_blocks(docs, row)
    documents = max(1, blocks.agg(F.sum(F.size("doc_ids"))).first()[0] or 0)
    replies = count_keys(blocks, lambda texts: [shingles(texts)[0]], 64, words_in(blocks))
    rows_of = stored_rows(with_totals(blocks, replies, _describer(documents, bands, rows), SIGNATURE), row, "signatures")
    drop_stored(blocks, replies)
    nodes = rows_of.select("key", "row", "bands").groupBy("key").agg(F.min(F.struct("row", "bands")).alias("x"), F.count(F.lit(1)).alias("copies"))
    nodes = stored(nodes.select("key", F.col("x.row").alias("node"), F.col("x.bands").alias("bands"), "copies"), "nodes")
    every = nodes.select("node", F.explode("bands").alias("band"))
    hubs = every.groupBy("band").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    entries = stored(join_counted(every, hubs, "band", "n", "inner").drop("n"), "entries")
    texts = stored(only(rows_of.select("row", "packed", "frequencies"), "row", entries.select(F.col("node").alias("row")).distinct()).withColumnRenamed("row", "node"), "texts")

    def verified(pairs: DataFrame) -> tuple[DataFrame, dict]:
        """The pairs with their similarity, and how many there are and are linked."""
        found = _with_texts(pairs, texts, few_rows).mapInArrow(tidy(_verifier(documents, threshold)), "a long, b long, similarity double, linked boolean")
        return observed(found, "pairs", n=F.count(F.lit(1)), links=F.count_if("linked"))

    def spread(stars: DataFrame) -> tuple[DataFrame, int]:
        """The members of buckets of several classes, and their number."""
        own, seen = observed(_apart(entries, stars.select(F.col("a").alias("node"), F.col("b").alias("comp"))), "apart")
        return own, seen["n"]

    tested, seen = verified(_ordered(entries.filter("node > hub").select(F.col("node").alias("x"), F.col("hub").alias("y"))))
    stars = component_stars(_links(tested))
    apart, members = spread(stars)
    turn = 0
    while members and turn < TURNS:
        past = tested.select("a", "b")
        fresh = _class_pairs(apart, turn)
        more, now = verified(fresh.join(F.broadcast(past) if seen["n"] <= few_rows else past, ["a", "b"], "left_anti"))
        tested, seen = tested.unionByName(more), {"n": seen["n"] + now["n"]}
        if not now["links"]:
            break
        stars = component_stars(_links(more).unionByName(stars.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"))))
        apart, members = spread(stars)
        turn += 1
    if members:
        # pairs of different classes were not linked before, so none is linked twice
        columns = "node long, comp long, home long, token long, r1 float, w1 float, r2 float, w2 float"
        prefixes = texts.join(_homes(apart), "node").mapInArrow(tidy(_prefixes(documents, threshold)), columns)
        more, now = observed(_links_of_cells(_close_pairs(prefixes, threshold), texts, documents, threshold), "pairs")
        if now["n"]:
            tested = tested.unionByName(more)
            stars = component_stars(_links(more).unionByName(stars.select("graph_id", F.col("a").alias("src"), F.col("b").alias("dst"))))
    classes = stars.select(F.col("a").alias("node"), F.col("b").alias("comp"))
    linked = tested.filter("linked")
    degree = linked.select(F.col("a").alias("node")).union(linked.select("b")).groupBy("node").agg(F.count(F.lit(1)).alias("n_links"))
    named = nodes.select("key", "node", "copies").join(classes, "node", "left").join(degree, "node", "left")
    named = named.select("key", "copies", F.coalesce("comp", "node").alias("comp"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    placed = stored(join_counted(rows_of.select("row", "doc_id", "key"), named, "key", "copies").drop("key", "copies"), "placed")
    first = F.min(F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)), "doc_id", "row")).alias("first")
    heads = placed.groupBy("comp").agg(first, F.count(F.lit(1)).alias("class_size"))
    return join_counted(placed, heads, "comp", "class_size").select(
        "doc_id", F.col("first.doc_id").alias("class_id"), "n_links", (F.col("row") == F.col("first.row")).alias("kept"), "class_size", "row"
    )


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, of which each class keeps one, as ``near_duplicates`` says.

    Texts without words are no near duplicates unless they are equal; rows alike in all columns are one class, a null
    ``doc_id`` gives way to any other, an empty table stays empty, and other columns, whatever their names, are only
    carried.
    """
    own, row = numbered(docs)
    return without(own, row, near_duplicates(own, row=row).filter("not kept").select("row"))


def op9_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all ``documents``."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")
