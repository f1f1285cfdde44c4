"""Toxicity by averaged subword embeddings and a linear softmax (Joulin et al. 2016; Bojanowski et al. 2017).

A word is the mean of the vectors of its character n-grams, of three to five bytes with a boundary at both ends, and of
itself; a document is the mean of its words; a linear softmax over two classes reads it. All are trained jointly in
numpy. A misspelt or inflected word shares n-grams with the words that were seen. After training, a bucket's vector
only matters through its product with the softmax weights, so scoring looks up one number for each n-gram.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.arrow import WORD_BYTES, byte_texts, hash_spans, mix, slices, spans_of
from viaduct.llm.training import Adam, labelled_sample, sigmoid
from viaduct.session import ready

NGRAMS, BUCKET_BITS, WIDTH = (3, 4, 5), 17, 4
EPOCHS, LEAST_STEPS, BATCH, RATE, DECAY, SCALE, SEED = 20, 400, 64, 0.03, 3e-3, 30, 7
#: Words as frequent as this weigh half as much as rare ones in the average (Arora et al. 2017).
COMMON = 1e-3
RESULT = "doc_id long, score double, predicted int"
_MULTIPLIER = np.uint64(0x100000001B3)


def _buckets(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int32)


class Subwords:
    """Words of a batch of texts and, by n, the bucket of the n-gram at each byte; a space is the boundary."""

    def __init__(self, texts: list[bytes]):
        joined = b" " + b" ".join(texts).translate(WORD_BYTES) + b" "
        buffer = np.frombuffer(joined, np.uint8)
        self.starts, self.ends = spans_of(buffer != 32)
        edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
        self.bounds = np.searchsorted(self.starts, edges)
        self.whole = _buckets(mix(hash_spans(buffer, self.starts, self.ends) ^ _MULTIPLIER))
        rolled, wide = buffer.astype(np.uint64), buffer.astype(np.uint64)
        self.grams: dict[int, np.ndarray] = {}
        for n in range(2, NGRAMS[-1] + 1):
            rolled = rolled[:-1] * _MULTIPLIER + wide[n - 1 :]
            if n in NGRAMS:
                scrambled = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
                self.grams[n] = _buckets(scrambled)
        lengths = self.ends - self.starts
        self.windows = {n: np.maximum(lengths + 3 - n, 0) for n in NGRAMS}
        self.sizes = 1 + sum(self.windows.values())

    def word_means(self, table: np.ndarray) -> np.ndarray:
        """The mean of ``table`` over the n-grams of each word."""
        total = table[self.whole].astype(np.float64)
        for n, buckets in self.grams.items():
            sums = np.concatenate(([0.0], np.cumsum(table[buckets], dtype=np.float64)))
            first = np.minimum(self.starts - 1, len(buckets))  # a last word that is too short for n has no window
            total += sums[first + self.windows[n]] - sums[first]
        return total / self.sizes

    def listed(self) -> tuple[np.ndarray, np.ndarray]:
        """The buckets of each word, one word after the other, and their bounds."""
        edges = np.concatenate(([0], np.cumsum(self.sizes)))
        out = np.empty(edges[-1], np.int32)
        out[edges[:-1]] = self.whole
        at = edges[:-1] + 1
        for n, buckets in self.grams.items():
            count = self.windows[n]
            inner = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            out[np.repeat(at, count) + inner] = buckets[np.repeat(self.starts - 1, count) + inner]
            at = at + count
        return out, edges


@dataclass
class ToxicityModel:
    """What a bucket adds to the log odds of a word, and the log odds of a text without words."""

    table: np.ndarray
    bias: float
    rarity: np.ndarray

    def scores(self, texts: list[bytes]) -> np.ndarray:
        own = Subwords(texts)
        weight = self.rarity[own.whole].astype(np.float64)
        sums = np.concatenate(([0.0], np.cumsum(own.word_means(self.table) * weight)))
        mass = np.concatenate(([0.0], np.cumsum(weight)))
        low, high = own.bounds[:-1], own.bounds[1:]
        return sigmoid(self.bias + (sums[high] - sums[low]) / np.where(high > low, mass[high] - mass[low], 1.0))


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS, rate: float = RATE) -> ToxicityModel:
    """Train embeddings and softmax together on whole texts; classes weigh the same. One class or none: its rate."""
    size = 1 << BUCKET_BITS
    if len(set(labels.tolist())) < 2:
        rate_of = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.1
        return ToxicityModel(np.zeros(size, np.float32), float(np.log(rate_of / (1 - rate_of))), np.ones(size, np.float32))
    own = Subwords([t.encode("utf-8", "replace") for t in texts])
    flat, edges = own.listed()
    del own.grams
    used = np.flatnonzero(np.bincount(flat, minlength=size))
    place = np.zeros(size, np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    flat = place[flat]
    starts, sizes, bounds = edges[:-1], own.sizes, own.bounds
    seen = np.bincount(own.whole, minlength=size) / max(1, len(own.whole))
    rarity = (COMMON / (COMMON + seen)).astype(np.float32)
    weight = rarity[own.whole]
    mass = np.concatenate(([0.0], np.cumsum(weight)))
    mass = np.where(np.diff(bounds), mass[bounds[1:]] - mass[bounds[:-1]], 1.0)
    rng = np.random.default_rng(SEED)
    vectors = rng.normal(0, 0.05, (len(used), WIDTH)).astype(np.float32)
    weights = rng.normal(0, 0.5, (WIDTH, 2)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    adams = [Adam(x.shape, rate) for x in (vectors, weights, bias)]
    share = np.where(labels == 1, 0.5 / labels.mean(), 0.5 / (1 - labels.mean())).astype(np.float32)
    target = np.stack([1 - labels, labels], axis=1).astype(np.float32)
    steps = max(LEAST_STEPS, epochs * len(texts) // BATCH)
    for step in range(steps):
        batch = rng.choice(len(texts), min(BATCH, len(texts)), replace=False)
        counts = bounds[batch + 1] - bounds[batch]
        tokens = _ranges(bounds[batch], counts)
        grams = flat[_ranges(starts[tokens], sizes[tokens])]
        first = np.cumsum(sizes[tokens]) - sizes[tokens]
        words = np.add.reduceat(vectors[grams], first, axis=0) * (weight[tokens] / sizes[tokens])[:, None] if len(tokens) else np.zeros((0, WIDTH))
        sums = np.concatenate((np.zeros((1, WIDTH)), np.cumsum(words, axis=0)))
        ends = np.cumsum(counts)
        per = (SCALE / mass[batch])[:, None]
        docs = (sums[ends] - sums[ends - counts]) * per
        logits = docs @ weights + bias
        logits -= logits.max(axis=1, keepdims=True)
        odds = np.exp(logits)
        off = (odds / odds.sum(axis=1, keepdims=True) - target[batch]) * share[batch, None] / len(batch)
        to_words = np.repeat((off @ weights.T) * per, counts, axis=0) * (weight[tokens] / sizes[tokens])[:, None]
        to_grams = np.repeat(to_words, sizes[tokens], axis=0)
        to_vectors = np.stack([np.bincount(grams, to_grams[:, k], minlength=len(used)) for k in range(WIDTH)], axis=1)
        rate_now = 1 - step / steps
        weights_step = adams[1].step(docs.T @ off)
        vectors -= rate_now * (adams[0].step(to_vectors) + DECAY * vectors)
        weights -= rate_now * weights_step
        bias -= rate_now * adams[2].step(off.sum(axis=0))
    table = np.zeros(size, np.float32)
    table[used] = SCALE * (vectors @ (weights[:, 1] - weights[:, 0]))
    return ToxicityModel(table, float(bias[1] - bias[0]), rarity)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, ``size`` of them."""
    total = int(sizes.sum())
    return np.repeat(starts - np.cumsum(sizes) + sizes, sizes) + np.arange(total)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, score (0 to 1) and predicted of ``docs(doc_id, text)``.

    A text that is null, empty or without words has the score of the bias alone. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = shared.value.scores(byte_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(score, RESULT)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all ``documents``, learned from labels outside the held-out fifth."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    model = train(*labelled_sample(docs, labels.filter(fold != 0), "toxic"))
    return score_toxicity(docs, model).select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "score", "predicted")
