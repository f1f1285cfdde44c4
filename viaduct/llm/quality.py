"""Document quality by a linear-chain conditional random field over lines.

Every line is good or bad. Features of a line and of its neighbours give the scores of its label, and a matrix those
of neighbouring labels. The field is trained in numpy on lines that carry the label of their document; marginals
come from the forward-backward recurrences, run for many documents at once. Marginals of being good, weighted by the
length of the line, make up the document's quality, which one logistic curve maps to the odds of its label.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.arrow import WORD_BYTES, byte_texts, hash_spans, slices, spans_of, tidy
from viaduct.llm.training import Adam, labelled_sample, sigmoid
from viaduct.session import ready

ACCEPT, EPOCHS, RATE, DECAY = 0.3, 120, 0.1, 1e-3
RESULT = "doc_id long, score double, predicted int"


def _class(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), np.frombuffer(chars, np.uint8)).astype(np.uint8)


_UPPER = _class(bytes(range(65, 91)))
_LOWER = _class(bytes(range(97, 123)))
_DIGIT = _class(b"0123456789")
_MARKS = _class(b"!?")
_BARS = _class(b"|\t")
_SIGNS = _class(b"#$%&*@^~=+<>{}[]\\_/`")
_STOPS = _class(b".,;:")
BASE = 12


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of every line with those of its neighbours, its weight, and bounds by text. A text has one line at least."""
    joined = b"\n".join(texts) + b"\n"
    buffer = np.frombuffer(joined, np.uint8)
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate(([0], ends[:-1] + 1))
    edges = np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))
    bounds = np.searchsorted(starts, edges)
    length = ends - starts
    size = np.maximum(length, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        return np.add.reduceat(kind[buffer], starts, dtype=np.int32)

    upper, lower = share(_UPPER), share(_LOWER)
    low = np.frombuffer(joined.translate(WORD_BYTES), np.uint8)
    first, last = spans_of(low != 32)
    line = np.searchsorted(ends, first)
    words = np.bincount(line, minlength=len(starts))
    hashes = hash_spans(low, first, last)
    same = np.zeros(len(hashes), bool)
    for gap in (1, 2):
        same[gap:] |= (hashes[gap:] == hashes[:-gap]) & (line[gap:] == line[:-gap])
    again = np.bincount(line, same, minlength=len(starts)) / np.maximum(words, 1)
    whole = hash_spans(buffer, starts, ends)
    twin = np.zeros(len(starts))
    twin[1:] = (whole[1:] == whole[:-1]) & (length[1:] > 0)
    marks, bars, signs = share(_MARKS), share(_BARS), share(_SIGNS)
    count = np.maximum(words, 1)
    base = np.stack(
        [
            upper / np.maximum(upper + lower, 1),
            (upper > 0.5 * (upper + lower)) & (upper + lower > 8),
            np.minimum(marks / count, 1.0),
            np.minimum(bars / count, 1.0),
            np.minimum(signs / count, 3.0) / 3,
            signs > 2 * (words > 2) + 2,
            share(_DIGIT) / size,
            share(_STOPS) / size * 5,
            again,
            again > 0.5,
            np.minimum(np.log1p(length) / 8, 1.0),
            twin,
        ],
        axis=1,
    ).astype(np.float32)
    before, after = np.zeros_like(base), np.zeros_like(base)
    before[1:], after[:-1] = base[:-1], base[1:]
    before[bounds[:-1]] = 0
    after[bounds[1:] - 1] = 0
    edge = np.zeros((len(base), 2), np.float32)
    edge[bounds[:-1], 0] = edge[bounds[1:] - 1, 1] = 1
    return np.concatenate((base, before, after, edge, np.ones((len(base), 1), np.float32)), axis=1), length + 1.0, bounds


def forward_backward(scores: np.ndarray, moves: np.ndarray, bounds: np.ndarray, per_line: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Log marginals of each line's label, and sums of the marginals of neighbouring labels, of all chains at once.

    The sums weigh each pair by the second line's ``per_line``; without it they are not made.

    Chains are stepped line by line, the long ones first, so that each step is one operation on all chains left.
    """
    sizes = np.diff(bounds)
    order = np.argsort(-sizes, kind="stable")
    first, size = bounds[:-1][order], sizes[order]
    longest = int(size.max(initial=0))
    active = np.searchsorted(-size, -np.arange(longest), side="left")
    forward, backward = scores.astype(np.float64), np.zeros(scores.shape)
    for k in range(1, longest):
        at = first[: active[k]] + k
        forward[at] += np.logaddexp(forward[at - 1, :1] + moves[0], forward[at - 1, 1:] + moves[1])
    for k in range(longest - 2, -1, -1):
        at = first[: active[k + 1]] + k
        onward = scores[at + 1] + backward[at + 1]
        backward[at] = np.logaddexp(onward[:, :1] + moves[:, 0], onward[:, 1:] + moves[:, 1])
    both = forward + backward
    log_marginals = both - np.logaddexp(both[:, :1], both[:, 1:])
    if per_line is None:
        return log_marginals, np.zeros((2, 2))
    inner = np.ones(len(scores), bool)
    inner[bounds[:-1][sizes > 0]] = False
    at = np.flatnonzero(inner)
    pairs = forward[at - 1][:, :, None] + moves + (scores[at] + backward[at])[:, None, :]
    pairs -= np.logaddexp(both[at, 0], both[at, 1])[:, None, None]
    return log_marginals, (np.exp(pairs) * per_line[at][:, None, None]).sum(axis=0)


@dataclass
class QualityModel:
    """Weights of the features for a good line, scores of neighbouring labels, and the curve of document scores."""

    weights: np.ndarray
    moves: np.ndarray
    slope: float
    offset: float

    def line_marginals(self, features: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        good = features @ self.weights
        return np.exp(forward_backward(np.stack([np.zeros_like(good), good], axis=1), self.moves, bounds)[0][:, 1])

    def means(self, texts: list[bytes]) -> np.ndarray:
        features, weight, bounds = line_features(texts)
        good = self.line_marginals(features, bounds) * weight
        return np.add.reduceat(good, bounds[:-1]) / np.add.reduceat(weight, bounds[:-1])

    def scores(self, texts: list[bytes]) -> np.ndarray:
        return sigmoid(self.slope * (self.means(texts) - 0.5) + self.offset)


def train(texts: list[str], labels: np.ndarray, epochs: int = EPOCHS) -> QualityModel:
    """Train on whole texts; classes weigh the same. With one class or none every text gets that class's rate."""
    width = 3 * BASE + 3
    if len(set(labels.tolist())) < 2:
        rate = (labels.sum() + 0.5) / (len(labels) + 1.0) if len(labels) else 0.5
        return QualityModel(np.zeros(width, np.float32), np.zeros((2, 2)), 0.0, float(np.log(rate / (1 - rate))))
    raw = [t.encode("utf-8", "replace") for t in texts]
    features, _, bounds = line_features(raw)
    sizes = np.diff(bounds)
    chain = np.repeat(np.arange(len(texts)), sizes)
    share = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    per_line = (share / sizes)[chain]
    truth = labels[chain]
    weights, moves = np.zeros(width, np.float32), np.zeros((2, 2), np.float32)
    adams = [Adam(x.shape, RATE) for x in (weights, moves)]
    inner = np.flatnonzero(np.append(False, chain[1:] == chain[:-1]))
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[inner - 1], truth[inner]), per_line[inner])
    for _ in range(epochs):
        good = features @ weights
        log_marginals, expected = forward_backward(np.stack([np.zeros_like(good), good], axis=1), moves, bounds, per_line)
        gradient = features.T @ ((np.exp(log_marginals[:, 1]) - truth) * per_line).astype(np.float32)
        weights -= adams[0].step(gradient + DECAY * weights)
        moves -= adams[1].step((expected - seen + DECAY * moves).astype(np.float32))
    model = QualityModel(weights, moves.astype(np.float64), 1.0, 0.0)
    means = model.means(raw) - 0.5
    slope, offset = np.float32(4.0), np.float32(0.0)
    curve = Adam((2,), 0.2)
    for _ in range(300):
        off = (sigmoid(slope * means + offset) - labels) * share
        step = curve.step(np.array([(off * means).sum() + 1e-4 * slope, off.sum()], np.float32))
        slope, offset = slope - step[0], offset - step[1]
    return QualityModel(weights, moves.astype(np.float64), float(slope), float(offset))


def score_quality(docs: DataFrame, model: QualityModel, accept: float = ACCEPT) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score of ``accept`` or more) of ``docs(doc_id, text)``.

    A null or empty text is one empty line. Other columns are not read.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = shared.value.scores(byte_texts(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found), pa.array((found >= accept).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(score), RESULT)


def quality_model(docs: DataFrame, labels: DataFrame) -> QualityModel:
    """A model from the labels outside the held-out fifth."""
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    return train(*labelled_sample(docs, labels.filter(fold != 0), "quality"))


def keep_good(docs: DataFrame, model: QualityModel, accept: float = ACCEPT) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is accepted.

    A null or empty text is one empty line and scored like any other; ids are not read, so null and repeated ones are
    rows like any other; an empty table stays empty, and other columns, whatever their names, are only carried.
    """
    spark = ready(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 1 << 20):
            found = shared.value.scores(byte_texts(batch.column("text")))
            yield batch.filter(pa.array(found >= accept))

    return docs.mapInArrow(tidy(keep), docs.schema)


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all ``documents``, learned from labels outside the held-out fifth."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    found = score_quality(docs, quality_model(docs, labels))
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False)).alias("held_out"), "score", "predicted")
