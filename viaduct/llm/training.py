"""Bounded samples of labelled documents for classifiers, and a small optimiser."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viaduct.session import stored

#: Bounds of a labelled sample: documents a class, and code points of their texts together.
SAMPLE_DOCS, SAMPLE_CHARS = 2000, 4_000_000


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, most_docs: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS
) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels of at most ``most_docs`` documents of each class, those with the least hashes of ids.

    ``labels(doc_id, label)`` may have nulls, which are skipped; of repeated ids one label, the larger, counts, and one
    text, the longer. Of each class whole texts are taken in the order of hashes, whatever their length, while they fit
    into ``most_chars`` together; if none fits, the shortest one is. Null texts are skipped. Only ids are sorted, and
    only the least of each partition are kept; texts are read once, for the picked ids.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y"))
    own = own.filter(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.max("y").alias("y"))
    own = stored(own.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "labels")
    wanted: dict[int, int] = {}
    for y in (0, 1):
        least = own.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_docs)
        wanted |= {r["doc_id"]: y for r in least.collect()}
    if not wanted:
        return [], np.zeros(0, np.int64)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.filter(F.col("doc_id").isin(list(wanted)) & F.col("text").isNotNull())
    texts = stored(texts.withColumns({"size": F.length("text"), "hash": F.xxhash64("doc_id")}), "sample")
    longest: dict[int, tuple] = {}
    for r in texts.select("doc_id", "size", "hash").collect():
        longest[r["doc_id"]] = max(longest.get(r["doc_id"], (0, 0)), (r["size"], r["hash"]))
    taken: list[int] = []
    for y in (0, 1):
        sizes = sorted((h, i, n) for i, (n, h) in longest.items() if wanted[i] == y)
        left, fit = most_chars, []
        for _, i, n in sizes:
            if n <= left:
                fit.append(i)
                left -= n
        taken += fit or [i for _, i in sorted((n, i) for _, i, n in sizes)[:1]]
    found: dict[int, str] = {}
    for r in texts.filter(F.col("doc_id").isin(taken)).select("doc_id", "text").collect() if taken else ():
        if len(r["text"]) == longest[r["doc_id"]][0]:
            found[r["doc_id"]] = max(found.get(r["doc_id"], ""), r["text"])
    ids = sorted(found)
    return [found[i] for i in ids], np.array([wanted[i] for i in ids], np.int64)


class Adam:
    """Adam (Kingma and Ba 2015) for one array."""

    def __init__(self, shape, rate: float):
        self.rate, self.m, self.v, self.t = rate, np.zeros(shape, np.float32), np.zeros(shape, np.float32), 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m += 0.1 * (gradient - self.m)
        self.v += 0.01 * (gradient * gradient - self.v)
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.99**self.t)) + 1e-8)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))
