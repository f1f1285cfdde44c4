"""Stupid-backoff language-model scores (Brants et al. 2007), counted and joined relationally.

Count tables of the n-grams of every order, partitioned by hash, are summed up over all documents and joined back to the
n-grams of each block of documents (``counts``); the terms are then summed by document.

With S(w | u v) = c(u v w) / c(u v) where c(u v w) > 0, else 0.4 S(w | v), down to c(w) / N. By default a document's
own n-grams are taken out of all counts before it is scored, so that it does not vouch for itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.arrow import ngrams, words
from viaduct.llm.counts import block_texts, count_keys, cut_blocks, with_totals, words_in

#: N-grams are told apart by so many bits: of 10^13 different ones, one in 100,000 shares its count with another.
ORDER, BACKOFF, HASH_BITS = 3, 0.4, 60
SCORE = "doc_id long, n_words long, log_score double, n_seen long"


def _grams(texts: list[bytes], order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Hashes of the n-grams, n from 1 to ``order``, one for each place where one begins, with bounds by text."""
    hashes, bounds = words(texts)
    out = [(hashes, bounds), *(ngrams(hashes, bounds, n) for n in range(2, order + 1))]
    return [(h >> np.uint64(64 - HASH_BITS), b) for h, b in out]


def _scorer(order: int, backoff: float, corpus: int, leave_out: bool):
    def score(row: dict, totals_of) -> pa.Table:
        texts = block_texts(row)
        grams = _grams(texts, order)
        found: list[np.ndarray] = []
        for n, (hashes, bounds) in enumerate(grams, 1):
            totals = totals_of(n)
            _, rank = np.unique(hashes, return_inverse=True)
            count = totals[rank]
            if leave_out:
                doc = np.repeat(np.arange(len(texts), dtype=np.int64), np.diff(bounds))
                _, which, times = np.unique(doc * (len(totals) + 1) + rank, return_inverse=True, return_counts=True)
                count = count - times[which]
            found.append(count)
        sizes = np.diff(grams[0][1])
        place = np.arange(len(found[0])) - np.repeat(grams[0][1][:-1], sizes)
        size_of = np.repeat(sizes, sizes)
        whole = (corpus - size_of if leave_out else np.full(len(place), corpus)).astype(float)
        # from the shortest history up: a longer n-gram that is known replaces what the shorter ones gave
        one = found[0]
        value = np.log(np.maximum(one, 0.5) / np.maximum(whole, 1.0))
        for n in range(2, order + 1):
            value = np.where(place >= n - 1, value + np.log(backoff), value)
            ends = np.flatnonzero(place >= n - 1)
            longer = found[n - 1]
            bounds, shorter = grams[n - 2][1], found[n - 2]
            doc = np.repeat(np.arange(len(texts)), np.maximum(sizes - n + 1, 0))
            history = shorter[bounds[:-1][doc] + place[ends] - (n - 1)]
            known = (longer > 0) & (history > 0)
            value[ends[known]] = np.log(longer[known] / history[known])
        sums = np.concatenate(([0.0], np.cumsum(value)))
        seen = np.concatenate(([0], np.cumsum(one > 0)))
        low, high = grams[0][1][:-1], grams[0][1][1:]
        return pa.table({"doc_id": pa.array(row["doc_ids"], pa.int64()), "n_words": sizes.astype(np.int64), "log_score": sums[high] - sums[low], "n_seen": (seen[high] - seen[low]).astype(np.int64)})

    return score


def score_documents(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, leave_out: bool = True) -> DataFrame:
    """doc_id, n_words, log_score (natural, summed), n_seen (words known from other documents) and mean_log_score.

    All documents of ``docs(doc_id, text)`` are the corpus. A word that no other document has counts as half an
    occurrence. A text that is null or has no words has log_score 0 and a null mean; repeated rows are documents of
    their own, and each vouches for the other. Other columns are not read.
    """
    blocks = cut_blocks(docs)
    corpus = words_in(blocks)
    replies = count_keys(blocks, lambda texts: [h for h, _ in _grams(texts, order)], HASH_BITS, corpus)
    scored = with_totals(blocks, replies, _scorer(order, backoff, corpus, leave_out), SCORE)
    return scored.withColumn("mean_log_score", F.when(F.col("n_words") > 0, F.col("log_score") / F.col("n_words")))


def op4_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trigram stupid-backoff scores of all ``documents``."""
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
