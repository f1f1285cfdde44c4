"""Language identification by cross-parsing.

A suffix automaton of sampled labelled text per language accepts every substring of that text. A document is parsed
greedily into the longest phrases that occur in a language's text; c phrases over n characters against N characters
of text estimate the cross entropy c log2(N) / n. The language with the least wins.

The transitions of all automata lie in one sparse table, whatever their alphabets, and many stretches of text are
stepped through it at once. A long text is cut into stretches that first start a phrase anew; then each is parsed again
from where its predecessor really ended, until both parses are in the same state, so that cutting changes no count.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.llm.arrow import slices
from viaduct.session import ready, stored

#: Bounds of the labelled sample: documents and characters a language.
SAMPLE_DOCS, SAMPLE_CHARS = 60, 24_000
#: Codes of a stretch, codes between the states that are kept of it, and rounds before a text is parsed in one go.
LANE, MARK, ROUNDS = 1024, 32, 6
#: Slots of the table for each transition, and random places tried at once for a state's transitions.
SPARSE, TRIES = 4, 64
UNDETERMINED, SHARPNESS = "und", 8
RESULT = "doc_id long, lang_pred string, score double"


def suffix_automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of ``codes``; state 0 is the start (Blumer et al. 1985, online form)."""
    moves: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for code in codes:
        new = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        at = last
        while at >= 0 and code not in moves[at]:
            moves[at][code] = new
            at = link[at]
        if at >= 0:
            to = moves[at][code]
            if length[at] + 1 == length[to]:
                link[new] = to
            else:
                copy = len(moves)
                moves.append(dict(moves[to]))
                length.append(length[at] + 1)
                link.append(link[to])
                link[to] = link[new] = copy
                while at >= 0 and moves[at].get(code) == to:
                    moves[at][code] = copy
                    at = link[at]
        last = new
    return moves


class Transitions:
    """Transitions of all states in one table: state s on code c is at ``base[s] + c`` if ``owner`` there is s."""

    def __init__(self, moves: list[dict[int, int]], width: int):
        total = sum(map(len, moves))
        rng = np.random.default_rng(0)
        size = max(64, SPARSE * total) + 2 * width
        owner, target = np.full(size, -1, np.int32), np.zeros(size, np.int32)
        self.base = np.zeros(len(moves), np.int32)
        single = [s for s, to in enumerate(moves) if len(to) == 1]
        for s in sorted((s for s, to in enumerate(moves) if len(to) > 1), key=lambda s: -len(moves[s])):
            codes = np.array(list(moves[s]), np.int64)
            while True:  # a place where all its codes are free
                places = rng.integers(0, size - width, TRIES)
                free = (owner[places[:, None] + codes] < 0).all(axis=1)
                if free.any():
                    break
            at = int(places[free.argmax()])
            self.base[s] = at
            owner[at + codes], target[at + codes] = s, list(moves[s].values())
        if single:
            codes, to = (np.array([x[k] for s in single for x in moves[s].items()], np.int64) for k in (0, 1))
            free = np.flatnonzero(owner[width:] < 0)[: len(single)] + width
            self.base[single] = free - codes
            owner[free], target[free] = single, to
        self.owner, self.target = owner, target


class CrossParser:
    """Automata of all languages, stepped for many texts at once.

    Letters of the sampled texts, in lower case, have codes from 1; runs of all other characters are one space, code 0;
    letters that no sample has share the last code, which no automaton accepts.
    """

    def __init__(self, samples: dict[str, list[str]], lane: int = LANE):
        """``samples``: texts by language, the preferred one of a tie first."""
        self.languages, self.lane = list(samples), lane
        letters = sorted({c for texts in samples.values() for t in texts for c in t.lower() if c.isalpha()})
        self.alphabet = {c: i + 1 for i, c in enumerate(letters)}
        self.width = len(letters) + 2
        self._lookup = None
        moves: list[dict[int, int]] = []
        self.roots, self.logs = [], []
        for texts in samples.values():
            codes = [int(c) for t in texts for c in np.append(self.codes(t), 0)]
            base = len(moves)
            moves += [{c: to + base for c, to in own.items()} for own in suffix_automaton(codes)]
            self.roots.append(base)
            self.logs.append(np.log2(max(2, len(codes))))
        self.moves = Transitions(moves, self.width)
        # where no move goes on, a phrase ends and the next one starts with this character
        self.again = np.array([[moves[r].get(c, r) for c in range(self.width)] for r in self.roots], np.int32).reshape(len(self.roots), self.width)

    def codes(self, text: str) -> np.ndarray:
        if self._lookup is None:
            self._lookup = np.zeros(0x110000, np.int32)
            for c in range(0x110000):
                if chr(c).isalpha():
                    low = chr(c).lower()
                    self._lookup[c] = self.alphabet.get(low if len(low) == 1 else chr(c), self.width - 1)
        found = self._lookup[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")]
        if not len(found):
            return found
        return found[np.append(True, (found[1:] != 0) | (found[:-1] != 0))]

    def _step(self, state: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """States by language and stretch after one code each, and where a phrase ended."""
        at = self.moves.base[state] + codes
        ends = self.moves.owner[at] != state
        return np.where(ends, self.again[:, codes], self.moves.target[at]), ends

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases of each text by language, and the number of codes of each text (0: it has no letter)."""
        coded = [self.codes(t) for t in texts]
        coded = [c if c.any() else c[:0] for c in coded]
        sizes, count = np.array([len(c) for c in coded], np.int64), len(self.languages)
        total = np.zeros((len(texts), count))
        total[sizes > 0] = 1  # the phrase that is open at the end
        if not count or not sizes.any():
            return total, sizes
        lanes = -(-sizes // self.lane)
        owner = np.repeat(np.arange(len(texts)), lanes)
        first = (np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)) * self.lane
        lengths = np.minimum(self.lane, sizes[owner] - first)
        held = np.zeros((int(lengths.max()), len(owner)), np.int32)
        for i, (own, at, n) in enumerate(zip(owner, first, lengths, strict=True)):
            held[:n, i] = coded[own][at : at + n]
        start = np.repeat(np.array(self.roots, np.int32)[:, None], len(owner), axis=1)
        marks = np.zeros((-(-len(held) // MARK), count, len(owner)), np.int32)
        found, state = np.zeros((2, count, len(owner)), np.int32)
        breaks = np.zeros_like(marks)
        self._parse(held, lengths, start, np.arange(len(owner)), marks, breaks, found, state)
        follows = np.flatnonzero(first > 0)
        for _ in range(ROUNDS):
            wrong = follows[(state[:, follows - 1] != start[:, follows]).any(axis=0)]
            if not len(wrong):
                break
            start[:, wrong] = state[:, wrong - 1]
            self._parse(held, lengths, start, wrong, marks, breaks, found, state, known=True)
        # texts whose parses do not meet, such as one letter again and again, go on step by step
        for i in sorted(set(owner[follows[(state[:, follows - 1] != start[:, follows]).any(axis=0)]].tolist())):
            own = np.flatnonzero(owner == i)
            late = own[1:][(state[:, own[:-1]] != start[:, own[1:]]).any(axis=0)][0]
            for k in range(count):
                found[k, late : own[-1] + 1] = 0
                found[k, late] = self._parse_one(k, int(state[k, late - 1]), coded[i][first[late] :])
        np.add.at(total, owner, found.T)
        return total, sizes

    def _parse(self, held, lengths, start, which, marks, breaks, found, state, known: bool = False) -> None:
        """Parse the stretches ``which`` from ``start``; ``known`` ones only until they meet what was found before.

        ``marks`` and ``breaks`` keep states and counts of ended phrases at every ``MARK`` codes, ``found`` and
        ``state`` those at the end.
        """
        which = which[np.argsort(-lengths[which], kind="stable")]
        size = lengths[which]
        own, ended = start[:, which], np.zeros((start.shape[0], len(which)), np.int32)
        for k in range(int(size.max(initial=0))):
            if k % MARK == 0 and k:
                m = k // MARK
                if known:
                    met = (marks[m][:, which] == own).all(axis=0)
                    if met.any():  # the rest is as it was, but for the count so far
                        i = which[met]
                        more = ended[:, met] - breaks[m][:, i]
                        found[:, i] += more
                        later = breaks[m:, :, i] + more
                        breaks[m:, :, i] = later
                        which, size, own, ended = which[~met], size[~met], own[:, ~met], ended[:, ~met]
                        if not len(which):
                            return
                marks[m][:, which], breaks[m][:, which] = own, ended
            done = int(np.searchsorted(-size, -k, side="left"))  # stretches longer than k come first
            if done < len(which):
                found[:, which[done:]], state[:, which[done:]] = ended[:, done:], own[:, done:]
                which, size, own, ended = which[:done], size[:done], own[:, :done], ended[:, :done]
            own, broke = self._step(own, held[k, which])
            ended = ended + broke
        found[:, which], state[:, which] = ended, own

    def _parse_one(self, language: int, state: int, codes: np.ndarray) -> int:
        """Phrases that end while one automaton runs from ``state`` over ``codes``."""
        base, owner, target = memoryview(self.moves.base), memoryview(self.moves.owner), memoryview(self.moves.target)
        again, ended = memoryview(self.again[language]), 0
        for code in memoryview(np.ascontiguousarray(codes)):
            at = base[state] + code
            if owner[at] == state:
                state = target[at]
            else:
                state, ended = again[code], ended + 1
        return ended

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        total, sizes = self.phrases([t or "" for t in texts])
        if not self.languages:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        cost = np.maximum(total, 1) * np.array(self.logs)
        best = cost.argmin(axis=1)
        weight = (cost.min(axis=1, keepdims=True) / cost) ** SHARPNESS
        known = sizes > 0
        score = np.where(known, weight[np.arange(len(texts)), best] / weight.sum(axis=1), 0.0)
        return [self.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)], score


def sample_by_language(docs: DataFrame, most_docs: int = SAMPLE_DOCS, most_chars: int = SAMPLE_CHARS) -> dict[str, list[str]]:
    """A bounded sample of whole texts by language, the language with most documents first.

    Of the ``most_docs`` documents of a language whose ids have the least hashes, texts are taken while they fit into
    ``most_chars`` together; if none fits, the shortest is, unless it is ten times as long: then the language has no
    text and is not learned.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    counts = labelled.groupBy("lang").count().collect()
    by_hash = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = labelled.select("lang", "doc_id").withColumn("rank", F.row_number().over(by_hash)).filter(F.col("rank") <= most_docs)
    ids = [r["doc_id"] for r in picked.select("doc_id").collect()]
    texts = labelled.filter(F.col("doc_id").isin(ids)).select("lang", "doc_id", F.length("text").alias("size"), "text")
    texts = stored(texts.filter(F.col("size") <= 10 * most_chars), "sample")
    sized = texts.select("lang", "doc_id", "size").collect()
    taken: dict[str, list[tuple]] = {}
    for lang in counts:
        own = sorted((r["doc_id"] * 2654435761 % 2**32, r["doc_id"], r["size"]) for r in sized if r["lang"] == lang["lang"])
        left = most_chars
        for _, i, n in own:
            if n <= left:
                taken.setdefault(lang["lang"], []).append((i, n))
                left -= n
        if own and lang["lang"] not in taken:
            taken[lang["lang"]] = [min(((i, n) for _, i, n in own), key=lambda x: x[::-1])]
    wanted = sorted({i for own in taken.values() for i, _ in own})
    found: dict[tuple, list[str]] = {}
    for r in texts.filter(F.col("doc_id").isin(wanted)).collect() if wanted else ():
        found.setdefault((r["lang"], r["doc_id"], r["size"]), []).append(r["text"])
    samples: dict[str, list[str]] = {}
    for lang in sorted(counts, key=lambda r: (-r["count"], r["lang"])):
        own = dict.fromkeys(taken.get(lang["lang"], ()))  # rows that repeat an id, of one length, come in the order of their texts
        rows = [t for i, n in own for t in sorted(found[(lang["lang"], i, n)])[: taken[lang["lang"]].count((i, n))]]
        if rows:
            samples[lang["lang"]] = rows
    return samples


def predict_language(docs: DataFrame, parser: CrossParser) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of ``docs(doc_id, text)``; other columns are not read.

    Texts that are null or have no letter are ``und`` with score 0, as is everything if nothing was learned. Ties go
    to the language with more labelled documents.
    """
    spark = ready(docs.sparkSession)
    model = spark.sparkContext.broadcast(parser)

    def predict(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 6 << 20):
            langs, score = model.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(langs, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(predict, RESULT)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all ``documents``, learned from those outside the held-out quarter."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.crc32(F.col("doc_id").cast("string")) % 4
    parser = CrossParser(sample_by_language(docs.filter(fold != 2)))
    found = predict_language(docs, parser)
    return found.select("doc_id", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")
