"""Collocations: phrases that are more frequent than their parts make likely, mined as by Toivonen (1996).

A sample of the documents is mined first, length by length, with a lowered threshold. What is frequent there is proposed;
its negative border are the phrases not proposed whose parts, one word shorter at either end, all are. One pass over all
documents counts both exactly. Where a phrase of the border turns out to be frequent, the border was drawn too close, and
an expansion pass goes on from there: it counts each phrase with such a failure inside whose parts are proposed, failed or
counted by this pass themselves. A frequent phrase has frequent parts only, so that pass leaves none uncounted.

The border is never listed. Tasks hold the proposed phrases as a map of bits of bounded size, and count an occurrence
when the bits of both its parts are set. Bits that are set by chance make a pass count more than it must, never less, so
a map that gets crowded costs time only. Passes count 45-bit hashes, which each task sums up and sends as packed sorted
differences; a last one counts the texts of all phrases whose hashes are frequent, so results do not depend on hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from math import sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from viaduct.llm.arrow import byte_texts, hash_spans, mix, release, slices, spans_of, squeezed, tidy, unsqueezed
from viaduct.llm.counts import WORD_SIZE, growth
from viaduct.llm.exact_dedup import LEAST_MAP_BITS, MOST_MAP_BITS, bit_map, in_bit_map
from viaduct.session import join_counted, observed, ready, stored

LEAST, LONGEST, TOP = 100, 5, 2000
#: One in so many documents is in the sample; its threshold is lowered by so many standard deviations.
SHARE, DEVIATIONS = 8, 1.5
#: Phrases to a part of the last count, and rows of it that a task holds.
PART_PHRASES, HELD_PHRASES = 1 << 14, 1 << 18
#: Bits of a key, keys of a pass that a task holds, and bytes of text to a part of its sums.
KEY_BITS, HELD_KEYS, PART_BYTES = 48, 1 << 21, 8 << 20
#: Parts in which the best phrases of a group are picked before they meet in one task.
PICK_PARTS = 64
NO_GROUP = "und"
#: Letters in lower case; characters between pieces become a line feed, tabs a space.
_PLAIN = bytes(10 if b in b".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_LENGTH = np.uint64(7)
Marks = tuple[object, int]


class _Words:
    """The words of some texts of one group, and their phrases level by level."""

    def __init__(self, group: str, texts: list[bytes]):
        self.buffer = np.frombuffer((b"\n".join(texts) + b"\n").translate(_PLAIN), np.uint8)
        self.starts, self.ends = spans_of((self.buffer != 32) & (self.buffer != 10))
        self.hashes = hash_spans(self.buffer, self.starts, self.ends)
        piece = np.cumsum(self.buffer == 10)[self.starts]
        self.joined = piece[1:] == piece[:-1]  # whether a word and the next are of one piece
        self.salt = np.uint64(xxhash.xxh3_64_intdigest(group.encode()))

    def keys(self, at: np.ndarray, grams: np.ndarray, k: int) -> np.ndarray:
        """Keys of phrases of ``k`` words: 45 bits of a hash of group and words, and the length."""
        return ((mix(grams[at] ^ self.salt) >> np.uint64(64 - KEY_BITS)) & ~_LENGTH) | np.uint64(k)

    def levels(self, longest: int, held: Callable | None, before: Callable | None = None, wide: bool = False) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each length where the phrases begin that a pass counts, and their keys.

        These are the phrases both parts of which are held, and all words. ``held`` tells of keys whether they are; None
        holds nothing. With ``before``, what a pass with that counted is left out. With ``wide`` phrases that are counted
        here are held as well.
        """
        n = len(self.hashes)
        grams, places, past = self.hashes.copy(), np.arange(n), np.zeros(n + 1, bool)
        past[:n] = before is not None
        for k in range(1, longest + 1):
            keys = self.keys(places, grams, k)
            new = ~past[places]
            yield k, places[new], keys[new]
            if k == longest:
                return
            flags = np.zeros(n + 1, bool)
            flags[places] = held(keys) if held else False
            if wide:
                flags[places[new]] = True
            if before is not None:
                old = np.zeros(n + 1, bool)
                old[places[~new]] = before(keys[~new])
                past[:-1] = old[:-1] & old[1:]
                if k == 1:
                    past[: n - 1] &= self.joined
            both = np.flatnonzero(flags[:-1] & flags[1:])
            places = both[self.joined[both]] if k == 1 else both
            grams[places] = grams[places] * _FACTOR + self.hashes[places + k]


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes]]]:
    """The texts of each group of a batch."""
    texts, own = byte_texts(batch.column("text")), {}
    for group, text in zip(batch.column("lang").to_pylist(), texts, strict=True):
        own.setdefault(group, []).append(text)
    yield from own.items()


def _held(marks: Marks | None) -> Callable | None:
    if marks is None:
        return None
    shared, bits = marks
    return lambda keys: in_bit_map(keys >> np.uint64(3), shared.value, bits).astype(bool)


def _map(keys: DataFrame, count: int) -> Marks:
    """The map of bits of ``count`` keys."""
    return bit_map(keys.select(F.shiftrightunsigned("key", 3).alias("print")), _bits(count))


def _bits(count: int) -> int:
    return min(MOST_MAP_BITS, max(LEAST_MAP_BITS, (16 * count).bit_length()))


def _grown(spark: SparkSession, marks: Marks | None, keys: DataFrame, count: int) -> Marks:
    """``marks`` with the bits of ``keys`` set as well, and room for them."""
    added, bits = _map(keys, count) if marks is None else bit_map(keys.select(F.shiftrightunsigned("key", 3).alias("print")), max(marks[1], _bits(count)))
    if marks is None:
        return added, bits
    old = np.tile(marks[0].value, 1 << (bits - marks[1]))  # a bit's place there is the lower part of its place here
    both = spark.sparkContext.broadcast(old | added.value)
    added.destroy()
    return both, bits


def _summed_keys(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys of all, sorted, and their counts."""
    keys, counts = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
    return keys[first], np.add.reduceat(counts[order], first) if len(first) else counts


def _counted(docs: DataFrame, least: int, longest: int, held: Marks | None, before: Marks | None = None, wide: bool = False, only: int = 0) -> tuple[DataFrame, int]:
    """(key), stored: the phrases of ``docs(lang, text)`` that a pass counts ``least`` times or more; and their number.

    What a pass counts ``_Words.levels`` says; with ``only`` it is the phrases of so many words.
    """

    spark, size = docs.sparkSession, docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(size / (PART_BYTES * growth(size / WORD_SIZE))))
    parts = 1 << (parts - 1).bit_length()
    shift = np.uint64(KEY_BITS - parts.bit_length() + 1)

    def packed(keys: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
        edges = np.searchsorted(keys >> shift, np.arange(parts + 1, dtype=np.uint64))
        some = np.flatnonzero(np.diff(edges))
        cuts = [slice(edges[p], edges[p + 1]) for p in some]
        columns = [squeezed(np.diff(keys[c], prepend=np.uint64(0))) for c in cuts], [squeezed(counts[c]) for c in cuts]
        return pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), *(pa.array(x, pa.binary()) for x in columns)], names=["part", "keys", "counts"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        new, old = _held(held), _held(before)
        own: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in slices(batches, "text", 4 << 20):
            for group, texts in _groups(batch):
                for k, _, keys in _Words(group, texts).levels(longest, new, old, wide):
                    if len(keys) and only in (0, k):
                        some, counts = np.unique(keys, return_counts=True)
                        own.append((some, counts.astype(np.uint64)))
            if sum(len(k) for k, _ in own) > HELD_KEYS:
                own = [_summed_keys(own)]
                if len(own[0][0]) > HELD_KEYS // 2:
                    yield packed(*own.pop())
        if own:
            yield packed(*_summed_keys(own))

    def total(table: pa.Table) -> pa.Table:
        found = [(np.cumsum(unsqueezed(k), dtype=np.uint64), unsqueezed(n)) for k, n in zip(table.column("keys").to_pylist(), table.column("counts").to_pylist(), strict=True)]
        keys, counts = _summed_keys(found)
        del found
        keys = keys[counts >= least]
        if len(counts) > HELD_KEYS:
            release()
        return pa.table({"key": pa.array(keys.view(np.int64))})

    sent = docs.mapInArrow(tidy(count), "part long, keys binary, counts binary")
    counted = sent.groupBy("part").applyInArrow(total, "key long")
    found, seen = observed(counted, "counted")
    return found, seen["n"]


def frequent_keys(docs: DataFrame, sample: DataFrame, least: int, lowered: int, longest: int = LONGEST) -> DataFrame:
    """(key): all phrases of ``docs(lang, text)`` with ``least`` occurrences or more, by their hashes; some more than once.

    Those with ``lowered`` occurrences in ``sample`` are proposed. Whatever the sample, the result is the same.
    """
    spark, known, marks = docs.sparkSession, None, None
    for k in range(1, longest):
        level, n = _counted(sample, lowered, k, marks, only=k)
        known = level if known is None else known.unionByName(level)
        marks = _grown(spark, marks, level, n)
        if not n:
            break
    found, _ = _counted(docs, least, longest, marks)
    if known is None:
        return found
    inner = found.filter(F.col("key").bitwiseAND(7) < longest)
    failed, seen = observed(inner.join(known, "key", "left_anti"), "failed")
    count = seen["n"]
    if not count:
        return found
    more, _ = _counted(docs, least, longest, _grown(spark, marks, failed, count), before=marks, wide=True)
    return found.unionByName(more)


def _gathered(buffer: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The bytes of each span, copied one after the other."""
    edges = np.concatenate((np.zeros(1, np.int64), np.cumsum(ends - starts)))
    where = np.arange(edges[-1]) + np.repeat(starts - edges[:-1], ends - starts)
    return pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(buffer[where])])


def _packed(counted: pa.Table, parts: int) -> Iterator[pa.RecordBatch]:
    """(part, packed): the rows of ``counted`` by a hash of their phrase, those of a part together and compressed."""
    whose = np.array([xxhash.xxh3_64_intdigest(p) for p in counted.column("phrase").to_pylist()], np.uint64) % np.uint64(parts)
    order = np.argsort(whose, kind="stable")
    some, starts = np.unique(whose[order], return_index=True)
    counted = counted.take(pa.array(order)).combine_chunks()
    pack = zstandard.ZstdCompressor(level=1).compress
    packed = []
    for a, b in zip(starts, np.append(starts[1:], len(order)), strict=True):
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, counted.schema) as out:
            out.write_table(counted.slice(a, b - a))
        packed.append(pack(sink.getvalue()))
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(packed, pa.binary())], names=["part", "packed"])


def count_texts(docs: DataFrame, keys: DataFrame, least: int, longest: int = LONGEST) -> DataFrame:
    """(lang, k, phrase, f), stored: exact counts of phrases whose keys are given, with ``least`` occurrences or more.

    The row of each lang with k = 0 and no phrase has the number of its words. Each task sums up what it finds, as far as
    it holds it, and sends it packed to the parts that its hash names, as most of these phrases are in most tasks.
    """
    count = keys.count()
    marks = _map(keys, count)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // PART_PHRASES)

    def summed(tables: list[pa.Table]) -> pa.Table:
        whole = pa.concat_tables(tables).group_by(["lang", "k", "phrase"]).aggregate([("f", "sum")])
        return whole.select(["lang", "k", "phrase", "f_sum"]).rename_columns(["lang", "k", "phrase", "f"])

    def count_in(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _held(marks)
        held: list[pa.Table] = []
        for batch in slices(batches, "text", 4 << 20):
            for group, texts in _groups(batch):
                own = _Words(group, texts)
                word = (own.buffer != 32) & (own.buffer != 10)
                kept = word.copy()
                kept[1:] |= word[:-1]  # one character between words
                plain = np.where(own.buffer[kept] == 10, 32, own.buffer[kept]).astype(np.uint8)
                sizes = own.ends - own.starts
                starts = np.concatenate((np.zeros(1, np.int64), np.cumsum(sizes + 1)))[:-1]
                found = [(0, pa.array([b""], pa.large_binary()), [len(sizes)])]
                for k, places, keys in own.levels(longest, known):
                    at = places[known(keys)]
                    counts = _gathered(plain, starts[at], starts[at + k - 1] + sizes[at + k - 1]).value_counts()
                    found.append((k, counts.field("values"), counts.field("counts")))
                for k, phrases, counts in found:
                    n = len(phrases)
                    held.append(pa.table({"lang": pa.array([group] * n, pa.string()), "k": pa.array(np.full(n, k, np.int32)), "phrase": phrases, "f": pa.array(counts, pa.int64())}))
            if sum(map(len, held)) > HELD_PHRASES:
                held = [summed(held)]
                if len(held[0]) > HELD_PHRASES // 2:
                    yield from _packed(held.pop(), parts)
        if held:
            yield from _packed(summed(held), parts)

    def merge(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        whole = summed([pa.ipc.open_stream(unpack(raw)).read_all() for raw in table.column("packed").to_pylist()])
        whole = whole.filter(pc.or_(pc.greater_equal(whole.column("f"), least), pc.equal(whole.column("k"), 0)))
        return whole.set_column(2, "phrase", whole.column("phrase").cast(pa.large_string()).cast(pa.string()))

    sent = docs.mapInArrow(tidy(count_in), "part long, packed binary")
    return stored(sent.groupBy("part").applyInArrow(merge, "lang string, k int, phrase string, f long"), "phrases")


def frequent_phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE) -> DataFrame:
    """(lang, k, phrase, f), stored: all phrases of up to ``longest`` words with ``least`` occurrences or more in a lang.

    Texts of ``docs(text, lang)`` are put in lower case (A to Z only) and cut into pieces at ``.,;:!?`` and the characters
    0A to 0D, pieces at spaces and tabs into words. The row of each lang with k = 0 has the number of its words. One in
    ``share`` documents, by a hash, is in the sample, which decides how many passes are needed, not their result. A null
    lang is "und", a null text has no words, an empty table has no phrases; other columns are not read.
    """
    if not 1 <= longest <= 7:
        raise ValueError("phrases have from one to seven words")
    ready(docs.sparkSession)
    picked = F.pmod(F.xxhash64(*(c for c in ("doc_id", "text") if c in docs.columns)), F.lit(share)) == 0
    own = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(NO_GROUP)).alias("lang"), F.col("text").cast("string").alias("text"), picked.alias("picked"))
    sample = stored(own.filter("picked"), "sample")
    mean = least / share
    keys = frequent_keys(own, sample, least, max(1, int(mean - DEVIATIONS * sqrt(mean))), longest)
    return count_texts(own, keys, least, longest)


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP, share: int = SHARE) -> DataFrame:
    """The first ``top`` phrases of two words and more of each lang: lang, rank, phrase, a, l, r, n, score, k.

    Counts are those of ``frequent_phrases``: ``a`` of the phrase, ``n`` all words of the lang, ``l`` and ``r`` of the two
    parts of the cut with the least score floor(1000 a n / (l r)), the first such cut. A phrase inside a longer frequent
    one with as many occurrences is left out. Order: score, then ``a``, both falling, then the bytes of the phrase.
    """
    counts = frequent_phrases(docs, least, longest, share)
    totals = counts.filter("k = 0").select("lang", F.col("f").alias("n"))  # a row a lang
    phrases = counts.filter("k > 0")
    key = F.struct("lang", "phrase").alias("key")
    longer = phrases.filter("k > 1").withColumn("words", F.split("phrase", " "))
    # which phrases a longer one with as many occurrences holds
    size, first = F.explode(F.sequence(F.lit(2), F.col("k") - 1)), F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1))
    inside = longer.filter("k > 2").withColumn("size", size).withColumn("at", first)
    inside = inside.select("lang", F.array_join(F.slice("words", F.col("at"), F.col("size")), " ").alias("phrase"), "f")
    covered = inside.groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    kept = longer.join(covered, ["lang", "phrase"], "left").filter(F.col("most").isNull() | (F.col("most") < F.col("f")))
    cut = F.explode(F.sequence(F.lit(1), F.col("k") - 1))
    parts = stored(
        kept.withColumn("cut", cut).select(
            "lang", "phrase", F.col("f").alias("a"), "k", "cut",
            F.struct("lang", F.array_join(F.slice("words", F.lit(1), F.col("cut")), " ").alias("phrase")).alias("left"),
            F.struct("lang", F.array_join(F.slice("words", F.col("cut") + 1, F.col("k") - F.col("cut")), " ").alias("phrase")).alias("right"),
        ),
        "cuts",
    )
    known = phrases.select(key, "f")
    for side, name in (("left", "l"), ("right", "r")):  # "the" is a part of many phrases
        uses = parts.groupBy(F.col(side).alias("key")).agg(F.count(F.lit(1)).alias("uses"))
        counted = known.join(uses, "key").select(F.col("key").alias(side), F.col("f").alias(name), "uses")
        parts = join_counted(parts, counted, side, "uses").drop("uses")
    parts = join_counted(parts, totals.join(parts.groupBy("lang").agg(F.count(F.lit(1)).alias("uses")), "lang"), "lang", "uses").drop("uses")
    wide = {c: F.col(c).cast("decimal(18,0)") for c in ("a", "n", "l", "r")}
    parts = parts.withColumns({"_up": wide["a"] * wide["n"] * F.lit(1000).cast("decimal(4,0)"), "_down": wide["l"] * wide["r"]})
    scored = parts.withColumn("score", F.expr("_up div _down"))
    least_cut = F.min_by(F.struct("a", "k", "l", "r", "n", "score"), F.struct("score", "cut")).alias("own")
    best = scored.groupBy("lang", "phrase").agg(least_cut).select("lang", "phrase", "own.*")
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(PICK_PARTS))
    some = best.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).filter(F.col("rank") <= top)
    whole = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return whole.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score", F.col("k").cast("long").alias("k"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all ``documents`` by lang."""
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("k")
