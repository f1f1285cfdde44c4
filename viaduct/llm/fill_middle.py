"""Fill-in-the-middle reordering of documents (Bavarian et al. 2022), cut by a sparse index of multibyte characters.

A text is cut in UTF-8 bytes, while its cuts are drawn and reported in units or code points. The two differ only behind
multibyte characters, so an index holds just those: where each stands, and the bytes beyond one that all before it take.
Binary search in it turns a code point into a byte and back; between two entries the two run in step, and a text in
ASCII has no entries at all. One index serves all texts of a batch.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.arrow import byte_texts, slices, tidy
from viaduct.session import ready

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, PERCENT, SPM_PERCENT = 42, 50, 80
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, prefix_bytes long, middle_bytes long, output string"


class ExceptionIndex:
    """The multibyte characters of a buffer of UTF-8: positions in code points, and the excess bytes before each."""

    def __init__(self, buffer: np.ndarray):
        lead = np.flatnonzero(buffer >= 0xC0)
        excess = 1 + (buffer[lead] >= 0xE0).astype(np.int64) + (buffer[lead] >= 0xF0)
        self.before = np.concatenate((np.zeros(1, np.int64), np.cumsum(excess)))
        self.chars = lead - self.before[:-1]

    def byte_of(self, char):
        """The byte at which code point ``char`` begins; the number of code points gives that of bytes."""
        return char + self.before[np.searchsorted(self.chars, char, side="left")]

    def char_of(self, byte):
        """The code point that begins at ``byte``, which must be the first of a character or the end."""
        return byte - self.before[np.searchsorted(self.chars + self.before[:-1], byte, side="left")]


def unit_ends(buffer: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """The bytes behind each unit: a run of other characters with the white space before it, or white space at the end.

    Texts lie between neighbouring ``edges`` of the buffer; white space is space and the characters 09 to 0D.
    """
    space = (buffer == 32) | ((buffer >= 9) & (buffer <= 13))
    last = np.zeros(len(buffer), bool)
    last[:-1] = ~space[:-1] & space[1:]
    last[edges[1:][np.diff(edges) > 0] - 1] = True
    return np.flatnonzero(last) + 1


def _draws(ids: list, seed: int) -> np.ndarray:
    """Four 32-bit draws for each id; a null id is drawn for as an empty one."""
    digests = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(digests, ">u4").reshape(-1, 4).astype(np.int64)


def fill_in_middle(docs: DataFrame, unit: str = "word", percent: int = PERCENT, spm_percent: int = SPM_PERCENT, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n, form, prefix_chars, middle_chars, prefix_bytes, middle_bytes, output.

    ``n`` counts the units of a text: words with the white space before them, or with ``unit="char"`` code points. Prefix
    and middle end after the lesser and the greater of two drawn numbers of units; draws depend on ``seed`` and ``doc_id``
    alone. ``percent`` of the texts are transformed, ``spm_percent`` of them with the suffix first. A text that is null,
    empty or holds a marker stays plain, with null lengths; rows of one id are cut by the same draws; a null id is drawn
    for as an empty one. Whole texts of any length are cut, an empty table stays empty, other columns are not read.
    """
    if unit not in ("word", "char"):
        raise ValueError("unit is word or char")
    ready(docs.sparkSession)
    marks = tuple(m.encode() for m in (PREFIX, SUFFIX, MIDDLE))
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 4 << 20):
            texts = byte_texts(batch.column("text"))
            buffer = np.frombuffer(b"".join(texts), np.uint8)
            edges = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
            index = ExceptionIndex(buffer)
            first = index.char_of(edges)
            draws = _draws(batch.column("doc_id").to_pylist(), seed)
            if unit == "word":
                ends = np.concatenate(([0], unit_ends(buffer, edges)))  # one before all units, as none begins the first
                base = np.searchsorted(ends[1:], edges, side="right")
                n = np.diff(base)
            else:
                n = np.diff(first)
            low, high = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1).T
            if unit == "word":
                cuts = [np.where(k > 0, ends[base[:-1] + k], edges[:-1]) for k in (low, high)]
                chars = [index.char_of(c) - first[:-1] for c in cuts]
            else:
                chars = [low, high]
                cuts = [index.byte_of(first[:-1] + k) for k in chars]
            plain = (n == 0) | (draws[:, 2] % 100 >= percent) | np.array([any(m in t for m in marks) for t in texts], bool)
            form = np.where(plain, "plain", np.where(draws[:, 3] % 100 < spm_percent, "spm", "psm"))
            one, two = (c - edges[:-1] for c in cuts)
            outputs = []
            for text, kind, a, b in zip(texts, form.tolist(), one.tolist(), two.tolist(), strict=True):
                head, tail = (marks[0] + text[:a], marks[1] + text[b:])
                outputs.append(text if kind == "plain" else (head + tail if kind == "psm" else tail + head) + marks[2] + text[a:b])
            lengths = [pa.array(x, pa.int64(), mask=plain) for x in (chars[0], chars[1] - chars[0], one, two - one)]
            columns = [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(form.tolist(), pa.string()), *lengths, pa.array(outputs, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return own.mapInArrow(tidy(cut), SCHEMA)


def restored(form: Column | str, output: Column | str) -> Column:
    """The text that an output was made of, as a Column of its ``form`` and ``output`` alone.

    Transformed texts hold no marker of their own, and none can arise at a seam, as a marker begins with a character
    that it has only once; so the three markers are the only ones.
    """
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    first, second = (F.when(form == "psm", parts[a]).otherwise(parts[b]) for a, b in ((1, 2), (2, 1)))
    return F.when(form == "plain", output).otherwise(F.concat(first, parts[3], second))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The form, cuts and digests of all ``documents``."""
    done = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return done.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"),
        F.sha2(restored("form", "output").cast("binary"), 256).alias("restored_sha256"),
    )
