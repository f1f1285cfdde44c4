"""Token ids of texts by a public tokenizer, for use inside tasks."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from viaduct.llm.arrow import hash_spans

#: White space as Unicode has it; Python's ``\s`` also takes the four separators 1C to 1F.
_CHUNK = re.compile(r"(?:[^\S\x1c-\x1f])*[\S\x1c-\x1f]+|(?:[^\S\x1c-\x1f])+")
#: Any white space but single spaces and line ends that touch no space.
_RARE = r"  | \n|\n |[\t\x0b\f\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
#: Chunks whose ids a worker remembers, some 50 bytes each, and chunks encoded in one call.
REMEMBERED, BLOCK = 600_000, 400
#: Marks chunks that are not one space and a word without spaces.
_ODD, _SECOND = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


class Encoder:
    """Encodes batches of texts with the ``tokenizers`` library.

    The byte-level pre-tokenizer always cuts between a character that is no white space and white space after it.
    So a text's ids are those of its chunks (white space and what follows up to the next white space), and each
    distinct chunk is encoded once and remembered under a 128-bit hash.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.remembered = remembered
        self.spaced = np.zeros(self.tokenizer.get_vocab_size(), bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.spaced[i] = token.startswith("\u0120")
        self._clear()

    def _clear(self) -> None:
        self.keys, self.checks = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.starts, self.sizes, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32)
        self.pool, self.used = np.zeros(1 << 16, np.uint32), 0

    def _forget(self) -> None:
        """Keep the chunks that more than one batch had; without many of those, keep none."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self.remembered // 2:
            return self._clear()
        sizes = self.sizes[kept].astype(np.int64)
        ends = np.cumsum(sizes)
        pool = self.pool[np.repeat(self.starts[kept] - ends + sizes, sizes) + np.arange(int(sizes.sum()))]
        self.keys, self.checks, self.sizes, self.uses = (x[kept] for x in (self.keys, self.checks, self.sizes, self.uses))
        self.starts, self.pool, self.used = ends - sizes, np.concatenate((pool, np.zeros(1 << 16, np.uint32))), len(pool)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, chunks: list[str], even: np.ndarray) -> list[np.ndarray]:
        """The ids of each chunk. Even ones go many to a call: an id that starts with a space starts a chunk."""
        out: list[np.ndarray | None] = [None] * len(chunks)
        odd = np.flatnonzero(~even).tolist()
        own = np.flatnonzero(even).tolist()
        groups = [own[i : i + BLOCK] for i in range(0, len(own), BLOCK)]
        for group, found in zip(groups, self._ids(["".join([chunks[i] for i in g]) for g in groups]), strict=True):
            first = np.flatnonzero(self.spaced[found])
            if len(first) == len(group):
                for i, ids in zip(group, np.split(found, first[1:]), strict=True):
                    out[i] = ids
            else:
                odd += group
        for i, ids in zip(odd, self._ids([chunks[i] for i in odd]), strict=True):
            out[i] = ids
        return out

    def _places(self, keys: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, keys)
        safe = np.minimum(at, max(len(self.keys) - 1, 0))
        hit = (self.keys[safe] == keys) & (self.checks[safe] == checks) if len(self.keys) else np.zeros(len(keys), bool)
        return safe, hit

    def _remember(self, keys: np.ndarray, checks: np.ndarray, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], np.int32)
        total = int(sizes.sum())
        while self.used + total > len(self.pool):
            self.pool = np.concatenate((self.pool, np.zeros_like(self.pool)))
        if total:
            self.pool[self.used : self.used + total] = np.concatenate(ids)
        starts = self.used + np.cumsum(sizes, dtype=np.int64) - sizes
        self.used += total
        order = np.argsort(keys)
        at = np.searchsorted(self.keys, keys[order])
        new = ((self.keys, keys), (self.checks, checks), (self.starts, starts), (self.sizes, sizes), (self.uses, np.zeros(len(keys), np.int32)))
        self.keys, self.checks, self.starts, self.sizes, self.uses = (np.insert(x, at, y[order]) for x, y in new)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after the other, and the bounds of each text in them; null counts as empty."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        rare = pc.match_substring_regex(texts, _RARE).to_numpy(zero_copy_only=False)
        split = pc.split_pattern(pc.if_else(pa.array(~rare), texts, ""), " ")
        bounds = split.offsets.to_numpy()
        coded = split.values.dictionary_encode()
        index = coded.indices.to_numpy().astype(np.int64)
        # a text's first word has no space before it
        heads = pc.take(split.values, pa.array(bounds[:-1])).dictionary_encode()
        index[bounds[:-1]] = heads.indices.to_numpy() + len(coded.dictionary)
        odd = heads.dictionary
        if rare.any():
            index, bounds, more = _rare_chunks(texts, rare, index, bounds, len(coded.dictionary) + len(odd))
            odd = pa.concat_arrays([odd, pa.array(more, pa.large_string())])
        keys, checks = (np.concatenate(x) for x in zip(_hashed(coded.dictionary), _hashed(odd, _ODD), strict=True))
        if len(self.keys) > self.remembered:
            self._forget()
        place, hit = self._places(keys, checks)
        if not hit.all():
            self._learn(np.flatnonzero(~hit), coded.dictionary, odd, keys, checks)
            place, hit = self._places(keys, checks)
            if not hit.all():  # two chunks share a hash: these texts are encoded as they are
                found = self._ids(texts.to_pylist())
                return np.concatenate([np.zeros(0, np.uint32), *found]), np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int64)
        self.uses[np.unique(place)] += 1
        at = place[index]
        sizes = self.sizes[at].astype(np.int64)
        ends = np.cumsum(sizes)
        where = np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        return self.pool[where], np.concatenate(([0], ends))[bounds]

    def _learn(self, missed: np.ndarray, words: pa.Array, odd: pa.Array, keys: np.ndarray, checks: np.ndarray) -> None:
        _, first = np.unique(keys[missed], return_index=True)
        missed = missed[np.sort(first)]
        plain = missed[missed < len(words)]
        other = missed[missed >= len(words)]
        own = _listed(words.take(pa.array(plain)))
        chunks = [f" {w}" for w in own] + odd.take(pa.array(other - len(words))).to_pylist()
        even = np.array([bool(w) for w in own] + [False] * len(other), bool)
        self._remember(keys[missed], checks[missed], self._encoded(chunks, even))


def _hashed(words: pa.Array, mark: np.uint64 = np.uint64(0)) -> tuple[np.ndarray, np.ndarray]:
    """Two independent 64-bit hashes of each string."""
    if not len(words):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    _, offsets, data = words.buffers()
    edges = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
    buffer = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
    return tuple(hash_spans(buffer, edges[:-1], edges[1:], *f) ^ mark for f in ((), (_SECOND,)))


def _rare_chunks(texts, rare, index, bounds, known: int) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """The chunks of the texts with rare white space in their places, and their strings, numbered from ``known``."""
    seen: dict[str, int] = {}
    parts, sizes = [], np.diff(bounds)
    for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:], strict=True)):
        if rare[i]:
            own = [seen.setdefault(c, known + len(seen)) for c in _CHUNK.findall(texts[i].as_py())]
            parts.append(np.array(own, np.int64))
            sizes[i] = len(own)
        else:
            parts.append(index[a:b])
    return np.concatenate(parts), np.concatenate(([0], np.cumsum(sizes))), list(seen)


def _listed(words: pa.Array) -> list[str]:
    """Strings without spaces as a list; one long string is much faster to decode than each of them."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), " ")[0].as_py().split(" ")


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder for a vocabulary file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
