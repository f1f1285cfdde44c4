"""Collocations, shards and fill-in-the-middle against brute force, row by row."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from viaduct.llm import collocations, counts, fill_middle, near_dedup, queries, rows, sharding
from viaduct.llm.arrow import squeezed, unsqueezed

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def prose(rng, n):
    words = ["the", "river", "runs", "Über", "old", "Bridge", "and", "näive", "town", "of", "stone"]
    return " ".join(rng.choice(words, n)) + rng.choice([".", "!\n", "; "])


@pytest.fixture(scope="module")
def docs():
    rng = np.random.default_rng(5)
    texts = {i: prose(rng, int(rng.integers(1, 60))) for i in range(120)}
    texts |= {200 + i: "New York City, new  york\tcity\nof old New York" for i in range(70)}
    texts |= {300: None, 301: "", 302: " \t\n", 303: "漢字 𝄞 café ", 304: "x" * 30_000, 305: "a a a a a " * 900, 306: "holds <S> itself", 307: "<P"}
    out = [(i, t, ["en", "de", None, ""][i % 4], "s", 1) for i, t in texts.items()]
    return out + [(None, "no id New York", "en", None, None)] * 3 + [out[4], out[4], (7, "another text of seven", "und", None, 2)]


@pytest.fixture(scope="module")
def frame(spark, docs):
    extra = {"shard": F.lit("x"), "_ROW": F.lit(1), "phrase": F.lit("y"), "k": F.lit(2)}  # names that operators use
    return spark.createDataFrame(docs, SCHEMA).repartition(5).withColumns(extra)


@pytest.fixture(scope="module")
def folder(spark, frame, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    frame.write.parquet(f"{path}/documents.parquet")
    return path


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def phrases_of(docs, longest):
    counts, total = Counter(), Counter()
    for _, text, lang, *_ in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts.update((lang, tuple(words[i : i + k])) for k in range(1, longest + 1) for i in range(len(words) - k + 1))
    return counts, total


def collocations_of(docs, least, longest, top):
    counts, total = phrases_of(docs, longest)
    frequent = {p: f for p, f in counts.items() if f >= least}
    covered = {(lang, w[i : i + k]) for (lang, w), f in frequent.items() for k in range(2, len(w)) for i in range(len(w) - k + 1) if frequent[lang, w[i : i + k]] <= f}
    out = defaultdict(list)
    for (lang, w), a in frequent.items():
        if len(w) > 1 and (lang, w) not in covered:
            cuts = [(1000 * a * total[lang] // (counts[lang, w[:j]] * counts[lang, w[j:]]), j) for j in range(1, len(w))]
            score, j = min(cuts)
            out[lang].append((-score, -a, " ".join(w).encode(), counts[lang, w[:j]], counts[lang, w[j:]]))
    return [(lang, i, p.decode(), -a, left, right, total[lang], -s) for lang, own in out.items() for i, (s, a, p, left, right) in enumerate(sorted(own)[:top], 1)]


@pytest.mark.parametrize(("least", "longest", "top", "share"), [(3, 5, 2000, 8), (10, 3, 7, 2), (2, 5, 40, 10_000), (100, 5, 2000, 1)])
def test_collocations(frame, docs, least, longest, top, share):
    """Also where the sample is empty, so that all is left to the expansion, or holds all."""
    found = collocations.collocations(frame, least, longest, top, share).drop("k").collect()
    assert sorted(map(tuple, found)) == sorted(collocations_of(docs, least, longest, top))


def test_collocations_when_tasks_hold_few_keys(frame, docs, monkeypatch):
    """Sums are sent packed, many times and to many parts; and keys of a pass are a few bytes each."""
    monkeypatch.setattr(collocations, "HELD_KEYS", 50)
    monkeypatch.setattr(collocations, "PART_BYTES", 512)
    found = collocations.collocations(frame, 2).drop("k").collect()
    assert sorted(map(tuple, found)) == sorted(collocations_of(docs, 2, 5, 2000))


def test_collocations_with_a_crowded_map(frame, docs, monkeypatch):
    """Chance bits make passes count more, never other results."""
    monkeypatch.setattr(collocations, "LEAST_MAP_BITS", 16)
    monkeypatch.setattr(collocations, "MOST_MAP_BITS", 16)
    monkeypatch.setattr(collocations, "_bits", lambda count: 16)
    found = collocations.collocations(frame, 2).drop("k").collect()
    assert sorted(map(tuple, found)) == sorted(collocations_of(docs, 2, 5, 2000))


def test_op11(spark, folder, docs, empty):
    found = queries.QUERIES["op11_collocations"](spark, folder).collect()
    assert sorted(map(tuple, found)) == sorted(collocations_of(docs, 100, 5, 2000)) and found
    assert collocations.collocations(empty).count() == 0


def test_scores_beyond_64_bits(spark):
    """Products of counts are decimals of 38 digits."""
    row = spark.sql("SELECT (CAST(3e12 AS DECIMAL(18,0)) * CAST(9e12 AS DECIMAL(18,0)) * CAST(1000 AS DECIMAL(4,0))) div (CAST(4e12 AS DECIMAL(18,0)) * CAST(5e12 AS DECIMAL(18,0))) AS s").first()
    assert row.s == 3 * 9 * 1000 // 20


def shards_by_hand(docs, shards, measure="rows", slack=0.01):
    """Round by round, in lists."""
    places, owners = sharding.ring(shards)
    weight = {d: 1 if measure == "rows" else len((docs[d][1] or "").encode()) + 8 for d in range(len(docs))}
    total = sum(weight.values())
    if measure == "rows":
        room = {s: total // shards + (s < total % shards) for s in range(shards)}
    else:
        room = dict.fromkeys(range(shards), -(-total // shards) + max(int(slack * -(-total // shards)), max(weight.values())))
    hashes = [hashlib.sha256(f"42:{'' if d[0] is None else d[0]}".encode()).hexdigest()[:12] for d in docs]
    home = [next((k for k, p in enumerate(places) if p >= h), 0) for h in hashes]
    full, waiting, where = {s for s in room if room[s] == 0}, list(range(len(docs))), {}
    while waiting:
        asked = defaultdict(list)
        for d in waiting:
            k = home[d]
            while owners[k] in full:
                k = (k + 1) % len(owners)
            asked[owners[k]].append(d)
        waiting = []
        for s, own in asked.items():
            for i, d in enumerate(sorted(own, key=lambda d: hashes[d])):
                if weight[d] > room[s]:
                    full.add(s)
                    waiting += sorted(own, key=lambda d: hashes[d])[i:]
                    break
                room[s] -= weight[d]
                where[d] = s
        full |= {s for s in room if room[s] == 0}
    return where


@pytest.mark.parametrize(("shards", "measure", "few"), [(24, "rows", 2048), (7, "rows", 1), (5, "bytes", 2048), (3, "bytes", 0), (400, "rows", 3)])
def test_shards(frame, docs, monkeypatch, shards, measure, few):
    monkeypatch.setattr(sharding, "FEW_ROWS", few)
    own, row = rows.numbered(frame)
    found = sharding.assign(own, row, shards=shards, measure=measure).collect()
    assert len(found) == len(docs)
    if measure == "rows":
        sizes = Counter(r.shard for r in found)
        assert max(sizes.values()) - min(sizes[s] for s in range(shards)) <= 1
    want = shards_by_hand(docs, shards, measure)
    single = Counter(d[0] for d in docs)  # rows of one id are told apart by their texts and numbers
    assert {r.doc_id: r.shard for r in found if single[r.doc_id] == 1} == {docs[d][0]: s for d, s in want.items() if single[docs[d][0]] == 1}
    assert Counter(r.shard for r in found) == Counter(want.values())
    for s in {r.shard for r in found}:
        assert sorted(r.slot for r in found if r.shard == s) == list(range(sum(r.shard == s for r in found)))


def test_op12(spark, folder, docs, empty):
    found = queries.QUERIES["op12_sharding"](spark, folder).collect()
    text = lambda t: (t or "").encode()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter((d, len(text(t)) + 8, zlib.crc32(text(t))) for d, t, *_ in docs)
    assert {(r.law, r.grown_shard) for r in found} == {("rows", None)}
    again = queries.QUERIES["op12_sharding"](spark, folder).collect()
    assert sorted(map(str, found)) == sorted(map(str, again))
    own, row = rows.numbered(empty)
    assert sharding.assign(own, row).count() == 0


def test_a_hot_id_fills_shard_after_shard(spark):
    """A third of all rows has no id, half of these no text either; all alike but for their numbers."""
    frame = spark.range(3000).selectExpr("if(id % 3 = 0, null, id) AS doc_id", "if(id % 6 = 0, null, 'text') AS text")
    own, row = rows.numbered(frame)
    sizes = Counter(r.shard for r in sharding.assign(own, row).select("shard").collect())
    assert set(sizes.values()) == {125}


def test_a_new_shard_moves_few_rows(spark):
    own, row = rows.numbered(spark.range(20_000).selectExpr("id AS doc_id", "'t' AS text"))
    before, after = (sharding.assign(own, row, shards=n).select("doc_id", F.col("shard").alias(f"s{n}")) for n in (24, 25))
    moved = before.join(after, "doc_id").filter("s24 <> s25").count()
    assert 20_000 / 25 <= moved < 3 * 20_000 / 25


def test_shards_as_files(spark, frame, docs, tmp_path):
    path = f"{tmp_path}/shards"
    sharding.write_shards(frame, path, shards=4)
    back = spark.read.parquet(path)
    assert {"shard", "shard_", "slot", "_ROW"} <= set(back.columns)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((d, t) for d, t, *_ in docs)
    assert set(Counter(r.shard_ for r in back.collect()).values()) <= {len(docs) // 4, len(docs) // 4 + 1}


def middle_by_hand(doc, text, unit, seed=42, percent=50, spm=80):
    text = text or ""
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text) if unit == "word" else list(text)
    h = hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(units)
    low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= percent:
        return n, "plain", None, None, text
    if h4 % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


@pytest.mark.parametrize(("unit", "seed", "percent"), [("word", 42, 50), ("char", 1, 100), ("word", 7, 100)])
def test_fill_in_middle(frame, docs, empty, unit, seed, percent):
    made = fill_middle.fill_in_middle(frame, unit=unit, seed=seed, percent=percent).withColumn("back", fill_middle.restored("form", "output"))
    found = made.collect()
    want = Counter((d, *middle_by_hand(d, t, unit, seed, percent)) for d, t, *_ in docs)
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in found) == want
    assert Counter(r.back for r in found) == Counter(t or "" for _, t, *_ in docs)
    assert {"plain", "spm", "psm"} == {r.form for r in found}
    assert fill_middle.fill_in_middle(empty).count() == 0


def test_op13(spark, folder, docs):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = Counter()
    for d, t, *_ in docs:
        *head, output = middle_by_hand(d, t, "word")
        want[(d, *head, sha(output), sha(t or ""))] += 1
    found = queries.QUERIES["op13_fill_middle"](spark, folder).collect()
    assert Counter((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in found) == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_exception_index(text):
    """Every code point and every byte at which one begins, both ways; ASCII has no entries."""
    index = fill_middle.ExceptionIndex(np.frombuffer(text.encode(), np.uint8))
    starts = np.array([len(text[:k].encode()) for k in range(len(text) + 1)])
    assert (index.byte_of(np.arange(len(text) + 1)) == starts).all()
    assert (index.char_of(starts) == np.arange(len(text) + 1)).all()
    assert len(index.chars) == sum(ord(c) > 127 for c in text)


@pytest.mark.parametrize("words", [16 << 20, 4096 << 20, 3 * 10**12 // 2])
def test_rows_of_counts_keep_their_length(words):
    """Keys in a row from a block to a part, and so bytes a key: no fewer for 4,096 parts' worth of words than for 16."""
    grown = counts.growth(words)
    parts = max(1, words / (counts.PART_WORDS * grown))
    assert counts.BLOCK_BYTES * grown / counts.WORD_SIZE / parts >= 60


def test_parts_summed_in_ranges(monkeypatch):
    rng = np.random.default_rng(2)
    blocks = [np.sort(rng.choice(np.uint64(5000) * np.arange(1, 4000, dtype=np.uint64), int(n), replace=False)) for n in (3000, 1, 2500, 700)]
    times = [rng.integers(1, 9, len(b)).astype("<u8") for b in blocks]
    table = pa.table({
        "part": [0] * 4, "n": [1] * 4, "block": [5, 6, 7, 8], "keys": [squeezed(np.diff(b, prepend=np.uint64(0))) for b in blocks],
        "counts": [squeezed(t) for t in times],
    })
    want = Counter()
    for b, t in zip(blocks, times, strict=True):
        want.update(dict(zip(b.tolist(), t.tolist(), strict=True)))
    for most in (1 << 22, 1000, 7):
        monkeypatch.setattr(counts, "SORTED_KEYS", most)
        found = counts._answer(table)
        for b, raw in zip(blocks, found.column("totals").to_pylist(), strict=True):
            assert unsqueezed(raw).tolist() == [want[x] for x in b.tolist()]


@pytest.mark.parametrize("rows", [512, 3])
def test_packed_pairs_of_crowded_tokens(spark, monkeypatch, rows):
    """Cells hold each pair of different classes that shares a token, however a crowded token is dealt, by the homes of its texts."""
    monkeypatch.setattr(near_dedup, "TOKEN_ROWS", rows)
    monkeypatch.setattr(near_dedup, "HELD_PAIRS", 50)
    rng = np.random.default_rng(4)
    nodes = [(int(n), int(n) % 9, int(t)) for n in range(60) for t in {0, *rng.choice(20, 3)}]
    columns = "node long, comp long, home long, token long, r1 float, w1 float, r2 float, w2 float"
    frame = spark.createDataFrame([(n, c, -(n % 4), t, 10.0, 10.0, 10.0, 10.0) for n, c, t in nodes], columns)
    found = set()
    for r in near_dedup._close_pairs(frame, 0.8).collect():
        own = {tuple(p) for p in unsqueezed(r.pairs).reshape(-1, 2).tolist()}
        assert {(max(-(a % 4), -(b % 4)), min(-(a % 4), -(b % 4))) for a, b in own} == {(r.ca, r.cb)}
        found |= own
    assert found == {(a, b) for a, c, t in nodes for b, d, u in nodes if a > b and c != d and t == u}


def test_homes_of_texts_of_one_body(spark):
    """Texts of one large bucket fill few homes, and every text has one, of ``CELL_ROWS`` texts or not many more."""
    entries = [(b, n, n) for n in range(400) for b in (1, 2 + n % 2)] + [(50 + n // 2, n, n) for n in range(400, 440)]
    apart = near_dedup._apart(spark.createDataFrame(entries, "band long, node long, x long").drop("x"), spark.createDataFrame([], "node long, comp long"))
    found = near_dedup._homes(apart).collect()
    assert sorted(r.node for r in found) == list(range(440)) and all(r.comp == r.node for r in found)
    sizes = Counter(r.home for r in found)
    assert len({r.home for r in found if r.node < 400}) <= -(-400 // near_dedup.CELL_ROWS)
    assert max(sizes.values()) < 2 * near_dedup.CELL_ROWS and len({r.home for r in found if r.node >= 400}) == 20
