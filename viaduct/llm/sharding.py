"""Shards by consistent hashing with bounded loads (Karger et al. 1997; Mirrokni, Thorup and Zadimoghaddam 2018).

Each shard owns many points of a ring; a row goes to the owner of the first point at or behind its hash. A shard has a
capacity. Rows come in rounds: of those that reach a shard in a round the first in the order of their hashes stay, as
many as fit, and the others go on clockwise to the next shard that is not full, in the next round. Shards that were
full once stay full, so there are at most as many rounds as shards, and each moves only what overflowed.

Where a shard's last row lies is found without sorting its rows: sums by the next two hexadecimal digits of their order
narrow it down until few rows are left to look at. Only those sums and rows reach the driver; their number follows that
of shards. Texts are read once, for their sizes; rounds see a narrow table.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from viaduct.llm.rows import free_name, numbered
from viaduct.operators.sampling import ranked
from viaduct.session import ready, stored

SHARDS, POINTS, SEED = 24, 64, 42
#: How far above the mean a shard may go where bytes are balanced.
SLACK = 0.01
#: Hexadecimal digits of a place on the ring; rows of a shard among which the last that fits is looked for one by one.
RING_DIGITS, FEW_ROWS = 12, 2048
#: The ring is looked up by its first digits; the points of a cell are few.
CELL_DIGITS = 3


def ring(shards: int, points: int = POINTS, seed: int = SEED) -> tuple[list[str], list[int]]:
    """The points of the ring in order, as hexadecimal places, and the shards that own them."""
    own = sorted((hashlib.sha256(f"{seed}:{s}:{k}".encode()).hexdigest()[:RING_DIGITS], s) for s in range(shards) for k in range(points))
    return [p for p, _ in own], [s for _, s in own]


def next_open(owners: list[int], full: set[int]) -> list[int]:
    """For each point the shard, not full, that owns it or the first such point behind it."""
    out, near = [0] * len(owners), -1
    for k in range(2 * len(owners) - 1, -1, -1):
        if owners[k % len(owners)] not in full:
            near = owners[k % len(owners)]
        out[k % len(owners)] = near
    return out


def _on_ring(rows: DataFrame, places: list[str]) -> DataFrame:
    """``rows`` with ``point``, the number of the first point at or behind their ``place``, found in its cell."""
    size = 16**CELL_DIGITS
    cells = [[] for _ in range(size)]
    for k, place in enumerate(places):
        cells[int(place[:CELL_DIGITS], 16)].append((place, k))
    after = (places[0], 0)
    table = []
    for c in range(size - 1, -1, -1):
        table.append((f"{c:0{CELL_DIGITS}x}", [*cells[c], ("g", after[1])]))  # "g" lies behind all digits
        after = cells[c][0] if cells[c] else after
    spark = rows.sparkSession
    cells_of = spark.createDataFrame(table, "cell string, points array<struct<at: string, point: int>>")
    found = rows.withColumn("cell", F.substring("place", 1, CELL_DIGITS)).join(F.broadcast(cells_of), "cell")  # 4,096 rows
    point = F.expr(f"filter(points, p -> p.at >= substring(place, 1, {RING_DIGITS}))[0].point")
    return found.withColumn("point", point).drop("cell", "points")


def _of(values: list, at: str):
    """The value of a short list of numbers or digits that the column ``at`` names, counted from 0."""
    return F.expr(f"element_at(array({', '.join(map(repr, values))}), {at} + 1)")


def _sums(bound: DataFrame, heads: list[str], digits: int) -> dict[int, list[tuple[str, int, int]]]:
    """Of each shard the next two digits of places that begin with its head, and the weight and number of rows there."""
    some = bound.filter(F.substring("place", 1, digits) == _of(heads, "shard")) if digits else bound
    sums = some.groupBy("shard", F.substring("place", digits + 1, 2).alias("next")).agg(F.sum("weight").alias("w"), F.count(F.lit(1)).alias("n"))
    out: dict[int, list] = {}
    for r in sums.collect():  # 256 rows a shard
        out.setdefault(r["shard"], []).append((r["next"], r["w"], r["n"]))
    return out


def _last_places(bound: DataFrame, rooms: dict[int, int], sums: dict[int, list], shards: int) -> dict[int, str]:
    """Of each shard in ``rooms`` the place of the last of the rows ``bound(shard, place, weight)`` that fits, or "".

    Rows are taken in the order of places while the sum of their weights is within the room. ``sums`` are those by the
    first two digits.
    """
    open_, last, digits = {s: ("", room) for s, room in rooms.items()}, dict.fromkeys(rooms, ""), 0
    while True:
        near, narrow = {}, {}
        for s, (head, room) in open_.items():
            for two, weight, n in sorted(sums[s]):
                if weight > room:
                    (near if n <= FEW_ROWS else narrow)[s] = (head + two, room)
                    break
                room -= weight
                last[s] = head + two + "g"  # all places with these digits lie before it
        digits += 2
        if near:
            heads = [near.get(s, ("-",))[0] for s in range(shards)]  # no place begins with a bar
            held: dict[int, list] = {}
            rest = bound.filter(F.substring("place", 1, digits) == _of(heads, "shard"))
            for r in rest.select("shard", "place", "weight").collect():  # FEW_ROWS a shard
                held.setdefault(r["shard"], []).append((r["place"], r["weight"]))
            for s, (_, room) in near.items():
                for place, weight in sorted(held[s]):
                    if weight > room:
                        break
                    room -= weight
                    last[s] = place
        if not narrow:
            return last
        open_, sums = narrow, _sums(bound, [narrow.get(s, ("-",))[0] for s in range(shards)], digits)


def assign(docs: DataFrame, row: str, shards: int = SHARDS, measure: str = "rows", points: int = POINTS, slack: float = SLACK, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, row, shard and slot of each row of ``docs(doc_id, text)``, whose column ``row`` is unique.

    With ``measure="rows"`` capacities are whole shares of the rows, so counts of shards are at most one apart. With
    ``"bytes"`` a shard takes ``slack`` above its share of all sizes, or the largest size if that is more, which is what
    it needs to guarantee a place for all. The hash of a row is that of its ``doc_id``; of equal ids the hash of the text,
    then ``row`` orders, so an id that a third of all rows have fills one shard after the other. ``slot`` numbers the
    rows of a shard from 0 in that order. Null texts have no bytes, null ids are one id, an empty table stays empty.
    """
    if measure not in ("rows", "bytes"):
        raise ValueError("measure is rows or bytes")
    spark = ready(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc = F.col("doc_id").cast("long")
    place = F.concat(
        F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit(""))).cast("binary"), 256), 1, RING_DIGITS),
        *(F.lower(F.lpad(F.hex(x), 16, "0")) for x in (F.xxhash64(text), F.col(f"`{row}`"))),
    )
    size = (F.octet_length(text) + 8).cast("long")
    rows = docs.select(
        doc.alias("doc_id"), size.alias("size"), F.crc32(text.cast("binary")).cast("long").alias("text_crc32"), F.col(f"`{row}`").alias("row"),
        place.alias("place"), (F.lit(1).cast("long") if measure == "rows" else size).alias("weight"),
    )
    places, owners = ring(shards, points, seed)
    waiting = stored(_on_ring(rows, places), "on-ring")
    total = waiting.agg(F.coalesce(F.sum("weight"), F.lit(0)).alias("w"), F.coalesce(F.max("weight"), F.lit(0)).alias("m")).first()
    if measure == "rows":
        room = {s: total["w"] // shards + (s < total["w"] % shards) for s in range(shards)}
    else:
        share = -(-total["w"] // shards)
        room = dict.fromkeys(range(shards), share + max(int(slack * share), total["m"]))
    settled, full = [], {s for s, r in room.items() if r == 0}
    while True:
        bound = waiting.withColumn("shard", _of(next_open(owners, full), "point"))
        sums = _sums(bound, [], 0)
        demand = {s: sum(w for _, w, _ in own) for s, own in sums.items()}
        over = {s: room[s] for s, w in demand.items() if w > room[s]}
        if not over:
            settled.append(bound)
            break
        last = _last_places(bound, over, sums, shards)
        stays = F.col("place") <= _of([last.get(s, "g") for s in range(shards)], "shard")
        round_ = stored(bound.withColumn("stays", stays), "round")
        settled.append(round_.filter("stays"))
        waiting = round_.filter(~F.col("stays")).drop("shard", "stays")
        room = {s: r - min(r, demand.get(s, 0)) for s, r in room.items()}
        full |= {s for s, r in room.items() if r == 0} | set(over)
    columns = ["doc_id", "size", "text_crc32", "row", "shard", "place"]
    whole = settled[0].select(*columns)
    for part in settled[1:]:
        whole = whole.unionByName(part.select(*columns))
    return ranked(whole, ["shard"], "place", name="slot").withColumn("slot", F.col("slot") - 1).drop("place")


def write_shards(docs: DataFrame, path: str, **how) -> None:
    """Write the rows of ``docs``, with all their columns, as Parquet below ``path``/shard=..., each in the order of slots.

    ``how`` is as in ``assign``; columns of ``docs`` that are called shard or slot keep their names, the new ones get a
    bar behind theirs. Files are cut by ranges of slots, so no task writes a whole shard of any size.
    """
    own, row = numbered(docs)
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    found = assign(own, row, **how).select(F.col("row").alias(row), F.col("shard").alias(shard), F.col("slot").alias(slot))
    dealt = own.join(found, row).drop(row).repartitionByRange(shard, slot).sortWithinPartitions(shard, slot)
    dealt.write.partitionBy(shard).parquet(path)


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shards of all ``documents``: counts at most one apart."""
    own, row = numbered(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return assign(own, row).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
