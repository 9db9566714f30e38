"""Sharding (operator 12): records are hashed into fixed virtual slots, and a versioned map says which shard holds a slot.

A record's slot rests on its id and the checksum of its text and never changes; what changes is the map.  Bytes are summed
by slot, slots are packed into shards so that bytes are nearly equal, and the map is written as version 1.  When loads or
the number of shards change, ``rebalanced`` moves as few slots as it takes, and only those are written, as edits of the
next version; a reader names the version that it works with.

A slot that would be a large part of a shard (rows repeated very often) is cut into pieces, dealt by row.  A row's place
in its shard is its rank in one range sort of slim rows (id, size, checksum; no texts), so no shard is ever one task.

Results: one row per row of the table.  A null text counts no bytes and has the checksum of the empty text; null ids stay
null; rows that repeat get places of their own; no other columns are read; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right, insort
from collections import defaultdict
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import scratch, stored, table

SLOTS, SHARDS, RECORD_BYTES = 8192, 24, 8
#: A slot of more than this part of a shard's fair share is cut into pieces of about half as much.
LARGE = 0.25
MAP = "slot int, piece int, shard int, bytes long"
Place = tuple[int, int]


def record_slot(doc_id: Column, checksum: Column, slots: int = SLOTS) -> Column:
    return F.pmod(F.xxhash64(doc_id, checksum), F.lit(slots)).cast("int")


def packed(loads: Mapping[Place, int], shards: int) -> dict[Place, int]:
    """Shard of each slot: the largest slots first, each to the shard with fewest bytes so far."""
    room, out = [(0, s) for s in range(shards)], {}
    for place, size in sorted(loads.items(), key=lambda x: (-x[1], x[0])):
        held, s = heapq.heappop(room)
        out[place] = s
        heapq.heappush(room, (held + size, s))
    return out


def rebalanced(old: Mapping[Place, int], loads: Mapping[Place, int], shards: int, tolerance: float = 0.02) -> dict[Place, int]:
    """The slots that move, with their new shards: from the fullest to the emptiest shard, until they differ by ``tolerance`` of a share.

    Slots of shards that are given up, and slots that the map doesn't know, go to the emptiest shards first.
    """
    held: dict[int, list[tuple[int, Place]]] = {s: [] for s in range(shards)}
    homeless, moved = [], {}
    for place in sorted({*old, *loads}):
        size, s = loads.get(place, 0), old.get(place)
        if s is None or s >= shards:
            homeless.append((size, place))
        else:
            held[s].append((size, place))
    total = {s: sum(x[0] for x in v) for s, v in held.items()}
    for v in held.values():
        v.sort()

    def give(size: int, place: Place, s: int) -> None:
        insort(held[s], (size, place))
        total[s] += size
        moved[place] = s

    for size, place in sorted(homeless, key=lambda x: (-x[0], x[1])):
        give(size, place, min(total, key=lambda s: (total[s], s)))
    share = sum(total.values()) / shards
    while True:
        low, high = min(total, key=lambda s: (total[s], s)), max(total, key=lambda s: (total[s], -s))
        gap = total[high] - total[low]
        # The largest slot that, moved, leaves the two closer than they are: it takes up to the middle.
        at = bisect_right(held[high], (gap / 2, (1 << 62, 0))) - 1
        if gap <= tolerance * share or at < 0 or held[high][at][0] <= 0:
            return {p: s for p, s in moved.items() if old.get(p) != s}
        size, place = held[high].pop(at)
        total[high] -= size
        give(size, place, low)


def write_map(spark: SparkSession, path: str, version: int, moves: Mapping[Place, int], loads: Mapping[Place, int]) -> None:
    """The edits of a version, as one file, so that a reader sees all of them or none; a version is never written twice."""
    rows = [(*place, shard, loads.get(place, 0)) for place, shard in sorted(moves.items())]
    spark.createDataFrame(rows, MAP).coalesce(1).write.mode("error").parquet(f"{path}/version={version}")


def read_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """slot, piece, shard, version of each slot's last edit up to ``version``: as many rows as there are slots."""
    edits = spark.read.schema(f"{MAP}, version int").parquet(path)
    edits = edits if version is None else edits.where(F.col("version") <= version)
    return edits.groupBy("slot", "piece").agg(F.max_by("shard", "version").alias("shard"), F.max("version").alias("version"))


def records(docs: DataFrame, slots: int = SLOTS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, virtual_slot and a number of each row, written once."""
    text = F.coalesce(docs[f"`{text_col}`"].cast("string"), F.lit(""))
    rows = docs.select(docs[f"`{id_col}`"].cast("long").alias("doc_id"), (F.octet_length(text).cast("long") + RECORD_BYTES).alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    return stored(rows.select("*", record_slot(F.col("doc_id"), F.col("text_crc32"), slots).alias("virtual_slot"), F.monotonically_increasing_id().alias("row")), "shard-records")


def slot_loads(rows: DataFrame, shards: int = SHARDS) -> tuple[dict[Place, int], dict[int, int]]:
    """Bytes by (slot, piece), and how many pieces a large slot has: at most a row for each slot, and few slots are large."""
    whole = {r["virtual_slot"]: r["bytes"] for r in rows.groupBy("virtual_slot").agg(F.sum("size").alias("bytes")).collect()}
    part = max(1, int(sum(whole.values()) / shards * LARGE))
    pieces = {s: -(-2 * b // part) for s, b in whole.items() if b > part}
    loads = {(s, 0): b for s, b in whole.items() if s not in pieces}
    if pieces:
        large = rows.where(F.col("virtual_slot").isin(list(pieces))).select("size", "virtual_slot", piece(pieces).alias("piece"))
        loads |= {(s, k): 0 for s, n in pieces.items() for k in range(n)}
        loads |= {(r["virtual_slot"], r["piece"]): r["bytes"] for r in large.groupBy("virtual_slot", "piece").agg(F.sum("size").alias("bytes")).collect()}
    return loads, pieces


def piece(pieces: Mapping[int, int]) -> Column:
    """The piece of its slot that a row belongs to."""
    if not pieces:
        return F.lit(0)
    count = F.coalesce(F.element_at(F.create_map(*(F.lit(x) for kv in pieces.items() for x in kv)), F.col("virtual_slot")), F.lit(1))
    return F.pmod(F.xxhash64("row"), count).cast("int")


def placed(rows: DataFrame, pieces: Mapping[int, int], shard_map: DataFrame) -> DataFrame:
    """Each row with its shard and its ``slot``, the place in it: 0, 1, ... by virtual slot and id.

    One range sort over all shards; equal rows are told apart by their number, so no range has to hold many of them.
    The rows of a task are consecutive, hence a shard's first place in each task follows from a count for each pair of
    them, of which there are no more than tasks and shards together: few enough to broadcast.
    """
    mapped = rows.withColumn("piece", piece(pieces)).join(F.broadcast(shard_map.withColumnRenamed("slot", "virtual_slot")), ["virtual_slot", "piece"])
    order = ("shard", "virtual_slot", "piece", "doc_id", "size", "text_crc32", "row")
    ranked = mapped.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    ranked = stored(ranked.withColumn("task", F.shiftright("at", 33)), "shard-order")
    runs = ranked.groupBy("task", "shard").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    earlier = Window.partitionBy("shard").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("task", "shard", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return ranked.join(F.broadcast(runs), ["task", "shard"]).withColumn("slot", F.col("at") - F.col("first") + F.col("before"))


def shard(docs: DataFrame, shards: int = SHARDS, slots: int = SLOTS, map_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, virtual_slot, map_version; the map stays at ``map_path``."""
    spark = docs.sparkSession
    map_path = map_path or scratch(spark, "shard-map")
    rows = records(docs, slots, id_col, text_col)
    loads, pieces = slot_loads(rows, shards)
    write_map(spark, map_path, 1, packed(loads, shards), loads)
    return placed(rows, pieces, read_map(spark, map_path, 1)).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"),
    )


def shard_bytes(moves: Mapping[Place, int], loads: Mapping[Place, int]) -> dict[int, int]:
    """Bytes of each shard under a map."""
    out: dict[int, int] = defaultdict(int)
    for place, s in moves.items():
        out[s] += loads.get(place, 0)
    return dict(out)


def op12_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(table(spark, sf_dir, "documents"))
