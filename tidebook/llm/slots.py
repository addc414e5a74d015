"""Shards through fixed virtual slots: rows hash into slots, bytes are summed per slot, a versioned map says which shard
holds a slot, and rebalancing edits the map instead of hashing anew.

A row's slot comes from its text, so equal texts stay together. Each slot has a fixed number of cells, dealt by id;
a slot that holds more than a whole shard's share is placed cell by cell. All that reaches the driver is one row per
cell, at most slots x cells rows whatever the input.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 4096
CELLS = 32


@dataclass(frozen=True)
class SlotMap:
    """Version, number of shards and the shard of each (slot, cell)."""

    version: int
    shards: int
    shard_of: dict[tuple[int, int], int]

    def loads(self, size_of: dict[tuple[int, int], int]) -> list[int]:
        loads = [0] * self.shards
        for cell, shard in self.shard_of.items():
            loads[shard] += size_of.get(cell, 0)
        return loads


def slot_columns(id_col: Column, text_col: Column, slots: int = SLOTS, cells: int = CELLS) -> tuple[Column, Column]:
    """Slot by text (a null text counts as empty), cell by id."""
    return (
        F.pmod(F.xxhash64(F.coalesce(text_col, F.lit(""))), F.lit(slots)).cast("int"),
        F.pmod(F.xxhash64(id_col, F.lit("cell")), F.lit(cells)).cast("int"),
    )


def sized(docs: DataFrame, id_col: str, text_col: str, slots: int = SLOTS, cells: int = CELLS) -> DataFrame:
    """id, size (UTF-8 bytes, a null text none, plus 1), CRC-32 of the text (null: of no bytes), slot and cell."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    slot, cell = slot_columns(F.col(id_col), F.col(text_col), slots, cells)
    return docs.select(
        F.col(id_col).alias("id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("crc"),
        slot.alias("slot"),
        cell.alias("cell"),
    )


def cell_sizes(rows: DataFrame) -> list[tuple[int, int, int, int]]:
    """(slot, cell, bytes, rows) of every cell in use, in order; bounded by slots x cells."""
    table = rows.groupBy("slot", "cell").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    return sorted((r.slot, r.cell, r.bytes, r.n) for r in table.collect())


def units(size_of: dict[tuple[int, int], int], shards: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """What is placed as one: a slot, or a single cell of a slot above one shard's share; largest first."""
    share = sum(size_of.values()) / shards
    by_slot: dict[int, list[tuple[int, int]]] = {}
    for cell in sorted(size_of):
        by_slot.setdefault(cell[0], []).append(cell)
    found = []
    for group in by_slot.values():
        size = sum(size_of[c] for c in group)
        found += [(size_of[c], [c]) for c in group] if size > share else [(size, group)]
    return sorted(found, key=lambda u: (-u[0], u[1]))


def balanced_map(size_of: dict[tuple[int, int], int], shards: int) -> SlotMap:
    """First version: each unit, largest first, to the shard that holds least."""
    shard_of, loads = {}, [(0, s) for s in range(shards)]
    for size, group in units(size_of, shards):
        load, shard = heapq.heappop(loads)
        shard_of.update(dict.fromkeys(group, shard))
        heapq.heappush(loads, (load + size, shard))
    return SlotMap(1, shards, shard_of)


def rebalanced(old: SlotMap, size_of: dict[tuple[int, int], int], shards: int | None = None, slack: float = 0.02) -> SlotMap:
    """Next version: moves units from the fullest to the emptiest shard until none is above (1 + slack) x the mean or no
    move helps. Shards may be added; a shard only gives while it is above the mean, so most cells stay where they are.
    Cells the old map doesn't know go to the emptiest shard first."""
    shards = shards or old.shards
    if shards < old.shards:
        raise ValueError("a map can't lose shards; move their slots first")
    shard_of, loads, held = dict(old.shard_of), [0] * shards, [[] for _ in range(shards)]
    mean = sum(size_of.values()) / shards
    late = []
    for size, group in units(size_of, shards):
        homes = {shard_of[c] for c in group if c in shard_of}
        if len(homes) == 1:
            home = homes.pop()
            shard_of.update(dict.fromkeys(group, home))
            loads[home] += size
            held[home].append((size, group))
        elif homes:
            for c in group:  # a slot that an earlier map took apart stays apart
                home = shard_of.get(c, min(homes))
                shard_of[c] = home
                loads[home] += size_of[c]
                held[home].append((size_of[c], [c]))
        else:
            late.append((size, group))
    for size, group in late:
        home = min(range(shards), key=lambda s: (loads[s], s))
        shard_of.update(dict.fromkeys(group, home))
        loads[home] += size
        held[home].append((size, group))
    while True:
        full, empty = max(range(shards), key=lambda s: (loads[s], -s)), min(range(shards), key=lambda s: (loads[s], s))
        gap = loads[full] - loads[empty]
        fits = [u for u in held[full] if 0 < u[0] < gap]
        if loads[full] <= mean * (1 + slack) or not fits:
            return SlotMap(old.version + 1, shards, shard_of)
        best = min(fits, key=lambda u: (abs(u[0] - gap / 2), u[1]))
        held[full].remove(best)
        held[empty].append(best)
        loads[full] -= best[0]
        loads[empty] += best[0]
        shard_of.update(dict.fromkeys(best[1], empty))


def save_map(spark: SparkSession, slot_map: SlotMap, folder: str) -> None:
    """Adds one version beside the earlier ones; an existing version is never overwritten."""
    rows = [(s, c, shard) for (s, c), shard in sorted(slot_map.shard_of.items())]
    table = spark.createDataFrame(rows, "slot int, cell int, shard int").withColumn("shards", F.lit(slot_map.shards))
    table.coalesce(1).write.mode("error").parquet(f"{folder.rstrip('/')}/version={slot_map.version}")


def load_map(spark: SparkSession, folder: str, version: int | None = None) -> SlotMap:
    table = spark.read.parquet(folder)
    version = version or table.agg(F.max("version")).first()[0]
    rows = table.where(F.col("version") == version).collect()
    return SlotMap(version, rows[0].shards if rows else 0, {(r.slot, r.cell): r.shard for r in rows})


def placed(rows: DataFrame, cells: list[tuple[int, int, int, int]], slot_map: SlotMap) -> DataFrame:
    """Adds shard and the row's place in its shard, gapless from 0: the cells of a shard follow one another, so a place
    is the cell's first place plus the row's number within the cell. No window is larger than a cell."""
    spark, first, used = rows.sparkSession, [0] * slot_map.shards, []
    for slot, cell, _, n in cells:
        shard = slot_map.shard_of[slot, cell]
        used.append((slot, cell, shard, first[shard]))
        first[shard] += n
    table = spark.createDataFrame(used, "slot int, cell int, shard int, start long")
    from pyspark.sql import Window

    within = F.row_number().over(Window.partitionBy("slot", "cell").orderBy("id", "size", "crc"))
    # at most slots x cells rows of 20 bytes, whatever the input
    return rows.withColumn("nth", within).join(F.broadcast(table), ["slot", "cell"]).withColumn("place", F.col("start") + F.col("nth") - 1).drop("start", "nth")


def shard_rows(
    docs: DataFrame, shards: int = 16, id_col: str = "doc_id", text_col: str = "text", map_folder: str | None = None, slots: int = SLOTS, cells: int = CELLS
) -> DataFrame:
    """id, size, crc, slot, cell, shard and place of every row, under the latest map in map_folder (edited where that map
    has become uneven) or, without one, a first balanced map, which is then stored there.

    Null ids are ordinary ids; rows that repeat are placed one by one. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    rows = sized(docs, id_col, text_col, slots, cells)
    table = cell_sizes(rows)
    size_of = {(s, c): b for s, c, b, _ in table}
    slot_map = balanced_map(size_of, shards)
    if map_folder:
        try:
            old = load_map(spark, map_folder)
        except Exception as missing:
            if "PATH_NOT_FOUND" not in str(missing):
                raise
        else:
            slot_map = rebalanced(old, size_of, max(shards, old.shards))
        save_map(spark, slot_map, map_folder)
    return placed(rows, table, slot_map)


def grown(old: SlotMap, size_of: dict[tuple[int, int], int]) -> SlotMap:
    """One more shard, filled from the others by whole units."""
    return replace(rebalanced(old, size_of, old.shards + 1), version=old.version + 1)
