"""SimHash near copies by the generalised pigeonhole principle.

The 64 bits are grouped so that correlated bits fall into one partition. If thresholds e_i satisfy
sum(e_i + 1) = max_bits + 1, two fingerprints within max_bits differ by at most e_i bits in some partition i. Each
fingerprint gets its own thresholds: a dynamic programme over the partitions picks those with the least estimated number
of candidates and probes, so a partition in which it shares a crowded value is left out (e_i = -1). Probes meet the
indexed values in a hash-partitioned table, crowded cells are cut into blocks, and every candidate is verified.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import components
from tidebook.llm.grouped import least_linked, runs
from tidebook.llm.scratch import stored

BITS = 64
#: Shingle hashes whose bits are counted at once.
STEP = 1 << 15
#: Fingerprints on a side of a block of a crowded cell.
BLOCK = 256
#: What writing and shuffling one probe costs, in comparisons of two fingerprints.
PROBE_COST = 64


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """A-Z in lower case, words parted by ASCII white space, every shingle with its repeats; a bit is set if it is in over
    half of the hashes. Fewer words than a shingle: the whole sequence; none: zero."""
    found = text.lower().split()
    if not found:
        return 0
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    flat = b" ".join(found)
    n = max(1, len(found) - words + 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[min(words, len(found)) - 1 :].tolist()
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for at in range(0, n, STEP):
        hashes = np.array([hashed(flat[a:b], seed) for a, b in zip(starts[at : at + STEP], stops[at : at + STEP], strict=True)], np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, BITS)
        counts += bits.sum(0, dtype=np.uint16 if len(hashes) < 1 << 16 else np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """(id, fp) of every row; a null text counts as empty. fp is the fingerprint as a signed 64-bit number."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.fromiter((fingerprint(t.as_py(), words) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(prints.view(np.int64))], ["id", "fp"])

    return rows.mapInArrow(run, f"id {kind}, fp long")


def bit_counts(prints: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and how many have bits i and j both set; 64 rows leave each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((BITS, BITS)), 0
        for batch in batches:
            bits = np.unpackbits(batch.column("fp").to_numpy().view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
            both += bits.T @ bits
            n += len(bits)
        rows = both.astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(BITS), pa.int32()), pa.array([n] * BITS), pa.array(rows.tolist(), pa.list_(pa.int64()))], ["i", "n", "both"])

    parts = prints.select("fp").mapInArrow(run, "i int, n long, both array<long>")
    sums = parts.groupBy("i").agg(F.sum("n").alias("n"), *[F.sum(F.col("both")[j]).alias(f"b{j}") for j in range(BITS)]).collect()
    both = np.zeros((BITS, BITS))
    for row in sums:
        both[row.i] = row[2:]
    return (sums[0].n if sums else 0), both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Partitions of near-equal size: each starts with the bit left that is set most evenly and takes the bits most
    correlated with those it has."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    related = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    left, found = set(range(BITS)), []
    for k in range(parts):
        size = (BITS - sum(map(len, found))) // (parts - k)
        group = [max(left, key=lambda b: (spread[b], -b))]
        left.remove(group[0])
        while len(group) < size:
            best = max(left, key=lambda b: (related[b, group].mean(), -b))
            group.append(best)
            left.remove(best)
        found.append(sorted(group))
    return found


def shared_chance(p: np.ndarray, bits: list[int], most: int) -> list[float]:
    """Chance that two fingerprints differ in exactly 0, 1 … most of the bits, the bits taken as independent."""
    chance = [1.0] + [0.0] * most
    for b in bits:
        same = p[b] ** 2 + (1 - p[b]) ** 2
        chance = [chance[e] * same + (chance[e - 1] * (1 - same) if e else 0) for e in range(most + 1)]
    return chance


def allocate(costs: np.ndarray, max_bits: int) -> np.ndarray:
    """Thresholds -1 … max_bits of each fingerprint: costs[f, i, e + 1] is what threshold e costs in partition i. The sum
    of e + 1 over the partitions is max_bits + 1; among equal sums of costs the first found stays."""
    n, parts, _ = costs.shape
    best = np.full((n, max_bits + 2), np.inf)
    best[:, 0] = 0
    picks = np.zeros((parts, n, max_bits + 2), np.int8)
    for i in range(parts):
        after = np.full_like(best, np.inf)
        for used in range(max_bits + 2):
            for e in range(used + 1):
                cost = best[:, used - e] + costs[:, i, e]
                better = cost < after[:, used]
                after[better, used] = cost[better]
                picks[i, better, used] = e
        best = after
    chosen, used = np.zeros((n, parts), np.int8), np.full(n, max_bits + 1)
    for i in range(parts - 1, -1, -1):
        chosen[:, i] = picks[i, np.arange(n), used]
        used = used - chosen[:, i]
    return chosen - 1


class Plan:
    """Partitions of the bits for n fingerprints, and what thresholds cost on average."""

    def __init__(self, n: int, both: np.ndarray, max_bits: int, parts: int):
        self.max_bits, self.bits = max_bits, grouped_bits(n, both, parts)
        p = np.diag(both) / max(n, 1)
        self.probes = np.array([[sum(math.comb(len(b), k) for k in range(e + 1)) for e in range(-1, max_bits + 1)] for b in self.bits], float)
        chance = np.array([np.cumsum([0.0, *shared_chance(p, b, max_bits)]) for b in self.bits])
        self.expected = n * chance
        self.base = self.probes * PROBE_COST + self.expected

    def cost(self) -> float:
        e = allocate(self.base[None], self.max_bits)[0]
        return float(sum(self.base[i, t + 1] for i, t in enumerate(e)))

    def values(self, prints: np.ndarray, i: int) -> np.ndarray:
        return reduce(np.bitwise_or, (((prints >> np.uint64(b)) & np.uint64(1)) << np.uint64(k) for k, b in enumerate(self.bits[i])))

    def flips(self, i: int, e: int) -> np.ndarray:
        """What a value is combined with to get every value within e bits of it, itself first."""
        width = len(self.bits[i])
        return np.array([sum(1 << b for b in bits) for k in range(e + 1) for bits in combinations(range(width), k)], np.uint64)


def plan_for(prints: DataFrame, max_bits: int) -> Plan:
    n, both = bit_counts(prints)
    return min((Plan(n, both, max_bits, parts) for parts in range(2, max_bits + 3)), key=Plan.cost)


def close_pairs(prints: DataFrame, max_bits: int) -> DataFrame:
    """(a, b): links between different fingerprints at max_bits or fewer, reduced inside each block to links with the
    least fingerprint reached there. prints has one column fp without repeats."""
    plan = plan_for(prints, max_bits)
    parts = len(plan.bits)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy()
            for i in range(parts):
                yield pa.RecordBatch.from_arrays([batch.column("fp"), pa.array(np.full(len(fp), i, np.int32)), pa.array(plan.values(fp.view(np.uint64), i).view(np.int64))], ["fp", "part", "value"])

    indexed = stored(prints.select("fp").mapInArrow(index, "fp long, part int, value long"), "indexed")
    # only values well above what chance gives say something about the cost; each holds many rows, so they are few
    usual = float(plan.expected[:, 1].mean())
    crowds = indexed.groupBy("part", "value").agg(F.count(F.lit(1)).alias("crowd")).where(F.col("crowd") > 16 + 4 * usual)
    crowded = indexed.join(crowds, ["part", "value"]).groupBy("fp").agg(F.map_from_entries(F.collect_list(F.struct("part", "crowd"))).alias("crowds"))

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = batch.column("fp").to_numpy().view(np.uint64)
            costs = np.repeat(plan.base[None], len(fp), 0)
            for f, crowds_of in enumerate(batch.column("crowds").to_pylist()):
                for i, crowd in crowds_of or ():
                    costs[f, i, 1:] += crowd
            chosen = allocate(costs, max_bits)
            for i in range(parts):
                for e in range(max_bits + 1):
                    if (mine := fp[chosen[:, i] == e]).size:
                        flips = plan.flips(i, e)
                        step = max(1, 500_000 // len(flips))
                        for at in range(0, len(mine), step):
                            part = mine[at : at + step]
                            values = (plan.values(part, i)[:, None] ^ flips[None]).ravel()
                            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(part, len(flips)).view(np.int64)), pa.array(np.full(len(values), i, np.int32)), pa.array(values.view(np.int64))], ["fp", "part", "value"])

    probes = prints.select("fp").join(crowded, "fp", "left").mapInArrow(probe, "fp long, part int, value long")
    cells = stored(
        indexed.select("fp", "part", "value", F.lit(True).alias("held"))
        .unionByName(probes.select("fp", "part", "value", F.lit(False).alias("held")))
        .select("fp", F.xxhash64("part", "value").alias("cell"), "held"),
        "cells",
    )
    return verified(cells, max_bits)


def verified(cells: DataFrame, max_bits: int) -> DataFrame:
    """Compares what is held with what is asked in every cell. A cell above BLOCK on either side becomes a grid of blocks:
    a held row goes to each column of its row of blocks, an asking one to each row of its column."""
    sizes = cells.groupBy("cell").agg(F.sum(F.col("held").cast("long")).alias("n_held"), F.sum((~F.col("held")).cast("long")).alias("n_asked"))
    used = sizes.where("n_held > 0 AND n_asked > 0 AND (n_held > 1 OR n_asked > 1)").select("cell", F.ceil(F.col("n_held") / BLOCK).alias("rows"), F.ceil(F.col("n_asked") / BLOCK).alias("cols"))
    spread = lambda n: F.pmod(F.xxhash64("fp", F.lit("block")), n)
    placed = cells.join(used, "cell").select(
        "fp",
        "held",
        "cell",
        F.explode(
            F.when(F.col("held"), F.transform(F.sequence(F.lit(0).cast("long"), F.col("cols") - 1), lambda c: F.struct(spread(F.col("rows")).alias("r"), c.alias("c")))).otherwise(
                F.transform(F.sequence(F.lit(0).cast("long"), F.col("rows") - 1), lambda r: F.struct(r.alias("r"), spread(F.col("cols")).alias("c")))
            )
        ).alias("at"),
    )
    blocks = placed.select("fp", "held", F.xxhash64("cell", "at.r", "at.c").alias("block"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches, "block"):
            fps, held = table.column("fp").to_numpy().view(np.uint64), table.column("held").to_numpy(zero_copy_only=False)
            a, b = [], []
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                if hi - lo < 2:
                    continue
                mine, asked = fps[lo:hi][held[lo:hi]], fps[lo:hi][~held[lo:hi]]
                if not mine.size or not asked.size:
                    continue
                linked = np.bitwise_count(mine[:, None] ^ asked[None]) <= max_bits
                if np.count_nonzero(linked) > np.isin(asked, mine).sum():
                    for ids, least in zip((mine, asked), least_linked(linked, mine, asked), strict=True):
                        moved = ids != least
                        a.append(ids[moved])
                        b.append(least[moved])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(compare, "a long, b long").distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, max_bits: int = 2) -> DataFrame:
    """(id, fp, component) of every row: rows whose fingerprints are linked at max_bits or fewer, directly or through
    others, share a component, named by its smallest id.

    Null and empty texts have fingerprint zero and are linked like any other. A null id never names a component; one
    that has no other id is null. Rows that share an id or a text stay rows of their own; equal fingerprints are
    searched once. An empty table gives an empty one.
    """
    prints = stored(fingerprints(docs, id_col, text_col, words), "prints")
    firsts = stored(prints.groupBy("fp").agg(F.min("id").alias("first")), "firsts")
    roots = components(close_pairs(firsts.select("fp"), max_bits), "a", "b").withColumnRenamed("node", "fp")
    rooted = firsts.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return prints.join(rooted.join(names, "root").select("fp", "component"), "fp")


def hexadecimal(fp: str) -> Column:
    """16 lower-case digits of a signed 64-bit column."""
    return F.lpad(F.lower(F.hex(F.col(fp))), 16, "0")
