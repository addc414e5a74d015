"""Near-duplicate vectors by randomised-rotation binary codes.

A unit vector is rotated at random and each coordinate's sign is kept, with the factor <code, vector> that makes
<code, q> / factor an unbiased estimate of <vector, q>. Bands of code bits bring similar vectors together; within a
cell the estimate plus its confidence bound decides which pairs are recomputed exactly, in double precision. The width of
a band follows the size of the largest label and the number of bands the chance of a miss that is allowed, so cells stay
small however many vectors there are.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import components
from tidebook.llm.grouped import runs
from tidebook.llm.scratch import stored

#: Chance that a pair right at the threshold shares no band, and width of the confidence bound in units of its scale:
#: an estimate is further off with a chance of about 2 exp(-BOUND^2 / 2).
MISS, BOUND = 1e-6, 6.0
#: Bits of a band beyond those that number the largest label's vectors; vectors on a side of a block; pairs compared at once.
SPARE_BITS, BLOCK, PAIRS = 2, 128, 1 << 16


@dataclass(frozen=True)
class Bands:
    """Number of bands and bits of each."""

    count: int
    bits: int

    @staticmethod
    def of(largest: int, cosine: float) -> Bands:
        bits = min(40, max(8, math.ceil(math.log2(max(largest, 2))) + SPARE_BITS))
        kept = (1 - math.acos(cosine) / math.pi) ** bits
        return Bands(math.ceil(math.log(MISS) / math.log1p(-kept)), bits)


@functools.lru_cache(maxsize=8)
def rotations(width: int, bits: int) -> np.ndarray:
    """Random orthogonal matrices side by side, enough for so many bits: width x (a multiple of width)."""
    draw = np.random.default_rng((width, 2024))
    found = []
    for _ in range(-(-bits // width)):
        q, r = np.linalg.qr(draw.standard_normal((width, width)))
        found.append(q * np.sign(np.diag(r)))
    return np.concatenate(found, axis=1)


def unit_rows(flat: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors in double precision, and which rows have one: finite throughout and not zero."""
    rows = flat.reshape(-1, width).astype(np.float64) if width else np.zeros((0, 0))
    with np.errstate(all="ignore"):
        largest = np.abs(rows).max(1, initial=0)
        good = np.isfinite(rows).all(1) & (largest > 0)
        scaled = rows / np.where(good, largest, 1)[:, None]  # so that no square leaves the range of numbers
        return scaled / np.sqrt((scaled**2).sum(1))[:, None], good


def keys(units: np.ndarray, bands: Bands) -> np.ndarray:
    """Number of each vector in each band."""
    turned = units @ rotations(units.shape[1], bands.count * bands.bits)
    bits = (turned[:, : bands.count * bands.bits] >= 0).reshape(len(units), bands.count, bands.bits)
    return bits @ (1 << np.arange(bands.bits, dtype=np.int64))


def cells(vectors: DataFrame, bands: Bands) -> DataFrame:
    """(row, label, width, band, key) of every vector that can have links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            widths = batch.column("width").to_numpy()
            for width in np.unique(widths):
                some = batch.filter(pa.array(widths == width))
                units, good = unit_rows(some.column("vector").flatten().to_numpy(), int(width))
                if not good.any():
                    continue
                rows, labels = some.column("row").to_numpy()[good], some.column("label").filter(pa.array(good))
                found = keys(units[good], bands)
                for band in range(bands.count):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows), labels, pa.array(np.full(len(rows), width, np.int32)), pa.array(np.full(len(rows), band, np.int32)), pa.array(found[:, band])], ["row", "label", "width", "band", "key"]
                    )

    kind = vectors.schema["label"].dataType.simpleString()
    return vectors.mapInArrow(run, f"row long, label {kind}, width int, band int, key long")


def compared(blocks: DataFrame, bands: Bands, cosine: float) -> DataFrame:
    """(row, links, least): links found in one block for the first time, and the least row reached by them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cuts in runs(batches, "block"):
            widths = table.column("width").to_numpy()
            for width in np.unique(widths):
                yield from block_links(table, cuts, int(width), bands, cosine)

    return blocks.repartition("block").sortWithinPartitions("block").mapInArrow(run, "row long, links long, least long")


def pairs_of(cuts: np.ndarray, side: np.ndarray, other: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in each group: all of one side where both sides are one block, else across the sides."""
    left, right, n = [], [], 0
    for lo, hi in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if hi - lo < 2:
            continue
        if side[lo] == other[lo]:
            i, j = np.triu_indices(hi - lo, 1)
            i, j = i + lo, j + lo
        else:
            one = side[lo:hi] < other[lo:hi]
            a, b = np.flatnonzero(one) + lo, np.flatnonzero(~one) + lo
            i, j = np.repeat(a, len(b)), np.tile(b, len(a))
        left.append(i)
        right.append(j)
        n += len(i)
        if n >= PAIRS:
            yield np.concatenate(left), np.concatenate(right)
            left, right, n = [], [], 0
    if n:
        yield np.concatenate(left), np.concatenate(right)


def block_links(table: pa.Table, cuts: np.ndarray, width: int, bands: Bands, cosine: float) -> Iterator[pa.RecordBatch]:
    mine = np.flatnonzero(table.column("width").to_numpy() == width)
    some = table.take(pa.array(mine)).combine_chunks()
    own_cuts = np.unique(np.searchsorted(mine, cuts))
    units, _ = unit_rows(some.column("vector").combine_chunks().flatten().to_numpy(), width)
    numbers, band, rows = keys(units, bands), some.column("band").to_numpy(), some.column("row").to_numpy()
    turned = (units @ rotations(width, width)[:, :width]).astype(np.float32)
    codes = np.where(turned >= 0, np.float32(1), np.float32(-1)) / np.float32(math.sqrt(width))
    factors = np.einsum("ij,ij->i", codes, turned)
    slack = BOUND * np.sqrt(np.maximum(1 - factors**2, 0)) / factors / math.sqrt(max(width - 1, 1)) + 1e-4
    for i, j in pairs_of(own_cuts, some.column("side").to_numpy(), some.column("other").to_numpy()):
        near = np.zeros(len(i), bool)
        for lo in range(0, len(i), PAIRS):
            a, b = i[lo : lo + PAIRS], j[lo : lo + PAIRS]
            guess = np.einsum("ij,ij->i", codes[a], turned[b]) / factors[a]
            maybe = np.flatnonzero(guess + slack[a] >= cosine)
            a, b = a[maybe], b[maybe]
            first = (numbers[a] == numbers[b]).argmax(1) == band[a]  # a pair counts in the first band that it shares
            near[lo + maybe] = first & (np.einsum("ij,ij->i", units[a], units[b]) >= cosine)
        i, j = i[near], j[near]
        if not i.size:
            continue
        at, ends = np.unique(np.concatenate([i, j]), return_inverse=True)
        a, b = ends[: len(i)], ends[len(i) :]
        least = rows[at].copy()
        while True:
            before = least.copy()
            np.minimum.at(least, a, least[b])
            np.minimum.at(least, b, least[a])
            if np.array_equal(before, least):
                break
        yield pa.RecordBatch.from_arrays([pa.array(rows[at]), pa.array(np.bincount(ends)), pa.array(least)], ["row", "links", "least"])


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(id, n_links, component, kept) of every row. Rows link if their labels and widths are equal, no label is null and the
    cosine is at least the threshold; a pair right at it is missed with a chance of MISS.

    A vector that is null, empty, zero or holds a null, a NaN or an infinity links with nothing and is its own component.
    Rows that repeat, also under one id, are vectors of their own: they count as links. component is the least id
    reached, kept whether that is the row's own; a null id names no component unless there is no other (then null, and
    kept). Cells above BLOCK are cut into a grid of blocks; pairs never leave the task that compares them.
    """
    rows = stored(
        vectors.select(
            F.monotonically_increasing_id().alias("row"),
            F.col(id_col).alias("id"),
            F.col(label_col).alias("label"),
            F.when(~F.exists(F.col(vector_col), lambda x: x.isNull()), F.col(vector_col)).cast("array<double>").alias("vector"),
        ),
        "vectors",
    )
    able = rows.where("label IS NOT NULL AND size(vector) > 0").select("row", "label", "vector", F.size("vector").alias("width"))
    largest = able.groupBy("label", "width").count().agg(F.max("count")).first()[0] or 0
    bands = Bands.of(largest, cosine)
    cell = cells(able, bands).select("row", "band", F.xxhash64("label", "width", "band", "key").alias("cell"))
    cell = stored(cell, "cells")
    sizes = cell.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("sides"), F.count(F.lit(1)).alias("n")).where("n > 1").select("cell", "sides")
    sided = cell.join(sizes, "cell").select("row", "band", "cell", "sides", F.pmod(F.xxhash64("row"), F.col("sides")).alias("side"))
    spread = sided.select("row", "band", "cell", "side", F.explode(F.sequence(F.lit(0).cast("long"), F.col("sides") - 1)).alias("other"))
    blocks = spread.select("row", "band", "side", "other", F.xxhash64("cell", F.least("side", "other"), F.greatest("side", "other")).alias("block"))
    found = stored(compared(blocks.join(able, "row"), bands, cosine), "links")
    links = found.groupBy("row").agg(F.sum("links").alias("n_links"))
    roots = components(found.where("row != least"), "row", "least").withColumnRenamed("node", "row")
    rooted = rows.select("row", "id").join(links, "row", "left").join(roots, "row", "left").select("id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("root", "row").alias("root"))
    names = rooted.groupBy("root").agg(F.min("id").alias("component"))
    return rooted.join(names, "root").select("id", "n_links", "component", F.col("id").eqNullSafe(F.col("component")).alias("kept"))
