"""Near copies by the Jaccard similarity of their sets of word shingles, none missed.

Two sets of similarity s or more share an element among the first n - ceil(s * n) + 1 of each, whatever the order of all
elements (prefix filter: the rest of a set is too small to hold what they must share). So every set is indexed under
those elements only, an element that a sample of texts holds often comes last in the order, and what meets is compared
in full. The first comparisons of a cell are with one member each, which joins a group of copies at the cost of its
size; only cells that still hold several groups are compared pair by pair. No text is stored but those that meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm.components import components
from tidebook.llm.scratch import stored

#: Texts in the sample that common shingles are counted in, how many of them hold a common one, and how many are kept.
#: They set the order of the elements only, so no choice loses a pair.
SAMPLE, COMMON, MOST_COMMON = 10_000, 4, 200_000
#: Rounds of comparing each member of a cell with one.
ROUNDS = 2
#: Bits of a cell by which cells of more than two rows are told from others before they are shuffled again.
CROWD_BITS = 24
#: Classes of elements that are counted for each set; sets whose counts differ by too much need no comparison in full.
CLASSES = 512
#: Bytes of texts whose sets are made at once, rows of class counts compared at once, and rows of a block of a cell.
SLICE, COMPARED, GRID = 4 << 20, 512, 256
FACTOR, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word shingles: A-Z in lower case, words parted by ASCII white space. Fewer
    words than a shingle: the whole sequence is one; so is no word at all."""
    found = text.lower().split()
    if len(found) < words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(found), 1)], np.uint64)
    each = np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found))
    n = len(found) - words + 1
    hashes = each[:n].copy()
    for k in range(1, words):
        hashes = hashes * FACTOR + each[k : k + n]
    hashes = (hashes ^ (hashes >> np.uint64(32))) * MIX
    return np.unique(hashes ^ (hashes >> np.uint64(29)))


def prefix(found: np.ndarray, common: np.ndarray, counts: np.ndarray, similarity: Fraction) -> np.ndarray:
    """The elements that a set is indexed under: those that aren't common first, then common ones by their counts."""
    n = len(found) - -(-len(found) * similarity.numerator // similarity.denominator) + 1
    at = np.minimum(np.searchsorted(common, found), max(len(common) - 1, 0))
    held = common[at] == found if len(common) else np.zeros(len(found), bool)
    if np.count_nonzero(~held) >= n:
        return found[~held][:n]
    late = found[held]
    return np.concatenate([found[~held], late[np.lexsort((late, counts[at[held]]))]])[:n]


def similar(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return similarity.denominator * both >= similarity.numerator * (len(a) + len(b) - both)


def classes(found: np.ndarray) -> np.ndarray:
    """How many elements each class has. Over all classes the differences of two sets add up to no more than the elements
    that only one of them has."""
    return np.bincount((found >> np.uint64(20)).astype(np.int64) % CLASSES, minlength=CLASSES).astype(np.int32)


def may_be_similar(a: np.ndarray, b: np.ndarray, similarity: Fraction) -> np.ndarray:
    """For rows of class counts: false only if the similarity can't be reached."""
    apart = np.abs(a - b).sum(1, dtype=np.int64)
    both = (a.sum(1, dtype=np.int64) + b.sum(1, dtype=np.int64) - apart) // 2
    return similarity.denominator * both >= similarity.numerator * (both + apart)


def common_shingles(rows: DataFrame, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(hashes in order, counts) of shingles that many texts of a sample hold; rows have a key and a text."""
    part = max(1, rows.count() // SAMPLE)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.column("text"):
                yield pa.RecordBatch.from_arrays([pa.array(shingles(t.as_py(), words).view(np.int64))], ["cell"])

    held = rows.where(F.pmod("key", F.lit(part)) == 0).select("text").mapInArrow(run, "cell long")
    most = held.groupBy("cell").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "cell").limit(MOST_COMMON).toArrow()
    cells, counts = most.column("cell").to_numpy().view(np.uint64), most.column("count").to_numpy()
    order = np.argsort(cells)
    return cells[order], counts[order]


def indexed(rows: DataFrame, words: int, common: tuple[np.ndarray, np.ndarray], similarity: Fraction, crowded: np.ndarray | None = None) -> DataFrame:
    """(cell, key, n): the elements that each text is indexed under; only those whose first bits crowded marks, if given."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                found = shingles(text.as_py(), words)
                cells = prefix(found, *common, similarity)
                if crowded is not None:
                    cells = cells[np.unpackbits(crowded[(at := (cells >> np.uint64(64 - CROWD_BITS)).astype(np.int64)) >> 3][:, None], axis=1)[np.arange(len(at)), at & 7] == 1]
                yield pa.RecordBatch.from_arrays([pa.array(cells.view(np.int64)), pa.array(np.full(len(cells), key.as_py(), np.int64)), pa.array(np.full(len(cells), len(found), np.int32))], ["cell", "key", "n"])

    return rows.select("key", "text").mapInArrow(index, "cell long, key long, n int")


def sets_of(rows: DataFrame, keys: DataFrame, words: int) -> DataFrame:
    """(key, grams, classes) of the texts with these keys, each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, grams, counts, size = [], [], [], 0
            for key, text in zip(batch.column("key"), batch.column("text"), strict=True):
                found = shingles(raw := text.as_py(), words)
                keys.append(key.as_py())
                grams.append(found.tobytes())
                counts.append(classes(found).tobytes())
                size += len(raw)
                if size >= SLICE:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())], ["key", "grams", "classes"])
                    keys, grams, counts, size = [], [], [], 0
            if keys:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(grams, pa.binary()), pa.array(counts, pa.binary())], ["key", "grams", "classes"])

    texts = rows.select("key", "text").join(keys.distinct(), "key", "left_semi").dropDuplicates(["key"])
    return stored(texts.mapInArrow(run, "key long, grams binary, classes binary"), "sets")


def verified(pairs: DataFrame, sets: DataFrame, similarity: Fraction) -> DataFrame:
    """The pairs (a, b) of keys whose sets are similar enough, compared in full where their class counts allow it."""

    def thin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, COMPARED):
                part = batch.slice(first, COMPARED)
                x, y = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.int32).reshape(-1, CLASSES) for c in ("x", "y"))
                yield part.select(["a", "b"]).filter(pa.array(may_be_similar(x, y, similarity)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = [similar(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), similarity) for x, y in zip(batch.column("x"), batch.column("y"), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    def beside(pairs: DataFrame, column: str) -> DataFrame:
        return pairs.join(sets.select(F.col("key").alias("a"), F.col(column).alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col(column).alias("y")), "b")

    pairs = stored(beside(pairs, "classes").mapInArrow(thin, "a long, b long"), "pairs")
    return beside(pairs, "grams").mapInArrow(run, "a long, b long")


def links(rows: DataFrame, words: int, similarity: Fraction) -> DataFrame:
    """(a, b): enough of the similar pairs of different keys to connect all that similar pairs connect."""
    common = common_shingles(rows, words)
    fits = lambda x, y: F.least(x, y) * similarity.denominator >= F.greatest(x, y) * similarity.numerator
    cells = indexed(rows, words, common, similarity).groupBy("cell").agg(
        F.min("key").alias("a"), F.max("key").alias("b"), F.min("n").alias("n_a"), F.max("n").alias("n_b"), F.count(F.lit(1)).alias("rows")
    )
    # two rows are a pair; cells of more are indexed once more by themselves
    cells = stored(cells.where("a != b"), "cells")
    twos = stored(cells.where((F.col("rows") == 2) & fits(F.col("n_a"), F.col("n_b"))).select("a", "b").distinct(), "twos")
    crowds = cells.where("rows > 2").select("cell")
    crowded = np.zeros(1 << CROWD_BITS, bool)
    crowded[crowds.select(F.shiftrightunsigned("cell", 64 - CROWD_BITS).cast("int").alias("at")).distinct().toArrow().column("at").to_numpy()] = True
    again = indexed(rows, words, common, similarity, np.packbits(crowded)).join(crowds, "cell", "left_semi").groupBy("cell", "key").agg(F.first("n").alias("n"))
    left = stored(again.withColumn("root", F.col("key")), "crowds")
    sets = sets_of(rows, left.select("key").union(twos.select("a")).union(twos.select("b")), words)
    found = stored(verified(twos, sets, similarity), "links")
    for draw in range(ROUNDS):
        rank = F.struct(F.xxhash64(F.lit(draw), "key").alias("rank"), F.col("key"), F.col("n"), F.col("root"))
        first = left.groupBy("cell").agg(F.min(rank).alias("one"))
        pairs = left.join(first, "cell").where((F.col("root") != F.col("one.root")) & fits(F.col("n"), F.col("one.n")))
        found = stored(found.union(verified(pairs.select(F.col("key").alias("a"), F.col("one.key").alias("b")).distinct(), sets, similarity)), "links")
        roots = components(found, "a", "b")
        rooted = left.drop("root").join(roots.withColumnRenamed("node", "key"), "key", "left").select("cell", "key", "n", F.coalesce("root", "key").alias("root"))
        left = stored(rooted, "rooted")
        mixed = left.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("cell")
        left = left.join(mixed, "cell", "left_semi")
    left = stored(left, "mixed")
    # what is left of a cell meets block by block, so a cell that many texts share is many keys
    sized = left.join(left.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GRID).alias("parts")), "cell")
    own, other = F.pmod(F.xxhash64("key"), "parts"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    a = sized.select("cell", F.col("key").alias("a"), F.col("n").alias("n_a"), F.col("root").alias("root_a"), own.alias("row"), other.alias("col"))
    b = sized.select("cell", F.col("key").alias("b"), F.col("n").alias("n_b"), F.col("root").alias("root_b"), other.alias("row"), own.alias("col"))
    pairs = a.join(b, ["cell", "row", "col"]).where((F.col("a") < F.col("b")) & (F.col("root_a") != F.col("root_b")) & fits(F.col("n_a"), F.col("n_b")))
    return found.union(verified(pairs.select("a", "b").distinct(), sets, similarity))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, similarity: Fraction = Fraction(4, 5)) -> DataFrame:
    """(id, key, component) of every row: rows whose sets of shingles have at least this Jaccard similarity, directly or
    through others, share a component, named by its smallest id.

    Null and empty texts are copies of each other. A null id never names a component; one that has no other id is null.
    Rows that share an id or a text stay rows of their own; equal texts are searched once. key is a 64-bit hash of the
    text, and sets are compared by 64-bit hashes of their elements. An empty table gives an empty one.
    """
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("key"), text.alias("text"))
    firsts = stored(rows.groupBy("key").agg(F.min("id").alias("first")), "firsts")
    roots = components(links(rows, words, similarity), "a", "b").withColumnRenamed("node", "key")
    rooted = firsts.join(roots, "key", "left").select("key", F.coalesce("root", "key").alias("root"), "first")
    names = rooted.groupBy("root").agg(F.min("first").alias("component"))
    return rows.select("id", "key").join(rooted.join(names, "root").select("key", "component"), "key")
