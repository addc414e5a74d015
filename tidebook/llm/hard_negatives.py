"""Hard negatives by anchor spanning-tree bounds.

Vectors are multiplied by 256 and floored, so scores are inner products of whole numbers. Anchors are dealt to blocks of
neighbours, and each block gets a minimum spanning tree. Where a tree meets a block of candidates, the root's scores are
computed in full; a child's score differs from its parent's by no more than the edge's length times the candidate's
norm, so only candidates whose bounds overlap a wanted range are scored again, and the others hand wider bounds down.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.llm.scratch import stored

SCALE = 256
#: Rows of a block of candidates and of anchors, and components whose signs order the rows before they are dealt.
CANDIDATES, ANCHORS, SIGNS = 4096, 512, 16
EXACT = 2.0**53
LEAST, MOST = -(1 << 63), (1 << 63) - 1
FOUND = "anchor long, nth int, score long, id long, row long"


def numbered(rows: DataFrame, key: str, size: int) -> DataFrame:
    """rows with a block number: size rows of one key each, by their order in the range partitions. One row a partition
    passes through the driver."""
    parts = sorted(rows.groupBy("part").count().collect())
    shifts = np.cumsum([0, *(r["count"] for r in parts)]).tolist()
    shift = rows.sparkSession.createDataFrame([(r.part, s) for r, s in zip(parts, shifts, strict=False)], "part int, shift long")
    inside = F.row_number().over(Window.partitionBy("part").orderBy("row")) - 1
    return rows.withColumn("inside", inside).join(F.broadcast(shift), "part").withColumn(key, F.floor((F.col("inside") + F.col("shift")) / size)).drop("inside", "shift")


def matrix(packed: bytes, n: int) -> np.ndarray:
    return np.frombuffer(packed, np.float64).reshape(n, -1)


def spanning_tree(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge) of a minimum spanning tree by Prim's algorithm; parents come before their children, the
    first has itself. Edge lengths are rounded up."""
    n = len(points)
    squares = (points * points).sum(1)
    order, parent, edge = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n)
    near, by, left = np.full(n, np.inf), np.zeros(n, np.int64), np.ones(n, bool)
    now = 0
    for k in range(n):
        order[k], left[now] = now, False
        apart = np.maximum(squares + squares[now] - 2 * (points @ points[now]), 0)
        closer = left & (apart < near)
        near[closer], by[closer] = apart[closer], now
        if k + 1 < n:
            now = int(np.where(left, near, np.inf).argmin())
            now = now if left[now] else int(np.flatnonzero(left)[0])
            exact = ((points[now] - points[by[now]]) ** 2).sum()
            parent[now], edge[now] = by[now], np.sqrt(exact) * (1 + 1e-12)
    return order, parent, edge


def packed(blocks: DataFrame, key: str, tree: bool) -> DataFrame:
    """One row a block: the rows' numbers, ids, labels and whole vectors as bytes; of anchors also the tree."""

    def pack(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        n, dims = table.num_rows, table.column("dims")[0].as_py()
        vectors = np.floor(SCALE * table.column("vector").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.float64)).reshape(n, dims) if n * dims else np.zeros((n, 0))
        ids = table.column("id").chunk(0)
        fields = {
            "dims": pa.array([dims], pa.int32()),
            key: table.column(key).slice(0, 1).combine_chunks().cast(pa.int64()),
            "rows": [table.column("row").to_numpy().astype(np.int64).tobytes()],
            "ids": [ids.fill_null(0).to_numpy().astype(np.int64).tobytes()],
            "known": [ids.is_valid().to_numpy(zero_copy_only=False).astype(np.uint8).tobytes()],
            "labels": [table.column("label").to_numpy().astype(np.int64).tobytes()],
            "vectors": [vectors.tobytes()],
        }
        if tree:
            with np.errstate(over="ignore", invalid="ignore"):
                fields["tree"] = [b"".join(x.astype(np.float64).tobytes() for x in spanning_tree(vectors))]
        return pa.table(fields)

    kind = f"dims int, {key} long, rows binary, ids binary, known binary, labels binary, vectors binary" + (", tree binary" if tree else "")
    return blocks.groupBy("dims", key).applyInArrow(pack, kind)


class Meeting:
    """A block of anchors and a block of candidates."""

    def __init__(self, anchors: dict, candidates: dict):
        number = lambda raw: np.frombuffer(raw, np.int64)
        self.anchor_rows, self.anchor_labels = number(anchors["rows"]), number(anchors["labels"])
        self.rows, self.ids, self.labels = number(candidates["rows"]), number(candidates["ids"]), number(candidates["labels"])
        self.known = np.frombuffer(candidates["known"], np.uint8).astype(bool)
        self.a, self.x = matrix(anchors["vectors"], len(self.anchor_rows)), matrix(candidates["vectors"], len(self.rows))
        self.tree = np.frombuffer(anchors["tree"], np.float64).reshape(3, -1)
        with np.errstate(over="ignore", invalid="ignore"):
            self.norms = np.sqrt((self.x * self.x).sum(1)) * (1 + 1e-12)
        top = lambda v: float(np.abs(v).max(initial=0))
        self.exact = max(top(self.a), top(self.x)) ** 2 * max(1, self.x.shape[1]) < EXACT / 8

    def scores(self, anchor: int, at: np.ndarray) -> np.ndarray:
        """Whole scores; those that 64 bits can't hold become the nearest number that they can."""
        if self.exact:
            whole = self.x @ self.a[anchor] if 2 * len(at) > len(self.rows) else None
            return (whole[at] if whole is not None else self.x[at] @ self.a[anchor]).astype(np.int64)
        own = [int(v) for v in self.a[anchor]]
        return np.array([min(MOST, max(LEAST, sum(p * int(q) for p, q in zip(own, self.x[i], strict=True)))) for i in at], np.int64)

    def walk(self, wanted) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(anchor, candidates, scores) for all that wanted(anchor, low, high) marks from the bounds, parents first."""
        order, parent, edge = self.tree
        n = len(self.rows)
        every, low, high = np.arange(n), np.zeros((len(order), n)), np.zeros((len(order), n))
        for k, anchor in enumerate(order.astype(np.int64)):
            if k == 0 or not self.exact:
                scores = self.scores(anchor, every)
                low[anchor] = high[anchor] = scores
                at = np.flatnonzero(wanted(anchor, low[anchor], high[anchor]))
                scores = scores[at]
            else:
                above, reach = int(parent[anchor]), edge[anchor] * self.norms + 1
                np.subtract(low[above], reach, out=low[anchor])
                np.add(high[above], reach, out=high[anchor])
                at = np.flatnonzero(wanted(anchor, low[anchor], high[anchor]))
                scores = self.scores(anchor, at)
                low[anchor, at] = high[anchor, at] = scores
            yield int(anchor), at, scores

    def best(self, at: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Places of the first few: higher scores, then smaller ids, none last, then smaller row numbers."""
        if len(at) > 4 * most:
            near = scores >= np.partition(scores, len(scores) - most)[len(scores) - most]
            places = np.flatnonzero(near)
        else:
            places = np.arange(len(at))
        i = at[places]
        return places[np.lexsort((self.rows[i], self.ids[i], ~self.known[i], -scores[places].astype(np.float64) if self.exact else ~scores[places]))[:most]]

    def table(self, found: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.Table:
        at = np.concatenate([f[2] for f in found]) if found else np.zeros(0, np.int64)
        counts = [len(f[2]) for f in found]
        columns = [
            np.repeat(self.anchor_rows[[f[0] for f in found]], counts) if found else at,
            np.repeat(np.array([f[1] for f in found], np.int32), counts),
            np.concatenate([f[3] for f in found]) if found else at,
            pa.array(self.ids[at], pa.int64(), mask=~self.known[at]),
            self.rows[at],
        ]
        return pa.table(columns, names=["anchor", "nth", "score", "id", "row"])


def nearest_of_label(most: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        meet = Meeting(anchors.to_pylist()[0], candidates.to_pylist()[0])

        def wanted(anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            own = (meet.labels == meet.anchor_labels[anchor]) & (meet.rows != meet.anchor_rows[anchor])
            bounds = low[own]
            if len(bounds) > most:
                own &= high >= np.partition(bounds, len(bounds) - most)[len(bounds) - most]
            return own

        found = []
        for anchor, at, scores in meet.walk(wanted):
            places = meet.best(at, scores, most)
            found.append((anchor, 0, at[places], scores[places]))
        return meet.table(found)

    return run


def inside_windows(most: int):
    def run(anchors: pa.Table, candidates: pa.Table) -> pa.Table:
        block = anchors.to_pylist()[0]
        meet = Meeting(block, candidates.to_pylist()[0])
        place = {row: k for k, row in enumerate(meet.anchor_rows.tolist())}
        windows: dict[int, list[tuple[int, int, int]]] = {}
        for w in block["windows"]:
            windows.setdefault(place[w["anchor"]], []).append((w["nth"], w["low"], w["high"]))

        def wanted(anchor: int, low: np.ndarray, high: np.ndarray) -> np.ndarray:
            hit = np.zeros(len(low), bool)
            for _, least, greatest in windows.get(anchor, ()):
                hit |= (low <= greatest) & (high >= least)
            return hit & (meet.labels != meet.anchor_labels[anchor])

        found = []
        for anchor, at, scores in meet.walk(wanted):
            for nth, least, greatest in windows.get(anchor, ()):
                held = np.flatnonzero((scores >= least) & (scores <= greatest))
                places = held[meet.best(at[held], scores[held], most)]
                if len(places):
                    found.append((anchor, nth, at[places], scores[places]))
        return meet.table(found)

    return run


def met(anchors: DataFrame, candidates: DataFrame, pairs: DataFrame, run) -> DataFrame:
    """run for each pair of blocks; a group holds one row of either side."""
    key = ["dims", "of", "among"]
    left, right = anchors.join(pairs, ["dims", "of"]), candidates.join(pairs, ["dims", "among"])
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, FOUND)


def ranked(found: DataFrame, keys: list[str], most: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)



def hard_negatives(
    table: DataFrame,
    anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    label: Column | None = None,
    candidates_block: int = CANDIDATES,
    anchors_block: int = ANCHORS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    anchor says which rows are anchors, label may replace the label column; both read the table's own columns. An
    anchor's positives are its first other rows of the same label, its negatives for each positive the first rows of
    another label whose score is low to high hundredths of the positive's. Higher scores come first, then smaller ids,
    rows without an id last. Rows with a null label or vector, or a null or non-finite component, take no part; labels
    are whole numbers. Vectors of another length than the anchor's aren't compared with it. Rows that share an id are
    rows of their own. Scores beyond 64 bits are the nearest number that they hold. No rows or no anchor: no result.
    """
    x = F.col("vector")
    rows = table.select(
        F.col(id_col).cast("long").alias("id"), (F.col(label_col) if label is None else label).cast("long").alias("label"), F.col(vector_col).cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor")
    )
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = rows.where(F.col("label").isNotNull() & x.isNotNull()).where(finite)
    signs = F.array_join(F.transform(F.slice(x, 1, SIGNS), lambda v: F.when(v < 0, "0").otherwise("1")), "")
    rows = rows.select("*", F.size(x).alias("dims"), signs.alias("signs"), F.monotonically_increasing_id().alias("place"))
    order = ["dims", "label", "signs", "place"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("dims", "id", "label", "vector", "anchor", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("row"))
    dealt = stored(dealt, "vectors")
    of = stored(numbered(dealt.where("anchor"), "of", anchors_block), "anchors")
    among = stored(numbered(dealt, "among", candidates_block), "candidates")
    trees, blocks = stored(packed(of, "of", tree=True), "trees"), stored(packed(among, "among", tree=False), "blocks")

    left, right = of.select("dims", "label", "of").distinct(), among.select("dims", "label", "among").distinct()
    near = left.join(right, ["dims", "label"]).select("dims", "of", "among").distinct()
    first = ranked(met(trees, blocks, near, nearest_of_label(positives)), ["anchor"], positives)
    first = first.select("anchor", F.col("place").alias("nth"), F.col("score").alias("positive_score"), F.col("id").alias("positive_id"))
    first = stored(first.join(of.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id"), "dims", "of"), "anchor"), "positives")

    # low * p <= 100 * s <= high * p, as the range of whole scores s
    share = lambda part: F.col("positive_score").cast("decimal(20,0)") * F.lit(part) / F.lit(100)
    bounds = F.struct("anchor", "nth", F.ceil(share(low)).cast("long").alias("low"), F.floor(share(high)).cast("long").alias("high"))
    windows = first.groupBy("dims", "of").agg(F.collect_list(bounds).alias("windows"))  # at most positives x anchors of a block
    own = lambda rows, key: rows.groupBy("dims", key).agg(F.min("label").alias(f"{key}_least"), F.max("label").alias(f"{key}_most"))
    one_label = (F.col("of_least") == F.col("of_most")) & (F.col("among_least") == F.col("among_most")) & (F.col("of_least") == F.col("among_least"))
    far = own(left, "of").join(own(right, "among"), "dims").where(~one_label).select("dims", "of", "among")
    second = ranked(met(trees.join(windows, ["dims", "of"]), blocks, far, inside_windows(negatives)), ["anchor", "nth"], negatives)
    second = second.select("anchor", "nth", F.col("place").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return first.join(second, ["anchor", "nth"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
