"""Boosted trees over histograms: several models (folds, losses) grow in the same passes.

Features are cut into bins at quantiles of the train rows. A pass adds up gradients and second derivatives per model,
output, node, feature and bin where the rows are; the driver picks the splits of one level of all trees from them. Scores
are a column of a table that is written every few rounds; a pass adds the trees since then, which costs less than writing.

A model with K classes grows K trees a round on the gradients of one shared softmax, with the classes' weights.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators import blocks, order_stats
from tidebook.operators.linear_classifiers import SPREAD

#: Rounds after which the scores are written anew.
ROUNDS_APART = 8
SOFTMAX, SQUARED, ABSOLUTE = "softmax", "squared", "absolute"


@dataclass(frozen=True)
class TreeParams:
    """Rounds, step, depth, bins a feature, and the least second derivative and L2 term of a leaf."""

    rounds: int = 20
    step: float = 0.1
    depth: int = 3
    bins: int = 32
    least: float = 1e-3
    l2: float = 1.0


@dataclass
class Boosted:
    """One model: rows with part < edge train it. `weight` has a number per class; `unit` scales the absolute loss."""

    name: str
    edge: int
    loss: str
    outputs: int = 1
    start: float = 0.0
    weight: np.ndarray | None = None
    unit: float = 1.0
    #: round -> output -> (features, bins, leaves): complete trees in breadth-first order; a row goes right above the bin
    trees: list[list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = field(default_factory=list)

    def derivatives(self, score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.loss == SOFTMAX:
            p = np.exp(score - score.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            label = y.astype(int) - 1
            w = self.weight[label][:, None]
            return w * (p - np.equal.outer(label, np.arange(self.outputs))), w * np.maximum(p * (1 - p), 1e-6)
        away = score - y[:, None]
        if self.loss == SQUARED:
            return away, np.ones_like(away)
        return np.sign(away), np.full_like(away, 1 / self.unit)


def cut_points(train: DataFrame, array: str, width: int, bins: int) -> list[np.ndarray]:
    """Bin borders of each position of an array column: distinct approximate quantiles of the rows given."""
    points = [i / bins for i in range(1, bins)]
    long = train.select(F.posexplode(array).alias("at", "v")).where("v IS NOT NULL AND NOT isnan(v)")
    found = long.groupBy("at").agg(F.percentile_approx(F.col("v").cast("double"), F.array(*[F.lit(p) for p in points]), F.lit(10_000)).alias("q"))
    out = {r["at"]: np.unique(r["q"]) for r in found.collect()}  # a row a feature
    return [out.get(i, np.zeros(0)) for i in range(width)]


def cuts_of_points(points: DataFrame, columns: Sequence[str], fill: Sequence[float], rows: int, bins: int) -> list[np.ndarray]:
    """As `cut_points` from the sketch of columns (part 0), of which missing values up to the number of rows count as `fill`."""
    held = points.groupBy("at").agg(F.sum(F.size("values") * F.col("weight")).alias("n")).collect()  # a row a column
    there = {r["at"]: r["n"] for r in held}
    gaps = [(0, i, [float(f)], float(rows - there.get(i, 0.0))) for i, f in enumerate(fill) if rows - there.get(i, 0.0) > 0.5]
    whole = points.unionByName(points.sparkSession.createDataFrame(gaps, points.schema)) if gaps else points
    found = order_stats.read_points(whole, "part", [1], [i / bins for i in range(1, bins)])
    return [np.unique(found[1, i]) if (1, i) in found else np.zeros(0) for i in range(len(columns))]


def binned(rows: DataFrame, array: str, cuts: Sequence[np.ndarray]) -> DataFrame:
    """Adds `bins`, a byte a feature: how many borders are below the value. A missing value is in bin 0."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.stack(pdf[array].to_numpy()).astype(float) if len(pdf) else np.zeros((0, len(cuts)))
            out = np.stack([np.where(np.isnan(x[:, i]), 0, np.searchsorted(c, x[:, i], "left")) for i, c in enumerate(cuts)], axis=1).astype(np.uint8)
            yield pdf.drop(columns=[array]).assign(bins=[b.tobytes() for b in out])

    others = [f for f in rows.schema.fields if f.name != array]
    ddl = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["bins binary"])
    return rows.mapInPandas(run, ddl)


def binned_columns(rows: DataFrame, columns: Sequence[str], cuts: Sequence[np.ndarray], fill: Sequence[float]) -> DataFrame:
    """As `binned`, of columns beside one another instead of an array; a missing value, or NaN, counts as the column's `fill`."""
    columns = list(columns)
    filled = [int(np.searchsorted(c, f, "left")) for c, f in zip(cuts, fill)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = np.empty((batch.num_rows, len(columns)), np.uint8)
            for i, name in enumerate(columns):
                x = batch.column(name).to_numpy(zero_copy_only=False)
                out[:, i] = np.where(np.isnan(x), filled[i], np.searchsorted(cuts[i], x, "left"))
            ends = pa.array(np.arange(len(out) + 1) * len(columns), pa.int32())
            bins = pa.Array.from_buffers(pa.binary(), len(out), [None, ends.buffers()[1], pa.py_buffer(out.tobytes())])
            yield pa.RecordBatch.from_arrays([*batch.select(others).columns, bins], [*others, "bins"])

    others = [c for c in rows.columns if c not in columns]
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    given = rows.select(*others, *[F.col(c).cast("double").alias(c) for c in columns])
    return given.mapInArrow(run, ", ".join([f"`{c}` {kinds[c]}" for c in others] + ["bins binary"]))


def _leaf_of(bins: np.ndarray, tree: tuple, levels: int) -> np.ndarray:
    node = np.zeros(len(bins), int)
    rows = np.arange(len(bins))
    for _ in range(levels):
        node = 2 * node + 1 + (bins[rows, tree[0][node]] > tree[1][node])
    return node - (2**levels - 1)


def _scores(models: Sequence[Boosted], flat: np.ndarray) -> list[np.ndarray]:
    ends = np.cumsum([m.outputs for m in models])
    return [flat[:, e - m.outputs : e] for m, e in zip(models, ends)]


def _columns(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Bins (rows, width) and scores (rows, outputs) of a batch, read from its buffers."""
    bins = batch.column("bins").cast(pa.binary())
    ends = np.frombuffer(bins.buffers()[1], np.int32)[bins.offset : bins.offset + len(bins) + 1]
    scores = batch.column("scores").flatten().to_numpy(zero_copy_only=False)
    return np.frombuffer(bins.buffers()[2], np.uint8)[ends[0] : ends[-1]].reshape(-1, width), scores.reshape(len(bins), -1)


def _grown_scores(bins: np.ndarray, scores: np.ndarray, rounds: Sequence[list[list[tuple]]], params: TreeParams) -> np.ndarray:
    """Scores after the trees of some rounds, one round after another."""
    for growing in rounds:
        steps = [t[2][_leaf_of(bins, t, params.depth)] for trees in growing for t in trees]
        scores = scores + params.step * np.stack(steps, axis=1)
    return scores


def _histograms(
    state: DataFrame, models: Sequence[Boosted], since: list[list[list[tuple]]], growing: list[list[tuple]], level: int, width: int, params: TreeParams
) -> list[np.ndarray]:
    """Per model an array (output, node, feature, bin, 2) of summed derivatives over its train rows.

    `since` has the rounds that the table's scores don't hold yet. A feature is counted at a time, so its bins and sums
    stay in the cache; a loss with one second derivative for all rows only counts rows, which at the root all such
    models with the same rows share.
    """
    bins = params.bins
    shapes = [(m.outputs, 2**level, width, bins, 2) for m in models]
    first = max(m.edge for m in models)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = [np.zeros(s) for s in shapes]
        for batch in batches:
            part = batch.column("part").to_numpy()
            if not len(part):
                continue
            b, scores = _columns(batch, width)
            y = batch.column("y").to_numpy()
            scores = _grown_scores(b, scores, since, params)
            by_edge: dict[int, tuple] = {}
            for k, (model, score) in enumerate(zip(models, _scores(models, scores))):
                if model.edge not in by_edge:
                    mine = part < model.edge
                    by_edge[model.edge] = mine, b[mine], np.ascontiguousarray(b[mine].T), {}
                mine, rows, turned, counted = by_edge[model.edge]
                if not len(rows):
                    continue
                g, h = model.derivatives(score[mine], y[mine])
                for o in range(model.outputs):
                    node = _leaf_of(rows, growing[k][o], level) * bins
                    for f in range(width):
                        at = node + turned[f]
                        size = 2**level * bins
                        out[k][o, :, f, :, 0] += np.bincount(at, g[:, o], size).reshape(-1, bins)
                        if model.loss == SOFTMAX:
                            out[k][o, :, f, :, 1] += np.bincount(at, h[:, o], size).reshape(-1, bins)
                            continue
                        counts = counted.get(f) if level == 0 else None
                        if counts is None:
                            counts = counted[f] = np.bincount(at, minlength=size).reshape(-1, bins)
                        out[k][o, :, f, :, 1] += counts * h[0, o]
        yield pa.RecordBatch.from_pydict({"k": pa.array(range(len(out)), pa.int32()), "g": pa.array([a.ravel() for a in out], pa.list_(pa.float64()))})

    narrow = state.where(F.col("part") < first).select("part", "y", "bins", "scores")
    parts = narrow.mapInArrow(partial, "k int, g array<double>").select("k", (F.spark_partition_id() % SPREAD).alias("s"), array_to_vector("g").alias("v"))
    some = parts.groupBy("k", "s").agg(Summarizer.sum(F.col("v")).alias("v"))
    found = {r["k"]: np.array(r["g"]) for r in some.groupBy("k").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("g")).collect()}
    return [found[k].reshape(s) if k in found else np.zeros(s) for k, s in enumerate(shapes)]


def best_splits(histogram: np.ndarray, params: TreeParams) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(feature, bin, left leaf, right leaf) of each node; a node that gains nothing sends every row left."""
    left = histogram.cumsum(2)
    whole = left[:, :, -1:, :]
    right = whole - left
    value = lambda s: s[..., 0] ** 2 / (s[..., 1] + params.l2)
    gain = value(left) + value(right) - value(whole)
    gain[(left[..., 1] < params.least) | (right[..., 1] < params.least)] = 0.0
    gain[:, :, -1] = 0.0
    nodes, width, bins = gain.shape
    flat = gain.reshape(nodes, -1)
    at = flat.argmax(1)
    stay = flat[np.arange(nodes), at] <= 1e-12
    feature, cut = np.where(stay, 0, at // bins), np.where(stay, bins, at % bins)
    rows = np.arange(nodes)
    leaf = lambda s: -s[..., 0] / (s[..., 1] + params.l2)
    a = np.where(stay, leaf(whole[rows, 0, 0]), leaf(left[rows, feature, np.minimum(cut, bins - 1)]))
    b = np.where(stay, a, leaf(right[rows, feature, np.minimum(cut, bins - 1)]))
    return feature, cut, a, b


def boost(rows: DataFrame, models: Sequence[Boosted], width: int, params: TreeParams) -> DataFrame:
    """Grows the models' trees and returns the rows with `scores`, the outputs of all models one after another.

    `rows` has part, y and bins besides columns that are kept; y may be NULL where part is not below any edge.
    """
    start = F.array(*[F.lit(float(m.start)) for m in models for _ in range(m.outputs)])
    state = blocks.settled(rows.withColumns({"y": F.coalesce(F.col("y").cast("double"), F.lit(0.0)), "part": F.col("part").cast("int"), "scores": start}))
    inner = 2**params.depth - 1
    since: list[list[list[tuple]]] = []

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                scores = pa.array(list(_grown_scores(*_columns(batch, width), since, params)), pa.list_(pa.float64()))
                batch = batch.set_column(batch.schema.get_field_index("scores"), "scores", scores)
            yield batch

    for _ in range(params.rounds):
        growing = [[(np.zeros(inner, int), np.zeros(inner, int), np.zeros(2**params.depth)) for _ in range(m.outputs)] for m in models]
        for level in range(params.depth):
            for trees, histogram in zip(growing, _histograms(state, models, since, growing, level, width, params)):
                for tree, h in zip(trees, histogram):
                    first = 2**level - 1
                    feature, cut, a, b = best_splits(h, params)
                    tree[0][first : first + len(feature)], tree[1][first : first + len(cut)] = feature, cut
                    if level == params.depth - 1:
                        tree[2][0::2], tree[2][1::2] = a, b
        for model, trees in zip(models, growing):
            model.trees.append(trees)
        since.append(growing)
        if len(since) == ROUNDS_APART:
            state = blocks.settled(state.mapInArrow(add, state.schema))
            since = []
    return blocks.settled(state.mapInArrow(add, state.schema)) if since else state


def ordered_target_statistic(
    rows: DataFrame, stock: str, date: str, target: str, train: Column, strength: float = 20.0, name: str = "stock_level"
) -> DataFrame:
    """Adds `target_levels` to the rows."""
    table = target_levels(rows, stock, date, target, train, strength, name)
    return blocks.null_safe_join(rows, table, [stock, date], "left")


def target_levels(
    rows: DataFrame, stock: str, date: str, target: str, train: Column, strength: float = 20.0, name: str = "stock_level"
) -> DataFrame:
    """(stock, date, level): a stock's mean target over strictly earlier train dates, drawn to the mean of all stocks on those dates as if
    it had `strength` rows of it. A stock without earlier train rows gets that mean; before any of them it is 0.

    `train` says which rows count. Any number of stocks is one numeric column, and no row's own date is in it.
    """
    counts = train & F.col(target).isNotNull()
    sums = rows.groupBy(stock, date).agg(
        F.sum(F.when(counts, F.col(target)).otherwise(0.0)).alias("_s"), F.count_if(counts).alias("_n")
    )
    sums = blocks.settled(sums)  # a row a stock and date
    earlier = lambda keys: Window.partitionBy(*keys).orderBy(date).rowsBetween(Window.unboundedPreceding, -1)
    days = sums.groupBy(date).agg(F.sum("_s").alias("_ds"), F.sum("_n").alias("_dn"))
    by_day = earlier([F.lit(0)])  # a row a date
    prior = F.coalesce(F.try_divide(F.sum("_ds").over(by_day), F.sum("_dn").over(by_day)), F.lit(0.0))
    days = days.select(date, prior.alias("_prior"))
    own = earlier([stock])
    before = sums.select(stock, date, F.coalesce(F.sum("_s").over(own), F.lit(0.0)).alias("_s"), F.coalesce(F.sum("_n").over(own), F.lit(0)).alias("_n"))
    level = (F.col("_s") + F.lit(strength) * F.col("_prior")) / (F.col("_n") + F.lit(strength))
    return blocks.null_safe_join(before, days, [date], "inner").select(stock, date, level.alias(name))
