"""Class-balanced linear classifiers over anchored folds by Newton's method, all folds and penalties in the same passes.

A pass adds up, where the rows are, the loss, the gradient and the blocks of the Hessian of every fold and penalty that
has not converged; the driver solves systems of (classes x features) size. Rows are read once a pass and never copied
per fold: a row takes part in each fold whose train blocks include its block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import dot, one_vs_rest_probabilities, softmax
from tidebook.operators import blocks, closed_form
from tidebook.operators.classify import CLASSES

SOFTMAX, ONE_VS_REST = "softmax", "one_vs_rest"
#: A fit has converged when no entry of the gradient of the mean loss is larger; more passes than MOST stop the job.
TOLERANCE, MOST = 1e-9, 60
#: Partial sums are added up in this many groups a model before they meet.
SPREAD = 32


@dataclass
class LinearFit:
    """One model in scaled features: rows of `theta` are classes, the last column is the intercept."""

    fold: int
    edge: int
    penalty: float
    mean: np.ndarray
    scale: np.ndarray
    class_weight: np.ndarray  # of each class, divided by the sum over the train rows
    theta: np.ndarray
    tried: np.ndarray = field(default=None)
    loss: float = np.inf
    gradient: float = np.inf
    passes: int = 0

    def __post_init__(self):
        self.tried = self.theta

    def raw(self) -> tuple[np.ndarray, np.ndarray]:
        """(weights, intercepts) on unscaled features."""
        weights = self.theta[:, :-1] / self.scale
        return weights, self.theta[:, -1] - weights @ self.mean


def fold_statistics(snapshots: DataFrame, block: str, folds: Sequence[tuple[int, int]], width: int) -> dict[int, dict[int, np.ndarray]]:
    """Per fold and class the Gram matrix of [features, 1], all from one pass; `folds` lists (fold, first block after train)."""
    wide, names = closed_form.array_columns(snapshots.select(block, "label", "features"), "features", width)
    grams = closed_form.gram_by_group(wide, [block, "label"], names)
    out: dict[int, dict[int, np.ndarray]] = {}
    for fold, edge in folds:
        mine = out.setdefault(fold, {})
        for (b, label), gram in grams.items():
            if int(b) < edge:
                mine[int(label)] = mine.get(int(label), 0) + gram
    return out


def _start(fold: int, edge: int, penalty: float, by_class: dict[int, np.ndarray]) -> LinearFit:
    whole = sum(by_class.values())
    total, d = whole[-1, -1], whole.shape[0] - 1
    mean, scale, _ = closed_form._standardised(whole, total, d, closed_form.TINY)
    counts = np.array([by_class[c][-1, -1] if c in by_class else 0.0 for c in CLASSES])
    weight = np.divide(total / np.count_nonzero(counts), counts, out=np.zeros(len(CLASSES)), where=counts > 0)
    return LinearFit(fold, edge, penalty, mean, scale, weight / (weight @ counts), np.zeros((len(CLASSES), d + 1)))


def _sums(kind: str, z: np.ndarray, label: np.ndarray, weight: np.ndarray, theta: np.ndarray) -> np.ndarray:
    """Loss, gradient and Hessian blocks of some rows in one flat vector."""
    scores = z @ theta.T
    target = np.equal.outer(label, CLASSES).astype(float)
    if kind == SOFTMAX:
        top = scores.max(1, keepdims=True)
        p = np.exp(scores - top)
        total = p.sum(1, keepdims=True)
        p /= total
        loss = weight @ (np.log(total[:, 0]) + top[:, 0] - (scores * target).sum(1))
        pairs = [(a, b) for a in range(len(CLASSES)) for b in range(len(CLASSES))]
        hessian = [z.T @ (z * (weight * p[:, a] * ((a == b) - p[:, b]))[:, None]) for a, b in pairs]
    else:
        p = 0.5 * (1 + np.tanh(scores / 2))
        loss = weight @ (np.logaddexp(0, scores) - scores * target).sum(1)
        hessian = [z.T @ (z * (weight * p[:, a] * (1 - p[:, a]))[:, None]) for a in range(len(CLASSES))]
    gradient = ((p - target) * weight[:, None]).T @ z
    return np.concatenate([[loss], gradient.ravel(), *[h.ravel() for h in hessian]])


def _pass(rows: DataFrame, block: str, kind: str, fits: Sequence[LinearFit]) -> list[np.ndarray]:
    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out: list = [0.0] * len(fits)
        for pdf in batches:
            if pdf.empty:
                continue
            x, at, label = np.stack(pdf["features"].to_numpy()).astype(float), pdf[block].to_numpy(), pdf["label"].to_numpy()
            for k, fit in enumerate(fits):
                mine = at < fit.edge
                if mine.any():
                    z = np.column_stack([(x[mine] - fit.mean) / fit.scale, np.ones(mine.sum())])
                    out[k] = out[k] + _sums(kind, z, label[mine], fit.class_weight[label[mine] - 1], fit.tried)
        made = [(k, v.tolist()) for k, v in enumerate(out) if not isinstance(v, float)]
        yield pd.DataFrame(made, columns=["k", "g"])

    parts = rows.mapInPandas(partial, "k int, g array<double>").select("k", (F.spark_partition_id() % SPREAD).alias("s"), array_to_vector("g").alias("v"))
    some = parts.groupBy("k", "s").agg(Summarizer.sum(F.col("v")).alias("v"))
    found = {r["k"]: np.array(r["g"]) for r in some.groupBy("k").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("g")).collect()}
    return [found[k] for k in range(len(fits))]


def _step(kind: str, fit: LinearFit, sums: np.ndarray) -> None:
    """Takes or halves the step that was tried, and sets the next one."""
    classes, w = fit.tried.shape
    slope = np.full(w, fit.penalty)
    slope[-1] = 0.0  # intercepts are free
    loss = sums[0] + 0.5 * float((slope * fit.tried**2).sum())
    fit.passes += 1
    if loss > fit.loss + 1e-12 * max(1.0, abs(fit.loss)) and np.abs(fit.tried - fit.theta).max() > 1e-12:
        fit.tried = (fit.tried + fit.theta) / 2
        return
    fit.theta, fit.loss = fit.tried, loss
    gradient = sums[1 : 1 + classes * w].reshape(classes, w) + slope * fit.theta
    fit.gradient = float(np.abs(gradient).max())
    blocks_ = sums[1 + classes * w :].reshape(-1, w, w)
    if kind == SOFTMAX:  # one system; equal shifts of all intercepts change nothing, so the shortest solution is taken
        hessian = blocks_.reshape(classes, classes, w, w).transpose(0, 2, 1, 3).reshape(classes * w, classes * w) + np.diag(np.tile(slope, classes))
        move = np.linalg.lstsq(hessian, gradient.ravel(), rcond=1e-13)[0].reshape(classes, w)
    else:
        move = np.stack([np.linalg.lstsq(h + np.diag(slope), g, rcond=1e-13)[0] for h, g in zip(blocks_, gradient)])
    fit.tried = fit.theta - move


def newton_fits(
    snapshots: DataFrame, block: str, folds: Sequence[tuple[int, int]], penalties: Sequence[float], kind: str, width: int
) -> list[LinearFit]:
    """A model per fold and penalty that minimises the weighted mean log loss plus penalty / 2 times the squared weights.

    Weights balance the classes of the fold's train rows. A fit that doesn't converge is an error.
    """
    statistics = fold_statistics(snapshots, block, folds, width)
    fits = [_start(fold, edge, float(penalty), statistics[fold]) for fold, edge in folds for penalty in penalties]
    rows = blocks.settled(snapshots.select(block, "label", "features"))
    while active := [f for f in fits if f.gradient > TOLERANCE]:
        if max(f.passes for f in active) >= MOST:
            raise RuntimeError(f"no convergence after {MOST} passes: gradients {[f.gradient for f in active]}")
        for fit, sums in zip(active, _pass(rows, block, kind, active)):
            _step(kind, fit, sums)
    return fits


def fit_table(snapshots: DataFrame, fits: Sequence[LinearFit]) -> DataFrame:
    """(fold, penalty, weights of each class, intercepts, gradient, passes): a row a model."""
    rows = [(f.fold, f.penalty, *[w.tolist() for w in f.raw()[0]], f.raw()[1].tolist(), f.gradient, f.passes) for f in fits]
    kinds = ", ".join(f"_w{c} array<double>" for c in CLASSES)
    return snapshots.sparkSession.createDataFrame(rows, f"fold int, penalty double, {kinds}, _b array<double>, gradient double, passes int")


def probabilities(rows: DataFrame, table: DataFrame, kind: str) -> DataFrame:
    """Each row once per penalty of its fold; classes absent from training have weight 0 there and a low score."""
    scores = F.array(*[dot(F.col("features"), F.col(f"_w{c}")) + F.get("_b", F.lit(i)) for i, c in enumerate(CLASSES)])
    form: Column = softmax(F.col("_z")) if kind == SOFTMAX else one_vs_rest_probabilities(F.col("_z"))
    scored = rows.join(F.broadcast(table), "fold").withColumn("_z", scores)  # a row a fold and penalty
    return scored.withColumn("probabilities", form).drop("_b", *[f"_w{c}" for c in CLASSES])
