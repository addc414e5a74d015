"""Snapshot study: fold-local fits from additive statistics, scored on the paired test members."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import softmax
from tidebook.operators import boosting, closed_form, linear_classifiers
from tidebook.operators.classify import CLASSES


def balanced_ridge_scores(
    snapshots: DataFrame, tests: DataFrame, block: str, folds: Sequence[tuple[int, int]], width: int, alpha: float
) -> DataFrame:
    """Class-balanced ridge per fold. One pass yields a Gram matrix per (block, class) for all folds."""
    wide, names = closed_form.array_columns(snapshots.select(block, "label", "features"), "features", width)
    grams = closed_form.gram_by_group(wide, [block, "label"], names)
    rows = []
    for fold, edge in folds:
        by_class = {}
        for (b, label), gram in grams.items():
            if int(b) < edge:
                by_class[int(label)] = by_class.get(int(label), 0) + gram
        weights, intercepts = closed_form.balanced_ridge(by_class, alpha)
        rows.append((fold, *[w.tolist() for w in weights], *[float(i) for i in intercepts]))
    schema = "fold int, _w1 array<double>, _w2 array<double>, _w3 array<double>, _b1 double, _b2 double, _b3 double"
    table = snapshots.sparkSession.createDataFrame(rows, schema)
    return closed_form.linear_probabilities(tests, table)


def boosted_class_scores(
    snapshots: DataFrame, block: str, folds: Sequence[tuple[int, int]], width: int, params: boosting.TreeParams, keep: Sequence[str] = ()
) -> DataFrame:
    """(fold, label, keep, probabilities) of boosted trees on each fold's test block; all folds grow in the same passes.

    Bins come from the blocks that train every fold, so no test row has a say in them.
    """
    statistics = linear_classifiers.fold_statistics(snapshots, block, folds, width)
    models = []
    for fold, edge in folds:
        counts = np.array([statistics[fold][c][-1, -1] if c in statistics[fold] else 0.0 for c in CLASSES])
        weight = np.divide(counts.sum() / np.count_nonzero(counts), counts, out=np.zeros(len(counts)), where=counts > 0)
        models.append(boosting.Boosted(str(fold), edge, boosting.SOFTMAX, len(CLASSES), weight=weight))
    rows = snapshots.select(block, "label", *keep, F.col(block).alias("part"), F.col("label").cast("double").alias("y"), "features")
    first = min(edge for _, edge in folds)
    cuts = boosting.cut_points(rows.where(F.col("part") < first), "features", width, params.bins)
    grown = boosting.boost(boosting.binned(rows, "features", cuts), models, width, params)
    place = {fold: k for k, (fold, _) in enumerate(folds)}
    cases = F.array(*[F.struct(F.lit(fold).alias("fold"), F.lit(edge).alias("edge"), F.lit(place[fold]).alias("k")) for fold, edge in folds])
    tested = grown.select("*", F.explode(cases).alias("_f")).where(F.col("part") == F.col("_f.edge"))
    own = F.slice("scores", F.col("_f.k") * len(CLASSES) + 1, F.lit(len(CLASSES)))
    return tested.select(F.col("_f.fold").alias("fold"), "label", *keep, softmax(own).alias("probabilities"))
