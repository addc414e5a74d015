"""Models with a closed form, fitted as distributed aggregates and scored as column expressions.

What the driver ever holds is parameters: matrices of feature-count size, never rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import clip, dot, softmax, weights
from tidebook.operators.classify import CLASSES

# --- Fixed rules -----------------------------------------------------------------------------------


def always_stationary() -> Column:
    return weights([0.0, 1.0, 0.0])


def pressure_probabilities(
    features: str = "features", accumulated: int = 86, temperature: float = 1.0, stationary: float = 0.45
) -> Column:
    """Liquidity-pressure rule over ten levels of (ask price, ask size, bid price, bid size).

    Deeper levels weigh 1/sqrt(level); the accumulated ask-minus-bid volume enters with a minus sign.
    """
    raw = [1 / np.sqrt(i) for i in range(1, 11)]
    level = [w / sum(raw) for w in raw]
    f = lambda i: F.element_at(features, i).cast("double")
    terms = [(f(4 * i + 4) - f(4 * i + 2)) * float(level[i]) for i in range(10)]
    depth = terms[0]
    for term in terms[1:]:
        depth = depth + term
    pressure = clip((0.75 * depth - 0.25 * f(accumulated)) / temperature, -12.0, 12.0)
    return softmax(F.array(pressure, F.lit(float(stationary)), -pressure))


def class_prior(counts: DataFrame, keys: Sequence[str], label: str = "label") -> DataFrame:
    """Class shares per key as a probability array, from counts `n` per key and class."""
    share = lambda c: F.coalesce(F.sum(F.when(F.col(label) == c, F.col("n"))), F.lit(0)) / F.sum("n")
    return counts.groupBy(*keys).agg(F.array(*[share(c) for c in CLASSES]).alias("probabilities"))


# --- Diagonal discriminant -------------------------------------------------------------------------


def block_moments(snapshots: DataFrame, block: str, label: str = "label") -> DataFrame:
    """Count, mean and centred sum of squares of each feature per (block, label), in one scan."""
    vectors = snapshots.select(block, label, array_to_vector(F.col("features")).alias("v"))
    summary = vectors.groupBy(block, label).agg(
        Summarizer.metrics("count", "mean", "variance").summary(F.col("v")).alias("s")
    )
    pairs = F.arrays_zip(
        vector_to_array("s.mean").alias("mean"), vector_to_array("s.variance").alias("variance")
    )
    long = summary.select(block, label, F.col("s.count").alias("n"), F.posexplode(pairs).alias("pos", "m"))
    return long.select(
        block, label, "pos", "n", F.col("m.mean").alias("mean"),
        (F.col("m.variance") * (F.col("n") - 1)).alias("m2"),
    )


def lda_parameters(
    moments: DataFrame, block: str, folds: Sequence[tuple[int, int]], shrinkage: float, floor: float = 1e-6,
    label: str = "label",
) -> DataFrame:
    """Weights and intercept per (fold, label) from additive block moments.

    `folds` lists (fold, first block not in train); one scan of the rows serves every fold.
    """
    edges = F.explode(
        F.array(*[F.struct(F.lit(f).alias("fold"), F.lit(e).alias("edge")) for f, e in folds])
    )
    member = moments.select("*", edges.alias("_f")).where(F.col(block) < F.col("_f.edge"))
    n, mean = F.sum("n"), F.sum(F.col("n") * F.col("mean")) / F.sum("n")
    between = F.sum(F.col("n") * F.col("mean") * F.col("mean")) - n * mean * mean
    by_class = member.groupBy(F.col("_f.fold").alias("fold"), label, "pos").agg(
        n.alias("n"), mean.alias("mean"), (F.sum("m2") + between).alias("m2")
    )
    pooled = by_class.groupBy("fold", "pos").agg(
        (F.sum("m2") / F.greatest(F.sum(F.col("n") - 1), F.lit(1))).alias("variance")
    )
    centre = pooled.groupBy("fold").agg(F.avg("variance").alias("target"))
    shrunk = pooled.join(centre, "fold").select(
        "fold", "pos",
        F.greatest(F.col("variance") * (1 - shrinkage) + F.col("target") * shrinkage, F.lit(floor)).alias("variance"),
    )
    cells = by_class.join(shrunk, ["fold", "pos"]).withColumn("w", F.col("mean") / F.col("variance"))
    # One element per feature: the array length is the feature count.
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"])
    return cells.groupBy("fold", label).agg(
        ordered.alias("weights"), (-0.5 * F.sum(F.col("mean") * F.col("w"))).alias("intercept")
    )


def linear_model_table(parameters: DataFrame, label: str = "label") -> DataFrame:
    """One row per fold with the three weight arrays and intercepts side by side."""
    pick = lambda c, name: F.first(F.when(F.col(label) == c, F.col(name)), ignorenulls=True)
    return parameters.groupBy("fold").agg(
        *[pick(c, "weights").alias(f"_w{c}") for c in CLASSES],
        *[pick(c, "intercept").alias(f"_b{c}") for c in CLASSES],
    )


def linear_probabilities(rows: DataFrame, table: DataFrame, features: str = "features") -> DataFrame:
    """Softmax of linear scores; `table` has one row per fold and is broadcast (folds are few)."""
    joined = rows.join(F.broadcast(table), "fold")
    logits = F.array(*[dot(F.col(features), F.col(f"_w{c}")) + F.col(f"_b{c}") for c in CLASSES])
    scored = joined.withColumn("probabilities", softmax(logits))
    return scored.drop(*[f"_{k}{c}" for k in "wb" for c in CLASSES])


# --- Gram matrices ---------------------------------------------------------------------------------


def gram_by_group(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> dict[tuple, np.ndarray]:
    """X'X of [columns, 1] per key, summed where the rows are; NULL is not allowed.

    Each task adds up its rows batch by batch and emits one matrix per key it met; the matrices are
    summed by an aggregate of vectors. Keys are few (dates, blocks, classes).
    """
    width = len(columns) + 1
    keys = list(keys)
    spread = df.select(*[F.col(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys)],
                       *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    names = [f"k{i}" for i in range(len(keys))]

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            groups = pdf.groupby(names, sort=False) if names else [((), pdf)]
            for key, part in groups:
                x = np.column_stack([part.iloc[:, len(names):].to_numpy(float), np.ones(len(part))])
                key = key if isinstance(key, tuple) else (key,)
                sums[key] = sums.get(key, 0) + x.T @ x
        rows = [(*key, matrix.ravel()) for key, matrix in sums.items()]
        yield pd.DataFrame(rows, columns=[*names, "g"])

    ddl = "".join(f"{n} string, " for n in names) + "g array<double>"
    matrices = spread.mapInPandas(partial, ddl).withColumn("v", array_to_vector(F.col("g")))
    total = matrices.groupBy(*names).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("g"))
    return {
        tuple(row[n] for n in names): np.asarray(row["g"]).reshape(width, width)
        for row in total.collect()
    }


def array_columns(df: DataFrame, array: str, width: int) -> tuple[DataFrame, list[str]]:
    names = [f"_f{i}" for i in range(width)]
    return df.withColumns({n: F.element_at(array, i + 1) for i, n in enumerate(names)}), names


TINY = 1e-8


def _standardised(gram: np.ndarray, count: float, features: int, tiny: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, scale, T) with T mapping [x, 1] to [(x - mean) / scale, 1]."""
    mean = gram[-1, :features] / count
    variance = np.maximum(np.diag(gram)[:features] / count - mean**2, 0)
    scale = np.sqrt(variance)
    scale[scale < tiny] = 1.0
    shift = np.eye(features + 1)
    shift[:features, :features] = np.diag(1 / scale)
    shift[:features, -1] = -mean / scale
    return mean, scale, shift


def ridge_from_gram(gram: np.ndarray, features: Sequence[int], target: int, alpha: float) -> tuple[np.ndarray, float]:
    """Coefficients on raw features and intercept of scaled ridge regression.

    `gram` is of [columns, 1]; any subset of columns may be used, so folds (sums of Gram matrices),
    targets, penalties and ablations need no further pass over the data.
    """
    features = list(features)
    take = [*features, gram.shape[0] - 1]
    sub = gram[np.ix_(take, take)]
    _, _, shift = _standardised(sub, sub[-1, -1], len(features), 1e-12)
    penalty = np.eye(len(take)) * alpha
    penalty[-1, -1] = 0.0
    normal, rhs = shift @ sub @ shift.T + penalty, shift @ gram[take, target]
    # without a penalty a constant feature leaves the system singular; the shortest solution gives it 0
    beta = np.linalg.solve(normal, rhs) if alpha else np.linalg.lstsq(normal, rhs, rcond=None)[0]
    raw = shift.T @ beta
    return raw[:-1], float(raw[-1])


def balanced_ridge(by_class: dict[int, np.ndarray], alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights 3 x d, intercepts) of class-balanced multiclass ridge from one Gram matrix per class."""
    counts = {c: by_class[c][-1, -1] if c in by_class else 0.0 for c in CLASSES}
    total, present = sum(counts.values()), sum(v > 0 for v in counts.values())
    weight = {c: total / (present * counts[c]) if counts[c] else 0.0 for c in CLASSES}
    plain = sum(by_class.values())
    _, _, shift = _standardised(plain, total, plain.shape[0] - 1, TINY)
    normal = shift @ sum(weight[c] * g for c, g in by_class.items()) @ shift.T
    rhs = np.column_stack(
        [weight[c] * (shift @ by_class[c][:, -1]) if c in by_class else np.zeros(len(shift)) for c in CLASSES]
    )
    penalty = np.eye(len(shift)) * alpha
    penalty[-1, -1] = 0.0
    raw = shift.T @ np.linalg.solve(normal + penalty, rhs)
    return raw[:-1].T, raw[-1]


def linear_score(columns: Sequence[str], coefficients: Sequence[float], intercept: float) -> Column:
    out = F.lit(float(intercept))
    for name, value in zip(columns, coefficients):
        out = out + F.col(name) * float(value)
    return out


# --- One-feature models ----------------------------------------------------------------------------


def single_feature_slopes(train: DataFrame, keys: Sequence[str], features: Sequence[str], target: str) -> DataFrame:
    """Least squares of the target on each feature alone, in one aggregate; constant features give 0."""
    def fit(f: str) -> Column:
        both = F.col(f).isNotNull() & F.col(target).isNotNull()
        x, y = F.when(both, F.col(f)), F.when(both, F.col(target))
        slope = F.coalesce(F.try_divide(F.covar_pop(x, y), F.var_pop(x)), F.lit(0.0))
        return F.struct(
            F.lit(f).alias("feature"), slope.alias("slope"), (F.avg(y) - slope * F.avg(x)).alias("intercept")
        )

    fitted = train.groupBy(*keys).agg(F.array(*[fit(f) for f in features]).alias("_m"))
    return fitted.select(*keys, F.explode("_m").alias("_m")).select(*keys, "_m.*")


def slope_through_origin(train: DataFrame, keys: Sequence[str], feature: str, target: str) -> DataFrame:
    x = F.coalesce(F.col(feature), F.lit(0.0))
    slope = F.coalesce(F.try_divide(F.sum(x * F.col(target)), F.sum(x * x)), F.lit(0.0))
    return train.where(F.col(target).isNotNull()).groupBy(*keys).agg(slope.alias("slope"))
