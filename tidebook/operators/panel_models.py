"""Ridge regression of the auction panel: imputation, scaling and a penalised effect per stock, from sums.

One pass over the rows adds up, per part of the chronology, the products of all columns, and per part and stock the
columns themselves. A missing value is kept as a zero and an indicator, so that filling with any median, centring and
scaling are linear maps of the sums: every fold, penalty, frozen preprocessing and set of left-out features is solved
from the same sums without reading the rows again.

The stock effects make the normal matrix as wide as the market, but their block is diagonal. They are eliminated
exactly (a Schur complement); each stock is one row of a grouped table, and the driver solves only systems of
feature-count size. Any number of stocks works.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import is_finite, nan_to_null
from tidebook.operators import blocks, order_stats

TINY = 1e-12
PART, GROUP = "_part", "_group"


@dataclass(frozen=True)
class Preprocessing:
    """Medians, means and deviations of each feature, fitted on training rows."""

    features: tuple[str, ...]
    median: tuple[float, ...]
    mean: tuple[float, ...]
    scale: tuple[float, ...]

    def table(self, df: DataFrame) -> DataFrame:
        """The parameters as rows (feature, median, mean, scale)."""
        rows = list(zip(self.features, self.median, self.mean, self.scale))
        return df.sparkSession.createDataFrame(rows, "feature string, median double, mean double, scale double")


def feature_medians(
    rows: DataFrame, features: Sequence[str], keys: Sequence[str] = (), limit: int | None = None
) -> dict[tuple, np.ndarray]:
    """Exact medians per key in one table; an all-missing feature gets 0. One row a key and feature reaches the driver."""
    keys = list(keys)
    clean = rows.select(*keys, *[nan_to_null(F.col(f)).alias(f) for f in features])
    found = order_stats.column_medians(clean, keys, features, limit)
    place = {f: i for i, f in enumerate(features)}
    out: dict[tuple, np.ndarray] = {} if keys else {(): np.zeros(len(features))}
    for row in found.collect():
        medians = out.setdefault(tuple(row[k] for k in keys), np.zeros(len(features)))
        medians[place[row[order_stats.NAME]]] = row["q"][0]
    return out


def nested_medians(rows: DataFrame, part: str, edges: Sequence[int], features: Sequence[str], points: DataFrame | None = None) -> dict[tuple, np.ndarray]:
    """As `feature_medians`, over the rows with part < edge for each edge, whose key is (edge,)."""
    place = {f: i for i, f in enumerate(features)}
    out: dict[tuple, np.ndarray] = {(e,): np.zeros(len(features)) for e in edges}
    for row in order_stats.nested_medians(rows, part, edges, features, points).collect():
        out[row[order_stats.EDGE],][place[row[order_stats.NAME]]] = row["q"][0]
    return out


def fit_preprocessing(train: DataFrame, features: Sequence[str], limit: int | None = None) -> Preprocessing:
    """Exact medians, then mean and population deviation after filling."""
    median = [float(m) for m in feature_medians(train, features, limit=limit)[()]]
    filled = [F.coalesce(nan_to_null(F.col(f)), F.lit(m)) for f, m in zip(features, median)]
    row = train.agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(filled)],
        *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(filled)],
    ).first()
    scale = [row[f"s{i}"] for i in range(len(features))]
    return Preprocessing(
        tuple(features), tuple(median), tuple(row[f"m{i}"] for i in range(len(features))),
        tuple(s if s > TINY else 1.0 for s in scale),
    )


@dataclass(frozen=True)
class RidgeCase:
    """One model: the parts it is fitted on, its penalty, its features, and where its preprocessing comes from.

    `prep` names the parts of the preprocessing (None: those of the fit), `medians` the key of the medians, and with
    `unlabeled` the preprocessing also counts rows without a target.
    """

    name: str
    parts: tuple[int, ...]
    alpha: float
    medians: tuple
    use: tuple[str, ...] | None = None
    prep: tuple[int, ...] | None = None
    unlabeled: bool = False


def _raw(batch: pa.RecordBatch, d: int, centre: np.ndarray) -> np.ndarray:
    """The rows' values as the sums hold them, without target and 1."""
    values = order_stats.matrix(batch, [f"_x{i}" for i in range(d)])
    missing = np.isnan(values)
    return np.hstack([np.where(missing, 0.0, values - centre), missing])


def _moments(parts, labeled, whole: bool, stocks: pa.Array, sums: np.ndarray) -> pa.RecordBatch:
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1) * sums.shape[1], pa.int32()), pa.array(sums.ravel()))
    columns = [pa.array(parts, pa.int32()), pa.array(labeled, pa.bool_()), pa.array([whole] * len(sums), pa.bool_()), stocks, lists]
    return pa.RecordBatch.from_arrays(columns, [PART, "_labeled", "_whole", GROUP, "g"])


class PanelMoments:
    """Sums of a panel from one pass. Columns are, for d features: values less a centre (0 where missing), indicators of
    missing values, the target, and 1."""

    def __init__(self, panel: DataFrame, part: Column, features: Sequence[str], target: str, centre: np.ndarray):
        self.features, self.target, self.centre = list(features), target, centre
        d = len(self.features)
        self.x, self.y, self.one = np.arange(2 * d), 2 * d, 2 * d + 1
        labeled = is_finite(F.col(target))
        y = F.when(labeled, F.col(target).cast("double")).otherwise(0.0)
        given = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(self.features)]
        rows = panel.select(part.cast("int").alias(PART), labeled.alias("_labeled"), F.col("stock_id").alias(GROUP), *given, y.alias("_y"))
        kind = panel.schema["stock_id"].dataType.simpleString()
        w = 2 * d + 2

        def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            products: dict[tuple, np.ndarray] = {}
            group_type = None
            for batch in batches:
                group_type = batch.schema.field(GROUP).type
                if not batch.num_rows:
                    continue
                values = np.ones((batch.num_rows, w))
                values[:, : 2 * d] = _raw(batch, d, centre)
                values[:, 2 * d] = batch.column("_y").to_numpy()
                parts, kept = batch.column(PART).to_numpy(), batch.column("_labeled").to_numpy(zero_copy_only=False)
                for p, l in sorted(set(zip(parts.tolist(), kept.tolist()))):
                    mine = values[(parts == p) & (kept == l)]
                    products[p, l] = products.get((p, l), 0) + mine.T @ mine
                if kept.any():
                    coded = batch.column(GROUP).dictionary_encode(null_encoding="encode")
                    stocks, numbers = coded.dictionary, coded.indices.to_numpy()[kept]
                    key = parts[kept].astype(np.int64) * len(stocks) + numbers
                    order = np.argsort(key, kind="stable")
                    first = np.flatnonzero(np.r_[True, key[order][1:] != key[order][:-1]])
                    sums = np.add.reduceat(values[kept][order], first, axis=0)
                    heads = order[first]
                    yield _moments(parts[kept][heads], [True] * len(heads), False, stocks.take(pa.array(numbers[heads])), sums)
            if products:
                keys = list(products)
                yield _moments([p for p, _ in keys], [l for _, l in keys], True, pa.nulls(len(keys), group_type), np.stack([products[k].ravel() for k in keys]))

        ddl = f"{PART} int, _labeled boolean, _whole boolean, {GROUP} {kind}, g array<double>"
        parts = rows.mapInArrow(partial, ddl).withColumn("v", array_to_vector("g"))
        cube = blocks.settled(parts.groupBy(PART, "_labeled", "_whole", GROUP).agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("g")))
        self.products = {(r[PART], r["_labeled"]): np.array(r["g"]).reshape(w, w) for r in cube.where("_whole").collect()}
        pair = F.struct(F.col(PART).alias("part"), "g")
        self.stocks = blocks.settled(cube.where("NOT _whole").groupBy(GROUP).agg(F.collect_list(pair).alias("sums")))  # a pair a part

    def total(self, parts: Sequence[int], unlabeled: bool = False) -> np.ndarray:
        w = self.one + 1
        return sum((m for (p, l), m in self.products.items() if p in parts and (l or unlabeled)), np.zeros((w, w)))

    def standardise(self, case: RidgeCase, medians: np.ndarray) -> tuple[Preprocessing, np.ndarray]:
        """The preprocessing, and the map from raw columns to [scaled features, target, 1]."""
        d, w = len(self.features), self.one + 1
        fill = np.zeros((d, w))
        fill[:, :d], fill[:, d : 2 * d] = np.eye(d), np.diag(medians - self.centre)
        sums = self.total(case.prep or case.parts, case.unlabeled)
        n = max(1.0, sums[self.one, self.one])
        mean = fill @ sums[:, self.one] / n
        scale = np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", fill, sums, fill) / n - mean**2, 0))
        scale[scale <= TINY * np.maximum(1, np.abs(mean))] = 1.0
        out = np.zeros((d + 2, w))
        out[:d] = fill / scale[:, None]
        out[:d, self.one] -= mean / scale
        out[d, self.y] = out[d + 1, self.one] = 1.0
        floats = lambda v: tuple(float(x) for x in v)
        return Preprocessing(tuple(self.features), floats(medians), floats(mean + self.centre), floats(scale)), out

    def explained(self, cases: Sequence[RidgeCase]) -> dict[tuple, np.ndarray]:
        """Per parts and penalty the products that the stock effects take: sums over stocks of s s' / (n + penalty)."""
        wanted = sorted({(c.parts, c.alpha) for c in cases})
        w, one = self.one + 1, self.one

        def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            out = np.zeros((len(wanted), w, w))
            for pdf in batches:
                for sums in pdf["sums"]:
                    held = {s["part"]: np.asarray(s["g"]) for s in sums}
                    for k, (parts, alpha) in enumerate(wanted):
                        v = sum((g for p, g in held.items() if p in parts), np.zeros(w))
                        if v[one]:
                            out[k] += np.outer(v, v) / (v[one] + alpha)
            yield pd.DataFrame({"k": range(len(wanted)), "g": [m.ravel() for m in out]})

        found = self.stocks.mapInPandas(partial, "k int, g array<double>").withColumn("v", array_to_vector("g"))
        rows = found.groupBy("k").agg(vector_to_array(Summarizer.sum(F.col("v"))).alias("g")).collect()
        taken = {wanted[r["k"]]: np.array(r["g"]).reshape(w, w) for r in rows}
        return {key: taken.get(key, np.zeros((w, w))) for key in wanted}


@dataclass(frozen=True)
class PanelRidges:
    """Fitted models over one set of sums; stock effects stay a table with one row a stock."""

    moments: PanelMoments
    cases: tuple[RidgeCase, ...]
    weights: tuple[np.ndarray, ...]  # on raw columns, then 1
    preprocessing: tuple[Preprocessing, ...]

    def effects(self) -> DataFrame:
        """(stock_id, effects): a stock's effect in every case; 0 where the case has not seen it."""
        w, y, one = self.moments.one + 1, self.moments.y, self.moments.one
        cases, weights = self.cases, self.weights

        def effect(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = []
                for sums in pdf["sums"]:
                    held = {s["part"]: np.asarray(s["g"]) for s in sums}
                    row = []
                    for case, b in zip(cases, weights):
                        v = sum((g for p, g in held.items() if p in case.parts), np.zeros(w))
                        row.append((v[y] - b[:-1] @ v[:y] - b[-1] * v[one]) / (v[one] + case.alpha) if v[one] else 0.0)
                    out.append(row)
                yield pd.DataFrame({"stock_id": pdf[GROUP], "effects": out})

        kind = self.moments.stocks.schema[GROUP].dataType.simpleString()
        return self.moments.stocks.mapInPandas(effect, f"stock_id {kind}, effects array<double>")

    def predict(self, panel: DataFrame, of: dict[int, Sequence[int]], select: Column | None = None, keep: Sequence[str] | None = None) -> DataFrame:
        """Each row once per case, as (columns to keep, all of the panel by default, case, prediction). `select` is the row's key into `of`, which lists
        the cases for it; without it every row is scored by `of[0]`. Unknown stocks get no effect."""
        features, centre, keep = self.moments.features, self.moments.centre, list(keep or panel.columns)
        d = len(features)
        weights = {k: np.column_stack([self.weights[i] for i in cases]) for k, cases in of.items()}
        given = [F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)]
        carried = list(dict.fromkeys([*keep, "stock_id"]))
        rows = panel.select(*carried, (F.lit(0) if select is None else select).cast("int").alias("_of"), *given)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                raw, keys = _raw(batch, d, centre), batch.column("_of").to_numpy(zero_copy_only=False)
                for k, b in weights.items():
                    at = np.flatnonzero(keys == k)
                    linear = raw[at] @ b[:-1] + b[-1]
                    ends = pa.array(np.arange(len(at) + 1) * b.shape[1], pa.int32())
                    some = batch.select(carried).take(pa.array(at))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.full(len(at), k, np.int32)), pa.ListArray.from_arrays(ends, pa.array(linear.ravel()))], [*carried, "_of", "_linear"])

        kinds = {f.name: f.dataType.simpleString() for f in panel.schema.fields}
        scored = rows.mapInArrow(score, ", ".join([f"`{c}` {kinds[c]}" for c in carried] + ["_of int", "_linear array<double>"]))
        # only the products are carried where the stock effects are too many to broadcast
        scored = blocks.null_safe_join(scored, blocks.settled(self.effects()), ["stock_id"], "left")
        cases = F.create_map(*[c for k, own in of.items() for c in (F.lit(k), F.array(*[F.lit(i) for i in own]))])
        each = scored.withColumn("_case", F.element_at(cases, F.col("_of"))).select(*keep, "effects", F.explode(F.arrays_zip("_case", "_linear")).alias("_c"))
        name = F.get(F.array(*[F.lit(c.name) for c in self.cases]), F.col("_c._case"))
        effect = F.coalesce(F.get("effects", F.col("_c._case")), F.lit(0.0))
        return each.select(*keep, name.alias("case"), (F.col("_c._linear") + effect).alias("prediction"))


def fit_panel_ridges(moments: PanelMoments, cases: Sequence[RidgeCase], medians: dict[tuple, np.ndarray]) -> PanelRidges:
    """Penalised least squares on standardised features and stock indicators with a free intercept, for every case."""
    taken = moments.explained(cases)
    d, weights, preps = len(moments.features), [], []
    for case in cases:
        prep, mapped = moments.standardise(case, medians[case.medians])
        left = mapped @ (moments.total(case.parts) - taken[case.parts, case.alpha]) @ mapped.T
        use = [i for i, f in enumerate(moments.features) if case.use is None or f in case.use]
        at = [*use, d + 1]
        penalty = np.eye(len(at)) * case.alpha
        penalty[-1, -1] = 0.0
        beta = np.linalg.solve(left[np.ix_(at, at)] + penalty, left[at, d])
        onto = mapped[at].T @ beta
        weights.append(np.append(onto[: moments.y], onto[moments.one]))
        preps.append(prep)
    return PanelRidges(moments, tuple(cases), tuple(weights), tuple(preps))
