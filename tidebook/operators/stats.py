"""Information coefficients, quantile tables, bootstrap intervals and regression metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.scalars import is_finite
from tidebook.operators import blocks, order_stats


def labeled_rows(df: DataFrame, target: str = "target") -> DataFrame:
    return df.where(is_finite(F.col(target)))


def feature_ic(
    df: DataFrame, keys: Sequence[str], features: Sequence[str], targets: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Rank correlation of every feature with every target, per key, in one long-form pass."""
    pairs = [
        F.struct(
            F.lit(f).alias("feature"), F.lit(t).alias("target"),
            F.col(f).cast("double").alias("x"), F.col(t).cast("double").alias("y"),
        )
        for f in features
        for t in targets
    ]
    # read for sizes, for borders and for the ranks
    narrow = blocks.settled(df.select(*dict.fromkeys([*keys, *features, *targets])))
    long = narrow.select(*keys, F.explode(F.array(*pairs)).alias("_e")).select(*keys, "_e.*")
    return order_stats.spearman(long, [*keys, "feature", "target"], "x", "y", limit=limit)


def quantile_edges(
    df: DataFrame, value: str, bins: int, keys: Sequence[str] = (), open_ends: bool = True, limit: int | None = None
) -> DataFrame:
    """Distinct inner bin edges per key. With open ends an edge equal to the minimum still counts.

    A key with fewer than two bins (no inner edge) stops the job when its row is read.
    """
    points = [i / bins for i in range(bins + 1)]
    found = order_stats.quantiles(df, keys, value, points, "_q", limit)
    inner = F.array_distinct(F.slice("_q", 2, bins - 1))
    if not open_ends:
        low, high = F.element_at("_q", 1), F.element_at("_q", -1)
        inner = F.filter(inner, lambda e: (e > low) & (e < high))
    few = F.raise_error(F.lit(f"{value}: fewer than three distinct quantile edges")).cast("array<double>")
    return found.select(*keys, inner.alias("edges")).withColumn("edges", F.when(F.size("edges") > 0, F.col("edges")).otherwise(few))


def bin_of(value: Column, edges: Column) -> Column:
    """Zero-based right-closed bin."""
    return F.size(F.filter(edges, lambda e: e < value))


def quantile_table(
    df: DataFrame,
    edges: DataFrame,
    value: str,
    target: str,
    keys: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Rows, mean and median target per bin of fitted edges.

    With no keys `edges` is one row; a bin may hold a tenth of the table, so the median goes through
    the block path when large.
    """
    clean = df.where(F.col(value).isNotNull() & F.col(target).isNotNull())
    paired = clean.join(edges, list(keys)) if keys else clean.crossJoin(F.broadcast(edges))
    binned = paired.select(*keys, bin_of(F.col(value), F.col("edges")).alias("bin"), target)
    by = [*keys, "bin"]
    middle = order_stats.quantiles(binned, by, target, [0.5], "_m", limit)
    summary = binned.groupBy(*by).agg(F.count("*").alias("rows"), F.avg(target).alias("mean_target"))
    return summary.join(middle, by).select(
        *by, "rows", "mean_target", F.col("_m")[0].alias("median_target")
    )


def pooled_bins(tables: DataFrame, session: str) -> DataFrame:
    """Row-weighted mean per bin over per-session tables."""
    return tables.groupBy("bin").agg(
        F.sum("rows").alias("rows"),
        (F.sum(F.col("rows") * F.col("mean_target")) / F.sum("rows")).alias("mean_target"),
        F.count_distinct(session).alias("sessions"),
    )


def cluster_bootstrap(
    clusters: DataFrame,
    keys: Sequence[str],
    cluster: str,
    value: str,
    repetitions: int = 2000,
    confidence: float = 0.95,
    seed: int = 0,
) -> DataFrame:
    """Percentile interval of the mean of cluster values (one row per cluster, resampled whole).

    Draw j of repetition b is a hash of (seed, b, j), so reruns and lost tasks give the same result.
    The clusters are days; draws multiply them, never the rows behind them.
    """
    clean = clusters.where(is_finite(F.col(value))).select(*keys, cluster, F.col(value).alias("_v"))
    part = Window.partitionBy(*(keys or [F.lit(0)]))
    numbered = clean.select(
        *keys, (F.row_number().over(part.orderBy(cluster)) - 1).cast("bigint").alias("_i"), "_v"
    )
    sizes = numbered.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg("_v").alias("_mean"))
    draws = (
        sizes.where("_n >= 2")
        .select(*keys, "_n", F.explode(F.sequence(F.lit(0), F.lit(repetitions - 1))).alias("_b"))
        .select(*keys, "_n", "_b", F.explode(F.expr("sequence(0L, _n - 1)")).alias("_j"))
    )
    digest = F.md5(F.concat_ws("-", F.lit(seed), "_b", "_j"))
    drawn = draws.withColumn("_i", F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % F.col("_n"))
    joined = drawn.join(numbered, [*keys, "_i"])
    means = joined.groupBy(*keys, "_b").agg(F.avg("_v").alias("_m"))
    tail = (1 - confidence) / 2
    bounds = (means.groupBy(*keys) if keys else means).agg(
        F.percentile("_m", F.array(F.lit(tail), F.lit(1 - tail))).alias("_q")
    )
    out = sizes.join(bounds, list(keys), "left") if keys else sizes.crossJoin(F.broadcast(bounds))
    return out.select(
        *keys,
        F.col("_n").alias("clusters"),
        F.col("_mean").alias("estimate"),
        F.col("_q")[0].alias("lower"),
        F.col("_q")[1].alias("upper"),
    )


def regression_metrics(
    df: DataFrame, keys: Sequence[str], actual: str, predicted: str
) -> DataFrame:
    """Error, correlation and direction accuracy over non-flat targets, in one aggregate."""
    y, p = F.col(actual), F.col(predicted)
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.avg(F.abs(y - p)).alias("mae"),
        F.sqrt(F.avg((y - p) * (y - p))).alias("rmse"),
        F.try_divide(F.covar_pop(p, y), F.stddev_pop(p) * F.stddev_pop(y)).alias("correlation"),
        direction_accuracy(y, p).alias("directional_accuracy"),
    )


def direction_accuracy(actual: Column, predicted: Column) -> Column:
    agree = (F.signum(actual) == F.signum(predicted)).cast("double")
    return F.avg(F.when(actual != 0, agree))


def predictive_metrics(
    df: DataFrame, keys: Sequence[str], actual: str, predicted: str, limit: int | None = None
) -> DataFrame:
    """Rows, absolute error, rank correlation and direction accuracy over finite pairs."""
    clean = df.where(is_finite(F.col(actual)) & is_finite(F.col(predicted)))
    errors = clean.groupBy(*keys).agg(
        F.avg(F.abs(F.col(actual) - F.col(predicted))).alias("mae"),
        direction_accuracy(F.col(actual), F.col(predicted)).alias("directional_accuracy"),
    )
    ranks = order_stats.spearman(clean, keys, actual, predicted, limit=limit)
    joined = ranks.join(errors, list(keys)) if keys else ranks.crossJoin(F.broadcast(errors))
    return joined.select(*keys, "rows", "mae", "spearman_ic", "directional_accuracy")


def interval_of(value: Column, cuts: Sequence[float]) -> Column:
    """Text of the right-closed interval between neighbouring cuts that holds a value, NULL for none."""
    out = F.when(value > cuts[-1], f"above {cuts[-1]:g}")
    for low, high in reversed(list(zip([None, *cuts], cuts))):
        out = F.when(value <= high, f"up to {high:g}" if low is None else f"{low:g} to {high:g}").otherwise(out)
    return out


def regimes(df: DataFrame, cuts: dict[str, Sequence[float]]) -> DataFrame:
    """Each row once per column of `cuts` (as dimension), with the interval of the column's absolute value (as regime)."""
    both = F.array(*[F.struct(F.lit(c).alias("dimension"), interval_of(F.abs(c), at).alias("regime")) for c, at in cuts.items()])
    return df.select("*", F.explode(both).alias("_r")).select("*", "_r.*").drop("_r").where("regime IS NOT NULL")


#: Seconds before the close, and sizes of the imbalance.
REGIMES = {"time_remaining_seconds": (120, 300), "auction_imbalance_ratio": (0.05, 0.2)}


def stability_table(
    df: DataFrame, actual: str, predicted: str, limit: int | None = None, cuts: dict[str, Sequence[float]] = REGIMES
) -> DataFrame:
    return predictive_metrics(regimes(df, cuts), ["dimension", "regime"], actual, predicted, limit)
