"""Chronological folds and even sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators import blocks


def expanding_folds(df: DataFrame, date: str, skip: int, folds: int) -> DataFrame:
    """(fold, role, date): the dates after the first `skip` in `folds` blocks, train = all earlier.

    Works on distinct dates only, which is why one unpartitioned window is fine here.
    """
    dates = df.select(date).where(F.col(date).isNotNull()).distinct()
    by_date = Window.partitionBy(F.lit(0)).orderBy(date)
    later = dates.withColumn("_i", F.row_number().over(by_date)).where(F.col("_i") > skip)
    blocked = later.select(date, F.ntile(folds).over(by_date).alias("fold"))
    starts = blocked.groupBy("fold").agg(F.min(date).alias("_start"))
    train = dates.join(F.broadcast(starts), F.col(date) < F.col("_start")).select(
        "fold", F.lit("train").alias("role"), date
    )
    return blocked.select("fold", F.lit("validation").alias("role"), date).unionByName(train)


def fold_isolation(folds: DataFrame, date: str) -> DataFrame:
    """Per fold: last train date, first validation date, shared dates and whether order holds."""
    is_train = F.col("role") == "train"
    shared = (
        folds.groupBy("fold", date)
        .agg(F.count_distinct("role").alias("roles"))
        .groupBy("fold")
        .agg(F.count_if(F.col("roles") > 1).alias("shared_dates"))
    )
    ends = folds.groupBy("fold").agg(
        F.max(F.when(is_train, F.col(date))).alias("last_train"),
        F.min(F.when(~is_train, F.col(date))).alias("first_validation"),
    )
    ordered = (F.col("last_train") < F.col("first_validation")) & (F.col("shared_dates") == 0)
    return ends.join(shared, "fold").withColumn("isolated", F.coalesce(ordered, F.lit(False)))


def rows_in(df: DataFrame, folds: DataFrame, fold: int, role: str, date: str) -> DataFrame:
    """Rows whose date belongs to one role of one fold (dates are few, so AQE broadcasts them)."""
    wanted = folds.where((F.col("fold") == fold) & (F.col("role") == role)).select(date)
    return df.join(wanted, date, "left_semi")


def even_sample(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, limit: int | None = None
) -> DataFrame:
    """At most `rows` evenly spaced rows per key: those at positions int(k * (n - 1) / (rows - 1)).

    Membership is decided from a row's own position, so no index list is built or joined. The first
    order column must be numeric and all of them together unique.
    """
    placed = blocks.positions(df, keys, order, "_p", limit)
    sized = placed.join(df.groupBy(*keys).agg(F.count("*").alias("_n")), list(keys))
    at = F.col("_p") - 1
    step = (F.col("_n") - 1).cast("double") / F.lit(max(rows - 1, 1))
    guess = F.ceil(at / step)
    hit = lambda k: (k >= 0) & (k < rows - 1) & (F.floor(k * step) == at)
    picked = hit(guess - 1) | hit(guess) | hit(guess + 1) | (at == F.col("_n") - 1)
    keep = F.when(F.col("_n") <= rows, True).otherwise(at == 0 if rows == 1 else picked)
    return sized.where(keep).drop("_p", "_n")


def paired_members(
    snapshots: DataFrame, block: str, first_train_blocks: int, folds: int
) -> DataFrame:
    """Anchored folds over chronological blocks: fold k trains on the first blocks and tests on the next.

    Train members are prefixes of each other and are kept per fold, never unioned.
    """
    k = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    seen = snapshots.select("*", k)
    edge = F.col("fold") + (first_train_blocks - 1)
    role = F.when(F.col(block) < edge, "train").when(F.col(block) == edge, "test")
    return seen.withColumn("split", role).where(F.col("split").isNotNull())


def fold_label_counts(snapshots: DataFrame, block: str, first_train_blocks: int, folds: int, label: str = "label") -> DataFrame:
    """(fold, label, n) of the train members of anchored folds. Rows are counted once, per block; folds add up counts."""
    counts = snapshots.groupBy(block, label).agg(F.count("*").alias("n"))
    each = F.explode(F.sequence(F.lit(1), F.lit(folds))).alias("fold")
    inside = counts.select(block, label, "n", each).where(F.col(block) < F.col("fold") + (first_train_blocks - 1))
    return inside.groupBy("fold", label).agg(F.sum("n").alias("n"))
