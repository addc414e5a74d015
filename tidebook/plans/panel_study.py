"""Auction-panel study: baselines, ridge over expanding folds, ablation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.scalars import nan_to_null
from tidebook.operators import folds as chronological
from tidebook.operators import blocks, boosting, order_stats, panel_models, stats
from tidebook.operators.panel import families
from tidebook.params import AuctionParams


def baseline_predictions(df: DataFrame, slope: str = "slope", feature: str = "auction_imbalance_ratio") -> DataFrame:
    """Each row once per baseline: the zero forecast and the signed-imbalance slope."""
    signed = F.col(slope) * F.coalesce(F.col(feature), F.lit(0.0))
    cases = F.array(
        F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("prediction")),
        F.struct(F.lit("signed_imbalance").alias("model"), signed.alias("prediction")),
    )
    return df.select("*", F.explode(cases).alias("_c")).select("*", "_c.*").drop("_c")


def ridge_cross_validation(
    panel: DataFrame, date: str, features: Sequence[str], target: str, alphas: Sequence[float], skip: int, folds: int
) -> DataFrame:
    """Predictive metrics per (fold, alpha); preprocessing and model see only the labeled rows of the fold's train dates.

    Medians of all folds come from one table, the models of all folds and penalties from one pass, and each validation
    row is scored once per penalty by its own fold's models.
    """
    features = list(features)
    panel = blocks.settled(panel.select("stock_id", date, target, *features))
    blocked = chronological.expanding_folds(panel, date, skip, folds).where("role = 'validation'")
    starts = [r["start"] for r in blocked.groupBy("fold").agg(F.min(date).alias("start")).orderBy("fold").collect()]
    # dates before the first block are part 0, block k is part k and validates fold k
    part = F.size(F.filter(F.array(*[F.lit(d) for d in starts]), lambda d: d <= F.col(date)))
    inside = stats.labeled_rows(panel, target).withColumn("fold", part)
    medians = panel_models.nested_medians(inside.where(F.col("fold") < len(starts)), "fold", range(1, len(starts) + 1), features)
    sums = panel_models.PanelMoments(inside, F.col("fold"), features, target, medians[(len(starts),)])
    cases = [
        panel_models.RidgeCase(str(float(alpha)), tuple(range(fold)), float(alpha), (fold,))
        for fold in range(1, len(starts) + 1) for alpha in alphas
    ]
    models = panel_models.fit_panel_ridges(sums, cases, medians)
    of = {fold: range((fold - 1) * len(alphas), fold * len(alphas)) for fold in range(1, len(starts) + 1)}
    scored = models.predict(inside.where("fold > 0"), of, F.col("fold"), ["fold", target])
    scored = blocks.settled(scored.select("fold", F.col("case").cast("double").alias("alpha"), target, "prediction"))
    return stats.predictive_metrics(scored, ["fold", "alpha"], target, "prediction")


def validation_summary(daily: DataFrame, model: str) -> DataFrame:
    """Mean of per-date metrics for each candidate."""
    return daily.groupBy(F.col(model).alias("spec_id")).agg(
        F.sum("rows").alias("rows"),
        F.avg("mae").alias("mae"),
        F.avg("rmse").alias("rmse"),
        F.avg("directional_accuracy").alias("directional_accuracy"),
    )


def pick_candidate(scores: DataFrame, error: str = "mae", spec: str = "spec_id") -> DataFrame:
    """The candidate with the lowest error, then the lowest id."""
    order = Window.partitionBy(F.lit(0)).orderBy(error, spec)  # one row per candidate
    return scores.withColumn("_i", F.row_number().over(order)).where("_i = 1").drop("_i")


def family_ablation(
    train: DataFrame, validation: DataFrame, features: Sequence[str], target: str, alpha: float, params: AuctionParams
) -> DataFrame:
    """Metrics of ridge on all features and with each feature family left out, all solved from the same sums."""
    features = list(features)
    columns = ["stock_id", target, *features]
    train, validation = blocks.settled(stats.labeled_rows(train, target).select(*columns)), stats.labeled_rows(validation, target).select(*columns)
    family_of = families(params)
    cases = {"all": tuple(features)}
    for family in dict.fromkeys(family_of[f] for f in features):
        kept = tuple(f for f in features if family_of[f] != family)
        if kept:
            cases[f"without_{family}"] = kept
    medians = panel_models.nested_medians(train.withColumn("_part", F.lit(0)), "_part", [1], features)
    sums = panel_models.PanelMoments(train, F.lit(0), features, target, medians[1,])
    models = panel_models.fit_panel_ridges(sums, [panel_models.RidgeCase(name, (0,), float(alpha), (1,), kept) for name, kept in cases.items()], medians)
    scored = models.predict(validation, {0: range(len(cases))}, keep=[target]).select(F.col("case").alias("features"), target, "prediction")
    scored = blocks.settled(scored)  # else every pass of the ranks would make the features again
    return stats.predictive_metrics(scored, ["features"], target, "prediction")


def frozen_refit(
    panel: DataFrame, date: str, features: Sequence[str], target: str, alpha: float, train_last: int, development_last: int
) -> DataFrame:
    """Per-date metrics on later dates: preprocessing from all train rows, coefficients from labeled train + validation."""
    features = list(features)
    rows = blocks.settled(panel.select("stock_id", date, target, *features))
    part = (F.col(date) > train_last).cast("int") + (F.col(date) > development_last).cast("int")
    medians = panel_models.nested_medians(rows.where(F.col(date) <= train_last).withColumn("_part", F.lit(0)), "_part", [1], features)
    sums = panel_models.PanelMoments(rows.where(F.col(date) <= development_last), part, features, target, medians[1,])
    case = panel_models.RidgeCase("frozen", (0, 1), float(alpha), (1,), prep=(0,), unlabeled=True)
    models = panel_models.fit_panel_ridges(sums, [case], medians)
    held = blocks.settled(models.predict(rows.where(F.col(date) > development_last), {0: [0]}, keep=[date, target]).select(date, target, "prediction"))
    return stats.predictive_metrics(held, [date], target, "prediction")


def boosted_scores(
    panel: DataFrame, date: str, features: Sequence[str], target: str, train_last: int, params: boosting.TreeParams
) -> DataFrame:
    """(panel columns, model, prediction) of boosted regressions with squared and absolute loss on rows after train_last.

    Missing features are filled with the medians of labeled train rows; the stock enters as the mean target of its
    earlier train dates.
    """
    features = list(features)
    train, y = F.col(date) <= train_last, F.col(target)
    part = F.when(train, 0).otherwise(1).alias("part")
    rows = blocks.settled(panel.select("stock_id", date, target, part, *features))
    labeled = stats.labeled_rows(rows, target)
    # a stock's level meets narrow rows only: few bytes a row are shuffled where the levels are too many to broadcast
    levels = blocks.settled(boosting.target_levels(rows, "stock_id", date, target, train))
    leveled = lambda narrow: blocks.null_safe_join(narrow, levels, ["stock_id", date], "left")
    cuts, fills = [], []
    for table, names in ((labeled, features), (leveled(labeled.select("stock_id", date, target, "part")), ["stock_level"])):
        points = blocks.settled(order_stats.quantile_points(table.where("part = 0"), "part", names))
        medians = panel_models.nested_medians(table.where("part = 0"), "part", [1], names, points)[1,]
        cuts += boosting.cuts_of_points(points, names, medians, table.where("part = 0").count(), params.bins)
        fills += list(medians)
    level = order_stats.quantiles(labeled.where("part = 0"), [], target, [0.5]).first()["q"][0]
    size = labeled.where("part = 0").agg(F.avg(y).alias("mean"), F.avg(F.abs(y - F.lit(level))).alias("away")).first()
    models = [
        boosting.Boosted("boosted_squared", 1, boosting.SQUARED, start=size["mean"]),
        boosting.Boosted("boosted_absolute", 1, boosting.ABSOLUTE, start=level, unit=max(size["away"], 1e-9)),
    ]
    narrow = leveled(boosting.binned_columns(labeled, features, cuts[:-1], fills[:-1]))
    value = F.coalesce(nan_to_null(F.col("stock_level")), F.lit(float(fills[-1])))
    last = F.unhex(F.lpad(F.hex(stats.bin_of(value, F.array(*[F.lit(float(c)) for c in cuts[-1]]).cast("array<double>"))), 2, "0"))
    table = narrow.select("stock_id", date, target, y.alias("y"), "part", F.concat("bins", last).alias("bins"))
    grown = boosting.boost(table, models, len(features) + 1, params)
    cases = F.array(*[F.struct(F.lit(m.name).alias("model"), F.get("scores", F.lit(i)).alias("prediction")) for i, m in enumerate(models)])
    return grown.where("part = 1").select("stock_id", date, target, F.explode(cases).alias("_c")).select("stock_id", date, target, "_c.*")
