"""Book study: from events to the decision table, then ridge over expanding folds."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidebook.functions.scalars import dot
from tidebook.operators import blocks, book, closed_form, folds as chronological, order_stats, quality, sessions, stats
from tidebook.params import BookParams, SessionParams, SplitRange


def decision_table(
    events: DataFrame,
    keys: Sequence[str],
    session: SessionParams,
    params: BookParams,
    splits: Sequence[SplitRange],
    report: DataFrame | None = None,
) -> DataFrame:
    """Complete decision rows of usable sessions, tagged with their split.

    `events` is canonical; with a quality `report`, events of rejected sessions are left out first.
    """
    inside = sessions.in_session(events, session)
    by = [*keys, "session_date"]
    if report is not None:
        inside, _ = quality.quarantine(inside, report, by)
    rows = book.features_and_labels(inside, by, session, params)
    lookback = max(*params.flow_ms, *params.trade_ms, params.intensity_ms, params.return_ms)
    needed = [*book.feature_names(params), *[f"target_{h}ms_ticks" for h in params.horizons_ms]]
    whole = sessions.trim(rows, lookback, max(params.horizons_ms), needed)
    return whole.withColumn("split", sessions.split_of(F.col("session_date"), splits))


def _fold_lists(table: DataFrame, date: str, skip: int, count: int) -> dict[int, dict[str, list[str]]]:
    """Dates of each fold and role; there is one row per fold and date."""
    out: dict[int, dict[str, list[str]]] = {}
    for row in chronological.expanding_folds(table, date, skip, count).collect():
        out.setdefault(row["fold"], {"train": [], "validation": []})[row["role"]].append(str(row[date]))
    return out


def _long_targets(rows: DataFrame, targets: Sequence[str]) -> DataFrame:
    """Each row once per target, as columns target and actual."""
    cases = F.array(*[F.struct(F.lit(t).alias("target"), F.col(t).alias("actual")) for t in targets])
    return rows.select("*", F.explode(cases).alias("_t")).drop(*targets).select("*", "_t.*").drop("_t")


def ridge_cross_validation(
    table: DataFrame,
    date: str,
    features: Sequence[str],
    targets: Sequence[str],
    alphas: Sequence[float],
    skip: int,
    folds: int,
) -> DataFrame:
    """Validation metrics per (fold, target, alpha), with the mean of the sessions' rank correlations.

    One pass makes a Gram matrix per date; train matrices of every fold, target and penalty are sums of
    those, solved on the driver. A second pass scores all models on each validation row at once.
    """
    features, targets = list(features), list(targets)
    narrow = table.select(F.col(date).cast("string").alias(date), *features, *targets)
    clean = blocks.settled(narrow.dropna())
    grams = closed_form.gram_by_group(clean, [date], [*features, *targets])
    plan = _fold_lists(clean, date, skip, folds)
    spark, models = table.sparkSession, []
    for fold, roles in sorted(plan.items()):
        gram = sum(grams[(d,)] for d in roles["train"] if (d,) in grams)
        for t, target in enumerate(targets):
            for alpha in alphas:
                beta, bias = closed_form.ridge_from_gram(gram, range(len(features)), len(features) + t, alpha)
                models.append((fold, target, float(alpha), [float(b) for b in beta], bias))
    # Each date validates one fold; both tables have a row per date or per model and are broadcast.
    member = spark.createDataFrame(
        [(d, fold) for fold, roles in plan.items() for d in roles["validation"]], f"`{date}` string, fold int"
    )
    fitted = spark.createDataFrame(models, "fold int, target string, alpha double, beta array<double>, bias double")
    long = _long_targets(clean.join(F.broadcast(member), date), targets)
    scored = long.join(F.broadcast(fitted), ["fold", "target"]).select(
        "fold", "target", "alpha", date, "actual", (dot(F.array(*features), F.col("beta")) + F.col("bias")).alias("prediction")
    )
    keys = ["fold", "target", "alpha"]
    scored = blocks.settled(scored)
    daily = order_stats.spearman(scored, [*keys, date], "prediction", "actual")
    return stats.regression_metrics(scored, keys, "actual", "prediction").join(
        daily.groupBy(*keys).agg(F.avg("spearman_ic").alias("mean_daily_ic")), keys
    )


def cv_summary(scores: DataFrame) -> DataFrame:
    """Fold means per (target, alpha). Of each target the penalty with the highest mean rank correlation is chosen, then
    the lowest penalty; one without a correlation comes last."""
    table = scores.groupBy("target", "alpha").agg(
        F.avg("mean_daily_ic").alias("mean_daily_ic"),
        F.avg("mae").alias("mean_mae"),
        F.avg("rmse").alias("mean_rmse"),
        F.avg("correlation").alias("mean_correlation"),
        F.avg("directional_accuracy").alias("mean_directional_accuracy"),
        F.count("*").alias("folds"),
    )
    order = Window.partitionBy("target").orderBy(F.desc_nulls_last("mean_daily_ic"), "alpha")  # a short list of candidates
    return table.withColumn("chosen", F.row_number().over(order) == 1)


RIDGE = "ridge"


def fitted_models(
    train: DataFrame, features: Sequence[str], targets: Sequence[str], alphas: dict[str, float], baselines: Sequence[str]
) -> DataFrame:
    """(model, target, alpha, beta, bias) of the ridge, of a regression on each baseline feature alone, and of the zero
    forecast, for every target from one Gram matrix. A row of the result holds a whole model."""
    features, targets = list(features), list(targets)
    gram = closed_form.gram_by_group(train.select(*features, *targets).dropna(), [], [*features, *targets])[()]
    rows = []
    for t, target in enumerate(targets):
        at = len(features) + t
        beta, bias = closed_form.ridge_from_gram(gram, range(len(features)), at, alphas[target])
        rows.append((RIDGE, target, float(alphas[target]), [float(b) for b in beta], float(bias)))
        rows.append(("zero", target, None, [0.0] * len(features), 0.0))
        for name in baselines:
            place = features.index(name)
            slope, bias = closed_form.ridge_from_gram(gram, [place], at, 0.0)
            rows.append((f"only_{name}", target, 0.0, [float(slope[0]) if i == place else 0.0 for i in range(len(features))], float(bias)))
    return train.sparkSession.createDataFrame(rows, "model string, target string, alpha double, beta array<double>, bias double")


def daily_scores(rows: DataFrame, date: str, features: Sequence[str], targets: Sequence[str], models: DataFrame) -> DataFrame:
    """Metrics and rank correlation of every model on every session, per (split, date, target, model)."""
    narrow = rows.select("split", date, *features, *targets).dropna(subset=[*features, *targets])
    long = _long_targets(narrow, targets).join(F.broadcast(models), "target")  # a row a model
    prediction = dot(F.array(*features), F.col("beta")) + F.col("bias")
    scored = blocks.settled(long.select("split", date, "target", "model", "actual", prediction.alias("prediction")))
    keys = ["split", date, "target", "model"]
    ranks = order_stats.spearman(scored, keys, "prediction", "actual").drop("rows")
    return stats.regression_metrics(scored, keys, "actual", "prediction").join(ranks, keys)


def split_scores(
    table: DataFrame, date: str, features: Sequence[str], targets: Sequence[str], alphas: dict[str, float], baselines: Sequence[str]
) -> DataFrame:
    """Validation and holdout metrics per session of ridge, one-feature regressions and the zero forecast, all fitted on
    the train split."""
    rows = blocks.settled(table.select("split", date, *features, *targets))
    models = fitted_models(rows.where("split = 'train'"), features, targets, alphas, baselines)
    return daily_scores(rows.where("split IN ('validation', 'holdout')"), date, features, targets, models)


def horizon_summary(daily: DataFrame) -> DataFrame:
    """Means over sessions per (target, model), and the target whose ridge has the highest mean rank correlation (then the
    shortest horizon, by the number in its name) as chosen."""
    table = daily.groupBy("target", "model").agg(
        F.count("*").alias("sessions"),
        F.sum("rows").alias("rows"),
        F.avg("spearman_ic").alias("mean_daily_ic"),
        F.avg("mae").alias("mean_mae"),
        F.avg("directional_accuracy").alias("mean_directional_accuracy"),
    )
    horizon = F.regexp_extract("target", "[0-9]+", 0).cast("bigint")
    order = Window.partitionBy("model").orderBy(F.desc_nulls_last("mean_daily_ic"), horizon)  # a row a target
    return table.withColumn("chosen", (F.col("model") == RIDGE) & (F.row_number().over(order) == 1))


def model_digest() -> Column:
    """Of a model row, over its text form."""
    return F.sha2(F.to_json(F.struct("stage", "model", "target", "alpha", "beta", "bias")), 256)


def freeze(models: DataFrame, path: str, stage: str) -> None:
    """Writes models with a digest each; a path that is taken already is an error, for a frozen stage isn't fitted anew."""
    models.withColumn("stage", F.lit(stage)).withColumn("digest", model_digest()).coalesce(1).write.mode("errorifexists").parquet(path)


def thaw(spark: SparkSession, path: str, stage: str) -> DataFrame:
    """The frozen models. A changed row, another stage or an empty table stops the job."""
    kept = spark.read.parquet(path)
    good = (F.col("stage") == stage) & (F.col("digest") == model_digest())
    if not kept.limit(1).count() or kept.where(~F.coalesce(good, F.lit(False))).limit(1).count():
        raise ValueError(f"{path} doesn't hold the models of stage {stage} as they were frozen")
    return kept.drop("stage", "digest")


def holdout_gap(
    table: DataFrame, date: str, features: Sequence[str], targets: Sequence[str], alphas: dict[str, float], baselines: Sequence[str], path: str
) -> DataFrame:
    """Per (target, model): means on validation sessions of models fitted on train, means on holdout sessions of models
    refitted on train and validation, and their differences.

    The refitted models are written before the holdout is read and scored from what was written.
    """
    rows = blocks.settled(table.select("split", date, *features, *targets))
    models = fitted_models(rows.where("split = 'train'"), features, targets, alphas, baselines)
    before = horizon_summary(daily_scores(rows.where("split = 'validation'"), date, features, targets, models))
    freeze(fitted_models(rows.where("split IN ('train', 'validation')"), features, targets, alphas, baselines), path, "development")
    after = horizon_summary(daily_scores(rows.where("split = 'holdout'"), date, features, targets, thaw(table.sparkSession, path, "development")))
    kept = ["mean_daily_ic", "mean_mae", "mean_directional_accuracy"]
    named = lambda df, prefix: df.select("target", "model", *[F.col(c).alias(f"{prefix}_{c}") for c in kept])
    both = named(before, "development").join(named(after, "holdout"), ["target", "model"])
    return both.withColumns({f"gap_{c}": F.col(f"development_{c}") - F.col(f"holdout_{c}") for c in kept})
