"""Fitted models: one-feature baselines, ridge by additive sums, linear classifiers, boosted trees."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks import book as book_checks
from checks import linear
from checks.book import TRIMMED_SQL
from checks.inputs import AUCTION, BOOK, PANEL_SQL, auction_panel, snapshots
from checks.panel import ALL_NAMES, FEATURE_SQL, ROW_SQL
from checks.shape import emit, sql
from checks.snapshot import FOLDS, MEMBERS_SQL, METRIC_COLS, METRIC_CTES, members, test_rows
from checks.snapshot import scored as snapshot_scored
from tidebook.operators import blocks, book, boosting, classify, closed_form, linear_classifiers, panel, panel_models, stats
from tidebook.plans import book_study, panel_study, snapshot_study

QUERIES, SQL = {}, {}


def query(name, text=None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return add


def rows(spark, sf):
    return panel.with_row_features(auction_panel(spark, sf), AUCTION)


# --- Baselines -------------------------------------------------------------------------------------

SINGLE = ["auction_imbalance_ratio", "book_size_imbalance", "spread_bps"]
SLOPE_SQL = ROW_SQL + ", slopes AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, coalesce(CASE WHEN var_pop(x) > 0 THEN covar_pop(x, y) / var_pop(x) END, 0) AS slope, "
    f"avg(y) - coalesce(CASE WHEN var_pop(x) > 0 THEN covar_pop(x, y) / var_pop(x) END, 0) * avg(x) AS intercept "
    f"FROM (SELECT {f} AS x, target AS y FROM r3 WHERE date_id <= 3 AND {f} IS NOT NULL AND target IS NOT NULL)"
    for f in SINGLE
) + ")"


@query("single_feature_slopes", sql(SLOPE_SQL, "feature:s slope:d intercept:d", "slopes"))
def single_feature_slopes(spark, sf):
    train = rows(spark, sf).where("date_id <= 3")
    return emit(closed_form.single_feature_slopes(train, [], SINGLE, "target"))


ORIGIN_SQL = ROW_SQL + """, slope AS (SELECT sum(coalesce(auction_imbalance_ratio, 0) * target) / sum(coalesce(auction_imbalance_ratio, 0) * coalesce(auction_imbalance_ratio, 0)) AS slope FROM r3 WHERE date_id <= 3 AND target IS NOT NULL),
scored AS (SELECT date_id, target, 'zero' AS model, 0e0 AS prediction FROM r3 UNION ALL SELECT date_id, target, 'signed_imbalance', slope * coalesce(auction_imbalance_ratio, 0) FROM r3, slope),
result AS (SELECT date_id, model, count(*) AS rows, avg(abs(target - prediction)) AS mae, sqrt(avg((target - prediction) * (target - prediction))) AS rmse,
    CASE WHEN stddev_pop(prediction) > 0 AND stddev_pop(target) > 0 THEN covar_pop(prediction, target) / (stddev_pop(prediction) * stddev_pop(target)) END AS correlation,
    avg(CASE WHEN target <> 0 THEN (sign(target) = sign(prediction))::INT END) AS directional_accuracy FROM scored WHERE target IS NOT NULL AND date_id > 3 GROUP BY ALL)"""


@query("baseline_metrics", sql(ORIGIN_SQL, "date_id:i model:s rows:i mae:d rmse:d correlation:d directional_accuracy:d"))
def baseline_metrics(spark, sf):
    data = rows(spark, sf)
    slope = closed_form.slope_through_origin(data.where("date_id <= 3"), [], "auction_imbalance_ratio", "target")
    later = stats.labeled_rows(data.where("date_id > 3")).crossJoin(F.broadcast(slope))  # one row
    scored = panel_study.baseline_predictions(later)
    return emit(stats.regression_metrics(scored, ["date_id", "model"], "target", "prediction"))


SUMMARY_SQL = ORIGIN_SQL + """, summary AS (SELECT model AS spec_id, sum(rows) AS rows, avg(mae) AS mae, avg(rmse) AS rmse, avg(directional_accuracy) AS directional_accuracy FROM result GROUP BY 1),
pick AS (SELECT * FROM summary ORDER BY mae, spec_id LIMIT 1)"""
SUMMARY_COLS = "spec_id:s rows:i mae:d rmse:d directional_accuracy:d"


def validation_summary_rows(spark, sf):
    data = rows(spark, sf)
    slope = closed_form.slope_through_origin(data.where("date_id <= 3"), [], "auction_imbalance_ratio", "target")
    later = stats.labeled_rows(data.where("date_id > 3")).crossJoin(F.broadcast(slope))  # one row
    daily = stats.regression_metrics(panel_study.baseline_predictions(later), ["date_id", "model"], "target", "prediction")
    return panel_study.validation_summary(daily, "model")


@query("validation_summary", sql(SUMMARY_SQL, SUMMARY_COLS, "summary"))
def validation_summary(spark, sf):
    return emit(validation_summary_rows(spark, sf))


@query("candidate_pick", sql(SUMMARY_SQL, SUMMARY_COLS, "pick"))
def candidate_pick(spark, sf):
    return emit(panel_study.pick_candidate(validation_summary_rows(spark, sf)))


# --- Book ridge over expanding folds, every fold and penalty from one pass -------------------------

ALPHAS = (0.1, 10.0)
BOOK_FEATURES = list(book.feature_names(BOOK))
BOOK_TARGETS = [f"target_{h}ms_ticks" for h in BOOK.horizons_ms]
ALPHA_OF = dict.fromkeys(BOOK_TARGETS, 1.0)
ALONE = ["microprice_displacement_ticks", "queue_imbalance_l1"]
LONG_SQL = "RECURSIVE " + TRIMMED_SQL + f""",
long AS MATERIALIZED (SELECT *, unnest([{", ".join(f"{{'target': '{t}', 'actual': {t}}}" for t in BOOK_TARGETS)}], recursive := true) FROM trimmed)"""
CORRELATION = "CASE WHEN stddev_pop(prediction) > 0 AND stddev_pop(actual) > 0 THEN covar_pop(prediction, actual) / (stddev_pop(prediction) * stddev_pop(actual)) END AS correlation"
ERRORS = f"""count(*) AS rows, avg(abs(actual - prediction)) AS mae, sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse, {CORRELATION},
    avg(CASE WHEN actual <> 0 THEN (sign(actual) = sign(prediction))::INT END) AS directional_accuracy"""


def ranks_sql(source, name, keys):
    """Rank correlation of (prediction, actual) per keys."""
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2e0"
    return f"""{name} AS (SELECT {keys}, CASE WHEN count(*) >= 2 AND stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS spearman_ic
  FROM (SELECT {keys}, {rank("actual")} AS ra, {rank("prediction")} AS rb FROM {source}) GROUP BY {keys})"""


BOOK_CV_SQL = (
    LONG_SQL + """,
later AS (SELECT session_date, ntile(3) OVER (ORDER BY session_date) AS fold FROM (SELECT DISTINCT session_date FROM trimmed QUALIFY dense_rank() OVER (ORDER BY session_date) > 10)),
firsts AS (SELECT fold, min(session_date) AS first_date FROM later GROUP BY fold),
fitted AS MATERIALIZED (SELECT fold || '/' || target AS fit, l.* FROM long l JOIN firsts ON session_date < first_date),"""
    + linear.scaled_ridge("fitted", BOOK_FEATURES, "actual", ALPHAS)
    + f""", scored AS MATERIALIZED (SELECT fold, target, alpha, session_date, actual, {linear.scaled_prediction(BOOK_FEATURES)} AS prediction FROM long JOIN later USING (session_date) JOIN coefs ON coefs.fit = fold || '/' || target),
{ranks_sql("scored", "daily", "fold, target, alpha, session_date")},
result AS (SELECT * FROM (SELECT fold, target, alpha, {ERRORS} FROM scored GROUP BY ALL) JOIN (SELECT fold, target, alpha, avg(spearman_ic) AS mean_daily_ic FROM daily GROUP BY ALL) USING (fold, target, alpha)),
summary AS (SELECT *, row_number() OVER (PARTITION BY target ORDER BY mean_daily_ic DESC NULLS LAST, alpha) = 1 AS chosen FROM (
  SELECT target, alpha, avg(mean_daily_ic) AS mean_daily_ic, avg(mae) AS mean_mae, avg(rmse) AS mean_rmse, avg(correlation) AS mean_correlation, avg(directional_accuracy) AS mean_directional_accuracy, count(*) AS folds FROM result GROUP BY ALL))"""
)


def book_cv(spark, sf):
    table = book_checks.decision_table(spark, sf)
    return book_study.ridge_cross_validation(table, "session_date", BOOK_FEATURES, BOOK_TARGETS, ALPHAS, skip=10, folds=3)


@query("book_ridge_cv", sql(BOOK_CV_SQL, "fold:i target:s alpha:d rows:i mae:d rmse:d correlation:d directional_accuracy:d mean_daily_ic:d", places=5))
def book_ridge_cv(spark, sf):
    return emit(book_cv(spark, sf), 5)


@query("book_cv_summary", sql(BOOK_CV_SQL, "target:s alpha:d mean_daily_ic:d mean_mae:d mean_rmse:d mean_correlation:d mean_directional_accuracy:d folds:i chosen:b", "summary", 5))
def book_cv_summary(spark, sf):
    return emit(book_study.cv_summary(book_cv(spark, sf)), 5)


def split_sql(fits):
    """daily(split, session_date, target, model, ...) of models fitted on each (name, split list, scored split list)."""
    chosen = " UNION ALL ".join(f"SELECT '{name}/' || target AS fit, '{name}' AS stage, l.* FROM long l WHERE split IN ({train})" for name, train, _ in fits)
    held = " UNION ALL ".join(f"SELECT '{name}' AS stage, l.* FROM long l WHERE split IN ({score})" for name, _, score in fits)
    single = ", ".join(f"regr_slope(actual, {f}) AS slope_{f}, regr_intercept(actual, {f}) AS base_{f}" for f in ALONE)
    cases = ", ".join([
        f"{{'model': 'ridge', 'prediction': {linear.scaled_prediction(BOOK_FEATURES)}}}",
        "{'model': 'zero', 'prediction': 0e0}",
        *[f"{{'model': 'only_{f}', 'prediction': base_{f} + slope_{f} * {f}}}" for f in ALONE],
    ])
    keys = "split, session_date, target, model"
    return LONG_SQL + f""",
fitted AS MATERIALIZED ({chosen}),
{linear.scaled_ridge("fitted", BOOK_FEATURES, "actual", [1.0])},
alone AS (SELECT fit, {single} FROM fitted GROUP BY fit),
scored AS MATERIALIZED (SELECT split, session_date, target, actual, unnest([{cases}], recursive := true) FROM ({held}) h JOIN coefs ON coefs.fit = stage || '/' || target JOIN alone ON alone.fit = coefs.fit),
{ranks_sql("scored", "ranks", keys)},
daily AS (SELECT * FROM (SELECT {keys}, {ERRORS} FROM scored GROUP BY {keys}) JOIN ranks USING ({keys})),
means AS (SELECT split, target, model, count(*) AS sessions, sum(rows) AS rows, avg(spearman_ic) AS mean_daily_ic, avg(mae) AS mean_mae, avg(directional_accuracy) AS mean_directional_accuracy FROM daily GROUP BY ALL)"""


TRAIN, DEVELOPMENT = "'train'", "'train', 'validation'"
SPLIT_SQL = split_sql([("train", TRAIN, "'validation', 'holdout'")])


def book_daily(spark, sf):
    table = book_checks.decision_table(spark, sf)
    return book_study.split_scores(table, "session_date", BOOK_FEATURES, BOOK_TARGETS, ALPHA_OF, ALONE)


@query("book_split_scores", sql(SPLIT_SQL, "split:s session_date:s target:s model:s rows:i mae:d rmse:d correlation:d directional_accuracy:d spearman_ic:d", "daily", 5))
def book_split_scores(spark, sf):
    return emit(book_daily(spark, sf), 5)


HORIZON_SQL = SPLIT_SQL + """,
horizons AS (SELECT * EXCLUDE (split), model = 'ridge' AND row_number() OVER (PARTITION BY model ORDER BY mean_daily_ic DESC NULLS LAST, regexp_extract(target, '[0-9]+')::BIGINT) = 1 AS chosen FROM means WHERE split = 'validation')"""


@query("book_horizon_summary", sql(HORIZON_SQL, "target:s model:s sessions:i rows:i mean_daily_ic:d mean_mae:d mean_directional_accuracy:d chosen:b", "horizons", 5))
def book_horizon_summary(spark, sf):
    return emit(book_study.horizon_summary(book_daily(spark, sf).where("split = 'validation'")), 5)


GAPS = ("mean_daily_ic", "mean_mae", "mean_directional_accuracy")
GAP_SQL = split_sql([("train", TRAIN, "'validation'"), ("development", DEVELOPMENT, "'holdout'")]) + f""",
gaps AS (SELECT target, model, {", ".join(f"d.{c} AS development_{c}, h.{c} AS holdout_{c}, d.{c} - h.{c} AS gap_{c}" for c in GAPS)}
  FROM (SELECT * FROM means WHERE split = 'validation') d JOIN (SELECT * FROM means WHERE split = 'holdout') h USING (target, model))"""


@query("book_holdout_gap", sql(GAP_SQL, "target:s model:s " + " ".join(f"{k}_{c}:d" for c in GAPS for k in ("development", "holdout", "gap")), "gaps", 5))
def book_holdout_gap(spark, sf):
    table = book_checks.decision_table(spark, sf)
    path = f"{blocks.shared_folder(table).rstrip('/')}/models-{uuid.uuid4().hex}"
    return emit(book_study.holdout_gap(table, "session_date", BOOK_FEATURES, BOOK_TARGETS, ALPHA_OF, ALONE, path), 5)


# --- Panel ridge -----------------------------------------------------------------------------------

PANEL_FEATURES = [
    "spread_bps", "wap_mid_gap_bps", "book_size_imbalance", "auction_imbalance_ratio", "near_wap_gap_bps",
    "matched_size_log", "time_remaining_fraction",
]
PREP_SQL = ROW_SQL + ", prep AS (" + " UNION ALL ".join(
    f"SELECT '{f}' AS feature, m AS median, avg(coalesce({f}, m)) AS mean, stddev_pop(coalesce({f}, m)) AS scale FROM r3, (SELECT quantile_cont({f}, 0.5) AS m FROM r3 WHERE date_id <= 3) WHERE date_id <= 3 GROUP BY m"
    for f in PANEL_FEATURES
) + ")"


@query("preprocessing_parameters", sql(PREP_SQL, "feature:s median:d mean:d scale:d", "prep", 4))
def preprocessing_parameters(spark, sf, limit=None):
    train = rows(spark, sf).where("date_id <= 3")
    return emit(panel_models.fit_preprocessing(train, PANEL_FEATURES, limit).table(train), 4)


@query("preprocessing_parameters_blocked", SQL["preprocessing_parameters"])
def preprocessing_parameters_blocked(spark, sf):
    return preprocessing_parameters(spark, sf, 5000)


PREDICTIVE = "rows:i mae:d spearman_ic:d directional_accuracy:d"


def predictive_sql(source, keys):
    """Metrics of (keys, target, prediction) with average ranks."""
    rank = lambda c: f"rank() OVER (PARTITION BY {keys} ORDER BY {c}) + (count(*) OVER (PARTITION BY {keys}, {c}) - 1) / 2e0"
    return f"""ranked AS (SELECT *, {rank("target")} AS ra, {rank("prediction")} AS rb FROM {source}),
result AS (SELECT {keys}, count(*) AS rows, avg(abs(target - prediction)) AS mae,
    CASE WHEN stddev_pop(ra) > 0 AND stddev_pop(rb) > 0 THEN covar_pop(ra, rb) / (stddev_pop(ra) * stddev_pop(rb)) END AS spearman_ic,
    avg(CASE WHEN target <> 0 THEN (sign(target) = sign(prediction))::INT END) AS directional_accuracy FROM ranked GROUP BY {keys})"""


def all_features(spark, sf):
    return panel.panel_features(auction_panel(spark, sf), AUCTION)


JOINED = "JOIN prep USING (fit) JOIN coefs USING (fit) LEFT JOIN effects e ON e.fit = coefs.fit AND e.alpha = coefs.alpha AND e.name = coefs.name AND e.stock_id = {0}.stock_id"
SCORED = f"{linear.panel_prediction(ALL_NAMES)} AS prediction"
PANEL_CV_SQL = (
    "RECURSIVE " + FEATURE_SQL + """,
turns AS (SELECT date_id FROM (SELECT DISTINCT date_id FROM panel) QUALIFY row_number() OVER (ORDER BY date_id) > 2),
later AS (SELECT date_id, ntile(3) OVER (ORDER BY date_id) AS fold FROM turns),
firsts AS (SELECT fold AS fit, min(date_id) AS first_date FROM later GROUP BY fold),
fitted AS MATERIALIZED (SELECT fit, true AS fits, true AS preps, c.* FROM crossed c JOIN firsts ON date_id < first_date WHERE target IS NOT NULL),"""
    + linear.panel_ridge("fitted", ALL_NAMES, ALPHAS, {"all": ALL_NAMES})
    + f""", held AS (SELECT fold AS fit, c.* FROM crossed c JOIN later USING (date_id) WHERE target IS NOT NULL),
scored AS MATERIALIZED (SELECT held.fit AS fold, coefs.alpha AS alpha, target, {SCORED} FROM held {JOINED.format("held")}),
""" + predictive_sql("scored", "fold, alpha")
)


@query("panel_ridge_cv", sql(PANEL_CV_SQL, "fold:i alpha:d " + PREDICTIVE, places=5))
def panel_ridge_cv(spark, sf):
    return emit(panel_study.ridge_cross_validation(all_features(spark, sf), "date_id", ALL_NAMES, "target", ALPHAS, skip=2, folds=3), 5)


FROZEN_SQL = (
    "RECURSIVE " + FEATURE_SQL + """,
fitted AS MATERIALIZED (SELECT 1 AS fit, target IS NOT NULL AS fits, date_id <= 3 AS preps, c.* FROM crossed c WHERE date_id <= 4),"""
    + linear.panel_ridge("fitted", ALL_NAMES, [1.0], {"all": ALL_NAMES})
    + f""", held AS (SELECT 1 AS fit, c.* FROM crossed c WHERE date_id > 4 AND target IS NOT NULL),
scored AS MATERIALIZED (SELECT date_id, target, {SCORED} FROM held {JOINED.format("held")}),
""" + predictive_sql("scored", "date_id")
)


@query("panel_frozen_refit", sql(FROZEN_SQL, "date_id:i " + PREDICTIVE, places=5))
def panel_frozen_refit(spark, sf):
    return emit(panel_study.frozen_refit(all_features(spark, sf), "date_id", ALL_NAMES, "target", 1.0, 3, 4), 5)


FAMILY_OF = panel.families(AUCTION)
LEFT_OUT = {"all": ALL_NAMES} | {f"without_{v}": [f for f in ALL_NAMES if FAMILY_OF[f] != v] for v in dict.fromkeys(FAMILY_OF.values())}
ABLATION_SQL = (
    "RECURSIVE " + FEATURE_SQL + """,
fitted AS MATERIALIZED (SELECT 1 AS fit, true AS fits, true AS preps, c.* FROM crossed c WHERE date_id <= 3 AND target IS NOT NULL),"""
    + linear.panel_ridge("fitted", ALL_NAMES, [1.0], LEFT_OUT)
    + f""", held AS (SELECT 1 AS fit, c.* FROM crossed c WHERE date_id = 4 AND target IS NOT NULL),
scored AS MATERIALIZED (SELECT coefs.name AS features, target, {SCORED} FROM held {JOINED.format("held")}),
""" + predictive_sql("scored", "features")
)


@query("family_ablation", sql(ABLATION_SQL, "features:s " + PREDICTIVE, places=5))
def family_ablation(spark, sf):
    data = all_features(spark, sf)
    return emit(panel_study.family_ablation(data.where("date_id <= 3"), data.where("date_id = 4"), ALL_NAMES, "target", 1.0, AUCTION), 5)


# --- Classifiers -----------------------------------------------------------------------------------

WIDTH = 64
Z = [f"z{i}" for i in range(1, WIDTH + 1)]
VALUES = [f"features[{i}]::DOUBLE" for i in range(1, WIDTH + 1)]
#: Scaled features of the train rows with their balanced weights, per fold.
BALANCED_SQL = MEMBERS_SQL + f""",
tr AS (SELECT * FROM members WHERE split = 'train'),
bal AS (SELECT fold, label, sum(count(*)) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * count(*))::DOUBLE AS w FROM tr GROUP BY fold, label),
prep AS MATERIALIZED (SELECT fold, [{", ".join(f"avg({v})" for v in VALUES)}] AS c, list_transform([{", ".join(f"stddev_pop({v})" for v in VALUES)}], lambda s: CASE WHEN s >= 1e-8 THEN s ELSE 1 END) AS s FROM tr GROUP BY fold),
std AS MATERIALIZED (SELECT fold, label, w, {", ".join(f"({v} - c[{i}]) / s[{i}] AS z{i}" for i, v in enumerate(VALUES, 1))}, 1e0 AS one, {", ".join(f"(label = {c})::INT::DOUBLE AS y{c}" for c in (1, 2, 3))}
  FROM tr JOIN prep USING (fold) JOIN bal USING (fold, label))"""
RIDGE_SQL = (
    "RECURSIVE " + BALANCED_SQL + f""",
whole AS MATERIALIZED (SELECT fold, unnest({linear.pairs([*Z, "one", "y1", "y2", "y3"], "w")}) AS p FROM std GROUP BY fold),
cells AS MATERIALIZED ({linear.mirrored("whole", "fold")}),
systems AS MATERIALIZED (SELECT fold AS key, i, j, a + CASE WHEN i = j AND i <= {WIDTH} THEN 0.1 ELSE 0 END AS a FROM cells WHERE i <= {WIDTH + 1}),
{linear.solved("systems", "solution")},
coefs AS MATERIALIZED (SELECT key AS fold, list(b[1] ORDER BY i) AS b1, list(b[2] ORDER BY i) AS b2, list(b[3] ORDER BY i) AS b3 FROM solution GROUP BY key),
points AS (SELECT m.fold, m.obs_id, m.label, [{", ".join(f"({v} - c[{i}]) / s[{i}]" for i, v in enumerate(VALUES, 1))}, 1e0] AS z FROM members m JOIN prep USING (fold) WHERE split = 'test'),
logits AS (SELECT fold, obs_id, label, [list_dot_product(z, b1), list_dot_product(z, b2), list_dot_product(z, b3)] AS z FROM points JOIN coefs USING (fold)),
said AS (SELECT *, 'ridge' AS spec_id, list_position(p, list_max(p)) AS predicted FROM (SELECT fold, obs_id, label, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p FROM logits)),
""" + METRIC_CTES
)
FOLD_METRICS = METRIC_COLS.removeprefix("spec_id:s ")


def _metrics(scored, keys=("fold",)):
    return emit(classify.classification_metrics(scored, list(keys)))


@query("balanced_ridge_classifier", sql(RIDGE_SQL, FOLD_METRICS, "metrics"))
def balanced_ridge_classifier(spark, sf):
    scored = snapshot_study.balanced_ridge_scores(snapshots(spark, sf), test_rows(spark, sf), "block", FOLDS, WIDTH, 0.1)
    return _metrics(scored)


PENALTIES = {linear_classifiers.SOFTMAX: (1e-3,), linear_classifiers.ONE_VS_REST: (1e-4, 1e-3)}


def linear_table(spark, sf, kind):
    rows = snapshots(spark, sf)
    return linear_classifiers.fit_table(rows, linear_classifiers.newton_fits(rows, "block", FOLDS, PENALTIES[kind], kind, WIDTH))


def linear_scored(spark, sf, kind):
    return linear_classifiers.probabilities(test_rows(spark, sf), linear_table(spark, sf, kind), kind)


@query("softmax_classifier")
def softmax_classifier(spark, sf):
    return _metrics(linear_scored(spark, sf, linear_classifiers.SOFTMAX), ("fold", "penalty"))


@query("one_vs_rest_linear")
def one_vs_rest_linear(spark, sf):
    return _metrics(linear_scored(spark, sf, linear_classifiers.ONE_VS_REST), ("fold", "penalty"))


def optimality(spark, sf, kind):
    """The gradient at the fitted models, from the emitted scores of the train rows by plain aggregates: one row for each
    fold, penalty, class and feature (65: intercept), and whether its entry is below 1e-7."""
    table = linear_table(spark, sf, kind)
    train = members(spark, sf).where("split = 'train'")
    counts = train.groupBy("fold").agg(*[F.count_if(F.col("label") == c).alias(f"n{c}") for c in (1, 2, 3)], F.count("*").alias("n"))
    moments = train.select("fold", F.posexplode("features").alias("at", "v")).groupBy("fold", "at").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    moments = moments.groupBy("fold").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "m", "s"))), lambda r: r).alias("moments"))
    own = F.when(F.col("label") == 1, F.col("n1")).when(F.col("label") == 2, F.col("n2")).otherwise(F.col("n3"))
    scored = linear_classifiers.probabilities(train, table, kind).join(counts, "fold").join(moments, "fold")
    p = "probabilities" if kind == linear_classifiers.SOFTMAX else "sigmoids"
    scored = scored.withColumn("sigmoids", F.transform("_z", lambda z: 1 / (1 + F.exp(-z))))
    z = F.concat(F.zip_with("features", "moments", lambda x, r: (x - r["m"]) / r["s"]), F.array(F.lit(1.0)))
    entries = scored.select("fold", "penalty", (F.lit(1.0) / (3 * own)).alias("w"), "label", F.posexplode(p).alias("c", "p"), z.alias("z"))
    residual = F.col("w") * (F.col("p") - (F.col("label") == F.col("c") + 1).cast("double"))
    loss = entries.select("fold", "penalty", "c", residual.alias("r"), F.posexplode("z").alias("at", "z")).groupBy("fold", "penalty", "c", "at").agg(F.sum(F.col("r") * F.col("z")).alias("g"))
    betas = table.join(moments, "fold").select("fold", "penalty", F.posexplode(F.array("_w1", "_w2", "_w3")).alias("c", "w"), "moments")
    betas = betas.select("fold", "penalty", "c", F.posexplode(F.concat(F.zip_with("w", "moments", lambda w, r: w * r["s"]), F.array(F.lit(0.0)))).alias("at", "b"))
    whole = loss.join(betas, ["fold", "penalty", "c", "at"])
    return emit(whole.select("fold", (F.col("c") + 1).alias("class"), (F.col("at") + 1).alias("feature"), (F.col("penalty") * 1e6).cast("int").alias("penalty_ppm"), (F.abs(F.col("g") + F.col("penalty") * F.col("b")) < 1e-7).alias("stationary")))


def optimality_sql(kind):
    ppm = ", ".join(str(round(p * 1e6)) for p in PENALTIES[kind])
    return sql(
        MEMBERS_SQL + f", result AS (SELECT fold, class, feature, penalty_ppm, true AS stationary FROM (SELECT DISTINCT fold FROM members WHERE split = 'train'), (SELECT unnest([1, 2, 3]) AS class), (SELECT unnest(range(1, {WIDTH + 2})) AS feature), (SELECT unnest([{ppm}]) AS penalty_ppm))",
        "fold:i class:i feature:i penalty_ppm:i stationary:b",
    )


@query("softmax_optimality", optimality_sql(linear_classifiers.SOFTMAX))
def softmax_optimality(spark, sf):
    return optimality(spark, sf, linear_classifiers.SOFTMAX)


@query("one_vs_rest_optimality", optimality_sql(linear_classifiers.ONE_VS_REST))
def one_vs_rest_optimality(spark, sf):
    return optimality(spark, sf, linear_classifiers.ONE_VS_REST)


TREES = boosting.TreeParams(rounds=15, step=0.2, depth=3, bins=32)


def tree_scored(spark, sf):
    return snapshot_study.boosted_class_scores(snapshots(spark, sf), "block", FOLDS, WIDTH, TREES, ["obs_id"])


@query("one_vs_rest_trees")
def one_vs_rest_trees(spark, sf):
    """A tree per class and round on shared softmax gradients, all five folds."""
    return _metrics(tree_scored(spark, sf))


@query("full_candidate_ranking")
def full_candidate_ranking(spark, sf):
    """Every family of the snapshot study in one ranking."""
    named = lambda df, spec, complexity: df.select(F.lit(spec).alias("spec_id") if isinstance(spec, str) else spec, F.lit(complexity).alias("complexity"), "fold", "label", "probabilities")
    of_penalty = lambda name: F.concat(F.lit(f"{name}(penalty="), F.col("penalty").cast("string"), F.lit(")"))
    ridge = snapshot_study.balanced_ridge_scores(snapshots(spark, sf), test_rows(spark, sf), "block", FOLDS, WIDTH, 0.1)
    parts = [
        snapshot_scored(spark, sf).select("spec_id", "complexity", "fold", "label", "probabilities"),
        named(ridge, "ridge(alpha=0.1)", 4),
        *[named(linear_scored(spark, sf, kind), of_penalty(kind).alias("spec_id"), 5) for kind in PENALTIES],
        named(tree_scored(spark, sf), "boosted_trees(rounds=15)", 6),
    ]
    every = parts[0]
    for part in parts[1:]:
        every = every.unionByName(part)
    return emit(classify.rank_candidates(classify.classification_metrics(every, ["spec_id", "complexity", "fold"])))


@query("boosted_regression")
def boosted_regression(spark, sf):
    scored = panel_study.boosted_scores(all_features(spark, sf), "date_id", ALL_NAMES, "target", 4, TREES)
    return emit(stats.regression_metrics(scored, ["model", "date_id"], "target", "prediction"))


LEVEL_SQL = PANEL_SQL + """, counted AS (SELECT stock_id, date_id, coalesce(sum(target) FILTER (date_id <= 4), 0) AS s, count(target) FILTER (date_id <= 4) AS n FROM panel GROUP BY ALL),
days AS (SELECT date_id, coalesce(sum(sum(s)) OVER w / nullif(sum(sum(n)) OVER w, 0), 0) AS prior FROM counted GROUP BY date_id WINDOW w AS (ORDER BY date_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
result AS (SELECT stock_id, date_id, (coalesce(sum(s) OVER w, 0) + 20 * prior) / (coalesce(sum(n) OVER w, 0) + 20) AS stock_level
  FROM counted JOIN days USING (date_id) WINDOW w AS (PARTITION BY stock_id ORDER BY date_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("stock_target_levels", sql(LEVEL_SQL, "stock_id:i date_id:i stock_level:d"))
def stock_target_levels(spark, sf):
    leveled = boosting.ordered_target_statistic(auction_panel(spark, sf), "stock_id", "date_id", "target", F.col("date_id") <= 4)
    return emit(leveled.select("stock_id", "date_id", "stock_level").distinct())
