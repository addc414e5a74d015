"""Snapshot study: rules and discriminants over anchored folds, class metrics and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import SNAP_SQL, snapshots
from checks.shape import emit, sql
from tidebook.functions.scalars import one_vs_rest_probabilities, softmax, top_class
from tidebook.operators import classify, closed_form, folds

QUERIES, SQL = {}, {}
FOLDS = [(k, k + 4) for k in range(1, 6)]
THRESHOLDS = (0.34, 0.36, 0.4, 0.5, 0.9)
ACCUMULATED = 60


def query(name, text=None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return add


MEMBERS_SQL = SNAP_SQL + """,
members AS (SELECT *, CASE WHEN block < fold + 4 THEN 'train' ELSE 'test' END AS split FROM snap, (SELECT unnest(range(1, 6)) AS fold) WHERE block <= fold + 4)"""


def members(spark, sf):
    return folds.paired_members(snapshots(spark, sf), "block", 5, 5)


def test_rows(spark, sf):
    return members(spark, sf).where("split = 'test'")


@query("class_weights", sql(MEMBERS_SQL + """, result AS (SELECT fold, label, count(*) AS n, sum(count(*)) OVER (PARTITION BY fold) / (count(*) OVER (PARTITION BY fold) * count(*))::DOUBLE AS weight
  FROM members WHERE split = 'train' GROUP BY fold, label)""", "fold:i label:i n:i weight:d"))
def class_weights(spark, sf):
    return emit(classify.balanced_weights(folds.fold_label_counts(snapshots(spark, sf), "block", 5, 5), ["fold"]))


PRESS = f"""press AS (SELECT *, greatest(-12, least(12, (0.75 * (({" + ".join(f"(features[{4 * i + 4}]::DOUBLE - features[{4 * i + 2}]::DOUBLE) / sqrt({i + 1}e0)" for i in range(10))}) / ({" + ".join(f"1 / sqrt({i}e0)" for i in range(1, 11))}))
    - 0.25 * features[{ACCUMULATED}]::DOUBLE) / 0.1)) AS z FROM members WHERE split = 'test'),
pressp AS (SELECT fold, obs_id, label, labels, [exp(z) / t, exp(0.45) / t, exp(-z) / t] AS p FROM (SELECT *, exp(z) + exp(0.45) + exp(-z) AS t FROM press))"""


def lda_sql(name, shrinkage):
    return f"""{name}_c AS (SELECT fold, label, pos, count(*) AS n, avg(v) AS mean, var_samp(v) AS var FROM (
    SELECT fold, label, unnest(range(1, 65)) AS pos, unnest(features)::DOUBLE AS v FROM members WHERE split = 'train') GROUP BY ALL),
{name}_v AS (SELECT fold, pos, sum(var * (n - 1)) / sum(n - 1) AS pv FROM {name}_c GROUP BY ALL),
{name}_s AS (SELECT fold, pos, greatest({1 - shrinkage} * pv + {shrinkage} * avg(pv) OVER (PARTITION BY fold), 1e-6) AS sv FROM {name}_v),
{name}_w AS (SELECT fold, label, list(mean / sv ORDER BY pos) AS w, -0.5 * sum(mean * mean / sv) AS b FROM {name}_c JOIN {name}_s USING (fold, pos) GROUP BY ALL),
{name}_z AS (SELECT m.fold, obs_id, m.label, any_value(labels) AS labels, list(list_inner_product(features::DOUBLE[], w) + b ORDER BY q.label) AS z
  FROM members m JOIN {name}_w q ON m.fold = q.fold WHERE split = 'test' GROUP BY m.fold, obs_id, m.label),
{name} AS (SELECT fold, obs_id, label, labels, list_transform(z, lambda x: exp(x - list_max(z)) / list_sum(list_transform(z, lambda y: exp(y - list_max(z))))) AS p FROM {name}_z)"""


PRIOR = """prior AS (SELECT fold, [count_if(label = 1) / count(*)::DOUBLE, count_if(label = 2) / count(*)::DOUBLE, count_if(label = 3) / count(*)::DOUBLE] AS p FROM members WHERE split = 'train' GROUP BY 1)"""
SPECS = {  # name: (complexity, SQL source)
    "always_stationary()": 0,
    "class_prior()": 1,
    "liquidity_pressure(temperature=0.1)": 2,
    "diagonal_lda(shrinkage=0.1)": 3,
    "diagonal_lda(shrinkage=0.5)": 3,
}
SCORED_SQL = (
    MEMBERS_SQL + "," + PRESS + "," + PRIOR + "," + lda_sql("lda1", 0.1) + "," + lda_sql("lda5", 0.5) + """,
scored AS (
  SELECT 'always_stationary()' AS spec_id, fold, obs_id, label, labels, [0e0, 1e0, 0e0] AS p FROM members WHERE split = 'test'
  UNION ALL SELECT 'class_prior()', m.fold, obs_id, label, labels, prior.p FROM members m JOIN prior USING (fold) WHERE split = 'test'
  UNION ALL SELECT 'liquidity_pressure(temperature=0.1)', fold, obs_id, label, labels, p FROM pressp
  UNION ALL SELECT 'diagonal_lda(shrinkage=0.1)', fold, obs_id, label, labels, p FROM lda1
  UNION ALL SELECT 'diagonal_lda(shrinkage=0.5)', fold, obs_id, label, labels, p FROM lda5),
said AS (SELECT *, list_position(p, list_max(p)) AS predicted FROM scored)"""
)


def lda_scored(spark, sf, shrinkage):
    moments = closed_form.block_moments(snapshots(spark, sf), "block")
    table = closed_form.linear_model_table(closed_form.lda_parameters(moments, "block", FOLDS, shrinkage))
    return closed_form.linear_probabilities(test_rows(spark, sf), table)


def scored(spark, sf):
    rows = test_rows(spark, sf)
    prior = closed_form.class_prior(folds.fold_label_counts(snapshots(spark, sf), "block", 5, 5), ["fold"])
    parts = [
        rows.withColumn("probabilities", closed_form.always_stationary()),
        rows.join(F.broadcast(prior), "fold"),  # one row per fold
        rows.withColumn("probabilities", closed_form.pressure_probabilities(accumulated=ACCUMULATED, temperature=0.1)),
        lda_scored(spark, sf, 0.1),
        lda_scored(spark, sf, 0.5),
    ]
    out = None
    for part, (spec, complexity) in zip(parts, SPECS.items()):
        named = part.select(
            F.lit(spec).alias("spec_id"), F.lit(complexity).alias("complexity"),
            "fold", "obs_id", "label", "labels", "probabilities",
        )
        out = named if out is None else out.unionByName(named)
    return out


@query(
    "snapshot_probabilities",
    sql(SCORED_SQL + ", result AS (SELECT *, p[1] AS p_up, p[2] AS p_stationary, p[3] AS p_down FROM said)",
        "spec_id:s fold:i obs_id:i label:i p_up:d p_stationary:d p_down:d predicted:i"),
)
def snapshot_probabilities(spark, sf):
    p = F.col("probabilities")
    return emit(
        scored(spark, sf).select(
            "spec_id", "fold", "obs_id", "label", p[0].alias("p_up"), p[1].alias("p_stationary"), p[2].alias("p_down"),
            top_class(p).alias("predicted"),
        )
    )


CELLS = ", ".join(f"count_if(label = {t} AND predicted = {p}) AS n_{t}_{p}" for t in (1, 2, 3) for p in (1, 2, 3))
CELL_COLS = " ".join(f"n_{t}_{p}:i" for t in (1, 2, 3) for p in (1, 2, 3))
PER_CLASS = " UNION ALL ".join(
    f"SELECT spec_id, fold, {c} AS c, '{n}' AS class, count_if(label = {c} AND predicted = {c})::DOUBLE AS hit, count_if(predicted = {c}) AS chosen, count_if(label = {c}) AS support FROM said GROUP BY 1, 2"
    for c, n in ((1, "up"), (2, "stationary"), (3, "down"))
)
#: Metrics of a table said(spec_id, fold, label, p, predicted).
METRIC_CTES = f"""
per AS (SELECT *, CASE WHEN chosen > 0 THEN hit / chosen ELSE 0 END AS precision, CASE WHEN support > 0 THEN hit / support ELSE 0 END AS recall,
    CASE WHEN chosen + support > 0 THEN 2 * hit / (chosen + support) ELSE 0 END AS f1 FROM ({PER_CLASS})),
agg AS (SELECT spec_id, fold, avg(f1) AS macro_f1, avg(recall) FILTER (support > 0) AS balanced_accuracy, sum(hit) AS c, sum(support)::DOUBLE AS s,
    sum(chosen * support)::DOUBLE AS pt, sum(chosen * chosen)::DOUBLE AS pp, sum(support * support)::DOUBLE AS tt FROM per GROUP BY 1, 2),
base AS (SELECT spec_id, fold, count(*) AS observations, avg(-ln(greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, p[label])))) AS log_loss, {CELLS} FROM said GROUP BY 1, 2),
metrics AS (SELECT *, CASE WHEN (s * s - pp) * (s * s - tt) > 0 THEN (c * s - pt) / sqrt((s * s - pp) * (s * s - tt)) ELSE 0 END AS mcc FROM base JOIN agg USING (spec_id, fold))"""
METRIC_SQL = SCORED_SQL + "," + METRIC_CTES
METRIC_COLS = f"spec_id:s fold:i observations:i log_loss:d {CELL_COLS} macro_f1:d balanced_accuracy:d mcc:d"


def metrics(spark, sf):
    return classify.classification_metrics(scored(spark, sf), ["spec_id", "complexity", "fold"])


@query("classification_metrics", sql(METRIC_SQL, METRIC_COLS, "metrics"))
def classification_metrics(spark, sf):
    return emit(metrics(spark, sf).drop("complexity"))


@query("class_report", sql(METRIC_SQL, "spec_id:s fold:i class:s precision:d recall:d f1:d support:i", "per"))
def class_report(spark, sf):
    return emit(classify.class_report(metrics(spark, sf), ["spec_id", "fold"]))


@query(
    "mean_class_report",
    sql(METRIC_SQL + ", result AS (SELECT class, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1, sum(support) AS support FROM per GROUP BY 1)",
        "class:s precision:d recall:d f1:d support:i"),
)
def mean_class_report(spark, sf):
    return emit(classify.mean_class_report(classify.class_report(metrics(spark, sf), ["spec_id", "fold"])))


@query(
    "pooled_confusion",
    sql(METRIC_SQL + f", result AS (SELECT spec_id, {', '.join(f'sum(n_{t}_{p}) AS n_{t}_{p}' for t in (1, 2, 3) for p in (1, 2, 3))} FROM base GROUP BY 1)", "spec_id:s " + CELL_COLS),
)
def pooled_confusion(spark, sf):
    return emit(classify.pooled_confusion(metrics(spark, sf), ["spec_id"]))


DIAG_SQL = SCORED_SQL + f""",
calls AS (SELECT *, p[1] >= threshold AND p[1] > p[3] AS u, p[3] >= threshold AND p[3] > p[1] AS d FROM said, (SELECT unnest([{", ".join(f"{t}e0" for t in THRESHOLDS)}]) AS threshold)),
diag AS (SELECT spec_id, fold, threshold, count(*) AS observations, count_if(u OR d) AS signals,
    CASE WHEN count_if(u OR d) > 0 THEN count_if((u AND label = 1) OR (d AND label = 3))::DOUBLE / count_if(u OR d) END AS directional_precision,
    count_if(u OR d)::DOUBLE / count(*) AS directional_coverage, 1 - count_if(u OR d)::DOUBLE / count(*) AS abstention_rate,
    CASE WHEN count_if(u) > 0 THEN count_if(u AND label = 1)::DOUBLE / count_if(u) END AS up_precision,
    CASE WHEN count_if(d) > 0 THEN count_if(d AND label = 3)::DOUBLE / count_if(d) END AS down_precision FROM calls GROUP BY ALL),
frontier AS (SELECT spec_id, threshold, avg(directional_precision) AS mean_directional_precision, min(directional_precision) AS worst_fold_directional_precision,
    avg(directional_coverage) AS mean_directional_coverage, avg(abstention_rate) AS mean_abstention_rate FROM diag GROUP BY ALL),
cand AS (SELECT threshold, avg(coalesce(directional_precision, 0)) AS mean_directional_precision, min(coalesce(directional_precision, 0)) AS worst_fold_directional_precision,
    avg(directional_coverage) AS mean_directional_coverage, 1 - avg(directional_coverage) AS mean_abstention_rate, avg(directional_coverage) >= 0.05 AS coverage_eligible, count(*) AS folds
  FROM diag WHERE spec_id = 'liquidity_pressure(temperature=0.1)' GROUP BY 1),
best AS (SELECT * FROM cand WHERE coverage_eligible ORDER BY mean_directional_precision DESC, worst_fold_directional_precision DESC, mean_directional_coverage DESC, threshold LIMIT 1)"""


def diagnostics(spark, sf):
    return classify.directional_diagnostics(scored(spark, sf), ["spec_id", "fold"], THRESHOLDS)


@query("directional_diagnostics", sql(DIAG_SQL, "spec_id:s fold:i threshold:d directional_precision:d directional_coverage:d abstention_rate:d signals:i observations:i up_precision:d down_precision:d", "diag"))
def directional_diagnostics(spark, sf):
    return emit(diagnostics(spark, sf))


FRONTIER_COLS = "threshold:d mean_directional_precision:d worst_fold_directional_precision:d mean_directional_coverage:d mean_abstention_rate:d"


@query("confidence_frontier", sql(DIAG_SQL, "spec_id:s " + FRONTIER_COLS, "frontier"))
def confidence_frontier(spark, sf):
    return emit(classify.confidence_frontier(diagnostics(spark, sf), ["spec_id"]))


def pressure_candidates(spark, sf):
    chosen = diagnostics(spark, sf).where("spec_id LIKE 'liquidity_pressure%'")
    return classify.threshold_candidates(chosen, 0.05)


@query("threshold_candidates", sql(DIAG_SQL, FRONTIER_COLS + " coverage_eligible:b folds:i", "cand"))
def threshold_candidates(spark, sf):
    return emit(pressure_candidates(spark, sf))


@query("chosen_threshold", sql(DIAG_SQL, FRONTIER_COLS + " coverage_eligible:b folds:i", "best"))
def chosen_threshold(spark, sf):
    return emit(classify.choose_threshold(pressure_candidates(spark, sf)))


ALT = " UNION ALL ".join(
    f"SELECT spec_id, fold, horizon_row, {c} AS c, count_if(lab = {c} AND predicted = {c})::DOUBLE AS hit, count_if(predicted = {c}) AS chosen, count_if(lab = {c}) AS support FROM alt GROUP BY 1, 2, 3"
    for c in (1, 2, 3)
)


@query(
    "alternate_horizons",
    sql(SCORED_SQL + f""", alt AS (SELECT spec_id, fold, predicted, unnest(range(1, 6)) AS horizon_row, unnest(labels) AS lab FROM said),
result AS (SELECT spec_id, fold, horizon_row, avg(CASE WHEN chosen + support > 0 THEN 2 * hit / (chosen + support) ELSE 0 END) AS macro_f1, sum(hit) / sum(support) AS accuracy FROM ({ALT}) GROUP BY 1, 2, 3)""",
        "spec_id:s fold:i horizon_row:i macro_f1:d accuracy:d"),
)
def alternate_horizons(spark, sf):
    return emit(classify.alternate_horizons(scored(spark, sf), ["spec_id", "fold"]))


FAMILIES = ["always_stationary", "class_prior", "liquidity_pressure", "diagonal_lda"]
RANK_SQL = METRIC_SQL + """,
spec AS (SELECT spec_id, CASE split_part(spec_id, '(', 1) WHEN 'always_stationary' THEN 0 WHEN 'class_prior' THEN 1 WHEN 'liquidity_pressure' THEN 2 ELSE 3 END AS complexity,
    avg(macro_f1) AS mean_macro_f1, min(macro_f1) AS worst_fold_macro_f1, max(macro_f1) AS best_fold_macro_f1, stddev_pop(macro_f1) AS std_macro_f1, count(*) AS folds FROM metrics GROUP BY 1),
ranking AS (SELECT *, row_number() OVER (ORDER BY mean_macro_f1 DESC, worst_fold_macro_f1 DESC, complexity, spec_id) AS place FROM spec),
family AS (SELECT *, split_part(spec_id, '(', 1) AS family, complexity AS family_order
  FROM ranking QUALIFY row_number() OVER (PARTITION BY complexity ORDER BY place) = 1),
port AS (SELECT spec_id, mean_macro_f1, std_macro_f1, worst_fold_macro_f1, best_fold_macro_f1, bb AS best_baseline_mean_macro_f1, bm AS best_manual_mean_macro_f1, mean_macro_f1 - bb AS uplift_vs_best_baseline
  FROM ranking, (SELECT max(mean_macro_f1) FILTER (complexity <= 1) AS bb, max(mean_macro_f1) FILTER (complexity >= 2) AS bm FROM ranking) WHERE place = 1)"""
RANK_COLS = "spec_id:s complexity:i mean_macro_f1:d worst_fold_macro_f1:d best_fold_macro_f1:d std_macro_f1:d folds:i place:i"


def ranking(spark, sf):
    return classify.rank_candidates(metrics(spark, sf))


@query("candidate_ranking", sql(RANK_SQL, RANK_COLS, "ranking"))
def candidate_ranking(spark, sf):
    return emit(ranking(spark, sf))


@query("best_per_family", sql(RANK_SQL, RANK_COLS + " family:s family_order:i", "family"))
def best_per_family(spark, sf):
    return emit(classify.best_per_family(ranking(spark, sf), FAMILIES))


@query(
    "portfolio_metrics",
    sql(RANK_SQL, "spec_id:s mean_macro_f1:d std_macro_f1:d worst_fold_macro_f1:d best_fold_macro_f1:d best_baseline_mean_macro_f1:d best_manual_mean_macro_f1:d uplift_vs_best_baseline:d", "port"),
)
def portfolio_metrics(spark, sf):
    return emit(classify.portfolio(ranking(spark, sf), ["always_stationary", "class_prior"], ["liquidity_pressure", "diagonal_lda"]))


@query(
    "probability_forms",
    sql(SNAP_SQL + """, z AS (SELECT obs_id, [features[1] * 400e0, features[2] * 3e0, -features[3] * 900e0] AS z FROM snap),
l AS (SELECT *, list_transform(z, lambda x: -(ln(1 + exp(-abs(x))) + greatest(-x, 0))) AS g FROM z),
result AS (SELECT obs_id, exp(z[1] - list_max(z)) / list_sum(list_transform(z, lambda x: exp(x - list_max(z)))) AS soft_up,
    exp(g[1] - list_max(g)) / list_sum(list_transform(g, lambda x: exp(x - list_max(g)))) AS ovr_up, list_position(z, list_max(z)) AS top FROM l)""",
        "obs_id:i soft_up:d ovr_up:d top:i"),
)
def probability_forms(spark, sf):
    f = lambda i: F.element_at("features", i).cast("double")
    z = F.array(f(1) * 400.0, f(2) * 3.0, -f(3) * 900.0)
    rows = snapshots(spark, sf).withColumn("z", z)
    return emit(
        rows.select(
            "obs_id", softmax(F.col("z"))[0].alias("soft_up"),
            one_vs_rest_probabilities(F.col("z"))[0].alias("ovr_up"), top_class(F.col("z")).alias("top"),
        )
    )


HELD_SQL = METRIC_SQL + """,
places AS (SELECT spec_id, avg(macro_f1) AS dev FROM metrics WHERE fold < 5 GROUP BY 1
  ORDER BY avg(macro_f1) DESC, min(macro_f1) DESC, CASE split_part(spec_id, '(', 1) WHEN 'always_stationary' THEN 0 WHEN 'class_prior' THEN 1 WHEN 'liquidity_pressure' THEN 2 ELSE 3 END, spec_id LIMIT 1),
held AS (SELECT spec_id, observations, dev AS development_macro_f1, macro_f1 AS holdout_macro_f1, dev - macro_f1 AS gap_macro_f1, balanced_accuracy AS holdout_balanced_accuracy, mcc AS holdout_mcc, log_loss AS holdout_log_loss
  FROM metrics JOIN places USING (spec_id) WHERE fold = 5)"""


@query(
    "snapshot_held_out",
    sql(HELD_SQL, "spec_id:s observations:i development_macro_f1:d holdout_macro_f1:d gap_macro_f1:d holdout_balanced_accuracy:d holdout_mcc:d holdout_log_loss:d", "held"),
)
def snapshot_held_out(spark, sf):
    return emit(classify.held_out(scored(spark, sf), 5))


UPLIFT_SQL = RANK_SQL + """, lifted AS (SELECT min_by(spec_id, place) FILTER (complexity >= 2) AS spec_id, max(mean_macro_f1) FILTER (complexity >= 2) AS mean_macro_f1,
  max(mean_macro_f1) FILTER (complexity < 2) AS best_other_mean_macro_f1, max(mean_macro_f1) FILTER (complexity >= 2) - max(mean_macro_f1) FILTER (complexity < 2) AS uplift FROM ranking)"""


@query("family_uplift", sql(UPLIFT_SQL, "spec_id:s mean_macro_f1:d best_other_mean_macro_f1:d uplift:d", "lifted"))
def family_uplift(spark, sf):
    return emit(classify.uplift_of(ranking(spark, sf), ["liquidity_pressure", "diagonal_lda"]))


WINNER_SQL = RANK_SQL + ", " + DIAG_SQL.split("said AS", 1)[1].split(",\n", 1)[1].replace("spec_id = 'liquidity_pressure(temperature=0.1)'", "spec_id = (SELECT spec_id FROM ranking WHERE place = 1)")


@query("winner_thresholds", sql(WINNER_SQL, FRONTIER_COLS + " coverage_eligible:b folds:i", "cand"))
def winner_thresholds(spark, sf):
    """Threshold candidates of the specification that ranks first."""
    winner = ranking(spark, sf).where("place = 1").select("spec_id")
    own = diagnostics(spark, sf).join(F.broadcast(winner), "spec_id", "left_semi")  # one row
    return emit(classify.threshold_candidates(own, 0.05))
