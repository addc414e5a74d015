"""Folds, sampling, information coefficients, quantile tables, bootstrap and regression metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import book as book_checks
from checks.inputs import AUCTION, SNAP_SQL, auction_panel, snapshots
from checks.panel import ROW_SQL
from checks.shape import emit, sql
from tidebook.operators import folds, panel, stats

QUERIES, SQL = {}, {}


def query(name, text=None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return add


PREDICTION = "auction_imbalance_ratio * 5 - book_size_imbalance"
SCORED_SQL = ROW_SQL + f", scored AS (SELECT *, {PREDICTION} AS prediction FROM r3)"
SCORED_COLUMNS = [
    "stock_id", "date_id", "seconds_in_bucket", "time_id", "target", "time_remaining_seconds",
    "auction_imbalance_ratio",
]


def scored(spark, sf):
    rows = panel.with_row_features(auction_panel(spark, sf), AUCTION)
    return rows.withColumn("prediction", F.expr(PREDICTION)).select(*SCORED_COLUMNS, "prediction")


@query(
    "scored_projection",
    sql(SCORED_SQL, " ".join(f"{c}:{'d' if c in ('target', 'auction_imbalance_ratio') else 'i'}" for c in SCORED_COLUMNS) + " prediction:d", "scored"),
)
def scored_projection(spark, sf):
    return emit(scored(spark, sf))


@query(
    "labeled_rows",
    sql(ROW_SQL + ", result AS (SELECT date_id, count(*) AS rows FROM r3 WHERE target IS NOT NULL AND isfinite(target) GROUP BY 1)", "date_id:i rows:i"),
)
def labeled_rows(spark, sf):
    return emit(stats.labeled_rows(auction_panel(spark, sf)).groupBy("date_id").agg(F.count("*").alias("rows")))


# --- Folds and sampling ----------------------------------------------------------------------------

FOLDS_SQL = ROW_SQL + """,
dates AS (SELECT DISTINCT date_id FROM panel),
later AS (SELECT date_id, ntile(3) OVER (ORDER BY date_id) AS fold FROM (
    SELECT date_id, row_number() OVER (ORDER BY date_id) AS i FROM dates) WHERE i > 2),
folds AS (SELECT fold, 'validation' AS role, date_id FROM later
  UNION ALL SELECT fold, 'train', d.date_id FROM dates d JOIN (SELECT fold, min(date_id) AS s FROM later GROUP BY 1) ON d.date_id < s)"""


def date_folds(spark, sf):
    return folds.expanding_folds(auction_panel(spark, sf), "date_id", 2, 3)


@query("expanding_folds", sql(FOLDS_SQL, "fold:i role:s date_id:i", "folds"))
def expanding_folds(spark, sf):
    return emit(date_folds(spark, sf))


@query(
    "fold_isolation",
    sql(
        FOLDS_SQL + """, result AS (SELECT fold, max(date_id) FILTER (role = 'train') AS last_train, min(date_id) FILTER (role = 'validation') AS first_validation,
    count(*) - count(DISTINCT date_id) AS shared_dates, max(date_id) FILTER (role = 'train') < min(date_id) FILTER (role = 'validation') AS isolated FROM folds GROUP BY 1)""",
        "fold:i last_train:i first_validation:i shared_dates:i isolated:b",
    ),
)
def fold_isolation(spark, sf):
    return emit(folds.fold_isolation(date_folds(spark, sf), "date_id"))


@query(
    "fold_rows",
    sql(
        FOLDS_SQL + """, result AS (SELECT date_id, count(*) AS rows, sum(matched_size) AS matched FROM panel
    WHERE date_id IN (SELECT date_id FROM folds WHERE fold = 2 AND role = 'validation') GROUP BY 1)""",
        "date_id:i rows:i matched:d",
    ),
)
def fold_rows(spark, sf):
    rows = folds.rows_in(auction_panel(spark, sf), date_folds(spark, sf), 2, "validation", "date_id")
    return emit(rows.groupBy("date_id").agg(F.count("*").alias("rows"), F.sum("matched_size").alias("matched")))


@query(
    "paired_members",
    sql(
        SNAP_SQL + """, result AS (SELECT fold, CASE WHEN block < fold + 4 THEN 'train' ELSE 'test' END AS split, count(*) AS rows, min(obs_id) AS first_obs, max(obs_id) AS last_obs
    FROM snap, (SELECT unnest(range(1, 6)) AS fold) WHERE block <= fold + 4 GROUP BY ALL)""",
        "fold:i split:s rows:i first_obs:i last_obs:i",
    ),
)
def paired_members(spark, sf):
    members = folds.paired_members(snapshots(spark, sf), "block", 5, 5)
    return emit(
        members.groupBy("fold", "split").agg(
            F.count("*").alias("rows"), F.min("obs_id").alias("first_obs"), F.max("obs_id").alias("last_obs")
        )
    )


SAMPLE_SQL = ROW_SQL + """,
placed AS (SELECT date_id, seconds_in_bucket, stock_id, row_number() OVER w - 1 AS p, count(*) OVER (PARTITION BY date_id) AS n
  FROM panel WINDOW w AS (PARTITION BY date_id ORDER BY seconds_in_bucket, stock_id)),
wanted AS (SELECT DISTINCT date_id, CAST(floor(CASE WHEN k = 499 THEN n - 1 ELSE k * ((n - 1) / 499e0) END) AS BIGINT) AS p FROM (SELECT DISTINCT date_id, n FROM placed), (SELECT unnest(range(500)) AS k)),
result AS (SELECT p.* FROM placed p WHERE n <= 500 OR (date_id, p.p) IN (SELECT (date_id, p) FROM wanted))"""


@query("even_sample", sql(SAMPLE_SQL, "date_id:i seconds_in_bucket:i stock_id:i"))
def even_sample(spark, sf, limit=None):
    rows = auction_panel(spark, sf).select("date_id", "seconds_in_bucket", "stock_id")
    return emit(folds.even_sample(rows, ["date_id"], ["seconds_in_bucket", "stock_id"], 500, limit))


@query("even_sample_blocked", SQL["even_sample"])
def even_sample_blocked(spark, sf):
    return even_sample(spark, sf, 1000)


@query(
    "fit_pool",
    sql(
        SAMPLE_SQL + """, pool AS (SELECT split, count(*) AS rows, avg(target) AS mean_target FROM (
    SELECT CASE WHEN date_id <= 3 THEN 'train' WHEN date_id <= 4 THEN 'validation' ELSE 'holdout' END AS split, target
    FROM panel JOIN result USING (date_id, seconds_in_bucket, stock_id)) GROUP BY 1)""",
        "split:s rows:i mean_target:d",
        "pool",
    ),
)
def fit_pool(spark, sf):
    rows = auction_panel(spark, sf).select("date_id", "seconds_in_bucket", "stock_id", "target")
    pool = folds.even_sample(rows, ["date_id"], ["seconds_in_bucket", "stock_id"], 500)
    split = F.when(F.col("date_id") <= 3, "train").when(F.col("date_id") <= 4, "validation").otherwise("holdout")
    return emit(pool.groupBy(split.alias("split")).agg(F.count("*").alias("rows"), F.avg("target").alias("mean_target")))


# --- Rank correlation ------------------------------------------------------------------------------

def spearman_sql(source, keys, x, y, name="ic", distinct_from=None):
    by = ", ".join(keys) if keys else "0"
    group = f"GROUP BY {by}" if keys else ""
    sel = f"{by}, " if keys else ""
    return f"""{name}_r AS (SELECT {sel}rank() OVER (PARTITION BY {by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {by}, {x}) - 1) / 2e0 AS rx,
    rank() OVER (PARTITION BY {by} ORDER BY {y}) + (count(*) OVER (PARTITION BY {by}, {y}) - 1) / 2e0 AS ry
  FROM {source} WHERE {x} IS NOT NULL AND {y} IS NOT NULL),
{name} AS (SELECT {sel}count(*) AS rows, CASE WHEN count(*) >= 2 AND min(rx) < max(rx) AND min(ry) < max(ry) THEN corr(rx, ry) END AS spearman_ic FROM {name}_r {group})"""


@query("spearman_overall", sql(SCORED_SQL + "," + spearman_sql("scored", [], "prediction", "target"), "rows:i spearman_ic:d", "ic"))
def spearman_overall(spark, sf, limit=None):
    from tidebook.operators.order_stats import spearman

    return emit(spearman(scored(spark, sf), [], "prediction", "target", limit=limit))


@query("spearman_overall_blocked", SQL["spearman_overall"])
def spearman_overall_blocked(spark, sf):
    return spearman_overall(spark, sf, 3000)


@query("daily_ic", sql(SCORED_SQL + "," + spearman_sql("scored", ["date_id"], "prediction", "target"), "date_id:i rows:i spearman_ic:d", "ic"))
def daily_ic(spark, sf, limit=None):
    from tidebook.operators.order_stats import spearman

    return emit(spearman(scored(spark, sf), ["date_id"], "prediction", "target", limit=limit))


@query("daily_ic_blocked", SQL["daily_ic"])
def daily_ic_blocked(spark, sf):
    return daily_ic(spark, sf, 1500)


FEATURES = ["queue_imbalance_l1", "depth_imbalance_l5", "ofi_900000ms"]
TARGETS = ["target_300000ms_ticks", "target_1800000ms_ticks"]
IC_SQL = book_checks.TRIMMED_SQL + ", pairs AS (" + " UNION ALL ".join(
    f"SELECT session_date, '{f}' AS feature, '{t}' AS target, {f} AS x, {t} AS y FROM trimmed" for f in FEATURES for t in TARGETS
) + ")," + spearman_sql("pairs", ["session_date", "feature", "target"], "x", "y")


def ic_table(spark, sf):
    return stats.feature_ic(book_checks.decision_table(spark, sf), ["session_date"], FEATURES, TARGETS)


@query("feature_ic_table", sql(IC_SQL, "session_date:s feature:s target:s rows:i spearman_ic:d", "ic"))
def feature_ic_table(spark, sf):
    return emit(ic_table(spark, sf))


def bootstrap_sql(source, keys, cluster, value, reps, seed=0):
    by = ", ".join(keys)
    sel = f"{by}, " if keys else ""
    part = f"PARTITION BY {by}" if keys else ""
    group = f"GROUP BY {by}" if keys else ""
    using = lambda extra: f"USING ({', '.join([*keys, *extra])})" if keys or extra else ""
    return f"""num AS (SELECT {sel}row_number() OVER ({part} ORDER BY {cluster}) - 1 AS i, {value} AS v FROM {source} WHERE {value} IS NOT NULL),
size AS (SELECT {sel}count(*) AS n, avg(v) AS mean FROM num {group}),
draws AS (SELECT {sel}b, ('0x' || substr(md5('{seed}-' || b || '-' || j), 1, 8))::BIGINT % n AS i FROM (
    SELECT {sel}n, b, unnest(range(n)) AS j FROM size, (SELECT unnest(range({reps})) AS b) WHERE n >= 2)),
means AS (SELECT {sel}b, avg(v) AS m FROM draws JOIN num {using(['i'])} GROUP BY {sel}b),
bounds AS (SELECT {sel}quantile_cont(m, 0.025) AS lower, quantile_cont(m, 0.975) AS upper FROM means {group}),
boot AS (SELECT {sel}n AS clusters, mean AS estimate, lower, upper FROM size {"LEFT JOIN bounds " + using([]) if keys else ", bounds"})"""


@query(
    "feature_ic_bootstrap",
    sql(IC_SQL + "," + bootstrap_sql("ic", ["feature", "target"], "session_date", "spearman_ic", 2000), "feature:s target:s clusters:i estimate:d lower:d upper:d", "boot"),
)
def feature_ic_bootstrap(spark, sf):
    return emit(stats.cluster_bootstrap(ic_table(spark, sf), ["feature", "target"], "session_date", "spearman_ic", 2000))


BY_DATE = "clusters AS (SELECT o_orderdate, avg(CAST(round(o_totalprice * 100) AS BIGINT)) / 100 AS v FROM orders GROUP BY 1)"


@query("cluster_bootstrap", sql(BY_DATE + "," + bootstrap_sql("clusters", [], "o_orderdate", "v", 2000), "clusters:i estimate:d lower:d upper:d", "boot", 4))
def cluster_bootstrap(spark, sf):
    from checks.inputs import table

    days = table(spark, sf, "orders").groupBy("o_orderdate").agg(
        (F.avg(F.expr("cast(round(o_totalprice * 100) AS bigint)")) / 100).alias("v")
    )
    return emit(stats.cluster_bootstrap(days, [], "o_orderdate", "v", 2000), 4)


# --- Quantile tables -------------------------------------------------------------------------------

TENTHS = "[" + ", ".join(str(i / 10) for i in range(1, 10)) + "]"
EDGES_SQL = SCORED_SQL + f""",
edges AS (SELECT list_sort(list_distinct(quantile_cont(prediction, {TENTHS}))) AS edges FROM scored WHERE date_id <= 3)"""


def fitted_edges(spark, sf, limit=None):
    train = scored(spark, sf).where("date_id <= 3")
    return stats.quantile_edges(train, "prediction", 10, limit=limit)


@query("quantile_edges", sql(EDGES_SQL + ", result AS (SELECT unnest(range(len(edges))) AS edge, unnest(edges) AS edge_value FROM edges)", "edge:i edge_value:d"))
def quantile_edges(spark, sf, limit=None):
    return emit(fitted_edges(spark, sf, limit).select(F.posexplode("edges").alias("edge", "edge_value")))


@query("quantile_edges_blocked", SQL["quantile_edges"])
def quantile_edges_blocked(spark, sf):
    return quantile_edges(spark, sf, 700)


BINNED_SQL = EDGES_SQL + """,
binned AS (SELECT date_id, len(list_filter(edges, lambda e: e < prediction)) AS bin, target FROM scored, edges WHERE date_id > 3 AND prediction IS NOT NULL AND target IS NOT NULL),
bins AS (SELECT bin, count(*) AS rows, avg(target) AS mean_target, quantile_cont(target, 0.5) AS median_target FROM binned GROUP BY 1),
daily AS (SELECT date_id, bin, count(*) AS rows, avg(target) AS mean_target FROM binned GROUP BY ALL),
pooled AS (SELECT bin, sum(rows) AS rows, sum(rows * mean_target) / sum(rows) AS mean_target, count(DISTINCT date_id) AS sessions FROM daily GROUP BY 1)"""


@query("quantile_table", sql(BINNED_SQL, "bin:i rows:i mean_target:d median_target:d", "bins"))
def quantile_table(spark, sf, limit=None):
    later = scored(spark, sf).where("date_id > 3")
    return emit(stats.quantile_table(later, fitted_edges(spark, sf, limit), "prediction", "target", limit=limit))


@query("quantile_table_blocked", SQL["quantile_table"])
def quantile_table_blocked(spark, sf):
    return quantile_table(spark, sf, 800)


@query("pooled_bins", sql(BINNED_SQL, "bin:i rows:i mean_target:d sessions:i", "pooled"))
def pooled_bins(spark, sf):
    later = scored(spark, sf).where("date_id > 3")
    edges = later.select("date_id").distinct().crossJoin(F.broadcast(fitted_edges(spark, sf)))
    daily = stats.quantile_table(later, edges, "prediction", "target", ["date_id"])
    return emit(stats.pooled_bins(daily, "date_id"))


DECILE_SQL = SCORED_SQL + f""",
usable AS (SELECT prediction, target FROM scored WHERE prediction IS NOT NULL AND target IS NOT NULL),
e AS (SELECT list_filter(list_distinct(q), lambda v: v > lo AND v < hi) AS edges FROM (SELECT quantile_cont(prediction, {TENTHS}) AS q, min(prediction) AS lo, max(prediction) AS hi FROM usable)),
binned AS (SELECT len(list_filter(edges, lambda v: v < prediction)) AS bin, target FROM usable, e),
bins AS (SELECT bin, count(*) AS rows, avg(target) AS mean_target, quantile_cont(target, 0.5) AS median_target FROM binned GROUP BY 1)"""


@query("prediction_deciles", sql(DECILE_SQL, "bin:i rows:i mean_target:d median_target:d", "bins"))
def prediction_deciles(spark, sf):
    usable = stats.labeled_rows(scored(spark, sf)).where("prediction IS NOT NULL")
    edges = stats.quantile_edges(usable, "prediction", 10, open_ends=False)
    return emit(stats.quantile_table(usable, edges, "prediction", "target"))


# --- Metrics ---------------------------------------------------------------------------------------

def metric_sql(source, keys, y, p, name):
    by = ", ".join(keys)
    agree = f"avg(CASE WHEN {y} <> 0 THEN (sign({y}) = sign({p}))::INT END)"
    return f"""{name} AS (SELECT {by}, count(*) AS rows, avg(abs({y} - {p})) AS mae, sqrt(avg(({y} - {p}) * ({y} - {p}))) AS rmse,
    CASE WHEN stddev_pop({p}) > 0 AND stddev_pop({y}) > 0 THEN covar_pop({p}, {y}) / (stddev_pop({p}) * stddev_pop({y})) END AS correlation,
    {agree} AS directional_accuracy FROM {source} WHERE {y} IS NOT NULL AND {p} IS NOT NULL GROUP BY {by})"""


@query("regression_metrics", sql(SCORED_SQL + "," + metric_sql("scored", ["date_id"], "target", "prediction", "m"), "date_id:i rows:i mae:d rmse:d correlation:d directional_accuracy:d", "m"))
def regression_metrics(spark, sf):
    rows = scored(spark, sf).dropna(subset=["target", "prediction"])
    return emit(stats.regression_metrics(rows, ["date_id"], "target", "prediction"))


def predictive_sql(source, keys):
    return (
        metric_sql(source, keys, "target", "prediction", "m")
        + ","
        + spearman_sql(source, keys, "target", "prediction")
        + f", pm AS (SELECT {', '.join(keys)}, m.rows, mae, spearman_ic, directional_accuracy FROM m JOIN ic USING ({', '.join(keys)}))"
    )


@query("daily_predictive_metrics", sql(SCORED_SQL + "," + predictive_sql("scored", ["date_id"]), "date_id:i rows:i mae:d spearman_ic:d directional_accuracy:d", "pm"))
def daily_predictive_metrics(spark, sf):
    return emit(stats.predictive_metrics(scored(spark, sf), ["date_id"], "target", "prediction"))


REGIME_SQL = SCORED_SQL + """,
reg AS (SELECT target, prediction, 'time_remaining_seconds' AS dimension, CASE WHEN time_remaining_seconds <= 120 THEN 'up to 120' WHEN time_remaining_seconds <= 300 THEN '120 to 300' ELSE 'above 300' END AS regime FROM scored
  UNION ALL SELECT target, prediction, 'auction_imbalance_ratio', CASE WHEN abs(auction_imbalance_ratio) <= 0.05 THEN 'up to 0.05' WHEN abs(auction_imbalance_ratio) <= 0.2 THEN '0.05 to 0.2' ELSE 'above 0.2' END FROM scored WHERE auction_imbalance_ratio IS NOT NULL)"""


@query("stability_table", sql(REGIME_SQL + "," + predictive_sql("reg", ["dimension", "regime"]), "dimension:s regime:s rows:i mae:d spearman_ic:d directional_accuracy:d", "pm"))
def stability_table(spark, sf):
    return emit(stats.stability_table(scored(spark, sf), "target", "prediction"))
