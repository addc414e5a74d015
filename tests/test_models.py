import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import classify, closed_form, linear_classifiers, panel_models, stats
from tidebook.functions.scalars import one_vs_rest_probabilities
from tidebook.plans.snapshot_study import balanced_ridge_scores


def vectors(seed=0, rows=240, width=6):
    rng = np.random.default_rng(seed)
    y = rng.integers(1, 4, rows)
    x = rng.normal(size=(rows, width)) + 3.0
    x[:, 0] += y
    x[:, 1] -= 2 * (y == 2)
    return x.astype(np.float32).astype(float), y


def frame(spark, x, y):
    rows = [(i, i * 10 // len(y), [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, "obs_id long, block int, features array<float>, label int").repartition(3)


def softmax(z):
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def probabilities(df):
    rows = sorted(df.select("obs_id", "probabilities").collect())
    return np.array([r["probabilities"] for r in rows])


def test_scaled_ridge_matches_normal_equations(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(5, [1, 2, 30], size=(200, 3))
    y = x @ [1.0, -2.0, 0.1] + rng.normal(size=200) + 7
    df = spark.createDataFrame([(int(i % 4), *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))], "d int, a double, b double, c double, y double")
    grams = closed_form.gram_by_group(df, ["d"], ["a", "b", "c", "y"])
    assert len(grams) == 4
    beta, bias = closed_form.ridge_from_gram(sum(grams.values()), [0, 1, 2], 3, 2.5)
    z = (x - x.mean(0)) / x.std(0)
    want = np.linalg.solve(z.T @ z + 2.5 * np.eye(3), z.T @ (y - y.mean()))
    np.testing.assert_allclose(beta * x.std(0), want, rtol=1e-8)
    np.testing.assert_allclose(x @ beta + bias, z @ want + y.mean(), rtol=1e-8)


def test_balanced_ridge_matches_weighted_normal_equations(spark):
    x, y = vectors()
    df = frame(spark, x, y)
    got = probabilities(balanced_ridge_scores(df, df.where("block = 9").withColumn("fold", F.lit(1)), "block", [(1, 9)], 6, 0.7))
    block = np.arange(len(y)) * 10 // len(y)
    xt, yt = x[block < 9], y[block < 9]
    mean, scale = xt.mean(0), xt.std(0)
    z = np.column_stack([(xt - mean) / scale, np.ones(len(xt))])
    w = np.array([len(yt) / (3 * (yt == c).sum()) for c in yt])
    penalty = 0.7 * np.eye(7)
    penalty[-1, -1] = 0
    coef = np.linalg.solve((z * w[:, None]).T @ z + penalty, (z * w[:, None]).T @ np.eye(3)[yt - 1])
    zt = np.column_stack([(x[block == 9] - mean) / scale, np.ones((block == 9).sum())])
    np.testing.assert_allclose(got, softmax(zt @ coef), rtol=1e-7)


def test_diagonal_lda_matches_numpy(spark):
    x, y = vectors(2)
    df = frame(spark, x, y)
    moments = closed_form.block_moments(df, "block")
    table = closed_form.linear_model_table(closed_form.lda_parameters(moments, "block", [(1, 8)], 0.1))
    got = probabilities(closed_form.linear_probabilities(df.where("block = 8").withColumn("fold", F.lit(1)), table))
    block = np.arange(len(y)) * 10 // len(y)
    xt, yt = x[block < 8], y[block < 8]
    means = np.array([xt[yt == c].mean(0) for c in (1, 2, 3)])
    pooled = sum(xt[yt == c].var(0, ddof=1) * ((yt == c).sum() - 1) for c in (1, 2, 3)) / (len(yt) - 3)
    var = np.maximum(0.9 * pooled + 0.1 * pooled.mean(), 1e-6)
    logits = x[block == 8] @ (means / var).T - 0.5 * (means**2 / var).sum(1)
    np.testing.assert_allclose(got, softmax(logits), rtol=1e-6)


def test_panel_ridge_matches_dense_one_hot(spark):
    rng = np.random.default_rng(4)
    n, stocks, alpha = 300, 7, 3.0
    x = rng.normal(2, 3, size=(n, 2))
    x[::11, 1] = np.nan
    s = rng.integers(0, stocks, n)
    y = np.nan_to_num(x) @ [0.5, -1.0] + s * 0.3 + rng.normal(size=n)
    rows = [(int(k), float(a), None if np.isnan(b) else float(b), float(t)) for k, (a, b), t in zip(s, x, y)]
    df = spark.createDataFrame(rows, "stock_id long, a double, b double, target double")
    medians = panel_models.feature_medians(df, ["a", "b"])
    part = F.when(F.col("a") > 2, 1).otherwise(0)  # sums of two parts
    sums = panel_models.PanelMoments(df, part, ["a", "b"], "target", medians[()] - 0.7)
    case = panel_models.RidgeCase("all", (0, 1), alpha, ())
    model = panel_models.fit_panel_ridges(sums, [case], medians)
    filled = np.where(np.isnan(x), np.nanmedian(x, axis=0), x)
    z = (filled - filled.mean(0)) / filled.std(0)
    design = np.column_stack([z, np.eye(stocks)[s], np.ones(n)])
    penalty = alpha * np.eye(design.shape[1])
    penalty[-1, -1] = 0
    beta = np.linalg.solve(design.T @ design + penalty, design.T @ y)
    got = sorted((r["target"], r["prediction"]) for r in model.predict(df, {0: [0]}).collect())
    np.testing.assert_allclose([p for _, p in got], [p for _, p in sorted(zip(y, design @ beta))], rtol=1e-8)
    unknown = spark.createDataFrame([(99, 1.0, 1.0)], "stock_id long, a double, b double")
    assert model.predict(unknown, {0: [0]}).first()["prediction"] is not None
    fitted = panel_models.fit_preprocessing(df, ["a", "b"])
    for kind in ("median", "mean", "scale"):
        np.testing.assert_allclose(getattr(model.preprocessing[0], kind), getattr(fitted, kind), rtol=1e-9)


def test_panel_ridge_cases_equal_fits_of_their_own(spark):
    """Folds, left-out features and frozen preprocessing from one set of sums, each against a dense solution."""
    rng = np.random.default_rng(5)
    n, stocks = 400, 9
    x = rng.normal([5, -100, 0.01], [1, 30, 0.002], size=(n, 3))
    x[rng.random((n, 3)) < 0.1] = np.nan
    s, part = rng.integers(0, stocks, n), np.arange(n) * 3 // n
    y = np.where(rng.random(n) < 0.1, np.nan, np.nan_to_num(x) @ [1.0, 0.1, 50.0] + s + rng.normal(size=n))
    null = lambda v: None if np.isnan(v) else float(v)
    rows = [(int(k), int(p), null(t), *map(null, v)) for k, p, t, v in zip(s, part, y, x)]
    df = spark.createDataFrame(rows, "stock_id long, p int, target double, a double, b double, c double")
    names = ["a", "b", "c"]
    labeled = df.where("target IS NOT NULL")
    both = {(1,): labeled.where("p = 0"), (2,): labeled.where("p <= 1"), (3,): df.where("p = 0")}
    medians = {k: panel_models.feature_medians(v, names)[()] for k, v in both.items()}
    cases = [
        panel_models.RidgeCase("fold1", (0,), 2.0, (1,)),
        panel_models.RidgeCase("fold2", (0, 1), 0.5, (2,)),
        panel_models.RidgeCase("no_b", (0, 1), 0.5, (2,), use=("a", "c")),
        panel_models.RidgeCase("frozen", (0, 1), 1.0, (3,), prep=(0,), unlabeled=True),
    ]
    sums = panel_models.PanelMoments(df, F.col("p"), names, "target", medians[(2,)])
    models = panel_models.fit_panel_ridges(sums, cases, medians)
    held = spark.createDataFrame([r for r in rows if r[1] == 2], df.schema)
    got = {}
    for r in models.predict(held, {0: range(4)}).collect():
        got.setdefault(r["case"], []).append(r["prediction"])
    for case, prep_rows in zip(cases, (part < 1, part < 2, part < 2, part < 1)):
        fits = np.isin(part, case.parts) & ~np.isnan(y)
        base = prep_rows if case.unlabeled else prep_rows & ~np.isnan(y)
        m = np.nanmedian(x[base], axis=0)
        filled = np.where(np.isnan(x), m, x)
        z = (filled - filled[base].mean(0)) / filled[base].std(0)
        use = [i for i, f in enumerate(names) if case.use is None or f in case.use]
        dense = np.column_stack([z[:, use], np.eye(stocks)[s], np.ones(n)])
        penalty = case.alpha * np.eye(dense.shape[1])
        penalty[-1, -1] = 0
        beta = np.linalg.solve(dense[fits].T @ dense[fits] + penalty, dense[fits].T @ y[fits])
        want = (dense @ beta)[part == 2]
        np.testing.assert_allclose(sorted(got[case.name]), sorted(want), rtol=1e-7)


def test_all_missing_feature_is_kept_as_zero(spark):
    df = spark.createDataFrame([(1.0, None), (3.0, None), (10.0, None)], "a double, b double")
    prep = panel_models.fit_preprocessing(df, ["a", "b"])
    assert prep.median == (3.0, 0.0) and prep.scale[1] == 1.0


def test_slopes(spark):
    df = spark.createDataFrame([(x, 2.0 * x) for x in (-2.0, -1.0, 1.0, 2.0)], "x double, target double")
    assert closed_form.slope_through_origin(df, [], "x", "target").first()["slope"] == 2.0
    fit = closed_form.single_feature_slopes(df, [], ["x"], "target").first()
    assert fit["slope"] == pytest.approx(2.0) and fit["intercept"] == pytest.approx(0.0)


def metric_rows(spark, y, p):
    rows = [(int(c), [float(v) for v in r]) for c, r in zip(y, p)]
    return spark.createDataFrame(rows, "label int, probabilities array<double>")


def test_metrics_match_definitions(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(1, 4, 200)
    p = rng.dirichlet([1, 1, 1], 200)
    got = classify.classification_metrics(metric_rows(spark, y, p).withColumn("k", F.lit(1)), ["k"]).first()
    said = p.argmax(1) + 1
    c = np.array([[((y == t) & (said == q)).sum() for q in (1, 2, 3)] for t in (1, 2, 3)])
    f1 = [2 * c[i, i] / (c[i].sum() + c[:, i].sum()) for i in range(3)]
    assert got["macro_f1"] == pytest.approx(np.mean(f1))
    assert got["balanced_accuracy"] == pytest.approx(np.mean([c[i, i] / c[i].sum() for i in range(3)]))
    t, q, s = c.sum(1), c.sum(0), c.sum()
    assert got["mcc"] == pytest.approx((np.trace(c) * s - q @ t) / np.sqrt((s * s - q @ q) * (s * s - t @ t)))
    assert got["log_loss"] == pytest.approx(-np.log(p[np.arange(200), y - 1]).mean())


def test_constant_prediction_has_zero_mcc_and_absent_class_is_skipped(spark):
    p = [[0.0, 1.0, 0.0]] * 4
    got = classify.classification_metrics(metric_rows(spark, [1, 2, 2, 1], p).withColumn("k", F.lit(1)), ["k"]).first()
    assert got["mcc"] == 0.0 and got["balanced_accuracy"] == 0.5


def test_undefined_precision_is_skipped_in_frontier_and_zero_in_choice(spark):
    rows = [(1, 1, [0.9, 0.05, 0.05]), (1, 1, [0.1, 0.8, 0.1]), (2, 1, [0.3, 0.4, 0.3])]
    scored = spark.createDataFrame(rows, "fold int, label int, probabilities array<double>")
    diag = classify.directional_diagnostics(scored, ["fold"], [0.5])
    assert classify.confidence_frontier(diag).first()["mean_directional_precision"] == 1.0
    assert classify.threshold_candidates(diag, 0.1).first()["mean_directional_precision"] == 0.5


def test_equal_up_and_down_abstains(spark):
    scored = spark.createDataFrame([(1, 1, [0.5, 0.0, 0.5])], "fold int, label int, probabilities array<double>")
    assert classify.directional_diagnostics(scored, ["fold"], [0.4]).first()["signals"] == 0


def test_ranking_ties(spark):
    rows = [("b", 2, 0.5), ("b", 2, 0.7), ("a", 1, 0.6), ("a", 1, 0.6), ("c", 1, 0.6), ("c", 1, 0.6)]
    got = classify.rank_candidates(spark.createDataFrame(rows, "spec_id string, complexity int, macro_f1 double"))
    assert [r["spec_id"] for r in got.orderBy("place").collect()] == ["a", "c", "b"]


def test_saturated_scores_stay_finite(spark):
    df = spark.createDataFrame([([-2000.0, -1000.0, -3000.0],)], "z array<double>")
    got = df.select(one_vs_rest_probabilities(F.col("z"))).first()[0]
    assert got == pytest.approx([0.0, 1.0, 0.0])


def test_weights_balance(spark):
    x, y = vectors(6, 300)
    y[:120] = 2
    weighed = classify.class_weights(frame(spark, x, y), [])
    assert sum(r["weight"] * r["n"] for r in weighed.collect()) == pytest.approx(300)


def test_bootstrap_is_deterministic_and_covers_the_mean(spark):
    df = spark.createDataFrame([(i, float(i % 7)) for i in range(40)], "d long, v double")
    one = stats.cluster_bootstrap(df, [], "d", "v", 200).first()
    two = stats.cluster_bootstrap(df.repartition(5), [], "d", "v", 200).first()
    assert one == two and one["lower"] < one["estimate"] < one["upper"] and one["clusters"] == 40
    single = stats.cluster_bootstrap(df.where("d = 3"), [], "d", "v", 200).first()
    assert single["lower"] is None and single["estimate"] == 3.0


def test_daily_ic_signs(spark):
    rows = [("d1", float(i), float(i)) for i in range(5)] + [("d2", float(i), float(-i)) for i in range(5)]
    df = spark.createDataFrame(rows, "d string, s double, t double")
    got = {r["d"]: r["spearman_ic"] for r in stats.feature_ic(df, ["d"], ["s"], ["t"]).collect()}
    assert got == {"d1": pytest.approx(1.0), "d2": pytest.approx(-1.0)}


def test_quantile_bins_cover_every_row(spark):
    df = spark.createDataFrame([(float(i), float(i)) for i in range(100)], "x double, y double")
    table = stats.quantile_table(df, stats.quantile_edges(df, "x", 10), "x", "y")
    assert sorted((r["bin"], r["rows"]) for r in table.collect()) == [(i, 10) for i in range(10)]


@pytest.mark.parametrize("kind", [linear_classifiers.SOFTMAX, linear_classifiers.ONE_VS_REST])
def test_newton_reaches_the_minimum_of_every_fold_and_penalty(spark, kind):
    rng = np.random.default_rng(12)
    n, d = 240, 4
    x = rng.normal([0, 5, -2, 100], [1, 3, 0.1, 20], size=(n, d))
    y = 1 + np.argmax(x[:, :3] / [1, 3, 0.1] - [0, 5 / 3, -20] + rng.gumbel(size=(n, 3)), axis=1)
    part = np.arange(n) * 4 // n
    df = spark.createDataFrame([(int(b), int(c), v.tolist()) for b, c, v in zip(part, y, x)], "block int, label int, features array<double>").repartition(3)
    fits = linear_classifiers.newton_fits(df, "block", [(1, 2), (2, 3)], [1e-3, 0.1], kind, d)
    assert [(f.fold, f.penalty) for f in fits] == [(1, 1e-3), (1, 0.1), (2, 1e-3), (2, 0.1)]
    for f in fits:
        xt, yt = x[part < f.edge], y[part < f.edge]
        z = np.column_stack([(xt - xt.mean(0)) / xt.std(0), np.ones(len(xt))])
        weight = np.array([1 / (3 * (yt == c).sum()) for c in yt])
        target = np.equal.outer(yt, [1, 2, 3])

        def objective(theta):
            s = z @ theta.T
            each = np.logaddexp.reduce(s, axis=1) - s[target] if kind == linear_classifiers.SOFTMAX else (np.logaddexp(0, s) - s * target).sum(1)
            return weight @ each + f.penalty / 2 * (theta[:, :-1] ** 2).sum()

        best = objective(f.theta)
        assert f.gradient <= linear_classifiers.TOLERANCE and f.loss == pytest.approx(best)
        assert all(objective(f.theta + 1e-3 * rng.normal(size=f.theta.shape)) > best for _ in range(20))
    table = linear_classifiers.fit_table(df, fits)
    scored = linear_classifiers.probabilities(df.withColumn("fold", F.lit(2)), table, kind)
    p = np.array([r[0] for r in scored.select("probabilities").collect()])
    np.testing.assert_allclose(p.sum(1), 1.0)
    assert len(p) == 2 * n


def test_separable_classes_converge(spark):
    df = spark.createDataFrame([(0, c, [float(c), float(i % 3)]) for i in range(30) for c in (1, 3)], "block int, label int, features array<double>")
    fits = linear_classifiers.newton_fits(df, "block", [(1, 1)], [1e-3], linear_classifiers.ONE_VS_REST, 2)
    assert fits[0].gradient <= linear_classifiers.TOLERANCE


def test_invalid_probabilities_stop_every_counter(spark):
    rows = [("a", 1, 1, 1, [1, 1, 1, 1, 1], [0.2, 0.5, 0.3]), ("a", 1, 1, 1, [1, 1, 1, 1, 1], None)]
    scored = spark.createDataFrame(rows, "spec_id string, complexity int, fold int, label int, labels array<int>, probabilities array<double>")
    for run in (
        lambda: classify.classification_metrics(scored, ["fold"]),
        lambda: classify.directional_diagnostics(scored, ["fold"], [0.5]),
        lambda: classify.alternate_horizons(scored, ["fold"]),
    ):
        with pytest.raises(Exception, match="no valid probabilities"):
            run().collect()


def test_fewer_than_three_edges_stop(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "x double")
    assert stats.quantile_edges(df, "x", 4).first()["edges"] == [1.0]  # open ends: three edges with both infinities
    with pytest.raises(Exception, match="three distinct"):
        stats.quantile_edges(df, "x", 4, open_ends=False).collect()
