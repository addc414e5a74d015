"""Boosted trees against the same trees grown by plain loops, and the stock encoding against counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.operators import boosting

PARAMS = boosting.TreeParams(rounds=4, step=0.3, depth=2, bins=8)


def grown(x, y, model, params):
    """Scores of a model by loops over nodes, features and bins."""
    cuts = [np.unique(np.quantile(x[:, i], [k / params.bins for k in range(1, params.bins)], method="inverted_cdf")) for i in range(x.shape[1])]
    b = np.stack([np.searchsorted(c, x[:, i], "left") for i, c in enumerate(cuts)], axis=1)
    score = np.full((len(y), model.outputs), float(model.start))
    for _ in range(params.rounds):
        g, h = model.derivatives(score, y)
        step = np.zeros_like(score)
        for o in range(model.outputs):
            groups = [np.arange(len(y))]
            for _ in range(params.depth):
                parts = []
                for at in groups:
                    best = (1e-12, None)
                    value = lambda i: g[i, o].sum() ** 2 / (h[i, o].sum() + params.l2)
                    for f in range(x.shape[1]):
                        for cut in range(params.bins - 1):
                            l, r = at[b[at, f] <= cut], at[b[at, f] > cut]
                            if min(h[l, o].sum(), h[r, o].sum()) >= params.least and value(l) + value(r) - value(at) > best[0] * (1 + 1e-9):
                                best = (value(l) + value(r) - value(at), (l, r))
                    parts += best[1] or (at, at[:0])
                groups = parts
            for at in groups:
                if len(at):
                    step[at, o] = -g[at, o].sum() / (h[at, o].sum() + params.l2)
        score = score + params.step * step
    return score


def test_equal_plain_trees(spark):
    rng = np.random.default_rng(2)
    n = 300
    x = rng.normal(size=(n, 3)).round(2)
    value = 3 * (x[:, 0] > 0.2) - 2 * x[:, 1] * (x[:, 2] > 0) + rng.normal(size=n) * 0.1
    label = 1 + (value > -0.5).astype(int) + (value > 1.5)
    for y, models in (
        (value, [boosting.Boosted("s", 1, boosting.SQUARED, start=value.mean()), boosting.Boosted("a", 1, boosting.ABSOLUTE, start=0.5, unit=2.0)]),
        (label.astype(float), [boosting.Boosted("c", 1, boosting.SOFTMAX, 3, weight=n / (3 * np.bincount(label)[1:]))]),
    ):
        df = spark.createDataFrame([(i, 0, float(t), v.tolist()) for i, (t, v) in enumerate(zip(y, x))], "id int, part int, y double, features array<double>").repartition(3)
        cuts = boosting.cut_points(df, "features", 3, PARAMS.bins)
        got = boosting.boost(boosting.binned(df, "features", cuts), models, 3, PARAMS).orderBy("id").collect()
        want = np.column_stack([grown(x, y, m, PARAMS) for m in models])
        np.testing.assert_allclose([r["scores"] for r in got], want, rtol=1e-8, atol=1e-10)


def test_models_see_their_train_parts_only(spark):
    rng = np.random.default_rng(3)
    x, part = rng.normal(size=(200, 2)), np.arange(200) * 2 // 200
    y = np.where(part == 0, x[:, 0], 100.0)
    table = lambda keep: boosting.binned(spark.createDataFrame([(i, int(part[i]), float(y[i]), x[i].tolist()) for i in keep], "id int, part int, y double, features array<double>"), "features", [np.linspace(-1, 1, 7)] * 2)
    both = boosting.boost(table(range(200)), [boosting.Boosted("first", 1, boosting.SQUARED), boosting.Boosted("all", 2, boosting.SQUARED)], 2, PARAMS)
    alone = boosting.boost(table(range(100)), [boosting.Boosted("first", 1, boosting.SQUARED)], 2, PARAMS)
    a = {r["id"]: r["scores"][0] for r in both.collect()}
    assert all(a[r["id"]] == pytest.approx(r["scores"][0]) for r in alone.collect()) and len(a) == 200


def test_stock_level_uses_earlier_train_dates(spark):
    rows = [(s, d, None if (s + d) % 5 == 0 else float(10 * s + d)) for s in range(40) for d in range(6) if (s * d) % 7 != 3] + [(99, 5, 1.0), (None, 2, 4.0)]
    df = spark.createDataFrame(rows, "stock int, day int, y double")
    got = boosting.ordered_target_statistic(df, "stock", "day", "y", F.col("day") <= 3, 2.0).collect()
    assert len(got) == len(rows)
    for r in got:
        past = [(s, y) for s, d, y in rows if d < r["day"] and d <= 3 and y is not None]
        own = [y for s, y in past if s == r["stock"]]
        prior = np.mean([y for _, y in past]) if past else 0.0
        assert r["stock_level"] == pytest.approx((sum(own) + 2 * prior) / (len(own) + 2))


def panel_rows(spark, stocks=30):
    rng = np.random.default_rng(7)
    rows = [(s, d, float(rng.normal() + s % 3), *[None if rng.random() < 0.1 else float(v) for v in rng.normal(size=3).round(1)]) for s in range(stocks) for d in range(6) for _ in range(3)]
    return spark.createDataFrame(rows, "stock_id int, date_id int, target double, a double, b double, c double").repartition(3)


def test_stock_levels_meet_narrow_rows_only(spark, monkeypatch):
    """Where levels are too many to broadcast, the join shuffles its rows: they may not carry the features."""
    from tidebook.operators import blocks
    from tidebook.plans import panel_study

    joined, plain = [], blocks.null_safe_join
    monkeypatch.setattr(blocks, "null_safe_join", lambda left, right, keys, how: (joined.append(left.columns), plain(left, right, keys, how))[1])
    got = panel_study.boosted_scores(panel_rows(spark), "date_id", ["a", "b", "c"], "target", 3, PARAMS).collect()
    assert len(got) == 2 * 30 * 2 * 3
    assert joined and not any({"a", "b", "c"} & set(columns) for columns in joined)


def test_bins_equal_those_of_filled_arrays(spark):
    from tidebook.operators import order_stats, panel_models

    names = ["a", "b", "c"]
    df = panel_rows(spark).withColumn("part", F.lit(0)).withColumn("b", F.when(F.col("b").isNull(), float("nan")).otherwise(F.col("b")))
    medians = panel_models.feature_medians(df, names)[()]
    array = F.array(*[F.coalesce(F.nanvl(F.col(n), F.lit(None).cast("double")), F.lit(float(m))) for n, m in zip(names, medians)])
    filled = df.select("*", array.alias("features"))
    want_cuts = boosting.cut_points(filled, "features", 3, 8)
    cuts = boosting.cuts_of_points(order_stats.quantile_points(df, "part", names), names, medians, df.count(), 8)
    assert all((a == b).all() for a, b in zip(cuts, want_cuts, strict=True))
    key = lambda r: (r["stock_id"], r["date_id"], r["target"])
    want = {key(r): bytes(r["bins"]) for r in boosting.binned(filled, "features", want_cuts).collect()}
    assert {key(r): bytes(r["bins"]) for r in boosting.binned_columns(df, names, cuts, medians).collect()} == want
