"""Ordered operators give the same answer whole and in blocks, and match brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidebook.operators import asof, blocks, fills, folds, order_stats


def skewed(seed=3, rows=900):
    """One key holds most rows; values repeat; one value is very common."""
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(rows) < 0.6, 1, rng.integers(2, 9, rows))
    value = np.where(rng.random(rows) < 0.35, 0.0, rng.integers(-20, 20, rows) / 4)
    frame = pd.DataFrame({"k": key, "t": rng.permutation(rows) * 10, "v": value})
    frame.loc[frame.index % 37 == 0, "v"] = None
    return frame


def load(spark, frame):
    rows = [tuple(None if pd.isna(x) else x.item() if hasattr(x, "item") else x for x in r) for r in frame.itertuples(index=False)]
    return spark.createDataFrame(rows, "k long, t long, v double").repartition(5)


@pytest.mark.parametrize("limit", [None, 40])
def test_previous_and_positions(spark, limit):
    frame = skewed()
    ordered = frame.sort_values(["k", "t"])
    want_prev = dict(zip(ordered["t"], ordered.groupby("k")["t"].shift()))
    want_pos = dict(zip(ordered["t"], ordered.groupby("k").cumcount() + 1))
    got = blocks.previous(load(spark, frame), ["k"], ["t"], ["t"], limit).collect()
    assert {r["t"]: r["prev"]["t"] if r["prev"] else None for r in got} == {
        t: None if pd.isna(p) else int(p) for t, p in want_prev.items()
    }
    placed = blocks.positions(load(spark, frame), ["k"], ["t"], limit=limit).collect()
    assert {r["t"]: r["position"] for r in placed} == want_pos


def test_only_large_keys_are_cut(spark):
    df = load(spark, skewed())
    cuts = blocks.cut_points(df, ["k"], "t", 100)
    assert [r["k"] for r in cuts.large.collect()] == [1]
    blocked = blocks.with_block(df, "t", cuts).groupBy("k", blocks.BLOCK).count().collect()
    assert {r[blocks.BLOCK] for r in blocked if r["k"] != 1} == {blocks.WHOLE}
    sizes = [r["count"] for r in blocked if r["k"] == 1]
    assert len(sizes) >= 5 and max(sizes) <= 200


def test_cut_points_are_bounded_and_each_key_has_the_cells_it_needs(spark):
    df = spark.range(40_000).selectExpr("id % 400 AS k", "id AS t").repartition(4)
    cuts = blocks.cut_points(df, ["k"], "t", 20)
    assert len(cuts.points) < blocks.MOST_POINTS and cuts.most == 5
    sizes = [r["count"] for r in blocks.with_block(df, "t", cuts).groupBy("k", blocks.BLOCK).count().collect()]
    assert sum(sizes) == 40_000 and len(sizes) <= 2 * 40_000 / 20 and max(sizes) <= 40
    placed = blocks.positions(df, ["k"], ["t"], limit=20)
    assert placed.where("position = t div 400 + 1").count() == 40_000


@pytest.mark.parametrize("limit", [None, 40])
def test_average_rank_and_quantiles(spark, limit):
    frame = skewed(5)
    got = order_stats.average_rank(load(spark, frame), ["k"], {"v": "r"}, percent=True, limit=limit).toPandas()
    want = frame.assign(r=frame.groupby("k")["v"].rank(pct=True, method="average")).sort_values("t")
    np.testing.assert_allclose(got.sort_values("t")["r"], want["r"], rtol=1e-12)
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]
    found = order_stats.quantiles(load(spark, frame), ["k"], "v", probs, limit=limit).collect()
    for row in found:
        want = np.nanquantile(frame.loc[frame["k"] == row["k"], "v"].astype(float), probs)
        np.testing.assert_allclose(row["q"], want, rtol=1e-12, atol=1e-12)


@pytest.mark.parametrize("limit", [None, 50])
def test_spearman_matches_pandas_and_is_null_for_constant(spark, limit):
    frame = skewed(7).dropna()
    frame["v2"] = (frame["t"] * 7919 % 101).astype(float)
    rows = [(int(k), float(v), float(w)) for k, v, w in zip(frame["k"], frame["v"], frame["v2"])]
    rows += [(99, 1.0, float(i)) for i in range(5)]
    df = spark.createDataFrame(rows, "k long, a double, b double")
    got = {r["k"]: r["spearman_ic"] for r in order_stats.spearman(df, ["k"], "a", "b", limit=limit).collect()}
    assert got.pop(99) is None
    for k, part in frame.groupby("k"):
        assert got[k] == pytest.approx(part["v"].rank().corr(part["v2"].rank()), abs=1e-12)


def greedy(spans):
    taken, free = [], -(10**18)
    for start, end in sorted(spans):
        if start >= free:
            taken.append(start)
            free = end
    return taken


@pytest.mark.parametrize("limit", [None, 60, 15])
@pytest.mark.parametrize("hold", [35, 900])
def test_non_overlapping_matches_brute_force(spark, limit, hold):
    frame = skewed(11)
    rng = np.random.default_rng(1)
    spans = [(int(k), int(t), int(t) + hold + int(rng.integers(0, 30))) for k, t in zip(frame["k"], frame["t"])]
    df = spark.createDataFrame(spans, "k long, s long, e long").repartition(3)
    got = fills.non_overlapping(df, ["k"], "s", "e", limit).toPandas()
    for k in frame["k"].unique():
        want = greedy([(s, e) for kk, s, e in spans if kk == k])
        assert sorted(got.loc[got["k"] == k, "s"]) == want


@pytest.mark.parametrize("rows", [1, 2, 7, 50, 100_000])
def test_even_sample_matches_linspace(spark, rows):
    frame = skewed(13)
    got = folds.even_sample(load(spark, frame), ["k"], ["t"], rows, 60).toPandas()
    for k, part in frame.sort_values("t").groupby("k"):
        index = (
            range(len(part)) if len(part) <= rows
            else np.unique(np.linspace(0, len(part) - 1, rows, dtype=int))
        )
        assert sorted(got.loc[got["k"] == k, "t"]) == list(part["t"].iloc[list(index)])


def test_bracketed_quantiles_are_exact_and_keep_few_rows(spark):
    df = spark.range(120_000).selectExpr("id % 2 AS k", "xxhash64(id) / 1e15D + pow(id % 97, 3) AS v")
    probs = [0.01, 0.1, 0.5, 0.503, 0.99]
    assert order_stats._bracketed_quantiles(df, ["k"], "v", probs, "q", 20_000) is not None
    got = {r["k"]: r["q"] for r in order_stats.quantiles(df, ["k"], "v", probs, limit=20_000).collect()}
    local = df.toPandas()
    for k in (0, 1):
        np.testing.assert_allclose(got[k], np.quantile(local.loc[local["k"] == k, "v"], probs), rtol=1e-12)


@pytest.mark.parametrize("limit", [None, 3])
def test_medians_of_wide_rows_equal_numpy(spark, limit):
    rng = np.random.default_rng(4)
    values = np.column_stack([rng.normal(size=5001), rng.integers(0, 3, 5001), np.full(5001, np.nan)])
    values[rng.random((5001, 3)) < 0.1] = np.nan
    rows = [(None if i % 3 == 2 else i % 3, *(None if np.isnan(x) else float(x) for x in v)) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "k long, a double, b double, c double").repartition(3)
    got = {(r.k, r[order_stats.NAME]): r.q[0] for r in order_stats.column_medians(df, ["k"], ["a", "b", "c"], limit).collect()}
    assert got == {(None if k == 2 else k, n): pytest.approx(np.nanmedian(values[k::3, j]), abs=1e-12) for k in range(3) for j, n in enumerate("ab")}
    whole = {r[order_stats.NAME]: r.q[0] for r in order_stats.column_medians(df, [], ["a", "b", "c"], limit).collect()}
    assert whole == {n: pytest.approx(np.nanmedian(values[:, j]), abs=1e-12) for j, n in enumerate("ab")}


@pytest.mark.parametrize("limit", [None, 20])
def test_null_is_a_key_like_any_other(spark, limit):
    rows = [(None, t) for t in range(0, 700, 7)] + [(1, t) for t in range(0, 90, 9)]
    df = spark.createDataFrame(rows, "k long, t long").repartition(4)
    got = {(r.k, r.t): (r.position, r.prev and r.prev.t) for r in blocks.previous(blocks.positions(df, ["k"], ["t"], limit=limit), ["k"], ["t"], ["t"], limit).collect()}
    assert got == {(k, t): (t // step + 1, t - step if t else None) for k, step in ((None, 7), (1, 9)) for kk, t in rows if kk == k}


@pytest.mark.parametrize("limit", [None, 2])
def test_ranks_keep_the_type_of_the_values(spark, limit):
    big = 2**53
    df = spark.createDataFrame([(1, big), (1, big + 1), (1, big + 2), (1, None), (None, 5), (None, 5)], "k long, v long")
    got = sorted(((r.k or 0, r.v or 0, r.r or 0.0) for r in order_stats.average_rank(df, ["k"], {"v": "r"}, limit=limit).collect()))
    assert got == [(0, 5, 1.5), (0, 5, 1.5), (1, 0, 0.0), (1, big, 1.0), (1, big + 1, 2.0), (1, big + 2, 3.0)]


def test_a_hot_left_key_is_cut(spark):
    left = spark.createDataFrame([("hot", t) for t in range(1000)] + [(None, 7)], "k string, t long")
    right = spark.createDataFrame([("hot", 500, 1), (None, 3, 2)], "k string, s long, x int")
    both = left.select("k", "t").unionAll(right.select("k", "s"))
    cuts = blocks.cut_points(both, ["k"], "t", 50)
    cells = blocks.with_block(both, "t", cuts).groupBy("k", blocks.BLOCK).count().collect()
    assert max(r["count"] for r in cells) <= 100
    got = asof.asof_join(left, right, ["k"], "t", "s", ["x"], limit=50).collect()
    assert {(r.k, r.t): r.x for r in got} == {**{("hot", t): 1 if t >= 500 else None for t in range(1000)}, (None, 7): 2}


def test_rows_of_many_keys_are_dealt_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_PER_TASK", 100, raising=False)
    rows = spark.range(2000).selectExpr("id % 400 AS k", "id AS t", "id AS sequence", "cast(id % 7 AS double) AS v")
    probes = spark.range(400).selectExpr("id AS k", "cast(1500 AS bigint) AS t")
    per_task = lambda df: [r["count"] for r in df.groupBy(F.spark_partition_id()).count().collect()]
    for found in (
        blocks.previous(rows, ["k"], ["t"], ["v"]),
        blocks.positions(rows, ["k"], ["t"]),
        order_stats.average_rank(rows, ["k"], {"v": "r"}),
    ):
        assert found.count() == 2000 and max(per_task(found)) <= 300
    states = asof.probe_states(rows, probes, ["k"], "t", ["sequence"], [{"n": ("sum", F.lit(1))}])
    assert {r["n"] for r in states.collect()} == {4, 3} and len(per_task(states)) > 12


def test_floating_keys_are_dealt_by_rows_too(spark, monkeypatch):
    """A window makes one of -0.0 and 0.0 before it groups, and must not shuffle the rows a second time for that."""
    monkeypatch.setattr(blocks, "ROWS_PER_TASK", 100)
    key = "CASE WHEN id % 400 = 0 THEN -0D WHEN id % 400 = 1 THEN 0D WHEN id % 400 = 2 THEN double('NaN') ELSE id % 400 END AS k"
    rows = spark.range(2000).selectExpr(key, "id AS t", "id AS sequence", "cast(id div 800 AS double) AS v")
    per_task = lambda df: [r["n"] for r in df.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max(df.columns[-1])).collect()]
    probes = rows.where("t < 400").selectExpr("k", "cast(1500 AS bigint) AS t")
    ranks = order_stats.average_rank(rows, ["k"], {"v": "r"})
    states = asof.probe_states(rows, probes, ["k"], "t", ["sequence"], [{"n": ("sum", F.lit(1))}])
    for found in (ranks, blocks.previous(rows, ["k"], ["t"], ["v"]), blocks.positions(rows, ["k"], ["t"])):
        assert found.columns[:4] == rows.columns and len(found.columns) == 5
        assert found.count() == 2000 and max(per_task(found)) <= 300
    assert sorted(r.r for r in ranks.where("k = 0").collect()) == [2.5] * 4 + [6.5] * 4 + [9.5] * 2
    assert len(per_task(states)) > 12 and {(r.k, r.n) for r in states.where("k <= 0 OR k = 5").collect()} == {(0.0, 8), (5.0, 4)}


def test_ranks_of_groups_beyond_a_task(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("id % 3 AS k", "CASE WHEN id % 11 > 0 THEN cast(id % 50 AS double) END AS v")
    whole = order_stats.average_rank(rows, ["k"], {"v": "r"}, percent=True).collect()
    monkeypatch.setattr(order_stats, "GROUP_ROWS", 100, raising=False)
    cut = order_stats.average_rank(rows, ["k"], {"v": "r"}, percent=True)
    plan = cut._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan and sorted(map(str, cut.collect())) == sorted(map(str, whole))


def test_few_large_groups_do_not_meet_in_a_task(spark, monkeypatch):
    monkeypatch.setattr(blocks, "ROWS_PER_TASK", 100)
    rows = spark.range(5000).selectExpr("concat('d', id % 20) AS k", "cast(id div 20 AS double) AS v")
    found = order_stats.average_rank(rows, ["k"], {"v": "r"})
    tasks = found.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.max("r").alias("most")).collect()
    assert max(r["n"] for r in tasks) <= 350 and {r["most"] for r in tasks} == {250.0}


@pytest.mark.parametrize("points", [2_048, 64])
def test_medians_of_nested_parts_read_every_row_once(spark, monkeypatch, points):
    """Exact beside numpy with ties, missing values and stretches that are thinned out; no row is repeated for an edge."""
    monkeypatch.setattr(order_stats, "POINTS", points)
    monkeypatch.setattr(order_stats, "CHUNK", 1_000)
    rng = np.random.default_rng(4)
    n = 9_000
    part, x = rng.integers(0, 4, n), rng.normal(size=(n, 4))
    x[:, 1], x[:, 2] = rng.integers(0, 3, n), np.where(part > 0, 1e9 + x[:, 2], np.nan)
    x[:, 3] = np.nan
    rows = [(int(p), *[None if np.isnan(v) and i % 2 else float(v) for v in r]) for i, (p, r) in enumerate(zip(part, x))]
    df = spark.createDataFrame(rows, "part int, a double, b double, c double, d double").repartition(3)
    got = {(r[order_stats.EDGE], r[order_stats.NAME]): r["q"][0] for r in order_stats.nested_medians(df, "part", [1, 2, 4], list("abcd")).collect()}
    want = {(e, c): np.nanmedian(x[part < e, i]) for e in (1, 2, 4) for i, c in enumerate("abcd") if not np.isnan(x[part < e, i]).all()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k], rel=1e-15) for k in want)
    sketch = order_stats.quantile_points(df, "part", list("abcd")).collect()
    assert sum(len(r["values"]) * r["weight"] for r in sketch) == pytest.approx(np.isfinite(x).sum())
