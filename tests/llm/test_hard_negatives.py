"""Hard negatives against all pairs in plain Python integers."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.llm import hard_negatives as hn


def expected(rows, step=5, positives=5, negatives=3):
    good = [(i, l, [math.floor(256 * x) for x in v]) for i, v, l in rows if l is not None and v is not None and None not in v and all(map(math.isfinite, v))]
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    out = []
    for k, (i, l, v) in enumerate(good):
        if i is None or i % step:
            continue
        scored = [(-clip(sum(map(int.__mul__, v, w))), j is None, j or 0, m) for n, (j, m, w) in enumerate(good) if n != k and len(w) == len(v)]
        scored.sort()
        for p in [s for s in scored if s[3] == l][:positives]:
            kept = [s for s in scored if s[3] != l and 50 * -p[0] <= 100 * -s[0] <= 95 * -p[0]][:negatives]
            out += [(i, None if p[1] else p[2], rank, None if s[1] else s[2], -p[0], -s[0]) for rank, s in enumerate(kept, 1)]
    return sorted(out, key=repr)


def found(spark, rows, step=5, **options):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, label int, row long, anchor string").repartition(3)
    return sorted(map(tuple, hn.hard_negatives(table, F.col("vec_id") % step == 0, **options).collect()), key=repr)


def clusters(n, dims, spread, seed):
    draw = np.random.default_rng(seed)
    centres = draw.standard_normal((6, dims))
    which = draw.integers(0, 6, n)
    v = centres[which] + spread * draw.standard_normal((n, dims))
    v /= np.linalg.norm(v, axis=1)[:, None]
    labels = (which // 2 + (draw.random(n) < 0.3)) % 3
    return [(int(i), x.tolist(), int(l)) for i, (x, l) in enumerate(zip(v, labels, strict=True))]


@pytest.mark.parametrize(("spread", "options"), [(0.05, {}), (0.4, {"candidates_block": 40, "anchors_block": 7}), (3.0, {"candidates_block": 64})])
def test_equals_all_pairs(spark, spread, options):
    rows = clusters(260, 16, spread, 2)
    assert found(spark, rows, **options) == expected(rows)


def test_bounds_spare_scores():
    """In tight clusters most candidates are never scored a second time, and the bounds hold for all of them."""
    rows = clusters(600, 24, 0.03, 3)
    x = np.floor(256 * np.array([v for _, v, _ in rows]))
    numbers = np.arange(len(rows))
    block = {"rows": numbers.tobytes(), "ids": numbers.tobytes(), "known": np.ones(len(rows), np.uint8).tobytes(), "labels": np.array([l for *_, l in rows]).tobytes(), "vectors": x.tobytes()}
    order, parent, edge = hn.spanning_tree(x)
    assert sorted(order) == list(range(len(rows))) and all(list(order).index(parent[k]) < list(order).index(k) for k in order[1:40])
    block["tree"] = np.array([order, parent, edge]).tobytes()
    meet, scored = hn.Meeting(block, block), 0

    def wanted(anchor, low, high):
        exact = x @ x[anchor]
        assert (low <= exact).all() and (exact <= high).all()
        return high >= 0.6 * 65536

    for anchor, at, scores in meet.walk(wanted):
        scored += len(at)
        assert set(np.flatnonzero(x @ x[anchor] >= 0.6 * 65536)) <= set(at) and (scores == (x @ x[anchor])[at]).all()
    assert scored < len(rows) ** 2 / 3


def test_spanning_tree_is_least():
    points = np.random.default_rng(9).integers(-50, 50, (40, 3)).astype(float)
    _, _, edge = hn.spanning_tree(points)
    lengths = sorted((np.linalg.norm(points[i] - points[j]), i, j) for i in range(40) for j in range(i))
    group, total = list(range(40)), 0.0
    for length, i, j in lengths:
        if group[i] != group[j]:
            total += length
            group = [group[i] if g == group[j] else g for g in group]
    assert abs(edge.sum() - total) < 1e-6


def test_nulls_ties_repeats_lengths_and_large_numbers(spark):
    rows = clusters(60, 8, 0.5, 4)
    v = rows[0][1]
    rows += [(200 + i, v, 0) for i in range(8)] + [(300 + i, [0.8 * x for x in v], 1) for i in range(8)]  # ties by id
    rows += [(0, v, 0), (0, v, 0), (None, v, 0), (None, [0.8 * x for x in v], 1)]  # repeated ids, no id
    rows += [(5, None, 1), (10, v, None), (15, [*v[:-1], None], 1), (20, [*v[:-1], math.nan], 1), (25, [*v[:-1], math.inf], 1)]
    rows += [(400, [1.0, 2.0], 0), (401, [1.0, 1.9], 0), (402, [0.8, 1.5], 1), (405, [], 0), (406, [], 0), (407, [], 1)]
    rows += [(500, [3e17] * 3, 2), (501, [3e17, 3e17, 2e17], 2), (502, [2e17] * 3, 3), (503, [1e9, 1e9, 1e9], 2), (504, [6e8] * 3, 3)]
    assert found(spark, rows) == expected(rows)


def test_no_anchor_and_no_rows(spark):
    assert found(spark, [(1, [1.0], 0), (2, [1.0], 0)]) == [] == found(spark, [(0, None, 0)])
