"""Near vectors against exact cosines of all pairs."""

import math

import numpy as np
import pytest

from tidebook.llm import vectors


def expected(rows, cosine):
    """(n_links, component) of each row, by all pairs."""
    good = [l is not None and v and None not in v and all(map(math.isfinite, v)) and any(v) for _, v, l in rows]
    links = [set() for _ in rows]
    for i in range(len(rows)):
        for j in range(i):
            if good[i] and good[j] and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]):
                a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
                a, b = a / np.abs(a).max(), b / np.abs(b).max()
                if a @ b / np.sqrt((a @ a) * (b @ b)) >= cosine:
                    links[i].add(j)
                    links[j].add(i)
    out = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((rows[i][0], len(links[i]), min(ids) if ids else None))
    return sorted(out, key=repr)


def near(draw, centre, spread, n):
    return [(centre + draw.standard_normal(len(centre)) * spread).tolist() for _ in range(n)]


def test_links_equal_all_pairs(spark):
    draw = np.random.default_rng(3)
    rows, k = [], 0
    for label in range(3):
        for _ in range(40):
            centre = draw.standard_normal(24)
            for v in near(draw, centre, draw.choice([0.02, 0.1, 0.14, 0.17]), draw.integers(1, 8)):
                rows.append((k, v, label))
                k += 1
    rows += [(k + i, v, 1) for i, v in enumerate(near(draw, draw.standard_normal(24), 0.08, 300))]  # a crowded cell
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<float>, label int, row int, vector string").repartition(3)
    single = [(i, np.array(v, np.float32).tolist(), l) for i, v, l in rows]
    got = sorted(((r.id, r.n_links, r.component) for r in vectors.near_vectors(table).collect()), key=repr)
    assert got == expected(single, 0.98)


def test_odd_rows(spark):
    v = [1.0, 2.0, 3.0]
    rows = [(1, v, 0), (2, v, None), (3, None, 0), (4, [0.0, 0.0, 0.0], 0), (5, [1.0, None, 3.0], 0), (6, [1.0, float("nan"), 3.0], 0), (7, [1.0, float("inf"), 3.0], 0), (8, [], 0), (9, [2.0, 4.0, 6.0], 0)]
    rows += [(10, [1.0, 2.0], 0), (11, v, 1), (12, v, 1), (12, v, 1), (None, v, 0), (None, v, 2), (13, [1e-30, 0.0, 0.0], 0), (14, [1e30, 0.0, 0.0], 0), (15, [1.0, 2.0], 0), (16, [-1.0, -2.0, -3.0], 0), (17, [5.0], 0), (18, [7.0], 0)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = sorted(((r.id, r.n_links, r.component) for r in vectors.near_vectors(table).collect()), key=repr)
    assert got == expected([(i, None if v is None else v, l) for i, v, l in rows], 0.98)
    assert all(r.kept == (r.id == r.component) for r in vectors.near_vectors(table).collect())
    assert vectors.near_vectors(table.limit(0)).collect() == []


@pytest.mark.parametrize("largest", [2, 10_000, 10**9])
def test_bands_reach_the_allowed_miss(largest):
    bands = vectors.Bands.of(largest, 0.98)
    kept = (1 - math.acos(0.98) / math.pi) ** bands.bits
    assert (1 - kept) ** bands.count <= vectors.MISS and 2**bands.bits >= min(2**40, largest)


def test_estimates_are_unbiased_and_bounded():
    draw = np.random.default_rng(1)
    a, b = draw.standard_normal(64), draw.standard_normal(64)
    a, b = a / np.linalg.norm(a), b / np.linalg.norm(b)
    off = []
    for _ in range(2000):
        q, r = np.linalg.qr(draw.standard_normal((64, 64)))
        q = q * np.sign(np.diag(r))
        code = np.sign(a @ q) / 8
        factor = code @ (a @ q)
        error = code @ (b @ q) / factor - a @ b
        off.append(error)
        assert abs(error) <= vectors.BOUND * math.sqrt(1 - factor**2) / factor / math.sqrt(63)
    assert abs(np.mean(off)) < 4 * np.std(off) / math.sqrt(len(off))
