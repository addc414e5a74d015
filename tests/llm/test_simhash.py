"""SimHash near copies against plain code over all pairs."""

import random

import numpy as np
import pytest
import xxhash

from tidebook.llm import simhash


def plain(text, words=3):
    found = text.translate({c: c + 32 for c in range(65, 91)})
    for c in "\t\n\x0b\x0c\r":
        found = found.replace(c, " ")
    found = [w for w in found.split(" ") if w]
    shingles = [" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes)) if hashes else 0


def classes(prints, max_bits):
    """Least index reachable, over all pairs."""
    least = list(range(len(prints)))
    changed = True
    while changed:
        changed = False
        for i, a in enumerate(prints):
            for j, b in enumerate(prints):
                if (a ^ b).bit_count() <= max_bits and least[j] < least[i]:
                    least[i], changed = least[j], True
    return least


def texts():
    draw = random.Random(3)
    words = [f"w{i}É" for i in range(60)]
    base = [" ".join(draw.choice(words) for _ in range(draw.choice([0, 1, 2, 3, 40, 300]))) for _ in range(60)]
    near = []
    for t in base[:30]:
        w = t.split(" ")
        w[draw.randrange(len(w))] = "CHANGED"
        near.append(" \n".join(w))
    return base + near + base[:20] + ["", " \t", "A b", "a B", "x" * 100_000]


def test_fingerprint_equals_plain_code():
    for text in texts():
        assert simhash.fingerprint(text.encode()) == plain(text)


def test_components_equal_all_pairs(spark):
    rows = [(i, t) for i, t in enumerate(texts())]
    docs = spark.createDataFrame([(i, t, i) for i, t in rows] + [(900, None, 1)], "doc_id long, text string, fp int").repartition(3)
    want = classes([plain(t) for _, t in rows] + [0], 2)
    got = {r.id: r for r in simhash.near_copies(docs).collect()}
    assert len(got) == len(rows) + 1
    assert [got[i].component for i, _ in rows] == want[:-1]
    assert got[900].component == want[-1] and got[900].fp == 0


@pytest.mark.parametrize("max_bits", [1, 2, 3, 7])
def test_no_link_is_lost(spark, max_bits):
    draw = random.Random(max_bits)
    prints = {draw.getrandbits(64) for _ in range(300)} | {draw.getrandbits(6) for _ in range(30)}
    for p in list(prints)[:150]:
        for b in draw.sample(range(64), draw.randint(1, max_bits + 1)):
            p ^= 1 << b
        prints.add(p)
    centre = draw.getrandbits(64)
    prints |= {centre ^ (1 << a) ^ (1 << b) for a in range(40) for b in range(a)}  # a crowded cell
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "fp long")
    from tidebook.llm.components import components

    roots = {r.node: r.root for r in components(simhash.close_pairs(table, max_bits), "a", "b").collect()}
    want = classes(prints, max_bits)
    by_root = {}
    for s, w in zip(signed, want, strict=True):
        by_root.setdefault(roots.get(s, s), set()).add(w)
    assert all(len(x) == 1 for x in by_root.values()) and len(by_root) == len(set(want))


def test_thresholds_cover_every_difference():
    draw = np.random.default_rng(1)
    costs = draw.random((50, 4, 5)) * 100
    chosen = simhash.allocate(costs, 3)
    assert ((chosen + 1).sum(1) == 4).all()
    from itertools import product

    for f in range(50):
        best = min(sum(costs[f, i, e] for i, e in enumerate(es)) for es in product(range(5), repeat=4) if sum(es) == 4)
        assert np.isclose(best, sum(costs[f, i, e + 1] for i, e in enumerate(chosen[f])))


def test_odd_rows(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_copies(empty).collect() == []
    rows = [(None, "only here and there"), (7, "twice the same text"), (7, "twice the same text"), (None, "twice the same text"), (8, None), (9, "")]
    got = sorted((r.id is None, r.id or 0, r.component or -1) for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(False, 7, 7), (False, 7, 7), (False, 8, 8), (False, 9, 8), (True, 0, -1), (True, 0, 7)]
