"""Near copies by shingles and the pipeline's stage against plain code over all pairs."""

import random
from fractions import Fraction

import numpy as np

import corpus_pipeline
from tidebook.llm import shingles

SCHEMA = "doc_id long, text string"


def plain(text, words=5):
    found = (text or "").split()
    return {" ".join(found[i : i + words]).lower() for i in range(max(1, len(found) - words + 1))}


def jaccard(a, b):
    return Fraction(len(a & b), len(a | b))


def least(sets):
    """Least index reachable over all pairs at 0.8 or more."""
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            if root[i] != root[j] and jaccard(a, sets[j]) >= Fraction(4, 5):
                lo, hi = sorted((root[i], root[j]))
                root = [lo if r == hi else r for r in root]
    return root


def texts():
    draw = random.Random(8)
    word = lambda: "".join(draw.choice("etaoinshrdlu") for _ in range(6))
    line = " ".join(word() for _ in range(12))  # one line that many texts hold
    out, pairs = [], []
    for k in range(80):
        base = [word() for _ in range(draw.choice([40, 120, 400]))]
        out.append(" ".join(base) + (f" {line}" if k % 2 else ""))
        for edits in (1, 2, 4, 6):
            copy = list(base)
            for at in draw.sample(range(len(copy)), edits):
                copy[at] = word()
            pairs.append((out[k * 5], " ".join(copy) + (f" \n{line}" if k % 2 else "")))
            out.append(pairs[-1][1])
    return out + out[3:8] + ["", None, " \t", "two words", "Two words"], pairs


def test_edited_copies_go(spark):
    rows, pairs = texts()
    planted = [jaccard(plain(a), plain(b)) for a, b in pairs]
    assert sum(Fraction(4, 5) <= x <= Fraction(97, 100) for x in planted) >= 80 and sum(x < Fraction(4, 5) for x in planted) >= 80
    want = least([plain(t) for t in rows])
    docs = spark.createDataFrame(list(enumerate(rows)), SCHEMA).repartition(3)
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {i for i, k in enumerate(want) if i == k}
    assert {r.id: r.component for r in shingles.near_copies(docs).collect()} == dict(enumerate(want))


def test_threshold_is_exact():
    a = np.arange(100, dtype=np.uint64)
    assert shingles.similar(a, a[:80], Fraction(4, 5)) and not shingles.similar(a, a[:79], Fraction(4, 5))


def test_prefixes_of_similar_sets_meet():
    draw = np.random.default_rng(2)
    for _ in range(300):
        n = int(draw.integers(1, 200))
        a = np.unique(draw.integers(0, 1 << 40, n).astype(np.uint64))
        b = np.union1d(a[draw.random(len(a)) < 0.9], draw.integers(0, 1 << 40, n // 12).astype(np.uint64))
        common = np.unique(draw.choice(np.union1d(a, b), draw.integers(0, n + 1)))
        counts = draw.integers(8, 99, len(common))
        if len(b) and shingles.similar(a, b, Fraction(4, 5)):
            assert np.isin(*(shingles.prefix(x, common, counts, Fraction(4, 5)) for x in (a, b))).any()


def test_odd_rows(spark):
    assert shingles.near_copies(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(None, "only here and there"), (7, "twice the same text"), (7, "twice the same text"), (None, "twice the same text"), (8, None), (9, "")]
    got = sorted((r.id is None, r.id or 0, r.component or -1) for r in shingles.near_copies(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(False, 7, 7), (False, 7, 7), (False, 8, 8), (False, 9, 8), (True, 0, -1), (True, 0, 7)]
