"""The backoff automaton against plain dictionaries, and that its probabilities sum to one."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from tidebook.llm import backoff

WHITE = " \t\n\x0b\x0c\r"


def tokens(text):
    out, word = [], ""
    for c in text or "":
        if c in WHITE:
            out += [word] * bool(word)
            word = ""
        else:
            word += c.lower() if "A" <= c <= "Z" else c
    return [*out, *[word] * bool(word), None]


def plain(rows, order, prior):
    """(n_tokens, n_known, N, base, score) of each row (text, is it learnt from)."""
    counts = Counter()
    for text, train in rows:
        seq = [0, *tokens(text)] if train else []
        for n in range(1, order + 1):
            counts.update(tuple(seq[i : i + n]) for i in range(len(seq) - n + 1))
    words = {g: c for g, c in counts.items() if len(g) == 1 and g != (0,)}
    total, types = sum(words.values()), len(words)

    def chance(history, w):
        if not history:
            return (words.get((w,), 0) + 1) / (total + types + 1)
        lower, seen = chance(history[1:], w), counts[history]
        return (counts[(*history, w)] + prior * lower) / (seen + prior) if seen else lower

    out = []
    for text, _ in rows:
        seq = [0, *tokens(text)]
        base = sum(math.log10(chance((), w)) for w in seq[1:])
        score = sum(math.log10(chance(tuple(seq[max(0, i - order + 1) : i]), seq[i])) for i in range(1, len(seq)))
        out.append((len(seq) - 1, sum((w,) in words for w in seq[1:]), total, base, score))
    return out, chance, [w for w, in words]


def texts(seed, n):
    draw = random.Random(seed)
    words = ["The", "the", "cat", "SAT", "on", "é", "É", "mat.", "<s>", "a b"]
    rows = [draw.choice(WHITE).join(draw.choice(words) for _ in range(draw.choice([0, 1, 2, 9, 60]))) for _ in range(n)]
    return rows + ["", None, " \n ", "new words only", "the " * 20_000, rows[0], rows[0]]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_plain_dictionaries(spark, order):
    rows = [(t, i % 3 != 0) for i, t in enumerate(texts(order, 80))]
    docs = spark.createDataFrame([(i, t, k, 1, "x") for i, (t, k) in enumerate(rows)], "doc_id long, text string, learn boolean, block int, train string").repartition(3)
    want, _, _ = plain(rows, order, 4.0)
    got = {r.id: r for r in backoff.scores(docs, "learn", order=order).collect()}
    for i, (n, known, total, base, score) in enumerate(want):
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.train) == (n, known, total, rows[i][1])
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)


def test_probabilities_sum_to_one():
    rows = [(t, True) for t in texts(7, 40)]
    _, chance, words = plain(rows, 3, 4.0)
    for history in [(), (0,), ("the", "cat"), ("sat", "on"), ("never", "seen")]:
        assert math.isclose(sum(chance(history, w) for w in words) + chance(history, "unseen"), 1, rel_tol=1e-9)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b", None), (1, "a b", None), (1, "a b", None)], "doc_id long, text string, learn boolean")
    rows = backoff.scores(docs, "learn").collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score, r.train) for r in rows] == [(3, 0, 0, 0.0, 0.0, False)] * 3
    assert backoff.scores(docs.limit(0), "learn").collect() == []


def test_repeated_rows_are_parted_and_small_blocks_agree(spark):
    rows = [(1, "the cat sat on the mat", True)] * 300 + [(i, t, i % 4 > 0) for i, t in enumerate(texts(5, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, learn boolean").repartition(6)
    want, _, _ = plain([(t, k) for _, t, k in rows], 3, 4.0)
    for size in (256, 1 << 22):
        got = backoff.scores(docs, "learn", block_bytes=size).collect()
        key = lambda r: (r[0], r[1], r[2], round(r[3], 6), round(r[4], 6))
        assert sorted(key((r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score)) for r in got) == sorted(map(key, want))


def test_packing():
    draw = np.random.default_rng(2)
    for n in (0, 1, 5, 10_000):
        hashes = np.unique(draw.integers(0, 2**64, n, dtype=np.uint64))
        assert np.array_equal(backoff.unpacked(backoff.packed(hashes)), hashes)
        short = hashes >> np.uint64(17) << np.uint64(17)
        assert np.array_equal(backoff.unpacked(backoff.packed(short, 17), 17), short)
        counts = draw.integers(0, 2**40, n)
        assert np.array_equal(backoff.unpacked_counts(backoff.packed_counts(counts)), counts)
