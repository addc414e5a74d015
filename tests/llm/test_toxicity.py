"""Positive-unlabelled toxicity: the risk's parts, held-out accuracy and odd rows."""

import random

import numpy as np

from tidebook.llm import toxicity


def corpus(n, seed):
    """Texts of which a tenth holds some of three bad words, and which those are."""
    draw = random.Random(seed)
    words, bad = [f"wort{i}" for i in range(300)], ["schurke", "lump", "esel"]
    rows = []
    for i in range(n):
        toxic = draw.random() < 0.1
        text = [draw.choice(words) for _ in range(draw.randint(5, 200))]
        for _ in range(2 * toxic):
            text.insert(draw.randrange(len(text)), draw.choice(bad))
        rows.append((i, " ".join(text), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(3000, 1)
    docs = spark.createDataFrame([(i, t, "de") for i, t, _ in rows], "doc_id long, text string, score_note string").repartition(4)
    labels = spark.createDataFrame([(i, y, y) for i, _, y in rows if i % 5 and i % 3], "doc_id long, toxic int, text int")
    model = toxicity.train(docs.where("doc_id % 5 != 0"), labels)
    got = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    held = [(got[i], y) for i, _, y in rows if i % 5 == 0]
    assert len(got) == 3000 and all(0 <= s <= 1 for s in got.values())
    assert np.mean([(s >= 0.5) == (y == 1) for s, y in held]) > 0.98
    again = toxicity.train(docs.repartition(2).where("doc_id % 5 != 0"), labels)
    assert np.array_equal(again.used, model.used) and np.allclose(again.weights, model.weights)


def test_negative_part_is_not_followed_below_zero():
    # every unlabelled text looks like the positives: a plain risk would drive all of them to the negative side
    positive = [np.array([1, 2], np.int32)] * 30
    unlabelled = [np.array([1, 2], np.int32)] * 40 + [np.array([3], np.int32)] * 60
    model = toxicity.fit(positive, unlabelled, 0.4)
    dense = model.dense()
    assert toxicity.score(np.array([1, 2]), dense, model.bias) > 0.5 > toxicity.score(np.array([3]), dense, model.bias)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, "", "a"), (1, "", "a"), (None, None, None), (2, "x" * 200_000 + " " + "wort " * 50_000, "b")], "doc_id long, text string, toxic string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    odd = spark.createDataFrame([(None, 1), (1, None), (9, 1)], "doc_id long, toxic int")
    for labels in (none, odd):
        model = toxicity.train(docs, labels)
        rows = toxicity.scored(docs, model).collect()
        assert len(rows) == 4 and all(0 <= r.score < 0.5 or labels is odd for r in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert toxicity.scored(empty, toxicity.train(empty, odd)).collect() == []
