"""CGK decontamination against the edit distance of every window, on planted edits."""

import random

import numpy as np

from tidebook.llm import cgk


def distance(item, window):
    """Least edits between the item and any part of the window, by the plain table."""
    row = [0] * (len(window) + 1)
    for i, a in enumerate(item):
        above, row[0] = row[0], i + 1
        for j, b in enumerate(window):
            above, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, above + (a != b))
    return min(row)


def test_bit_vectors_equal_the_table():
    draw = random.Random(2)
    for _ in range(200):
        item = bytes(draw.choice(b"abc ") for _ in range(draw.randint(1, 90)))
        window = bytes(draw.choice(b"abc ") for _ in range(draw.randint(0, 120)))
        assert cgk.edit_distance(item, window, 1000) == distance(item, window)


def prose(draw, n):
    return " ".join("".join(draw.choice("etaoinshr") for _ in range(draw.randint(1, 9))) for _ in range(n))


def test_planted_edits_are_found_and_nothing_else(spark):
    draw, edits = random.Random(4), np.random.default_rng(4)
    items = [(i, prose(draw, draw.randint(15, 60))) for i in range(60)]
    docs, planted = [], {}
    for d in range(600):
        text = prose(draw, draw.choice([0, 3, 50, 400]))
        if d % 3 == 0:
            i, item = draw.choice(items)
            share = [0, 0.05, 0.1, 0.15][d // 3 % 4]
            passage = cgk.edited(item.encode(), share, edits).decode()
            text = f"{text} {passage.upper() if d % 2 else passage}\n{prose(draw, 20)}"
            planted[d, i] = share
        docs.append((d, text))
    rows = spark.createDataFrame([(*r, 1, "x") for r in docs], "doc_id long, text string, item_id int, edits string").repartition(4)
    got = {(r.id, r.item): r for r in cgk.leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    want, texts, by_id = {}, dict(docs), dict(items)
    for d, i in planted:  # what the exact distance says of the planted pairs
        item = cgk.plain(by_id[i])
        edit = cgk.edit_distance(item, cgk.plain(texts[d]), len(item))
        if edit <= int(cgk.EDITS * len(item)):
            want[d, i] = edit
    assert all(k in got for k, share in planted.items() if share <= 0.1)
    assert sum(k in got for k in want) >= 0.97 * len(want)
    assert set(got) <= set(want) and all(got[k].edits == want[k] for k in got)


def test_odd_rows(spark):
    draw = random.Random(9)
    item, long_item = prose(draw, 20), prose(draw, 3000)
    items = spark.createDataFrame([(1, item), (2, item), (None, long_item), (3, "yes"), (4, None), (5, "")], "item_id long, text string")
    filler = "word " * 100_000
    docs = spark.createDataFrame([(1, filler + item + " " + filler), (2, None), (3, ""), (None, item), (4, long_item), (5, item), (5, item), (6, "\x00" + item)], "doc_id long, text string")
    got = sorted(((r.id or 0, r.item or 0, r.edits) for r in cgk.leaks(docs, items).collect()))
    assert got == [(0, 1, 0), (0, 2, 0), (1, 1, 0), (1, 2, 0), (4, 0, 0), (5, 1, 0), (5, 2, 0), (6, 1, 0), (6, 2, 0)]
    nothing = spark.createDataFrame([], "item_id long, text string")
    assert cgk.leaks(docs, nothing).collect() == [] and cgk.leaks(docs.limit(0), items).collect() == []


def test_short_items_are_found_word_for_word(spark):
    items = [(1, "What is  the capital of Peru?"), (2, "what is the capital of peru?"), (3, "Peru?"), (4, "capital"), (5, "é ü"), (6, "a" * 47), (7, " "), (8, "the capital of")]
    docs = [(1, "Q: what IS the\ncapital of Peru? A: Lima"), (2, "capitals of Peru?x"), (3, "é  ü"), (4, "b " + "a" * 47), (5, "a" * 48), (6, ""), (7, None), (8, "the capital of the capital of")]
    got = sorted((r.id, r.item, r.edits) for r in cgk.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect())
    want = [(d, i, 0) for d, x in docs for i, y in items if cgk.plain(y) and f" {cgk.plain(y).decode()} " in f" {cgk.plain(x).decode()} "]
    assert got == sorted(want) and len(want) == 9


def test_edited_short_items_behind_many_long_ones_are_found(spark):
    """The pilot reads every item, and those of which samples miss a copy go by their pieces."""
    draw, edits = random.Random(5), np.random.default_rng(5)
    short = lambda: cgk.plain(prose(draw, 30))[:60].strip().decode()
    items = [(i, prose(draw, 40)) for i in range(310)] + [(310 + i, short()) for i in range(60)]
    by_id, docs = dict(items), []
    for d in range(240):
        text = cgk.edited(by_id[310 + d % 60].encode(), [0.05, 0.1, 0.15, 0.2][d // 60], edits).decode()
        docs.append((d, f"{prose(draw, 30)} {text} {prose(draw, 30)}"))
    want = {}
    for d, text in docs:
        pattern = cgk.plain(by_id[310 + d % 60])
        if (edit := cgk.edit_distance(pattern, cgk.plain(text), len(pattern))) <= int(cgk.EDITS * len(pattern)):
            want[d, 310 + d % 60] = edit
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = {(r.id, r.item): r.edits for r in cgk.leaks(rows, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(want) >= 230 and all(len(cgk.plain(by_id[i])) >= cgk.LEAST_CHARS for _, i in want)
    assert sum(got.get(k) == edit for k, edit in want.items()) >= 0.99 * len(want)


def test_pieces_find_every_window():
    draw, edits = random.Random(6), np.random.default_rng(6)
    for share in (0.0, 0.1, 0.2, 0.3, 0.45):
        for _ in range(60):
            item = cgk.plain("".join(draw.choice("abcde  é") for _ in range(draw.randint(50, 150))))
            copies = [cgk.plain(cgk.edited(item, share * draw.random(), edits).decode(errors="ignore")) for _ in range(3)]
            texts = [b"", cgk.plain(prose(draw, 30)), *[cgk.plain(prose(draw, 9)) + b" " + c + b" " + c for c in copies]]
            items = cgk.Items([1], [item], range(1), 1, np.zeros((0, cgk.STEPS), np.uint8), np.zeros(0, np.int32), np.zeros(0, np.int32), [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)])
            got = {owner: edit for owner, _, edit in cgk.Search(items, share).matches(texts)}
            exact = {k: cgk.edit_distance(item, t, len(item)) for k, t in enumerate(texts)}
            assert got == {k: e for k, e in exact.items() if e <= int(share * len(item))}
