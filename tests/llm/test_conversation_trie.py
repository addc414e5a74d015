"""The trie against prefixes listed in plain Python."""

import hashlib
import random
import zlib

import pytest

from tidebook.llm import conversation_trie as trie


def rebuilt(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in convs.items()}
    out = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = own.get(c - c % 5, [])[:h] + turns[h:]
    return out


def expected(rows):
    members = {}
    whole = rebuilt(rows)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for prefix, convs in members.items():
        d = len(prefix)
        below = [p for p in members if p[:d] == prefix]
        children = [p for p in below if len(p) == d + 1]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(members[p]) - 1) * len(p[-1][1].encode()) for p in below if p)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(whole[c]) == d))
        parent = min(members[prefix[:-1]]) if d else None
        out.append((min(convs), d, parent, len(convs), len(children), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(spark, rows, partitions=3):
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn int, role string, text string, at int, name string").repartition(partitions)
    return sorted(map(tuple, trie.prefix_trie(trie.spliced(trie.ordered_turns(table))).collect()), key=lambda r: (r[1], r[0]))


def test_equals_plain_prefixes(spark):
    draw = random.Random(4)
    rows = []
    for c in range(60):
        for t in range(draw.choice([1, 2, 5, 8, 12])):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", draw.choice(["ja", "nein", "vielleicht é"])))
    rows += [(c, t, "user", "all alike") for c in range(100, 140) for t in range(3)]
    draw.shuffle(rows)
    assert found(spark, rows) == expected(rows)


def test_long_conversations_cross_tiles(spark, monkeypatch):
    monkeypatch.setattr(trie, "TILE_BITS", 2)
    rows = [(c, t, "user", f"turn {t % 7}" if t < cut else f"own {c}") for c, n, cut in ((10, 70, 70), (11, 70, 66), (12, 64, 64), (15, 3, 3), (20, 65, 16), (25, 17, 4)) for t in range(n)]
    assert found(spark, rows) == expected(rows)


def test_real_tile_is_crossed(spark):
    rows = [(c, t, "user", "same" if t < cut else f"own {c}") for c, n, cut in ((10, 140, 140), (11, 140, 130), (16, 131, 64)) for t in range(n)]
    assert found(spark, rows) == expected(rows)


def test_nulls_ties_repeats_and_missing_bases(spark):
    rows = [(0, None, None, "first"), (0, 3, "user", None), (0, 3, "user", "b"), (0, 3, "assistant", "z"), (0, 3, "user", "b"), (None, 1, "user", "lost"), (1, 0, "", "first"), (7, 0, "user", "gone"), (8, 1, "user", ""), (9, None, None, None)]
    rows += [(33, t, "user", "t") for t in range(20)] + [(34, 0, "user", "short")]
    assert found(spark, rows) == expected(rows)


def test_many_members_and_short_pieces(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 20)
    rows = [(5 * c, 0, "user", "hi") for c in range(300)] + [(5 * c, 1, "user", "yes") for c in range(0, 300, 2)]
    assert found(spark, rows, 7) == expected(rows)


def test_no_rows(spark):
    assert found(spark, [(None, 1, "user", "lost")]) == []


@pytest.mark.parametrize("length", [1, 2, 3, 9])
def test_parts_that_begin_alike_have_other_names(spark, length):
    rows = [(10, 0, "a" * length, "bc"), (20, 0, "a" * length + "b", "c")]
    assert found(spark, rows) == expected(rows)
