"""Virtual slots: balance, gapless places, equal texts together, versions and rebalancing."""

import random
import zlib
from collections import Counter, defaultdict

from tidebook.llm import slots


def rows(seed, n, copies=0):
    draw = random.Random(seed)
    made = [(i, "é" * draw.randint(0, 300) + str(i)) for i in range(n)]
    made += [(n + i, "one text that many rows share " * 4) for i in range(copies)]
    return made + [(None, "no id"), (10**6, None), (10**6, None), (7, made[0][1]), (7, made[0][1]), (10**6 + 1, ""), (10**6 + 2, "x" * 200_000)]


def placed(spark, data, **more):
    docs = spark.createDataFrame([(*r, 1, "clash") for r in data], "doc_id long, text string, slot int, shard string").repartition(4)
    return slots.shard_rows(docs, **more).collect()


def test_every_row_has_one_place(spark):
    data = rows(1, 3000)
    got = placed(spark, data, shards=5)
    assert Counter((r.id, r.size, r.crc) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in data)
    places = defaultdict(list)
    for r in got:
        places[r.shard].append(r.place)
    assert sorted(places) == list(range(5)) and all(sorted(p) == list(range(len(p))) for p in places.values())
    loads = [sum(r.size for r in got if r.shard == s) for s in range(5)]
    assert max(loads) - min(loads) <= max(r.size for r in got)
    shards_of = defaultdict(set)
    for r in got:
        shards_of[r.size, r.crc].add(r.shard)
    assert all(len(s) == 1 for s in shards_of.values())


def test_a_text_above_a_whole_shard_is_split(spark):
    got = placed(spark, rows(2, 200, copies=4000), shards=8)
    loads = [sum(r.size for r in got if r.shard == s) for s in range(8)]
    assert sorted(loads)[-2] < 1.02 * (sum(loads) - 200_000) / 7  # one row alone is larger than a shard's share


def test_versions_and_rebalancing(spark, tmp_path):
    folder, first = str(tmp_path / "map"), rows(3, 1500)
    docs = spark.createDataFrame(first, "doc_id long, text string")
    slots.shard_rows(docs, shards=4, map_folder=folder).count()
    old = slots.load_map(spark, folder)
    more = first + [(10**7 + i, "new " * 300 + str(i)) for i in range(400)]
    slots.shard_rows(spark.createDataFrame(more, "doc_id long, text string"), shards=5, map_folder=folder).count()
    new = slots.load_map(spark, folder)
    assert (old.version, new.version, new.shards) == (1, 2, 5) and slots.load_map(spark, folder, 1) == old
    size_of = {(s, c): b for s, c, b, _ in slots.cell_sizes(slots.sized(spark.createDataFrame(more, "doc_id long, text string"), "doc_id", "text"))}
    loads = new.loads(size_of)
    assert max(loads) <= 1.02 * sum(loads) / 5 or max(loads) - min(loads) <= max(size_of.values())
    moved = sum(size_of.get(c, 0) for c, s in old.shard_of.items() if new.shard_of[c] != s)
    assert moved < 0.5 * sum(size_of.values())


def test_growing_takes_rows_into_the_new_shard_only():
    size_of = {(s, 0): 10 + s % 7 for s in range(400)}
    old = slots.balanced_map(size_of, 4)
    new = slots.grown(old, size_of)
    changed = {new.shard_of[c] for c in size_of if new.shard_of[c] != old.shard_of[c]}
    assert changed == {4} and new.version == 2


def test_no_rows(spark):
    assert placed(spark, [], shards=3) == []
