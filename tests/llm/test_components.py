"""Connected components on awkward graphs."""

import random

from tidebook.llm.components import components


def expected(links):
    near, least = {}, {}
    for a, b in links:
        if a is not None and b is not None and a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    for start in sorted(near):
        todo = [start] if start not in least else []
        while todo:
            n = todo.pop()
            if n not in least:
                least[n] = start
                todo += near[n]
    return least


def test_paths_stars_and_odd_links(spark):
    draw = random.Random(1)
    links = [(i, i + 1) for i in range(300)] + [(1000, 1001 + i) for i in range(400)] + [(5000 - i, 5001 - i) for i in range(50)]
    links += [(draw.randrange(10_000, 10_200), draw.randrange(10_000, 10_200)) for _ in range(150)]
    links += [(7, 7), (None, 3), (4, None), (0, 1), (1, 0), (20_000, 20_000), (-5, 2**62)]
    draw.shuffle(links)
    got = components(spark.createDataFrame(links, "a long, b long").repartition(3), "a", "b").collect()
    want, by_root = expected(links), {}
    assert {r.node for r in got} == set(want) and len(got) == len(want)
    for r in got:
        by_root.setdefault(r.root, set()).add(want[r.node])
    assert all(len(x) == 1 for x in by_root.values()) and len(by_root) == len(set(want.values()))


def test_no_links(spark):
    assert components(spark.createDataFrame([(1, 1)], "a long, b long"), "a", "b").collect() == []
