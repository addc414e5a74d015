import random

import pytest
from pyspark.sql import functions as F

from tests.test_book import NS, OPEN, SCHEMA, event
from tidebook.operators import fills


def swept(spark, prices, sizes, quantity):
    df = spark.createDataFrame([(prices, sizes)], "p array<double>, s array<double>")
    return df.select(fills.sweep(F.col("p"), F.col("s"), F.lit(quantity)).alias("f")).first()["f"]


def test_sweep_levels(spark):
    assert swept(spark, [100.0, 101.0], [5.0, 5.0], 3) == (100.0, 1)
    assert swept(spark, [100.0, 101.0, 102.0], [2.0, 2.0, 9.0], 5) == (pytest.approx((200 + 202 + 102) / 5), 3)
    assert swept(spark, [100.0, 0.0, 102.0], [2.0, 2.0, 9.0], 3) == (pytest.approx((200 + 102) / 3), 3)
    assert swept(spark, [100.0, 101.0], [2.0, 2.0], 5) is None


def test_flat_round_trip_pays_spread_and_fees_once(spark):
    book = "struct<bid_px:array<double>,bid_sz:array<double>,ask_px:array<double>,ask_sz:array<double>>"
    df = spark.createDataFrame([(([99.75], [9.0], [100.0], [9.0]),)], f"b {book}")
    terms = fills.round_trip(F.col("b"), F.col("b"), F.lit(True), F.lit(2), 50.0, F.lit(2.5))
    got = df.select(*[c.alias(n) for n, c in terms.items()]).first()
    assert got["gross_pnl"] == -25.0 and got["fees"] == 10.0 and got["net_pnl"] == -35.0


@pytest.mark.parametrize("limit", [None, 30])
def test_trades_do_not_overlap_and_use_only_known_books(spark, limit):
    events = spark.createDataFrame([event(i) for i in range(400)], SCHEMA)
    signals = spark.createDataFrame(
        [("ES", OPEN + i * 100 * NS, 5.0 if i % 2 else -5.0) for i in range(1, 60)], "symbol string, decision_ns long, prediction double"
    )
    got = fills.marketable_trades(
        events, signals, ["symbol"], [fills.Scenario(10, 1, 2.5, 0.0)],
        horizon_ms=500, tick=0.25, multiplier=50.0, max_age_ms=100, limit=limit,
    ).orderBy("decision_ns").collect()
    assert len(got) > 2
    for r in got:
        assert r["entry_source_ns"] <= r["entry_target_ns"] and r["exit_source_ns"] <= r["exit_target_ns"]
    assert all(b["decision_ns"] >= a["exit_target_ns"] for a, b in zip(got, got[1:]))


def test_empty_summary_is_zero(spark):
    df = spark.createDataFrame([], "gross_pnl double, fees double, net_pnl double")
    got = fills.trade_summary(df).first()
    assert got["trades"] == 0 and got["net_pnl"] == 0.0 and got["hit_rate"] is None


@pytest.mark.parametrize("limit", [None, 4])
def test_tied_starts_are_taken_once(spark, limit):
    rows = [("a", 10, 20, 1), ("a", 10, 18, 2), ("a", 10, 18, 3), ("a", 15, 30, 4), ("a", 18, 40, 5), ("a", 40, 41, 6), ("a", 40, 60, 7)]
    rows += [(None, t, t + 3, t) for t in range(50)] + [("b", 5, 1_000_000, 1), ("b", 6, 7, 2), ("b", 1_000_000, 1_000_001, 3)]
    df = spark.createDataFrame(rows, "k string, s long, e long, n int").repartition(3)
    got = sorted(((r.k or "", r.s, r.e, r.n) for r in fills.non_overlapping(df, ["k"], "s", "e", limit).collect()))
    want = [("", t, t + 3, t) for t in range(0, 50, 3)]
    want += [("a", 10, 18, 2), ("a", 18, 40, 5), ("a", 40, 41, 6), ("b", 5, 1_000_000, 1), ("b", 1_000_000, 1_000_001, 3)]
    assert got == want


def greedy(rows):
    """The selection in plain Python: per key by (start, end, n), one row a start."""
    kept = []
    for key in {r[0] for r in rows}:
        free, last = None, None
        for r in sorted(r for r in rows if r[0] == key):
            if r[1] != last and (free is None or r[1] >= free):
                kept.append(r)
                free = r[2]
            last = r[1]
    return sorted(kept)


@pytest.mark.parametrize(("limit", "outliers"), [(25, 0), (25, 3), (7, 40), (1000, 3)])
def test_long_holds_in_a_hot_key_equal_the_walk(spark, limit, outliers):
    draw = random.Random(limit + outliers)
    rows = [("hot", s := draw.randrange(4000), s + draw.randrange(1, 60), n) for n in range(600)]
    rows += [("hot", s := draw.randrange(4000), s + draw.randrange(300, 3000), 1000 + n) for n in range(outliers)]
    rows += [(k, s := draw.randrange(500), s + draw.randrange(1, 90), 2000 + n) for n, k in enumerate("abc" * 20)]
    df = spark.createDataFrame(rows, "k string, s long, e long, n int").repartition(3)
    got = sorted(tuple(r) for r in fills.non_overlapping(df, ["k"], "s", "e", limit).collect())
    assert got == greedy(rows)
