"""Book features: hand-computed values, causality, borders and units."""

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from tidebook.operators import asof, book, sessions
from tidebook.params import BookParams, SessionParams

NS = 1_000_000
SESSION = SessionParams(zone="America/New_York", start="09:35:00", end="09:35:08", grid_ms=100, max_age_ms=500)
PARAMS = BookParams(flow_ms=(100, 500), trade_ms=(500,), intensity_ms=500, return_ms=300, horizons_ms=(100, 500))
OPEN = 1_773_668_100_000 * NS  # 2026-03-16 13:35:00 UTC, 09:35 in New York
SCHEMA = (
    "symbol string, ts_ns long, sequence long, action string, side string, size double, "
    "bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>"
)


def event(i, bump=0.0, step_ms=20):
    bid = 6000.0 + 0.25 * ((i // 9) % 5) + bump
    bids, asks = [bid - 0.25 * l for l in range(10)], [bid + 0.25 + 0.25 * l for l in range(10)]
    action = "T" if i % 7 == 0 else "A" if i % 3 else "C"
    return (
        "ES", OPEN + i * step_ms * NS, i + 1, action, "B" if i % 2 == 0 else "A", float(1 + i % 5),
        bids, [float(20 + (i * 7 + 3 * l) % 30) for l in range(10)],
        asks, [float(20 + (i * 5 + 3 * l) % 30) for l in range(10)],
    )


def table(spark, rows):
    return sessions.in_session(spark.createDataFrame(rows, SCHEMA), SESSION)


def decisions(spark, rows, limit=None):
    out = book.features_and_labels(table(spark, rows), ["symbol", "session_date"], SESSION, PARAMS, limit)
    return {r["decision_ns"]: r for r in out.collect()}


def test_level_one_formulas(spark):
    row = spark.createDataFrame([([99.75], [30.0], [100.25], [10.0])], "bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>")
    got = row.select(*[c.alias(n) for n, c in book.state_features(BookParams(depth_levels=(1,))).items()]).first()
    assert got["midpoint"] == 100.0 and got["spread_ticks"] == 2.0 and got["queue_imbalance_l1"] == 0.5
    assert got["microprice_displacement_ticks"] == pytest.approx(((100.25 * 30 + 99.75 * 10) / 40 - 100) / 0.25)
    assert got["log_top_depth"] == pytest.approx(math.log1p(40)) and got["depth_imbalance_l1"] == 0.5


def test_zero_depth_falls_back(spark):
    row = spark.createDataFrame([([99.75], [0.0], [100.25], [0.0])], "bid_px array<double>, bid_sz array<double>, ask_px array<double>, ask_sz array<double>")
    got = row.select(*[c.alias(n) for n, c in book.state_features(BookParams(depth_levels=(1,))).items()]).first()
    assert got["queue_imbalance_l1"] == 0 and got["microprice_displacement_ticks"] == 0 and got["depth_imbalance_l1"] == 0


def test_trailing_windows_match_brute_force(spark):
    events = [event(i) for i in range(400)]
    got = decisions(spark, events)
    increments = [0.0]
    for p, e in zip(events, events[1:]):
        pb, pbs, pa, pas = p[6][0], p[7][0], p[8][0], p[9][0]
        b, bs, a, sz = e[6][0], e[7][0], e[8][0], e[9][0]
        increments.append((b >= pb) * bs - (b <= pb) * pbs - (a <= pa) * sz + (a >= pa) * pas)
    for t in list(got)[::9]:
        inside = [i for i, e in enumerate(events) if t - 500 * NS < e[1] <= t]
        now = events[max(i for i, e in enumerate(events) if e[1] <= t)]
        row = got[t]
        assert row["ofi_500ms"] == pytest.approx(sum(increments[i] for i in inside) / max(now[7][0] + now[9][0], 1))
        signed = sum((1 if events[i][4] == "B" else -1) * events[i][5] for i in inside if events[i][3] == "T")
        total = sum(events[i][5] for i in inside if events[i][3] == "T")
        assert row["trade_imbalance_500ms"] == pytest.approx(signed / total if total else 0)
        assert row["event_intensity_500ms"] == len(inside) / 0.5
        assert row["sequence"] == now[2]


def test_changing_the_future_does_not_move_the_past(spark):
    cut = 200
    before = decisions(spark, [event(i) for i in range(400)])
    after = decisions(spark, [event(i, bump=0.0 if i < cut else 5.0) for i in range(400)])
    border = OPEN + cut * 20 * NS
    names = book.feature_names(PARAMS)
    checked = 0
    for t, row in before.items():
        if t < border:
            assert [row[n] for n in names] == [after[t][n] for n in names]
            checked += 1
    assert checked > 20
    assert any(before[t]["midpoint"] != after[t]["midpoint"] for t in before if t >= border)


def test_input_order_and_blocks_do_not_matter(spark):
    events = [event(i) for i in range(300)]
    whole = decisions(spark, events)
    shuffled = decisions(spark, [events[(i * 71) % 300] for i in range(300)], limit=40)
    assert whole.keys() == shuffled.keys()
    for t in whole:
        assert whole[t].asDict() == shuffled[t].asDict()


def test_session_end_is_exclusive_and_sessions_are_isolated(spark):
    close = OPEN + 8_000 * NS
    early = [("ES", OPEN - 1, 1, "T", "B", 9.0, *event(0)[6:])]
    late = [("ES", close, 2, "T", "B", 9.0, *event(0)[6:])]
    kept = table(spark, [*early, *[event(i) for i in range(5)], *late]).select("ts_ns").collect()
    assert sorted(r[0] for r in kept) == [event(i)[1] for i in range(5)]


def test_labels_respect_age_and_missing_is_flat(spark):
    events = [event(i) for i in range(10)] + [event(200)]
    rows = [("ES", OPEN + 200 * NS, 100.0), ("ES", OPEN + 3_000 * NS, 100.0)]
    made = spark.createDataFrame(rows, "symbol string, decision_ns long, midpoint double")
    got = book.build_labels(spark.createDataFrame(events, SCHEMA), made, ["symbol"], PARAMS, 500)
    first, second = sorted(got.collect(), key=lambda r: r["decision_ns"])
    assert first["label_source_ns_500ms"] == events[9][1] and first["future_midpoint_500ms"] is None is not first["future_midpoint_100ms"]
    assert second["future_midpoint_100ms"] is None and second["direction_100ms"] == "flat"
    assert first["label_source_ns_100ms"] <= first["label_target_ns_100ms"]


def test_asof_takes_exact_match_and_last_of_ties(spark):
    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9)], "k string, t long")
    right = spark.createDataFrame([("a", 5, 1, 10.0), ("a", 5, 2, 20.0), ("a", 3, 9, 30.0)], "k string, u long, seq long, v double")
    for limit in (None, 1):
        got = asof.asof_join(left, right, ["k"], "t", "u", ["v"], ["seq"], limit=limit).collect()
        assert {(r["k"], r["t"]): r["v"] for r in got} == {("a", 5): 20.0, ("a", 1): None, ("b", 9): None}


def test_session_bounds_follow_daylight_saving(spark):
    days = spark.createDataFrame([(date(2026, 3, 6),), (date(2026, 3, 9),)], "session_date date")
    got = sessions.with_bounds(days, SessionParams()).select(
        F.timestamp_micros((F.col("start_ns") / 1000).cast("long")).cast("string")
    ).collect()
    assert [r[0] for r in got] == ["2026-03-06 14:35:00", "2026-03-09 13:35:00"]


def test_positional_lag_skips_stale_ticks(spark):
    rows = [("a", i, float(m)) for i, m in [(0, 100), (1, 101), (5, 103), (6, 106)]]
    df = spark.createDataFrame(rows, "k string, decision_ns long, midpoint double")
    got = book.positional_returns(df, ["k"], BookParams(return_ms=200, tick=1.0), 100).orderBy("decision_ns").collect()
    assert [r["lagged_mid_return_200ms_ticks"] for r in got] == [None, None, 3.0, 5.0]
    assert [r["realized_vol_200ms_ticks"] for r in got] == [None, None, 0.5, 0.5]
