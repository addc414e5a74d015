from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from tests.test_book import OPEN, SCHEMA, event
from tidebook.operators import panel_quality, quality, sessions
from tidebook.params import Contract


def report(spark, rows, counts="array_repeat(3D, 10)"):
    numbered = [(*r, i) for i, r in enumerate(rows)]
    df = spark.createDataFrame(numbered, SCHEMA + ", ingest_ord long").withColumns({"bid_ct": F.expr(counts), "ask_ct": F.expr("array_repeat(2D, 10)")})
    return quality.quality_report(df, ["symbol"], 0.25).first()


def changed(i, **edits):
    names = ["symbol", "ts_ns", "sequence", "action", "side", "size", "bid_px", "bid_sz", "ask_px", "ask_sz"]
    row = dict(zip(names, event(i)))
    row.update({k: f(row[k]) for k, f in edits.items()})
    return tuple(row[n] for n in names)


def test_clean_session_is_accepted(spark):
    got = report(spark, [event(i) for i in range(60)])
    assert got["accepted"] and got["rows"] == 60 and got["trades"] == 9 and got["maximum_receive_gap_ms"] == 20.0


@pytest.mark.parametrize(
    "rule, row",
    [
        ("crossed_books", changed(60, ask_px=lambda a: [a[0] - 1.0, *a[1:]])),
        ("negative_size_or_count", changed(60, bid_sz=lambda s: [*s[:5], -1.0, *s[6:]])),
        ("ladder_errors", changed(60, ask_px=lambda a: [*a[:4], a[3], *a[5:]])),
        ("tick_misaligned_rows", changed(60, bid_px=lambda b: [p - 0.1 for p in b])),
        ("invalid_best_quotes", changed(60, bid_px=lambda b: [None, *b[1:]])),
        ("timestamp_inversions", changed(60, ts_ns=lambda t: OPEN + 1)),
        ("exact_duplicate_rows", event(59)),
        ("missing_timestamps", changed(60, ts_ns=lambda t: None)),
    ],
)
def test_each_defect_is_counted_and_rejected(spark, rule, row):
    got = report(spark, [*[event(i) for i in range(60)], row])
    assert got[rule] == 1 and not got["accepted"]


def test_negative_counts_are_seen_without_negative_sizes(spark):
    counts = "CASE WHEN ingest_ord = 7 THEN array(3D, -1D) ELSE array_repeat(3D, 10) END"
    got = report(spark, [event(i) for i in range(60)], counts)
    assert got["negative_size_or_count"] == 1 and not got["accepted"]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_sessions_do_not_depend_on_the_time_zone_of_the_session(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        # the weeks in which New York and Europe change their clocks, and a winter day before the epoch
        days = spark.createDataFrame([("2026-03-06",), ("2026-03-09",), ("2026-10-30",), ("2026-11-02",), ("1965-01-04",)], "d string").select(F.col("d").cast("date").alias("d"))
        bounds = {str(r.d): r.b for r in days.select("d", sessions.bound_ns(F.col("d"), "09:35:00", "America/New_York").alias("b")).collect()}
        hours = {"2026-03-06": 14, "2026-03-09": 13, "2026-10-30": 13, "2026-11-02": 14, "1965-01-04": 14}
        for day, hour in hours.items():
            begin = datetime.fromisoformat(day).replace(hour=hour, minute=35, tzinfo=timezone.utc)
            assert bounds[day] == int(begin.timestamp()) * 10**9
        late = [(bounds["2026-03-06"] + 10 * 3600 * 10**9, "2026-03-06"), (bounds["2026-11-02"] - 10 * 3600 * 10**9, "2026-11-01"), (-1, "1969-12-31")]
        got = spark.createDataFrame(late, "t long, d string").select(sessions.local_date("t", "America/New_York").cast("string").alias("g"), "d").collect()
        assert all(r.g == r.d for r in got)
        texts = ["2026-03-16T13:35:00.5", "2026-03-16 13:35:00.500000000", "2026-03-16T13:35:00.5Z", "2026-03-16T09:35:00.5-04:00"]
        nanos = spark.createDataFrame([(t,) for t in texts], "t string").select(quality.utc_nanos(F.col("t")).alias("n")).collect()
        assert {r.n for r in nanos} == {int(datetime(2026, 3, 16, 13, 35, tzinfo=timezone.utc).timestamp()) * 10**9 + 500_000_000}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


def test_locked_book_alone_is_tolerated(spark):
    got = report(spark, [*[event(i) for i in range(60)], changed(60, ask_px=lambda a: [a[0] - 0.25, *a[1:]])])
    assert got["locked_books"] == 1 and got["accepted"]


def test_definitions_use_newest_and_scale(spark):
    rows = [("A", 1, 0, 0.5, 50.0), ("A", 2, 1, 250_000_000.0, 50.0), ("B", 1, 2, 0.25, 20.0), ("C", 1, 3, 0.0, 50.0)]
    df = spark.createDataFrame(rows, "symbol string, ts_recv int, ingest_ord int, min_price_increment double, unit_of_measure_qty double")
    got = {r["symbol"]: r for r in quality.verify_definitions(df, Contract(0.25, 50.0)).collect()}
    assert got["A"]["tick_size"] == 0.25 and got["A"]["matches"]
    assert not got["B"]["matches"] and not got["C"]["usable"]


def test_nanoseconds_survive(spark):
    df = spark.createDataFrame([("2026-03-16T13:35:00.123456789Z",), ("2026-03-16T13:35:00Z",), ("bad",)], "t string")
    got = [r[0] for r in df.select(quality.utc_nanos(F.col("t"))).collect()]
    assert got == [OPEN + 123_456_789, OPEN, None]


def test_panel_row_rules(spark):
    good = (1, 2, 30, 5.0, 1, 10.0, 7.0, None, None, 9.0, 4.0, 11.0, 4.0, 10.0, 1.0, 5, "SYNTHETIC_2_30_1")
    schema = (
        "stock_id long, date_id long, seconds_in_bucket long, imbalance_size double, imbalance_buy_sell_flag long, reference_price double, "
        "matched_size double, far_price double, near_price double, bid_price double, bid_size double, ask_price double, ask_size double, "
        "wap double, target double, time_id long, row_id string"
    )
    bad = [
        (*good[:4], 3, *good[5:]),
        (*good[:2], 35, *good[3:16], "2_35_1"),
        (*good[:7], -1.0, *good[8:]),
        (*good[:13], 12.0, *good[14:]),
        (*good[:14], float("inf"), *good[15:]),
        (*good[:16], "2_30_9"),
    ]
    count = lambda rows: {r["rule"]: r["failures"] for r in panel_quality.row_rule_counts(spark.createDataFrame(rows, schema)).collect()}
    assert set(count([good]).values()) == {0}
    got = count([good, *bad])
    assert all(got[r] == 1 for r in ("flag_domain", "second_grid", "optional_price", "wap_outside", "target_not_finite", "row_id_text"))
