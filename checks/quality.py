"""Quality reports of book events and of the auction panel, catalogs and definitions."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import book as book_checks
from checks.inputs import (
    BOOK_KEYS, BOOK_SQL, FLAWED_SQL, PANEL_SQL, SESSION, SNAP_SQL, auction_panel, flawed_events,
    snapshots, table, book_events,
)
from checks.shape import emit, sql
from tidebook.operators import panel_quality, quality, sessions
from tidebook.params import Contract

QUERIES, SQL = {}, {}


def query(name, text=None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return add


RULES = [
    "invalid_best_quotes", "locked_books", "crossed_books", "negative_size_or_count",
    "ladder_errors", "tick_misaligned_rows",
]
# A tenth of the rows is doubled so that exact copies exist.
REPORT_SQL = FLAWED_SQL + """,
fed AS (SELECT * FROM flawed UNION ALL SELECT * FROM flawed WHERE action = 'T' AND size = 5),
flags AS (SELECT *, coalesce(bid_px[1] <= 0 OR ask_px[1] <= 0 OR bid_px[1] IS NULL OR ask_px[1] IS NULL, false) AS invalid_best_quotes,
    bid_px[1] = ask_px[1] AS locked_books, bid_px[1] > ask_px[1] AS crossed_books,
    list_min(bid_sz) < 0 OR list_min(ask_sz) < 0 OR list_min(bid_ct) < 0 OR list_min(ask_ct) < 0 AS negative_size_or_count,
    list_bool_or(list_transform(range(1, 10), lambda i: bid_px[i] <= bid_px[i + 1] OR ask_px[i] >= ask_px[i + 1])) AS ladder_errors,
    list_bool_or(list_transform(list_concat(bid_px, ask_px), lambda p: abs(p / 0.25 - round_even(p / 0.25, 0)) > 1e-8)) AS tick_misaligned_rows,
    lag(ts_ns) OVER (PARTITION BY symbol, session_date ORDER BY ingest_ord, ts_ns) AS arrived_before,
    lag(ts_ns) OVER (PARTITION BY symbol, session_date ORDER BY ts_ns) AS earlier
  FROM fed),
counted AS (SELECT symbol, session_date, count(*) AS rows, count_if(action = 'T') AS trades, count_if(ts_ns < arrived_before) AS timestamp_inversions,
    """ + ", ".join(f"count_if({r}) AS {r}" for r in RULES) + """,
    coalesce(max((ts_ns - earlier) / 1e6), 0) AS maximum_receive_gap_ms FROM flags GROUP BY ALL),
dups AS (SELECT symbol, session_date, sum(n - 1) AS exact_duplicate_rows FROM (
    SELECT symbol, session_date, sequence, count(*) AS n FROM fed GROUP BY ALL) GROUP BY ALL),
report AS (SELECT *, timestamp_inversions = 0 AND exact_duplicate_rows = 0 AND invalid_best_quotes = 0 AND crossed_books = 0
    AND negative_size_or_count = 0 AND ladder_errors = 0 AND tick_misaligned_rows = 0 AS accepted
  FROM counted JOIN dups USING (symbol, session_date))"""
REPORT_COLS = (
    "symbol:i session_date:s rows:i trades:i exact_duplicate_rows:i timestamp_inversions:i "
    + " ".join(f"{r}:i" for r in RULES)
    + " maximum_receive_gap_ms:d accepted:b"
)


def fed_events(spark, sf):
    rows = sessions.in_session(flawed_events(spark, sf), SESSION).drop("start_ns", "end_ns")
    # The copies arrive together with their originals.
    return rows.unionByName(rows.where("action = 'T' AND size = 5"))


def report(spark, sf, limit=None):
    return quality.quality_report(fed_events(spark, sf), BOOK_KEYS, 0.25, limit=limit)


@query("book_quality_report", sql(REPORT_SQL, REPORT_COLS, "report"))
def book_quality_report(spark, sf):
    return emit(report(spark, sf).drop("missing_timestamps"))


@query("book_quality_report_blocked", SQL["book_quality_report"])
def book_quality_report_blocked(spark, sf):
    return emit(report(spark, sf, 20).drop("missing_timestamps"))


@query(
    "quarantine_sessions",
    sql(
        REPORT_SQL + """,
result AS (SELECT accepted, count(*) AS events, count(DISTINCT sequence) AS sequences FROM fed JOIN report USING (symbol, session_date) GROUP BY 1)""",
        "accepted:b events:i sequences:i",
    ),
)
def quarantine_sessions(spark, sf):
    events = fed_events(spark, sf)
    good, bad = quality.quarantine(events, report(spark, sf), BOOK_KEYS)
    both = good.withColumn("accepted", F.lit(True)).unionByName(bad.withColumn("accepted", F.lit(False)))
    return emit(
        both.groupBy("accepted").agg(
            F.count("*").alias("events"), F.count_distinct("sequence").alias("sequences")
        )
    )


PROFILE_SQL = (
    REPORT_SQL
    + ","
    + book_checks.TRIMMED_SQL.replace(BOOK_SQL + ",", "", 1)
    + """,
planned AS (SELECT symbol, session_date FROM (SELECT DISTINCT symbol FROM book),
  (SELECT CAST(unnest(generate_series(DATE '2023-12-29', DATE '2024-02-01', INTERVAL 1 DAY)) AS DATE) AS session_date) WHERE isodow(session_date) < 6),
raw AS (SELECT symbol, session_date, count(*) AS decoded_rows, count_if(ts_ns >= start_ns AND ts_ns < end_ns) AS session_rows FROM bounded GROUP BY ALL),
made AS (SELECT symbol, session_date, count(*) AS n FROM trimmed GROUP BY ALL),
profile AS (SELECT p.symbol, p.session_date, decoded_rows, session_rows, coalesce(accepted, false) AS quality_accepted,
    CASE WHEN coalesce(accepted, false) THEN coalesce(n, 0) END AS decision_rows,
    CASE WHEN decoded_rows IS NULL THEN 'missing' WHEN session_rows = 0 THEN 'no_session_data' WHEN NOT accepted THEN 'rejected_quality'
      WHEN coalesce(n, 0) = 0 THEN 'no_processed_rows' ELSE 'processed' END AS status
  FROM planned p LEFT JOIN raw USING (symbol, session_date) LEFT JOIN report USING (symbol, session_date) LEFT JOIN made USING (symbol, session_date)),
totals AS (SELECT field, coalesce(sum(v), 0) AS total, coalesce(max(v), 0) AS maximum FROM (
    UNPIVOT (SELECT decoded_rows, session_rows, decision_rows FROM profile) ON decoded_rows, session_rows, decision_rows INTO NAME field VALUE v) GROUP BY 1)"""
)


def profile(spark, sf):
    events = book_events(spark, sf)
    dated = sessions.with_bounds(
        events.withColumn(
            "session_date",
            sessions.local_date("ts_ns", SESSION.zone),
        ),
        SESSION,
    ).withColumn("inside", F.expr("ts_ns >= start_ns AND ts_ns < end_ns"))
    days = spark.range(1).select(
        F.explode(F.expr("sequence(DATE '2023-12-29', DATE '2024-02-01')")).alias("session_date")
    )
    planned = events.select("symbol").distinct().crossJoin(
        F.broadcast(days.where(F.weekday("session_date") < 5))
    )
    finished = book_checks.decision_table(spark, sf)
    return quality.session_profile(planned, dated, report(spark, sf), finished, BOOK_KEYS)


@query(
    "session_profile",
    sql(PROFILE_SQL, "symbol:i session_date:s status:s decoded_rows:i session_rows:i quality_accepted:b decision_rows:i", "profile"),
)
def session_profile(spark, sf):
    return emit(profile(spark, sf))


@query("session_profile_totals", sql(PROFILE_SQL, "field:s total:i maximum:i", "totals"))
def session_profile_totals(spark, sf):
    return emit(
        quality.profile_totals(profile(spark, sf), ["decoded_rows", "session_rows", "decision_rows"])
    )


@query(
    "contract_definitions",
    sql(
        """raw AS (SELECT p_brand AS symbol, p_size AS ts_recv, p_partkey AS ord,
    CASE WHEN p_partkey % 2 = 0 THEN 250000000e0 ELSE 0.25e0 END AS tick, 50e0 + (p_size % 3 = 0)::INT AS qty FROM part),
newest AS (SELECT symbol, max_by(tick, (ts_recv, ord)) AS t, max_by(qty, (ts_recv, ord)) AS q FROM raw GROUP BY 1),
result AS (SELECT symbol, CASE WHEN abs(t) >= 1e6 THEN t / 1e9 ELSE t END AS tick_size, q AS multiplier,
    t > 0 AND q > 0 AS usable, abs(CASE WHEN abs(t) >= 1e6 THEN t / 1e9 ELSE t END - 0.25) <= 1e-9 AND abs(q - 50) <= 1e-9 AS matches FROM newest)""",
        "symbol:s tick_size:d multiplier:d usable:b matches:b",
    ),
)
def contract_definitions(spark, sf):
    definitions = table(spark, sf, "part").selectExpr(
        "p_brand AS symbol",
        "p_size AS ts_recv",
        "p_partkey AS ingest_ord",
        "CASE WHEN p_partkey % 2 = 0 THEN 250000000D ELSE 0.25D END AS min_price_increment",
        "50D + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS unit_of_measure_qty",
    )
    return emit(quality.verify_definitions(definitions, Contract(0.25, 50.0)))


# --- Auction panel ---------------------------------------------------------------------------------
# Defects are planted by row: the panel itself is clean except for quotes that price formation pushes
# below zero.

FLAWS = {
    "imbalance_buy_sell_flag": "CASE WHEN stock_id % 29 = 3 AND seconds_in_bucket = 50 THEN 2 ELSE imbalance_buy_sell_flag END",
    "seconds_in_bucket": "CASE WHEN stock_id % 31 = 5 AND seconds_in_bucket = 590 THEN 605 ELSE seconds_in_bucket END",
    "bid_size": "CASE WHEN stock_id % 23 = 4 AND seconds_in_bucket = 100 THEN 0 ELSE bid_size END",
    "matched_size": "CASE WHEN stock_id % 19 = 6 AND seconds_in_bucket = 110 THEN -1 ELSE matched_size END",
    "ask_price": "CASE WHEN stock_id % 37 = 7 AND seconds_in_bucket = 120 THEN bid_price - 1 ELSE ask_price END",
    "near_price": "CASE WHEN stock_id % 41 = 8 AND seconds_in_bucket = 130 THEN -5 ELSE near_price END",
    "time_id": "CASE WHEN stock_id % 43 = 9 AND seconds_in_bucket = 140 THEN 7 ELSE time_id END",
}
#: Values that no typed column of the panel has: infinite and not-a-number prices, a fraction for a whole number, no row_id.
ODD = FLAWS | {
    "wap": "CASE WHEN stock_id % 47 = 10 AND seconds_in_bucket = 150 THEN CAST('Infinity' AS DOUBLE) ELSE wap END",
    "far_price": "CASE WHEN stock_id % 53 = 11 AND seconds_in_bucket = 310 THEN CAST('NaN' AS DOUBLE) ELSE far_price END",
    "target": "CASE WHEN stock_id % 59 = 12 AND seconds_in_bucket = 160 THEN CAST('NaN' AS DOUBLE) WHEN stock_id % 61 = 13 AND seconds_in_bucket = 170 THEN CAST('-Infinity' AS DOUBLE) ELSE target END",
    "imbalance_buy_sell_flag": "CASE WHEN stock_id % 29 = 3 AND seconds_in_bucket = 50 THEN 2 WHEN stock_id % 67 = 14 AND seconds_in_bucket = 180 THEN CAST(0.5 AS DOUBLE) ELSE CAST(imbalance_buy_sell_flag AS DOUBLE) END",
    "row_id": "CASE WHEN stock_id % 71 = 15 AND seconds_in_bucket = 190 THEN NULL ELSE row_id END",
}
NAMES = [
    "stock_id", "date_id", "seconds_in_bucket", "imbalance_size", "imbalance_buy_sell_flag", "reference_price",
    "matched_size", "far_price", "near_price", "bid_price", "bid_size", "ask_price", "ask_size", "wap", "target",
    "time_id", "row_id",
]
PANEL_FLAWED_SQL = PANEL_SQL + ", bent AS (SELECT " + ", ".join(
    f"{FLAWS[n]} AS {n}" if n in FLAWS else n for n in NAMES
) + " FROM panel)"


def bent_panel(spark, sf, flaws=FLAWS):
    panel = auction_panel(spark, sf)
    return panel.selectExpr(*[f"{flaws[n]} AS {n}" if n in flaws else n for n in NAMES])


FINITE = [n for n in NAMES if n not in ("far_price", "near_price", "target", "row_id")]
ROW_RULES_SQL = PANEL_SQL + ", bent AS (SELECT " + ", ".join(f"{ODD[n]} AS {n}" if n in ODD else n for n in NAMES) + " FROM panel)" + f""",
marks AS (SELECT
    {" OR ".join(f"{n} IS NULL OR NOT isfinite({n}::DOUBLE)" for n in FINITE)} AS not_finite,
    {" OR ".join(f"coalesce({n}::DOUBLE <> floor({n}::DOUBLE), false)" for n in panel_quality.INTEGERS)} AS not_integral,
    row_id IS NULL AS missing_row_id, coalesce(NOT isfinite(target), false) AS target_not_finite,
    imbalance_buy_sell_flag NOT IN (-1, 0, 1) AS flag_domain,
    seconds_in_bucket < 0 OR seconds_in_bucket >= 600 OR seconds_in_bucket % 10 <> 0 AS second_grid,
    stock_id < 0 OR date_id < 0 OR time_id < 0 AS negative_id,
    bid_size <= 0 OR ask_size <= 0 AS quote_size,
    imbalance_size < 0 OR matched_size < 0 AS auction_size,
    reference_price <= 0 OR bid_price <= 0 OR ask_price <= 0 OR wap <= 0 AS price_sign,
    coalesce(near_price <= 0 OR NOT isfinite(near_price), false) OR coalesce(far_price <= 0 OR NOT isfinite(far_price), false) AS optional_price,
    ask_price < bid_price AS crossed_quote, wap < bid_price OR wap > ask_price AS wap_outside,
    row_id <> date_id || '_' || seconds_in_bucket || '_' || stock_id AS row_id_text
  FROM bent),
result AS (SELECT rule, coalesce(sum(bad::INT), 0) AS failures FROM (UNPIVOT marks ON COLUMNS(*) INTO NAME rule VALUE bad) GROUP BY 1)"""


@query("panel_row_rules", sql(ROW_RULES_SQL, "rule:s failures:i"))
def panel_row_rules(spark, sf):
    return emit(panel_quality.row_rule_counts(bent_panel(spark, sf, ODD)))


SET_RULES_SQL = PANEL_FLAWED_SQL + """,
result AS (
  SELECT 'duplicate_key' AS rule, (SELECT count(*) FROM (SELECT 1 FROM bent GROUP BY date_id, seconds_in_bucket, stock_id HAVING count(*) > 1)) AS failures
  UNION ALL SELECT 'duplicate_row_id', (SELECT count(*) FROM (SELECT 1 FROM bent GROUP BY row_id HAVING count(*) > 1))
  UNION ALL SELECT 'time_id_has_many_slots', (SELECT count(*) FROM (SELECT 1 FROM bent GROUP BY time_id HAVING count(DISTINCT (date_id, seconds_in_bucket)) > 1))
  UNION ALL SELECT 'slot_has_many_time_ids', (SELECT count(*) FROM (SELECT 1 FROM bent GROUP BY date_id, seconds_in_bucket HAVING count(DISTINCT time_id) > 1)))"""


@query("panel_set_rules", sql(SET_RULES_SQL, "rule:s failures:i"))
def panel_set_rules(spark, sf):
    return emit(panel_quality.set_rule_counts(bent_panel(spark, sf)))


@query(
    "panel_order_breaks",
    """WITH keyed AS (SELECT l_orderkey, l_linenumber, lag((l_orderkey, l_linenumber)) OVER (ORDER BY ord) AS prev
         FROM (SELECT l_orderkey, l_linenumber, l_suppkey * 1000000000 + l_orderkey * 10 + l_linenumber AS ord FROM lineitem))
       SELECT count_if(prev > (l_orderkey, l_linenumber)) AS order_breaks FROM keyed""",
)
def panel_order_breaks(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_suppkey * 1000000000 + l_orderkey * 10 + l_linenumber AS ingest_ord"
    )
    return emit(panel_quality.order_breaks(lines, ["l_orderkey", "l_linenumber"], "ingest_ord", limit=2000))


@query(
    "panel_profile",
    sql(
        PANEL_SQL + """,
times AS (SELECT time_id, count(*) AS n FROM panel GROUP BY 1),
modal AS (SELECT min(n) AS m FROM (SELECT n, count(*) AS c FROM times GROUP BY 1 QUALIFY c = max(c) OVER ())),
result AS (SELECT count(*) AS rows, count(DISTINCT stock_id) AS stocks, min(date_id) AS date_id_min, max(date_id) AS date_id_max,
    count(DISTINCT date_id) AS dates, count(DISTINCT time_id) AS time_ids, (SELECT min(n) FROM times) AS rows_per_time_min,
    (SELECT max(n) FROM times) AS rows_per_time_max, (SELECT m FROM modal) AS rows_per_time_mode,
    (SELECT count(*) FROM times WHERE n < (SELECT m FROM modal)) AS times_below_mode,
    count(DISTINCT (stock_id, date_id)) AS stock_date_pairs, count_if(near_price IS NULL) AS near_missing,
    count_if(far_price IS NULL) AS far_missing, count_if(target IS NULL) AS target_missing FROM panel)""",
        "rows:i stocks:i date_id_min:i date_id_max:i dates:i time_ids:i rows_per_time_min:i rows_per_time_max:i "
        "rows_per_time_mode:i times_below_mode:i stock_date_pairs:i near_missing:i far_missing:i target_missing:i",
    ),
)
def panel_profile(spark, sf):
    return emit(panel_quality.profile(auction_panel(spark, sf)))


@query(
    "panel_date_coverage",
    sql(
        PANEL_SQL + """,
expected AS (SELECT CAST(unnest(range(-1, 9)) AS BIGINT) AS date_id),
seen AS (SELECT date_id, count(target) AS targets FROM panel GROUP BY 1),
result AS (SELECT coalesce(e.date_id, s.date_id) AS date_id, CASE WHEN s.date_id IS NULL THEN 'missing'
    WHEN e.date_id IS NULL THEN 'unexpected' WHEN targets = 0 THEN 'no_target' ELSE 'covered' END AS status
  FROM expected e FULL JOIN seen s ON e.date_id = s.date_id)""",
        "date_id:i status:s",
    ),
)
def panel_date_coverage(spark, sf):
    return emit(panel_quality.date_coverage(auction_panel(spark, sf), -1, 8))


# --- Snapshot matrices -----------------------------------------------------------------------------

@query(
    "snapshot_checks",
    sql(
        SNAP_SQL + """,
result AS (SELECT block, count(*) AS observations, count_if(len(features) <> 64) AS bad_width,
    count_if(len(list_filter(features, lambda v: isnan(v) OR isinf(v))) > 0) AS not_finite,
    count_if(len(list_filter(labels, lambda v: v NOT IN (1, 2, 3))) > 0) AS bad_labels FROM snap GROUP BY 1)""",
        "block:i observations:i bad_width:i not_finite:i bad_labels:i",
    ),
)
def snapshot_checks(spark, sf):
    return emit(panel_quality.snapshot_checks(snapshots(spark, sf), ["block"], width=64))


# --- Canonical events from text --------------------------------------------------------------------

def raw_text(spark, sf):
    """Book events as a CSV reader would deliver them: text columns, some cells unreadable."""
    ladders = [
        f"CASE WHEN '{n}_{i:02d}' = 'bid_px_00' AND event_type = 'error' THEN 'n/a' ELSE cast({src}[{i}] AS string) END AS {n}_{i:02d}"
        for n, src in (("bid_px", "bid_px"), ("ask_px", "ask_px"), ("bid_sz", "bid_sz"), ("ask_sz", "ask_sz"), ("bid_ct", "bid_sz"), ("ask_ct", "ask_sz"))
        for i in range(quality.DEPTH)
    ]
    stamp = "date_format(timestamp_micros({0} div 1000), \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS\") || '789Z' AS {1}"
    return book_events(spark, sf).selectExpr(
        "symbol", stamp.format("ts_ns", "ts_recv"), stamp.format("ts_event_ns", "ts_event"), "action", "side",
        "cast(sequence AS string) AS sequence", "cast(bid_px[0] AS string) AS price", "cast(size AS string) AS size", *ladders,
    )


@query(
    "canonical_events",
    sql(
        BOOK_SQL + """, result AS (SELECT symbol, ts_ns + 789 AS ts_ns, ts_event_ns + 789 AS ts_event_ns, sequence, size::DOUBLE AS size, bid_px[1] AS price,
    CASE WHEN event_type <> 'error' THEN bid_px[1] END AS best_bid, ask_px[10] AS far_ask, list_sum(ask_sz) AS ask_total FROM book)""",
        "symbol:i ts_ns:i ts_event_ns:i sequence:i size:d price:d best_bid:d far_ask:d ask_total:d",
    ),
)
def canonical_events(spark, sf):
    rows = quality.canonical_events(raw_text(spark, sf))
    total = F.aggregate("ask_sz", F.lit(0.0), lambda a, b: a + b)
    return emit(
        rows.select(
            "symbol", "ts_ns", "ts_event_ns", "sequence", "size", "price", F.col("bid_px")[0].alias("best_bid"),
            F.col("ask_px")[9].alias("far_ask"), total.alias("ask_total"),
        )
    )
