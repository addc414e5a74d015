"""Book study: sessions, decision clock, as-of states, features and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.inputs import (
    BOOK, BOOK_KEYS, BOOK_SQL, GRID_SQL, SESSION, book_events, in_session_events, micros, table,
)
from checks.shape import emit, sql
from tidebook.operators import asof, blocks, book, sessions
from tidebook.params import SplitRange

QUERIES, SQL = {}, {}
SMALL_BLOCK = 500  # forces the block path on small tables


def query(name, text=None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return add


# --- Sessions and clocks ---------------------------------------------------------------------------

@query(
    "session_filter",
    sql(BOOK_SQL, "symbol:i session_date:s sequence:i start_ns:i end_ns:i", "sess"),
)
def session_filter(spark, sf):
    return emit(
        in_session_events(spark, sf).select("symbol", "session_date", "sequence", "start_ns", "end_ns")
    )


CALENDAR = """span AS (SELECT min(epoch_us(ts)) * 1000 AS a, max(epoch_us(ts)) * 1000 AS b FROM events),
days AS (SELECT a, b, CAST(unnest(generate_series(
    CAST(make_timestamp(a // 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE),
    CAST(make_timestamp(b // 1000) AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE), INTERVAL 1 DAY)) AS DATE) AS session_date FROM span),
bounds AS (SELECT *, epoch_us((session_date + TIME '09:35:00') AT TIME ZONE 'America/New_York') * 1000 AS start_ns,
    epoch_us((session_date + TIME '15:55:00') AT TIME ZONE 'America/New_York') * 1000 AS end_ns FROM days WHERE isodow(session_date) < 6),
result AS (SELECT * FROM bounds WHERE start_ns >= a AND end_ns <= b)"""


@query("session_calendar", sql(CALENDAR, "session_date:s start_ns:i end_ns:i"))
def session_calendar(spark, sf):
    span = book_events(spark, sf).agg(
        F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns")
    )
    return emit(sessions.calendar(span, SESSION))


@query(
    "decision_grid",
    sql(BOOK_SQL + "," + GRID_SQL, "symbol:i session_date:s start_ns:i end_ns:i decision_ns:i", "grid"),
)
def decision_grid(spark, sf):
    return emit(sessions.decision_grid(in_session_events(spark, sf), BOOK_KEYS, SESSION))


@query(
    "sampled_states",
    sql(
        BOOK_SQL + "," + GRID_SQL
        + ", result AS (SELECT *, bid_px[1] AS bid, ask_px[1] AS ask, ask_sz[10] AS far_size FROM states)",
        "symbol:i session_date:s decision_ns:i source_ns:i sequence:i bid:d ask:d far_size:d quote_age_ms:d",
    ),
)
def sampled_states(spark, sf, limit=None):
    states = book.sampled_states(in_session_events(spark, sf), BOOK_KEYS, SESSION, limit)
    return emit(
        states.select(
            "symbol", "session_date", "decision_ns", "source_ns", "sequence",
            F.col("bid_px")[0].alias("bid"), F.col("ask_px")[0].alias("ask"),
            F.col("ask_sz")[9].alias("far_size"), "quote_age_ms",
        )
    )


@query("sampled_states_blocked", SQL["sampled_states"])
def sampled_states_blocked(spark, sf):
    return sampled_states(spark, sf, 20)


SPLITS = [
    SplitRange("train", "1995-01-01", "1997-12-31"),
    SplitRange("validation", "1998-01-01", "1999-06-30"),
    SplitRange("holdout", "1999-07-01", "2000-12-31"),
]


@query(
    "split_assignment",
    """SELECT CASE WHEN d <= '1997-12-31' THEN 'train' WHEN d <= '1999-06-30' THEN 'validation'
         WHEN d <= '2000-12-31' THEN 'holdout' END AS split, count(*) AS orders, min(d) AS first_date, max(d) AS last_date
       FROM (SELECT strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders) GROUP BY 1""",
)
def split_assignment(spark, sf):
    dated = table(spark, sf, "orders").withColumn("d", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return (
        dated.withColumn("split", sessions.split_of(F.col("d"), SPLITS))
        .groupBy("split")
        .agg(F.count("*").alias("orders"), F.min("d").alias("first_date"), F.max("d").alias("last_date"))
    )


# --- As-of joins -----------------------------------------------------------------------------------

ASOF = """v AS (SELECT user_id, event_id, epoch_us(ts) AS us FROM events WHERE event_type = 'view'),
p AS (SELECT user_id, event_id AS purchase_id, value, epoch_us(ts) AS us FROM events WHERE event_type = 'purchase'),
result AS (SELECT v.user_id, v.event_id, CASE WHEN {age} THEN p.purchase_id END AS purchase_id, CASE WHEN {age} THEN p.value END AS value
  FROM v ASOF LEFT JOIN p ON v.user_id = p.user_id AND v.us >= p.us)"""


def views_and_purchases(spark, sf):
    events = table(spark, sf, "events").withColumn("us", micros("ts"))
    views = events.where("event_type = 'view'").select("user_id", "event_id", "us")
    bought = events.where("event_type = 'purchase'").select(
        "user_id", F.col("event_id").alias("purchase_id"), "value", "us"
    )
    return views, bought


def _asof(spark, sf, **kw):
    views, bought = views_and_purchases(spark, sf)
    out = asof.asof_join(
        views, bought, ["user_id"], "us", "us", ["purchase_id", "value"], ["purchase_id"], **kw
    )
    return emit(out.drop("us"))


@query("asof_join", sql(ASOF.format(age="true"), "user_id:i event_id:i purchase_id:i value:d"))
def asof_join(spark, sf):
    return _asof(spark, sf)


@query("asof_join_blocked", SQL["asof_join"])
def asof_join_blocked(spark, sf):
    return _asof(spark, sf, limit=10)


@query(
    "asof_join_max_age",
    sql(ASOF.format(age="v.us - p.us <= 86400000000"), "user_id:i event_id:i purchase_id:i value:d"),
)
def asof_join_max_age(spark, sf):
    return _asof(spark, sf, max_age=86_400_000_000)


# --- Features --------------------------------------------------------------------------------------

W5, W10 = (
    "[" + ", ".join(f"exp(-0.5 * {i})" for i in range(n)) + "]" for n in (5, 10)
)
STATE_FEATURES_SQL = f"""
feat AS (SELECT *, (bid_px[1] + ask_px[1]) / 2 AS midpoint, (ask_px[1] - bid_px[1]) / 0.25 AS spread_ticks,
    (bid_sz[1] - ask_sz[1]) / (bid_sz[1] + ask_sz[1]) AS queue_imbalance_l1,
    ((ask_px[1] * bid_sz[1] + bid_px[1] * ask_sz[1]) / (bid_sz[1] + ask_sz[1]) - (bid_px[1] + ask_px[1]) / 2) / 0.25
      AS microprice_displacement_ticks,
    ln(1 + bid_sz[1] + ask_sz[1]) AS log_top_depth,
    (bid_sz[1] - ask_sz[1]) / (bid_sz[1] + ask_sz[1]) AS depth_imbalance_l1,
    (b5 - a5) / (b5 + a5) AS depth_imbalance_l5, (b10 - a10) / (b10 + a10) AS depth_imbalance_l10
  FROM (SELECT *, list_inner_product(bid_sz[1:5], {W5}) AS b5, list_inner_product(ask_sz[1:5], {W5}) AS a5,
      list_inner_product(bid_sz, {W10}) AS b10, list_inner_product(ask_sz, {W10}) AS a10 FROM states))"""
STATE_COLS = (
    "midpoint:d spread_ticks:d queue_imbalance_l1:d microprice_displacement_ticks:d log_top_depth:d "
    "depth_imbalance_l1:d depth_imbalance_l5:d depth_imbalance_l10:d"
)
KEY_COLS = "symbol:i session_date:s decision_ns:i"


@query(
    "book_state_features",
    sql(BOOK_SQL + "," + GRID_SQL + "," + STATE_FEATURES_SQL, f"{KEY_COLS} {STATE_COLS}", "feat"),
)
def book_state_features(spark, sf):
    states = book.sampled_states(in_session_events(spark, sf), BOOK_KEYS, SESSION)
    features = book.state_features(BOOK)
    return emit(states.withColumns(features).select(*BOOK_KEYS, "decision_ns", *features))


OFI_SQL = """
lagged AS (SELECT symbol, session_date, ts_ns, sequence, action, side, size, bid_px[1] AS b, ask_px[1] AS a, bid_sz[1] AS bs, ask_sz[1] AS sz,
    lag(bid_px[1]) OVER w AS pb, lag(ask_px[1]) OVER w AS pa, lag(bid_sz[1]) OVER w AS pbs, lag(ask_sz[1]) OVER w AS psz
  FROM sess WINDOW w AS (PARTITION BY symbol, session_date ORDER BY ts_ns, sequence)),
ofi AS (SELECT symbol, session_date, ts_ns, sequence, CASE WHEN pb IS NULL THEN 0e0 ELSE
    (CASE WHEN b >= pb THEN bs ELSE 0 END) - (CASE WHEN b <= pb THEN pbs ELSE 0 END)
    - (CASE WHEN a <= pa THEN sz ELSE 0 END) + (CASE WHEN a >= pa THEN psz ELSE 0 END) END AS ofi,
    CASE WHEN action = 'T' AND side = 'B' THEN size WHEN action = 'T' AND side = 'A' THEN -size ELSE 0 END AS signed,
    CASE WHEN action = 'T' THEN size ELSE 0 END AS traded FROM lagged)"""


def _ofi(spark, sf, limit=None):
    events = in_session_events(spark, sf)
    tops = events.select(
        *BOOK_KEYS, "ts_ns", "sequence",
        *[F.element_at(c, 1).alias(n) for c, n in
          (("bid_px", "bid"), ("bid_sz", "bid_size"), ("ask_px", "ask"), ("ask_sz", "ask_size"))],
    )
    seen = blocks.previous(
        tops, BOOK_KEYS, ["ts_ns", "sequence"], ["bid", "bid_size", "ask", "ask_size"], limit
    )
    change = book.flow_increment(*[F.col(c) for c in ("bid", "bid_size", "ask", "ask_size", "prev")])
    return emit(seen.select(*BOOK_KEYS, "sequence", change.alias("ofi")))


@query("flow_increments", sql(BOOK_SQL + "," + OFI_SQL, "symbol:i session_date:s sequence:i ofi:d", "ofi"))
def flow_increments(spark, sf):
    return _ofi(spark, sf)


@query("flow_increments_blocked", SQL["flow_increments"])
def flow_increments_blocked(spark, sf):
    return _ofi(spark, sf, 15)


def _trail(name, expr, ms):
    return (
        f"(SELECT coalesce(sum({expr}), 0) FROM ofi e WHERE e.symbol = f.symbol AND e.session_date = f.session_date"
        f" AND e.ts_ns > f.decision_ns - {ms}000000 AND e.ts_ns <= f.decision_ns) AS {name}"
    )


FLOW_SQL = f"""
trail AS (SELECT f.*, {", ".join(
    [_trail(f"o_{w}", "ofi", w) for w in BOOK.flow_ms]
    + [_trail(f"s_{w}", "signed", w) for w in BOOK.trade_ms]
    + [_trail(f"t_{w}", "traded", w) for w in BOOK.trade_ms]
    + [_trail("n_i", "1", BOOK.intensity_ms)]
)} FROM feat f),
flow AS (SELECT *, {", ".join(
    [f"o_{w} / greatest(bid_sz[1] + ask_sz[1], 1) AS ofi_{w}ms" for w in BOOK.flow_ms]
    + [f"CASE WHEN t_{w} > 0 THEN CAST(s_{w} AS DOUBLE) / t_{w} ELSE 0 END AS trade_imbalance_{w}ms" for w in BOOK.trade_ms]
)}, n_i / 1800e0 AS event_intensity_1800000ms,
    (midpoint - lag(midpoint, 5) OVER w) / 0.25 AS lagged_mid_return_1500000ms_ticks,
    (midpoint - lag(midpoint) OVER w) / 0.25 AS step
  FROM trail WINDOW w AS (PARTITION BY symbol, session_date ORDER BY decision_ns)),
vol AS (SELECT *, CASE WHEN count(step) OVER w = 5 THEN stddev_pop(step) OVER w END AS realized_vol_1500000ms_ticks
  FROM flow WINDOW w AS (PARTITION BY symbol, session_date ORDER BY decision_ns ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""


def _labels_sql(source, out, mid="midpoint"):
    steps, prev = [], source
    for h in BOOK.horizons_ms:
        name = f"lab_{out}_{h}"
        steps.append(
            f"""{name} AS (SELECT d.*, d.decision_ns + {h}000000 AS label_target_ns_{h}ms, s.ts_ns AS label_source_ns_{h}ms,
  CASE WHEN d.decision_ns + {h}000000 - s.ts_ns <= 1800000000000 THEN (s.bid_px[1] + s.ask_px[1]) / 2 END AS future_midpoint_{h}ms
  FROM (SELECT *, decision_ns + {h}000000 AS at_{h} FROM {prev}) d ASOF LEFT JOIN sess s
  ON d.symbol = s.symbol AND d.session_date = s.session_date AND d.at_{h} >= s.ts_ns)"""
        )
        prev = name
    ticks = ", ".join(
        f"(future_midpoint_{h}ms - {mid}) / 0.25 AS target_{h}ms_ticks, CASE WHEN (future_midpoint_{h}ms - {mid}) > 0 THEN 'up'"
        f" WHEN (future_midpoint_{h}ms - {mid}) < 0 THEN 'down' ELSE 'flat' END AS direction_{h}ms"
        for h in BOOK.horizons_ms
    )
    return ",\n".join(steps) + f",\n{out} AS (SELECT *, {ticks} FROM {prev})"


FEATURES_SQL = ",".join([BOOK_SQL, GRID_SQL, STATE_FEATURES_SQL, OFI_SQL, FLOW_SQL])
TABLE_SQL = FEATURES_SQL + "," + _labels_sql("vol", "labelled")
FLOW_COLS = " ".join(f"{c}:d" for c in book.feature_names(BOOK)[7:])
LABEL_COLS = " ".join(
    f"label_target_ns_{h}ms:i label_source_ns_{h}ms:i future_midpoint_{h}ms:d target_{h}ms_ticks:d direction_{h}ms:s"
    for h in BOOK.horizons_ms
)


def decision_rows(spark, sf, limit=None):
    return book.features_and_labels(in_session_events(spark, sf), BOOK_KEYS, SESSION, BOOK, limit)


@query("book_flow_features", sql(FEATURES_SQL, f"{KEY_COLS} {FLOW_COLS}", "vol"))
def book_flow_features(spark, sf):
    names = book.feature_names(BOOK)[7:]
    return emit(decision_rows(spark, sf).select(*BOOK_KEYS, "decision_ns", *names))


@query("book_flow_features_blocked", SQL["book_flow_features"])
def book_flow_features_blocked(spark, sf):
    names = book.feature_names(BOOK)[7:]
    return emit(decision_rows(spark, sf, 20).select(*BOOK_KEYS, "decision_ns", *names))


@query(
    "future_labels",
    sql(BOOK_SQL + "," + GRID_SQL + "," + STATE_FEATURES_SQL + "," + _labels_sql("feat", "labelled"),
        f"{KEY_COLS} {LABEL_COLS}", "labelled"),
)
def future_labels(spark, sf):
    events = in_session_events(spark, sf)
    states = book.sampled_states(events, BOOK_KEYS, SESSION).withColumns(book.state_features(BOOK))
    labels = book.build_labels(events, states, BOOK_KEYS, BOOK, SESSION.max_age_ms)
    return emit(labels)


REQUIRED = [*book.feature_names(BOOK), *[f"target_{h}ms_ticks" for h in BOOK.horizons_ms]]


def decision_table(spark, sf):
    rows = decision_rows(spark, sf)
    return sessions.trim(rows, 3_600_000, 1_800_000, REQUIRED).withColumn(
        "split",
        sessions.split_of(
            F.col("session_date").cast("string"),
            [
                SplitRange("train", "2024-01-01", "2024-01-15"),
                SplitRange("validation", "2024-01-16", "2024-01-22"),
                SplitRange("holdout", "2024-01-23", "2024-01-31"),
            ],
        ),
    )


TRIMMED_SQL = TABLE_SQL + f""",
trimmed AS (SELECT *, CASE WHEN session_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-15' THEN 'train'
    WHEN session_date BETWEEN DATE '2024-01-16' AND DATE '2024-01-22' THEN 'validation'
    WHEN session_date BETWEEN DATE '2024-01-23' AND DATE '2024-01-31' THEN 'holdout' END AS split
  FROM labelled WHERE decision_ns >= start_ns + 3600000000000 AND decision_ns <= end_ns - 1800000000000
    AND {" AND ".join(f"{c} IS NOT NULL" for c in REQUIRED)})"""


@query(
    "book_decision_table",
    sql(TRIMMED_SQL, f"{KEY_COLS} split:s " + " ".join(f"{c}:d" for c in REQUIRED), "trimmed"),
)
def book_decision_table(spark, sf):
    return emit(decision_table(spark, sf).select(*BOOK_KEYS, "decision_ns", "split", *REQUIRED))
