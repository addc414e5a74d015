"""Study inputs derived from the given tables, in Spark and as SQL text.

The given tables hold no order books, so each study input is a row-by-row or grouped mapping of one of
them. Prices are whole ticks and sums are of whole numbers, which keeps both engines exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import blocks
from tidebook.params import AuctionParams, BookParams, SessionParams

SESSION = SessionParams(grid_ms=300_000, max_age_ms=1_800_000)
BOOK = BookParams(
    flow_ms=(900_000, 1_800_000, 3_600_000),
    trade_ms=(900_000, 3_600_000),
    intensity_ms=1_800_000,
    return_ms=1_500_000,
    horizons_ms=(300_000, 600_000, 1_800_000),
)
BOOK_KEYS = ["symbol", "session_date"]
AUCTION = AuctionParams()


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


# --- Book events: one event row becomes one book update of the symbol that groups fifty users. -----

def book_events(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").withColumn("us", micros("ts"))
    bid0, ask0 = "100 + floor(value) * 0.25D", "100 + floor(value) * 0.25D + 0.25D * (1 + event_id % 3)"
    levels = "sequence(0, 9)"
    return events.selectExpr(
        "user_id div 50 AS symbol",
        "us * 1000 AS ts_ns",
        "us * 1000 - 100000 AS ts_event_ns",
        "event_id AS sequence",
        "CASE event_type WHEN 'purchase' THEN 'T' WHEN 'error' THEN 'C' ELSE 'A' END AS action",
        "CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side",
        "1 + event_id % 5 AS size",
        f"transform({levels}, l -> {bid0} - 0.25D * l) AS bid_px",
        f"transform({levels}, l -> cast(20 + (event_id * 7 + l * 3) % 31 AS double)) AS bid_sz",
        f"transform({levels}, l -> {ask0} + 0.25D * l) AS ask_px",
        f"transform({levels}, l -> cast(20 + (event_id * 11 + l * 5) % 29 AS double)) AS ask_sz",
        "event_type",
        "value",
    )


BOOK_SQL = """
book AS (
  SELECT user_id // 50 AS symbol, epoch_us(ts) * 1000 AS ts_ns, epoch_us(ts) * 1000 - 100000 AS ts_event_ns,
    event_id AS sequence,
    CASE event_type WHEN 'purchase' THEN 'T' WHEN 'error' THEN 'C' ELSE 'A' END AS action,
    CASE WHEN event_id % 2 = 0 THEN 'B' ELSE 'A' END AS side,
    1 + event_id % 5 AS size,
    list_transform(range(10), lambda l: 100 + floor(value) * 0.25 - 0.25 * l) AS bid_px,
    list_transform(range(10), lambda l: CAST(20 + (event_id * 7 + l * 3) % 31 AS DOUBLE)) AS bid_sz,
    list_transform(range(10), lambda l: 100 + floor(value) * 0.25 + 0.25 * (1 + event_id % 3) + 0.25 * l) AS ask_px,
    list_transform(range(10), lambda l: CAST(20 + (event_id * 11 + l * 5) % 29 AS DOUBLE)) AS ask_sz,
    event_type, value, ts
  FROM events),
dated AS (
  SELECT *, CAST(ts AT TIME ZONE 'UTC' AT TIME ZONE 'America/New_York' AS DATE) AS session_date FROM book),
bounded AS (
  SELECT *, epoch_us((session_date + TIME '09:35:00') AT TIME ZONE 'America/New_York') * 1000 AS start_ns,
    epoch_us((session_date + TIME '15:55:00') AT TIME ZONE 'America/New_York') * 1000 AS end_ns FROM dated),
sess AS (SELECT * FROM bounded WHERE ts_ns >= start_ns AND ts_ns < end_ns)"""

GRID_SQL = """
ends AS (SELECT symbol, session_date, any_value(start_ns) AS start_ns, any_value(end_ns) AS end_ns,
    least(any_value(end_ns), max(ts_ns) - max(ts_ns) % 300000000000) AS stop_ns
  FROM sess GROUP BY symbol, session_date),
grid AS (SELECT symbol, session_date, start_ns, end_ns,
    unnest(generate_series(start_ns, stop_ns, 300000000000)) AS decision_ns FROM ends WHERE stop_ns >= start_ns),
found AS (SELECT g.*, s.ts_ns AS source_ns, s.sequence, s.bid_px, s.bid_sz, s.ask_px, s.ask_sz
  FROM grid g ASOF LEFT JOIN sess s
    ON g.symbol = s.symbol AND g.session_date = s.session_date AND g.decision_ns >= s.ts_ns),
states AS (SELECT *, (decision_ns - source_ns) / 1e6 AS quote_age_ms FROM found
  WHERE source_ns IS NOT NULL AND (decision_ns - source_ns) / 1e6 <= 1800000)"""


def in_session_events(spark: SparkSession, sf: str) -> DataFrame:
    from tidebook.operators.sessions import in_session

    return in_session(book_events(spark, sf), SESSION)


# --- The same events with planted defects, for the quality checks. ---------------------------------

def flawed_events(spark: SparkSession, sf: str) -> DataFrame:
    """Book events where rare large `error` rows break one rule each; arrival order is `ingest_ord`."""
    bad = "event_type = 'error' AND value > 150"
    fix = lambda arr, kind, change: (
        f"CASE WHEN {bad} AND sequence % 6 = {kind} THEN {change} ELSE {arr} END AS {arr}"
    )
    # A late row arrives 40 places after its turn.
    arrival = f"sequence + CASE WHEN {bad} AND sequence % 6 = 5 THEN 40 ELSE 0 END AS ingest_ord"
    base = book_events(spark, sf)
    return base.selectExpr(
        "symbol", "ts_ns", "sequence", "action", "side", "size",
        fix("bid_px", 0, "transform(bid_px, (p, i) -> CASE WHEN i = 0 THEN ask_px[0] ELSE p END)"),
        f"CASE WHEN {bad} AND sequence % 12 = 1 THEN transform(bid_sz, (s, i) -> CASE WHEN i = 4 THEN -s ELSE s END) ELSE bid_sz END AS bid_sz",
        "transform(bid_sz, s -> 1D + s % 7) AS bid_ct",
        f"transform(ask_sz, (s, i) -> CASE WHEN {bad} AND sequence % 12 = 7 AND i = 2 THEN -1D ELSE 1D + s % 7 END) AS ask_ct",
        "CASE WHEN {b} AND sequence % 6 = 2 THEN transform(ask_px, (p, i) -> CASE WHEN i = 3 THEN p - 2 ELSE p END)"
        " WHEN {b} AND sequence % 6 = 3 THEN transform(ask_px, p -> p + 0.1D)"
        " WHEN {b} AND sequence % 6 = 4 THEN transform(ask_px, (p, i) -> CASE WHEN i = 0 THEN bid_px[0] - 0.25D ELSE p END)"
        " ELSE ask_px END AS ask_px".format(b=bad),
        "ask_sz",
        arrival,
    )


FLAWED_SQL = BOOK_SQL + """,
flawed AS (
  SELECT symbol, ts_ns, sequence, action, side, size, session_date, start_ns, end_ns,
    CASE WHEN bad AND k = 0 THEN list_transform(bid_px, lambda p, i: CASE WHEN i = 1 THEN ask_px[1] ELSE p END) ELSE bid_px END AS bid_px,
    CASE WHEN bad AND sequence % 12 = 1 THEN list_transform(bid_sz, lambda s, i: CASE WHEN i = 5 THEN -s ELSE s END) ELSE bid_sz END AS bid_sz,
    list_transform(bid_sz, lambda s: 1 + s % 7) AS bid_ct,
    list_transform(ask_sz, lambda s, i: CASE WHEN bad AND sequence % 12 = 7 AND i = 3 THEN -1 ELSE 1 + s % 7 END) AS ask_ct,
    CASE WHEN bad AND k = 2 THEN list_transform(ask_px, lambda p, i: CASE WHEN i = 4 THEN p - 2 ELSE p END)
         WHEN bad AND k = 3 THEN list_transform(ask_px, lambda p: p + 0.1)
         WHEN bad AND k = 4 THEN list_transform(ask_px, lambda p, i: CASE WHEN i = 1 THEN bid_px[1] - 0.25 ELSE p END)
         ELSE ask_px END AS ask_px,
    ask_sz, sequence + CASE WHEN bad AND k = 5 THEN 40 ELSE 0 END AS ingest_ord
  FROM (SELECT *, event_type = 'error' AND value > 150 AS bad, sequence % 6 AS k FROM sess))"""


# --- Auction panel: supplier = stock, ship year = date, sixtieth of the year = ten-second slot. ----

def auction_panel(spark: SparkSession, sf: str) -> DataFrame:
    given = table(spark, sf, "lineitem")
    lines = given.selectExpr(
        "l_suppkey AS stock_id",
        "year(l_shipdate) - 1995 AS date_id",
        "((dayofyear(l_shipdate) - 1) * 60 div 366) * 10 AS seconds_in_bucket",
        "cast(l_quantity AS bigint) AS qty",
        "cast(round(l_extendedprice * 100) AS bigint) AS cents",
        "cast(round(l_discount * 100) AS bigint) AS disc",
        "cast(round(l_tax * 100) AS bigint) AS tax",
        "CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS sign",
    )
    # A cell has about two lines, so adding up before the shuffle would keep nearly a file split of them in memory.
    cells = blocks.dealt(lines, given.count(), ["stock_id", "date_id"]).groupBy("stock_id", "date_id", "seconds_in_bucket").agg(
        F.sum("qty").alias("q"),
        F.sum("cents").alias("c"),
        F.sum("disc").alias("d"),
        F.sum("tax").alias("t"),
        F.sum(F.expr("sign * qty")).alias("net"),
        F.count("*").alias("n"),
    )
    return cells.selectExpr(
        "stock_id",
        "cast(date_id AS bigint) AS date_id",
        "cast(seconds_in_bucket AS bigint) AS seconds_in_bucket",
        "cast(abs(net) AS double) AS imbalance_size",
        "cast(sign(net) AS bigint) AS imbalance_buy_sell_flag",
        "cast(c AS double) / (q * 100) AS reference_price",
        "cast(q AS double) AS matched_size",
        "CASE WHEN seconds_in_bucket >= 300 THEN cast(c AS double) / (q * 100) + d END AS far_price",
        "CASE WHEN seconds_in_bucket >= 200 THEN cast(c AS double) / (q * 100) - t END AS near_price",
        "cast(c AS double) / (q * 100) - 1 - d AS bid_price",
        "cast(q + n AS double) AS bid_size",
        "cast(c AS double) / (q * 100) + 1 + t AS ask_price",
        "cast(q + d + 1 AS double) AS ask_size",
        "cast(c AS double) / (q * 100) + (cast(t AS double) - d) / 4 AS wap",
        "CASE WHEN (stock_id + d) % 17 = 0 THEN NULL ELSE cast(d AS double) - t + net / 10D END AS target",
        "cast(date_id * 60 + seconds_in_bucket div 10 AS bigint) AS time_id",
        "concat_ws('_', date_id, seconds_in_bucket, stock_id) AS row_id",
    )


PANEL_SQL = """
lots AS (
  SELECT l_suppkey AS stock_id, CAST(year(l_shipdate) - 1995 AS BIGINT) AS date_id,
    CAST(((dayofyear(l_shipdate) - 1) * 60 // 366) * 10 AS BIGINT) AS seconds_in_bucket,
    CAST(l_quantity AS BIGINT) AS qty, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
    CAST(round(l_discount * 100) AS BIGINT) AS disc, CAST(round(l_tax * 100) AS BIGINT) AS tax,
    CASE l_returnflag WHEN 'A' THEN 1 WHEN 'R' THEN -1 ELSE 0 END AS sgn
  FROM lineitem),
cells AS (
  SELECT stock_id, date_id, seconds_in_bucket, CAST(sum(qty) AS BIGINT) AS q, CAST(sum(cents) AS BIGINT) AS c,
    CAST(sum(disc) AS BIGINT) AS d, CAST(sum(tax) AS BIGINT) AS t, CAST(sum(sgn * qty) AS BIGINT) AS net, count(*) AS n
  FROM lots GROUP BY ALL),
panel AS (
  SELECT stock_id, date_id, seconds_in_bucket,
    CAST(abs(net) AS DOUBLE) AS imbalance_size, CAST(sign(net) AS BIGINT) AS imbalance_buy_sell_flag,
    CAST(c AS DOUBLE) / (q * 100) AS reference_price, CAST(q AS DOUBLE) AS matched_size,
    CASE WHEN seconds_in_bucket >= 300 THEN CAST(c AS DOUBLE) / (q * 100) + d END AS far_price,
    CASE WHEN seconds_in_bucket >= 200 THEN CAST(c AS DOUBLE) / (q * 100) - t END AS near_price,
    CAST(c AS DOUBLE) / (q * 100) - 1 - d AS bid_price, CAST(q + n AS DOUBLE) AS bid_size,
    CAST(c AS DOUBLE) / (q * 100) + 1 + t AS ask_price, CAST(q + d + 1 AS DOUBLE) AS ask_size,
    CAST(c AS DOUBLE) / (q * 100) + (CAST(t AS DOUBLE) - d) / 4 AS wap,
    CASE WHEN (stock_id + d) % 17 = 0 THEN NULL ELSE CAST(d AS DOUBLE) - t + net / 10e0 END AS target,
    date_id * 60 + seconds_in_bucket // 10 AS time_id,
    date_id || '_' || seconds_in_bucket || '_' || stock_id AS row_id
  FROM cells)"""


# --- Snapshots: embeddings with three classes; ten equal blocks of vec_id are the chronology. ------

def snapshots(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    last = vectors.agg(F.max("vec_id").alias("last_id"))
    return vectors.crossJoin(F.broadcast(last)).selectExpr(
        "vec_id AS obs_id",
        "cast(vec_id * 10 div (last_id + 1) AS int) AS block",
        "embedding AS features",
        "transform(sequence(0, 4), h -> cast((label + h) % 3 + 1 AS tinyint)) AS labels",
        "label % 3 + 1 AS label",
    )


SNAP_SQL = """
snap AS (
  SELECT vec_id AS obs_id, vec_id * 10 // ((SELECT max(vec_id) FROM embeddings) + 1) AS block,
    embedding AS features, list_transform(range(5), lambda h: (label + h) % 3 + 1) AS labels, label % 3 + 1 AS label
  FROM embeddings)"""
