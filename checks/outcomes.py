"""Trade outcomes on book depth and on the auction panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import book as book_checks
from checks.inputs import BOOK_KEYS, BOOK_SQL, SESSION, book_events, in_session_events, micros, table, auction_panel, AUCTION
from checks.shape import emit, sql
from checks.stats import PREDICTION, SCORED_SQL, bootstrap_sql
from tidebook.operators import fills, longshort, panel
from tidebook.params import TradingRule

QUERIES, SQL = {}, {}


def query(name, text=None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return add


# --- Fills -----------------------------------------------------------------------------------------

def fill_sql(px, sz, qty):
    """(average price, levels used) from running depth over the levels of one book."""
    before = f"list_transform(range(1, 11), lambda i: CASE WHEN i = 1 THEN 0 ELSE list_sum({sz}[1:i - 1]) END)"
    part = f"greatest(0, least({sz}[i], {qty} - (CASE WHEN i = 1 THEN 0 ELSE list_sum({sz}[1:i - 1]) END)))"
    paid = f"list_sum(list_transform(range(1, 11), lambda i: {px}[i] * {part}))"
    used = f"len(list_filter(range(1, 11), lambda i: {part} > 0))"
    enough = f"list_sum({sz}) >= {qty}"
    return f"CASE WHEN {enough} THEN {paid} / {qty} END", f"CASE WHEN {enough} THEN {used} END"


BUY, BUY_N = fill_sql("ask_px", "ask_sz", "qty")
SELL, SELL_N = fill_sql("bid_px", "bid_sz", "qty")


@query(
    "depth_sweep",
    sql(
        BOOK_SQL + f""", asked AS (SELECT *, unnest([3, 120, 360]) AS qty FROM book),
result AS (SELECT sequence, qty, {BUY} AS buy_price, {BUY_N} AS buy_levels, {SELL} AS sell_price, {SELL_N} AS sell_levels FROM asked)""",
        "sequence:i qty:i buy_price:d buy_levels:i sell_price:d sell_levels:i",
    ),
)
def depth_sweep(spark, sf):
    asked = book_events(spark, sf).withColumn("qty", F.explode(F.array(F.lit(3), F.lit(120), F.lit(360))))
    swept = asked.withColumns(
        {
            "buy": fills.sweep(F.col("ask_px"), F.col("ask_sz"), F.col("qty")),
            "sell": fills.sweep(F.col("bid_px"), F.col("bid_sz"), F.col("qty")),
        }
    )
    return emit(
        swept.select(
            "sequence", "qty",
            F.col("buy.average_price").alias("buy_price"), F.col("buy.levels_used").alias("buy_levels"),
            F.col("sell.average_price").alias("sell_price"), F.col("sell.levels_used").alias("sell_levels"),
        )
    )


GREEDY_SQL = """RECURSIVE ev AS (SELECT user_id, event_id, epoch_us(ts) AS s, epoch_us(ts) + 21600000000::BIGINT AS e FROM events),
chain AS (SELECT user_id, min(s) AS s FROM ev GROUP BY 1
  UNION ALL SELECT user_id, s FROM (SELECT c.user_id, (SELECT min(n.s) FROM ev n WHERE n.user_id = c.user_id AND n.s >= c.s + 21600000000::BIGINT) AS s FROM chain c) WHERE s IS NOT NULL),
result AS (SELECT ev.user_id, ev.event_id FROM ev JOIN chain USING (user_id, s))"""


@query("non_overlapping", sql(GREEDY_SQL, "user_id:i event_id:i"))
def non_overlapping(spark, sf, limit=None):
    events = table(spark, sf, "events").withColumn("s", micros("ts"))
    spans = events.select("user_id", "event_id", "s", (F.col("s") + 21_600_000_000).alias("e"))
    return emit(fills.non_overlapping(spans, ["user_id"], "s", "e", limit).select("user_id", "event_id"))


@query("non_overlapping_blocked", SQL["non_overlapping"])
def non_overlapping_blocked(spark, sf):
    return non_overlapping(spark, sf, 70)


SCENARIOS = [
    fills.Scenario(60_000, 3, 2.5, 0.0),
    fills.Scenario(60_000, 120, 2.5, 1.0),
    fills.Scenario(240_000, 3, 1.0, 0.5),
    fills.Scenario(240_000, 120, 5.0, 0.0),
]
TERMS = dict(horizon_ms=1_200_000, tick=0.25, multiplier=50.0, max_age_ms=SESSION.max_age_ms)
SIGNAL = "queue_imbalance_l1 * 12 + event_intensity_1800000ms * 100"


def signals(spark, sf):
    rows = book_checks.decision_table(spark, sf)
    return rows.select(*BOOK_KEYS, "decision_ns", F.expr(SIGNAL).alias("prediction"))


def _found(name, source, offset):
    return f"""{name} AS (SELECT d.*, CASE WHEN d.at_ns - s.ts_ns <= 1800000000000 THEN s.ts_ns END AS {name}_ns,
  s.bid_px AS {name}_bp, s.bid_sz AS {name}_bs, s.ask_px AS {name}_ap, s.ask_sz AS {name}_as
  FROM (SELECT * EXCLUDE (at_ns), {offset} AS at_ns FROM {source}) d ASOF LEFT JOIN sess s
  ON d.symbol = s.symbol AND d.session_date = s.session_date AND d.at_ns >= s.ts_ns)"""


def _avg(prefix, side):
    return fill_sql(f"{prefix}_ap" if side == "buy" else f"{prefix}_bp", f"{prefix}_as" if side == "buy" else f"{prefix}_bs", "quantity")[0]


TRADES_SQL = (
    "RECURSIVE " + book_checks.TRIMMED_SQL + f""",
scen AS (SELECT * FROM (VALUES {", ".join(f"({i}, {s.latency_ms}::BIGINT, {s.quantity}::BIGINT, {s.fee}e0, {s.margin_ticks}e0)" for i, s in enumerate(SCENARIOS))})
  t(scenario_id, latency_ms, quantity, fee, margin_ticks)),
sig AS (SELECT symbol, session_date, decision_ns, {SIGNAL} AS prediction, scen.*, 0::BIGINT AS at_ns FROM trimmed, scen WHERE {SIGNAL} <> 0),
{_found("dec", "sig", "decision_ns")}, {_found("ent", "dec", "decision_ns + latency_ms * 1000000")},
{_found("ext", "ent", "decision_ns + (latency_ms + 1200000) * 1000000")},
priced AS (SELECT *, (dec_ap[1] - dec_bp[1]) / 0.25 + 2 * fee / (0.25 * 50) + margin_ticks AS hurdle_ticks,
    CASE WHEN prediction > 0 THEN {_avg("ent", "buy")} ELSE {_avg("ent", "sell")} END AS entry_price,
    CASE WHEN prediction > 0 THEN {_avg("ext", "sell")} ELSE {_avg("ext", "buy")} END AS exit_price
  FROM ext WHERE dec_ns IS NOT NULL AND ent_ns IS NOT NULL AND ext_ns IS NOT NULL),
ready AS (SELECT *, CASE WHEN prediction > 0 THEN exit_price - entry_price ELSE entry_price - exit_price END * 50 * quantity AS gross_pnl,
    2 * fee * quantity AS fees, decision_ns + latency_ms * 1000000 AS entry_target_ns, decision_ns + (latency_ms + 1200000) * 1000000 AS exit_target_ns
  FROM priced WHERE abs(prediction) > hurdle_ticks AND entry_price IS NOT NULL AND exit_price IS NOT NULL),
chain AS (SELECT scenario_id, symbol, session_date, min(decision_ns) AS decision_ns FROM ready GROUP BY ALL
  UNION ALL SELECT * FROM (SELECT c.scenario_id, c.symbol, c.session_date, (SELECT min(r.decision_ns) FROM ready r, ready p
      WHERE p.scenario_id = c.scenario_id AND p.symbol = c.symbol AND p.session_date = c.session_date AND p.decision_ns = c.decision_ns
        AND r.scenario_id = c.scenario_id AND r.symbol = c.symbol AND r.session_date = c.session_date AND r.decision_ns >= p.exit_target_ns) AS decision_ns FROM chain c) WHERE decision_ns IS NOT NULL),
trades AS (SELECT *, gross_pnl - fees AS net_pnl, CASE WHEN prediction > 0 THEN 'long' ELSE 'short' END AS position_side
  FROM ready JOIN chain USING (scenario_id, symbol, session_date, decision_ns)),
summary AS (SELECT scenario_id, count(*) AS trades, sum(gross_pnl) AS gross_pnl, sum(fees) AS fees, sum(net_pnl) AS net_pnl,
    avg(net_pnl) AS mean_net_pnl, avg((net_pnl > 0)::INT) AS hit_rate FROM trades GROUP BY 1)"""
)
TRADE_COLS = (
    "symbol:i session_date:s decision_ns:i scenario_id:i position_side:s prediction:d hurdle_ticks:d entry_target_ns:i ent_ns:i "
    "exit_target_ns:i ext_ns:i quantity:i entry_price:d exit_price:d gross_pnl:d fees:d net_pnl:d"
)


def trades(spark, sf, limit=None):
    return fills.marketable_trades(
        in_session_events(spark, sf), signals(spark, sf), BOOK_KEYS, SCENARIOS, **TERMS, limit=limit
    )


@query("marketable_trades", sql(TRADES_SQL, TRADE_COLS, "trades", 4))
def marketable_trades(spark, sf):
    out = trades(spark, sf).withColumnsRenamed({"entry_source_ns": "ent_ns", "exit_source_ns": "ext_ns"})
    return emit(out.select(*[c.split(":")[0] for c in TRADE_COLS.split()]), 4)


@query("scenario_summary", sql(TRADES_SQL, "scenario_id:i trades:i gross_pnl:d fees:d net_pnl:d mean_net_pnl:d hit_rate:d", "summary", 4))
def scenario_summary(spark, sf):
    return emit(fills.trade_summary(trades(spark, sf), ["scenario_id"]), 4)


@query(
    "sessions_without_events",
    """SELECT DISTINCT c_custkey AS symbol FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""",
)
def sessions_without_events(spark, sf):
    wanted = table(spark, sf, "customer").select(F.col("c_custkey").alias("symbol"))
    have = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("symbol"))
    return emit(fills.sessions_without_events(wanted, have, ["symbol"]))


# --- Long/short ------------------------------------------------------------------------------------

RULES = [
    TradingRule(q, p, s, l, 0.5)
    for q in (0.1, 0.25)
    for p in (0.0, 1.0)
    for s, l in ((1e9, 0.0), (120.0, 60.0))
]
FEES = (0.0, 0.5, 2.0)
FUTURE_SQL = SCORED_SQL + """,
fut AS (SELECT a.*, b.bid_price AS fb, b.bid_size AS fbs, b.ask_price AS fa, b.ask_size AS fas, b.wap AS fw FROM scored a LEFT JOIN panel b
  ON a.stock_id = b.stock_id AND a.date_id = b.date_id AND b.seconds_in_bucket = a.seconds_in_bucket + 60)"""
READY_SQL = FUTURE_SQL + f""",
rules AS (SELECT * FROM (VALUES {", ".join(f"({i}, {r.quantile}e0, {r.min_prediction_bps}e0, {int(r.max_spread_bps)}e0, {r.min_liquidity}e0, {r.fee_bps}e0)" for i, r in enumerate(RULES))})
  t(rule_id, quantile, min_p, max_s, min_l, fee)),
ready AS (SELECT fut.*, rules.*, seconds_in_bucket % 60 = 0 AS on_grid, fb IS NULL OR fa IS NULL AS future_missing,
    coalesce(bid_price > 0 AND ask_price > 0 AND bid_size > 0 AND ask_size > 0 AND fb > 0 AND fa > 0 AND fbs > 0 AND fas > 0 AND ask_price >= bid_price AND fa >= fb, false) AS valid_quotes,
    coalesce(abs(prediction) >= min_p, false) AS clears_prediction,
    coalesce(spread / ((ask_price + bid_price) / 2) * 10000 <= max_s, false) AS clears_spread,
    coalesce(bid_size + ask_size >= min_l, false) AS clears_liquidity FROM fut, rules),
elig AS (SELECT * FROM ready WHERE on_grid AND valid_quotes AND clears_prediction AND clears_spread AND clears_liquidity),
sec AS (SELECT rule_id, date_id, time_id, count(*) AS n, CAST(floor(count(*) * any_value(quantile)) AS BIGINT) AS k, count_if(prediction < 0) AS dn, count_if(prediction > 0) AS up FROM elig GROUP BY ALL)"""


def forecasts(spark, sf):
    rows = panel.with_row_features(auction_panel(spark, sf), AUCTION).withColumn("prediction", F.expr(PREDICTION))
    keep = ["stock_id", "date_id", "seconds_in_bucket", "time_id", *longshort.QUOTES, "prediction"]
    return rows.select(*keep)


def ready(spark, sf):
    return longshort.execution_panel(forecasts(spark, sf), RULES)


@query(
    "future_quotes",
    sql(FUTURE_SQL, "stock_id:i date_id:i seconds_in_bucket:i fb:d fbs:d fa:d fas:d fw:d", "fut"),
)
def future_quotes(spark, sf):
    rows = longshort.with_future_quotes(auction_panel(spark, sf))
    names = {"future_bid_price": "fb", "future_bid_size": "fbs", "future_ask_price": "fa", "future_ask_size": "fas", "future_wap": "fw"}
    return emit(rows.withColumnsRenamed(names).select("stock_id", "date_id", "seconds_in_bucket", *names.values()))


COUNTERS = [
    "input_rows", "decision_grid_rows", "missing_exact_future_quote_rows", "invalid_quote_rows",
    "prediction_threshold_rejections", "spread_rejections", "liquidity_rejections", "eligible_rows",
    "insufficient_cross_section_time_ids", "one_sided_time_ids",
]


def funnel_sql(keys):
    by = ", ".join(keys)
    return READY_SQL + f""",
rowc AS (SELECT {by}, count(*) AS input_rows, count_if(on_grid) AS decision_grid_rows, count_if(on_grid AND future_missing) AS missing_exact_future_quote_rows,
    count_if(on_grid AND NOT valid_quotes) AS invalid_quote_rows, count_if(on_grid AND valid_quotes AND NOT clears_prediction) AS prediction_threshold_rejections,
    count_if(on_grid AND valid_quotes AND clears_prediction AND NOT clears_spread) AS spread_rejections,
    count_if(on_grid AND valid_quotes AND clears_prediction AND clears_spread AND NOT clears_liquidity) AS liquidity_rejections,
    count_if(on_grid AND valid_quotes AND clears_prediction AND clears_spread AND clears_liquidity) AS eligible_rows FROM ready GROUP BY {by}),
timec AS (SELECT {by}, count_if(k < 1) AS insufficient_cross_section_time_ids, count_if(k >= 1 AND least(dn, up) < k) AS one_sided_time_ids FROM sec GROUP BY {by}),
funnel AS (SELECT {by}, * EXCLUDE ({by}, insufficient_cross_section_time_ids, one_sided_time_ids), coalesce(insufficient_cross_section_time_ids, 0) AS insufficient_cross_section_time_ids,
    coalesce(one_sided_time_ids, 0) AS one_sided_time_ids FROM rowc LEFT JOIN timec USING ({by}))"""


@query("filter_funnel", sql(funnel_sql(["rule_id"]), "rule_id:i " + " ".join(f"{c}:i" for c in COUNTERS), "funnel"))
def filter_funnel(spark, sf):
    return emit(longshort.filter_funnel(forecasts(spark, sf), RULES))


@query(
    "summed_funnel",
    sql(
        funnel_sql(["rule_id", "date_id"]) + ", totals AS (" + " UNION ALL ".join(f"SELECT '{c}' AS counter, sum({c}) AS total FROM funnel" for c in COUNTERS) + ")",
        "counter:s total:i",
        "totals",
    ),
)
def summed_funnel(spark, sf):
    return emit(longshort.summed_funnel(longshort.filter_funnel(forecasts(spark, sf), RULES, ["date_id"]), COUNTERS))


LEGS_SQL = READY_SQL + """,
picked AS (SELECT e.*, k, CASE WHEN prediction < 0 THEN 'short' ELSE 'long' END AS side,
    row_number() OVER (PARTITION BY e.rule_id, e.time_id ORDER BY prediction, stock_id) AS low,
    row_number() OVER (PARTITION BY e.rule_id, e.time_id ORDER BY prediction DESC, stock_id DESC) AS high
  FROM elig e JOIN sec USING (rule_id, time_id) WHERE k >= 1 AND dn >= k AND up >= k),
mids AS (SELECT *, (bid_price + ask_price) / 2 AS m0, (fb + fa) / 2 AS m1 FROM picked WHERE (side = 'short' AND low <= k) OR (side = 'long' AND prediction > 0 AND high <= k)),
ret AS (SELECT *, CASE side WHEN 'long' THEN (fb / ask_price - 1) * 10000 ELSE (bid_price - fa) / bid_price * 10000 END AS g,
    CASE side WHEN 'long' THEN (m1 / m0 - 1) * 10000 ELSE (m0 - m1) / m0 * 10000 END AS m FROM mids),
legs AS (SELECT rule_id, time_id, date_id, seconds_in_bucket, stock_id, side, 0.5e0 / k AS weight, prediction AS prediction_bps, m AS midpoint_return_bps,
    g AS gross_executable_return_bps, m - g AS spread_cost_bps, 2 * fee AS fee_bps, g - 2 * fee AS net_return_bps,
    CASE side WHEN 'long' THEN least(ask_size, fbs) ELSE least(bid_size, fas) END AS displayed_capacity_units FROM ret),
decs AS (SELECT rule_id, date_id, time_id, seconds_in_bucket, count(*) AS stock_legs, sum(weight * gross_executable_return_bps) AS gross_return_bps,
    sum(weight * net_return_bps) AS net_return_bps, sum(weight * spread_cost_bps) AS spread_cost_bps, sum(weight * fee_bps) AS fee_bps,
    min(displayed_capacity_units) AS minimum_displayed_capacity_units FROM legs GROUP BY ALL)"""
LEG_COLS = (
    "rule_id:i time_id:i date_id:i seconds_in_bucket:i stock_id:i side:s weight:d prediction_bps:d midpoint_return_bps:d "
    "gross_executable_return_bps:d spread_cost_bps:d fee_bps:d net_return_bps:d displayed_capacity_units:d"
)
DEC_COLS = (
    "rule_id:i date_id:i time_id:i seconds_in_bucket:i stock_legs:i gross_return_bps:d net_return_bps:d spread_cost_bps:d fee_bps:d "
    "minimum_displayed_capacity_units:d"
)


@query("long_short_legs", sql(LEGS_SQL, LEG_COLS, "legs", 4))
def long_short_legs(spark, sf, limit=None):
    return emit(longshort.legs(ready(spark, sf), limit), 4)


@query("long_short_legs_blocked", SQL["long_short_legs"])
def long_short_legs_blocked(spark, sf):
    return long_short_legs(spark, sf, 25)


@query("long_short_decisions", sql(LEGS_SQL, DEC_COLS, "decs", 4))
def long_short_decisions(spark, sf):
    return emit(longshort.decisions(longshort.legs(ready(spark, sf))), 4)


SUMMARY_SQL = LEGS_SQL + """,
grid_summary AS (SELECT rule_id, count(*) AS decisions, avg(gross_return_bps) AS gross_mean_bps, avg(net_return_bps) AS net_mean_bps,
    avg(spread_cost_bps) AS spread_cost_mean_bps, avg(fee_bps) AS fee_mean_bps, min(minimum_displayed_capacity_units) AS minimum_displayed_capacity_units FROM decs GROUP BY 1),
best AS (SELECT * FROM grid_summary ORDER BY net_mean_bps DESC, rule_id LIMIT 1)"""
GRID_COLS = "rule_id:i decisions:i gross_mean_bps:d net_mean_bps:d spread_cost_mean_bps:d fee_mean_bps:d minimum_displayed_capacity_units:d"


@query("rule_grid_summary", sql(SUMMARY_SQL, GRID_COLS, "grid_summary", 4))
def rule_grid_summary(spark, sf):
    return emit(longshort.decision_summary(longshort.decisions(longshort.legs(ready(spark, sf)))), 4)


@query("best_rule", sql(SUMMARY_SQL, GRID_COLS, "best", 4))
def best_rule(spark, sf):
    summary = longshort.decision_summary(longshort.decisions(longshort.legs(ready(spark, sf))))
    return emit(longshort.best_rule(summary), 4)


@query(
    "overlap_violations",
    sql(LEGS_SQL + """, gaps AS (SELECT rule_id, date_id, seconds_in_bucket - lag(seconds_in_bucket) OVER (PARTITION BY rule_id, date_id ORDER BY seconds_in_bucket) AS gap FROM decs),
result AS (SELECT count(*) AS decisions, (SELECT count(*) FROM gaps WHERE gap < 60) AS violations FROM decs)""", "decisions:i violations:i"),
)
def overlap_violations(spark, sf):
    made = longshort.decisions(longshort.legs(ready(spark, sf)))
    bad = longshort.overlap_violations(made).agg(F.count("*").alias("violations"))
    return emit(made.agg(F.count("*").alias("decisions")).crossJoin(F.broadcast(bad)))


FULL_SQL = LEGS_SQL + """,
d AS (SELECT rule_id, date_id, avg(net_return_bps) AS v FROM decs GROUP BY ALL),
sl AS (SELECT rule_id, date_id, time_id, side, avg(gross_executable_return_bps) AS g, avg(net_return_bps) AS n FROM legs GROUP BY ALL),
sides AS (SELECT rule_id, avg(g) FILTER (side = 'long') AS long_gross_mean_bps, avg(n) FILTER (side = 'long') AS long_net_mean_bps,
    avg(g) FILTER (side = 'short') AS short_gross_mean_bps, avg(n) FILTER (side = 'short') AS short_net_mean_bps FROM sl GROUP BY 1),
dist AS (SELECT rule_id, avg(v) AS daily_mean_bps, stddev_pop(v) AS daily_standard_deviation_bps, min(v) AS daily_minimum_bps, quantile_cont(v, 0.25) AS daily_quartile_25_bps,
    quantile_cont(v, 0.5) AS daily_median_bps, quantile_cont(v, 0.75) AS daily_quartile_75_bps, max(v) AS daily_maximum_bps FROM d GROUP BY 1),
base AS (SELECT rule_id, count(*) AS decisions, sum(stock_legs) AS stock_legs, avg(gross_return_bps) AS gross_mean_bps, avg(net_return_bps) AS net_mean_bps,
    avg((net_return_bps > 0)::INT) AS hit_rate, 2.0 * count(*) AS turnover_round_trip_gross, avg(spread_cost_bps) AS spread_cost_mean_bps, avg(fee_bps) AS fee_mean_bps,
    greatest(0, avg(net_return_bps)) AS break_even_additional_total_cost_bps, min(minimum_displayed_capacity_units) AS minimum_displayed_capacity_units,
    quantile_cont(net_return_bps, 0.5) AS net_median_bps FROM decs GROUP BY 1),""" + bootstrap_sql("d", ["rule_id"], "date_id", "v", 2000) + """,
ts AS (SELECT *, clusters AS dates, lower AS ci_low, upper AS ci_high FROM base JOIN sides USING (rule_id) JOIN dist USING (rule_id) JOIN boot USING (rule_id))"""
FULL_COLS = (
    "rule_id:i decisions:i stock_legs:i gross_mean_bps:d net_mean_bps:d hit_rate:d turnover_round_trip_gross:d spread_cost_mean_bps:d fee_mean_bps:d "
    "break_even_additional_total_cost_bps:d minimum_displayed_capacity_units:d net_median_bps:d long_gross_mean_bps:d long_net_mean_bps:d short_gross_mean_bps:d "
    "short_net_mean_bps:d daily_mean_bps:d daily_standard_deviation_bps:d daily_minimum_bps:d daily_quartile_25_bps:d daily_median_bps:d daily_quartile_75_bps:d "
    "daily_maximum_bps:d dates:i ci_low:d ci_high:d"
)


@query("trading_summary", sql(FULL_SQL, FULL_COLS, "ts", 4))
def trading_summary(spark, sf):
    chosen = longshort.legs(ready(spark, sf))
    return emit(longshort.trading_summary(chosen, longshort.decisions(chosen), repetitions=2000), 4)


@query(
    "fee_repricing",
    sql(LEGS_SQL + """, priced AS (SELECT rule_id, fee_per_side, count(*) AS decisions, avg(gross_return_bps - 2 * fee_per_side) AS net_mean_bps,
    avg((gross_return_bps - 2 * fee_per_side > 0)::INT) AS hit_rate FROM decs, (SELECT unnest([0e0, 0.5e0, 2e0]) AS fee_per_side) GROUP BY ALL)""",
        "rule_id:i fee_per_side:d decisions:i net_mean_bps:d hit_rate:d", "priced", 4),
)
def fee_repricing(spark, sf):
    made = longshort.repriced(longshort.decisions(longshort.legs(ready(spark, sf))), FEES, "gross_return_bps")
    return emit(
        made.groupBy("rule_id", "fee_per_side").agg(
            F.count("*").alias("decisions"), F.avg("net_return_bps").alias("net_mean_bps"),
            F.avg((F.col("net_return_bps") > 0).cast("double")).alias("hit_rate"),
        ),
        4,
    )
