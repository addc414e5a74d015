"""Auction panel: features and cross-sectional trade outcomes."""

from __future__ import annotations


from checks.inputs import AUCTION, PANEL_SQL, auction_panel
from checks.shape import emit, sql
from tidebook.operators import panel

QUERIES, SQL = {}, {}
KEYS = ["stock_id", "date_id", "seconds_in_bucket", "time_id"]
KEY_COLS = " ".join(f"{k}:i" for k in KEYS)


def query(name, text=None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return add


def div(a, b):
    return f"({a}) / nullif({b}, 0)"


ROW_SQL = PANEL_SQL + f""",
r1 AS (SELECT *, ask_price - bid_price AS spread, (bid_price + ask_price) / 2 AS midpoint,
    bid_size AS bid_liquidity, ask_size AS ask_liquidity, bid_size + ask_size AS displayed_liquidity,
    imbalance_buy_sell_flag * imbalance_size AS signed_size_imbalance,
    imbalance_buy_sell_flag * imbalance_size AS signed_unmatched_imbalance,
    ln(1 + matched_size) AS matched_size_log, ln(1 + imbalance_size) AS imbalance_size_log,
    (near_price IS NULL)::INT AS near_price_missing, (far_price IS NULL)::INT AS far_price_missing,
    {div("(reference_price - wap) * 10000", "wap")} AS reference_wap_gap_bps,
    {div("(near_price - wap) * 10000", "wap")} AS near_wap_gap_bps, {div("(far_price - wap) * 10000", "wap")} AS far_wap_gap_bps,
    {div("(near_price - far_price) * 10000", "wap")} AS near_far_dislocation_bps,
    600 - seconds_in_bucket AS time_remaining_seconds, (600 - seconds_in_bucket) / 600e0 AS time_remaining_fraction
  FROM panel),
r2 AS (SELECT *, {div("spread * 10000", "midpoint")} AS spread_bps, {div("(wap - midpoint) * 10000", "midpoint")} AS wap_mid_gap_bps,
    {div("bid_size - ask_size", "displayed_liquidity")} AS book_size_imbalance, ln(1 + displayed_liquidity) AS displayed_liquidity_log,
    {div("ask_price * bid_size + bid_price * ask_size", "displayed_liquidity")} AS microprice,
    {div("signed_unmatched_imbalance", "matched_size + imbalance_size")} AS auction_imbalance_ratio,
    time_remaining_fraction * time_remaining_fraction AS time_remaining_squared FROM r1),
r3 AS (SELECT *, {div("(microprice - midpoint) * 10000", "midpoint")} AS microprice_gap_bps,
    imbalance_buy_sell_flag * book_size_imbalance AS flag_book_imbalance_interaction,
    imbalance_buy_sell_flag * wap_mid_gap_bps AS flag_wap_mid_interaction,
    auction_imbalance_ratio * time_remaining_fraction AS imbalance_time_interaction FROM r2)"""

INTEGER_FEATURES = {"near_price_missing", "far_price_missing", "time_remaining_seconds"}
ROW_NAMES = panel.row_feature_names(AUCTION)


def cols(names):
    return KEY_COLS + " " + " ".join(f"{n}:{'i' if n in INTEGER_FEATURES else 'd'}" for n in names)


@query("panel_row_features", sql(ROW_SQL, cols(ROW_NAMES), "r3"))
def panel_row_features(spark, sf):
    return emit(panel.with_row_features(auction_panel(spark, sf), AUCTION).select(*KEYS, *ROW_NAMES))


def _lag_sql():
    out = []
    for lag in AUCTION.lags:
        k = lag // 10
        at = lambda c: f"CASE WHEN seconds_in_bucket - lag(seconds_in_bucket, {k}) OVER w = {lag} THEN lag({c}, {k}) OVER w END"
        for src, name in (("wap", "wap_return"), ("midpoint", "midpoint_return")):
            out.append(f"{div(f'({src} - {at(src)}) * 10000', at(src))} AS {name}_{lag}s_bps")
        out += [f"{src} - {at(src)} AS {name}_{lag}s" for src, name in panel.CHANGES.items()]
    return ", ".join(out)


LAG_SQL = ROW_SQL + f""",
lagged AS (SELECT *, {_lag_sql()} FROM r3 WINDOW w AS (PARTITION BY stock_id, date_id ORDER BY seconds_in_bucket))"""
LAG_NAMES = [
    n for lag in AUCTION.lags
    for n in (f"wap_return_{lag}s_bps", f"midpoint_return_{lag}s_bps", *[f"{o}_{lag}s" for o in panel.CHANGES.values()])
]


@query("panel_exact_lags", sql(LAG_SQL, cols(LAG_NAMES), "lagged"))
def panel_exact_lags(spark, sf):
    rows = panel.with_row_features(auction_panel(spark, sf), AUCTION)
    return emit(panel.with_exact_lags(rows, AUCTION).select(*KEYS, *LAG_NAMES))


def _roll_sql():
    out = []
    for w in AUCTION.windows:
        x = "wap_return_10s_bps"
        out.append(f"avg({x}) OVER w{w} AS wap_return_10s_mean_{w}s")
        out.append(f"CASE WHEN count({x}) OVER w{w} >= 2 THEN stddev_pop({x}) OVER w{w} END AS wap_return_10s_vol_{w}s")
        out += [f"avg({n}) OVER w{w} AS {n}_mean_{w}s" for n in ("auction_imbalance_ratio", "spread_bps")]
    frames = ", ".join(
        f"w{w} AS (PARTITION BY stock_id, date_id ORDER BY seconds_in_bucket RANGE BETWEEN {w - 10} PRECEDING AND CURRENT ROW)"
        for w in AUCTION.windows
    )
    return f"SELECT *, {', '.join(out)} FROM lagged WINDOW {frames}"


ROLL_SQL = LAG_SQL + f", rolled AS ({_roll_sql()})"
ROLL_NAMES = [
    n for w in AUCTION.windows
    for n in (f"wap_return_10s_mean_{w}s", f"wap_return_10s_vol_{w}s", f"auction_imbalance_ratio_mean_{w}s", f"spread_bps_mean_{w}s")
]


@query("panel_rolling", sql(ROLL_SQL, cols(ROLL_NAMES), "rolled", 5))
def panel_rolling(spark, sf):
    return emit(panel.with_dynamics(auction_panel(spark, sf), AUCTION).select(*KEYS, *ROLL_NAMES), 5)


def _cross_sql(source):
    ranked = ", ".join(
        f"CASE WHEN {c} IS NOT NULL THEN (rank() OVER (PARTITION BY time_id ORDER BY {c} NULLS LAST) + "
        f"(count(*) OVER (PARTITION BY time_id, {c}) - 1) / 2e0) / count({c}) OVER (PARTITION BY time_id) END AS {c}_cs_rank, "
        f"quantile_cont({c}, 0.5) OVER (PARTITION BY time_id) AS m_{c}, {c} - avg({c}) OVER (PARTITION BY time_id) AS {c}_cs_demeaned"
        for c in AUCTION.ranked
    )
    mads = ", ".join(
        f"quantile_cont(abs({c} - m_{c}), 0.5) OVER (PARTITION BY time_id) AS d_{c}" for c in AUCTION.ranked
    )
    zs = ", ".join(
        f"coalesce(({c} - m_{c}) / CASE WHEN d_{c} > 0 THEN 1.4826e0 * d_{c} END, 0) AS {c}_cs_robust_z" for c in AUCTION.ranked
    )
    return f", c1 AS (SELECT *, {ranked} FROM {source}), c2 AS (SELECT *, {mads} FROM c1), crossed AS (SELECT *, {zs} FROM c2)"


CROSS_NAMES = [f"{c}_cs_{k}" for c in AUCTION.ranked for k in ("rank", "robust_z", "demeaned")]


@query("panel_cross_section", sql(ROW_SQL + _cross_sql("r3"), cols(CROSS_NAMES), "crossed", 5))
def panel_cross_section(spark, sf, limit=None):
    rows = panel.with_row_features(auction_panel(spark, sf), AUCTION)
    return emit(panel.with_cross_section(rows.select(*KEYS, *AUCTION.ranked), AUCTION.ranked, limit).select(*KEYS, *CROSS_NAMES), 5)


@query("panel_cross_section_blocked", SQL["panel_cross_section"])
def panel_cross_section_blocked(spark, sf):
    return panel_cross_section(spark, sf, 30)


ALL_NAMES = panel.feature_names(AUCTION)
FEATURE_SQL = ROLL_SQL + _cross_sql("rolled")


@query("panel_feature_table", sql(FEATURE_SQL, cols(ALL_NAMES), "crossed", 5))
def panel_feature_table(spark, sf):
    return emit(panel.panel_features(auction_panel(spark, sf), AUCTION).select(*KEYS, *ALL_NAMES), 5)
