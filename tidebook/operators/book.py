"""Features and labels of the book study, all read from the state at or before the decision time.

Events carry the arrays bid_px, bid_sz, ask_px, ask_sz (level 1 first), plus action, side, size,
sequence and the integer time ts_ns.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.scalars import NANOS_PER_MS, ratio_or_zero
from tidebook.operators.asof import probe_states
from tidebook.operators.sessions import decision_grid
from tidebook.params import BookParams, SessionParams

BOOK_ARRAYS = ("bid_px", "bid_sz", "ask_px", "ask_sz")


def weighted(sizes: str, factors: Sequence[float]) -> Column:
    """Weighted sum of the first levels, written out so that it stays in generated code."""
    terms = [F.element_at(sizes, i + 1) * f for i, f in enumerate(factors)]
    return reduce(lambda a, b: a + b, terms)


def state_features(params: BookParams) -> dict[str, Column]:
    """Features of a single book: midpoint, spread, imbalances, microprice, depth."""
    bid, ask = F.element_at("bid_px", 1), F.element_at("ask_px", 1)
    bid_size, ask_size = F.element_at("bid_sz", 1), F.element_at("ask_sz", 1)
    depth = bid_size + ask_size
    mid = (bid + ask) / 2
    micro = F.when(depth > 0, (ask * bid_size + bid * ask_size) / depth).otherwise(mid)
    out = {
        "midpoint": mid,
        "spread_ticks": (ask - bid) / params.tick,
        "queue_imbalance_l1": ratio_or_zero(bid_size - ask_size, depth),
        "microprice_displacement_ticks": (micro - mid) / params.tick,
        "log_top_depth": F.log1p(depth),
    }
    for levels in params.depth_levels:
        decay = [math.exp(-params.depth_decay * i) for i in range(levels)]
        bids, asks = weighted("bid_sz", decay), weighted("ask_sz", decay)
        out[f"depth_imbalance_l{levels}"] = ratio_or_zero(bids - asks, bids + asks)
    return out


def flow_increment(bid: Column, bid_size: Column, ask: Column, ask_size: Column, prev: Column) -> Column:
    """Order-flow-imbalance contribution of one event given the previous top of book; 0 for the first."""
    keep = lambda test, size: F.when(test, size).otherwise(F.lit(0.0))
    change = (
        keep(bid >= prev["bid"], bid_size)
        - keep(bid <= prev["bid"], prev["bid_size"])
        - keep(ask <= prev["ask"], ask_size)
        + keep(ask >= prev["ask"], prev["ask_size"])
    )
    return F.when(prev.isNotNull(), change).otherwise(F.lit(0.0))


def flow_phases(with_book: bool = True) -> list[dict[str, tuple[str, Column]]]:
    """Running values for `probe_states`: latest book and cumulative flow, trades and events."""
    bid, ask = F.element_at("bid_px", 1), F.element_at("ask_px", 1)
    bid_size, ask_size = F.element_at("bid_sz", 1), F.element_at("ask_sz", 1)
    top = F.struct(
        bid.alias("bid"), bid_size.alias("bid_size"), ask.alias("ask"), ask_size.alias("ask_size")
    )
    traded = F.when(F.col("action") == "T", F.coalesce(F.col("size").cast("double"), F.lit(0.0)))
    signed = F.when(F.col("side") == "B", traded).when(F.col("side") == "A", -traded)
    totals = {
        "cum_flow": ("sum", flow_increment(bid, bid_size, ask, ask_size, F.col("prev_top"))),
        "cum_signed": ("sum", F.coalesce(signed, F.lit(0.0))),
        "cum_traded": ("sum", F.coalesce(traded, F.lit(0.0))),
        "cum_events": ("sum", F.lit(1)),
    }
    if with_book:
        book = F.struct(F.col("ts_ns").alias("source_ns"), "sequence", *BOOK_ARRAYS)
        totals["book"] = ("last", book)
    return [{"prev_top": ("prior", top)}, totals]


def _event_columns(events: DataFrame, keys: Sequence[str]) -> DataFrame:
    return events.select(*keys, "ts_ns", "sequence", "action", "side", "size", *BOOK_ARRAYS)


def sampled_states(
    events: DataFrame, keys: Sequence[str], session: SessionParams, limit: int | None = None
) -> DataFrame:
    """Last observable book on the decision clock, complete and not older than the age limit."""
    grid = decision_grid(events, keys, session).withColumn("ts_ns", F.col("decision_ns"))
    book = F.struct(F.col("ts_ns").alias("source_ns"), "sequence", *BOOK_ARRAYS)
    found = probe_states(
        events.select(*keys, "ts_ns", "sequence", *BOOK_ARRAYS),
        grid,
        keys,
        "ts_ns",
        ["sequence"],
        [{"book": ("last", book)}],
        limit,
    )
    return fresh_books(found.drop("ts_ns"), session.max_age_ms)


def fresh_books(df: DataFrame, max_age_ms: int) -> DataFrame:
    """Unpack the `book` struct; drop rows with no quote or a stale one."""
    flat = df.select("*", "book.*").drop("book")
    aged = flat.withColumn("quote_age_ms", (F.col("decision_ns") - F.col("source_ns")) / NANOS_PER_MS)
    complete = F.element_at("bid_px", 1).isNotNull() & F.element_at("ask_px", 1).isNotNull()
    return aged.where(complete & (F.col("quote_age_ms") <= max_age_ms))


def positional_returns(
    df: DataFrame, keys: Sequence[str], params: BookParams, grid_ms: int
) -> DataFrame:
    """Lagged return and realised volatility over surviving ticks (positions, not clock time)."""
    steps = max(1, round(params.return_ms / grid_ms))
    ticks = Window.partitionBy(*keys).orderBy("decision_ns")
    moved = df.withColumns(
        {
            f"lagged_mid_return_{params.return_ms}ms_ticks": (
                F.col("midpoint") - F.lag("midpoint", steps).over(ticks)
            )
            / params.tick,
            "_step": (F.col("midpoint") - F.lag("midpoint").over(ticks)) / params.tick,
        }
    )
    recent = ticks.rowsBetween(-(steps - 1), 0)
    vol = F.when(F.count("_step").over(recent) == steps, F.stddev_pop("_step").over(recent))
    return moved.withColumn(f"realized_vol_{params.return_ms}ms_ticks", vol).drop("_step")


def direction(target: Column) -> Column:
    """up / down / flat; a missing target is flat as well, so drop it before use."""
    return F.when(target > 0, "up").when(target < 0, "down").otherwise("flat")


def label_columns(
    future: dict[int, tuple[Column, Column]], params: BookParams, max_age_ms: int | None
) -> dict[str, Column]:
    """Label columns per horizon from (future midpoint, its source time) at each target time."""
    out: dict[str, Column] = {}
    for horizon, (mid, source) in future.items():
        target = F.col("decision_ns") + horizon * NANOS_PER_MS
        if max_age_ms is not None:
            mid = F.when(~(target - source > max_age_ms * NANOS_PER_MS), mid)
        ticks = (mid - F.col("midpoint")) / params.tick
        out[f"label_target_ns_{horizon}ms"] = target
        out[f"label_source_ns_{horizon}ms"] = source
        out[f"future_midpoint_{horizon}ms"] = mid
        out[f"target_{horizon}ms_ticks"] = ticks
        out[f"direction_{horizon}ms"] = direction(ticks)
    return out


def features_and_labels(
    events: DataFrame,
    keys: Sequence[str],
    session: SessionParams,
    params: BookParams,
    limit: int | None = None,
) -> DataFrame:
    """Decision table with every book feature and label.

    One shuffle by `keys`: the book at the tick, the flow totals at the tick and at each lookback
    start, and the midpoint at each horizon are all probes of the same running state. A trailing sum
    over (t-w, t] is the difference of two running totals, so its cost does not depend on w.
    """
    looks = sorted({*params.flow_ms, *params.trade_ms, params.intensity_ms})
    offsets = [0, *[-w for w in looks], *params.horizons_ms]
    grid = decision_grid(events, keys, session)
    probes = grid.select(
        "*", F.explode(F.array(*[F.lit(o).cast("bigint") for o in offsets])).alias("offset_ms")
    ).withColumn("ts_ns", F.col("decision_ns") + F.col("offset_ms") * NANOS_PER_MS)
    found = probe_states(
        _event_columns(events, keys), probes, keys, "ts_ns", ["sequence"], flow_phases(), limit
    )

    def at(offset: int, column: Column) -> Column:
        return F.max(F.when(F.col("offset_ms") == offset, column))

    top_mid = (F.element_at("book.bid_px", 1) + F.element_at("book.ask_px", 1)) / 2
    totals = ("cum_flow", "cum_signed", "cum_traded", "cum_events")
    picked = [
        F.first("start_ns").alias("start_ns"),
        F.first("end_ns").alias("end_ns"),
        F.first(F.when(F.col("offset_ms") == 0, F.col("book")), ignorenulls=True).alias("book"),
        *[
            F.coalesce(at(o, F.col(c)), F.lit(0)).alias(f"_{c}_{-o}")
            for o in offsets
            if o <= 0
            for c in totals
        ],
        *[at(h, top_mid).alias(f"_mid_{h}") for h in params.horizons_ms],
        *[at(h, F.col("book.source_ns")).alias(f"_src_{h}") for h in params.horizons_ms],
    ]
    wide = found.groupBy(*keys, "decision_ns").agg(*picked)
    states = fresh_books(wide, session.max_age_ms).withColumns(state_features(params))

    since = lambda c, w: F.col(f"_{c}_0") - F.col(f"_{c}_{w}")
    top = F.element_at("bid_sz", 1) + F.element_at("ask_sz", 1)
    flow = {f"ofi_{w}ms": since("cum_flow", w) / F.greatest(top, F.lit(1.0)) for w in params.flow_ms}
    flow |= {
        f"trade_imbalance_{w}ms": ratio_or_zero(since("cum_signed", w), since("cum_traded", w))
        for w in params.trade_ms
    }
    w = params.intensity_ms
    flow[f"event_intensity_{w}ms"] = since("cum_events", w) / (w / 1000)
    lagged = positional_returns(states.withColumns(flow), keys, params, session.grid_ms)
    future = {h: (F.col(f"_mid_{h}"), F.col(f"_src_{h}")) for h in params.horizons_ms}
    labelled = lagged.withColumns(label_columns(future, params, session.max_age_ms))
    return labelled.drop(*[c for c in labelled.columns if c.startswith("_")])


def feature_names(params: BookParams) -> list[str]:
    return [
        "spread_ticks",
        "queue_imbalance_l1",
        "microprice_displacement_ticks",
        "log_top_depth",
        *[f"depth_imbalance_l{n}" for n in params.depth_levels],
        *[f"ofi_{w}ms" for w in params.flow_ms],
        *[f"trade_imbalance_{w}ms" for w in params.trade_ms],
        f"event_intensity_{params.intensity_ms}ms",
        f"lagged_mid_return_{params.return_ms}ms_ticks",
        f"realized_vol_{params.return_ms}ms_ticks",
        "quote_age_ms",
    ]


def build_labels(
    events: DataFrame,
    decisions: DataFrame,
    keys: Sequence[str],
    params: BookParams,
    max_age_ms: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Labels for given decisions (`decision_ns`, `midpoint`): every horizon in one as-of pass."""
    probes = decisions.select(
        *keys,
        "decision_ns",
        "midpoint",
        F.explode(F.array(*[F.lit(h) for h in params.horizons_ms])).alias("_h"),
    ).withColumn("ts_ns", F.col("decision_ns") + F.col("_h").cast("bigint") * NANOS_PER_MS)
    mid = (F.element_at("bid_px", 1) + F.element_at("ask_px", 1)) / 2
    found = probe_states(
        events.select(*keys, "ts_ns", "sequence", "bid_px", "ask_px"),
        probes,
        keys,
        "ts_ns",
        ["sequence"],
        [{"hit": ("last", F.struct(F.col("ts_ns").alias("src"), mid.alias("mid")))}],
        limit,
    )
    at = lambda h, c: F.max(F.when(F.col("_h") == h, F.col(c)))
    wide = found.groupBy(*keys, "decision_ns").agg(
        F.first("midpoint").alias("midpoint"),
        *[at(h, "hit.mid").alias(f"_mid_{h}") for h in params.horizons_ms],
        *[at(h, "hit.src").alias(f"_src_{h}") for h in params.horizons_ms],
    )
    future = {h: (F.col(f"_mid_{h}"), F.col(f"_src_{h}")) for h in params.horizons_ms}
    columns = label_columns(future, params, max_age_ms)
    return wide.withColumns(columns).select(*keys, "decision_ns", *columns)
