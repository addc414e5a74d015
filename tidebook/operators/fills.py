"""Trade outcomes on book depth: fills, round trips, and the one-position-at-a-time selection."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.functions.scalars import NANOS_PER_MS, is_finite
from tidebook.operators import blocks
from tidebook.operators.asof import asof_join, probe_states
from tidebook.operators.blocks import BLOCK


@dataclass(frozen=True)
class Scenario:
    """One point of the sensitivity grid."""

    latency_ms: int
    quantity: int
    fee: float
    margin_ticks: float


def sweep(prices: Column, sizes: Column, quantity: Column, depth: int = 10) -> Column:
    """Struct (average_price, levels_used) of consuming visible levels, NULL when depth is short.

    Levels with no price or size are skipped; sizes count in whole contracts.
    """
    wanted = quantity.cast("double")
    start = F.struct(
        wanted.alias("left"), F.lit(0.0).alias("paid"), F.lit(0).alias("used"), F.lit(0).alias("level")
    )

    def take(state: Column, level: Column) -> Column:
        there = F.floor(level["size"]).cast("double")
        usable = (level["price"] > 0) & (there > 0) & (state["left"] > 0)
        fill = F.when(usable, F.least(state["left"], there)).otherwise(0.0)
        number = state["level"] + 1
        return F.struct(
            (state["left"] - fill).alias("left"),
            (state["paid"] + F.when(usable, fill * level["price"]).otherwise(0.0)).alias("paid"),
            F.when(usable, number).otherwise(state["used"]).alias("used"),
            number.alias("level"),
        )

    levels = F.arrays_zip(F.slice(prices, 1, depth).alias("price"), F.slice(sizes, 1, depth).alias("size"))
    done = lambda s: F.when(
        s["left"] == 0, F.struct((s["paid"] / wanted).alias("average_price"), s["used"].alias("levels_used"))
    )
    return F.aggregate(levels, start, take, done)


def round_trip(
    entry: Column, exit_: Column, is_long: Column, quantity: Column, multiplier: float, fee: Column
) -> dict[str, Column]:
    """Prices and money of entering one book and leaving another; NULL when either lacks depth."""

    def average(book: Column, buys: Column) -> Column:
        asks = sweep(book["ask_px"], book["ask_sz"], quantity)["average_price"]
        bids = sweep(book["bid_px"], book["bid_sz"], quantity)["average_price"]
        return F.when(buys, asks).otherwise(bids)

    opened, closed = average(entry, is_long), average(exit_, ~is_long)
    move = F.when(is_long, closed - opened).otherwise(opened - closed)
    gross, fees = move * multiplier * quantity, 2.0 * fee * quantity
    return {
        "entry_price": opened,
        "exit_price": closed,
        "gross_pnl": gross,
        "fees": fees,
        "net_pnl": gross - fees,
    }


def candidate_trades(
    events: DataFrame,
    signals: DataFrame,
    keys: Sequence[str],
    scenarios: Sequence[Scenario],
    *,
    horizon_ms: int,
    tick: float,
    multiplier: float,
    max_age_ms: int,
    limit: int | None = None,
) -> DataFrame:
    """Every signal and scenario that would trade if no position were open.

    `signals` has keys, decision_ns and prediction. The books at decision, entry and exit of all
    scenarios are probes of one as-of pass: the offsets are distinct latencies, not scenarios.
    """
    latencies = sorted({s.latency_ms for s in scenarios})
    offsets = sorted({0, *latencies, *[t + horizon_ms for t in latencies]})
    usable = signals.where(is_finite(F.col("prediction")) & (F.col("prediction") != 0))
    probes = usable.select(
        *keys, "decision_ns", "prediction",
        F.explode(F.array(*[F.lit(o).cast("bigint") for o in offsets])).alias("_o"),
    ).withColumn("ts_ns", F.col("decision_ns") + F.col("_o") * NANOS_PER_MS)
    book = F.struct(F.col("ts_ns").alias("source_ns"), "bid_px", "bid_sz", "ask_px", "ask_sz")
    found = probe_states(
        events.select(*keys, "ts_ns", "sequence", "bid_px", "bid_sz", "ask_px", "ask_sz"),
        probes, keys, "ts_ns", ["sequence"], [{"book": ("last", book)}], limit,
    )
    fresh = F.col("ts_ns") - F.col("book.source_ns") <= max_age_ms * NANOS_PER_MS
    wide = found.groupBy(*keys, "decision_ns").agg(
        F.first("prediction").alias("prediction"),
        *[
            F.first(F.when((F.col("_o") == o) & fresh, F.col("book")), ignorenulls=True).alias(f"_b{o}")
            for o in offsets
        ],
    )
    cases = []
    for i, s in enumerate(scenarios):
        cases.append(
            F.struct(
                F.lit(i).alias("scenario_id"),
                F.lit(s.latency_ms).cast("bigint").alias("latency_ms"),
                F.lit(s.quantity).cast("bigint").alias("quantity"),
                F.lit(float(s.fee)).alias("fee"),
                F.lit(float(s.margin_ticks)).alias("margin_ticks"),
                F.col(f"_b{s.latency_ms}").alias("entry"),
                F.col(f"_b{s.latency_ms + horizon_ms}").alias("exit"),
            )
        )
    spread = (F.element_at("_b0.ask_px", 1) - F.element_at("_b0.bid_px", 1)) / tick
    crossed = (
        wide.where(F.col("_b0").isNotNull())
        .withColumn("_spread", spread)
        .select(*keys, "decision_ns", "prediction", "_spread", F.explode(F.array(*cases)).alias("_c"))
        .select(*keys, "decision_ns", "prediction", "_spread", "_c.*")
    )
    hurdle = F.col("_spread") + 2.0 * F.col("fee") / (tick * multiplier) + F.col("margin_ticks")
    cleared = crossed.withColumn("hurdle_ticks", hurdle).where(
        (F.abs("prediction") > F.col("hurdle_ticks")) & F.col("entry").isNotNull() & F.col("exit").isNotNull()
    )
    money = round_trip(
        F.col("entry"), F.col("exit"), F.col("prediction") > 0, F.col("quantity"), multiplier, F.col("fee")
    )
    entry_ns = F.col("decision_ns") + F.col("latency_ms") * NANOS_PER_MS
    priced = cleared.withColumns(
        {
            "position_side": F.when(F.col("prediction") > 0, "long").otherwise("short"),
            "entry_target_ns": entry_ns,
            "entry_source_ns": F.col("entry.source_ns"),
            "exit_target_ns": entry_ns + horizon_ms * NANOS_PER_MS,
            "exit_source_ns": F.col("exit.source_ns"),
            **money,
        }
    )
    return priced.where(F.col("net_pnl").isNotNull()).drop("entry", "exit", "_spread")


def marketable_trades(
    events: DataFrame, signals: DataFrame, keys: Sequence[str], scenarios: Sequence[Scenario], **terms
) -> DataFrame:
    """Trades actually taken: per key and scenario, no decision before the previous exit."""
    limit = terms.get("limit")
    # Read for sizes, for the selection and for the rows themselves.
    ready = blocks.settled(candidate_trades(events, signals, keys, scenarios, **terms))
    return non_overlapping(ready, [*keys, "scenario_id"], "decision_ns", "exit_target_ns", limit)


NEVER = -(2**62)


def _first_come(keys: Sequence[str]):
    """Streaming selection over batches sorted by key and start; state is the current key and end."""

    def select(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, free = None, NEVER
        for pdf in batches:
            if pdf.empty:
                continue
            by = pdf[keys]
            same = (by == by.shift()) | (by.isna() & by.shift().isna())
            changed = ~same.all(axis=1).to_numpy()
            named = lambda i: tuple(None if pd.isna(v) else v for v in by.iloc[i])
            changed[0] = last is None or named(0) != last
            last = named(-1)
            entry, starts, ends = (pdf[c].to_numpy() for c in ("_free", "_s", "_e"))
            borders = np.flatnonzero(np.append(changed, True))
            take = []
            for lo, hi in zip(np.unique(np.append(0, borders[:-1])), borders if borders[0] else borders[1:]):
                if changed[lo]:
                    free = entry[lo]
                at = lo + int(np.searchsorted(starts[lo:hi], free, "left"))
                while at < hi:  # rows that would be refused are jumped over
                    take.append(at)
                    free = ends[at]
                    at = max(at + 1, lo + int(np.searchsorted(starts[lo:hi], free, "left")))
            yield pdf.iloc[take][[*(k for k in keys if k != BLOCK), "_s"]]

    return select


def _leaving(keys: Sequence[str]):
    """Per cell: (_upto, _out), the end of the chain that enters with the first start up to `_upto`."""

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        starts, ends = pdf["_s"].to_numpy(), pdf["_e"].to_numpy()
        n = len(starts)
        after = np.maximum(np.searchsorted(starts, ends, "left"), np.arange(n) + 1)
        last = np.where(after < n, after, np.arange(n))
        while not np.array_equal(further := last[last], last):  # halves what is left of every chain
            last = further
        out = ends[last]
        closes_run = np.append(out[1:] != out[:-1], True)
        rows = pd.DataFrame({"_upto": starts[closes_run], "_out": out[closes_run]})
        return rows.assign(**{k: pdf[k].iloc[0] for k in [*keys, BLOCK]})[[*keys, BLOCK, "_upto", "_out"]]

    return leave


def _entries(steps: DataFrame, keys: Sequence[str], cells: int, limit: int | None) -> DataFrame:
    """The time from which each block may take its first row, from the blocks' transfer functions.

    A step leads to the first step of its key, in time, that can be entered when it leaves; that is one as-of join.
    Pointer doubling then composes these: after k joins every step knows where 2**k steps lead, and the steps that the
    chain from the first one really takes are found from the longest jumps to the shortest. A chain meets a block at
    most once, so the rounds are the logarithm of the number of blocks, and no round has a key's steps in one task.
    """
    late = steps.select(*keys, (-F.col("_upto")).alias("_at"), F.col("_upto").alias("_next"))
    found = asof_join(
        steps.select(*keys, "_upto", (-F.col("_out")).alias("_leaves")), late, keys, "_leaves", "_at", ["_next"], limit=limit
    )
    jumps = [blocks.settled(found.drop("_leaves"))]
    for _ in range(max(0, cells.bit_length() - 1)):
        onward = jumps[-1].select(*keys, F.col("_upto").alias("_next"), F.col("_next").alias("_far"))
        jumps.append(blocks.settled(blocks.null_safe_join(jumps[-1], onward, [*keys, "_next"], "left").select(*keys, "_upto", F.col("_far").alias("_next"))))
    taken = steps.groupBy(*keys).agg(F.min("_upto").alias("_upto"))
    for jump in reversed(jumps):
        reached = blocks.null_safe_join(taken, jump, [*keys, "_upto"], "left").where("_next IS NOT NULL")
        taken = blocks.settled(taken.union(reached.select(*keys, F.col("_next").alias("_upto"))).distinct())
    left = blocks.null_safe_join(steps, taken.withColumn("_taken", F.lit(True)), [*keys, "_upto"], "left")
    cell_ends = left.groupBy(*keys, BLOCK).agg(F.max(F.when(F.col("_taken"), F.col("_out"))).alias("_out"))
    earlier = Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return cell_ends.select(*keys, BLOCK, F.max("_out").over(earlier).alias("_free"))


def non_overlapping(
    df: DataFrame, keys: Sequence[str], start: str, end: str, limit: int | None = None
) -> DataFrame:
    """Greedy first-come selection per key: take a row when its start is not before the last taken end.

    Of rows that share a start the first in (end, other columns) is the one that can be taken. The choice is
    sequential per key, so sorted partitions are streamed once over narrow columns with one end time as state. A large
    key is cut into blocks first. Each block tells, for every start that a chain could enter it with, when that chain
    would leave it; equal leaving times of neighbours merge into one row, whatever the longest hold. These steps are
    composed by pointer doubling; then every block is streamed on its own from its now known entry.
    """
    keys = list(keys)
    others = [f.name for f in df.schema if f.name not in (*keys, start, end) and "map<" not in f.dataType.simpleString()]
    among_equals = Window.partitionBy(*keys, start).orderBy(end, *others)
    df = df.withColumn("_nth", F.row_number().over(among_equals)).where("_nth = 1").drop("_nth")
    narrow = df.select(*keys, F.col(start).cast("bigint").alias("_s"), F.col(end).cast("bigint").alias("_e"))
    cuts = blocks.cut_points(narrow, keys, "_s", limit)
    celled = blocks.with_block(narrow, "_s", cuts)
    ddl = ", ".join(f"`{k}` {narrow.schema[k].dataType.simpleString()}" for k in keys)
    never = F.lit(NEVER).cast("bigint")
    if cuts is None:
        entered = celled.withColumn("_free", never)
    else:
        steps = blocks.settled(
            celled.where(F.col(BLOCK) != blocks.WHOLE)
            .groupBy(*keys, BLOCK)
            .applyInPandas(_leaving(keys), f"{ddl}, {BLOCK} int, _upto bigint, _out bigint")
        )
        entries = _entries(steps, keys, cuts.most, limit)
        entered = blocks.null_safe_join(celled, entries, [*keys, BLOCK], "left").withColumn(
            "_free", F.coalesce("_free", never)
        )
    part = [*keys, BLOCK] if cuts else keys
    taken = (
        entered.select(*part, "_s", "_e", "_free")
        .repartition(*part)
        .sortWithinPartitions(*part, "_s")
        .mapInPandas(_first_come(part), f"{ddl}, _s bigint")
    )
    return blocks.null_safe_join(df, taken.withColumnRenamed("_s", start), [*keys, start], "left_semi")


def trade_summary(trades: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Counts and money per key; without keys an empty input still gives one row of zeros."""
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    return trades.groupBy(*keys).agg(
        F.count("*").alias("trades"),
        zero("gross_pnl").alias("gross_pnl"),
        zero("fees").alias("fees"),
        zero("net_pnl").alias("net_pnl"),
        F.avg("net_pnl").alias("mean_net_pnl"),
        F.avg((F.col("net_pnl") > 0).cast("double")).alias("hit_rate"),
    )


def sessions_without_events(signals: DataFrame, events: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions that have signals but no raw events; a non-empty result means the run must fail."""
    return signals.select(*keys).distinct().join(events.select(*keys), list(keys), "left_anti")
