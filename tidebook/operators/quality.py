"""Data-quality reports of book events, per session, and the accept/quarantine split."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import NANOS_PER_MS, nan_to_null
from tidebook.operators import blocks
from tidebook.params import Contract

DEPTH = 10
EVENT_FIELDS = ("ts_recv", "ts_event", "action", "side", "sequence", "price", "size")
LADDERS = ("bid_px", "ask_px", "bid_sz", "ask_sz", "bid_ct", "ask_ct")
TICK_TOLERANCE = 1e-8
FATAL = (
    "timestamp_inversions",
    "exact_duplicate_rows",
    "invalid_best_quotes",
    "crossed_books",
    "negative_size_or_count",
    "ladder_errors",
    "tick_misaligned_rows",
    "missing_timestamps",
)


def required_columns() -> list[str]:
    return [*EVENT_FIELDS, *[f"{name}_{i:02d}" for i in range(DEPTH) for name in LADDERS]]


def canonical_events(raw: DataFrame) -> DataFrame:
    """Typed events: ns timestamps, coerced numbers (bad text to NULL), ladders packed into arrays.

    Rows whose timestamps do not parse keep NULLs, so that they can be counted and rejected.
    """
    missing = sorted(set(required_columns()) - set(raw.columns))
    if missing:
        raise ValueError(f"missing book columns: {missing}")
    number = lambda c: nan_to_null(F.col(c).try_cast("double"))
    packed = {
        name: F.array(*[number(f"{name}_{i:02d}") for i in range(DEPTH)]) for name in LADDERS
    }
    ladder_columns = [f"{name}_{i:02d}" for name in LADDERS for i in range(DEPTH)]
    return raw.withColumns(
        {
            "ts_ns": utc_nanos(F.col("ts_recv")),
            "ts_event_ns": utc_nanos(F.col("ts_event")),
            "sequence": F.col("sequence").try_cast("bigint"),
            "price": number("price"),
            "size": number("size"),
            **packed,
        }
    ).drop(*ladder_columns)


def utc_nanos(text: Column) -> Column:
    """Nanoseconds since the epoch from ISO text, keeping digits Spark's TIMESTAMP would drop.

    Text without a zone is UTC whatever the session's time zone.
    """
    value = F.trim(text.cast("string"))
    plain = F.regexp_replace(value, r"\.\d+", "")
    zoned = F.when(plain.rlike(r"(?:Z|UTC|GMT|[+-]\d{1,2}(?::?\d{2})?)$") & plain.rlike(":"), plain).otherwise(F.concat(plain, F.lit("Z")))
    whole = F.unix_micros(F.try_to_timestamp(zoned)) * 1000
    digits = F.rpad(F.regexp_extract(value, r"\.(\d{1,9})", 1), 9, "0")
    return whole + F.coalesce(digits.try_cast("bigint"), F.lit(0))


def row_flags(tick: float) -> dict[str, Column]:
    """Boolean rules of one book row."""
    bid, ask = F.element_at("bid_px", 1), F.element_at("ask_px", 1)

    def falls(prices: str, wrong) -> Column:
        steps = F.zip_with(
            F.slice(prices, 1, DEPTH - 1), F.slice(prices, 2, DEPTH - 1), lambda a, b: wrong(a, b)
        )
        return F.exists(steps, lambda bad: F.coalesce(bad, F.lit(False)))

    off_grid = lambda p: F.coalesce(
        F.abs(p / tick - F.rint(p / tick)) > TICK_TOLERANCE, F.lit(False)
    )
    negative = lambda sizes: F.exists(sizes, lambda s: F.coalesce(s < 0, F.lit(False)))
    return {
        "invalid_best_quotes": bid.isNull() | ask.isNull() | (bid <= 0) | (ask <= 0),
        "locked_books": bid == ask,
        "crossed_books": bid > ask,
        "negative_size_or_count": negative(F.concat("bid_sz", "ask_sz", "bid_ct", "ask_ct")),
        "ladder_errors": falls("bid_px", lambda a, b: a <= b) | falls("ask_px", lambda a, b: a >= b),
        "tick_misaligned_rows": F.exists(F.concat("bid_px", "ask_px"), off_grid),
    }


def duplicate_counts(events: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact copies beyond the first, per session. Copies meet by full-row group, one row per value."""
    copies = events.groupBy(*keys, *[c for c in columns if c not in keys]).agg(F.count("*").alias("n"))
    return copies.groupBy(*keys).agg(F.sum(F.col("n") - 1).alias("exact_duplicate_rows"))


def quality_report(
    events: DataFrame,
    keys: Sequence[str],
    tick: float,
    arrival: str = "ingest_ord",
    time: str = "ts_ns",
    limit: int | None = None,
) -> DataFrame:
    """One row of rule counts per session plus `accepted`.

    Inversions compare each row with the one that arrived before it; the receive gap compares
    neighbours in time order. Both read the previous row by blocks, so one session may be any size.
    """
    flags = row_flags(tick)
    flagged = events.select(
        *keys, arrival, time, (F.col("action") == "T").alias("_trade"), *[c.alias(n) for n, c in flags.items()]
    )
    arrived = blocks.previous(flagged, keys, [arrival], [time], limit)
    counted = arrived.groupBy(*keys).agg(
        F.count("*").alias("rows"),
        F.count_if("_trade").alias("trades"),
        F.count_if(F.col(time) < F.col(f"prev.{time}")).alias("timestamp_inversions"),
        F.count_if(F.col(time).isNull()).alias("missing_timestamps"),
        *[F.count_if(n).alias(n) for n in flags],
    )
    instants = events.select(*keys, time).where(F.col(time).isNotNull()).distinct()
    gaps = (
        blocks.previous(instants, keys, [time], [time], limit)
        .groupBy(*keys)
        .agg(
            F.coalesce(
                F.max((F.col(time) - F.col(f"prev.{time}")) / NANOS_PER_MS), F.lit(0.0)
            ).alias("maximum_receive_gap_ms")
        )
    )
    copies = duplicate_counts(events, keys, [c for c in events.columns if c != arrival])
    report = counted.join(copies, list(keys), "left").join(gaps, list(keys), "left")
    clean = F.lit(True)
    for rule in FATAL:
        clean = clean & (F.col(rule) == 0)
    return report.withColumn("accepted", clean)


def quarantine(
    events: DataFrame, report: DataFrame, keys: Sequence[str]
) -> tuple[DataFrame, DataFrame]:
    """(usable events, events of rejected sessions)."""
    good = report.where("accepted").select(*keys)
    return events.join(good, list(keys), "left_semi"), events.join(good, list(keys), "left_anti")


def session_profile(
    planned: DataFrame, events: DataFrame, report: DataFrame, processed: DataFrame, keys: Sequence[str]
) -> DataFrame:
    """Status of each planned session from raw rows, in-session rows, quality and output rows.

    `events` holds raw rows per session with a boolean `inside`; `processed` the finished decision rows.
    """
    keys = list(keys)
    raw = events.groupBy(*keys).agg(
        F.count("*").alias("decoded_rows"), F.count_if("inside").alias("session_rows")
    )
    made = processed.groupBy(*keys).agg(F.count("*").alias("decision_rows"))
    joined = (
        planned.join(raw, keys, "left")
        .join(report.select(*keys, "accepted"), keys, "left")
        .join(made, keys, "left")
    )
    status = (
        F.when(F.col("decoded_rows").isNull(), "missing")
        .when(F.col("session_rows") == 0, "no_session_data")
        .when(~F.col("accepted"), "rejected_quality")
        .when(F.coalesce("decision_rows", F.lit(0)) == 0, "no_processed_rows")
        .otherwise("processed")
    )
    ok = F.coalesce("accepted", F.lit(False))
    return joined.select(
        *keys,
        status.alias("status"),
        "decoded_rows",
        "session_rows",
        ok.alias("quality_accepted"),
        F.when(ok, F.coalesce("decision_rows", F.lit(0))).alias("decision_rows"),
    )


def profile_totals(profile: DataFrame, fields: Sequence[str]) -> DataFrame:
    """Total and maximum of each numeric field over the sessions that have it."""
    long = profile.select(
        F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in fields])).alias("e")
    ).select("e.*")
    return long.groupBy("field").agg(
        F.coalesce(F.sum("v"), F.lit(0)).alias("total"), F.coalesce(F.max("v"), F.lit(0)).alias("maximum")
    )


FIXED_POINT_FROM = 1_000_000


def scaled(value: Column) -> Column:
    """Undo the 1e-9 fixed-point encoding, recognised by its size."""
    number = value.cast("double")
    return F.when(F.abs(number) >= FIXED_POINT_FROM, number / 1e9).otherwise(number)


def verify_definitions(definitions: DataFrame, expected: Contract, symbol: str = "symbol") -> DataFrame:
    """Newest definition per symbol, scaled, with a `matches` flag against the expected contract."""
    newest = definitions.groupBy(symbol).agg(
        F.max_by(
            F.struct("min_price_increment", "unit_of_measure_qty"), F.struct("ts_recv", "ingest_ord")
        ).alias("d")
    )
    tick, size = scaled(F.col("d.min_price_increment")), scaled(F.col("d.unit_of_measure_qty"))
    near = lambda a, b: F.abs(a - b) <= expected.tolerance
    usable = F.coalesce((tick > 0) & (size > 0), F.lit(False))
    return newest.select(
        symbol,
        tick.alias("tick_size"),
        size.alias("multiplier"),
        usable.alias("usable"),
        (usable & near(tick, expected.tick) & near(size, expected.multiplier)).alias("matches"),
    )
