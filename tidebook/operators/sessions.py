"""Trading sessions, decision clocks and split assignment."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import NANOS_PER_MS
from tidebook.params import SessionParams, SplitRange


DAY_US = 86_400_000_000
# Days added before a division and taken off after it, so that dates before 1970 round down as well.
# 64-bit nanoseconds reach less than 107,000 days back.
EARLY = 110_000


def clock_us(clock: str) -> int:
    """Microseconds of a wall-clock time since midnight."""
    hours, minutes, seconds = clock.split(":")
    return (int(hours) * 3600 + int(minutes) * 60) * 1_000_000 + round(float(seconds) * 1_000_000)


def bound_ns(session_date: Column, clock: str, zone: str) -> Column:
    """UTC nanoseconds of a local wall-clock time on a date (daylight saving handled by the zone).

    Integer microseconds go into the shift and come out of it, so the session's own time zone has no part in it; the
    zone is a literal, which generated code resolves once.
    """
    local = F.unix_date(session_date.cast("date")).cast("bigint") * F.lit(DAY_US) + F.lit(clock_us(clock))
    return F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(local), F.lit(zone))) * F.lit(1000).cast("bigint")


def local_date(time: str, zone: str) -> Column:
    """Local calendar date of an integer nanosecond column."""
    utc = F.call_function("div", F.col(time) - F.pmod(F.col(time), F.lit(1000)), F.lit(1000))
    local = F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), F.lit(zone)))
    days = F.call_function("div", local + F.lit(EARLY * DAY_US), F.lit(DAY_US)) - F.lit(EARLY)
    return F.date_from_unix_date(days.cast("int"))


def with_bounds(df: DataFrame, session: SessionParams, date: str = "session_date") -> DataFrame:
    return df.withColumns(
        {
            "start_ns": bound_ns(F.col(date), session.start, session.zone),
            "end_ns": bound_ns(F.col(date), session.end, session.zone),
        }
    )


def in_session(events: DataFrame, session: SessionParams, time: str = "ts_ns") -> DataFrame:
    """Rows inside their local day's window: start inclusive, end exclusive.

    The session follows from the row's own timestamp, so no calendar join is needed.
    """
    dated = events.withColumn("session_date", local_date(time, session.zone))
    bounded = with_bounds(dated, session)
    return bounded.where((F.col(time) >= F.col("start_ns")) & (F.col(time) < F.col("end_ns")))


def calendar(span: DataFrame, session: SessionParams) -> DataFrame:
    """Weekday sessions lying wholly within each row's [first_ns, last_ns]."""
    day = lambda c: local_date(c, session.zone)
    days = span.select(
        "first_ns",
        "last_ns",
        F.explode(F.sequence(day("first_ns"), day("last_ns"))).alias("session_date"),
    ).where(F.weekday("session_date") < 5)
    whole = with_bounds(days, session).where(
        (F.col("start_ns") >= F.col("first_ns")) & (F.col("end_ns") <= F.col("last_ns"))
    )
    return whole.select("session_date", "start_ns", "end_ns")


def decision_grid(
    events: DataFrame, keys: Sequence[str], session: SessionParams, time: str = "ts_ns"
) -> DataFrame:
    """One row per clock tick up to the session end or the last event floored to the grid."""
    step = session.grid_ms * NANOS_PER_MS
    seen = events.groupBy(*keys).agg(
        F.first("start_ns").alias("start_ns"),
        F.first("end_ns").alias("end_ns"),
        F.max(time).alias("_last"),
    )
    floored = F.col("_last") - F.col("_last") % F.lit(step)
    open_until = seen.withColumn("_stop", F.least("end_ns", floored)).where("_stop >= start_ns")
    return open_until.select(
        *keys,
        "start_ns",
        "end_ns",
        F.explode(F.sequence("start_ns", "_stop", F.lit(step))).alias("decision_ns"),
    )


def split_of(date: Column, splits: Sequence[SplitRange]) -> Column:
    """Split name by inclusive range, NULL outside every range."""
    out = F.lit(None).cast("string")
    for part in reversed(splits):
        out = F.when(date.between(F.lit(part.first), F.lit(part.last)), part.name).otherwise(out)
    return out


def trim(
    df: DataFrame, lookback_ms: int, horizon_ms: int, required: Sequence[str]
) -> DataFrame:
    """Drop ticks without a full lookback or horizon in the session, and incomplete rows."""
    inside = (F.col("decision_ns") >= F.col("start_ns") + lookback_ms * NANOS_PER_MS) & (
        F.col("decision_ns") <= F.col("end_ns") - horizon_ms * NANOS_PER_MS
    )
    return df.where(inside).dropna(subset=list(required))
