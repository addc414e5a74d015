"""Backward as-of lookups: the state of an event table at given instants.

Spark has no as-of join, and a range join per probe would be a nested loop. Here events and probes are
put in one table, shuffled once by key, sorted once by (time, events before probes, tie-breaks), and a
running window carries the state to each probe. Any number of lookups (several horizons, several
lookbacks, book and flow totals together) share that one shuffle and sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.operators import blocks

PROBE = "_probe"


def probe_states(
    events: DataFrame,
    probes: DataFrame,
    keys: Sequence[str],
    time: str,
    tie: Sequence[str],
    phases: Sequence[dict[str, tuple[str, Column]]],
    limit: int | None = None,
) -> DataFrame:
    """Running values of `events` at every row of `probes`.

    Both tables carry `keys` and the integer `time`. Each phase is a set of running values as in
    `blocks.running`, computed from event rows only; later phases may use names of earlier ones.
    """
    instants = events.select(*keys, time).unionAll(probes.select(*keys, time))
    cuts, rows = blocks.sized_cuts(instants, keys, time, limit)
    both = events.withColumn(PROBE, F.lit(0)).unionByName(
        probes.withColumn(PROBE, F.lit(1)), allowMissingColumns=True
    )
    state, by = blocks.dealing_keys(blocks.with_block(both, time, cuts), keys)
    state = blocks.dealt(state, rows, [*by, blocks.BLOCK] if cuts else by)
    order = [time, PROBE, *tie]
    for phase in phases:
        from_events = {
            name: (kind, F.when(F.col(PROBE) == 0, expr)) for name, (kind, expr) in phase.items()
        }
        state = blocks.running(state, by, order, from_events, cuts)
    names = [name for phase in phases for name in phase]
    return state.where(F.col(PROBE) == 1).select(*probes.columns, *names)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_time: str,
    right_time: str,
    payload: Sequence[str],
    tie: Sequence[str] = (),
    max_age: int | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Left as-of join: the last `right` row at or before each left time, as columns `payload`.

    Exact matches count; among equal right times the highest `tie` wins. With `max_age` (same unit as
    the times) an older match is replaced by NULLs.
    """
    source = right.select(
        *keys,
        F.col(right_time).alias("_t"),
        *[F.col(c).alias(f"_tie_{c}") for c in tie],
        F.struct(F.col(right_time).alias("_src"), *payload).alias("_row"),
    )
    probes = left.withColumn("_t", F.col(left_time))
    found = probe_states(
        source,
        probes,
        keys,
        "_t",
        [f"_tie_{c}" for c in tie],
        [{"_match": ("last", F.col("_row"))}],
        limit,
    )
    if max_age is not None:
        fresh = F.col("_t") - F.col("_match._src") <= max_age
        found = found.withColumn("_match", F.when(fresh, F.col("_match")))
    return found.select(*left.columns, *[F.col(f"_match.{c}").alias(c) for c in payload])
