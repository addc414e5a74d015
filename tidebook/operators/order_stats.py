"""Exact ranks and quantiles per group, for groups of any size.

Small groups use one window or one `percentile` aggregate. A group above the block limit is first
reduced to its distinct values with counts (so a value shared by a third of the rows is one row), then
ranked by blocks; see `blocks`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidebook.operators import blocks
from tidebook.operators.blocks import BLOCK, BOUNDED

GROUP_ROWS = 1_000_000  # of one group that a task ranks at once; more are ranked by blocks


def value_counts(
    df: DataFrame, keys: Sequence[str], value: str, limit: int | None = None
) -> DataFrame:
    """One row per distinct value: `n` copies, `below` smaller rows, `total` rows of the group.

    Meant for large groups: the distinct values are written once, then sized, sampled and ranked.
    """
    distinct = blocks.settled(
        df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    )
    cuts = blocks.cut_points(distinct, keys, value, limit)
    ranked = blocks.running(
        blocks.with_block(distinct, value, cuts),
        keys,
        [value],
        {"upto": ("sum", F.col("n"))},
        cuts,
    ).drop(BLOCK)
    totals = ranked.groupBy(*keys).agg(F.sum("n").alias("total"))
    joined = blocks.null_safe_join(ranked, totals, keys, "inner") if keys else ranked.crossJoin(F.broadcast(totals))
    return joined.select(*keys, value, "n", (F.col("upto") - F.col("n")).alias("below"), "total")


def is_hot(df: DataFrame, keys: Sequence[str], limit: int | None = None) -> bool:
    """Whether some group holds more rows than one block."""
    return False if limit == BOUNDED else group_sizes(df, keys)[0] > blocks.rows_per_block(df, limit)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest group and of all groups."""
    sizes = df.groupBy(*keys).count() if keys else df.select(F.count("*").alias("count"))
    largest, rows = sizes.agg(F.max("count"), F.sum("count")).first()
    return largest or 0, rows or 0


def average_rank(
    df: DataFrame,
    keys: Sequence[str],
    columns: dict[str, str],
    percent: bool = False,
    limit: int | None = None,
) -> DataFrame:
    """Add ranks with ties averaged; NULL values get NULL. `columns` maps value to output name."""
    largest, rows = (0, 0) if limit == BOUNDED else group_sizes(df, keys)
    if limit == BOUNDED or largest <= min(GROUP_ROWS, blocks.rows_per_block(df, limit)):
        given = df.columns
        df, by = blocks.dealing_keys(df, keys)
        df, part = blocks.dealt(df, rows, by, ranges=largest > blocks.ROWS_PER_TASK // 8), by or [F.lit(0)]

        def rank(value: str) -> Column:
            # NULLs sort first and are subtracted. The count runs up to the last row of the same value, so that the mean of
            # both ends needs one sort, and every further window of this order none.
            by_value = Window.partitionBy(*part).orderBy(value)
            last = F.count(value).over(by_value)
            mean = (F.rank().over(by_value) - F.count_if(F.col(value).isNull()).over(by_value) + last) / 2
            scaled = mean / F.count(value).over(Window.partitionBy(*part)) if percent else mean.cast("double")
            return F.when(F.col(value).isNotNull(), scaled)

        for value, out in columns.items():  # one after the other, for a window node sorts once for each order
            df = df.withColumn(out, rank(value))
        return df.select(*given, *columns.values())
    for value, out in columns.items():
        counts = value_counts(df.select(*keys, value), keys, value, limit)
        mean = F.col("below") + (F.col("n") + 1) / 2
        scaled = mean / F.col("total") if percent else mean.cast("double")
        ranks = counts.select(*keys, value, scaled.alias(out))
        df = blocks.null_safe_join(df, ranks, [*keys, value], "left")
    return df


NAME, VALUE = "_name", "_value"


def stacked(df: DataFrame, keys: Sequence[str], columns: Iterable[str]) -> DataFrame:
    """Several numeric columns as (keys, name, value) rows, so that one pass serves them all."""
    entries = [
        F.struct(F.lit(c).alias(NAME), F.col(c).cast("double").alias(VALUE)) for c in columns
    ]
    return df.select(*keys, F.explode(F.array(*entries)).alias("_e")).select(*keys, "_e.*")


def join_ranks(
    df: DataFrame, keys: Sequence[str], columns: dict[str, str], counts: DataFrame, percent: bool
) -> DataFrame:
    """Attach average ranks from the value counts of `stacked` columns."""
    mean = F.col("below") + (F.col("n") + 1) / 2
    rank = mean / F.col("total") if percent else mean.cast("double")
    for value, out in columns.items():
        ranks = counts.where(F.col(NAME) == value).select(
            *keys, F.col(VALUE).alias("_v"), rank.alias(out)
        )
        df = (
            df.withColumn("_v", F.col(value).cast("double"))
            .join(ranks, [*keys, "_v"], "left")
            .drop("_v")
        )
    return df


def quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probabilities: Sequence[float],
    name: str = "q",
    limit: int | None = None,
) -> DataFrame:
    """Exact linearly interpolated quantiles per group as one array column."""
    clean = df.where(F.col(value).isNotNull())
    if not is_hot(clean, keys, limit):
        wanted = F.percentile(value, F.array(*[F.lit(float(p)) for p in probabilities]))
        return (clean.groupBy(*keys) if keys else clean).agg(wanted.alias(name))
    found = _bracketed_quantiles(clean, keys, value, probabilities, name, limit)
    if found is not None:
        return found
    return quantiles_from_counts(
        value_counts(df, keys, value, limit), keys, value, probabilities, name
    )


SKETCH = 10_000  # rank error of the sketch is at most rows / SKETCH
MARGIN = 3 / SKETCH


def _bracketed_quantiles(
    clean: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], name: str, limit: int | None
) -> DataFrame | None:
    """Exact quantiles without shuffling all values, or None if a bracket missed its position.

    A mergeable sketch gives, per group and probability, two values that enclose the wanted position.
    A second scan keeps the values inside brackets and only counts the rest: every stretch between
    brackets collapses to one row before the shuffle. Positions are then read off exact running counts.
    """
    points = sorted(set(probabilities))
    lows = [max(0.0, p - MARGIN) for p in points]
    highs = [min(1.0, p + MARGIN) for p in points]
    sketch = F.percentile_approx(value, [*lows, *highs], SKETCH)
    bounds = (clean.groupBy(*keys) if keys else clean).agg(sketch.alias("_b"))
    at = lambda i: F.element_at("_b", i + 1)
    v, count = F.col(value), len(points)
    paired = (
        blocks.null_safe_join(clean.select(*keys, value), bounds, keys, "inner")
        if keys
        else clean.select(value).crossJoin(F.broadcast(bounds))  # one row
    )
    inside, cell = F.lit(False), F.lit(0)
    for i in range(count):
        inside = inside | ((v >= at(i)) & (v <= at(count + i)))
        cell = cell + (v >= at(i)).cast("int")
    kept = paired.select(*keys, value, cell.alias("_cell"), F.when(inside, v).alias("_v"))
    # Rows outside brackets have no _v; their least value keeps them in order.
    table = blocks.settled(
        kept.groupBy(*keys, "_cell", "_v").agg(F.count("*").alias("n"), F.min(value).alias("_at"))
    )
    cuts = blocks.cut_points(table, keys, "_at", limit)
    ranked = blocks.running(
        blocks.with_block(table, "_at", cuts), keys, ["_at"], {"upto": ("sum", F.col("n"))}, cuts
    )
    totals = (table.groupBy(*keys) if keys else table).agg(F.sum("n").alias("total"))
    sized = blocks.null_safe_join(ranked, totals, keys, "inner") if keys else ranked.crossJoin(F.broadcast(totals))
    counts = sized.where("_v IS NOT NULL").select(
        *keys, F.col("_v").alias(value), "n", (F.col("upto") - F.col("n")).alias("below"), "total"
    )
    found = blocks.settled(quantiles_from_counts(counts, keys, value, probabilities, name))
    groups = totals.count()
    whole = (F.size(name) == len(probabilities)) & ~F.exists(name, lambda q: q.isNull())
    return found if found.where(whole).count() == groups else None


def column_medians(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], limit: int | None = None
) -> DataFrame:
    """Exact medians of many columns per key as (keys, NAME, q), q an array of one; an all-missing column has no row.

    Rows stay wide: one pass sketches two values around the median of every column, a second one counts what is below
    and keeps only the values between them, a few in ten thousand besides ties, which count as one. Keys are few, and a
    row a key passes through the driver. Values that are missing are NULL, not NaN.
    """
    keys, columns = list(keys), list(columns)
    ends = [0.5 - MARGIN, 0.5 + MARGIN]
    sketches = [F.percentile_approx(F.col(c).cast("double"), ends, SKETCH).alias(f"_b{i}") for i, c in enumerate(columns)]
    grouped = lambda rows: rows.groupBy(*keys) if keys else rows
    bounds = grouped(df).agg(*sketches)
    bounds = df.sparkSession.createDataFrame(bounds.collect(), bounds.schema)
    at = F.broadcast(bounds)
    paired = blocks.null_safe_join(df, at, keys, "inner") if keys else df.crossJoin(at)
    value = [F.col(c).cast("double") for c in columns]
    counts = [F.struct(F.lit(c).alias(NAME), F.count(v).alias("total"), F.count_if(v < F.col(f"_b{i}")[0]).alias("lower")) for i, (c, v) in enumerate(zip(columns, value))]
    sizes = blocks.settled(
        grouped(paired).agg(F.array(*counts).alias("_s")).select(*keys, F.explode("_s").alias("_s")).select(*keys, "_s.*").where("total > 0")
    )
    inside = [F.struct(F.lit(c).alias(NAME), F.when(v.between(F.col(f"_b{i}")[0], F.col(f"_b{i}")[1]), v).alias(VALUE)) for i, (c, v) in enumerate(zip(columns, value))]
    kept = paired.select(*keys, F.explode(F.filter(F.array(*inside), lambda e: e[VALUE].isNotNull())).alias("_e")).select(*keys, "_e.*")
    by = [*keys, NAME]
    found = _placed_medians(kept.groupBy(*by, VALUE).agg(F.count("*").alias("n")), sizes, by, limit)
    return quantiles(stacked(df, keys, columns), by, VALUE, [0.5], "q", limit) if found is None else found


def _placed_medians(kept: DataFrame, sizes: DataFrame, by: Sequence[str], limit: int | None) -> DataFrame | None:
    """Medians from the counts of the values inside brackets and the rows below them, or None if a bracket missed."""
    table = blocks.settled(kept)
    cuts = blocks.cut_points(table, by, VALUE, limit)
    ranked = blocks.running(blocks.with_block(table, VALUE, cuts), by, [VALUE], {"upto": ("sum", F.col("n"))}, cuts)
    placed = blocks.null_safe_join(ranked, sizes, by, "inner")
    counted = placed.select(*by, VALUE, "n", (F.col("lower") + F.col("upto") - F.col("n")).alias("below"), "total")
    found = blocks.settled(quantiles_from_counts(counted, by, VALUE, [0.5], "q"))
    return found if found.where(~F.exists("q", lambda q: q.isNull())).count() == sizes.count() else None


CHUNK, POINTS = 65_536, 2_048  # rows that are sorted at once, and points kept of them: a rank is off by rows / POINTS / 2 at most
EDGE = "_edge"


def matrix(batch: pa.RecordBatch, columns: Sequence[str]) -> np.ndarray:
    """Numeric columns of a batch side by side; NaN where a value is missing."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])


def quantile_points(df: DataFrame, part: str, columns: Sequence[str]) -> DataFrame:
    """(part, at, values, weight): points at even ranks of the sorted values of a stretch of rows, by part and position of the
    column; each stands for `weight` values. They add up over tasks, so quantiles of any parts can be read off."""
    columns = list(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}

        def points(p: int) -> pa.RecordBatch:
            rows = np.sort(np.concatenate(held.pop(p)), axis=0)  # NaN last
            there = len(rows) - np.isnan(rows).sum(0)
            kept = [rows[:n, i] if n <= POINTS else rows[((np.arange(POINTS) + 0.5) * (n / POINTS)).astype(int), i] for i, n in enumerate(there)]
            weights = [n / max(1, len(v)) for n, v in zip(there.tolist(), kept)]
            return pa.RecordBatch.from_pydict(
                {part: pa.array([p] * len(kept), pa.int32()), "at": pa.array(range(len(kept)), pa.int32()), "values": pa.array(kept, pa.list_(pa.float64())), "weight": pa.array(weights, pa.float64())}
            )

        for batch in batches:
            parts = batch.column(part).to_numpy(zero_copy_only=False)
            values = matrix(batch, columns)
            for p in np.unique(parts).tolist():
                held.setdefault(p, []).append(values[parts == p])
                if sum(map(len, held[p])) >= CHUNK:
                    yield points(p)
        for p in list(held):
            yield points(p)

    rows = df.select(F.col(part).cast("int").alias(part), *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.mapInArrow(run, f"{part} int, at int, values array<double>, weight double")


def read_points(points: DataFrame, part: str, edges: Sequence[int], probabilities: Sequence[float]) -> dict[tuple[int, int], np.ndarray]:
    """Approximate quantiles of the rows with part < edge, for each edge and position of a column that has values."""
    edges, probabilities = list(edges), np.array(probabilities, float)

    def run(table: pa.Table) -> pa.Table:
        sizes = np.array([len(v) for v in table.column("values")])
        values = table.column("values").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        weights, parts = (np.repeat(table.column(c).to_numpy(), sizes) for c in ("weight", part))
        order = np.argsort(values, kind="stable")
        values, weights, parts = values[order], weights[order], parts[order]
        out = []
        for edge in edges:
            mine = parts < edge
            if mine.any():
                upto = np.cumsum(weights[mine])
                # the first value with that share of the rows up to it
                found = np.searchsorted(upto, probabilities * upto[-1] - 1e-9 * upto[-1], "left")
                out.append((edge, values[mine][np.minimum(found, mine.sum() - 1)]))
        return pa.table({"edge": pa.array([e for e, _ in out], pa.int32()), "at": pa.array([table.column("at")[0].as_py()] * len(out), pa.int32()), "q": pa.array([q for _, q in out], pa.list_(pa.float64()))})

    rows = points.where(F.size("values") > 0).groupBy("at").applyInArrow(run, "edge int, at int, q array<double>").collect()  # a row an edge and column
    return {(r["edge"], r["at"]): np.array(r["q"]) for r in rows}


def nested_medians(df: DataFrame, part: str, edges: Sequence[int], columns: Sequence[str], points: DataFrame | None = None, limit: int | None = None) -> DataFrame:
    """Exact medians of many columns over the rows with part < edge, for each edge, as (EDGE, NAME, q); a column without values
    has no row. NaN is missing.

    Rows stay wide and are not repeated per edge: one pass sketches all columns (or `points` has the sketch), a second one
    counts what is below the bracket around each median and keeps the values inside.
    """
    columns, edges = list(columns), list(edges)
    points = quantile_points(df, part, columns) if points is None else points
    ends = read_points(points, part, edges, [0.5 - 2 / POINTS, 0.5 + 2 / POINTS])
    bounds = {e: np.array([ends.get((e, i), [np.nan, np.nan]) for i in range(len(columns))]).T for e in edges}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = {e: np.zeros((2, len(columns)), np.int64) for e in edges}
        for batch in batches:
            parts = batch.column(part).to_numpy(zero_copy_only=False)
            values = matrix(batch, columns)
            for e in edges:
                mine = values[parts < e]
                low, high = bounds[e]
                below = mine < low
                sizes[e] += np.stack([(~np.isnan(mine)).sum(0), below.sum(0)])
                at, row = np.nonzero(((mine >= low) & (mine <= high)).T)
                inside = mine[row, at]
                order = np.lexsort((inside, at))
                at, inside = at[order], inside[order]
                first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (inside[1:] != inside[:-1])][: len(at)])
                n = np.diff(np.r_[first, len(at)])
                yield pa.RecordBatch.from_pydict({EDGE: pa.array(np.full(len(first), e, np.int32)), "at": pa.array(at[first].astype(np.int32)), VALUE: pa.array(inside[first]), "n": pa.array(n.astype(np.int64)), "total": pa.nulls(len(first), pa.int64())})
        for e, (total, lower) in sizes.items():
            yield pa.RecordBatch.from_pydict({EDGE: pa.array([e] * len(columns), pa.int32()), "at": pa.array(range(len(columns)), pa.int32()), VALUE: pa.nulls(len(columns), pa.float64()), "n": pa.array(lower), "total": pa.array(total)})

    rows = df.select(F.col(part).cast("int").alias(part), *[F.col(c).cast("double").alias(c) for c in columns])
    name = F.get(F.array(*[F.lit(c) for c in columns]), F.col("at")).alias(NAME)
    made = rows.mapInArrow(run, f"{EDGE} int, at int, {VALUE} double, n bigint, total bigint").groupBy(EDGE, "at", VALUE)
    made = blocks.settled(made.agg(F.sum("n").alias("n"), F.sum("total").alias("total")).select(EDGE, name, VALUE, "n", "total"))
    by = [EDGE, NAME]
    sizes = made.where(F.col("total") > 0).select(*by, "total", F.col("n").alias("lower"))
    found = _placed_medians(made.where(F.col(VALUE).isNotNull()).select(*by, VALUE, "n"), sizes, by, limit)
    if found is not None:
        return found
    each = rows.withColumn(EDGE, F.explode(F.filter(F.array(*[F.lit(e) for e in edges]), lambda e: e > F.col(part))))
    clean = each.select(EDGE, *[F.nanvl(F.col(c), F.lit(None).cast("double")).alias(c) for c in columns])
    return quantiles(stacked(clean, [EDGE], columns), by, VALUE, [0.5], "q", limit)


def quantiles_from_counts(
    counts: DataFrame, keys: Sequence[str], value: str, probabilities: Sequence[float], name: str = "q"
) -> DataFrame:
    """Quantiles read off value counts by position, without collecting a group."""
    # Each probability needs the values at two neighbouring zero-based positions.
    spots = F.explode(
        F.array(
            *[
                F.struct(F.lit(i).alias("slot"), F.lit(float(p)).alias("p"))
                for i, p in enumerate(probabilities)
            ]
        )
    )
    at = (F.col("total") - 1) * F.col("spot.p")
    low, high = F.floor(at), F.ceil(at)
    inside = lambda where: (where >= F.col("below")) & (where < F.col("below") + F.col("n"))
    hits = counts.select("*", spots.alias("spot")).where(inside(low) | inside(high))
    lerp = hits.groupBy(*keys, F.col("spot.slot").alias("slot")).agg(
        F.max(F.when(inside(low), F.col(value))).alias("lo"),
        F.max(F.when(inside(high), F.col(value))).alias("hi"),
        F.first(at - low).alias("share"),
    )
    point = F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("share")
    ordered = F.array_sort(F.collect_list(F.struct("slot", point.alias("v"))))
    return lerp.groupBy(*keys).agg(F.transform(ordered, lambda s: s["v"]).alias(name))


def spearman(
    df: DataFrame,
    keys: Sequence[str],
    left: str,
    right: str,
    name: str = "spearman_ic",
    limit: int | None = None,
) -> DataFrame:
    """Rank correlation per group with its row count; NULL for <2 rows or a constant side."""
    clean = df.where(F.col(left).isNotNull() & F.col(right).isNotNull()).select(*keys, left, right)
    ranked = average_rank(clean, keys, {left: "_rl", right: "_rr"}, limit=limit)
    spread = F.stddev_pop("_rl") * F.stddev_pop("_rr")
    value = F.when(F.count("*") >= 2, F.try_divide(F.covar_pop("_rl", "_rr"), spread))
    return ranked.groupBy(*keys).agg(F.count("*").alias("rows"), value.alias(name))
