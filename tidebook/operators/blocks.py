"""Ordered computations that survive a hot key.

A window over `partitionBy(key)` sends every row of a key to one task. When one key may hold a third
of the table that task never ends, so ordered operators here cut the rows of *large* keys into blocks:
the order column is cut at quantile points of the large keys' rows, neighbouring stretches of one key are
put together until they hold about one block's share of rows, and a cell is one (key, block) pair. So a large
key has about as many cells as it holds shares, however the keys are distributed. Small keys stay whole. Each
cell is processed by an ordinary window; what crosses a border travels as one summary row per cell, accumulated
along the blocks of its key, and is joined back. The result is exactly that of the single window.

Key sizes are measured with one map-side-combined count. If no key is larger than a block, the plan is
the plain window; the values are the same either way, in the columns' own types. A NULL key is a key like
any other and is cut like one. The same count says how many tasks the rows are dealt to.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = "_block"
STRETCH = "_stretch"
WHOLE = -1  # block of rows whose key is not cut
DEFAULT_ROWS = 4_000_000
CONF_KEY = "spark.tidebook.rowsPerBlock"
# Rows drawn per cut point to place it. Only the borders depend on the draw, never the result.
SAMPLE_PER_POINT = 200
# Cut points for each share of rows, and the most that pass through the driver. Beyond that a cell may hold
# rows / MOST_POINTS more than its share; no row is left out.
POINTS_PER_BLOCK = 4
MOST_POINTS = 1024
# Passed as `limit` where a key's rows are bounded by construction (for example 60 slots per stock and
# date): no size check, one window.
BOUNDED = -1
# Rows a task gets where whole keys are dealt to tasks.
ROWS_PER_TASK = 200_000


@dataclass(frozen=True)
class Cuts:
    """Border values of the order column and the large keys they apply to (None: the whole table).

    `cells` says for each large key and stretch between borders to which block it belongs; `most` is the largest number
    of blocks of one key.
    """

    points: tuple[float, ...]
    large: DataFrame | None
    cells: DataFrame | None
    most: int


def rows_per_block(df: DataFrame, override: int | None = None) -> int:
    return int(override or df.sparkSession.conf.get(CONF_KEY, str(DEFAULT_ROWS)))


def cut_points(
    df: DataFrame, keys: Sequence[str], order: str, limit: int | None = None
) -> Cuts | None:
    """Where to cut large keys, or None when no key holds more than `limit` rows."""
    return sized_cuts(df, keys, order, limit)[0]


def sized_cuts(
    df: DataFrame, keys: Sequence[str], order: str, limit: int | None = None
) -> tuple[Cuts | None, int]:
    """`cut_points` and the number of all rows, from the same count (0 where nothing is counted)."""
    if limit == BOUNDED:
        return None, 0
    limit = rows_per_block(df, limit)
    sizes = df.groupBy(*keys).count() if keys else df.select(F.count("*").alias("count"))
    rows, everything = sizes.agg(F.sum(F.when(F.col("count") > limit, F.col("count"))), F.sum("count")).first()
    if not rows:
        return None, everything or 0
    large, measured = None, df
    if keys:
        # at most rows / limit keys; they stay a table, whose written size decides how it is joined
        large = settled(sizes.where(F.col("count") > limit).select(*keys))
        measured = null_safe_join(df, large, keys, "left_semi")
    count = min(MOST_POINTS, -(-rows * POINTS_PER_BLOCK // limit))
    share = min(1.0, SAMPLE_PER_POINT * count / rows)
    drawn = measured.select(F.col(order).cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    if share < 1.0:
        drawn = drawn.sample(fraction=share, seed=7)
    found = drawn.agg(
        F.percentile_approx("v", [i / count for i in range(1, count)] or [0.5], 10 * count)
    ).first()[0]
    points = tuple(sorted(set(found or [])))
    part = list(keys)
    sizes = _stretched(measured, order, points).groupBy(*part, STRETCH).count()
    before = F.sum("count").over(
        Window.partitionBy(*(part or [F.lit(0)])).orderBy(STRETCH).rowsBetween(Window.unboundedPreceding, -1)
    )
    block = F.floor(F.coalesce(before, F.lit(0)) / limit).cast("int")
    cells = settled(sizes.select(*part, STRETCH, block.alias(BLOCK)))
    most = cells.agg(F.max(BLOCK)).first()[0]
    return Cuts(points, large, cells, int(most) + 1), everything


def _stretched(df: DataFrame, order: str, points: Sequence[float]) -> DataFrame:
    """Add the number of the stretch between cut points that each row is in; NULL comes first, NaN last."""
    staged = df.withColumn("_order_value", F.coalesce(F.col(order).cast("double"), F.lit(float("-inf"))))
    splits = [float("-inf"), *points, float("inf")]
    cut = Bucketizer(splits=splits, inputCol="_order_value", outputCol=STRETCH, handleInvalid="keep")
    return cut.transform(staged).drop("_order_value")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join on equal keys, NULL equal to NULL; the columns of `left` and the other columns of `right`."""
    named = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    matched = F.lit(True)
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"_right_{k}"))
    return left.join(named, matched, how).drop(*[f"_right_{k}" for k in keys])


def shared_folder(df: DataFrame) -> str:
    """The checkpoint folder of the cluster. Only a local session may go without one; it gets its own."""
    context = df.sparkSession.sparkContext
    folder = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        context.setCheckpointDir(folder)
    return folder


def settled(df: DataFrame) -> DataFrame:
    """The same rows, written once to the shared folder, for tables that several jobs would redo."""
    path = f"{shared_folder(df).rstrip('/')}/settled-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dealt(df: DataFrame, rows: int, keys: Sequence[str], ranges: bool = False) -> DataFrame:
    """The same rows, dealt by `keys` to a task for every `ROWS_PER_TASK` of them.

    Without a number adaptive execution joins shuffle partitions by their compressed bytes. Rows of ladders or of repeated
    keys shrink forty times and more, so tasks would grow with the input until one sort holds gigabytes.

    With `ranges` the keys are dealt in their order, so that a task gets its share and one key's rows at most, where hashes
    bring several large keys together. The rows are read once more for the borders.
    """
    if rows <= ROWS_PER_TASK or not keys:
        return df
    tasks = max(-(-rows // ROWS_PER_TASK), df.sparkSession.sparkContext.defaultParallelism)
    return df.repartitionByRange(tasks, *keys) if ranges else df.repartition(tasks, *keys)


def dealing_keys(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """The rows with a column of text for each floating-point key, and the names to deal and to part them by.

    A window makes one value of -0.0 and 0.0 and of all NaN first, which takes it for other keys than those that the rows
    were dealt by: they would be shuffled once more, into tasks by bytes again. Equal keys have equal texts.
    """
    types, names = dict(df.dtypes), list(keys)
    for i, k in enumerate(names):
        if types[k] in ("double", "float"):
            names[i] = f"_key_{k}"
            df = df.withColumn(names[i], (F.col(k) + F.lit(0.0)).cast("string"))
    return df, names


def with_block(df: DataFrame, order: str, cuts: Cuts | None) -> DataFrame:
    """Add the block number of each row; rows of small keys get `WHOLE`."""
    if cuts is None:
        return df.withColumn(BLOCK, F.lit(WHOLE))
    keys = cuts.large.columns if cuts.large is not None else []
    blocked = null_safe_join(_stretched(df, order, cuts.points), cuts.cells, [*keys, STRETCH], "left")
    return blocked.withColumn(BLOCK, F.coalesce(BLOCK, F.lit(WHOLE))).drop(STRETCH)


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    values: dict[str, tuple[str, Column]],
    cuts: Cuts | None = None,
) -> DataFrame:
    """Add running values over `order` within `keys`.

    `values` maps an output name to (kind, expression): `sum` is the running total with the current
    row, `last` the latest non-NULL value with the current row, `prior` the latest non-NULL value of
    strictly earlier rows. With cuts, `df` must carry the block column.
    """
    part = [*keys, BLOCK] if cuts else list(keys)
    upto = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    local = {
        name: F.sum(expr).over(upto)
        if kind == "sum"
        else F.last(expr, ignorenulls=True).over(upto if kind == "last" else before)
        for name, (kind, expr) in values.items()
    }
    out = df.withColumns(local)
    if not cuts:
        return out
    closing = [
        (
            F.sum(expr)
            if kind == "sum"
            else F.max_by(expr, F.when(expr.isNotNull(), F.struct(*order)))
        ).alias(f"_c_{name}")
        for name, (kind, expr) in values.items()
    ]
    earlier = (
        Window.partitionBy(*(keys or [F.lit(0)]))
        .orderBy(BLOCK)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    seeds = (
        df.where(F.col(BLOCK) != WHOLE)
        .groupBy(*part)
        .agg(*closing)
        .select(
            *part,
            *[
                (
                    F.sum(f"_c_{name}")
                    if kind == "sum"
                    else F.last(f"_c_{name}", ignorenulls=True)
                )
                .over(earlier)
                .alias(f"_s_{name}")
                for name, (kind, _) in values.items()
            ],
        )
    )
    joined = null_safe_join(out, seeds, part, "left")
    # A sum keeps NULL only while nothing at all has been added.
    patched = {
        name: F.when(F.col(f"_s_{name}").isNull(), F.col(name)).otherwise(
            F.coalesce(F.col(name), F.lit(0)) + F.col(f"_s_{name}")
        )
        if kind == "sum"
        else F.coalesce(name, f"_s_{name}")
        for name, (kind, _) in values.items()
    }
    return joined.withColumns(patched).drop(*[f"_s_{name}" for name in values])


def previous(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    columns: Sequence[str],
    limit: int | None = None,
) -> DataFrame:
    """Add a struct `prev` with `columns` of the preceding row, NULL on a key's first row.

    The first order column must be numeric: it decides the blocks.
    """
    cuts, rows = sized_cuts(df, keys, order[0], limit)
    blocked, by = dealing_keys(with_block(df, order[0], cuts), keys)
    values = {"prev": ("prior", F.struct(*columns))}
    found = running(dealt(blocked, rows, [*by, BLOCK] if cuts else by), by, order, values, cuts)
    return found.select(*df.columns, *values)


def positions(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    name: str = "position",
    limit: int | None = None,
) -> DataFrame:
    """Add the one-based rank of each row in `order` within `keys`; order columns must be unique."""
    cuts, rows = sized_cuts(df, keys, order[0], limit)
    blocked, by = dealing_keys(with_block(df, order[0], cuts), keys)
    values = {name: ("sum", F.lit(1))}
    found = running(dealt(blocked, rows, [*by, BLOCK] if cuts else by), by, order, values, cuts)
    return found.select(*df.columns, *values)
