"""Quality rules and profiles of the auction panel and of snapshot matrices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidebook.functions.scalars import is_finite
from tidebook.operators import blocks

# The panel's external header, with what each column holds.
PANEL_TYPES = {
    "stock_id": "whole",
    "date_id": "whole",
    "seconds_in_bucket": "whole",
    "imbalance_size": "number",
    "imbalance_buy_sell_flag": "whole",
    "reference_price": "number",
    "matched_size": "number",
    "far_price": "number or missing",
    "near_price": "number or missing",
    "bid_price": "number",
    "bid_size": "number",
    "ask_price": "number",
    "ask_size": "number",
    "wap": "number",
    "target": "number or missing",
    "time_id": "whole",
    "row_id": "text",
}
PANEL_COLUMNS = tuple(PANEL_TYPES)
INTEGERS = tuple(c for c, kind in PANEL_TYPES.items() if kind == "whole")
FLOATS = tuple(c for c, kind in PANEL_TYPES.items() if kind == "number")
SYNTHETIC_PREFIX = "SYNTHETIC_"


def row_rules(has_target: bool = True) -> dict[str, Column]:
    """Rule name to 'this row breaks it'."""
    c = F.col
    any_of = lambda parts: F.coalesce(_either(parts), F.lit(False))
    fractional = lambda n: c(n).cast("double") != F.floor(c(n).cast("double"))
    optional_bad = lambda n: c(n).isNotNull() & (~is_finite(c(n)) | (c(n) <= 0))
    key_text = F.concat_ws("_", "date_id", "seconds_in_bucket", "stock_id")
    rules = {
        "not_finite": any_of([~is_finite(c(n)) for n in (*INTEGERS, *FLOATS)]),
        "not_integral": any_of([fractional(n) for n in INTEGERS]),
        "flag_domain": any_of([~c("imbalance_buy_sell_flag").isin(-1, 0, 1)]),
        "second_grid": any_of(
            [c("seconds_in_bucket") < 0, c("seconds_in_bucket") >= 600, c("seconds_in_bucket") % 10 != 0]
        ),
        "negative_id": any_of([c(n) < 0 for n in ("stock_id", "date_id", "time_id")]),
        "quote_size": any_of([c(n) <= 0 for n in ("bid_size", "ask_size")]),
        "auction_size": any_of([c(n) < 0 for n in ("imbalance_size", "matched_size")]),
        "price_sign": any_of([c(n) <= 0 for n in ("reference_price", "bid_price", "ask_price", "wap")]),
        "optional_price": any_of([optional_bad(n) for n in ("near_price", "far_price")]),
        "crossed_quote": any_of([c("ask_price") < c("bid_price")]),
        "wap_outside": any_of([c("wap") < c("bid_price"), c("wap") > c("ask_price")]),
        "missing_row_id": c("row_id").isNull(),
        "row_id_text": any_of([F.regexp_replace("row_id", f"^{SYNTHETIC_PREFIX}", "") != key_text]),
    }
    if has_target:
        rules["target_not_finite"] = c("target").isNotNull() & ~is_finite(c("target"))
    return rules


def _either(parts: Sequence[Column]) -> Column:
    out = parts[0]
    for part in parts[1:]:
        out = out | part
    return out


def row_rule_counts(panel: DataFrame) -> DataFrame:
    """(rule, failures) from one scan."""
    rules = row_rules("target" in panel.columns)
    counts = panel.agg(*[F.count_if(test).alias(name) for name, test in rules.items()])
    return counts.unpivot([], list(rules), "rule", "failures")


def set_rule_counts(panel: DataFrame) -> DataFrame:
    """(rule, failures) of uniqueness and of the one-to-one map between time_id and (date, second).

    Distinct triples are taken first, so the mapping checks run on one row per time slot.
    """
    above_one = lambda grouped: grouped.where("n > 1").agg(F.count("*").alias("failures"))
    keys = ["date_id", "seconds_in_bucket", "stock_id"]
    slots = panel.select("time_id", "date_id", "seconds_in_bucket").distinct()
    size = F.count("*").alias("n")
    parts = {
        "duplicate_key": panel.groupBy(*keys).agg(size),
        "duplicate_row_id": panel.groupBy("row_id").agg(size),
        "time_id_has_many_slots": slots.groupBy("time_id").agg(size),
        "slot_has_many_time_ids": slots.groupBy("date_id", "seconds_in_bucket").agg(size),
    }
    rows = [above_one(g).select(F.lit(name).alias("rule"), "failures") for name, g in parts.items()]
    out = rows[0]
    for row in rows[1:]:
        out = out.unionByName(row)
    return out


def order_breaks(
    rows: DataFrame, key: Sequence[str], arrival: str, file: str | None = None, limit: int | None = None
) -> DataFrame:
    """Rows that arrive after a row with a larger key (per file if given)."""
    by = [file] if file else []
    seen = blocks.previous(rows, by, [arrival], list(key), limit)
    late = seen.select(*by, (F.col("prev") > F.struct(*key)).alias("late"))
    return (late.groupBy(*by) if by else late).agg(F.count_if("late").alias("order_breaks"))


def profile(panel: DataFrame) -> DataFrame:
    """Shape of the panel in one row, reduced in two steps so that no set of rows is held whole."""
    times = panel.groupBy("time_id").agg(F.count("*").alias("n"))
    sizes = times.groupBy("n").agg(F.count("*").alias("c"))
    modal = sizes.agg(
        F.min("n").alias("rows_per_time_min"),
        F.max("n").alias("rows_per_time_max"),
        F.max_by("n", F.struct("c", -F.col("n"))).alias("rows_per_time_mode"),
        F.sum("c").alias("time_ids"),
    )
    below = (
        sizes.crossJoin(F.broadcast(modal))
        .groupBy("rows_per_time_min", "rows_per_time_max", "rows_per_time_mode", "time_ids")
        .agg(F.coalesce(F.sum(F.when(F.col("n") < F.col("rows_per_time_mode"), F.col("c"))), F.lit(0)).alias("times_below_mode"))
    )
    pairs = panel.groupBy("stock_id", "date_id").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col(c).isNull()).alias(c) for c in ("near_price", "far_price", "target")],
    )
    totals = pairs.agg(
        F.sum("n").alias("rows"),
        F.count("*").alias("stock_date_pairs"),
        F.min("date_id").alias("date_id_min"),
        F.max("date_id").alias("date_id_max"),
        *[F.sum(c).alias(c.replace("_price", "") + "_missing") for c in ("near_price", "far_price", "target")],
    )
    stocks = pairs.select("stock_id").distinct().agg(F.count("*").alias("stocks"))
    dates = pairs.select("date_id").distinct().agg(F.count("*").alias("dates"))
    # Four one-row tables side by side.
    return totals.crossJoin(F.broadcast(below)).crossJoin(F.broadcast(stocks)).crossJoin(F.broadcast(dates))


def date_coverage(panel: DataFrame, first: int, last: int) -> DataFrame:
    """Status of each expected or observed date: covered, no_target, missing or unexpected."""
    expected = panel.sparkSession.range(first, last + 1).select(
        F.col("id").alias("date_id"), F.lit(True).alias("expected")
    )
    seen = panel.groupBy("date_id").agg(F.count("target").alias("targets"))
    status = (
        F.when(F.col("targets").isNull(), "missing")
        .when(F.col("expected").isNull(), "unexpected")
        .when(F.col("targets") == 0, "no_target")
        .otherwise("covered")
    )
    return expected.join(seen, "date_id", "full").select("date_id", status.alias("status"))


def snapshot_checks(snapshots: DataFrame, keys: Sequence[str], width: int = 144) -> DataFrame:
    """Observation count and rule failures per member."""
    bad_value = F.exists("features", lambda v: ~is_finite(v))
    bad_label = F.size(F.array_except("labels", F.array(*[F.lit(i).cast("tinyint") for i in (1, 2, 3)]))) > 0
    return snapshots.groupBy(*keys).agg(
        F.count("*").alias("observations"),
        F.count_if(F.size("features") != width).alias("bad_width"),
        F.count_if(bad_value).alias("not_finite"),
        F.count_if(bad_label).alias("bad_labels"),
    )
