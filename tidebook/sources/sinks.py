"""Writers and the partition catalog."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.operators import blocks


def write_table(df: DataFrame, path: str, kind: str = "parquet") -> None:
    """Parquet, CSV or gzip CSV; Spark's commit makes the output appear whole or not at all."""
    writer = df.write.mode("overwrite")
    if kind == "parquet":
        writer.parquet(path)
    elif kind == "csv":
        writer.option("header", True).csv(path)
    elif kind == "csv.gz":
        writer.option("header", True).option("compression", "gzip").csv(path)
    else:
        raise ValueError("kind must be parquet, csv or csv.gz")


def write_partitions(df: DataFrame, path: str, by: Sequence[str]) -> None:
    """Zstandard Parquet, one directory per key; only the directories present in `df` are replaced.

    `rebalance` sends a key's rows together but lets AQE split a large one over several files and tasks.
    """
    (
        df.hint("rebalance", *by)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .option("compression", "zstd")
        .partitionBy(*by)
        .parquet(path)
    )


def not_yet_done(sessions: DataFrame, catalog: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sessions without a catalog entry."""
    return sessions.join(catalog.select(*keys), list(keys), "left_anti")


#: What a catalog of sessions holds.
CATALOG = "split string, session_date string, rows long, fingerprint long"


def committed_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Catalog rows of the sessions whose commit is whole; none where there is no catalog yet."""
    try:
        return spark.read.schema(CATALOG).parquet(f"{path}/catalog")
    except AnalysisException:  # no such folder
        return spark.createDataFrame([], CATALOG)


def process_sessions(events: DataFrame, path: str, process: Callable[[DataFrame], DataFrame], split: Column) -> DataFrame:
    """Processes every session of `events` that the catalog doesn't list, in one job, and returns the catalog.

    `process` makes a session's rows from its events, keeping session_date; sessions outside every split are left out.
    Rows are written first, one folder per split and session, replacing what an attempt that died has left there; then
    they are counted as written, and only then are the sessions' rows appended to the catalog. So a session is in the
    catalog if and only if its rows are whole, and running again takes up what is missing. A session whose processing
    gives no row is listed with none.
    """
    spark = events.sparkSession
    dated = events.withColumns({"session_date": F.col("session_date").cast("string"), "split": split}).where("split IS NOT NULL")
    known = dated.select("split", "session_date").distinct()
    wanted = blocks.settled(not_yet_done(known, committed_sessions(spark, path), ["session_date"]))
    if wanted.isEmpty():
        return committed_sessions(spark, path)
    todo = dated.join(wanted.select("session_date"), "session_date", "left_semi").drop("split")
    rows = process(todo).withColumn("session_date", F.col("session_date").cast("string")).join(wanted, "session_date")
    write_partitions(rows, f"{path}/sessions", ["split", "session_date"])
    kinds = rows.schema  # partition values are read back as they were written
    written = spark.read.schema(kinds).parquet(f"{path}/sessions").join(wanted, ["split", "session_date"], "left_semi")
    counted = wanted.join(catalog(written, ["split", "session_date"]), ["split", "session_date"], "left")
    entries = counted.select("split", "session_date", F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("fingerprint", F.lit(0)).cast("long").alias("fingerprint"))
    entries.coalesce(1).write.mode("append").parquet(f"{path}/catalog")
    return committed_sessions(spark, path)


def compact(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df.select(*columns)


def catalog(df: DataFrame, keys: Sequence[str], target: str | None = None) -> DataFrame:
    """Rows and an order-free content fingerprint per partition, with usable targets if named.

    The fingerprint is the XOR of row hashes (of every column by name) next to the row count. Whole
    numbers hash as BIGINT, so a partition column read back with a narrower type changes nothing.
    """
    whole = {"tinyint", "smallint", "int"}
    plain = lambda c, kind: F.col(c).cast("bigint" if kind in whole else "double" if kind == "float" else kind)
    body = F.xxhash64(*[plain(c, kind) for c, kind in sorted(df.dtypes)])
    extra = [F.count(target).alias("target_rows")] if target else []
    return df.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.bit_xor(body).alias("fingerprint"), *extra
    )


def compare_catalogs(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Status of each partition: same, changed, added or removed."""
    keys = list(keys)
    a = old.select(*keys, F.struct("rows", "fingerprint").alias("_a"))
    b = new.select(*keys, F.struct("rows", "fingerprint").alias("_b"))
    status = (
        F.when(F.col("_a").isNull(), "added")
        .when(F.col("_b").isNull(), "removed")
        .when(F.col("_a") == F.col("_b"), "same")
        .otherwise("changed")
    )
    return a.join(b, keys, "full").select(*keys, status.alias("status"))


def split_totals(entries: DataFrame) -> DataFrame:
    """Partitions, rows and targets per split, and whether every partition has between 1 and all targets."""
    covered = (F.col("target_rows") > 0) & (F.col("target_rows") <= F.col("rows"))
    return entries.groupBy("split").agg(
        F.count("*").alias("partitions"),
        F.sum("rows").alias("rows"),
        F.sum("target_rows").alias("target_rows"),
        F.bool_and(covered).alias("covered"),
    )


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """SHA-256 of each file's bytes, computed where the file is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
