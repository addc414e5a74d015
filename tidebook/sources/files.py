"""Readers: book CSV, auction CSV, matrix text and prepared Parquet."""

from __future__ import annotations

from collections.abc import Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidebook.operators import quality
from tidebook.operators.panel_quality import PANEL_COLUMNS, PANEL_TYPES

SKIPPED_NAMES = ("definition", "symbology", "metadata")  # fixed words in names of side files
DATA_SUFFIXES = (".csv", ".csv.gz")
MATRIX_FEATURES, MATRIX_LABELS = 144, 5


def session_date_of(name: Column) -> Column:
    """Session date in a file name: the first run of digits that is a whole date of this century, one with dashes
    before one without; NULL when there is none."""
    runs = F.regexp_extract_all(name, F.lit(r"\d{4}-\d{2}-\d{2}(?!\d)|\d+"), F.lit(0))
    dates = lambda dashed: F.filter(
        F.transform(
            F.filter(runs, lambda r: F.contains(r, F.lit("-")) == F.lit(dashed)),
            lambda r: F.when(F.length(F.replace(r, F.lit("-"))).eqNullSafe(8), F.try_to_date(F.replace(r, F.lit("-")), "yyyyMMdd")),
        ),
        lambda d: d.between(F.lit("2000-01-01").cast("date"), F.lit("2099-12-31").cast("date")),
    )
    return F.coalesce(F.get(dates(True), F.lit(0)), F.get(dates(False), F.lit(0)))


def _base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def _is_daily(name: Column) -> Column:
    lowered = F.lower(name)
    suffix = F.lit(False)
    for s in DATA_SUFFIXES:
        suffix = suffix | lowered.endswith(s)
    side = F.lit(False)
    for word in SKIPPED_NAMES:
        side = side | lowered.contains(word)
    return suffix & ~side


def discover_daily_files(spark: SparkSession, root: str) -> DataFrame:
    """(session_date, path, bytes) of dated data files below `root`; contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    )
    dated = listed.where(_is_daily(_base_name(F.col("path")))).withColumn(
        "session_date", session_date_of(_base_name(F.col("path")))
    )
    return dated.where("session_date IS NOT NULL").select(
        "session_date", "path", F.col("length").alias("bytes")
    )


def repeated_sessions(files: DataFrame) -> DataFrame:
    """Session dates that more than one file claims; must be empty before reading."""
    return files.groupBy("session_date").agg(F.count_distinct("path").alias("files")).where("files > 1")


def arrival_order() -> Column:
    """Position of a row in its file, for use right after a file scan.

    Rows of one file split are read in order by one task, so (split start, running id) sorts as the file.
    """
    start = F.col("_metadata.file_block_start").cast("decimal(20,0)")
    within = F.monotonically_increasing_id().bitwiseAND(F.lit(2**33 - 1)).cast("decimal(10,0)")
    return (start * F.lit(10**10).cast("decimal(11,0)") + within).cast("decimal(31,0)")


#: Headers read at the same time.
READERS = 16


def header_lines(spark: SparkSession, paths: Sequence[str]) -> list[tuple[str, ...]]:
    """Column names of each CSV file. Spark takes one line for them, so a file of any size costs its first block's start;
    the small jobs of several files run side by side."""
    plain = lambda names: tuple(n.lstrip("\ufeff").strip() for n in names)
    with ThreadPoolExecutor(READERS) as pool:
        return list(pool.map(lambda path: plain(spark.read.option("header", True).csv(path).columns), paths))


def read_book_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Canonical book events of every daily file below `path`; two files of one session stop the read.

    Each file's own header names its columns: files are grouped by header, so one with its columns in another order is
    read by name. Side files are left out before any header is looked at. Everything is read as text and
    coerced, so bad cells become NULL instead of failing the scan. A gzip file is one task; sessions are spread again by
    the first shuffle that follows.
    """
    daily = discover_daily_files(spark, path)
    if twice := [str(r.session_date) for r in repeated_sessions(daily).limit(10).collect()]:
        raise ValueError(f"sessions with more than one file: {twice}")
    paths = sorted(r.path for r in daily.select("path").collect())  # one name a session
    if not paths:
        raise ValueError(f"no daily files below {path}")
    headers: dict[tuple[str, ...], list[str]] = {}
    for name, header in zip(paths, header_lines(spark, paths)):
        headers.setdefault(header, []).append(name)
    parts = []
    for header, files in sorted(headers.items()):
        names = list(header)
        wanted = columns or [*quality.required_columns(), *[c for c in ("symbol",) if c in names]]
        require_columns(names, [c for c in wanted if c != "symbol"], "book")
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
        rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(files)
        parts.append(rows.select(*wanted, arrival_order().alias("ingest_ord"), session_date_of(F.col("_metadata.file_name")).alias("session_date")))
    raw = parts[0]
    for more in parts[1:]:
        raw = raw.unionByName(more, allowMissingColumns=True)
    return quality.canonical_events(raw)


def require_columns(found: Sequence[str], wanted: Sequence[str], what: str, closed: bool = False) -> None:
    """Fails unless every wanted column is there, and no other one if the set is closed."""
    absent = [c for c in wanted if c not in found]
    surplus = [c for c in found if c not in wanted] if closed else []
    if absent or surplus:
        raise ValueError(f"{what} file: absent columns {absent}, surplus columns {surplus}")


def read_panel_csv(spark: SparkSession, path: str, with_target: bool = True) -> DataFrame:
    """Auction panel with its closed set of columns, plus `ingest_ord` and `source_file`.

    Without target the column is dropped before any action and pruned from the scan.
    """
    header = spark.read.option("header", True).csv(path).columns
    require_columns(header, PANEL_COLUMNS, "panel", closed=True)
    kinds = {"whole": T.LongType(), "text": T.StringType()}
    schema = T.StructType([T.StructField(c, kinds.get(PANEL_TYPES[c], T.DoubleType())) for c in header])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(path)
    kept = [c for c in PANEL_COLUMNS if with_target or c != "target"]
    return rows.select(
        *kept, arrival_order().alias("ingest_ord"), F.col("_metadata.file_name").alias("source_file")
    )


MEMBER = r"(?i)(train|test)(?:ing)?_Dst_.*_CF_(\d+)"  # fixed naming of matrix members


def member_of(path: Column) -> dict[str, Column]:
    """Fold number and split of a matrix file from its name."""
    return {
        "split": F.lower(F.regexp_extract(path, MEMBER, 1)),
        "fold": F.regexp_extract(path, MEMBER, 2).try_cast("int"),
    }


def read_matrix_text(
    spark: SparkSession, path: str, features: int = MATRIX_FEATURES, labels: int = MATRIX_LABELS
) -> DataFrame:
    """One row per observation from matrices stored with one line per feature.

    Line numbers come from the arrival order of a narrow (file, order) table that holds features +
    labels rows per file; the values are exploded, shuffled by (file, observation) and packed again.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        F.col("_metadata.file_path").alias("file"), arrival_order().alias("ord"), F.trim("value").alias("line")
    ).where("line <> ''")
    numbered = lines.groupBy("file").agg(F.collect_list("ord").alias("o")).select(
        "file", F.posexplode(F.array_sort("o")).alias("row", "ord")
    )
    cells = lines.join(numbered, ["file", "ord"]).select(
        "file", "row", F.posexplode(F.split("line", r"\s+")).alias("obs_id", "text")
    )
    value = F.struct("row", F.col("text").try_cast("double").alias("v"))
    packed = cells.groupBy("file", "obs_id").agg(
        F.transform(F.array_sort(F.collect_list(value)), lambda s: s["v"]).alias("column")
    )
    last = F.slice("column", features + 1, labels)
    return packed.select(
        "file",
        F.col("obs_id").cast("bigint").alias("obs_id"),
        *[c.alias(n) for n, c in member_of(F.col("file")).items()],
        F.size("column").alias("height"),
        F.transform(F.slice("column", 1, features), lambda v: v.cast("float")).alias("features"),
        F.transform(last, lambda v: v.cast("tinyint")).alias("labels"),
        F.exists(last, lambda v: v.isNull() | (v != F.floor(v))).alias("fractional_label"),
    )


def primary_label(row: int, labels: str = "labels") -> Column:
    """The registered horizon's label (one-based row of the label block)."""
    return F.element_at(labels, row).cast("int")


def unpaired_folds(members: DataFrame) -> DataFrame:
    """Folds that do not have exactly one train and one test file; must be empty."""
    files = members.select("fold", "split", "file").distinct()
    return (
        files.groupBy("fold")
        .agg(F.count_if(F.col("split") == "train").alias("train_files"), F.count_if(F.col("split") == "test").alias("test_files"))
        .where("train_files <> 1 OR test_files <> 1 OR fold IS NULL")
    )


def read_prepared(spark: SparkSession, path: str, split: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """Prepared rows; a split prunes partitions and columns prune the scan."""
    rows = spark.read.parquet(path)
    if split is not None:
        rows = rows.where(F.col("split") == split)
    return rows.select(*columns) if columns else rows


def read_cataloged(spark: SparkSession, path: str, catalog: DataFrame, split: str, keys: Sequence[str]) -> DataFrame:
    """Rows of one split, after its partitions have been compared with the catalog: each partition that is listed is
    there with as many rows, and no other one is. Counting reads no column but the keys, which are folder names."""
    rows = read_prepared(spark, path, split)
    keys = list(keys)
    listed = catalog.where(F.col("split") == split).select(*keys, F.col("rows").alias("_listed"))
    found = rows.groupBy(*keys).agg(F.count("*").alias("_found"))
    apart = listed.join(found, keys, "full").where("NOT (_listed <=> _found)").limit(10).collect()
    if apart:
        raise ValueError(f"partitions that differ from the catalog: {[r.asDict() for r in apart]}")
    return rows


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of a Parquet table without reading a column."""
    return spark.read.parquet(path).count()
