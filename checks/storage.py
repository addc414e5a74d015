"""Catalogs, projections and name rules of the storage layer over derived tables."""

from __future__ import annotations

import gzip
import uuid

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from checks.inputs import BOOK_SQL, PANEL_SQL, SESSION, SNAP_SQL, auction_panel, book_events, snapshots, table
from checks.shape import emit, sql
from checks.snapshot import MEMBERS_SQL, members
from tidebook.operators import blocks, quality
from tidebook.operators.panel_quality import PANEL_COLUMNS
from tidebook.operators.sessions import in_session, local_date, split_of
from tidebook.params import SplitRange
from tidebook.sources import files, sinks

QUERIES, SQL = {}, {}
SPLITS = [SplitRange("train", 0, 3), SplitRange("validation", 4, 4), SplitRange("holdout", 5, 9)]
SPLIT_SQL = "CASE WHEN date_id <= 3 THEN 'train' WHEN date_id <= 4 THEN 'validation' ELSE 'holdout' END"


def query(name, text=None):
    def add(fn):
        QUERIES[name] = fn
        if text is not None:
            SQL[name] = text
        return fn

    return add


def tagged(spark, sf):
    return auction_panel(spark, sf).withColumn("split", split_of(F.col("date_id"), SPLITS))


CATALOG_SQL = PANEL_SQL + f""", entries AS (SELECT {SPLIT_SQL} AS split, date_id, count(*) AS rows, count(target) AS target_rows FROM panel GROUP BY ALL),
totals AS (SELECT split, count(*) AS partitions, sum(rows) AS rows, sum(target_rows) AS target_rows, bool_and(target_rows > 0 AND target_rows <= rows) AS covered FROM entries GROUP BY 1)"""


@query("partition_catalog", sql(CATALOG_SQL, "split:s date_id:i rows:i target_rows:i", "entries"))
def partition_catalog(spark, sf):
    return emit(sinks.catalog(tagged(spark, sf), ["split", "date_id"], "target").drop("fingerprint"))


@query("partition_fingerprints")
def partition_fingerprints(spark, sf):
    return emit(sinks.catalog(tagged(spark, sf), ["split", "date_id"], "target"))


@query("split_totals", sql(CATALOG_SQL, "split:s partitions:i rows:i target_rows:i covered:b", "totals"))
def split_totals(spark, sf):
    return emit(sinks.split_totals(sinks.catalog(tagged(spark, sf), ["split", "date_id"], "target")))


@query(
    "catalog_comparison",
    sql(
        PANEL_SQL + """, old AS (SELECT date_id, count(*) AS n, sum(bid_size) AS s FROM panel WHERE date_id < 6 GROUP BY 1),
new AS (SELECT date_id, count(*) AS n, sum(CASE WHEN date_id = 2 AND seconds_in_bucket = 30 THEN bid_size + 1 ELSE bid_size END) AS s FROM panel WHERE date_id > 0 GROUP BY 1),
result AS (SELECT coalesce(o.date_id, n.date_id) AS date_id, CASE WHEN o.date_id IS NULL THEN 'added' WHEN n.date_id IS NULL THEN 'removed' WHEN o.n = n.n AND o.s = n.s THEN 'same' ELSE 'changed' END AS status
  FROM old o FULL JOIN new n ON o.date_id = n.date_id)""",
        "date_id:i status:s",
    ),
)
def catalog_comparison(spark, sf):
    before = auction_panel(spark, sf)
    edited = F.expr("CASE WHEN date_id = 2 AND seconds_in_bucket = 30 THEN bid_size + 1 ELSE bid_size END")
    after = before.withColumn("bid_size", edited)
    old = sinks.catalog(before.where("date_id < 6"), ["date_id"])
    new = sinks.catalog(after.where("date_id > 0"), ["date_id"])
    return emit(sinks.compare_catalogs(old, new, ["date_id"]))


@query(
    "unprocessed_sessions",
    """SELECT DISTINCT CAST(o_orderdate AS DATE)::VARCHAR AS session_date FROM orders WHERE CAST(o_orderdate AS DATE) NOT IN (SELECT CAST(l_shipdate AS DATE) FROM lineitem WHERE l_returnflag = 'A')""",
)
def unprocessed_sessions(spark, sf):
    wanted = table(spark, sf, "orders").select(F.to_date("o_orderdate").alias("session_date")).distinct()
    done = table(spark, sf, "lineitem").where("l_returnflag = 'A'").select(F.to_date("l_shipdate").alias("session_date"))
    return emit(sinks.not_yet_done(wanted, done.distinct(), ["session_date"]))


@query("compact_projection", sql(PANEL_SQL, "stock_id:i date_id:i seconds_in_bucket:i wap:d target:d", "panel"))
def compact_projection(spark, sf):
    return emit(sinks.compact(auction_panel(spark, sf), ["stock_id", "date_id", "seconds_in_bucket", "wap", "target"]))


@query("row_count", "SELECT count(*) AS rows FROM lineitem")
def row_count(spark, sf):
    return emit(spark.createDataFrame([(files.row_count(spark, f"{sf}/lineitem.parquet"),)], "rows long"))


def fresh_path(df, name):
    return f"{blocks.shared_folder(df).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@query(
    "prepared_train_rows",
    sql(
        PANEL_SQL + ", result AS (SELECT date_id, count(*) AS rows, sum(stock_id) AS stocks, count(target) AS targets FROM panel WHERE date_id <= 3 GROUP BY 1)",
        "date_id:i rows:i stocks:i targets:i",
    ),
)
def prepared_train_rows(spark, sf):
    """Written by split and date, one date written twice, one split read back."""
    rows = tagged(spark, sf)
    path = fresh_path(rows, "prepared")
    sinks.write_partitions(rows, path, ["split", "date_id"])
    sinks.write_partitions(rows.where("date_id = 2"), path, ["split", "date_id"])
    back = files.read_prepared(spark, path, "train", ["date_id", "stock_id", "target"])
    return emit(back.groupBy("date_id").agg(F.count("*").alias("rows"), F.sum("stock_id").alias("stocks"), F.count("target").alias("targets")))


@query(
    "table_formats",
    sql(PANEL_SQL + ", result AS (SELECT date_id, count(*) AS rows, sum(seconds_in_bucket) AS seconds FROM panel GROUP BY 1)", "date_id:i rows:i seconds:i"),
)
def table_formats(spark, sf):
    """One table through compressed text, plain text and Parquet in turn."""
    rows = sinks.compact(auction_panel(spark, sf), ["date_id", "seconds_in_bucket"])
    for kind in ("csv.gz", "csv", "parquet"):
        path = fresh_path(rows, "format")
        sinks.write_table(rows, path, kind)
        rows = files.read_prepared(spark, path) if kind == "parquet" else spark.read.schema(rows.schema).option("header", True).csv(path)
    return emit(rows.groupBy("date_id").agg(F.count("*").alias("rows"), F.sum("seconds_in_bucket").alias("seconds")))


NAMES = "('book_' || CASE WHEN event_id % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y%m%d') END || CASE event_type WHEN 'error' THEN '_definition.csv' WHEN 'signup' THEN '.txt' ELSE '.csv.gz' END)"


@query(
    "daily_file_names",
    f"""SELECT day AS session_date, count(*) AS files FROM (SELECT strftime(ts, '%Y-%m-%d') AS day, {NAMES} AS name FROM events)
        WHERE name LIKE '%.csv.gz' GROUP BY 1""",
)
def daily_file_names(spark, sf):
    form = F.when(F.col("event_id") % 2 == 0, F.date_format("ts", "yyyy-MM-dd")).otherwise(F.date_format("ts", "yyyyMMdd"))
    tail = F.when(F.col("event_type") == "error", "_definition.csv").when(F.col("event_type") == "signup", ".txt").otherwise(".csv.gz")
    names = table(spark, sf, "events").select(F.concat(F.lit("book_"), form, tail).alias("name"))
    daily = names.where(files._is_daily(F.col("name")))
    return emit(daily.groupBy(files.session_date_of(F.col("name")).alias("session_date")).agg(F.count("*").alias("files")))


@query(
    "primary_labels",
    sql(SNAP_SQL + ", result AS (SELECT labels[3] AS label, count(*) AS rows FROM snap GROUP BY 1)", "label:i rows:i"),
)
def primary_labels(spark, sf):
    return emit(
        snapshots(spark, sf).groupBy(files.primary_label(3).alias("label")).agg(F.count("*").alias("rows"))
    )


# --- Text written and read again -------------------------------------------------------------------

PIECE = 200  # observations of a matrix line that are written at a time


def text_files(rows, by, order, name_of, text_of, folder):
    """One text file for each key in the shared folder; returns the number of files.

    Rows are dealt by key, sorted by `order` and written batch by batch, so Python holds a batch of a file and not the file.
    name_of(key) names it; text_of(rows, last) is the text of the next rows, `last` the row before them (None: the first).
    """

    def write(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        current, last, out, plain = None, None, None, None
        for pdf in batches:
            for key, part in pdf.groupby(by, sort=False, dropna=False):
                if out is None or str(key) != str(current):
                    for stream in (out, plain) if out is not None else ():
                        stream.close()
                    name = name_of(key)
                    plain = store.open_output_stream(f"{root}/{name}", compression=None)
                    out, current, last = gzip.GzipFile(fileobj=plain, mode="wb") if name.endswith(".gz") else plain, key, None
                    yield pd.DataFrame({"name": [name]})
                out.write(text_of(part, last).encode())
                last = part.iloc[-1]
        for stream in (out, plain) if out is not None else ():
            stream.close()

    tasks = max(-(-rows.count() // blocks.ROWS_PER_TASK), rows.sparkSession.sparkContext.defaultParallelism)
    return rows.repartition(tasks, *by).sortWithinPartitions(*by, *order).mapInPandas(write, "name string").count()


BOOK_TEXT_SQL = BOOK_SQL + """, utc AS (SELECT *, strftime(ts, '%Y-%m-%d') AS day FROM book),
result AS (SELECT day AS session_date, count(*) AS rows, sum(sequence) AS sequences, sum(size) AS size, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns,
    sum(bid_px[1]) AS bid, sum(ask_px[10]) AS ask, sum(bid_sz[10]) AS depth, count_if(action = 'T') AS trades FROM utc GROUP BY day)"""


@query("book_csv_round_trip", sql(BOOK_TEXT_SQL, "session_date:s rows:i sequences:i size:d first_ns:i last_ns:i bid:d ask:d depth:d trades:i"))
def book_csv_round_trip(spark, sf):
    """A file a day, every second one compressed, every third one with its columns in another order, next to side files."""
    base = book_events(spark, sf)
    ladders = {"bid_px": "bid_px", "ask_px": "ask_px", "bid_sz": "bid_sz", "ask_sz": "ask_sz", "bid_ct": "bid_sz", "ask_ct": "ask_sz"}
    stamp = lambda c: F.concat(F.date_format(F.timestamp_micros(F.expr(f"{c} div 1000")), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("000Z"))
    wide = base.select(
        stamp("ts_ns").alias("ts_recv"), stamp("ts_event_ns").alias("ts_event"), "action", "side", "sequence", F.element_at("bid_px", 1).alias("price"), "size", "symbol",
        *[F.element_at(ladders[c.rsplit("_", 1)[0]], int(c.rsplit("_", 1)[1]) + 1).alias(c) for c in quality.required_columns()[7:]],
    )

    number = lambda day: int(day.replace("-", ""))

    def text_of(pdf, last):
        turned = number(pdf["_day"].iloc[0]) % 3 == 0
        pdf = pdf.drop(columns="_day")
        return (pdf[pdf.columns[::-1]] if turned else pdf).to_csv(index=False, header=last is None)

    folder = fresh_path(wide, "book-text")
    dated = wide.withColumn("_day", F.substring("ts_recv", 1, 10))
    text_files(dated, ["_day"], ["sequence"], lambda key: f"book-{key[0]}.csv" + (".gz" if number(key[0]) % 2 else ""), text_of, folder)
    text_files(wide.limit(1), ["symbol"], [], lambda key: "book-2024-01-01_definition.csv", lambda pdf, last: "not,a,book\n", folder)
    back = files.read_book_csv(spark, folder)
    return emit(
        back.groupBy("session_date").agg(
            F.count("*").alias("rows"), F.sum("sequence").alias("sequences"), F.sum("size").alias("size"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"),
            F.sum(F.element_at("bid_px", 1)).alias("bid"), F.sum(F.element_at("ask_px", 10)).alias("ask"), F.sum(F.element_at("bid_sz", 10)).alias("depth"), F.count_if(F.col("action") == "T").alias("trades"),
        )
    )


@query(
    "panel_csv_round_trip",
    sql(
        PANEL_SQL + """, result AS (SELECT date_id, count(*) AS rows, sum(target) AS target, sum(stock_id) AS stocks, count(near_price) AS near, sum(wap) AS wap, 0 AS hidden FROM panel GROUP BY 1)""",
        "date_id:i rows:i target:d stocks:i near:i wap:d hidden:i", places=4,
    ),
)
def panel_csv_round_trip(spark, sf):
    """The closed panel schema with its target, and without (hidden counts target columns of the blind scan)."""
    rows = auction_panel(spark, sf)
    path = fresh_path(rows, "panel-text")
    sinks.write_table(rows.select(*PANEL_COLUMNS), path, "csv")
    whole, blind = files.read_panel_csv(spark, path), files.read_panel_csv(spark, path, with_target=False)
    hidden = sum(c == "target" for c in blind.columns)
    waps = blind.groupBy("date_id").agg(F.sum("wap").alias("wap"))
    rest = whole.groupBy("date_id").agg(F.count("*").alias("rows"), F.sum("target").alias("target"), F.sum("stock_id").alias("stocks"), F.count("near_price").alias("near"))
    return emit(rest.join(waps, "date_id").withColumn("hidden", F.lit(hidden)), 4)


@query(
    "matrix_text_round_trip",
    sql(
        MEMBERS_SQL + """, result AS (SELECT fold, split, count(*) AS rows, sum(labels[1]) AS first_label, sum(labels[5]) AS last_label, sum(features[1]::DOUBLE) AS first_feature, sum(features[64]::DOUBLE) AS last_feature, 69 AS height FROM members GROUP BY ALL)""",
        "fold:i split:s rows:i first_label:i last_label:i first_feature:d last_feature:d height:i", places=4,
    ),
)
def matrix_text_round_trip(spark, sf):
    """A transposed text file per fold and split, named by both, read back as observations."""
    rows = members(spark, sf).select("fold", "split", "obs_id", "features", "labels")

    def pieces(pdf):
        pdf = pdf.sort_values("obs_id")
        values = np.vstack([np.stack(pdf["features"].to_numpy()).astype(np.float32).T.astype(object), np.stack(pdf["labels"].to_numpy()).astype(int).T.astype(object)])
        first = pdf.iloc[0]
        return pd.DataFrame({"fold": first["fold"], "split": first["split"], "line": range(len(values)), "piece": first["piece"], "text": ["  ".join(map(str, line)) for line in values]})

    def text_of(pdf, last):
        """Pieces of one line are two spaces apart, and a line ends where the next one begins."""
        before = pdf["line"].shift(fill_value=pdf["line"].iloc[0] if last is None else last["line"])
        apart = np.where(pdf["line"] != before, "\n", "  ")
        if last is None:
            apart[0] = ""
        return "".join(a + t for a, t in zip(apart, pdf["text"]))

    kind = lambda split: "Train" if split == "train" else "Test"
    cut = rows.withColumn("piece", F.expr(f"obs_id div {PIECE}"))
    lines = cut.groupBy("fold", "split", "piece").applyInPandas(pieces, "fold int, split string, line int, piece long, text string")
    folder = fresh_path(rows, "matrix-text")
    text_files(blocks.settled(lines), ["fold", "split"], ["line", "piece"], lambda key: f"{kind(key[1])}_Dst_NoAuction_ZScore_CF_{key[0]}.txt", text_of, folder)
    back = files.read_matrix_text(spark, folder, features=64, labels=5)
    value = lambda c, i: F.sum(F.element_at(c, i).cast("double"))
    return emit(
        back.groupBy("fold", "split").agg(
            F.count("*").alias("rows"), F.sum(F.element_at("labels", 1)).alias("first_label"), F.sum(F.element_at("labels", 5)).alias("last_label"),
            value("features", 1).alias("first_feature"), value("features", 64).alias("last_feature"), F.max("height").alias("height"),
        ), 4,
    )


@query(
    "session_batch",
    sql(
        BOOK_SQL + """, result AS (SELECT CASE WHEN session_date <= DATE '2024-01-15' THEN 'train' WHEN session_date <= DATE '2024-01-22' THEN 'validation' ELSE 'holdout' END AS split, session_date, count(*) AS rows, sum(sequence) AS sequences
  FROM sess WHERE session_date BETWEEN DATE '2024-01-01' AND DATE '2024-01-31' GROUP BY ALL)""",
        "split:s session_date:s rows:i sequences:i",
    ),
)
def session_batch(spark, sf):
    """All sessions in two runs: the first sees the earlier half of them, and an attempt that died has left a wrong folder
    for a session that only the second commits. What is read back has been compared with the catalog."""
    events = book_events(spark, sf)
    dated = events.withColumn("session_date", local_date("ts_ns", SESSION.zone).cast("string"))
    splits = [SplitRange("train", "2024-01-01", "2024-01-15"), SplitRange("validation", "2024-01-16", "2024-01-22"), SplitRange("holdout", "2024-01-23", "2024-01-31")]
    split, path = split_of(F.col("session_date"), splits), fresh_path(events, "batch")
    process = lambda rows: in_session(rows.drop("session_date"), SESSION).select("session_date", "symbol", "sequence", "ts_ns", "size")
    sinks.process_sessions(dated.where("session_date <= '2024-01-12'"), path, process, split)
    left = process(dated.where("session_date = '2024-01-18'")).withColumns({"split": F.lit("validation"), "size": F.lit(-1)})
    sinks.write_partitions(left, f"{path}/sessions", ["split", "session_date"])
    listed = sinks.process_sessions(dated, path, process, split)
    parts = [files.read_cataloged(spark, f"{path}/sessions", listed.where("rows > 0"), s.name, ["session_date"]) for s in splits]
    back = parts[0].unionByName(parts[1]).unionByName(parts[2]).where("size > 0")
    return emit(back.groupBy("split", F.col("session_date").cast("string").alias("session_date")).agg(F.count("*").alias("rows"), F.sum("sequence").alias("sequences")))
