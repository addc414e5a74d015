import gzip

import pytest
from pyspark.sql import functions as F

from checks import storage
from tests.test_book import event
from tidebook.operators import panel_quality, quality
from tidebook.sources import files, sinks


def book_rows(count):
    names, rows = quality.required_columns(), []
    for i in range(count):
        _, _, seq, action, side, size, bid_px, bid_sz, ask_px, ask_sz = event(i)
        stamp = f"2026-03-16T13:35:{i // 50:02d}.{(i % 50) * 20:03d}000001Z"
        levels = [v for l in range(10) for v in (bid_px[l], ask_px[l], bid_sz[l], ask_sz[l], 1, 1)]
        rows.append([stamp, stamp, action, side, seq, bid_px[0], size, *levels])
    return names, rows


def test_book_csv_round_trip(spark, tmp_path):
    names, rows = book_rows(30)
    rows[4][7] = "oops"  # best bid of one row
    day = tmp_path / "raw" / "deep"
    day.mkdir(parents=True)
    text = "\n".join(",".join(map(str, r)) for r in [names, *rows])
    (day / "es_2026-03-16.csv").write_text(text)
    (day / "es_2026-03-16_definition.csv").write_text(text)
    found = files.discover_daily_files(spark, str(tmp_path / "raw")).collect()
    assert [str(r["session_date"]) for r in found] == ["2026-03-16"]
    got = files.read_book_csv(spark, str(tmp_path / "raw")).orderBy("ingest_ord").collect()
    assert len(got) == 30 and [r["sequence"] for r in got] == list(range(1, 31))
    assert got[1]["ts_ns"] % 1000 == 1 and got[4]["bid_px"][0] is None and got[5]["bid_px"][0] is not None
    assert str(got[0]["session_date"]) == "2026-03-16"
    (tmp_path / "raw" / "copy_20260316.csv").write_text(text)
    twice = files.repeated_sessions(files.discover_daily_files(spark, str(tmp_path / "raw"))).collect()
    assert [r["files"] for r in twice] == [2]


def test_arrival_order_holds_across_splits(spark, tmp_path):
    (tmp_path / "x.csv").write_text("n\n" + "\n".join(str(i) for i in range(3000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        rows = spark.read.option("header", True).csv(str(tmp_path)).select(F.col("n").cast("int"), files.arrival_order().alias("o"))
        assert rows.rdd.getNumPartitions() > 3
        assert [r["n"] for r in rows.orderBy("o").collect()] == list(range(3000))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_file_name_dates(spark):
    names = ["a_2026-03-16.csv", "b20260317.csv.gz", "c_120260318.csv", "none.csv", "d_2026-13-45.csv"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] and str(r[0]) for r in df.select(files.session_date_of(F.col("n"))).collect()]
    assert got == ["2026-03-16", "2026-03-17", None, None, None]


def test_matrix_text_is_transposed(spark, tmp_path):
    width, height, folder = 9, 5, tmp_path / "m"
    folder.mkdir()
    for fold, split in ((1, "Train"), (1, "Test"), (2, "Train")):
        lines = [" ".join(str(r * 100 + c + 0.5) for c in range(width)) for r in range(height)]
        lines += [" ".join(str((r + c) % 3 + 1) for c in range(width)) for r in range(2)]
        (folder / f"{split}_Dst_Set_CF_{fold}.txt").write_text("\n".join("   " + l for l in lines) + "\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "120")
    try:
        rows = files.read_matrix_text(spark, str(folder), height, 2)
        got = rows.where("fold = 1 AND split = 'test'").orderBy("obs_id").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["obs_id"] for r in got] == list(range(width))
    assert got[3]["features"] == [r * 100 + 3.5 for r in range(height)]
    assert got[3]["labels"] == [1, 2] and got[3]["height"] == 7 and not got[3]["fractional_label"]
    assert [r["fold"] for r in files.unpaired_folds(rows).collect()] == [2]
    checks = panel_quality.snapshot_checks(rows, ["fold", "split"], height).collect()
    assert all(r["observations"] == width and r["bad_width"] == r["bad_labels"] == 0 for r in checks)


def test_panel_csv_has_a_closed_header(spark, tmp_path):
    columns = list(panel_quality.PANEL_COLUMNS)
    values = ["1", "0", "10", "5", "1", "10", "7", "", "", "9", "4", "11", "4", "10", "2.5", "1", "0_10_1"]
    (tmp_path / "ok.csv").write_text(",".join(columns) + "\n" + ",".join(values) + "\n")
    row = files.read_panel_csv(spark, str(tmp_path / "ok.csv")).first()
    assert row["target"] == 2.5 and row["near_price"] is None and row["row_id"] == "0_10_1"
    blind = files.read_panel_csv(spark, str(tmp_path / "ok.csv"), with_target=False)
    assert "target" not in blind.columns
    (tmp_path / "bad.csv").write_text(",".join([*columns, "extra"]) + "\n")
    with pytest.raises(ValueError, match="surplus"):
        files.read_panel_csv(spark, str(tmp_path / "bad.csv"))


def test_partition_writes_replace_only_their_own(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.range(100).selectExpr("id", "id % 4 AS date_id", "CASE WHEN id % 4 < 2 THEN 'train' ELSE 'holdout' END AS split")
    sinks.write_partitions(df, path, ["split", "date_id"])
    sinks.write_partitions(df.where("date_id = 1").withColumn("id", F.col("id") + 1000), path, ["split", "date_id"])
    back = files.read_prepared(spark, path)
    assert back.count() == 100 == files.row_count(spark, path)
    assert back.where("id >= 1000").count() == 25
    assert files.read_prepared(spark, path, "train", ["id"]).columns == ["id"]
    old = sinks.catalog(df.select("id", "date_id"), ["date_id"])
    new = sinks.catalog(back.select("id", "date_id"), ["date_id"])
    got = {r["date_id"]: r["status"] for r in sinks.compare_catalogs(old, new, ["date_id"]).collect()}
    assert got == {0: "same", 1: "changed", 2: "same", 3: "same"}
    assert files_hash_lengths(spark, path) == {64}


def files_hash_lengths(spark, path):
    return {len(r["sha256"]) for r in sinks.file_hashes(spark, path).collect()}


@pytest.mark.parametrize("kind", ["parquet", "csv", "csv.gz"])
def test_table_formats(spark, tmp_path, kind):
    sinks.write_table(spark.range(5), str(tmp_path / "o"), kind)
    reader = spark.read.parquet if kind == "parquet" else spark.read.option("header", True).csv
    assert reader(str(tmp_path / "o")).count() == 5


def test_book_files_are_read_by_their_own_headers(spark, tmp_path):
    names = quality.required_columns()
    cell = lambda c, day: f"2026-01-0{day}T15:00:00Z" if c.startswith("ts_") else "T" if c in ("action", "side") else str(100 + day) if c == "bid_px_00" else "1"
    for day, order in ((5, names), (6, names[::-1])):
        lines = [",".join(order), ",".join(cell(c, day) for c in order)]
        (tmp_path / f"book-2026-01-0{day}.csv").write_text("\n".join(lines) + "\n")
    (tmp_path / "a-definition-20260105.csv").write_text("x,y\n" + "1,2\n" * 5000)
    got = {str(r.session_date): r.bid_px[0] for r in files.read_book_csv(spark, str(tmp_path)).collect()}
    assert got == {"2026-01-05": 105.0, "2026-01-06": 106.0}
    (tmp_path / "again-20260106.csv").write_text(",".join(names) + "\n")
    with pytest.raises(ValueError, match="more than one file"):
        files.read_book_csv(spark, str(tmp_path))


def test_text_is_written_batch_by_batch(spark, tmp_path):
    """Python never holds more of a file than a batch, and the pieces stand in order."""
    rows = spark.range(1000).selectExpr("id % 3 AS k", "999 - id AS at")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")

    def text_of(pdf, last):
        if len(pdf) > 50:
            raise ValueError(f"{len(pdf)} rows at once")
        return "".join(f"{at}\n" for at in pdf["at"])

    name = lambda key: f"{key[0]}.txt" + (".gz" if key[0] == 1 else "")
    try:
        assert storage.text_files(rows, ["k"], ["at"], name, text_of, tmp_path.as_uri()) == 3
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for k in range(3):
        got = (gzip.decompress((tmp_path / "1.txt.gz").read_bytes()) if k == 1 else (tmp_path / f"{k}.txt").read_bytes()).decode()
        assert got == "".join(f"{at}\n" for at in sorted(999 - i for i in range(1000) if i % 3 == k))
