"""WARC archives: exact round trips, one member a record, damaged files."""

import gzip
import zlib
from pathlib import Path

import pytest

from tidebook.llm import warc


def pages():
    rows = [(i, f"http://h/{i}?q=ä b", f"<p>{i % 7}</p>" * (i % 5)) for i in range(60)]
    return rows + [(100, None, None), (101, "bad\r\nWARC-Type: x", ""), (5, "again", "<p>5</p>"), (102, "long", "é\r\n\r\n" * 400_000), (None, "no id", "<p>5</p>"), (103, "x", "WARC/1.1\r\n\r\n")]


def expected(rows):
    first = {}
    for i, _, h in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    out = []
    for i, u, h in rows:
        raw, f = (h or "").encode(), first.get(h or "")
        out.append((i, u, len(raw), warc.base32_sha1(raw), *(("response", None, raw) if f is None or f == i else ("revisit", f, None))))
    return sorted(out, key=repr)


@pytest.mark.parametrize("archive_bytes", [1 << 30, 2000])
def test_round_trip(spark, tmp_path, archive_bytes):
    rows = pages()
    table = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, digest string, first int").repartition(3)
    written = warc.write_archives(table, f"file://{tmp_path}/whole", archive_bytes=archive_bytes).collect()
    assert sum(r.records for r in written) == len(rows)
    for r in written:  # a single member each
        engine = zlib.decompressobj(warc.GZIP)
        engine.decompress(Path(tmp_path, "whole", r.archive).read_bytes())
        assert engine.eof and not engine.unused_data
    names = [r.archive for r in written]
    warc.normalise(spark, f"file://{tmp_path}/whole", f"{tmp_path}/members", names)
    index = warc.read_index(spark, f"{tmp_path}/members")
    for r in index.collect():
        raw = Path(tmp_path, "members", r.archive).read_bytes()[r.offset : r.offset + r.length]
        engine = zlib.decompressobj(warc.GZIP)
        assert engine.decompress(raw).startswith(b"WARC/1.1\r\nWARC-Type: " + r.record_type.encode()) and engine.eof and not engine.unused_data
    for name in names:
        assert gzip.decompress(Path(tmp_path, "whole", name).read_bytes()) == gzip.decompress(Path(tmp_path, "members", name).read_bytes())
    got = sorted(((*r[:6], None if r[6] is None else bytes(r[6])) for r in warc.read_records(index, f"{tmp_path}/members", 3).collect()), key=repr)
    assert got == expected(rows)


def test_normalising_twice_and_members_as_input(spark, tmp_path):
    table = spark.createDataFrame([(1, "u", "x"), (2, "u", "y")], "page_id long, url string, html string").coalesce(1)
    names = [r.archive for r in warc.write_archives(table, f"{tmp_path}/whole").collect()]
    first = warc.normalise(spark, f"{tmp_path}/whole", f"{tmp_path}/members", names, drop_source=True).collect()
    assert not list(Path(tmp_path, "whole").glob("*.gz"))
    assert warc.normalise(spark, f"{tmp_path}/whole", f"{tmp_path}/members", names, drop_source=True).collect() == first
    assert warc.normalise(spark, f"{tmp_path}/members", f"{tmp_path}/again", names).collect() == first


def test_damaged_archives_stop_the_job(spark, tmp_path):
    good = gzip.compress(warc.record(1, "u", b"payload" * 1000, None, "2000-01-01T00:00:00Z"))
    for k, raw in enumerate((good[:-20], gzip.compress(b"no warc\r\n\r\n"), gzip.compress(gzip.decompress(good)[:-50]))):
        Path(tmp_path, f"{k}.warc.gz").write_bytes(raw)
        with pytest.raises(Exception, match="early|not a WARC"):
            warc.normalise(spark, str(tmp_path), f"{tmp_path}/out{k}", [f"{k}.warc.gz"])


def test_no_pages(spark, tmp_path):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path)).collect() == []
