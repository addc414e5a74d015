"""WARC archives: writing whole-file gzip streams, normalising them to one member a record with a sidecar index, reading back.

Archives live in a folder that every executor reaches by its URI. A task writes under a name of its own and renames the
file when it is whole, so a task that runs twice leaves one file. Records are streamed; memory doesn't grow with a file.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm.scratch import stored

LEVEL = 5
#: Bytes read at once, text bytes after which a task begins its next archive, and compressed bytes that one task reads back.
BLOCK, ARCHIVE, SPAN = 1 << 20, 1 << 30, 8 << 20
GZIP = 16 + zlib.MAX_WBITS
PAGE_URN = "urn:x-page:"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
#: Fixed value: the standard's name for a revisit of an equal payload.
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "archive string, offset long, length long, record_type string, record_id string"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One record; a revisit keeps the HTTP head, which states the full payload's length, and leaves the payload out."""
    name = lambda i: f"<{PAGE_URN}{'' if i is None else i}>"
    head = HTTP.format(len(payload)).encode()
    body = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", quote(url, safe="!#$&'()*+,/:;=?@[]~-._")))
    if refers_to is not None:
        fields += [("WARC-Profile", SAME_PAYLOAD), ("WARC-Refers-To", name(refers_to))]
    fields += [("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + body + b"\r\n\r\n"


def with_first(pages: DataFrame, id_col: str, url_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """id, url, payload and refers_to: the least id with the same payload, null where that is the row itself, where the
    payload is below least_bytes or where no id is known.

    Only digests that repeat are joined. They are counted and written first, so Spark knows the size of that side: it
    is broadcast below Spark's threshold and shuffled with the pages beyond it.
    """
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    digests = rows.where(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    repeated = stored(digests.where("n > 1 AND first IS NOT NULL").select("digest", "first"), "repeated")
    return rows.join(repeated, "digest", "left").select("id", "url", "payload", F.when(~F.col("id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder)


def committed(store: fs.FileSystem, made: str, name: str) -> None:
    """Renames a whole file; one that an earlier attempt left is replaced."""
    if store.get_file_info(name).type != fs.FileType.NotFound:
        store.delete_file(name)
    store.move(made, name)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", level: int = LEVEL, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes every page as a record into archives of one gzip stream each and returns (archive, records, bytes).

    Null html is an empty payload, a null url leaves the field out, a null id leaves the record's name empty. Of pages
    with equal payloads of least_bytes or more the smallest id is the response and the others revisit it; rows that
    share this id are all responses. Ids are whole numbers.
    """
    rows = with_first(pages, id_col, url_col, html_col, least_bytes)
    store, root = opened(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = opened(folder)
        done, out = [], None
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(c) for c in ("id", "url", "payload", "refers_to")), strict=True):
                if out is None:
                    name = f"part-{task.partitionId():05d}-{len(done):03d}.warc.gz"
                    made, packer, n, size = f"{root}/.{name}.{task.taskAttemptId()}", zlib.compressobj(level, zlib.DEFLATED, GZIP), 0, 0
                    out = store.open_output_stream(made, compression=None)
                raw = record(page_id.as_py(), url.as_py(), payload.as_py(), refers_to.as_py(), date)
                out.write(packer.compress(raw))
                n, size = n + 1, size + len(raw)
                if size >= archive_bytes:
                    out.write(packer.flush())
                    out.close()
                    committed(store, made, f"{root}/{name}")
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            committed(store, made, f"{root}/{name}")
            done.append((name, n, size))
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], kind) for i, kind in ((0, pa.string()), (1, pa.int64()), (2, pa.int64()))], ["archive", "records", "bytes"])

    return stored(rows.mapInArrow(run, "archive string, records long, bytes long"), "archives")


def inflated(source) -> Iterator[bytes]:
    """Plain bytes of a gzip file of one or many members."""
    engine, fresh = zlib.decompressobj(GZIP), True
    while data := source.read(BLOCK):
        while data:
            if engine.eof:
                engine, fresh = zlib.decompressobj(GZIP), True
            if fresh and not data.strip(b"\x00"):
                break
            fresh = False
            if plain := engine.decompress(data, BLOCK):
                yield plain
            data = engine.unused_data if engine.eof else engine.unconsumed_tail
    if not fresh and not engine.eof:
        raise ValueError("the gzip stream ends early")


class Plain:
    """Reads records from pieces of plain bytes."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held = pieces, b""

    def more(self) -> bool:
        piece = next(self.pieces, None)
        if piece is None:
            return False
        self.held += piece
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Up to and with the mark; None at the end of the input."""
        searched = 0
        while (at := self.held.find(mark, searched)) < 0:
            searched = max(0, len(self.held) - len(mark))
            if not self.more():
                if self.held.strip():
                    raise ValueError("a record's head ends early")
                return None
        found, self.held = self.held[: at + len(mark)], self.held[at + len(mark) :]
        return found

    def exactly(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.held and not self.more():
                raise ValueError("a record ends early")
            piece, self.held = self.held[:n], self.held[n:]
            n -= len(piece)
            yield piece


def head_fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").strip().split("\r\n")
    if not re.fullmatch(r"WARC/\d+\.\d+", lines[0]):
        raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def normalise(spark: SparkSession, folder: str, target: str, archives: list[str], level: int = LEVEL, drop_source: bool = False) -> DataFrame:
    """Inflates each archive of folder once, as one stream, and writes it to target with every record as a gzip member of
    its own, beside a sidecar `<archive>.idx` of offset, length, type and id of the members. Returns (archive, records,
    bytes). An archive that is cut off or no WARC stops the job.

    One task for each archive. An archive whose normalised file and sidecar are in place is left alone, so a task that
    runs again after its source went (drop_source) finds its work done.
    """
    store, root = opened(target)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        store, root = opened(target)
        here, base = opened(folder)
        for batch in batches:
            for i in batch.column("id").to_pylist():
                name = archives[i]
                final, sidecar = f"{root}/{name}", f"{root}/{name}.idx"
                if store.get_file_info(sidecar).type == fs.FileType.NotFound:
                    made = f"{root}/.{name}.{attempt}"
                    rewritten(here, f"{base}/{name}", store, made, name, level)
                    committed(store, made, final)
                    committed(store, f"{made}.idx", sidecar)  # last: it says that the archive is whole
                if drop_source and here.get_file_info(f"{base}/{name}").type != fs.FileType.NotFound:
                    here.delete_file(f"{base}/{name}")
                with store.open_input_stream(sidecar, compression=None) as lines:
                    n = lines.read().count(b"\n")
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64()), pa.array([store.get_file_info(final).size], pa.int64())], ["archive", "records", "bytes"])

    n = len(archives)
    tasks = spark.range(0, n, 1, max(n, 1))
    return stored(tasks.mapInArrow(run, "archive string, records long, bytes long"), "normalised")


def rewritten(here: fs.FileSystem, source: str, store: fs.FileSystem, made: str, name: str, level: int) -> None:
    with here.open_input_stream(source, compression=None) as packed, store.open_output_stream(made, compression=None) as out, store.open_output_stream(f"{made}.idx", compression=None) as index:
        plain, offset = Plain(inflated(packed)), 0
        while (head := plain.until(b"\r\n\r\n")) is not None:
            head = head.lstrip(b"\r\n")
            fields, packer = head_fields(head), zlib.compressobj(level, zlib.DEFLATED, GZIP)
            for piece in (head, *plain.exactly(int(fields["content-length"])), *plain.exactly(4)):
                out.write(packer.compress(piece))
            out.write(packer.flush())
            now = out.tell()
            index.write("\t".join([name, str(offset), str(now - offset), fields.get("warc-type", ""), fields.get("warc-record-id", "")]).encode() + b"\n")
            offset = now


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """All sidecars of a folder: archive, offset, length, record_type, record_id."""
    return spark.read.schema(INDEX).option("sep", "\t").option("quote", "").csv(f"{target}/*.idx")


def read_records(index: DataFrame, target: str, spans: int) -> DataFrame:
    """Fetches the members that the index rows name: page_id, url, payload_bytes, payload_digest, record_type, refers_to
    and payload (null for a revisit). A payload that doesn't have its digest stops the job.

    Only index rows are shuffled, in file order, so each of the spans reads neighbouring members.
    """

    def number(name: str | None) -> int | None:
        text = (name or "").strip("<>").removeprefix(PAGE_URN)
        return int(text) if text else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = opened(target)
        name, source = None, None
        for batch in batches:
            rows, held = [], 0
            for archive, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if archive != name:
                    if source:
                        source.close()
                    name, source = archive, store.open_input_file(f"{root}/{archive}")
                source.seek(offset)
                head, _, body = zlib.decompress(source.read(length), GZIP).partition(b"\r\n\r\n")
                fields = head_fields(head)
                http, _, payload = body[: int(fields["content-length"])].partition(b"\r\n\r\n")
                digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                if kind == "response" and base32_sha1(payload) != digest:
                    raise ValueError(f"{archive} at {offset}: the payload doesn't have the digest {digest}")
                size = int(re.search(rb"(?i)\ncontent-length:\s*(\d+)", http)[1])
                url = fields.get("warc-target-uri")
                rows.append((number(fields["warc-record-id"]), None if url is None else unquote(url), size, digest, kind, number(fields.get("warc-refers-to")), payload if kind == "response" else None))
                held += len(payload)
                if held >= 8 * BLOCK:
                    yield as_batch(rows)
                    rows, held = [], 0
            if rows:
                yield as_batch(rows)
        if source:
            source.close()

    ordered = index.select("archive", "offset", "length").repartitionByRange(max(1, spans), "archive", "offset").sortWithinPartitions("archive", "offset")
    return ordered.mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")


def as_batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names)


def archived(pages: DataFrame, folder: str, least_bytes: int = 0, drop_source: bool = True, **columns: str) -> DataFrame:
    """Writes pages to whole-file streams, normalises these and reads the result back through the sidecar index."""
    spark = pages.sparkSession
    written = write_archives(pages, f"{folder}/whole", least_bytes=least_bytes, **columns)
    names = sorted(r.archive for r in written.select("archive").collect())  # one name for each archive of up to 1 GiB
    done = normalise(spark, f"{folder}/whole", f"{folder}/members", names, drop_source=drop_source)
    size = done.agg(F.sum("bytes")).first()[0] or 0
    if not names:
        return read_records(spark.createDataFrame([], INDEX), f"{folder}/members", 1)
    return read_records(read_index(spark, f"{folder}/members"), f"{folder}/members", -(-size // SPAN))
