"""Byte-level BPE by overlapping chunks.

A text longer than a chunk is cut into chunks that overlap; each is pre-tokenised and encoded in a task of its own. Where
the pre-token boundaries of two neighbours meet in their overlap, both read on alike, for a match depends only on what
stands to its right; there the chunks are stitched. Neighbours that never meet (a pre-token longer than the overlap) are
read again as one. Texts of one chunk need no stitching and no shuffle. Decoding concatenates the tokens' bytes.
"""

from __future__ import annotations

import base64
import functools
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a chunk, and of the part that it shares with the next.
CHUNK, OVERLAP = 1 << 16, 512
#: The end of a chunk can change how this many last characters are matched (the longest contraction less one, and one more to look at).
UNSURE = 3
#: Ids that one batch of results holds before it is handed on, and pieces that a task remembers.
BATCH_IDS, MEMORY = 1 << 20, 1 << 17


class Pieces(dict):
    """Ids of the first pieces seen, which hold the frequent ones; long and later pieces are encoded but not kept."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode(piece.encode())
        if len(piece) <= 64 and len(self) < MEMORY:
            self[piece] = ids
        return ids


class Coder:
    """Splits, encodes and decodes by one rank file and one pattern."""

    def __init__(self, ranks: bytes, pattern: str):
        self.ranks, self.pattern = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in ranks.splitlines() if line)}, pattern
        self.match = regex.compile(pattern)
        self.tokens = np.full(max(self.ranks.values()) + 1, None, object)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token

    @functools.cached_property
    def pieces(self) -> Pieces:
        """Made where texts are encoded only."""
        return Pieces(tiktoken.Encoding("ranks", pat_str=self.pattern, mergeable_ranks=self.ranks, special_tokens={})._core_bpe.encode_single_piece)

    def encode(self, text: str) -> np.ndarray:
        return np.fromiter(chain.from_iterable(map(self.pieces.__getitem__, self.match.findall(text))), np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.tokens[ids].tolist())

    def encode_spans(self, text: str, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First character (counted from the whole text's start) and number of ids of each pre-token, and all ids."""
        found = self.match.findall(text)
        ids = [self.pieces[p] for p in found]
        ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
        return start + ends - np.fromiter(map(len, found), np.int64, len(found)), np.fromiter(map(len, ids), np.int32, len(ids)), np.fromiter(chain.from_iterable(ids), np.int32)


@functools.lru_cache(maxsize=4)
def coder(ranks: bytes, pattern: str) -> Coder:
    return Coder(ranks, pattern)


def list_array(parts: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    offsets = np.zeros(len(parts) + 1, np.int32)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    flat = np.concatenate(parts) if parts else np.zeros(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, kind))


def stitched(chunks: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]], code: Coder) -> np.ndarray:
    """Ids of a whole text from its chunks' (start, length, starts of pre-tokens, ids of each, ids), in order."""
    out: list[np.ndarray] = []
    start, length, at, n, ids = chunks[0]
    begin = start
    for nxt_start, nxt_length, nxt_at, nxt_n, nxt_ids in chunks[1:]:
        end = start + length
        meet = np.intersect1d(at[(at >= max(begin, nxt_start)) & (at <= end - UNSURE)], nxt_at, assume_unique=True)
        if len(meet):
            out.append(ids[np.repeat((at >= begin) & (at < meet[0]), n)])
            begin, start, length, at, n, ids = meet[0], nxt_start, nxt_length, nxt_at, nxt_n, nxt_ids
            continue
        # the two have no boundary in common: read them again as one text, from the last boundary that is known
        first = code.decode(ids[np.repeat(at >= begin, n)]).decode()
        second = code.decode(nxt_ids).decode()[end - nxt_start :]
        at, n, ids = code.encode_spans(first + second, begin)
        start, length = begin, nxt_start + nxt_length - begin
    out.append(ids[np.repeat(at >= begin, n)])
    return np.concatenate(out)


def encode(docs: DataFrame, ranks: bytes, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP, decoded: bool = False) -> DataFrame:
    """id and ids (array of int) of every row's whole text, and on request the bytes that the ids decode to, joined in
    the same task, which spares a second Python worker. A null or empty text has no ids; rows that share an id or a
    text are encoded one by one; other columns are left behind.

    Only texts above one chunk are shuffled: their chunks to be encoded in parallel, then the ids to be stitched.
    The rank file goes to the tasks with the code; its size is that of the vocabulary.
    """
    if overlap <= UNSURE or chunk <= overlap:
        raise ValueError("the overlap must be longer than what a chunk's end leaves unsure, and shorter than the chunk")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    id_type = rows.schema["id"].dataType.simpleString()

    names = ["id", "ids", *["bytes"] * decoded]
    kind = f"id {id_type}, ids array<int>" + ", bytes binary" * decoded

    def results(code: Coder, parts: list[np.ndarray]) -> list[pa.Array]:
        return [list_array(parts, pa.int32()), *[pa.array([code.decode(p) for p in parts], pa.binary())] * decoded]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value, pattern)
        for batch in batches:
            done, parts, n = 0, [], 0
            for i, text in enumerate(batch.column("text")):
                parts.append(code.encode(text.as_py()))
                n += len(parts[-1])
                if n >= BATCH_IDS or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("id").slice(done, len(parts)), *results(code, parts)], names)
                    done, parts, n = i + 1, [], 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, key, text in zip(batch.column("row"), batch.column("id"), batch.column("text"), strict=True):
                whole_text = text.as_py()
                for no, start in enumerate(range(0, max(1, len(whole_text) - overlap), chunk)):
                    piece = whole_text[start : start + chunk + overlap]
                    yield pa.RecordBatch.from_arrays([pa.array([row.as_py()], pa.int64()), pa.array([key.as_py()], batch.column("id").type), pa.array([no], pa.int32()), pa.array([start], pa.int64()), pa.array([piece])], ["row", "id", "no", "start", "piece"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value, pattern)
        for batch in batches:
            for i in range(batch.num_rows):
                start, piece = batch.column("start")[i].as_py(), batch.column("piece")[i].as_py()
                at, n, ids = code.encode_spans(piece, start)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(c).slice(i, 1) for c in ("row", "id", "no", "start")] + [pa.array([len(piece)], pa.int64()), list_array([at], pa.int64()), list_array([n], pa.int32()), list_array([ids], pa.int32())],
                    ["row", "id", "no", "start", "length", "at", "n", "ids"],
                )

    def stitch(table: pa.Table) -> pa.Table:
        table = table.sort_by("no").combine_chunks()
        get = lambda c, i: table.column(c)[i].values.to_numpy()
        chunks = [(table.column("start")[i].as_py(), table.column("length")[i].as_py(), get("at", i), get("n", i), get("ids", i)) for i in range(table.num_rows)]
        code = coder(shared.value, pattern)
        return pa.table([table.column("id").slice(0, 1), *results(code, [stitched(chunks, code)])], names)

    one, many = rows.where(F.length("text") <= chunk), rows.where(F.length("text") > chunk)
    short = one.mapInArrow(whole, kind)
    chunks = many.withColumn("row", F.monotonically_increasing_id()).mapInArrow(cut, f"row long, id {id_type}, no int, start long, piece string")
    parts = chunks.repartition("row", "no").mapInArrow(pieces, f"row long, id {id_type}, no int, start long, length long, at array<long>, n array<int>, ids array<int>")
    return short.unionByName(parts.groupBy("row").applyInArrow(stitch, kind))


def decode(encoded: DataFrame, ranks: bytes, pattern: str, ids_col: str = "ids", bytes_col: str = "bytes") -> DataFrame:
    """Puts the concatenated bytes of the ids in their place; no ids give no bytes, null ids give null. An id that the
    vocabulary doesn't have stops the job."""
    shared = encoded.sparkSession.sparkContext.broadcast(ranks)
    kept = [c for c in encoded.columns if c != ids_col]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema if f.name != ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = coder(shared.value, pattern)
        for batch in batches:
            texts = [None if ids.as_py() is None else code.decode(ids.values.to_numpy()) for ids in batch.column(ids_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.binary())], [*kept, bytes_col])

    return encoded.mapInArrow(run, f"{kinds}, `{bytes_col}` binary")


def digests(encoded: DataFrame, ranks: bytes, pattern: str) -> DataFrame:
    """id, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 of an encoded table, which is decoded
    here unless it has its bytes."""
    rest = ["bytes"] if "bytes" in encoded.columns else ["ids"]
    counted = encoded.select("id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), *rest)
    return (counted if rest == ["bytes"] else decode(counted, ranks, pattern)).select("id", "n_tokens", "ids_sha256", F.sha2("bytes", 256).alias("decoded_sha256"))
