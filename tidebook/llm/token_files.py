"""Token ids of documents in binary files: written in id order by tasks, read back block by block.

A file holds whole documents; their ids stand one after another, cut into blocks that mixing.py codes each by itself.
Layout, integers little-endian: MAGIC; blocks; the footer, deflated: number of documents (u64), of blocks (u64), tokens
of each document (u64 each), document ids (i64 each, 0 where there is none) and flags (u8, 1 where there is one), bytes
of each block (u64 each); then bytes of the footer (u64), its CRC-32 (u32) and MAGIC.
"""

from __future__ import annotations

import functools
import os
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidebook.llm import mixing
from tidebook.llm.scratch import stored

MAGIC, END = b"TKID\x02\r\n\x00", struct.Struct("<QI8s")
#: Blocks coded side by side, ids after which a task begins its next file, and bytes of text tokenised at once.
TOGETHER, FILE_IDS, TEXTS = 128, 1 << 24, 1 << 24
#: Distinct chunks of text whose ids a worker remembers, new ones given to the library as one text, and stops that part a word from what follows.
MEMORY, JOINED = 1 << 20, 1 << 10
STOPS = b".,;:!?"
#: Bytes whose borders are looked for at once, and those beside them that may matter.
NEAR, BESIDE = 1 << 17, 4


class Chunks:
    """Ids of texts by a byte-level tokenizers file. Texts are cut where its pre-tokens always end: before a single space
    or line end between two plain characters (printing ASCII, or others below U+0800 that no white space is among), after
    such a line end, and between a letter and a stop. A chunk that comes again isn't encoded again; chunks beyond MEMORY
    are encoded whenever they come. New chunks are joined where they would be cut again, and a token's bytes say to
    which chunk it belongs."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        tokens = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes = np.zeros(max(tokens.values()) + 1, np.int64)
        self.bytes[list(tokens.values())] = [len(t) for t in tokens]  # a character of a token's name is a byte
        self.words, self.ids, self.ends = pa.array([], pa.large_string()), np.zeros(0, np.uint32), np.zeros(1, np.int64)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each text) of an array of strings without nulls."""
        texts = texts.cast(pa.large_string())
        _, offsets, data = texts.buffers()
        offsets = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        if offsets[-1] == offsets[0]:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
        borders = self.borders(np.frombuffer(data, np.uint8)[: offsets[-1]], offsets)
        pieces = pa.Array.from_buffers(pa.large_string(), len(borders) - 1, [None, pa.py_buffer(borders), data])
        at = pc.fill_null(pc.index_in(pieces, value_set=self.words), -1).to_numpy(zero_copy_only=False).astype(np.int32)
        missing, all_ids, all_ends = at < 0, self.ids, self.ends
        if missing.any():
            new = pieces.filter(pa.array(missing)).dictionary_encode()
            at[missing] = len(self.words) + new.indices.to_numpy()
            found, lengths = self.encoded(new.dictionary)
            all_ids, all_ends = np.concatenate([self.ids, found]), np.concatenate([self.ends, self.ends[-1] + np.cumsum(lengths)])
            kept = min(MEMORY, int(np.searchsorted(all_ends, 8 * MEMORY, "right")) - 1)
            if kept > len(self.words):
                self.words = pa.concat_arrays([self.words, new.dictionary.slice(0, kept - len(self.words))])
                self.ids, self.ends = all_ids[: all_ends[kept]], all_ends[: kept + 1]
        lengths = np.diff(all_ends).take(at)
        ends = np.cumsum(lengths)
        ids = all_ids.take(np.repeat(all_ends.take(at) - (ends - lengths), lengths) + np.arange(ends[-1]))
        return ids, np.diff(np.concatenate([[0], ends])[np.searchsorted(borders, offsets)])

    @staticmethod
    def plain(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a plain character begins, and where one ends."""
        ascii, lead = raw - np.uint8(33) < 94, raw - np.uint8(0xC3) < 29
        ends = ascii.copy()
        ends[1:] |= lead[:-1]
        return ascii | lead, ends

    @classmethod
    def borders(cls, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        cut = np.zeros(len(raw) + 1, bool)
        for start in range(int(offsets[0]), len(raw), NEAR):  # few bytes at once stay in the processor's cache
            first, end = max(int(offsets[0]), start - BESIDE), min(len(raw), start + NEAR)
            cut[start:end] = cls.cuts(raw[first : end + BESIDE])[start - first : end - first]
        cut[offsets] = True
        return np.flatnonzero(cut).astype(np.int64)

    @classmethod
    def cuts(cls, raw: np.ndarray) -> np.ndarray:
        """Before which bytes a chunk begins, as far as the bytes given say it."""
        cut = np.zeros(len(raw), bool)
        begins, ends = cls.plain(raw)
        letter = (raw | 32) - np.uint8(97) < 26
        letter[1:] |= (raw[:-1] == 0xC3) & (raw[1:] != 0x97) & (raw[1:] != 0xB7)  # U+00C0 to U+00FF without two signs
        line = raw[1:-1] == 10
        white = ((raw[1:-1] == 32) | line) & ends[:-2] & begins[2:]
        cut[1:-1] |= white
        cut[2:] |= white & line
        stop = np.zeros(len(raw), bool)
        for s in STOPS:
            stop |= raw == s
        cut[1:] |= letter[:-1] & stop[1:]
        return cut

    def encoded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, number of ids of each) of chunks, none of them empty. Those that begin with a single space follow one
        another, those that begin with a plain character are parted by line ends, any others stay alone."""
        _, offsets, data = words.buffers()
        offsets = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1]
        raw = np.frombuffer(data, np.uint8)[: offsets[-1]]
        begins, ends = self.plain(raw)
        first, last = offsets[:-1], offsets[1:] - 1
        spaced = (raw[first] == 32) & begins[np.minimum(first + 1, last)] & ends[last]
        lined = begins[first] & ends[last]
        parts = [self.joined(words, np.flatnonzero(spaced), ""), self.joined(words, np.flatnonzero(lined), "\n")]
        parts.append(self.alone(words, np.flatnonzero(~spaced & ~lined)))
        rows, ids, lengths = (np.concatenate(x) for x in zip(*parts, strict=True))
        starts, order = np.cumsum(lengths) - lengths, np.argsort(rows)
        starts, lengths = starts[order], lengths[order]
        return ids[np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(len(ids))], lengths

    def joined(self, words: pa.Array, rows: np.ndarray, between: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, counts = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)]
        for i in range(0, len(rows), 16 * JOINED):
            several = [words.take(pa.array(rows[j : j + JOINED])) for j in range(i, min(len(rows), i + 16 * JOINED), JOINED)]
            texts = [between.join(w.to_pylist()) if between else self.text(w) for w in several]
            for w, encoding in zip(several, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
                ids = np.array(encoding.ids, np.uint32)
                upto = np.cumsum(self.bytes[ids])
                ends = np.cumsum(pc.binary_length(w).to_numpy() + len(between)) - len(between)
                after = np.searchsorted(upto, ends) + 1  # ids up to the end of each chunk
                if after[-1] != len(ids) or not np.array_equal(upto[after - 1], ends):
                    raise ValueError("a token of the library goes beyond a chunk")
                keep = np.ones(len(ids), bool)
                if between:
                    keep[after[:-1]] = False
                found.append(ids[keep])
                counts.append(np.diff(after, prepend=0) - np.minimum(np.arange(len(w)), len(between)))
        return rows, np.concatenate(found), np.concatenate(counts)

    @staticmethod
    def text(words: pa.Array) -> str:
        """All of them in a row, as they stand in memory."""
        _, offsets, data = words.buffers()
        first, last = np.frombuffer(offsets, np.int64)[[words.offset, words.offset + len(words)]]
        return str(memoryview(data)[first:last], "utf-8")

    def alone(self, words: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        found, lengths = [np.zeros(0, np.uint32)], []
        for i in range(0, len(rows), 4 * JOINED):
            for encoding in self.tokenizer.encode_batch_fast(words.take(pa.array(rows[i : i + 4 * JOINED])).to_pylist(), add_special_tokens=False):
                found.append(np.array(encoding.ids, np.uint32))
                lengths.append(len(found[-1]))
        return rows, np.concatenate(found), np.array(lengths, np.int64)


@functools.lru_cache(2)
def chunks(path: str) -> Chunks:
    """Kept by the worker from task to task."""
    return Chunks(path)


def slices(texts: pa.Array, size: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, rows) of about size bytes, one row at least."""
    lengths = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(lengths, (lengths[first - 1] if first else 0) + size, "right")))
        yield first, texts.slice(first, last - first)
        first = last


class Writer:
    """One file, under a name of its own until it is whole; memory holds the ids of TOGETHER blocks and one text's."""

    def __init__(self, store: fs.FileSystem, root: str, name: str, attempt: int):
        self.store, self.made, self.path = store, f"{root}/.{name}.{attempt}", f"{root}/{name}"
        self.out = store.open_output_stream(self.made, compression=None)
        self.out.write(MAGIC)
        self.rest: list[np.ndarray] = []
        self.held, self.docs, self.tokens, self.blocks = 0, [], [], []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.tokens.append(len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        if self.held >= TOGETHER * mixing.BLOCK:
            self.flush(last=False)

    def flush(self, last: bool) -> None:
        ids = np.concatenate(self.rest) if self.rest else np.zeros(0, np.uint32)
        upto = len(ids) if last else len(ids) // mixing.BLOCK * mixing.BLOCK
        blocks = [ids[i : min(upto, i + mixing.BLOCK)] for i in range(0, upto, mixing.BLOCK)]
        for i in range(0, len(blocks), TOGETHER):
            for raw in mixing.encode(blocks[i : i + TOGETHER]):
                self.out.write(raw)
                self.blocks.append(len(raw))
        self.rest, self.held = [ids[upto:]], len(ids) - upto

    def close(self) -> tuple[int, int, int]:
        """(documents, ids, bytes) of the file. One that an earlier attempt left is replaced."""
        self.flush(last=True)
        present = np.array([d is not None for d in self.docs], np.uint8)
        known = np.array([d or 0 for d in self.docs], "<i8")
        footer = struct.pack("<QQ", len(self.docs), len(self.blocks)) + np.array(self.tokens, "<u8").tobytes() + known.tobytes() + present.tobytes() + np.array(self.blocks, "<u8").tobytes()
        footer = zlib.compress(footer, 6)
        self.out.write(footer + END.pack(len(footer), zlib.crc32(footer), MAGIC))
        size = self.out.tell()
        self.out.close()
        if self.store.get_file_info(self.path).type != fs.FileType.NotFound:
            self.store.delete_file(self.path)
        self.store.move(self.made, self.path)
        return len(self.docs), int(sum(self.tokens)), size


class Reader:
    """A file's documents without their ids, and its blocks."""

    def __init__(self, store: fs.FileSystem, path: str):
        self.path, self.file = path, store.open_input_file(path)
        size = self.file.size()
        head, tail = self.file.read_at(len(MAGIC), 0), self.file.read_at(END.size, max(0, size - END.size))
        length, check, magic = END.unpack(tail) if len(tail) == END.size else (0, 0, b"")
        footer = self.file.read_at(length, max(0, size - END.size - length)) if magic == MAGIC else b""
        if head != MAGIC or magic != MAGIC or zlib.crc32(footer) != check:
            raise ValueError(f"{path} is no whole token file")
        footer = zlib.decompress(footer)
        docs, blocks = struct.unpack_from("<QQ", footer)
        self.tokens = np.frombuffer(footer, "<u8", docs, 16).astype(np.int64)
        known, present = np.frombuffer(footer, "<i8", docs, 16 + 8 * docs), np.frombuffer(footer, np.uint8, docs, 16 + 16 * docs)
        self.docs = pa.array(known, pa.int64(), mask=present == 0)
        self.ends = len(MAGIC) + np.cumsum(np.frombuffer(footer, "<u8", blocks, 16 + 17 * docs).astype(np.int64))

    def blocks(self, first: int = 0, last: int | None = None) -> Iterator[np.ndarray]:
        """The ids of blocks first to last, decoded TOGETHER at a time."""
        last = len(self.ends) if last is None else min(last, len(self.ends))
        for i in range(first, last, TOGETHER):
            ends = self.ends[i : min(i + TOGETHER, last)]
            start = int(self.ends[i - 1]) if i else len(MAGIC)
            raw = self.file.read_at(int(ends[-1]) - start, start)
            yield from mixing.decode([raw[a:b] for a, b in zip([0, *(ends[:-1] - start)], ends - start, strict=True)])

    def document(self, nth: int) -> np.ndarray:
        """The ids of one document; only the blocks that hold it are decoded."""
        start = int(self.tokens[:nth].sum())
        end = start + int(self.tokens[nth])
        first, last = start // mixing.BLOCK, -(-end // mixing.BLOCK)
        return np.concatenate([np.zeros(0, np.uint32), *self.blocks(first, last)])[start - first * mixing.BLOCK : end - first * mixing.BLOCK]

    def checksums(self) -> tuple[np.ndarray, int]:
        """CRC-32 of each document's ids as little-endian u32, and the number of ids in all blocks."""
        ends = np.cumsum(self.tokens)
        sums, doc, total = np.zeros(len(ends), np.int64), 0, 0
        for block in self.blocks():
            raw, start = memoryview(block.astype("<u4").tobytes()), total
            total += len(block)
            while doc < len(ends):
                a, b = max(start, int(ends[doc] - self.tokens[doc])), min(total, int(ends[doc]))
                sums[doc] = zlib.crc32(raw[4 * (a - start) : 4 * (b - start)], int(sums[doc])) if b > a else sums[doc]
                if ends[doc] > total:
                    break
                doc += 1
        return sums, total


def write_files(docs: DataFrame, folder: str, coder: Callable[[], Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]], end_id: int, id_col: str = "doc_id", text_col: str = "text", file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of every text, and end_id after each, into files of about file_ids ids and returns one row a file:
    (part, nth, file, documents, ids, bytes); read in order of (part, nth) the documents ascend by id.

    coder makes, once in a task, a function from an array of texts to (all ids, ids of each text). Nulls are empty
    texts. Rows without an id come first; rows that share an id are ordered by a hash of the text, and equal rows are
    told apart by their place in the input, so that any number of them spreads over tasks.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("place"))
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        encode, done, out, held = coder(), [], None, 0
        for batch in batches:
            keys = batch.column("id")
            for first, texts in slices(batch.column("text"), TEXTS):
                ids, lengths = encode(texts)
                ends = np.cumsum(lengths)
                for k, (length, end) in enumerate(zip(lengths, ends, strict=True)):
                    if out is None:
                        out, held = Writer(store, root, f"part-{task.partitionId():06d}-{len(done):04d}.ids", task.taskAttemptId()), 0
                    out.add(keys[first + k].as_py(), np.append(ids[end - length : end], end_id).astype(np.uint32))
                    held += int(length) + 1
                    if held >= file_ids:
                        done.append((out.path.rpartition("/")[2], *out.close()))
                        out = None
        if out is not None:
            done.append((out.path.rpartition("/")[2], *out.close()))
        columns = list(zip(*done, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [pa.array([task.partitionId()] * len(done), pa.int32()), pa.array(range(len(done)), pa.int32()), pa.array(columns[0], pa.string()), *(pa.array(c, pa.int64()) for c in columns[1:])],
            ["part", "nth", "file", "documents", "ids", "bytes"],
        )

    ordered = rows.repartitionByRange(F.asc_nulls_first("id"), "hash", "place").sortWithinPartitions(F.asc_nulls_first("id"), "hash").select("id", "text")
    return stored(ordered.mapInArrow(run, "part int, nth int, file string, documents long, ids long, bytes long"), "token-files")


def read_files(files: DataFrame, folder: str) -> DataFrame:
    """(id, start, n_tokens, ids_crc32) of every document in the files: start counts the ids of all documents before it,
    the checksum is taken over the decoded ids. A damaged file or block stops the job.

    Only the totals of parts, one row for each task that wrote, pass through the driver.
    """
    spark = files.sparkSession
    totals = sorted((r.part, r.total) for r in files.groupBy("part").agg(F.sum("ids").alias("total")).collect())
    bases = dict(zip([p for p, _ in totals], np.cumsum([0, *(t for _, t in totals)]).tolist(), strict=False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        part, base = None, 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["part"] != part:
                    part, base = row["part"], bases[row["part"]]
                reader = Reader(store, f"{root}/{row['file']}")
                sums, total = reader.checksums()
                if total != row["ids"] or total != reader.tokens.sum():
                    raise ValueError(f"{row['file']} doesn't hold the ids that its index names")
                starts = base + np.cumsum(reader.tokens) - reader.tokens
                base += total
                yield pa.RecordBatch.from_arrays([reader.docs, pa.array(starts), pa.array(reader.tokens), pa.array(sums)], ["id", "start", "n_tokens", "ids_crc32"])

    if not totals:
        return spark.createDataFrame([], "id long, start long, n_tokens long, ids_crc32 long")
    placed = files.select("part", "nth", "file", "ids").repartitionByRange(len(totals), "part").sortWithinPartitions("part", "nth")
    return placed.mapInArrow(run, "id long, start long, n_tokens long, ids_crc32 long")
