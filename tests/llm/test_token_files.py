"""Token files: blocks against their ids, ids against the tokenizers library, damage, and files against plain counting."""

import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyarrow import fs
from tokenizers import Tokenizer

from tidebook.llm import mixing, token_files

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = ["", " ", "  two  spaces ", "a b", "a  b\tc \n d", "it's <|endoftext|> here", "café au lait 　 x", "  a b", "x" * 5000, "ab " * 3000, "\U0001f600 \U0001f600", "1 2 33 ! ?? a'll"]


TOKENIZER = Tokenizer.from_file(PATH)
TOKENIZER.encode_special_tokens = True
CHUNKS = token_files.Chunks(PATH)


def library(texts):
    return [e.ids for e in TOKENIZER.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=25, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 5), max_size=700), max_size=5))
def test_blocks_come_back(blocks):
    blocks = [np.array(b, np.uint32) for b in blocks]
    assert all(np.array_equal(a, b) for a, b in zip(mixing.decode(mixing.encode(blocks)), blocks, strict=True))


def test_blocks_of_all_kinds_and_each_by_itself():
    draw = np.random.default_rng(5)
    text = np.array(sum(library(["the cat sat on the mat and the dog lay by the door " * 300]), []), np.uint32)
    blocks = [np.arange(mixing.BLOCK), np.zeros(mixing.BLOCK), draw.integers(0, 50_000, mixing.BLOCK), draw.zipf(1.3, 30_000) % 50_000, text]
    blocks = [np.asarray(b).astype(np.uint32) for b in blocks]
    together = mixing.encode(blocks)
    assert [mixing.encode([b])[0] for b in blocks] == together  # what is coded beside a block doesn't change it
    assert all(np.array_equal(mixing.decode([raw])[0], b) for raw, b in zip(together, blocks, strict=True))
    assert len(together[4]) < len(text) / 3 and len(together[1]) < 6000


def test_order_two_helps():
    """Ids that the two before decide, and one before does not, cost less than half of what order 0 would give them."""
    draw = np.random.default_rng(6)
    ids = [1, 2]
    while len(ids) < 60_000:
        ids.append((ids[-1] * 7 + ids[-2] * 13 + int(draw.random() < 0.02)) % 64)
    assert 8 * len(mixing.encode([np.array(ids, np.uint32)])[0]) / len(ids) < 3


def test_damage_is_found():
    raw = bytearray(mixing.encode([np.arange(500, dtype=np.uint32)])[0])
    for at in (0, 5, 20, len(raw) // 2, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 4
        with pytest.raises(ValueError):
            mixing.decode([bytes(bad)])


def test_chunks_equal_the_library():
    for texts in (ODD, ODD[::-1], [""], []):
        ids, lengths = CHUNKS.encode(pa.array(texts, pa.string()))
        expected = library(texts)
        assert lengths.tolist() == [len(x) for x in expected] and ids.tolist() == sum(expected, [])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab'st 1!,.\n\té 　\x1c\x85", max_size=40), max_size=4))
def test_chunks_equal_the_library_on_any_text(texts):
    ids, lengths = CHUNKS.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == sum(library(texts), []) and lengths.tolist() == [len(x) for x in library(texts)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text("ab's ,.!\n\u00e9\u00d7\u00f7\u00ff\u00aa\u00a0\u0301\u0663\u07ff\u0800\u2009", max_size=40), max_size=4))
def test_chunks_equal_the_library_beyond_ascii(texts):
    ids, lengths = CHUNKS.encode(pa.array(texts, pa.string()))
    assert ids.tolist() == sum(library(texts), []) and lengths.tolist() == [len(x) for x in library(texts)]


def test_borders_do_not_depend_on_how_many_bytes_are_seen(monkeypatch):
    texts = pa.array(["a\u00e9 b\n\u00e9,\u00d7.", "", " c\u00a0 d \u00ff!\nx"] * 40, pa.large_string())
    offsets, raw = (np.frombuffer(b, t) for b, t in zip(texts.buffers()[1:], (np.int64, np.uint8), strict=True))
    offsets, raw = offsets[: len(texts) + 1], raw[: offsets[len(texts)]]
    whole = CHUNKS.borders(raw, offsets).tolist()
    for near in (1, 2, 5, 64):
        monkeypatch.setattr(token_files, "NEAR", near)
        assert CHUNKS.borders(raw, offsets).tolist() == whole
        assert CHUNKS.borders(raw, offsets[7:]).tolist() == [b for b in whole if b >= offsets[7]]


def test_new_chunks_are_given_to_the_library_together():
    """Words that no text had before, with and without a space, accents and stops: a few strings, not one a word."""
    chunks, given = token_files.Chunks(PATH), []

    class Counted:
        def encode_batch_fast(self, texts, **options):
            given.extend(texts)
            return TOKENIZER.encode_batch_fast(texts, **options)

    chunks.tokenizer = Counted()
    texts = [f"w{k} \u00e9t\u00e9{k} x{k}\u00f1, {k}\nLine{k} end" for k in range(3000)]
    ids, lengths = chunks.encode(pa.array(texts))
    assert ids.tolist() == sum(library(texts), []) and lengths.tolist() == [len(x) for x in library(texts)]
    assert len(given) < 50


def expected(rows):
    out, start = [], 0
    ids = library([t or "" for _, t in rows])
    for (doc_id, _), found in sorted(zip(rows, ids, strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
        found = [*found, 0]
        out.append((doc_id, start, len(found), zlib.crc32(struct.pack(f"<{len(found)}I", *found))))
        start += len(found)
    return out


@pytest.mark.parametrize("file_ids", [50, 1 << 24])
def test_files_equal_plain_counting(spark, tmp_path, file_ids):
    rows = [(k * 3 - 20, t) for k, t in enumerate(ODD)] + [(None, "no id"), (500, None), (501, "long word by word " * 20_000), (502, "")]
    table = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, hash string").repartition(5)
    files = token_files.write_files(table, f"file://{tmp_path}/ids", lambda: token_files.Chunks(PATH).encode, 0, file_ids=file_ids)
    found = sorted(map(tuple, token_files.read_files(files, f"file://{tmp_path}/ids").collect()), key=lambda r: r[1])
    assert found == expected(rows)
    listed = files.orderBy("part", "nth").collect()
    assert (len(listed) > 4) == (file_ids == 50) and sum(r.documents for r in listed) == len(rows)
    store, root = fs.FileSystem.from_uri(f"file://{tmp_path}/ids")
    reader = token_files.Reader(store, f"{root}/{listed[-1].file}")
    texts = dict(rows)
    assert [reader.document(k).tolist() for k in range(len(reader.docs))] == [[*library([texts[d.as_py()] or ""])[0], 0] for d in reader.docs]
    with open(reader.path, "r+b") as file:  # a lost byte stops the job
        file.truncate(reader.file.size() - 1)
    with pytest.raises(Exception, match="token file"):
        token_files.read_files(files, f"file://{tmp_path}/ids").collect()


def test_repeats_and_no_rows(spark, tmp_path):
    rows = [(7, "same text")] * 40 + [(7, "other")] * 3
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    files = token_files.write_files(table, f"file://{tmp_path}/a", lambda: token_files.Chunks(PATH).encode, 0)
    found = token_files.read_files(files, f"file://{tmp_path}/a").collect()
    ends = {r.start + r.n_tokens for r in found}
    assert len(found) == 43 and {r.start for r in found} == {0} | ends - {max(ends)} and len({r.ids_crc32 for r in found}) == 2
    empty = token_files.write_files(table.where("false"), f"file://{tmp_path}/b", lambda: token_files.Chunks(PATH).encode, 0)
    assert token_files.read_files(empty, f"file://{tmp_path}/b").collect() == []
