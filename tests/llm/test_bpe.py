"""Byte-level BPE against the tiktoken library and by round trips."""

import hashlib
import random
import unicodedata
from pathlib import Path

import public_tokenizers
import pytest
import tiktoken

from tidebook.llm import bpe

PATTERN = public_tokenizers.PATTERN
RANKS = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
CODE = bpe.coder(RANKS, PATTERN)
LIBRARY = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=CODE.ranks, special_tokens={})

ODD = ["", " ", "\n\n  x", "it's we'll'd", "<|endoftext|>", "a" * 5000, " " * 3000 + "x", "é ñ 日本語 🙂🙂", "12 345", "  x", "'" * 50, "tab\t\tend \n"]


def texts():
    draw = random.Random(5)
    parts = ["the", " of", "'s", "'re", " ", "  ", "\n", "12", "%%", "é", "日本", "🙂", "\t", "'", "word" * 30]
    return ODD + ["".join(draw.choice(parts) for _ in range(draw.randint(1, 400))) for _ in range(150)]


def test_every_character_is_matched_as_the_library_does():
    wrong = []
    for point in range(0x110000):
        c = chr(point)
        if unicodedata.category(c) in ("Cn", "Cs", "Co") or 0x3400 <= point <= 0xD7A3 or 0x17000 <= point <= 0x18CFF or 0x20000 <= point:
            continue
        text = f"a{c}a 1{c}1{c}{c} x"
        if CODE.encode(text).tolist() != LIBRARY.encode_ordinary(text):
            wrong.append(point)
    assert wrong == []


def test_texts_equal_the_library():
    for text in texts():
        assert CODE.encode(text).tolist() == LIBRARY.encode_ordinary(text)


@pytest.mark.parametrize(("chunk", "overlap"), [(40, 12), (64, 30), (1000, 8)])
def test_stitched_chunks_equal_the_library(chunk, overlap):
    for text in texts():
        starts = range(0, max(1, len(text) - overlap), chunk)
        chunks = [(s, len(text[s : s + chunk + overlap]), *CODE.encode_spans(text[s : s + chunk + overlap], s)) for s in starts]
        assert bpe.stitched(chunks, CODE).tolist() == LIBRARY.encode_ordinary(text)


def test_operator_on_odd_rows(spark):
    rows = [(i, t, "clash", i) for i, t in enumerate(texts())] + [(None, "no id", "x", 1), (3, None, "x", 1), (3, "again", None, None), (3, "again", None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, id string, ids int").repartition(3)
    encoded = bpe.encode(docs.drop("id", "ids"), RANKS, PATTERN, chunk=300, overlap=20)
    clashing = bpe.encode(docs, RANKS, PATTERN, chunk=300, overlap=20)
    key = lambda t: sorted((r.id is None, r.id or 0, list(r.ids)) for r in t.collect())
    assert key(encoded) == key(clashing) == sorted((i is None, i or 0, LIBRARY.encode_ordinary(t or "")) for i, t, *_ in rows)
    fused = bpe.encode(docs, RANKS, PATTERN, chunk=300, overlap=20, decoded=True)
    assert sorted(bpe.digests(fused, RANKS, PATTERN).collect(), key=repr) == sorted(bpe.digests(encoded, RANKS, PATTERN).collect(), key=repr)
    out = {(r.id, r.decoded_sha256): r for r in bpe.digests(encoded, RANKS, PATTERN).collect()}
    for i, t, *_ in rows:
        row, ids = out[i, hashlib.sha256((t or "").encode()).hexdigest()], LIBRARY.encode_ordinary(t or "")
        assert (row.n_tokens, row.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.digests(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN).collect() == []
