"""Licence scan by canonical digest: a text and each of its lines are brought to one spelling, hashed whole, and
joined by hash to the digests of known licence texts."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Licence identifiers and the texts they stand for.
KNOWN = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above "
        "copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH "
        "REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, "
        "DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above "
        "copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS "
        "IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR "
        "PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN "
        "ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
]

# Spellings that licence texts use for one another.
SPELLINGS = [
    ("licence", "license"),
    ("licenced", "licensed"),
    ("sublicence", "sublicense"),
    ("noncommercial", "nc"),
    ("attribution", "by"),
    ("authorisation", "authorization"),
    ("favour", "favor"),
    ("organisation", "organization"),
    ("whilst", "while"),
    ("wilful", "willful"),
]

#: A line that names an owner and nothing else: comment marks, then the word or sign for copyright and a year, a name or the sign.
COPYRIGHT = r"^[^\p{L}\p{N}(©]*(?:copyright\s*(?:\(c\)|©|[0-9]{4}|:|by )|\(c\)|©|all rights reserved)"
APART = r"[^\p{L}\p{N}]+"

OWNER = re.compile(COPYRIGHT.replace(r"\p{L}\p{N}", r"\w"))
WORD = re.compile(r"[^\W_]+")
ONE_SPELLING = dict(SPELLINGS)
#: Digests that a batch of results holds.
BATCH = 50_000


def canonical(line: str) -> str:
    """One line in lower case with one spelling, its words parted by single spaces; nothing if it only names an owner."""
    line = line.lower()
    return "" if OWNER.match(line) else " ".join(ONE_SPELLING.get(w, w) for w in WORD.findall(line))


def canonical_units(text: str) -> tuple[str, list[str]]:
    """The whole text and its lines; lines with nothing left are left out of the whole and of the list."""
    lines = [line for line in map(canonical, text.split("\n")) if line]
    return " ".join(lines), lines


def known_digests(spark: SparkSession, known: list[tuple[str, str]]) -> DataFrame:
    """(license_id, digest); as many rows as known texts."""
    digests = {(name, hashlib.sha256(canonical_units(text)[0].encode()).digest()) for name, text in known}
    rows = [(name, bytearray(digest)) for name, digest in sorted(digests)]
    return spark.createDataFrame(rows, "license_id string, digest binary")


def unit_digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, scope, digest) of every whole text and every line in which something is left; null and empty texts have none."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, scopes, digests = [], [], []
            for i, cell in enumerate(batch.column("text")):
                whole, lines = canonical_units(cell.as_py() or "")
                if whole:
                    at += [i] * (len(lines) + 1)
                    scopes += ["text", *["line"] * len(lines)]
                    digests += [hashlib.sha256(unit.encode()).digest() for unit in (whole, *lines)]
                if len(at) >= BATCH or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int32())), pa.array(scopes, pa.string()), pa.array(digests, pa.binary())], ["id", "scope", "digest"])
                    at, scopes, digests = [], [], []

    return rows.mapInArrow(run, f"id {kind}, scope string, digest binary")


def license_matches(docs: DataFrame, known: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, scope, license_id, matches): which known licence the whole text is (scope 'text') and how many of its lines
    are one (scope 'line'). A text of a single line counts in both scopes; empty and null texts match nothing; rows that
    share an id are counted together; a null id is an id.

    The licence table has one row per known text and doesn't grow with the documents, so it is the broadcast side; only
    matches are shuffled.
    """
    found = unit_digests(docs, id_col, text_col).join(F.broadcast(known), "digest")
    return found.groupBy("id", "scope", "license_id").agg(F.count(F.lit(1)).alias("matches"))
