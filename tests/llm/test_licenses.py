"""Licence digests: what normalising makes equal and what it keeps apart."""

from tidebook.llm import licenses


def matches(spark, texts):
    docs = spark.createDataFrame([(i, t, "clash", "x") for i, t in texts], "doc_id long, text string, digest string, scope string").repartition(2)
    found = licenses.license_matches(docs, licenses.known_digests(spark, licenses.KNOWN))
    return sorted(((r.id, r.scope, r.license_id, r.matches) for r in found.collect()), key=repr)


def test_spellings_case_punctuation_and_owners(spark):
    isc = dict(licenses.KNOWN)["ISC"]
    wrapped = f"/*\n * Copyright (c) 2020 A. Person\n *\n * {isc.upper()}\n * All rights reserved.\n */"
    texts = [
        (1, "released UNDER the M.I.T. licence"),  # M.I.T. isn't MIT
        (2, "Copyright 2021 Someone\n  # Released under the MIT Licence!!"),
        (3, wrapped),
        (4, "prose\nLicensed under the Apache License, Version 2.0.\nprose\n* licenced under the apache license version 2 0"),
        (5, "Licensed under CC BY-NC 4.0."),
        (5, "Licensed under CC BY-NC 4.0."),
        (None, "Licensed under CC Attribution-NonCommercial 4.0."),
        (6, "Licensed under the Apache License, Version 2.1."),
        (7, "This work is licensed under the GNU General Public License, version 3. And more."),
        (8, ""), (9, None), (10, "© 2020\n\n"), (11, "word " * 200_000),
    ]
    want = [
        (2, "line", "MIT", 1), (2, "text", "MIT", 1), (3, "line", "ISC", 1), (3, "text", "ISC", 1), (4, "line", "Apache-2.0", 2),
        (5, "line", "CC-BY-NC-4.0", 2), (5, "text", "CC-BY-NC-4.0", 2), (None, "line", "CC-BY-NC-4.0", 1), (None, "text", "CC-BY-NC-4.0", 1),
    ]
    assert matches(spark, texts) == sorted(want, key=repr)


def test_no_rows(spark):
    assert matches(spark, []) == []
