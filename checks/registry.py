"""Collects the queries of all studies."""

from __future__ import annotations

from checks import book, models, outcomes, panel, quality, snapshot, stats, storage

STUDIES = (book, quality, panel, stats, snapshot, outcomes, models, storage)


def queries():
    return {k: v for m in STUDIES for k, v in m.QUERIES.items()}


def oracle_sql():
    return {k: v for m in STUDIES for k, v in m.SQL.items()}
