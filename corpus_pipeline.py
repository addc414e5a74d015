"""From raw documents to tokens: toxic texts go, near copies go but one, texts that leak benchmark items go, the rest is encoded.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is written as Parquet and read again as the
next stage's docs. Rows are judged by id: rows that share an id stay or go together, and a row without an id goes only
with a group that has an id to keep.
"""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import bpe, cgk, simhash, toxicity
from tidebook.llm.queries import remainder, table
from tidebook.llm.scratch import stored

#: A text of this score or more is rejected.
TOXIC = 0.5


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in gone, compared as null-safe values. The ids are written first, so Spark
    knows their size: small lists are broadcast, larger ones are joined by shuffle."""
    ids = stored(gone.select(F.col("doc_id").alias("gone_id")).distinct(), "gone")
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["gone_id"]), "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    learnt_from = remainder("doc_id", 5) != 0
    model = toxicity.train(docs.where(learnt_from), table(spark, sf_dir, "labels").where(learnt_from))
    rows = toxicity.scored(docs, model, score_col="__score", keep_text=True)
    return rows.where(F.col("__score") < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = simhash.near_copies(docs)
    return without(docs, rows.where("component IS NOT NULL AND NOT (id <=> component)").select(F.col("id").alias("doc_id")))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without(docs, cgk.leaks(docs, table(spark, sf_dir, "benchmark")).select(F.col("id").alias("doc_id")))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ranks, pattern = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes(), public_tokenizers.PATTERN
    encoded = bpe.encode(docs, ranks, pattern, decoded=True)
    return encoded.select(F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2("bytes", 256).alias("decoded_sha256"), F.col("ids").alias("tokens"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_leaks),
    ("byte_bpe", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
