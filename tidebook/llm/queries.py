"""One query for each operator over the whole of its table, with production parameters, and the SQL where SQL can say it."""

from __future__ import annotations

from pathlib import Path

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebook.llm import backoff, bpe, cgk, conversation_trie, hard_negatives, host_paths, licenses, simhash, slots, token_files, toxicity, vectors, warc
from tidebook.llm.scratch import new_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = Path(public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    encoded = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, decoded=True)
    return bpe.digests(encoded, ranks, public_tokenizers.PATTERN).withColumnRenamed("id", "doc_id")


def license_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = licenses.known_digests(spark, licenses.KNOWN)
    return licenses.license_matches(table(spark, sf_dir, "documents"), known).withColumnRenamed("id", "doc_id")


def license_sql() -> str:
    known = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in licenses.KNOWN)
    words = f"' ' || regexp_replace(lower(unit), '{licenses.APART}', '  ', 'g') || ' '"
    for other, kept in licenses.SPELLINGS:
        words = f"replace({words}, ' {other} ', ' {kept} ')"
    line = f"CASE WHEN regexp_matches(lower(unit), '{licenses.COPYRIGHT}') THEN '' ELSE trim(regexp_replace({words}, ' +', ' ', 'g')) END"
    return f"""
    WITH known AS (SELECT DISTINCT license_id, sha256({line}) AS digest FROM (VALUES {known}) AS k(license_id, unit)),
    lines AS (
        SELECT doc_id, n, nth, {line} AS unit
        FROM (
            SELECT doc_id, n, unnest(string_split(text, chr(10))) AS unit, generate_subscripts(string_split(text, chr(10)), 1) AS nth
            FROM (SELECT doc_id, text, row_number() OVER () AS n FROM documents)
        )
    ),
    units AS (
        SELECT doc_id, 'line' AS scope, unit FROM lines WHERE unit <> ''
        UNION ALL
        SELECT doc_id, 'text' AS scope, string_agg(unit, ' ' ORDER BY nth) AS unit FROM lines WHERE unit <> '' GROUP BY doc_id, n
    )
    SELECT doc_id, scope, license_id, count(*) AS matches
    FROM (SELECT doc_id, scope, sha256(unit) AS digest FROM units) JOIN known USING (digest)
    GROUP BY doc_id, scope, license_id
    """


def virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = slots.shard_rows(table(spark, sf_dir, "documents"), shards=16)
    return rows.select(
        F.col("id").alias("doc_id"),
        "size",
        F.col("crc").alias("text_crc32"),
        F.lit("bytes").alias("law"),
        "shard",
        F.col("place").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
        F.col("slot").alias("virtual_slot"),
    )


def simhash_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_copies(table(spark, sf_dir, "documents"), words=3, max_bits=2)
    return rows.select(F.col("id").alias("doc_id"), simhash.hexadecimal("fp").alias("fingerprint"), F.col("component").alias("component_id"))


def remainder(id_col: str, divisor: int) -> Column:
    """CRC-32 of the id as text, modulo the divisor; a null id counts as no text."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % divisor


def pu_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learnt_from = remainder("doc_id", 5) != 0
    model = toxicity.train(docs.where(learnt_from), labels.where(learnt_from))
    rows = toxicity.scored(docs.select("doc_id", "text"), model)
    return rows.select("doc_id", (~(remainder("doc_id", 5) != 0)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def warc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.archived(table(spark, sf_dir, "pages"), new_folder(spark, "warc"), least_bytes=0)
    return rows.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def cgk_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cgk.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return rows.withColumnsRenamed({"id": "doc_id", "item": "item_id"})


def rotated_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = vectors.near_vectors(table(spark, sf_dir, "embeddings"), cosine=0.98)
    return rows.withColumnsRenamed({"id": "vec_id", "component": "component_id"})


def consensus_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = host_paths.main_text(table(spark, sf_dir, "pages"))
    return rows.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


def backoff_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rows = backoff.scores(docs, "crc32(CAST(coalesce(CAST(doc_id AS STRING), '') AS BINARY)) % 7 != 2")
    return rows.select(F.col("id").alias("doc_id"), (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, folder = public_tokenizers.path("byte_bpe_50k.json"), new_folder(spark, "ids")
    files = token_files.write_files(table(spark, sf_dir, "documents"), folder, lambda: token_files.chunks(path).encode, end_id=0)
    return token_files.read_files(files, folder).withColumnRenamed("id", "doc_id")


def conversation_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = conversation_trie.ordered_turns(table(spark, sf_dir, "conversations"))
    return conversation_trie.prefix_trie(conversation_trie.spliced(turns, step=5, heads=9)).withColumnRenamed("saved", "saved_tokens")


def conversation_sql() -> str:
    """CRC-32 is spelt out, DuckDB has none."""
    low = "list_reduce(list_prepend(xor(crc, byte) & 255, [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)"
    crc = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(name) + 1), lambda i: ascii(substr(name, i, 1))::BIGINT)), lambda crc, byte: xor(crc >> 8, {low})), 4294967295)"
    return f"""
    WITH own AS (
        SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS turns
        FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
    ),
    cut AS (SELECT conv_id, turns, {crc} % 9 AS h FROM (SELECT *, conv_id::VARCHAR AS name FROM own)),
    rebuilt AS (
        SELECT c.conv_id, list_concat(coalesce(b.turns, [])[1:c.h], c.turns[c.h + 1:]) AS turns
        FROM cut c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5
    ),
    paths AS (SELECT conv_id, turns, unnest(range(0, len(turns) + 1)) AS depth FROM rebuilt),
    named AS (SELECT conv_id, depth, sha256(turns[1:depth]::VARCHAR) AS node, sha256(turns[1:depth - 1]::VARCHAR) AS parent,
        CASE WHEN depth = 0 THEN 0 ELSE strlen(turns[depth].text) END AS size, depth = len(turns) AS ends FROM paths),
    nodes AS (
        SELECT depth, node, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, max(size) AS size,
            sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
        FROM named GROUP BY depth, node
    ),
    children AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY ALL),
    kept AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN children USING (depth, node)),
    totals AS (
        SELECT up.depth, up.node, sum(CASE WHEN u.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((u.n_convs - 1) * u.size) AS saved_tokens
        FROM kept u JOIN named up ON up.conv_id = u.conv_id AND up.depth <= u.depth GROUP BY ALL
    )
    SELECT k.conv_id, k.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, k.n_convs, k.n_children, t.n_leaves::BIGINT AS n_leaves, t.saved_tokens::BIGINT AS saved_tokens, k.ends_sha256
    FROM kept k JOIN totals t USING (depth, node) LEFT JOIN nodes p ON p.depth = k.depth - 1 AND p.node = k.parent
    """


def mined_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


NEGATIVES_SQL = """
WITH good AS (
    SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
    SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, list_dot_product(a.v, c.v)::BIGINT AS score
    FROM good a JOIN good c ON a.vec_id % 50 = 0 AND a.vec_id <> c.vec_id
),
positives AS (
    SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
    QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
),
negatives AS (
    SELECT p.*, n.vec_id AS negative_id, n.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INT AS rank
    FROM positives p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM negatives WHERE rank <= 3
"""


QUERIES = {
    "op1_byte_bpe": byte_bpe,
    "op2_rotated_codes": rotated_codes,
    "op3_license_digests": license_digests,
    "op4_pu_toxicity": pu_toxicity,
    "op5_simhash": simhash_components,
    "op6_virtual_slots": virtual_slots,
    "op7_host_paths": consensus_paths,
    "op8_backoff_automaton": backoff_scores,
    "op9_cgk_windows": cgk_leaks,
    "op10_warc_members": warc_round_trip,
    "op11_mixing_coder": token_blocks,
    "op12_conversation_trie": conversation_nodes,
    "op13_hard_negatives": mined_negatives,
}

ORACLE_SQL = {
    "op3_license_digests": license_sql(),
    "op12_conversation_trie": conversation_sql(),
    "op13_hard_negatives": NEGATIVES_SQL,
}
