"""The pipeline's stages one by one against plain code, and a whole run."""

import hashlib
import random

import pytest
import tiktoken

import corpus_pipeline
from tests.llm.test_simhash import classes, plain
from tidebook.llm import bpe, cgk


def prose(draw, n):
    return " ".join("".join(draw.choice("etaoinshrdlu") for _ in range(draw.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    folder, draw = tmp_path_factory.mktemp("corpus"), random.Random(6)
    items = [(i, prose(draw, 30)) for i in range(20)]
    rows, toxic, leaking = [], set(), set()
    for i in range(400):
        text = prose(draw, draw.randint(1, 150))
        if i % 8 == 0:
            text, _ = f"{text} wretch {prose(draw, 3)} villain", toxic.add(i)
        elif i % 8 == 1:
            text, _ = f"{text} {cgk.edited(draw.choice(items)[1].encode(), 0.03, cgk.np.random.default_rng(i)).decode()} end", leaking.add(i)
        elif i % 8 == 2:
            text = rows[i - 3 if i > 3 else 0][1]
        rows.append((i, text, "en", "s", len(text)))
    rows += [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, prose(draw, 40), "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(400) if i % 3], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), rows, toxic, leaking, items


def test_each_stage(spark, corpus, tmp_path):
    folder, rows, toxic, leaking, items = corpus
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in docs.collect()}
    everything, by_id = {r[0] for r in rows}, {r[0]: r[1] for r in rows}
    assert not (toxic - leaking) & kept["toxicity"] and len(everything - toxic - kept["toxicity"]) <= 2
    ids = sorted((i for i in kept["toxicity"]), key=lambda i: (i is None, i))
    least = classes([plain(by_id[i] or "") for i in ids], 2)
    assert kept["simhash_near_dedup"] == {i for k, i in enumerate(ids) if least[k] == k}
    leaks = {i for i in kept["simhash_near_dedup"] if any(cgk.edit_distance(cgk.plain(t), cgk.plain(by_id[i]), 10**6) <= 0.2 * len(t) for _, t in items)}
    assert kept["benchmark_decontamination"] == kept["simhash_near_dedup"] - leaks and leaks >= leaking & kept["simhash_near_dedup"]


def test_whole_run(spark, corpus):
    folder, rows, *_ = corpus
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    ranks = corpus_pipeline.Path(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.tiktoken")).read_bytes()
    code = bpe.coder(ranks, corpus_pipeline.public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=corpus_pipeline.public_tokenizers.PATTERN, mergeable_ranks=code.ranks, special_tokens={})
    by_id = {r[0]: r[1] or "" for r in rows}
    assert 200 < len(got) < 330
    for i, r in got.items():
        assert list(r.tokens) == library.encode_ordinary(by_id[i]) and r.n_tokens == len(r.tokens)
        assert r.decoded_sha256 == hashlib.sha256(by_id[i].encode()).hexdigest()


def test_empty_table(spark, corpus, tmp_path):
    folder, *_ = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{tmp_path}/{name}")
        assert (docs := spark.read.parquet(f"{tmp_path}/{name}")).count() == 0


def test_near_copies_are_those_of_simhash(spark):
    draw = random.Random(8)
    while True:  # close fingerprints, though a third of the five-word shingles differ
        words = prose(draw, 30).split()
        changed = [*words[:15], "other", *words[16:]]
        if (plain(" ".join(words)) ^ plain(" ".join(changed))).bit_count() <= 2:
            break
    rows = [(1, " ".join(words)), (2, " ".join(changed)), (3, prose(draw, 30)), (4, " ".join(words).upper())]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()}
    assert kept == {1, 3}
