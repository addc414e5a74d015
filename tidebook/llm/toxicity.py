"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, all other text is unlabelled and may hold toxic texts too. The risk is
prior x (positives as positive) + max(0, unlabelled as negative - prior x positives as negative); where the second part
falls below zero its gradient is turned round, which keeps the classifier from calling every unlabelled text clean.
Features are the distinct words of the whole text and their first letters, hashed; the classifier is linear, in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Hashed features, and the lengths of the beginnings of words that are features beside the word.
FEATURES, PREFIXES = 1 << 22, (3, 4, 5)
#: Texts the classifier is fitted on: the bound of the sample of confirmed and of unlabelled rows, taken in hash order.
POSITIVES, UNLABELLED = 2_000, 5_000
#: A feature is used if its shares of the confirmed and of the unlabelled texts are so many standard errors apart.
APART = 4.5
STEPS, RATE, DECAY = 120, 0.1, 1e-4
MEMORY = 1 << 16

WORD = re.compile(r"[^\W\d_]+")


class Words(dict):
    """Feature numbers of the first words seen, which hold the frequent ones."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        marked = [word + "\x00", *(word[:n] for n in PREFIXES if len(word) >= n)]
        found = tuple(xxhash.xxh32_intdigest(m.encode()) % FEATURES for m in marked)
        if len(self) < MEMORY:
            self[word] = found
        return found


WORDS = Words()


def features(text: str) -> np.ndarray:
    """Numbers of the features of a whole text, each once, in order."""
    words = set(WORD.findall(text.lower()))
    found: set[int] = set().union(*map(WORDS.__getitem__, words)) if words else set()
    return np.sort(np.fromiter(found, np.int32, len(found)))


@dataclass(frozen=True)
class Classifier:
    """Weights of the features that have one, in order of their numbers, and the bias."""

    used: np.ndarray
    weights: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        table = np.zeros(FEATURES, np.float32)
        table[self.used] = self.weights
        return table


def score(found: np.ndarray, dense: np.ndarray, bias: float) -> float:
    """Chance of toxicity; no features leave the bias."""
    return float(1 / (1 + np.exp(-np.clip(dense[found].sum(dtype=np.float64) + bias, -30, 30))))


def fit(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Classifier:
    """Minimises the non-negative risk with the logistic loss by Adam over all texts. No positives or no other text: a
    classifier that knows the prior only."""
    if not positive or not unlabelled or not 0 < prior < 1:
        prior = min(max(prior, 1e-6), 1 - 1e-6)
        return Classifier(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(prior / (1 - prior))))
    rows = [*positive, *unlabelled]
    every = np.concatenate(rows)
    used, number = np.unique(every, return_inverse=True)
    of_positive = np.bincount(number[: sum(map(len, positive))], minlength=len(used))
    share = np.bincount(number, minlength=len(used)) / len(rows)
    apart = of_positive / len(positive) - (share * len(rows) - of_positive) / len(unlabelled)
    kept = np.abs(apart) >= APART * np.sqrt(share * (1 - share) * (1 / len(positive) + 1 / len(unlabelled))) + 1e-12
    row_of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])[kept[number]]
    column = (np.cumsum(kept) - 1)[number[kept[number]]]
    used, n = used[kept], int(kept.sum())
    is_positive = np.arange(len(rows)) < len(positive)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    loss = lambda z: np.logaddexp(0, -z)
    weights, bias = np.zeros(n), float(np.log(prior / (1 - prior)))
    first, second = np.zeros(n + 1), np.zeros(n + 1)
    for step in range(1, STEPS + 1):
        z = np.bincount(row_of, weights[column], len(rows)) + bias
        zp, zu = z[is_positive], z[~is_positive]
        negative_part = loss(-zu).mean() - prior * loss(-zp).mean()
        slope = np.empty(len(rows))
        as_negative_p, as_negative_u = -prior * sigmoid(zp) / len(zp), sigmoid(zu) / len(zu)
        if negative_part >= 0:
            slope[is_positive] = -prior * sigmoid(-zp) / len(zp) + as_negative_p
            slope[~is_positive] = as_negative_u
        else:
            slope[is_positive], slope[~is_positive] = -as_negative_p, -as_negative_u
        gradient = np.append(np.bincount(column, slope[row_of], n) + DECAY * weights, slope.sum())
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        move = RATE * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        weights -= move[:-1]
        bias -= move[-1]
    return Classifier(used.astype(np.int32), weights.astype(np.float32), float(bias))


def featured(docs: DataFrame, text_col: str) -> DataFrame:
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"), "confirmed")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [features(t.as_py()) for t in batch.column("text")]
            offsets = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            flat = np.concatenate(found) if found else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("confirmed"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))], ["confirmed", "found"])

    return rows.mapInArrow(run, "confirmed boolean, found array<int>")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", toxic_col: str = "toxic", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Classifier:
    """Fits on at most so many confirmed and unlabelled texts of docs. labels has an id and 1 for toxic, anything else for
    not; an id that is labelled both ways counts as toxic; null ids and labels are passed over. The prior is the share of
    toxic among the labelled.

    Only ids are sorted and only the drawn texts' features reach the driver, at most FEATURES for each of the bounded
    number of texts.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(toxic_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.max((F.col(toxic_col) == 1).cast("int")).alias("toxic"))
    totals = known.agg(F.count(F.lit(1)).alias("n"), F.sum("toxic").alias("toxic")).first()
    ids = docs.select(F.col(id_col).alias("id")).where("id IS NOT NULL").join(known, "id", "left")
    order = F.xxhash64("id", F.lit("fit"))
    drawn = []
    for confirmed, most in ((True, positives), (False, unlabelled)):
        own = ids.where("toxic = 1") if confirmed else ids
        drawn.append(own.select("id", F.lit(confirmed).alias("confirmed"), order.alias("rank")).distinct().orderBy("rank", "id").limit(most).select("id", "confirmed"))
    # at most positives + unlabelled ids
    chosen = F.broadcast(drawn[0].unionByName(drawn[1]))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(chosen, "id")
    table = featured(texts, "text").toArrow()
    found = [np.asarray(f.values) for f in table.column("found")]
    marks = table.column("confirmed").to_pylist()
    split = lambda want: sorted((f for f, m in zip(found, marks, strict=True) if m is want), key=lambda f: (len(f), f[:50].tolist()))
    return fit(split(True), split(False), (totals.toxic or 0) / max(totals.n, 1))


def scored(docs: DataFrame, model: Classifier, text_col: str = "text", score_col: str = "score", keep_text: bool = False) -> DataFrame:
    """All columns (the text only if it is to be kept) and the score of every row's whole text. Empty and null texts get
    the bias alone."""
    if score_col in docs.columns:
        raise ValueError(f"docs already has a column {score_col}")
    kept = [c for c in docs.columns if keep_text or c != text_col]
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in kept)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the number of texts fitted on

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense, bias = shared.value.dense(), shared.value.bias
        for batch in batches:
            scores = [score(features(t.as_py() or ""), dense, bias) for t in batch.column(text_col)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(scores, pa.float64())], [*kept, score_col])

    return docs.mapInArrow(run, f"{kinds}`{score_col}` double")
