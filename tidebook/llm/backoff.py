"""Language-model scores by a weighted backoff automaton.

States are the n-grams of the training text that can stand before a token. A seen continuation is an arc with its log
probability; anything else takes the failure arc, with its weight, to the state of the next shorter history. Smoothing is
by a Dirichlet prior on every order, p(w | h) = (c(h w) + m p(w | shorter h)) / (c(h) + m), over add-one unigrams, so an
arc needs counts alone and failure weighs m / (c(h) + m).

The automaton grows with the corpus and is never in one place. Texts are dealt into blocks; a block asks for the counts
of the n-grams that it holds, buckets of n-gram hashes add up what all blocks have seen in training texts and answer
each block, and the block builds the part of the automaton that its texts can reach and walks each text once, from left
to right. The texts are shuffled once; asking takes about 4 bytes an n-gram and block, answering about one. A block asks
only buckets of which it holds an n-gram, so the rows that move are never more than the n-grams of all blocks.

Words are known by 64-bit hashes. Longer n-grams are known by as many bits as the bytes of the input need, and 20 more, at
every size: another n-gram adds to the count of one in about two million.
"""

from __future__ import annotations

import math
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: n-gram length, weight of the prior, text bytes of a block, and blocks at least (so that small inputs spread too).
ORDER, PRIOR, BLOCK_BYTES, LEAST_BLOCKS = 3, 4.0, 4 << 20, 48
#: Tokens that one lane of a traversal scores.
LANE = 256
#: Bits of the hash of a longer n-gram beyond those that count the bytes of the input.
SPARE_BITS = 20
#: Hashes of the start of a text, which is a history but no token, and of its end, which is a token.
START, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
MIX = np.uint64(0xFF51AFD7ED558CCD)


def packed(hashes: np.ndarray, drop: int = 0) -> bytes:
    """Sorted hashes, whose lowest bits are zero, as differences without these bits: byte plane by byte plane, as many as
    the largest needs, so that the shuffle's compression finds the empty ones."""
    steps = np.diff(hashes, prepend=np.uint64(0)) >> np.uint64(drop)
    width = max(1, (int(steps.max()).bit_length() + 7) // 8) if len(steps) else 1
    return bytes([width]) + np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unpacked(raw: bytes, drop: int = 0) -> np.ndarray:
    steps = np.zeros(((len(raw) - 1) // raw[0], 8), np.uint8)
    steps[:, : raw[0]] = np.frombuffer(raw, np.uint8, offset=1).reshape(raw[0], -1).T
    return np.cumsum(steps.view("<u8").ravel().astype(np.uint64), dtype=np.uint64) << np.uint64(drop)


def packed_counts(counts: np.ndarray) -> bytes:
    """Counts byte plane by byte plane, so that the many small ones compress well."""
    return zlib.compress(np.ascontiguousarray(counts.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes(), 1)


def unpacked_counts(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(zlib.decompress(raw), np.uint8).reshape(8, -1).T).view("<u8").ravel().astype(np.int64)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    z = (a * np.uint64(3) + b) * MIX
    z ^= z >> np.uint64(32)
    z *= MIX
    return z ^ (z >> np.uint64(29))


class Grams:
    """The n-grams of a block's texts: for each order the distinct ones, with prefix, last word and suffix by number, and
    which stands at each place. Hashes of more than one word lose their lowest bits."""

    def __init__(self, texts: list[bytes], order: int, drop: int = 0):
        words: defaultdict[bytes, int] = defaultdict()
        words.default_factory = lambda: len(words) + 2
        parts, lengths = [], []
        for text in texts:
            found = text.lower().split()
            parts += [np.zeros(1, np.int64), np.fromiter(map(words.__getitem__, found), np.int64, len(found)), np.ones(1, np.int64)]
            lengths.append(len(found) + 2)
        self.begins = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        at = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        place = np.arange(len(at)) - np.repeat(self.begins[:-1], lengths)
        self.words = len(words) + 2
        hashes = np.empty(self.words, np.uint64)
        hashes[:2] = START, END
        hashes[2:] = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
        self.at, self.hashes, self.prefix, self.last, self.suffix = [at], [hashes], [None], [None], [None]
        for n in range(2, order + 1):
            here = np.flatnonzero(place >= n - 1)
            code = self.at[-1][here - 1] * self.words + at[here]
            found, first, number = np.unique(code, return_index=True, return_inverse=True)
            now = np.full(len(at), -1, np.int64)
            now[here] = number
            prefix, last = found // self.words, found % self.words
            self.suffix.append(self.at[-1][here[first]])
            self.prefix.append(prefix)
            self.last.append(last)
            self.hashes.append(mixed(self.hashes[-1][prefix], hashes[last] ^ np.uint64(n)) >> np.uint64(drop) << np.uint64(drop))
            self.at.append(now)

    def seen(self, train: np.ndarray) -> list[np.ndarray]:
        """How often each n-gram stands in the training texts."""
        marks = np.repeat(train, np.diff(self.begins)).astype(bool)
        return [np.bincount(at[marks & (at >= 0)], minlength=len(h)) for at, h in zip(self.at, self.hashes, strict=True)]


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Ranges of hashes, so the parts of a sorted list lie side by side."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


class Automaton:
    """The part of the model that a block's n-grams reach; counts are those of the whole training text."""

    def __init__(self, grams: Grams, counts: list[np.ndarray], tokens: int, types: int, prior: float):
        self.unigram = np.log10((counts[0] + 1) / (tokens + types + 1))
        chance = [(counts[0] + 1) / (tokens + types + 1)]
        # state 0 is the empty history; a history is a state if it was seen
        states = [np.where((counts[0] > 0) & (len(counts) > 1), np.cumsum(counts[0] > 0), 0)]
        states[0][1] = 0  # nothing follows the end
        total = 1 + int((counts[0] > 0).sum())
        histories = [(states[0], counts[0], np.zeros(len(counts[0]), np.int64))]
        keys, weights, nexts = [], [], []
        for n in range(1, len(counts)):
            prefix, last, suffix, c = grams.prefix[n], grams.last[n], grams.suffix[n], counts[n]
            before = counts[n - 1][prefix]
            chance.append(np.where(before > 0, (c + prior * chance[n - 1][suffix]) / (before + prior), chance[n - 1][suffix]))
            is_last = n == len(counts) - 1
            own = np.where(c > 0, total + np.cumsum(c > 0) - 1, 0) if not is_last else None
            if not is_last:
                own = np.where(last == 1, 0, own)
                histories.append((own, c, states[n - 1][suffix]))
                states.append(own)
                total += int((c > 0).sum())
            known = c > 0
            keys.append(states[n - 1][prefix[known]] * grams.words + last[known])
            weights.append(np.log10(chance[n][known]))
            nexts.append(states[n - 1][suffix[known]] if is_last else own[known])
        self.keys, self.weights = np.concatenate([*keys, np.zeros(0, np.int64)]), np.concatenate([*weights, np.zeros(0)])
        self.nexts = np.concatenate([*nexts, np.zeros(0, np.int64)])
        order = np.argsort(self.keys, kind="stable")
        self.keys, self.weights, self.nexts = self.keys[order], self.weights[order], self.nexts[order]
        fail, back = np.zeros(total), np.zeros(total, np.int64)
        for state, c, shorter in histories:
            used = state > 0
            fail[state[used]] = np.log10(prior / (c[used] + prior))
            back[state[used]] = shorter[used]
        self.fail, self.back, self.root_next = fail, back, states[0]
        self.words, self.start, self.reach = grams.words, int(states[0][0]), len(counts) - 1

    def step(self, state: np.ndarray, token: np.ndarray) -> np.ndarray:
        """Log probabilities of one token in each lane; the states move on."""
        total, left = np.zeros(len(token)), np.arange(len(token))
        while left.size:
            at_root = state[left] == 0
            done, left = left[at_root], left[~at_root]
            total[done] += self.unigram[token[done]]
            state[done] = self.root_next[token[done]]
            key = state[left] * self.words + token[left]
            arc = np.searchsorted(self.keys, key)
            hit = self.keys.take(arc, mode="clip") == key if len(self.keys) else np.zeros(len(key), bool)
            done, arc, left = left[hit], arc[hit], left[~hit]
            total[done] += self.weights[arc]
            state[done] = self.nexts[arc]
            total[left] += self.fail[state[left]]
            state[left] = self.back[state[left]]
        return total

    def walk(self, tokens: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Log probability of every token, each text from left to right; the state carries the history.

        A long text is walked in lanes side by side. A state is what the last tokens leave, as many as a history has, so
        a lane that starts inside a text reads these from the empty history first.
        """
        first, ends = begins[:-1] + 1, begins[1:]
        n = np.maximum(-(-(ends - first) // LANE), 0)
        text = np.repeat(np.arange(len(n)), n)
        own = first[text] + LANE * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
        begin, stop = np.maximum(own - self.reach, first[text]), np.minimum(own + LANE, ends[text])
        order = np.argsort(begin - stop, kind="stable")
        own, begin, stop = own[order], begin[order], stop[order]
        state = np.where(begin == first[text[order]], self.start, 0)
        out = np.zeros(len(tokens))
        for k in range(int((stop - begin).max(initial=0))):
            active = int(np.searchsorted(begin - stop, -k))
            place = begin[:active] + k
            chance = self.step(state[:active], tokens[place])
            scored = place >= own[:active]
            out[place[scored]] = chance[scored]
        return out


def scores(docs: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, prior: float = PRIOR, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score) of every row; train is a SQL condition on docs that
    says which rows are learnt from (null: not).

    Words are parted by ASCII white space, A-Z in lower case; every text ends with one end token, so null and empty texts
    have one token. base_score takes add-one unigrams, score the automaton. Rows that repeat are learnt from and scored
    one by one, and go to as many blocks as partitions they are read from. Without training rows all scores are those of
    the one unknown word.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.expr(train), F.lit(False)).alias("train"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(LEAST_BLOCKS, -(-total // block_bytes))
    drop = max(0, 64 - (total.bit_length() + SPARE_BITS))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text", F.spark_partition_id()), F.lit(blocks)).cast("int"))

    def grams_of(table: pa.Table) -> tuple[Grams, list[np.ndarray], list[np.ndarray]]:
        """With the order that sorts the hashes of each length, and the borders of the buckets in it."""
        grams = Grams([t.as_py() for t in table.column("text")], order, drop)
        orders = [np.argsort(h, kind="stable") for h in grams.hashes]
        cuts = [np.searchsorted(bucket_of(h[o], blocks), np.arange(blocks + 1)) for h, o in zip(grams.hashes, orders, strict=True)]
        return grams, orders, cuts

    def ask(table: pa.Table) -> pa.Table:
        table = arranged(table)
        grams, orders, cuts = grams_of(table)
        seen = grams.seen(table.column("train").to_numpy())
        hashes = [h[o] for h, o in zip(grams.hashes, orders, strict=True)]
        counts = [c[o] for c, o in zip(seen, orders, strict=True)]
        some = np.flatnonzero(np.any([np.diff(c) > 0 for c in cuts], axis=0)).tolist()

        def parts(make, lists, b: int) -> list[bytes]:
            return [make(x[c[b] : c[b + 1]], n) for n, (x, c) in enumerate(zip(lists, cuts, strict=True))]

        block = table.column("block")[0].as_py()
        return pa.table(
            {
                "bucket": pa.array(some, pa.int32()),
                "block": pa.array([block] * len(some), pa.int32()),
                "hashes": pa.array([parts(lambda x, n: packed(x, drop if n else 0), hashes, b) for b in some], pa.list_(pa.binary())),
                "counts": pa.array([parts(lambda x, _: packed_counts(x), counts, b) for b in some], pa.list_(pa.binary())),
            }
        )

    def answer(table: pa.Table) -> pa.Table:
        """Adds up a bucket; every block hears the sums it asked for."""
        asked, counted = table.column("hashes").to_pylist(), table.column("counts").to_pylist()
        replies: list[list[bytes]] = [[] for _ in asked]
        for n in range(order):
            lists = [unpacked(a[n], drop if n else 0) for a in asked]
            distinct, number = np.unique(np.concatenate(lists), return_inverse=True)
            sums = np.zeros(len(distinct), np.int64)
            np.add.at(sums, number, np.concatenate([unpacked_counts(c[n]) for c in counted]))
            at = 0
            for reply, own in zip(replies, lists, strict=True):
                reply.append(packed_counts(sums[number[at : at + len(own)]]))
                at += len(own)
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "sums": pa.array(replies, pa.list_(pa.binary()))})

    def vocabulary(table: pa.Table) -> pa.Table:
        """Tokens of the training texts that fall into a bucket, and how many distinct ones."""
        hashes = np.concatenate([unpacked(a[0].as_py()) for a in table.column("hashes")])
        counts = np.concatenate([unpacked_counts(c[0].as_py()) for c in table.column("counts")])
        used = (counts > 0) & (hashes != START)
        return pa.table({"tokens": pa.array([int(counts[used].sum())], pa.int64()), "types": pa.array([len(np.unique(hashes[used]))], pa.int64())})

    def score(_, table: pa.Table, replies: pa.Table) -> pa.Table:
        table, replies = arranged(table), replies.sort_by("bucket")
        grams, orders, cuts = grams_of(table)
        tokens, types = (replies.column(name)[0].as_py() for name in ("tokens", "types"))
        counts = [np.zeros(len(h), np.int64) for h in grams.hashes]
        for b, sums in zip(replies.column("bucket").to_pylist(), replies.column("sums").to_pylist(), strict=True):
            for n in range(order):
                counts[n][orders[n][cuts[n][b] : cuts[n][b + 1]]] = unpacked_counts(sums[n])
        model = Automaton(grams, counts, tokens, types, prior)
        at, n_tokens, n_known, base, full = grams.at[0], [], [], [], []
        chances = model.walk(at, grams.begins)
        for begin, end in zip(grams.begins[:-1], grams.begins[1:], strict=True):
            own = at[begin + 1 : end]
            n_tokens.append(len(own))
            n_known.append(int((counts[0][own] > 0).sum()))
            base.append(math.fsum(model.unigram[own]))
            full.append(math.fsum(chances[begin + 1 : end]))
        return pa.table(
            {
                "id": table.column("id"), "train": table.column("train"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()),
                "train_tokens": pa.array([tokens] * len(n_tokens), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(full, pa.float64()),
            }
        )

    asked = dealt.groupBy("block").applyInArrow(ask, "bucket int, block int, hashes array<binary>, counts array<binary>")
    answered = asked.groupBy("bucket").applyInArrow(answer, "block int, bucket int, sums array<binary>")
    # the same shuffle serves both; its totals are one row
    totals = asked.groupBy("bucket").applyInArrow(vocabulary, "tokens long, types long").agg(F.sum("tokens").alias("tokens"), F.sum("types").alias("types"))
    answered = answered.crossJoin(F.broadcast(totals))
    return dealt.groupBy("block").cogroup(answered.groupBy("block")).applyInArrow(score, f"id {kind}, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def arranged(table: pa.Table) -> pa.Table:
    """A block's rows in one order, whatever order they arrived in; equal texts give equal n-grams."""
    order = sorted(range(table.num_rows), key=lambda i: (table.column("text")[i].as_py(), table.column("train")[i].as_py()))
    return table.take(pa.array(order)).combine_chunks()
