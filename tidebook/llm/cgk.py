"""Benchmark decontamination: the CGK random walk maps edit distance to Hamming distance, bit sampling finds windows
close to an item, and the exact edit distance decides.

The walk reads a string with one pointer. At step j it writes the letter under the pointer and moves on if a random bit
for (j, letter) is set. Two strings that differ by few edits fall back into step after each, so what they write differs in
few places. Windows start at every word of a document; an item is hashed from each of its words that a whole walk can
follow, so an edit near one start leaves the others. Each of a number of samples of places is one hash table.

A pilot plants edits in all items, up to the share that counts as a match. Items of which the samples miss a copy are found
by an exact way instead: an item has more pieces of a few characters than there can be edits, so some stand in every match,
and windows with enough of them are compared. Items too short for a walk are found where their words stand in a row without
an edit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: Steps of a walk, draws of four places each, and how many samples (two draws together) are tried at most.
STEPS, DRAWS, MOST_SAMPLES = 96, 10, 45
#: Places of two whole walks that agree, from which on the strings are compared: chance makes about 26 where a sample agrees, an item with a fifth edited over 57.
AGREE = 56
#: Share of an item's characters that may be edited, and a smaller share that the pilot plants besides.
EDITS, PILOT_EDITS = 0.2, 0.12
#: Characters of an item that the pilot reads at most: what finds these finds the item.
PILOT_CHARS = 2048
#: Items with fewer characters give no walk enough letters; they are looked up word for word.
LEAST_CHARS = 48
#: Bytes of items that one pass over the documents looks for, windows walked at once, and document bytes taken together.
ITEM_BYTES, WINDOWS, TEXT_BYTES = 2 << 20, 1 << 15, 1 << 22


def plain(text: str | None) -> bytes:
    """A-Z in lower case, single spaces."""
    return b" ".join((text or "").encode().lower().split())


class Walk:
    """The random bits, and the places that each sample looks at."""

    def __init__(self, samples: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.moves = draw.integers(0, 2, (STEPS, 256), dtype=np.uint8)
        self.moves[:, 0] = 0  # the end of the text is never passed
        self.places = np.array([np.sort(draw.choice(STEPS, 4, replace=False)) for _ in range(DRAWS)])
        self.factors = draw.integers(1 << 31, 1 << 32, DRAWS, dtype=np.uint32) | np.uint32(1)
        self.pairs = [(a, b) for b in range(DRAWS) for a in range(b)][:samples]

    def letters(self, text: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """What the walks from these starts write; text ends with a zero."""
        out, at = np.empty((STEPS, len(starts)), np.uint8), starts.astype(np.int64)
        step = np.empty(len(starts), np.uint8)
        for moves, row in zip(self.moves, out, strict=True):
            np.take(text, at, out=row, mode="clip")
            np.take(moves, row, out=step, mode="clip")
            at += step
        return out

    def keys(self, letters: np.ndarray) -> Iterator[np.ndarray]:
        """One 32-bit key of every walk for each sample, of the letters at the eight places of its two draws."""
        draws: list[np.ndarray] = []
        for a, b in self.pairs:
            while len(draws) <= b:
                four = np.ascontiguousarray(letters[self.places[len(draws)]].T).view(np.uint32).ravel()
                four *= self.factors[len(draws)]
                draws.append(four ^ (four >> np.uint32(15)))
            key = draws[a] * self.factors[b]
            key += draws[b]
            key *= self.factors[a]
            yield key


def word_starts(text: np.ndarray) -> np.ndarray:
    before = np.concatenate([[32], text[:-1]])
    return np.flatnonzero(((before == 32) | (before == 0)) & (text != 32) & (text != 0))


def item_starts(text: np.ndarray) -> np.ndarray:
    """The first word, and every word that leaves a walk enough letters: a walk reads about half as many as it has steps."""
    starts = word_starts(text)
    return starts[(starts == 0) | (len(text) - starts >= STEPS * 5 // 8)]


def edited(text: bytes, share: float, draw: np.random.Generator) -> bytes:
    """Plants single-character changes, insertions and losses."""
    out = list(text)
    for _ in range(int(share * len(text))):
        at = int(draw.integers(0, len(out)))
        kind = int(draw.integers(0, 3))
        out[at : at + (kind < 2)] = [] if kind == 1 else [int(draw.integers(97, 123))]
    return bytes(out)


def first_hit(walk: Walk, item: bytes, copy: bytes) -> int:
    """The first sample that finds the copy; one above the most if none does."""
    own, other = (np.frombuffer(t + b"\x00", np.uint8) for t in (item, copy))
    a, b = walk.letters(own, item_starts(own[:-1])), walk.letters(other, word_starts(other))
    for k, (x, y) in enumerate(zip(walk.keys(a), walk.keys(b), strict=True) if b.size else ()):
        order = np.argsort(y, kind="stable")
        j = order[np.minimum(np.searchsorted(y[order], x), len(y) - 1)]
        i = np.flatnonzero(y[j] == x)
        if (np.count_nonzero(a[:, i] == b[:, j[i]], axis=0) >= AGREE).any():
            return k + 1
    return MOST_SAMPLES + 1


def first_hits(items: list[bytes], share: float, seed: int = 11) -> list[list[int]]:
    """The first samples that find the edited copies of each item: one copy, and more of short items, which have few starts."""
    walk, draw = Walk(MOST_SAMPLES), np.random.default_rng(seed)
    heads = [item[:PILOT_CHARS] for item in items]
    return [[first_hit(walk, head, edited(head, share, draw)) for _ in range(1 + 2 * STEPS // len(head))] for head in heads]


def samples_for(worst: list[int]) -> tuple[int, int]:
    """(samples that have to find all copies of an item, samples drawn: half as many again for safety). worst: the sample
    after which all copies of an item are found. Items that need more are looked for by their pieces, which costs about as
    much an item as a sample does for all; the sum is made least."""
    enough = MOST_SAMPLES * 2 // 3
    needed = min(range(1, enough + 1), key=lambda k: k + (k + 1) // 2 + sum(w > k for w in worst))
    return needed, needed + (needed + 1) // 2


@dataclass(frozen=True)
class Items:
    """Normalised items: those found by walks, those of which the pilot missed a copy, short ones. The walks from all
    starts of the first (a row each), and for each sample the sorted keys with the number of the start."""

    ids: list
    texts: list[bytes]
    missed: range
    samples: int
    letters: np.ndarray
    item: np.ndarray
    start: np.ndarray
    keys: list[np.ndarray]
    order: list[np.ndarray]


def indexed(rows: list[tuple], share: float = EDITS) -> Items:
    """rows: (id, normalised item)."""
    long, short = ([r for r in rows if (len(r[1]) < LEAST_CHARS) == b] for b in (False, True))
    texts = [text for _, text in long]
    worst = [max(a + b) for a, b in zip(first_hits(texts, PILOT_EDITS), first_hits(texts, share, 12), strict=True)]
    needed, samples = samples_for(worst)
    sure = [w <= needed for w in worst]
    rows = [r for r, s in zip(long, sure, strict=True) if s] + [r for r, s in zip(long, sure, strict=True) if not s] + short
    walked = [text for _, text in rows[: sum(sure)]]
    walk, letters, item, start = Walk(samples), [np.zeros((STEPS, 0), np.uint8)], [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for i, text in enumerate(walked):
        padded = np.frombuffer(text + b"\x00", np.uint8)
        starts = item_starts(padded[:-1])
        letters.append(walk.letters(padded, starts))
        item.append(np.full(len(starts), i, np.int32))
        start.append(starts.astype(np.int32))
    letters = np.concatenate(letters, axis=1)
    keys = list(walk.keys(letters))
    orders = [np.argsort(k, kind="stable") for k in keys]
    return Items([r[0] for r in rows], [r[1] for r in rows], range(len(walked), len(long)), samples, np.ascontiguousarray(letters.T), np.concatenate(item), np.concatenate(start), [k[o] for k, o in zip(keys, orders, strict=True)], orders)


def edit_distance(item: bytes, window: bytes, most: int) -> int:
    """Least edits between the item and any part of the window, by bit vectors as long as the item; most + 1 if above most."""
    m, full = len(item), (1 << len(item)) - 1
    masks = dict.fromkeys(set(item), 0)
    for i, c in enumerate(item):
        masks[c] |= 1 << i
    up, down, score, least, top = full, 0, m, m, 1 << (m - 1)
    for c in window:
        match = masks.get(c, 0)
        level = (((match & up) + up) ^ up) | match | down
        raised = down | (~(level | up) & full)
        lowered = up & level
        score += bool(raised & top) - bool(lowered & top)
        raised, lowered = (raised << 1) & full, (lowered << 1) & full
        up = lowered | (~(level | raised) & full)
        down = raised & level
        least = min(least, score)
    return min(least, most + 1)


class Pieces:
    """An item cut into pieces of `size` characters. It has `need` more of them than edits, and an edit spoils one; so a window
    within `most` edits holds `need` of them at least. Where they stand, less where they stand in the item, differs by no
    more than the edits between them, and from the window's begin by no more than `most`."""

    def __init__(self, item: bytes, most: int, size: int):
        self.length, self.most, self.size, self.need = len(item), most, size, max(1, len(item) // size - most)
        found = codes(np.frombuffer(item, np.uint8), size)[::size]
        order = np.argsort(found, kind="stable")
        self.codes, self.places = found[order], order * size
        self.table = np.zeros(1 << 5 * size, bool)
        self.table[found] = True

    def stretches(self, text: np.ndarray, low: np.ndarray | None = None, high: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """From and to of the stretches of a text, given by its codes, that hold all such windows; none overlap. With low and
        high only windows inside these stretches count."""
        if low is None:
            hits = np.flatnonzero(self.table.take(text))
        else:
            low, high = np.clip(low, 0, len(text)), np.clip(high, 0, len(text))
            n = high - low
            within = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
            hits = within[self.table.take(text[within])]
        left, right = np.searchsorted(self.codes, text[hits], "left"), np.searchsorted(self.codes, text[hits], "right")
        n = right - left
        entry = np.repeat(left - (np.cumsum(n) - n), n) + np.arange(n.sum())
        begins = np.sort(np.repeat(hits, n) - self.places[entry])
        first, last = begins[: max(0, len(begins) - self.need + 1)], begins[self.need - 1 :]
        near = last - first <= self.most
        low, high = last[near] - self.most, first[near] + self.length + 2 * self.most
        opens = np.r_[True, low[1:] > high[:-1]][: len(low)]
        return low[opens], high[np.r_[opens[1:], True][: len(low)]]


def piece_sizes(length: int, most: int) -> list[int]:
    """Longer pieces are rarer in a text, shorter ones leave more of them unspoilt."""
    return [q for q in (4, 3, 2) if length // q >= most + 2] or [1]


def codes(text: np.ndarray, size: int) -> np.ndarray:
    """A number for the characters from each place on; equal ones have equal numbers."""
    letters, out = (text & 31).astype(np.int32), np.zeros(max(0, len(text) - size + 1), np.int32)
    for k in range(size):
        out <<= 5
        out |= letters[k : k + len(out)]
    return out.astype(np.intp)


class Search:
    """Finds the items of one pass in a task's documents."""

    def __init__(self, items: Items, share: float):
        self.items, self.share, self.walk = items, share, Walk(items.samples)
        bits = min(24, max(16, (64 * len(items.item)).bit_length() - 1))
        self.shift, self.tables = np.uint32(32 - bits), np.zeros((items.samples, 1 << bits), bool)
        for k, keys in enumerate(items.keys):
            self.tables[k, keys >> self.shift] = True
        most = {i: int(share * len(items.texts[i])) for i in items.missed}
        self.pieces = {i: [Pieces(items.texts[i], m, size) for size in piece_sizes(len(items.texts[i]), m)] for i, m in most.items()}
        self.short = ahocorasick.Automaton()
        by_text: dict[bytes, list[int]] = {}
        for i, text in enumerate(items.texts):
            if len(text) < LEAST_CHARS:
                by_text.setdefault(text, []).append(i)
        for text, numbers in by_text.items():
            self.short.add_word(f" {text.decode()} ", numbers)
        self.short.make_automaton()

    def candidates(self, text: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items and the places in the text where they would begin."""
        found_items, found_at = [], []
        for low in range(0, len(starts), WINDOWS):
            some = starts[low : low + WINDOWS]
            letters = self.walk.letters(text, some)
            by_window = np.ascontiguousarray(letters.T)
            for k, key in enumerate(self.walk.keys(letters)):
                hits = np.flatnonzero(self.tables[k].take(key >> self.shift))
                if not hits.size:
                    continue
                keys = self.items.keys[k]
                left, right = np.searchsorted(keys, key[hits], "left"), np.searchsorted(keys, key[hits], "right")
                n = right - left
                if not n.any():
                    continue
                entry = self.items.order[k][np.repeat(left - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
                window = np.repeat(hits, n)
                near = np.count_nonzero(self.items.letters[entry] == by_window[window], axis=1) >= AGREE
                entry, window = entry[near], window[near]
                found_items.append(self.items.item[entry])
                found_at.append(some[window] - self.items.start[entry])
        if not found_items:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        both = np.unique(np.stack([np.concatenate(found_items).astype(np.int64), np.concatenate(found_at)]), axis=1)
        return both[0], both[1]

    def verbatim(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """As matches, for the short items whose words stand in a row."""
        for owner, text in enumerate(texts) if len(self.short) else ():
            for item in sorted({i for _, numbers in self.short.iter(f" {text.decode()} ") for i in numbers}):
                yield owner, item, 0

    def by_pieces(self, texts: list[bytes], flat: np.ndarray, begins: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """As matches, for the items of which the pilot missed a copy."""
        text_codes = {size: codes(flat, size) for size in {p.size for levels in self.pieces.values() for p in levels}}
        for item, levels in self.pieces.items():
            pattern, most, bounds, best = self.items.texts[item], levels[0].most, (), {}
            for pieces in levels:
                bounds = pieces.stretches(text_codes[pieces.size], *bounds)
            for low, high in zip(*(b.tolist() for b in bounds), strict=True):
                # a stretch may go over the border of two texts; a window doesn't
                for owner in range(max(0, int(np.searchsorted(begins, low, "right")) - 1), int(np.searchsorted(begins[:-1], high, "left"))):
                    begin = int(begins[owner])
                    if before := best.get(owner, most + 1):
                        best[owner] = min(before, edit_distance(pattern, texts[owner][max(0, low - begin) : max(0, high - begin)], most))
            for owner, edits in best.items():
                if edits <= most:
                    yield owner, item, edits

    def matches(self, texts: list[bytes]) -> Iterator[tuple[int, int, int]]:
        """(number of the text, number of the item, least edits) of every pair within the share of edits."""
        yield from self.verbatim(texts)
        flat = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
        begins = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
        yield from self.by_pieces(texts, flat, begins)
        items, places = self.candidates(flat, word_starts(flat))
        if not items.size:
            return
        # the place where an item would begin may lie before its text's first letter; its windows' start doesn't
        lengths = np.array([len(t) for t in self.items.texts])
        middle = np.clip(places + lengths[items] // 2, 0, len(flat) - 1)
        owners = np.searchsorted(begins, middle, "right") - 1
        best: dict[tuple[int, int], int] = {}
        reach: dict[tuple[int, int], int] = {}
        for item, place, owner in zip(items.tolist(), places.tolist(), owners.tolist(), strict=True):
            pattern, text, key = self.items.texts[item], texts[owner], (owner, item)
            most = int(self.share * len(pattern))
            at = place - int(begins[owner])
            if best.get(key, most + 1) == 0 or at + most // 2 <= reach.get(key, -1 << 60):
                continue
            if text[max(at, 0) : at + len(pattern)] == pattern:
                edits = 0
            else:
                edits = edit_distance(pattern, text[max(0, at - 2 * most) : max(0, at + len(pattern) + 2 * most)], most)
                reach[key] = at + most  # windows that begin by here lie within what was just compared, up to its slack
            best[key] = min(best.get(key, most + 1), edits)
        for (owner, item), edits in best.items():
            if edits <= int(self.share * len(self.items.texts[item])):
                yield owner, item, edits


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", share: float = EDITS) -> DataFrame:
    """(id, item, edits, similarity) of every document and benchmark item of which some part of the document is within
    share x the item's characters; edits is the least found, similarity 1 - edits / characters of the item.

    Case of A-Z and runs of white space don't count. Null and empty texts and items match nothing; items under LEAST_CHARS
    match only where their words stand in a row, with no edits; rows that share an id are one document; equal items under
    two ids are both reported; null ids are ids.

    The items are a stated set of queries: they are read in blocks of bounded size, each of which goes to every task and
    costs one pass over the documents. Only matches are shuffled.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    queries = benchmark.select(F.col(item_col).alias("item"), F.col(item_text).alias("text"))
    id_type, item_type = rows.schema["id"].dataType.simpleString(), queries.schema["item"].dataType.simpleString()
    kind = f"id {id_type}, item {item_type}, edits long, similarity double"
    total = queries.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = total // ITEM_BYTES + 1
    found = []
    for k in range(passes):
        block = queries.where(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == k).collect()
        own = sorted({(r.item, plain(r.text)) for r in block}, key=lambda r: (r[0] is None, r))
        own = [(i, t) for i, t in own if t]
        if own:
            found.append(rows.mapInArrow(one_pass(spark.sparkContext.broadcast(indexed(own, share)), share, to_arrow_type(queries.schema["item"].dataType)), kind))
    if not found:
        return spark.createDataFrame([], kind)
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.groupBy("id", "item").agg(F.min("edits").alias("edits"), F.max("similarity").alias("similarity"))


def one_pass(items, share: float, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = None
        for batch in batches:
            search = search or Search(items.value, share)
            first, held, size = 0, [], 0
            for i, cell in enumerate(batch.column("text")):
                held.append(plain(cell.as_py()))
                size += len(held[-1])
                if size >= TEXT_BYTES or i + 1 == batch.num_rows:
                    if found := list(search.matches(held)):
                        who = batch.column("id").take(pa.array([first + f[0] for f in found]))
                        lengths = [len(search.items.texts[f[1]]) for f in found]
                        yield pa.RecordBatch.from_arrays(
                            [who, pa.array([search.items.ids[f[1]] for f in found], item_type), pa.array([f[2] for f in found], pa.int64()), pa.array([1 - f[2] / n for f, n in zip(found, lengths, strict=True)], pa.float64())],
                            ["id", "item", "edits", "similarity"],
                        )
                    first, held, size = i + 1, [], 0

    return run
