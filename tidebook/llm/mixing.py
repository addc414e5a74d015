"""Blocks of token ids by an adaptive context-mixing range coder.

A block is coded on its own: every table starts empty. Order 2 and order 1 predict the ids that followed the same two
ids, or the same one, most often; order 0 is the ids' frequency in the block so far. The orders' predictions are mixed
by weights that the block learns for each pair of confidences, and the mixture drives a range coder. Only whole numbers
and single IEEE operations are used, so every machine decodes what another has encoded.

A block's ids are dealt to lanes of equal length that are coded side by side and share one model, and many blocks are
coded together: one NumPy call codes an id in each lane of each block.

Layout of a block, integers little-endian: ids (u32), checksum of the ids as u32 (u32), lanes (u16), distinct ids (u32),
bytes of their list (u32), words of each lane (u16 each), the list (differences of the sorted ids, deflated), the words
(u32), and a checksum of all that (u32). Checksums are CRC-32.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

#: Ids of a block, its lanes, and the ids that a lane holds at least. More lanes than a short block can use cost bytes.
BLOCK, LANES, LEAST = 64_000, 64, 128
#: Successors remembered for one id (two ids have one), and bits of the tables that find them.
ONE, ONE_BITS, TWO_BITS = 4, 12, 14
#: Probabilities are shares of 1 << SCALE, those handed to the coder of 1 << FINE; a successor's count is halved beyond MOST.
SCALE, FINE, MOST = 16, 24, 200
#: Kinds of confidence in one order, and the votes that order 0 begins with.
KINDS, PRIOR = 8, 4
HEAD = struct.Struct("<IIHII")
TOTAL, MORE = 1 << SCALE, FINE - SCALE
#: low and range have 62 bits, words 32; a range of 30 bits or less is widened by a word.
WIDE, BITS, KEPT = 1 << 62, 32, 30
SHORT = (1 << KEPT) - 1
#: The ONE successors of an id, moved as one number.
ROW = np.complex128


class Model:
    """The state of several blocks, one lane a position of every array. Encoder and decoder change it alike."""

    def __init__(self, sizes: np.ndarray, block: np.ndarray, decoding: bool):
        n = len(sizes)
        self.one, self.two = np.zeros(n << ONE_BITS, ROW), np.zeros(n << TWO_BITS, np.uint32)
        self.votes = np.tile(np.array([1, 1, PRIOR]), (n * KINDS * KINDS, 1))
        self.base_one, self.base_two, self.base_votes = block << ONE_BITS, block << TWO_BITS, block * KINDS * KINDS
        self.sizes = sizes
        self.at = np.concatenate([[0], np.cumsum(sizes + 1)])  # where a block's ids stand in order 0; after them "not seen yet"
        self.counts, self.low, self.share = np.zeros(self.at[-1], np.int64), np.zeros(self.at[-1], np.int32), np.zeros(self.at[-1], np.int32)
        self.places = np.zeros(n << SCALE, np.uint16) if decoding else None
        self.base_zero, self.base_places, self.unseen = self.at[block], block << SCALE, sizes[block]
        self.last, self.before = np.zeros(len(block), np.int64), np.zeros(len(block), np.int64)
        sums = np.arange(ONE * (MOST + 1) + 1)
        self.kinds = np.minimum(KINDS - 1, np.ceil(np.log2(sums + 1))).astype(np.int64)
        self.kinds_two = self.kinds * KINDS
        self.inverse = (1 / np.maximum(sums, 1)).astype(np.float32)
        self.voted: list[np.ndarray] = []
        self.came: list[np.ndarray] = []
        self.recount()

    def recount(self) -> None:
        """Weights and order 0 from what has been counted. What a block hasn't seen has one share, which falls as ids repeat."""
        if self.came:
            self.votes += np.bincount(np.concatenate(self.voted), minlength=self.votes.size).reshape(self.votes.shape)
            self.counts += np.bincount(np.concatenate(self.came), minlength=self.at[-1])
            self.voted, self.came = [], []
        weights = (TOTAL * 15 / 16 - 1) * self.votes / self.votes.sum(1, keepdims=True)  # order 0 keeps a sixteenth at least
        self.weight_two, self.weight_one = weights[:, 0].astype(np.int32), weights[:, 1].astype(np.float32)
        self.weight_two.reshape(-1, KINDS, KINDS)[:, 0] = 0  # order 2 says nothing
        if not len(self.sizes):
            return
        starts, seen = self.at[:-1], self.counts > 0
        total, distinct = np.maximum(1, np.add.reduceat(self.counts, starts)), np.add.reduceat(seen, starts, dtype=np.int64)
        new = np.where(distinct < self.sizes, np.minimum(1 + TOTAL * distinct // (4 * total + 1), TOTAL - distinct), 0)
        share = seen + (self.counts * np.repeat((TOTAL - new - distinct) / total, self.sizes + 1)).astype(np.int32)
        share[self.at[1:] - 1] = new
        rest = TOTAL - np.add.reduceat(share, starts)
        for b, (start, end) in enumerate(zip(starts, self.at[1:], strict=True)):
            share[start + share[start:end].argmax()] += rest[b]
            if self.places is not None:
                self.places[b << SCALE : (b + 1) << SCALE] = np.repeat(np.arange(end - start, dtype=np.uint16), share[start:end])
        self.share = share.astype(np.int32)
        self.low = (np.cumsum(share) - share - np.repeat(np.arange(len(starts)) << SCALE, self.sizes + 1)).astype(np.int32)

    def look(self, n: int) -> None:
        """Shares of the successors for the next id of the first n lanes: the one of order 2, then those of order 1."""
        mixed = self.last[:n] * 0x9E3779B1
        self.row_one = self.base_one[:n] + ((mixed >> 7) & ((1 << ONE_BITS) - 1))
        self.row_two = self.base_two[:n] + ((mixed + self.before[:n] * 0x85EBCA77 >> 9) & ((1 << TWO_BITS) - 1))
        slots = np.empty((1 + ONE, n), np.uint32)
        slots[0], slots[1:] = self.two.take(self.row_two), self.one.take(self.row_one).view(np.uint32).reshape(n, ONE).T
        counts = (slots >> 16).view(np.int32)
        total = counts[1:].sum(0, dtype=np.int32)
        self.vote = self.base_votes[:n] + self.kinds_two.take(counts[0]) + self.kinds.take(total)
        self.slots, self.ids = slots, slots & 0xFFFF
        shares = np.empty((1 + ONE, n), np.int32)
        shares[0] = self.weight_two.take(self.vote)
        shares[1:] = counts[1:].astype(np.float32) * (self.weight_one.take(self.vote) * self.inverse.take(total))
        both = shares[1:] * (self.ids[1:] == self.ids[0])  # an id that both orders predict stands once, with both shares
        shares[0] += both.sum(0, dtype=np.int32)
        shares[1:] -= both
        self.shares, self.lows = shares, shares.copy()
        for i in range(ONE):
            self.lows[i + 1] += self.lows[i]

    def zero(self, place: np.ndarray, top: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(low, share) in fine shares of places in order 0, which has what is above top: a sixteenth at least, so none is 0."""
        left, low = TOTAL - top, self.low.take(place).astype(np.int64)
        start = low * left >> SCALE - MORE
        return (top << MORE) + start, ((low + self.share.take(place)) * left >> SCALE - MORE) - start

    def learn(self, n: int, symbol: np.ndarray, place: np.ndarray) -> None:
        """The ids that followed in the first n lanes, and where they stand in order 0."""
        small = symbol.astype(np.uint32)
        hits = (self.ids == small) & (self.slots > 0xFFFF)
        raised = self.slots + (hits.astype(np.uint32) << 16)
        small |= 1 << 16
        two, one, found = raised[0], raised[1:], hits[1:].any(0)
        self.voted.append(self.vote * 3 + np.where(hits[0], 0, 2 - found))
        self.came.append(place)
        halved = two - (two >> 17 << 16)
        self.two[self.row_two] = np.where(two >= np.where(hits[0], np.uint32(MOST << 16), np.uint32(3 << 16)), halved, np.where(hits[0], two, small))
        one[-1] = np.where(found, one[-1], small)
        for i in range(ONE - 1, 0, -1):
            upper = np.maximum(one[i - 1], one[i])
            np.minimum(one[i - 1], one[i], out=one[i])
            one[i - 1] = upper
        full = np.flatnonzero(one[0] >= MOST << 16)
        if len(full):
            one[:, full] = (one[:, full] >> 17 << 16) | (one[:, full] & 0xFFFF)
        self.one[self.row_one] = np.ascontiguousarray(one.T).view(ROW)[:, 0]
        self.before[:n] = self.last[:n]
        self.last[:n] = symbol + 1


def due(step: int) -> bool:
    """Whether order 0 and the weights are counted anew after this many steps."""
    return step & (step - 1) == 0 or step % 128 == 0


class Lanes:
    """How the ids of blocks are dealt: long lanes first, so those that still run at a step are the first ones."""

    def __init__(self, sizes: Sequence[int]):
        shapes = [self.shape(n) for n in sizes]
        block = np.repeat(np.arange(len(sizes)), [s[0] for s in shapes]).astype(np.int64)
        nth = np.concatenate([np.arange(s[0]) for s in shapes] or [[]]).astype(np.int64)
        step = np.array([s[1] for s in shapes], np.int64)
        lengths = np.minimum(step[block], np.array(sizes, np.int64)[block] - nth * step[block]) if len(block) else nth
        self.order = np.argsort(-lengths, kind="stable")
        self.block, self.lengths, self.starts = block[self.order], lengths[self.order], (nth * step[block])[self.order] if len(block) else nth
        self.steps = int(lengths.max(initial=0))
        self.running = len(lengths) - np.searchsorted(self.lengths[::-1], np.arange(self.steps), "right")

    @staticmethod
    def shape(n: int) -> tuple[int, int]:
        """Lanes of a block of n ids, and ids of a lane but the last one."""
        if not n:
            return 0, 0
        length = -(-n // max(1, min(LANES, n // LEAST)))
        return -(-n // length), length


class Encoder:
    """Range coders side by side. A carry out of low goes into the words already written; a lane's words stand below each other."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.range = np.zeros(lanes, np.int64), np.full(lanes, WIDE, np.int64)
        self.words, self.n = np.zeros((2 * steps + 4, lanes), np.uint32), np.zeros(lanes, np.int64)

    def code(self, lanes: slice | np.ndarray, low: np.ndarray, share: np.ndarray) -> None:
        unit = self.range[lanes] >> FINE
        bottom, width = self.low[lanes] + unit * low, unit * share
        over = np.flatnonzero(bottom >= WIDE)
        if len(over):
            bottom[over] -= WIDE
            self.carry(over if isinstance(lanes, slice) else lanes[over])
        short = np.flatnonzero(width <= SHORT)
        if len(short):
            at, low = short if isinstance(lanes, slice) else lanes[short], bottom[short]
            n = self.n[at]
            self.words[n, at] = low >> KEPT
            self.n[at] = n + 1
            bottom[short] = (low & SHORT) << BITS
            width[short] <<= BITS
        self.low[lanes], self.range[lanes] = bottom, width

    def carry(self, lanes: np.ndarray) -> None:
        at = self.n[lanes] - 1
        while len(lanes):
            self.words[at, lanes] += np.uint32(1)
            more = self.words[at, lanes] == 0
            lanes, at = lanes[more], at[more] - 1

    def close(self) -> None:
        """One word more settles each lane; the decoder reads zeros after it."""
        self.low += SHORT
        over = np.flatnonzero(self.low >= WIDE)
        self.low[over] -= WIDE
        self.carry(over)
        self.words[self.n, np.arange(len(self.n))] = self.low >> KEPT
        self.n += 1
        self.words = np.ascontiguousarray(self.words[: self.n.max(initial=0)].T)


class Decoder:
    """The other side; rest is what the words say beyond low."""

    def __init__(self, words: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        self.words, self.at, self.ends = words, starts, ends
        every = np.arange(len(starts))
        first, second = self.next(every), self.next(every)
        self.rest, self.range = (first << KEPT) | (second >> BITS - KEPT), np.full(len(starts), WIDE, np.int64)
        self.spare = second & 3  # bits of the last word read that rest has no room for yet

    def next(self, lanes: np.ndarray) -> np.ndarray:
        at = self.at[lanes]
        self.at[lanes] = at + 1
        return np.where(at < self.ends[lanes], self.words.take(np.minimum(at, len(self.words) - 1)), 0).astype(np.int64)

    def target(self, lanes: slice | np.ndarray) -> np.ndarray:
        """The quotient of rest and unit. Rounding may miss it by one, which the remainder shows."""
        unit, rest = self.range[lanes] >> FINE, self.rest[lanes]
        found = (rest / unit).astype(np.int64)
        left = rest - found * unit
        found += left >= unit
        found -= left < 0
        self.unit = unit
        return np.minimum(found, (1 << FINE) - 1)

    def take(self, lanes: slice | np.ndarray, low: np.ndarray, share: np.ndarray) -> None:
        rest, width = self.rest[lanes] - self.unit * low, self.unit * share
        short = np.flatnonzero(width <= SHORT)
        if len(short):
            at = short if isinstance(lanes, slice) else lanes[short]
            word = self.next(at)
            rest[short] = (rest[short] << BITS) | (self.spare[at] << KEPT) | (word >> BITS - KEPT)
            self.spare[at] = word & 3
            width[short] <<= BITS
        self.rest[lanes], self.range[lanes] = rest, width


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def packed_list(ids: np.ndarray) -> bytes:
    return zlib.compress(np.diff(ids, prepend=0).astype("<u4").tobytes(), 6)


def unpacked_list(raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(raw), "<u4").astype(np.int64))


def listed(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids of a block, ascending, and each id's place among them."""
    if not len(ids) or ids.max() >= 4 * BLOCK:
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(4 * BLOCK, bool)  # small ids need no sort
    seen[ids] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.uint16) - np.uint16(1))[ids]


def encode(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """Each block of up to BLOCK ids (whole numbers below 2**32), coded together but each by itself. An empty block has no lane."""
    if not len(blocks):
        return []
    lists, local = zip(*(listed(np.asarray(b, np.int64)) for b in blocks), strict=True)
    lanes = Lanes([len(b) for b in blocks])
    ids = np.zeros((len(lanes.block), lanes.steps), np.uint16)
    for lane, (k, start, length) in enumerate(zip(lanes.block, lanes.starts, lanes.lengths, strict=True)):
        ids[lane, :length] = local[k][start : start + length]
    ids = np.ascontiguousarray(ids.T)
    model, coder = Model(np.array([len(x) for x in lists], np.int64), lanes.block, False), Encoder(len(lanes.block), lanes.steps)
    for step, n in enumerate(lanes.running):
        symbol = ids[step, :n].astype(np.int64)
        model.look(n)
        hit = (model.ids == symbol.astype(np.uint32)) & (model.shares > 0)  # one place at most
        share, top = (model.shares * hit).sum(0, dtype=np.int64), model.lows[-1].astype(np.int64)
        low, missed = (model.lows * hit).sum(0, dtype=np.int64) - share, share == 0
        place = model.base_zero[:n] + symbol
        spelled = np.flatnonzero(missed & (model.share.take(place) == 0))
        coded = place
        if len(spelled):
            coded = place.copy()
            coded[spelled] = model.base_zero[spelled] + model.unseen[spelled]
        below, width = model.zero(coded, top)
        coder.code(slice(0, n), np.where(missed, below, low << MORE), np.where(missed, width, share << MORE))
        if len(spelled):
            coder.code(spelled, symbol[spelled] << MORE, np.full(len(spelled), 1 << MORE))
        model.learn(n, symbol, place)
        if due(step + 1):
            model.recount()
    coder.close()
    out, place = [], np.argsort(lanes.order)
    ends = np.searchsorted(np.sort(lanes.block), np.arange(len(blocks) + 1))
    for k, block in enumerate(blocks):
        here, names = place[ends[k] : ends[k + 1]], packed_list(lists[k])
        body = HEAD.pack(len(block), checksum(np.asarray(block)), len(here), len(lists[k]), len(names)) + coder.n[here].astype("<u2").tobytes() + names
        body += b"".join(coder.words[lane, : coder.n[lane]].astype("<u4").tobytes() for lane in here)
        out.append(body + struct.pack("<I", zlib.crc32(body)))
    return out


def decode(blocks: Sequence[bytes]) -> list[np.ndarray]:
    """The ids of each block. A block that doesn't have its checksums is an error."""
    if not len(blocks):
        return []
    heads, lists, words, counts = [], [], [], []
    for raw in blocks:
        if len(raw) < HEAD.size + 4 or struct.unpack("<I", raw[-4:])[0] != zlib.crc32(memoryview(raw)[:-4]):
            raise ValueError("a block of ids is damaged")
        n, check, own, _, size = HEAD.unpack_from(raw)
        start = HEAD.size + 2 * own
        counts.append(np.frombuffer(raw, "<u2", own, HEAD.size).astype(np.int64))
        lists.append(unpacked_list(raw[start : start + size]))
        words.append(np.frombuffer(raw, "<u4", int(counts[-1].sum()), start + size))
        heads.append((n, check))
    lanes = Lanes([n for n, _ in heads])
    ends = np.cumsum(np.concatenate(counts))
    starts = ends - np.concatenate(counts)
    model = Model(np.array([len(x) for x in lists], np.int64), lanes.block, True)
    coder = Decoder(np.concatenate([*words, np.zeros(1, np.uint32)]), starts[lanes.order], ends[lanes.order])
    ids = np.zeros((lanes.steps, len(lanes.block)), np.uint16)
    for step, n in enumerate(lanes.running):
        now = slice(0, n)
        model.look(n)
        target, top = coder.target(now), model.lows[-1].astype(np.int64)
        slot = (model.lows <= (target >> MORE).astype(np.int32)).view(np.uint8).sum(0, dtype=np.uint8)
        missed = slot == 1 + ONE
        at = np.where(missed, ONE, slot).astype(np.int64) * n + np.arange(n)
        share, low = model.shares.reshape(-1).take(at).astype(np.int64), model.lows.reshape(-1).take(at)
        # the last share of order 0 that begins at the target or before it
        beyond = np.maximum(0, target - (top << MORE)) + 1
        nth = (((beyond << SCALE - MORE) - 1) / (TOTAL - top)).astype(np.int64)  # below 2**34, so rounding doesn't reach the next whole number
        found = model.places.take(model.base_places[:n] + np.minimum(nth, TOTAL - 1))
        symbol = np.where(missed, found, model.ids.reshape(-1).take(at)).astype(np.int64)
        place = model.base_zero[:n] + symbol
        below, width = model.zero(place, top)
        coder.take(now, np.where(missed, below, low - share << MORE), np.where(missed, width, share << MORE))
        spelled = np.flatnonzero(missed & (symbol == model.unseen[:n]))
        if len(spelled):
            symbol[spelled] = coder.target(spelled) >> MORE
            coder.take(spelled, symbol[spelled] << MORE, np.full(len(spelled), 1 << MORE))
            place[spelled] = model.base_zero[spelled] + symbol[spelled]
        ids[step, :n] = symbol
        model.learn(n, symbol, place)
        if due(step + 1):
            model.recount()
    found = [np.zeros(n, np.uint32) for n, _ in heads]
    for lane, (k, start, length) in enumerate(zip(lanes.block, lanes.starts, lanes.lengths, strict=True)):
        found[k][start : start + length] = lists[k][ids[:length, lane]]
    for (_, check), block in zip(heads, found, strict=True):
        if checksum(block) != check:
            raise ValueError("a block of ids is damaged")
    return found
