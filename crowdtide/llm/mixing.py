"""Logistic context mixing over bytes, on whole arrays.

The next byte is coded as binary decisions: five choose one of 31 bytes common in Latin text, or else the escape, after
which eight spell the byte. Each predictor keeps counts of zeros and ones per (context, decisions so far), hashed into a
table of fixed size: orders 0 to 4, and the letters of the word so far. A prediction enters the mixer
as ln(ones/zeros), which is near 0 where little is known. The mixer adds predictions by weights; which weights is gated by
the decision's place and by how much the two longest contexts have seen. A last stage corrects the mixed
probability by what came true at that probability and decision before.

Texts are processed in blocks. Within a block, equal (contexts, byte) are handled once, with their number. Learning is
online, in steps of ``STEP`` bytes whatever a task holds: a step is predicted before its counts enter the tables, and
weights move once after it.

The decisions of a context lie together in its table. Rows are sorted by byte and then backwards through the text, so
those that agree in a short context lie in a run, and its counts are read, turned into logarithms and added to once.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import copy
from typing import NamedTuple

import numpy as np

from crowdtide.llm.arrays import BYTE_VALUES, LOWER, SOLID, _power_table, mix

#: Bytes of text in a block that is scored, and in a piece that is cut into steps; a longer text is one of its own.
BLOCK, PIECE = (1 << 19) - (1 << 15), 1 << 17
#: Bytes and ends of text learned from in one step.
STEP = 1 << 15
#: Place in the byte stream before, between and after texts. No UTF-8 text holds it.
END = 255
PAD = 4

#: The bytes that five decisions spell; any order gives a proper code, this one a short one.
COMMON = b" etaoinshrdlucmfgypwbvkqj.,-\n\xc3" + bytes([END])
FIRST, SPELLED = 5, 8
PLACES, NODES = FIRST + SPELLED, 512

#: Node and outcome of every decision of every byte; a common byte has the first five only.
NODE, BIT = np.zeros((256, PLACES), np.int64), np.zeros((256, PLACES), np.int64)
RARE = ~np.isin(np.arange(256), list(COMMON))
_rank = np.full(256, len(COMMON))
_rank[list(COMMON)] = np.arange(len(COMMON))
for _t in range(FIRST):
    NODE[:, _t] = (1 << _t) | (_rank >> (FIRST - _t))
    BIT[:, _t] = (_rank >> (FIRST - 1 - _t)) & 1
for _t in range(SPELLED):
    NODE[:, FIRST + _t] = 256 | (1 << _t) | (np.arange(256) >> (SPELLED - _t))
    BIT[:, FIRST + _t] = (np.arange(256) >> (SPELLED - 1 - _t)) & 1

TABLE_BITS = (9, 17, 19, 20, 21, 22)
STARTS = np.concatenate(([0], np.cumsum([1 << b for b in TABLE_BITS]))).astype(np.int64)
N_SLOTS = int(STARTS[-1])
N_INPUTS = len(TABLE_BITS)
WORD_GATES, LONG_GATES, CELLS = 4, 3, 32
N_SETS = PLACES * WORD_GATES * LONG_GATES
#: Counts a context must have exceeded for the next gate: order 4, the word.
LEAST = ((0, 10), (0, 3, 30))
_GOLD = np.uint64(0x9E3779B97F4A7C15)
PRIOR = 0.4
#: Distinct rows handled at a time.
PART = 1 << 15


class Leg(NamedTuple):
    """Places decided together; arrays by byte and place."""

    count_at: np.ndarray  # where an outcome's count lies from its context's place, in single counts
    came_at: np.ndarray  # first place of an outcome's corrections, in single counts
    bit: np.ndarray
    sets: np.ndarray  # first set of weights of every place

    @classmethod
    def of(cls, places: slice) -> Leg:
        node, bit = np.ascontiguousarray(NODE[:, places]), np.ascontiguousarray(BIT[:, places])
        return cls(node * 2 + bit, node * 2 * CELLS + bit, bit.astype(np.float32), np.arange(PLACES)[places] * (WORD_GATES * LONG_GATES))


#: What every byte decides, and what rare bytes decide after it.
EVERY, SPELL = Leg.of(slice(0, FIRST)), Leg.of(slice(FIRST, PLACES))
#: Predictors (orders 0 to 3) whose rows come in runs.
IN_RUNS = 4
FOLDED, OUTSIDE = BYTE_VALUES[LOWER], ~SOLID
OUTSIDE[END] = True


class Places:
    """Contexts and byte of every place of some texts: all bytes and one end of every text."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n_docs = len(offsets) - 1
        sizes = np.diff(offsets)
        n = len(data) + PAD * (n_docs + 1)
        stream = np.full(n, END, np.uint8)
        self.doc = np.repeat(np.arange(n_docs), sizes + 1)
        at = np.arange(len(self.doc)) + (PAD - 1) * self.doc + PAD
        inner = np.ones(len(at), bool)
        inner[offsets[1:] + np.arange(n_docs)] = False
        stream[at[inner]] = data

        power, inverse = _power_table(n + 1)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(FOLDED.take(stream) * power[:n], out=total[1:])
        start = np.arange(n)
        start[1:] *= OUTSIDE.take(stream[:-1])
        np.maximum.accumulate(start, out=start)
        start = start.take(at)
        self.word = (total.take(at) - total.take(start)) * inverse.take(start)
        wide = stream.astype(np.uint64)
        recent = wide[3:-1] | wide[2:-2] << np.uint64(8) | wide[1:-3] << np.uint64(16) | wide[:-4] << np.uint64(24)
        self.recent, self.byte = recent.take(at - PAD), wide.take(at)
        self.key = (mix(self.word + self.recent * _GOLD) & ~np.uint64(255)) | self.byte
        self.rank = self._rank()

    def _rank(self) -> np.ndarray:
        """What rows are sorted by: the byte, the three before it, the nearest first, and bits of the key."""
        recent = self.recent
        text = self.byte << np.uint64(24) | (recent & np.uint64(0xFF)) << np.uint64(16) | recent & np.uint64(0xFF00) | recent >> np.uint64(16) & np.uint64(0xFF)
        return text << np.uint64(32) | self.key >> np.uint64(32)


class Block:
    """The distinct (contexts, byte) of some texts, and where they occur."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        places = Places(data, offsets)
        self.doc, self.n_docs = places.doc, len(offsets) - 1
        self._gather(places, slice(None))

    @classmethod
    def of(cls, places: Places, part: slice) -> Block:
        """The block of some places, in order."""
        out = cls.__new__(cls)
        out._gather(places, part)
        return out

    def _gather(self, places: Places, part: slice) -> None:
        key, rank = places.key[part], places.rank[part]
        # the place takes the low bits of the rank: sorting values is several times faster than sorting places by them
        low = np.uint64(len(key).bit_length())
        order = (np.sort(rank >> low << low | np.arange(len(key), dtype=np.uint64)) & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
        ranked = key.take(order)
        first = np.ones(len(key), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        self.which = np.empty(len(key), np.int64)
        self.which[order] = np.cumsum(first) - 1
        starts = np.flatnonzero(first)
        lead = order.take(starts)
        self.key, self.rank = ranked.take(starts), rank.take(lead)
        self.count = np.diff(np.append(starts, len(key))).astype(np.float64)
        self.byte = places.byte[part].take(lead).astype(np.int64)
        self.word, self.recent = mix(places.word[part].take(lead)), places.recent[part].take(lead)

    def only(self, rows: np.ndarray) -> Block:
        """The given distinct rows alone."""
        out = copy(self)
        for name in ("key", "rank", "count", "byte", "word", "recent"):
            setattr(out, name, getattr(self, name)[rows])
        return out

    @staticmethod
    def merged(blocks: list[Block]) -> Block:
        """The distinct rows of all blocks, without places."""
        if len(blocks) == 1:
            return blocks[0]
        out = copy(blocks[0])
        key, rank = (np.concatenate([getattr(b, c) for b in blocks]) for c in ("key", "rank"))
        order = np.argsort(rank)
        ranked = key[order]
        first = np.ones(len(key), bool)
        first[1:] = ranked[1:] != ranked[:-1]
        lead = order[first]
        out.key, out.rank = ranked[first], rank[lead]
        out.count = np.add.reduceat(np.concatenate([b.count for b in blocks])[order], np.flatnonzero(first))
        out.byte, out.word, out.recent = (np.concatenate([getattr(b, c) for b in blocks])[lead] for c in ("byte", "word", "recent"))
        return out

    def runs(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For orders 0 to 3: the first row of every run of equal (context, byte), the run of every row, its place in the table."""
        change = np.ones(len(self.byte), bool)
        change[1:] = self.byte[1:] != self.byte[:-1]
        for k in range(IN_RUNS):
            if k:
                before = self.recent >> np.uint64(8 * (k - 1)) & np.uint64(0xFF)
                change[1:] |= before[1:] != before[:-1]
            first = np.flatnonzero(change)
            yield first, np.cumsum(change) - 1, base(k, self.recent[first] & np.uint64((1 << 8 * k) - 1))

    def rows(self) -> Iterator[np.ndarray]:
        """For order 4 and the word: the place of every row in the table."""
        yield base(4, self.recent)
        yield base(5, self.word)

    def legs(self) -> Iterator[tuple[Leg, np.ndarray | slice, Block]]:
        """Places decided together, the rows that decide there, and their block."""
        yield EVERY, slice(None), self
        rare = np.flatnonzero(RARE[self.byte])
        if len(rare):
            yield SPELL, rare, self.only(rare)


def base(j: int, context: np.ndarray) -> np.ndarray:
    """Where a context's counts lie: the one of decision d and outcome b at this place exclusive-or 2 * d + b."""
    if j < 2:
        slot = context << np.uint64(9)
    else:
        slot = (context if j == N_INPUTS - 1 else mix(context + np.uint64(j << 40))) >> np.uint64(64 - TABLE_BITS[j])
    return (slot.astype(np.int64) + STARTS[j]) << 1


def _share(odds: np.ndarray) -> np.ndarray:
    """Probability of a 1 from log odds."""
    p = np.exp(-odds)
    p += 1
    return np.reciprocal(p, out=p)


class Model:
    def __init__(self):
        self.counts = np.zeros((N_SLOTS, 2), np.float32)
        self.weights = np.full((N_SETS, N_INPUTS), 0.3)
        self.squares = np.zeros((N_SETS, N_INPUTS))
        self.used = np.zeros(N_SETS)
        self.came = np.zeros((NODES, CELLS, 2))

    def decide(self, block: Block, leg: Leg) -> tuple:
        """By row and place: log odds mixed, those of each predictor, the weights' set, the cell; by predictor, where its counts are."""
        path = leg.count_at.take(block.byte, axis=0)
        pairs = self.counts.view(np.int64)[:, 0]  # both counts of a slot in one read
        x = np.empty((N_INPUTS, *path.shape), np.float32)
        found: list[tuple] = []
        for j, (first, run, start) in enumerate(block.runs()):
            at = start[:, None] ^ path.take(first, axis=0)
            np.take(self._odds(pairs.take(at >> 1)), run, axis=0, out=x[j], mode="clip")
            found.append((first, at))
        gates = []
        for j, start in enumerate(block.rows(), IN_RUNS):
            at = start[:, None] ^ path
            c = pairs.take(at >> 1)
            both = c.view(np.float32)
            seen = both[:, ::2] + both[:, 1::2]
            gates.append(sum((seen > least).view(np.int8) for least in LEAST[j - IN_RUNS]))
            x[j] = self._odds(c)
            found.append((None, at))
        chosen = gates[1] * np.int8(LONG_GATES) + gates[0] + leg.sets
        weights = self.weights.T.astype(np.float32)
        mixed, more = np.empty_like(x[0]), np.empty_like(x[0])
        np.multiply(np.take(weights[0], chosen, out=mixed, mode="clip"), x[0], out=mixed)
        for j in range(1, N_INPUTS):
            mixed += np.multiply(np.take(weights[j], chosen, out=more, mode="clip"), x[j], out=more)
        np.clip(mixed, -12, 12, out=mixed)
        np.multiply(mixed + 12, np.float32(CELLS / 24), out=more)
        cell = np.minimum(more, CELLS - 1, out=more).astype(np.int64)
        return mixed, x, chosen, cell, found

    @staticmethod
    def _odds(pairs: np.ndarray) -> np.ndarray:
        c = pairs.view(np.float32) + np.float32(PRIOR)
        odds = c[:, 1::2] / c[:, ::2]
        return np.log(odds, out=odds)

    def learn(self, block: Block, rate: float = 0.03) -> None:
        """Part by part: predict, move the weights a step, then count."""
        flat, came = self.counts.reshape(-1), self.came.reshape(-1)
        for start in range(0, len(block.byte), PART):
            part = block.only(slice(start, start + PART))
            step, size = np.zeros((N_SETS, N_INPUTS)), np.zeros(N_SETS)
            kept: list[tuple] = []
            for leg, _, rows in part.legs():
                mixed, x, chosen, cell, found = self.decide(rows, leg)
                times = np.broadcast_to(rows.count.astype(np.float32)[:, None], mixed.shape)
                wrong = (leg.bit.take(rows.byte, axis=0) - _share(mixed)) * times
                chosen = chosen.reshape(-1)
                for j in range(N_INPUTS):
                    step[:, j] += np.bincount(chosen, np.multiply(wrong, x[j], out=x[j]).reshape(-1), minlength=N_SETS)
                size += np.bincount(chosen, times.reshape(-1), minlength=N_SETS)
                cell *= 2
                cell += leg.came_at.take(rows.byte, axis=0)
                kept.append((rows.count, found, cell))
            step /= np.maximum(size, 1)[:, None]
            self.squares += step * step
            self.weights += rate * step / np.sqrt(self.squares + 1e-8)
            self.used += size
            for count, found, cell in kept:
                for first, at in found:
                    own = count if first is None else np.add.reduceat(count, first)
                    np.add.at(flat, at.reshape(-1), np.broadcast_to(own.astype(np.float32)[:, None], at.shape).reshape(-1))
                came += np.bincount(cell.reshape(-1), np.broadcast_to(count[:, None], cell.shape).reshape(-1), minlength=len(came))

    def log10(self, block: Block) -> np.ndarray:
        """log10 probability of every distinct (contexts, byte)."""
        out = np.zeros(len(block.byte))
        share = self.came.reshape(-1, 2).sum(axis=1) + 20
        known, open_ = (self.came.reshape(-1, 2)[:, 1] / share).astype(np.float32), (20 / share).astype(np.float32)
        for start in range(0, len(out), PART):
            part, total = block.only(slice(start, start + PART)), out[start : start + PART]
            for leg, which, rows in part.legs():
                mixed, _, _, cell, _ = self.decide(rows, leg)
                cell += leg.came_at.take(rows.byte, axis=0) // (2 * CELLS) * CELLS
                p = _share(mixed)
                final = np.clip(0.5 * p + 0.5 * (known.take(cell) + p * open_.take(cell)), 1e-6, 1 - 1e-6)
                total[which] += np.log10(np.where(leg.bit.take(rows.byte, axis=0) == 1, final, 1 - final).prod(axis=1, dtype=np.float64))
        return out

    def learn_all(self, texts: Iterator[tuple[np.ndarray, np.ndarray]]) -> Model:
        """Learn from (bytes, offsets) in steps of ``STEP`` places, however the texts are cut into pieces."""
        waiting: list[Block] = []
        free = STEP
        for data, offsets in texts:
            places = Places(data, offsets)
            n, start = len(places.key), 0
            while start < n:
                end = min(start + free, n)
                waiting.append(Block.of(places, slice(start, end)))
                free -= end - start
                start = end
                if not free:
                    self.learn(Block.merged(waiting))
                    waiting, free = [], STEP
        if waiting:
            self.learn(Block.merged(waiting))
        return self

    # --- exchange of what tasks have learned ---

    def cells(self) -> np.ndarray:
        """Everything that adds up over tasks, as (cells, 2): counts, corrections, and weights by use with their use."""
        weighted = np.stack([(self.weights * self.used[:, None]).reshape(-1), np.repeat(self.used, N_INPUTS)], axis=1)
        return np.concatenate((self.counts, self.came.reshape(-1, 2).astype(np.float32), weighted.astype(np.float32)))

    @classmethod
    def of(cls, cells: np.ndarray) -> Model:
        out = cls()
        out.counts[:] = cells[:N_SLOTS]
        out.came.reshape(-1, 2)[:] = cells[N_SLOTS : N_SLOTS + NODES * CELLS]
        total, used = cells[N_SLOTS + NODES * CELLS :].T.astype(np.float64)
        out.weights.reshape(-1)[used > 0] = total[used > 0] / used[used > 0]
        return out


N_CELLS = N_SLOTS + NODES * CELLS + N_SETS * N_INPUTS


class Memo:
    """log10 probabilities under a finished model, each distinct (contexts, byte) worked out once per worker.

    Known rows are kept sorted by rank, with other bits of their key to tell them by; new ones wait in a short list that is
    merged now and then. At ``LIMIT`` rows all are forgotten, so memory is bounded and only time depends on what is kept.
    """

    LIMIT, WAITING = 1 << 21, 1 << 17

    def __init__(self, model: Model):
        self.model = model
        self.tiers = [self._none()] * 2

    @staticmethod
    def _none() -> tuple:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.float32)

    def log10(self, block: Block) -> np.ndarray:
        out = np.zeros(len(block.key), np.float32)
        missing = np.ones(len(block.key), bool)
        check = block.key.astype(np.uint32)
        for ranks, checks, values in self.tiers:
            if len(ranks):
                at = np.minimum(np.searchsorted(ranks, block.rank), len(ranks) - 1)
                hit = (ranks[at] == block.rank) & (checks[at] == check)
                out[hit] = values[at[hit]]
                missing &= ~hit
        new = np.flatnonzero(missing)
        if len(new):
            out[new] = self.model.log10(block.only(new))
            self.tiers[1] = self._merged(self.tiers[1], (block.rank[new], check[new], out[new]))
            if len(self.tiers[1][0]) > self.WAITING:
                both = len(self.tiers[0][0]) + len(self.tiers[1][0])
                self.tiers[0] = self._merged(*self.tiers) if both <= self.LIMIT else self.tiers[1]
                self.tiers[1] = self._none()
        return out

    @staticmethod
    def _merged(a: tuple, b: tuple) -> tuple:
        parts = [np.concatenate(x) for x in zip(a, b, strict=True)]
        order = np.argsort(parts[0], kind="stable")
        return tuple(x[order] for x in parts)
