"""Language-model scores by online logistic mixing of hashed-context bit predictors."""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm.common import arrow_rows, by_bytes, table
from weftgraph.llm.langid import held_out
from weftgraph.llm.quality import _mixed, _powers
from weftgraph.plans.lineage import stored

_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Contexts of the corpus: the last so many bytes, and the word so far, hashed to so many bits each.
ORDERS = (2, 3, 4, 6)
CONTEXTS = (13, 15, 17, 17, 17)
#: Symbols: END closes a text, ESC stands for a rare byte and is followed by its 8 bits.
SYMBOLS, END, ESC = 64, 62, 63
NEWLINE = 10  # closes a text in a buffer; no word holds it
LEAD = 6  # bytes before each piece, so that contexts never reach another text
PIECE = 1 << 20  # bytes of a text that are worked on together
LANE = 2048  # bytes that are coded one after the other; the lanes of many texts run side by side
#: Bits of a lane that are laid out together; a lane is filled up to a multiple with idle ones.
STEPS = 64
IDLE = 63  # no node of the code
GATES = 16
#: The predictors that learn in the lane itself look at so many bytes before, hashed to SLOTS.
OWN = (1, 3)
SLOTS = 4096
#: Words with at least 1 / FREQUENT of all tokens are sent to every task, FREQUENT at most.
FREQUENT = 1 << 20
END_WORD = 1  # the hash that the end of a text is counted under
CHUNK = 1 << 19
ROWS = 500  # texts that a task gets at a time
BYTES = 1 << 20  # of texts whose lanes run together, more or less; they take about 100 bytes for each
PART = 1 << 15  # of those, what is looked up together
ALIKE = 1 << 21  # bytes whose equal contexts are looked up once; finding them takes about 50 bytes for each


def normal(text: str | None) -> bytes:
    """The text's words in lower case, a space between."""
    return b" ".join((text or "").encode("utf-8", "replace").translate(_LOWER).split())


def pieces(text: bytes) -> list[tuple[bytes, bytes]]:
    """A normal text in pieces of about PIECE bytes that end with a word, each with the LEAD bytes
    before it. The last one ends with a newline, the sign of the text's end."""
    at, found, text = 0, [], b"\n" * LEAD + text + b"\n"
    while at < len(text) - LEAD:
        end = text.find(b" ", at + LEAD + PIECE) + 1 if len(text) - LEAD - at > PIECE else 0
        end = (end or len(text)) - LEAD
        found.append((text[at : at + LEAD], text[at + LEAD : end + LEAD]))
        at = end
    return found


class Buffer:
    """Several pieces in one array: contexts of every byte, and hashes of all words."""

    def __init__(self, some: list[tuple[bytes, bytes]]) -> None:
        self.bytes = np.frombuffer(b"".join([part for piece in some for part in piece]), np.uint8)
        self.sizes = sizes = np.array([len(body) for _, body in some], np.int64)
        self.starts = np.cumsum(sizes + LEAD) - sizes
        b = self.bytes.astype(np.uint64)
        power, inverse = _powers(len(b) + 1)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b + np.uint64(1)) * power[: len(b)], out=sums[1:])
        gap = (self.bytes == 32) | (self.bytes == NEWLINE)
        begins = np.zeros(len(b), bool)  # a piece begins with a word, whatever its lead is
        begins[self.starts] = True
        self.word_start = np.zeros(len(b), np.int64)  # of the word that a byte is in or ends
        self.word_start[1:] = np.where(gap[:-1] | begins[1:], np.arange(1, len(b)), 0)
        np.maximum.accumulate(self.word_start, out=self.word_start)
        self.prefix = _mixed((sums[:-1] - sums[self.word_start]) * inverse[self.word_start])
        lead = np.zeros(len(b) + 1, np.int64)
        lead[self.starts - LEAD] += 1
        lead[self.starts] -= 1
        self._last: np.ndarray | None = None
        self.ends = np.flatnonzero(gap & (self.word_start < np.arange(len(b))) & (np.cumsum(lead)[:-1] == 0))

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all words, and the piece of each."""
        return self.prefix[self.ends].view(np.int64), np.searchsorted(self.starts, self.ends, side="right") - 1

    def hashed(self, order: int) -> np.ndarray:
        """A hash of the `order` bytes (8 at most) before each byte."""
        if self._last is None:
            padded = np.concatenate([np.zeros(8, np.uint8), self.bytes])
            self._last = np.ndarray(len(self.bytes), "<u8", padded, strides=(1,)).astype(np.uint64)
        return (self._last >> np.uint64(64 - 8 * order)) * np.uint64(0x9E3779B97F4A7C15)

    def contexts(self, at: np.ndarray) -> Iterator[np.ndarray]:
        """Of each byte in `at`: the hashed contexts that it stands in."""
        for order, bits in zip(ORDERS, CONTEXTS):
            yield (self.hashed(order)[at] >> np.uint64(64 - bits)).view(np.int64)
        yield (self.prefix[at] >> np.uint64(64 - CONTEXTS[-1])).view(np.int64)


class Code:
    """A prefix code for bytes from their counts: frequent bytes take few binary decisions."""

    def __init__(self, counts: np.ndarray) -> None:
        order = [b for b in np.argsort(-counts, kind="stable") if b != NEWLINE][:END]
        self.symbol = np.full(256, ESC, np.uint8)
        self.symbol[order] = np.arange(END)
        self.symbol[NEWLINE] = END
        weight = np.concatenate([counts[order], counts[[NEWLINE]], [counts.sum() - counts[order].sum() - counts[NEWLINE]]]) + 1.0
        heap = [(w, s) for s, w in enumerate(weight)]
        heapq.heapify(heap)
        sides = []
        while len(heap) > 1:
            (wa, a), (wb, b) = heapq.heappop(heap), heapq.heappop(heap)
            heapq.heappush(heap, (wa + wb, SYMBOLS + len(sides)))
            sides.append((a, b))
        paths: list[list[tuple[int, int]]] = [[] for _ in range(SYMBOLS)]
        todo: list[tuple[int, list[tuple[int, int]]]] = [(heap[0][1], [])]
        while todo:
            node, path = todo.pop()
            if node < SYMBOLS:
                paths[node] = path
            else:
                inner = node - SYMBOLS
                todo += [(sides[inner][bit], [*path, (inner, bit)]) for bit in (0, 1)]
        self.length = np.array([len(p) for p in paths])
        self.start = np.cumsum(np.append(0, self.length))  # the last one is that of idle bits
        flat = np.array([step for p in paths for step in p] + [(IDLE, 0)] * STEPS)
        self.node, self.bit = flat[:, 0].astype(np.uint8), flat[:, 1].astype(np.uint8)
        self.way = np.where(self.node == IDLE, 0, 2 * flat[:, 1] - 1).astype(np.int8)
        self.under = np.zeros((2, SYMBOLS, SYMBOLS))  # of each symbol: nodes it passes, and those it leaves by bit 1
        for s, p in enumerate(paths):
            for node, bit in p:
                self.under[0, s, node] = 1
                self.under[1, s, node] = bit


#: A packed byte says how often a node was left by bit 0 and by bit 1: exactly if neither is above
#: FEW, else by one of three levels of how often it was passed and the log odds in ODDS steps.
FEW, ODDS = 6, 69
_EXACT = (FEW + 1) ** 2


def pack(cells: np.ndarray, code: Code) -> np.ndarray:
    """Packed bytes of the nodes of each context from its symbol counts (contexts, SYMBOLS)."""
    passed, ones = cells @ code.under[0], cells @ code.under[1]
    zeros = passed - ones
    odds = np.clip(np.log((ones + 0.4) / (zeros + 0.4)), -8, 8)
    many = _EXACT + np.searchsorted([32, 256], passed, side="right") * ODDS + np.round((odds + 8) * ((ODDS - 1) / 16))
    return np.where((zeros <= FEW) & (ones <= FEW), zeros * (FEW + 1) + ones, many).astype(np.uint8)


def _unpacked() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    zeros, ones = np.divmod(np.arange(_EXACT), FEW + 1)
    stretch = np.r_[np.log((ones + 0.4) / (zeros + 0.4)), np.tile(np.arange(ODDS) * (16 / (ODDS - 1)) - 8, 3)].astype(np.float32)
    level = np.r_[np.searchsorted([1, 4], zeros + ones, side="right"), np.full(3 * ODDS, 3)].astype(np.uint8)
    less = np.tile(np.arange(256, dtype=np.uint8), (3, 1))
    less[1, :_EXACT] = np.maximum(zeros - 1, 0) * (FEW + 1) + ones
    less[2, :_EXACT] = zeros * (FEW + 1) + np.maximum(ones - 1, 0)
    return stretch, level, less.reshape(-1)


#: Of each packed byte: log odds, confidence from 0 to 3, and (at 256 and 512 on) the byte with one
#: bit 0 or 1 less.
STRETCH, LEVEL, LESS = _unpacked()
#: The first two by place in LESS.
STRETCHED, LEVELS = STRETCH[LESS], LEVEL[LESS]
#: The weights that move in a lane: of the contexts' mixture and of the lane's own predictors.
INPUTS = 3
#: How fast weights and the lane's own predictors move, and the values that these move to.
RATE, PACE, FULL = 0.006, 0.15, 4.0
#: Bits after which they move.
BLOCK = 16
class Bits:
    """The binary decisions of a buffer's pieces, cut into lanes of at most LANE bytes.

    Here and below places are taken with mode="clip" where all lie inside: numpy takes half the time.
    """

    def __init__(self, buffer: Buffer, code: Code) -> None:
        n_lanes = -(-buffer.sizes // LANE)
        self.owner = owner = np.repeat(np.arange(len(n_lanes)), n_lanes)
        turn = np.arange(len(owner)) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
        size = np.minimum(LANE, buffer.sizes[owner] - turn * LANE)
        close = np.cumsum(size)
        at = np.repeat(buffer.starts[owner] + turn * LANE - close + size, size) + np.arange(close[-1])
        symbol = code.symbol.take(buffer.bytes.take(at)).astype(np.int64)
        length = code.length.take(symbol)
        fill = -np.add.reduceat(length, close - size) % STEPS  # one idle symbol ends each lane
        self.at = np.insert(at, close, 0)
        self.real = np.ones(len(self.at), bool)
        self.real[close + np.arange(len(close))] = False
        self.symbol, length = np.insert(symbol, close, SYMBOLS), np.insert(length, close, fill)
        self.first = np.cumsum(length) - length
        self.rows = np.add.reduceat(length, close - size + np.arange(len(close))) // STEPS  # of each lane
        self.of = np.repeat(np.arange(len(length)), length)
        step = (code.start.take(self.symbol) - self.first).take(self.of, mode="clip")
        step += np.arange(len(step))
        self.node, self.bit, self.way = [x.take(step, mode="clip") for x in (code.node, code.bit, code.way)]

    def less(self, taught: np.ndarray | None) -> np.ndarray:
        """Where in LESS the packed bytes of each bit begin."""
        if taught is None or not taught.any():
            return np.zeros(len(self.bit), np.int64)
        found = (self.bit.astype(np.int64) + 1) << 8
        found *= np.repeat(taught[self.owner], self.rows * STEPS)
        return found


class Met(Buffer):
    """Bytes that stand in different contexts, in place of the texts that they come from."""

    def __init__(self, last: np.ndarray, prefix: np.ndarray, bytes_: np.ndarray) -> None:
        self._last, self.prefix, self.bytes = last, prefix, bytes_
        self.sizes, self.starts = np.array([len(bytes_)]), np.zeros(1, np.int64)


class Batch:
    """Pieces whose bytes are looked up together: each symbol in each set of contexts once, however
    often it stands there.

    The last six bytes and the word so far decide all contexts. `of` is the number of each byte's pair
    of contexts and symbol; a pair that has taught and one that hasn't differ.
    """

    def __init__(self, some: list[tuple[bytes, bytes]], symbol: np.ndarray, taught: np.ndarray | None = None) -> None:
        self.sizes = np.array([len(body) for _, body in some], np.int64)
        taught = np.zeros(len(some), bool) if taught is None else taught
        n, end = int(self.sizes.sum()), 0
        last, prefix, key, bytes_, learnt = np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint64), np.empty(n, np.uint8), np.empty(n, bool)
        words, owner = [], []
        for part in _parts(some):
            buffer = Buffer(some[part])
            at = np.repeat(buffer.starts - np.cumsum(buffer.sizes) + buffer.sizes, buffer.sizes)
            at += np.arange(len(at))
            mine = slice(end, end + len(at))
            end = mine.stop
            six = buffer.hashed(6)
            buffer._last.take(at, out=last[mine], mode="clip")
            buffer.prefix.take(at, out=prefix[mine], mode="clip")
            buffer.bytes.take(at, out=bytes_[mine], mode="clip")
            learnt[mine] = np.repeat(taught[part], buffer.sizes)
            six ^= buffer.prefix
            six.take(at, out=key[mine], mode="clip")
            kind = symbol.take(bytes_[mine]).astype(np.int64)
            kind += learnt[mine] * np.int64(SYMBOLS)
            key[mine] += _KINDS.take(kind, mode="clip")
            hashes, piece = buffer.words()
            words.append(hashes)
            owner.append(piece + part.start)
        self.words, self.owner = np.concatenate(words), np.concatenate(owner)
        first, of = once(key)
        del key
        side = learnt[first]
        self.split = int(len(first) - side.sum())
        order = np.argsort(side, kind="stable")
        number = np.empty(len(first), np.int32)
        number[order] = np.arange(len(first), dtype=np.int32)
        self.of, first = number.take(of, mode="clip"), first[order]
        self.last, self.prefix, self.bytes = last[first], prefix[first], bytes_[first]

    def times(self) -> np.ndarray:
        """How often each pair stands in the pieces."""
        return np.bincount(self.of, minlength=len(self.bytes))

    def met(self) -> Iterator[tuple[slice, Met, np.ndarray]]:
        """The pairs, PART at a time, and whether these have taught."""
        for begin, end, taught in ((0, self.split, False), (self.split, len(self.bytes), True)):
            for a in range(begin, end, PART):
                mine = slice(a, min(end, a + PART))
                yield mine, Met(self.last[mine], self.prefix[mine], self.bytes[mine]), np.array([taught])


#: What symbols add to the hash of their contexts: those of texts that don't teach, and of those that do.
_KINDS = np.random.default_rng(42).integers(0, 1 << 64, 2 * SYMBOLS, np.uint64)


def once(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes that stand for all equal ones, and the number of each hash's in them.

    A table holds one place for each slot, and hashes that find an equal one there are done; the
    others go round with other slots. What then is left stands for itself, so a few may stand twice.
    """
    n = len(key)
    place, rest, k = np.arange(n, dtype=np.int32), None, key
    for turn in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9):
        bits = max(4, len(k).bit_length())
        slot = k * np.uint64(turn)
        slot >>= np.uint64(64 - bits)
        slot = slot.view(np.int64)
        table_ = np.empty(1 << bits, np.int32)
        table_[slot] = place if rest is None else rest
        found = table_.take(slot, mode="clip")
        del slot, table_
        same = key.take(found, mode="clip") == k
        if rest is None:
            np.copyto(place, found, where=same)
            rest = np.flatnonzero(~same).astype(np.int32)
        else:
            place[rest[same]] = found[same]
            rest = rest[~same]
        if not len(rest):
            break
        k = key.take(rest)
    own = place == np.arange(n, dtype=np.int32)
    number = np.cumsum(own, dtype=np.int32)
    number -= 1
    return np.flatnonzero(own), number.take(place, mode="clip")


@dataclass
class MixModel:
    """Shipped to the tasks: the code, a table of packed bytes for each context, gated weights."""

    code: Code
    tables: list[np.ndarray]
    weights: np.ndarray  # (contexts, GATES): of the contexts' log odds
    start: np.ndarray  # (GATES, INPUTS): what lanes start with

    @classmethod
    def fresh(cls, code: Code, tables: list[np.ndarray]) -> MixModel:
        return cls(code, tables, np.full((len(tables), GATES), 1 / len(tables), np.float32), np.tile(np.array([1, 0.1, 0.1], np.float32), (GATES, 1)))

    def looked_up(self, buffer: Buffer, bits: Bits, taught: np.ndarray | None) -> tuple[list[np.ndarray], np.ndarray]:
        """The places in LESS that the contexts have for each bit (where a piece has taught, its own
        occurrence is taken out), and the gate: how sure the two longest contexts are."""
        less, places = bits.less(taught), []
        for cells, context in zip(self.tables, buffer.contexts(bits.at)):
            context *= SYMBOLS
            at = context.take(bits.of, mode="clip")
            at += bits.node
            places.append(less | cells.take(at))
        gate = LEVELS.take(places[-1], mode="clip")
        gate *= np.uint8(4)
        gate += LEVELS.take(places[-2], mode="clip")
        return places, gate

    def given(self, buffer: Buffer, bits: Bits, taught: np.ndarray | None, ranks: list[np.ndarray]) -> np.ndarray:
        """What is known of each bit before it is coded: the contexts' mixture in the upper 32 bits,
        then 2 bits of `way` + 1, 12 for the slot of each predictor of the lane's own, 4 for the gate.

        The first call of a batch numbers the slots by how often it met them, into `ranks`, so that a
        lane's busy slots lie together in memory.
        """
        places, gate = self.looked_up(buffer, bits, taught)
        found = self.mixed(places, gate).view(np.uint32).astype(np.int64)
        found <<= 4
        found |= bits.way + 1
        fresh = not ranks
        for k, n in reversed(list(enumerate(OWN))):
            own = (buffer.hashed(n)[bits.at] >> np.uint64(58 if n == 1 else 40)) * np.uint64(SYMBOLS)
            slot = (own & np.uint64(SLOTS - 1)).view(np.int64).take(bits.of, mode="clip")
            slot += bits.node
            if fresh:
                ranks.insert(0, np.argsort(np.argsort(-np.bincount(slot, minlength=SLOTS), kind="stable")))
            found <<= 12
            found |= ranks[0 if fresh else k].take(slot, mode="clip")
        found <<= 4
        found |= gate
        return found

    def mixed(self, places: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        """The contexts' log odds, summed with the trained weights of the gate."""
        row, said = gate.astype(np.int64) * len(STRETCHED), (self.weights[:, :, None] * STRETCHED).reshape(len(places), -1)
        total = said[0].take(row + places[0], mode="clip")
        for say, p in zip(said[1:], places[1:]):
            total += say.take(row + p, mode="clip")
        return total

    def log10(self, some: list[tuple[bytes, bytes]], taught: np.ndarray | None = None) -> list[np.ndarray]:
        """log10 probability of each byte of some pieces. taught marks pieces that the tables have
        learned from: there each occurrence is taken out of its own counts."""
        batch, found = Batch(some, self.code.symbol, taught), []
        for _, of, lanes, bits, cost in self.costs(batch):
            sums = np.add.reduceat(cost, (np.cumsum(bits) - bits).clip(max=len(cost) - 1), dtype=np.float64)
            escaped = self.code.symbol.take(batch.bytes[of]) == ESC
            found.append(np.delete(sums, lanes) / -np.log(10) - escaped * (8 * np.log10(2)))
        return np.split(np.concatenate(found), np.cumsum(batch.sizes)[:-1])

    def scores(self, batch: Batch) -> np.ndarray:
        """log10 probability of each piece of a batch."""
        found = np.empty(len(batch.sizes))
        escaped = np.where(self.code.symbol.take(batch.bytes) == ESC, 8 * np.log10(2), 0)
        for part, of, lanes, bits, cost in self.costs(batch):
            sizes = batch.sizes[part]
            n_lanes = -(-sizes // LANE)
            rows = np.add.reduceat(bits, np.append(0, lanes[:-1] + 1)) // STEPS
            by_row = cost.reshape(-1, STEPS).sum(axis=1).astype(np.float64)
            by_lane = np.add.reduceat(by_row, np.cumsum(rows) - rows) - bits[lanes] * np.log(2)  # what idle bits cost
            found[part] = np.add.reduceat(by_lane, np.cumsum(n_lanes) - n_lanes) / -np.log(10) - np.add.reduceat(escaped.take(of, mode="clip"), np.cumsum(sizes) - sizes)
        return found

    def costs(self, batch: Batch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """The pieces of a batch, about BYTES at a time: which they are, the pair of each byte, and, with
        one more byte of idle bits behind each lane, these bytes' places, the bits of each byte, and
        coded() of all bits."""
        known, starts, lengths, n, ranks = [], [], [], 0, []
        for _, met, taught in batch.met():
            bits = Bits(met, self.code)
            known.append(self.given(met, bits, taught, ranks))
            starts.append((bits.first[bits.real] + n).astype(np.int32))
            lengths.append(self.code.length.take(bits.symbol[bits.real]))
            n += len(bits.way)
        known = np.concatenate([*known, np.full(STEPS, 1 << 28)])  # the last pair is that of idle bits
        start, length = np.concatenate([*starts, np.array([n], np.int32)]), np.concatenate([*lengths, [0]])
        end = 0
        for part in by_bytes(batch.sizes.tolist(), BYTES):
            sizes = batch.sizes[part]
            n_lanes = -(-sizes // LANE)
            turn = np.arange(n_lanes.sum()) - np.repeat(np.cumsum(n_lanes) - n_lanes, n_lanes)
            close = np.cumsum(np.minimum(LANE, np.repeat(sizes, n_lanes) - turn * LANE))
            of = batch.of[end : end + close[-1]]
            end += close[-1]
            lanes, real = close + np.arange(len(close)), np.ones(len(of) + len(close), bool)
            real[lanes] = False
            all_of = np.full(len(real), len(batch.bytes), np.int32)
            all_of[real] = of
            bits = length.take(all_of, mode="clip")
            begin = np.append(0, lanes[:-1] + 1)
            bits[lanes] = -np.add.reduceat(bits, begin) % STEPS
            first = np.cumsum(bits, dtype=np.int32)
            first -= bits
            step = np.repeat(start.take(all_of, mode="clip") - first, bits)
            step += np.arange(len(step), dtype=np.int32)
            yield part, of, lanes, bits, self.coded(np.add.reduceat(bits, begin) // STEPS, step, known)

    def coded(self, rows: np.ndarray, step: np.ndarray, known: np.ndarray) -> np.ndarray:
        """The cost of each bit: the negative natural logarithm of its probability. rows: STEPS bits
        each, of each lane; step: where in `known` each bit of the lanes is given.

        A lane starts with the weights `start` and codes its bits in blocks: the mixture of the
        contexts and the predictors that learn in the lane are summed with the weights of the bit's
        gate. Then the block's bits move these weights down the gradient of the coding cost, and
        the lane's own predictors towards themselves. All lanes go block by block together.
        """
        order = np.argsort(-rows, kind="stable")
        first = (np.cumsum(rows) - rows)[order]
        n = len(order)
        by_row = step.reshape(-1, STEPS)
        cost = np.empty(by_row.shape, np.float32)
        weights = [np.tile(w, n) for w in self.start.T.astype(np.float32)]
        own, lanes = [np.zeros(n * SLOTS, np.float32) for _ in OWN], np.arange(n)[:, None]
        for chunk, n in enumerate(n - np.cumsum(np.bincount(rows))[:-1]):
            where = first[:n] + chunk
            now = known.take(by_row.take(where, axis=0), mode="clip")
            mixed = (now >> 32).astype(np.uint32).view(np.float32)
            way = ((now >> 28) & 3).astype(np.float32)
            way -= np.float32(1)
            slots = [((now >> 4) & (SLOTS - 1)) + lanes[:n] * SLOTS, ((now >> 16) & (SLOTS - 1)) + lanes[:n] * SLOTS]
            gate = (now & (GATES - 1)) + lanes[:n] * GATES
            out = np.empty((n, STEPS), np.float32)
            for t in range(0, STEPS, BLOCK):
                some = slice(t, t + BLOCK)
                g, y = gate[:, some].reshape(-1), way[:, some].reshape(-1)
                at = [s[:, some].reshape(-1) for s in slots]
                x = [mixed[:, some].reshape(-1), *[table_.take(c, mode="clip") for table_, c in zip(own, at)]]
                total = weights[0].take(g, mode="clip")
                total *= x[0]
                for w, v in zip(weights[1:], x[1:]):
                    said = w.take(g, mode="clip")
                    said *= v
                    total += said
                np.minimum(np.maximum(total, -16, out=total), 16, out=total)
                total *= y
                wrong = np.exp(np.negative(total, out=total), out=total)  # odds against the bit
                odds = wrong + np.float32(1)
                wrong /= odds
                out[:, some] = np.log(odds, out=odds).reshape(n, BLOCK)
                wrong *= y
                wrong *= np.float32(RATE)
                y *= np.float32(FULL * PACE)
                for w, v in zip(weights, x):
                    np.add.at(w, g, wrong * v)
                for table_, c, v in zip(own, at, x[1:]):
                    v *= np.float32(1 - PACE)
                    v += y
                    table_[c] = v
            cost[where] = out
        return cost.reshape(-1)

    def slopes(self, some: list[tuple[bytes, bytes]]) -> np.ndarray:
        """(GATES, contexts, contexts + 1): the gradient of the coding cost of teaching pieces in the
        contexts' weights, and behind it the matrix of second derivatives. Sums over bits, so those
        of several pieces add up."""
        k = len(self.tables)
        found = np.zeros((GATES, k, k + 1))
        batch = Batch(some, self.code.symbol, np.ones(len(some), bool))
        times = batch.times().astype(np.float32)
        for mine, met, taught in batch.met():
            bits = Bits(met, self.code)
            places, gate = self.looked_up(met, bits, taught)
            often = np.zeros(len(bits.real), np.float32)
            often[bits.real] = times[mine]
            order = np.argsort(gate, kind="stable")
            often = often.take(bits.of.take(order, mode="clip"), mode="clip")
            way, x = bits.way.take(order, mode="clip").astype(np.float32), np.empty((k, len(order)), np.float32)
            for one, p in zip(x, places):
                STRETCHED.take(p.take(order, mode="clip"), out=one, mode="clip")
            x *= way  # now towards the bit; bits that are none count as zeros
            ends = np.cumsum(np.bincount(gate, minlength=GATES))
            for g, (a, b) in enumerate(zip(ends - np.diff(ends, prepend=0), ends)):
                mine = x[:, a:b]
                wrong = self.weights[:, g] @ mine
                np.minimum(np.maximum(wrong, -16, out=wrong), 16, out=wrong)
                np.exp(np.negative(wrong, out=wrong), out=wrong)
                wrong /= wrong + np.float32(1)
                found[g, :, 0] -= mine @ (wrong * often[a:b])
                found[g, :, 1:] += (mine * ((wrong - wrong * wrong) * often[a:b])) @ mine.T
        return found

    def move(self, slopes: np.ndarray) -> None:
        """One Newton step of the contexts' weights; a gate of few bits hardly moves."""
        damped = slopes[:, :, 1:] + 50 * np.eye(len(self.tables))
        step = np.linalg.solve(damped, slopes[:, :, :1])[:, :, 0]
        self.weights = np.round(self.weights - np.clip(step, -1, 1).T, 4).astype(np.float32)

    def teach(self, texts: list[bytes], rounds: int) -> None:
        """Train the contexts' weights on a few texts that are at hand."""
        some = [p for t in texts for p in pieces(t)]
        for _ in range(rounds):
            self.move(self.slopes(some))


def _parts(some: list[tuple[bytes, bytes]]) -> Iterator[slice]:
    """Slices of pieces that are looked up together."""
    return by_bytes([len(body) for _, body in some], PART)


def _batches(texts: Iterable[bytes], most: int) -> Iterator[tuple[np.ndarray, list[tuple[bytes, bytes]]]]:
    """Pieces of about `most` bytes at a time, and the text of each."""
    some, owner, size = [], [], 0
    for i, text in enumerate(texts):
        for piece in pieces(text):
            some.append(piece)
            owner.append(i)
            size += len(piece[1])
            if size >= most:
                yield np.array(owner), some
                some, owner, size = [], [], 0
    if some:
        yield np.array(owner), some


def _count(parts: Iterator[pd.DataFrame], symbol: np.ndarray) -> Iterator[pd.DataFrame]:
    """Counts of a partition: (0, key, n) of words by hash and (k, key, cells, counts) of slice
    `key` of the k-th context's symbol counts."""
    cells = [np.zeros(SYMBOLS << bits, np.int32) for bits in CONTEXTS]
    words: list[np.ndarray] = []
    texts = 0

    def add(some: list[tuple[bytes, bytes]]) -> None:
        buffer = Buffer(some)
        at = np.repeat(buffer.starts - np.cumsum(buffer.sizes) + buffer.sizes, buffer.sizes) + np.arange(buffer.sizes.sum())
        now = symbol[buffer.bytes[at]]
        for mine, c in zip(cells, buffer.contexts(at)):
            np.add.at(mine, c * SYMBOLS + now, np.int32(1))  # a plain 1 takes a slow path
        words.append(buffer.words()[0])

    def row(k, key, n, cells, counts) -> pd.DataFrame:
        return pd.DataFrame({"k": k, "key": key, "n": n, "cells": cells, "counts": counts})

    def counted() -> pd.DataFrame:
        key, n = np.unique(np.concatenate([np.empty(0, np.int64), *words]), return_counts=True)
        words.clear()
        return row(np.zeros(len(key), np.int32), key, n, None, None)

    for pdf in parts:
        texts += len(pdf)
        for _, some in _batches([normal(t) for t in pdf["text"]], CHUNK):
            add(some)
        if sum(map(len, words)) > MOST:  # so that a large partition's words stay within memory
            yield counted()
    yield counted()
    if texts:
        yield row(np.zeros(1, np.int32), [END_WORD], [texts], None, None)
    for i, mine in enumerate(cells):
        for part, slice_ in enumerate(mine.reshape(-1, SYMBOLS << SLICE)):
            key = np.flatnonzero(slice_)
            if len(key):
                yield row([i + 1], [part], [0], [key.astype(np.int32)], [slice_[key]])


#: Partitions that one counting task takes, where there are more than all cores need: a task gives on
#: tables of a fixed size, so fewer tasks shuffle less.
TOGETHER = 32
#: Words that a task holds before it gives them on.
MOST = 1 << 20
#: Contexts of one row of tables on their way to the driver.
SLICE = 10


def _summed(parts: Iterator[pd.DataFrame], code: Code) -> Iterator[pd.DataFrame]:
    """The packed slices of a partition's rows, which stand in the order of (k, key)."""
    of, sums = None, np.zeros(SYMBOLS << SLICE)

    def packed() -> pd.DataFrame:
        return pd.DataFrame({"k": [of[0]], "part": [of[1]], "packed": [pack(sums.reshape(-1, SYMBOLS), code).tobytes()]})

    for pdf in parts:
        for k, part, cells, counts in zip(pdf["k"], pdf["key"], pdf["cells"], pdf["counts"], strict=True):
            if of != (k, part):
                if of is not None:
                    yield packed()
                of = (k, part)
                sums[:] = 0
            sums[np.asarray(cells)] += counts
    if of is not None:
        yield packed()


def _tables(raw: DataFrame, code: Code) -> list[np.ndarray]:
    """The packed tables: counts of all partitions are summed a slice of contexts at a time."""
    cells = raw.where("k > 0").select("k", "key", "cells", "counts").repartition("k", "key").sortWithinPartitions("k", "key")
    tables = [np.zeros(SYMBOLS << bits, np.uint8) for bits in CONTEXTS]
    rows = cells.mapInPandas(lambda parts: _summed(parts, code), "k int, part long, packed binary").collect()
    for row in rows:  # at most sum(2 ** (bits - SLICE)) rows of 64 kB
        tables[row["k"] - 1][row["part"] * (SYMBOLS << SLICE) :][: SYMBOLS << SLICE] = np.frombuffer(row["packed"], np.uint8)
    return tables


def _seen(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts (i, x) of a partition's bytes."""
    found = np.zeros(256)
    for pdf in parts:
        for _, some in _batches([normal(t) for t in pdf["text"]], CHUNK):
            found += np.bincount(np.frombuffer(b"".join([body for _, body in some]), np.uint8), minlength=256)
    yield pd.DataFrame({"i": np.arange(256, dtype=np.int32), "x": found})


def _slopes(parts: Iterator[pd.DataFrame], model: MixModel) -> Iterator[pd.DataFrame]:
    """(i, x): MixModel.slopes() of a partition's texts."""
    found = np.zeros((GATES, len(model.tables), len(model.tables) + 1))
    for _, some in _batches((normal(t) for pdf in parts for t in pdf["text"]), ALIKE):
        found += model.slopes(some)
    yield pd.DataFrame({"i": np.arange(found.size, dtype=np.int32), "x": found.reshape(-1)})


def _added(rows: DataFrame, size: int) -> np.ndarray:
    """Sums over all partitions of (i, x)."""
    out = np.zeros(size)
    for i, x in rows.groupBy("i").agg(F.sum("x")).collect():  # `size` rows at most
        out[i] = x
    return out


def lm_scores(docs: DataFrame, train: Column, sample: int | None = None) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    Tokens are the words of the whole text, A-Z in lower case, and one end. Texts with `train` teach:
    all of them, whole, count words and the symbols that follow each context. base_score sums
    log10((c + 1) / (N + V + 1)) over the tokens. score is the log10 probability of the same tokens,
    written as bytes with a space between and an end, under the mixture of MixModel.coded(). A text
    that teaches is scored with one occurrence less in every count of at most FEW that it meets;
    higher counts are packed into coarse levels, which one occurrence doesn't move.

    All teaching texts, whole, also give the code of the bytes and train the contexts' weights: each
    task sums the slopes of the coding cost over its texts, and the sums make one Newton step from
    equal weights. What lanes start with is fixed. Nothing is sampled; `sample` has no effect and is
    taken only because callers give it.

    Null and blank texts are an end alone. Rows are independent of each other; repeated rows repeat,
    and ids may be null or repeat. An empty table gives no rows. Without any text to learn from, N
    and V are 0, the base score is 0 and the contexts are unknown. Columns of docs other than doc_id
    and text play no part, whatever their names. Word counts meet the texts by a join; frequent
    words (FREQUENT at most) are looked up in the tasks instead.
    """
    spark = docs.sparkSession
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    texts = d.where("train").select("text")
    with arrow_rows(spark, ROWS):
        seen = _added(texts.mapInPandas(_seen, "i int, x double"), 256)
    seen[97:123] += 1
    code = Code(seen)
    symbol = code.symbol
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // TOGETHER))
    counts = texts.coalesce(tasks).mapInPandas(lambda parts: _count(parts, symbol), "k int, key long, n long, cells array<int>, counts array<int>")
    with arrow_rows(spark, ROWS):
        raw = stored(counts)
    words = stored(raw.where("k = 0").groupBy("key").agg(F.sum("n").alias("n")))
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, n_words = int(total["n"]), int(total["v"])
    model = MixModel.fresh(code, _tables(raw, code))
    sent = spark.sparkContext.broadcast(model)
    with arrow_rows(spark, ROWS):
        slopes = _added(texts.mapInPandas(lambda parts: _slopes(parts, sent.value), "i int, x double"), GATES * len(model.tables) * (len(model.tables) + 1))
    model.move(slopes.reshape(GATES, len(model.tables), -1))
    least = max(2, -(-n_all // FREQUENT))
    common = words.where(F.col("n") >= least).toArrow()  # FREQUENT rows at most
    keys, n = common["key"].to_numpy(), common["n"].to_numpy()
    order = np.argsort(keys)
    weights, shipped = model.weights, spark.sparkContext.broadcast((keys[order], n[order]))
    with arrow_rows(spark, ROWS):
        scored = stored(_scored(d, sent, weights, shipped, n_all, n_words))
    rare = scored.select("row", F.explode("rare").alias("key")).groupBy("row", "key").agg(F.count("*").alias("times"))
    unit = F.lit(float(np.log10(n_all + n_words + 1)))
    rare = rare.join(words.where(F.col("n") < least), "key", "left").select("row", "times", F.coalesce("n", F.lit(0)).alias("c"))
    rare = rare.groupBy("row").agg(F.sum(F.col("times") * (F.log10(F.col("c") + 1.0) - unit)).alias("base"), F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("known"))
    out = scored.drop("rare").join(rare, "row", "left")
    out = out.withColumn("bits_per_byte", -F.col("score") * float(np.log2(10)) / F.col("bytes"))
    add = lambda a, b: F.col(a) + F.coalesce(F.col(b), F.lit(0))
    return out.select("doc_id", "n_tokens", add("n_known", "known").cast("long").alias("n_known"), F.lit(n_all).cast("long").alias("train_tokens"), add("base_score", "base").alias("base_score"), "score", "bits_per_byte")


def _scored(docs: DataFrame, sent, weights: np.ndarray, shipped, n_all: int, n_words: int) -> DataFrame:
    """What a task can tell of its texts alone, and the hashes of words that aren't common."""

    def each(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keys, counts = shipped.value
        model = replace(sent.value, weights=weights)
        unit = np.log10(n_all + n_words + 1)
        for pdf in parts:
            n, train = len(pdf), pdf["train"].to_numpy(bool)
            score, base, size, tokens, known = np.zeros((5, n))
            rare: list[np.ndarray] = [np.full(1, END_WORD)] * 0
            rare_of: list[np.ndarray] = []
            for text, some in _batches([normal(t) for t in pdf["text"]], ALIKE):
                batch = Batch(some, model.code.symbol, train[text])
                size += np.bincount(text, batch.sizes, n)
                score += np.bincount(text, model.scores(batch), n)
                closed = np.flatnonzero([body.endswith(b"\n") for _, body in some])
                words, owner = np.r_[batch.words, np.full(len(closed), END_WORD)], text[np.r_[batch.owner, closed]]
                place = np.searchsorted(keys, words)
                place[place == len(keys)] = 0
                found = keys[place] == words if len(keys) else np.zeros(len(words), bool)
                tokens += np.bincount(owner, minlength=n)
                known += np.bincount(owner[found], minlength=n)
                base += np.bincount(owner[found], np.log10(counts[place[found]] + 1.0) - unit, n)
                rare.append(words[~found])
                rare_of.append(owner[~found])
            of = np.concatenate([np.empty(0, np.int64), *rare_of])
            rank = np.argsort(of, kind="stable")
            lists = np.split(np.concatenate([np.empty(0, np.int64), *rare])[rank], np.cumsum(np.bincount(of, minlength=n))[:-1])
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"].astype("Int64").to_numpy(), "n_tokens": tokens.astype(np.int64), "n_known": known.astype(np.int64),
                "base_score": base, "score": score, "bytes": size.astype(np.int64), "rare": lists,
            })

    schema = "doc_id long, n_tokens long, n_known long, base_score double, score double, bytes long, rare array<long>"
    return docs.mapInPandas(each, schema).withColumn("row", F.monotonically_increasing_id())


def op4_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lm_scores() of all documents, taught by those whose crc32(doc_id) mod 7 is not 2; nulls, empty
    texts, ties, repeats, an empty table and further columns as stated there."""
    out = lm_scores(table(spark, sf_dir, "documents"), ~held_out(7, 2))
    return out.select("doc_id", held_out(7, 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")
