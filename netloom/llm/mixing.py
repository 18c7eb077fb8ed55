"""Context-mixing range coder for token ids.

A block lists its distinct ids and codes each id by its rank among them. Three predictions are kept: the id that follows
the two ids before (order 2, by hash), the id that follows the one before (order 1), each with a trust that hits raise
and misses lower, and the frequencies of the ids so far (order 0). Two models, one that sees both trusts and one that sees
the last three events, say what comes: order 2, order 1, order 0, or an id too rare for order 0, of which all are alike.
Their distributions are mixed by weights, one for each pair of trusts, that follow the two models' shares in the
probability of what came (steps of expectation and maximisation). Event and order-0 id go through one arithmetic-coding
step.

A block's ids are dealt to lanes, consecutive runs that are coded side by side: one numpy step codes one id of every
lane. The lanes share all predictions, models and weights. These learn from what all lanes have coded at fixed rows (after
each one at first, after EPOCH at most), so that within an epoch the mix is a table of bounds, and the encoder has whole
epochs at once. The words of all lanes form one stream, in the order in which a decoder asks for them.

Models use integers only. The coder's numbers are integers below 2^53 in doubles, on which all its steps are exact, and
quotients are so far from the next integer that rounding can't reach it; so every machine decodes the same.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import zstandard

BLOCK = 1 << 22  # ids in a block at most
LANES, LANE = 4096, 1024  # lanes of a block at most; ids that each has at least, where there is more than one
EPOCH = 32  # rows between two lessons at most
TABLE_BITS = 19  # of order 2
TRUST, PAST = 7, 64  # most trust in an order; combinations of the last three events
SLOT_BITS, TOTAL_BITS = 17, 24
SLOTS, TOTAL = 1 << SLOT_BITS, 1 << TOTAL_BITS
LEAST = np.array([1 << 10, 1 << 10, 1 << SLOT_BITS, 1 << 10])  # of 2^24, of each event; order 0 needs one for each slot
WHOLE = 1 << 12  # of the weights
MOST_ID = (1 << 29) - 1
HEAD = struct.Struct("<IIIII")  # ids, distinct ids, bytes of their list, words of the stream, crc32 of the ids as little-endian unsigned 32-bit integers
LOW, SHORT, WORD = float(1 << 48), float(1 << 32), float(1 << 16)


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(np.ascontiguousarray(ids, "<u4").tobytes())


def cut(ids: np.ndarray) -> list[np.ndarray]:
    """A segment's ids as blocks of about the same size."""
    many = -(-len(ids) // BLOCK)
    return np.array_split(ids, many) if many else []


def _shape(n: int) -> tuple[int, int]:
    """(rows, lanes) of a block; the last lane may be shorter, and lanes that would be empty are left out."""
    rows = -(-n // max(1, min(LANES, n // LANE)))
    return rows, -(-n // rows) if rows else 0


def _lessons(rows: int) -> list[int]:
    """First rows of the epochs, and the end."""
    out = [0]
    while (at := out[-1] + max(1, min(out[-1] // 2, EPOCH))) < rows:
        out.append(at)
    return [*out, rows] if rows else [0]


class _Model:
    """What the lanes of a block have learnt. An entry of a table is the rank that it foretells, times 8, and its trust (0: none)."""

    def __init__(self, distinct: int):
        self.table2, self.table1 = np.zeros(1 << TABLE_BITS, np.int64), np.zeros(distinct, np.int64)
        self.count = np.ones(distinct, np.int64)
        self.by_trust, self.by_past = (np.tile(np.array([1, 1, 4, 2]), (k, 1)) for k in ((TRUST + 1) ** 2, PAST))
        self.weight = np.full(len(self.by_trust), WHOLE // 2)  # of the model that sees the trusts
        self._settle()

    @staticmethod
    def key2(before: np.ndarray, last: np.ndarray) -> np.ndarray:
        return (before * 0x9E3779B1 + last * 0x85EBCA77 >> 11) & (1 << TABLE_BITS) - 1

    def _shares(self) -> tuple[np.ndarray, np.ndarray]:
        return tuple((t << 20) // t.sum(axis=1, keepdims=True) for t in (self.by_trust, self.by_past))

    def _settle(self) -> None:
        """Tables for the next epoch: bounds of the events by context, slots of order 0."""
        trust, past = self._shares()
        mix = self.weight[:, None, None] * trust[:, None] + (WHOLE - self.weight)[:, None, None] * past[None]
        mix[: TRUST + 1, :, 0] = 0  # nothing foretold
        mix[:: TRUST + 1, :, 1] = 0
        mix = LEAST + mix * (TOTAL - LEAST.sum()) // mix.sum(axis=2, keepdims=True)
        self.end2 = mix[..., 0].ravel().astype(np.float64)
        self.end1 = self.end2 + mix[..., 1].ravel()
        self.end0 = TOTAL - mix[..., 3].ravel().astype(np.float64)
        slots = self.count * SLOTS // self.count.sum()
        slots[self.count.argmax()] += SLOTS - slots.sum()
        self.frequent = np.flatnonzero(slots)
        self.last = np.cumsum(slots).astype(np.float64)
        self.first = self.last - slots

    def learn(self, key2: np.ndarray, last: np.ndarray, ranks: np.ndarray, entry2: np.ndarray, entry1: np.ndarray, context: np.ndarray, event: np.ndarray) -> None:
        """What came in an epoch, in the order of rows, and within a row of lanes."""
        for table, at, entry in ((self.table2, key2, entry2), (self.table1, last, entry1)):
            trust, new = entry & 7, ranks << 3 | 1
            table[at] = np.where(entry >> 3 == ranks, entry + (trust < TRUST), np.where(trust > 1, entry - 1, new))
        self.count += np.bincount(ranks, minlength=len(self.count))
        came = np.bincount(context << 2 | event, minlength=len(self.by_trust) * PAST * 4).reshape(-1, PAST, 4)
        trust, past = self._shares()
        some = came.sum(axis=(1, 2))
        for _ in range(3):
            own = self.weight[:, None, None] * trust[:, None]
            part = (own << 12) // np.maximum(own + (WHOLE - self.weight)[:, None, None] * past[None], 1)
            weight = (came * part).sum(axis=(1, 2)) // np.maximum(some, 1)
            self.weight = np.where(some > 0, np.clip(weight, WHOLE // 32, WHOLE - WHOLE // 32), self.weight)
        self.by_trust += came.sum(axis=1)
        self.by_past += came.sum(axis=0)
        self._settle()


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most BLOCK ids below 2^29 as bytes."""
    return [_encode(np.asarray(b)) for b in blocks]


def _ranks(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ids, rank of each id)."""
    if not len(ids) or ids.max() >= 1 << 22:
        return np.unique(ids, return_inverse=True)
    have = np.bincount(ids) > 0
    return np.flatnonzero(have), (np.cumsum(have) - 1).take(ids)


def _encode(block: np.ndarray) -> bytes:
    if len(block) > BLOCK:
        raise ValueError("a block is too long")
    if len(block) and not 0 <= block.min() <= block.max() <= MOST_ID:
        raise ValueError("an id is above 29 bits")
    rows, lanes = _shape(len(block))
    distinct, flat = _ranks(block)
    names = zstandard.ZstdCompressor().compress(np.diff(distinct, prepend=0).astype("<u4").tobytes())
    ranks = np.zeros(rows * lanes, np.int64)
    ranks[: len(flat)] = flat
    ranks = np.ascontiguousarray(ranks.reshape(lanes, rows).T)
    del flat
    model, coder = _Model(len(distinct)) if rows else None, _Encoder(lanes, rows)
    before = np.zeros((2, lanes), np.int64)  # the two rows before
    past = np.zeros(lanes, np.int64)
    lessons = _lessons(rows)
    for a, z in zip(lessons, lessons[1:], strict=False):
        own = ranks[a:z]
        seen = np.concatenate([before, own])
        last = seen[1:-1]
        key2 = model.key2(seen[:-2], last)
        entry2, entry1 = model.table2.take(key2), model.table1.take(last)
        first, last_slot = model.first.take(own), model.last.take(own)
        by2 = (entry2 >> 3 == own) & (entry2 & 7 > 0)
        by1 = (entry1 >> 3 == own) & (entry1 & 7 > 0) & ~by2
        rare = (first == last_slot) & ~by2 & ~by1
        event = np.full(own.shape, 2)
        for mask, what in ((by2, 0), (by1, 1), (rare, 3)):
            event[mask] = what
        late = np.zeros((z - a, lanes), np.int64)
        for k in range(z - a):
            late[k] = past
            past = past << 2 & PAST - 1 | event[k]
        context = ((entry2 & 7) * (TRUST + 1) + (entry1 & 7)) * PAST + late
        end2, end1, end0 = (t.take(context) for t in (model.end2, model.end1, model.end0))
        unit = (end0 - end1) / SLOTS  # exact: 2^17 is a power of two
        begin, end = end1 + np.floor(first * unit), end1 + np.floor(last_slot * unit)
        for mask, low, high in ((by2, 0.0, end2), (by1, end2, end1), (rare, end0, float(TOTAL))):
            np.copyto(begin, low, where=mask)
            np.copyto(end, high, where=mask)
        end -= begin
        for k in range(z - a):
            coder.put(begin[k], end[k])
            if len(some := np.flatnonzero(rare[k])):
                coder.put_one_of(some, own[k, some], len(distinct))
        before = seen[-2:]
        if z < rows:
            model.learn(key2.ravel(), last.ravel(), own.ravel(), entry2.ravel(), entry1.ravel(), context.ravel(), event.ravel())
    first, stream = coder.finish()
    return HEAD.pack(len(block), len(distinct), len(names), len(stream), checksum(block)) + names + first.astype("<u2").tobytes() + stream.astype("<u2").tobytes()


class _Encoder:
    """Range coders of all lanes: low is below 2^48, width above 2^32 between two ids. Words lie by their number, then by lane."""

    def __init__(self, lanes: int, rows: int):
        self.lanes, self.low, self.width = lanes, np.zeros(lanes), np.full(lanes, LOW)
        self.words, self.next = np.zeros((rows * 5 // 8 + 16) * lanes, np.uint16), np.arange(lanes)  # places of the next words
        self.asked: list[np.ndarray] = []  # places of words, in the order in which they were emitted

    def put(self, begin: np.ndarray, size: np.ndarray) -> None:
        if self.next.max() + 8 * self.lanes > len(self.words):  # an id takes 4 words at most, the end 3
            self.words = np.concatenate([self.words, np.zeros(len(self.words) // 2 + 16 * self.lanes, np.uint16)])
        unit = np.floor(self.width * (1 / TOTAL))
        self.low += unit * begin
        np.multiply(unit, size, out=self.width)
        self._even()

    def put_one_of(self, some: np.ndarray, which: np.ndarray, many: int) -> None:
        unit = np.floor(self.width[some] / many)
        self.low[some] += unit * which
        self.width[some] = unit
        self._even()

    def _even(self) -> None:
        if len(over := np.flatnonzero(self.low >= LOW)):
            self.low[over] -= LOW
            at = self.next[over] - self.lanes
            while len(at):
                self.words[at] += np.uint16(1)
                at = at[self.words[at] == 0] - self.lanes
        short = np.flatnonzero(self.width <= SHORT)
        while len(short):
            self.asked.append(self._emit(short).astype(np.int32))
            self.width[short] = wide = self.width[short] * WORD
            short = short[wide <= SHORT]

    def _emit(self, some: np.ndarray) -> np.ndarray:
        at, low = self.next[some], self.low[some]
        word = np.floor(low * (1 / SHORT))
        self.words[at] = word.astype(np.uint16)
        self.low[some] = (low - word * SHORT) * WORD
        self.next[some] = at + self.lanes
        return at

    def finish(self) -> tuple[np.ndarray, np.ndarray]:
        """(the first three words of all lanes, which a decoder begins with; the others as it asks for them, three later)."""
        for _ in range(3 if self.lanes else 0):
            self._emit(np.arange(self.lanes))
        asked = np.concatenate([np.zeros(0, np.int32), *self.asked])
        return self.words[: 3 * self.lanes], self.words.take(asked + 3 * self.lanes)


def decode_blocks(blobs: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; ValueError if a checksum is wrong."""
    return [_decode(b) for b in blobs]


def _decode(blob: bytes) -> np.ndarray:
    n, many, size, held, check = HEAD.unpack_from(blob)
    rows, lanes = _shape(n)
    at = HEAD.size + size
    try:
        distinct = np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob[HEAD.size : at], max_output_size=4 * many), "<u4"), dtype=np.int64)
    except zstandard.ZstdError as e:
        raise ValueError("a block is damaged") from e
    if n > BLOCK or len(distinct) != many or (n and not many) or len(blob) != at + 2 * (3 * lanes + held):
        raise ValueError("a block is damaged")
    start = np.frombuffer(blob, "<u2", 3 * lanes, at).reshape(3, lanes).astype(np.float64)
    stream = np.frombuffer(blob, "<u2", held, at + 6 * lanes).astype(np.float64)
    code, width, used = start[0] * SHORT + start[1] * WORD + start[2], np.full(lanes, LOW), 0  # code is relative to the coder's low

    def even() -> None:
        nonlocal used
        short = np.flatnonzero(width <= SHORT)
        while len(short):
            own = stream[used : used + len(short)]
            if len(own) < len(short):
                raise ValueError("a block is damaged")
            used += len(short)
            code[short] = code[short] * WORD + own
            width[short] = wide = width[short] * WORD
            short = short[wide <= SHORT]

    model = _Model(many) if n else None
    ranks = np.zeros((rows + 2, lanes), np.int64)  # after two rows of nothing
    past = np.zeros(lanes, np.int64)
    lessons = _lessons(rows)
    for a, z in zip(lessons, lessons[1:], strict=False):
        key2, entry2, entry1, context, event = (np.zeros((z - a, lanes), np.int64) for _ in range(5))
        slot_rank = np.repeat(model.frequent, (model.last - model.first)[model.frequent].astype(np.int64))
        for k in range(z - a):
            t = a + k
            last = ranks[t + 1]
            key2[k] = at2 = model.key2(ranks[t], last)
            entry2[k] = own2 = model.table2.take(at2)
            entry1[k] = own1 = model.table1.take(last)
            context[k] = at = ((own2 & 7) * (TRUST + 1) + (own1 & 7)) * PAST + past
            end2, end1, end0 = model.end2.take(at), model.end1.take(at), model.end0.take(at)
            unit = np.floor(width * (1 / TOTAL))
            value = np.floor(code / unit)
            is2, not1, is3 = value < end2, value >= end1, value >= end0
            event[k] = now = not1.astype(np.int64) + is3 + ~is2
            room = end0 - end1
            slot = np.floor(((value - end1 + 1) * SLOTS - 1) / room).astype(np.int64)
            share = room / SLOTS
            rank = slot_rank.take(slot, mode="clip")  # of order 0; otherwise none is in bounds
            begin, end = end1 + np.floor(model.first.take(rank) * share), end1 + np.floor(model.last.take(rank) * share)
            if len(some := np.flatnonzero(~not1)):
                two = is2[some]
                rank[some] = np.where(two, own2[some], own1[some]) >> 3
                begin[some], end[some] = np.where(two, 0.0, end2[some]), np.where(two, end2[some], end1[some])
            rare = np.flatnonzero(is3)
            begin[rare], end[rare] = end0[rare], TOTAL
            code -= unit * begin
            np.multiply(unit, end - begin, out=width)
            even()
            if len(rare):
                unit = np.floor(width[rare] / many)
                which = np.minimum(np.floor(code[rare] / unit), many - 1.0)
                code[rare] -= unit * which
                width[rare] = unit
                rank[rare] = which.astype(np.int64)
                even()
            ranks[t + 2] = rank
            past = past << 2 & PAST - 1 | now
        if z < rows:
            model.learn(key2.ravel(), ranks[a + 1 : z + 1].ravel(), ranks[a + 2 : z + 2].ravel(), entry2.ravel(), entry1.ravel(), context.ravel(), event.ravel())
    out = distinct.take(ranks[2:].T.ravel()[:n]).astype(np.uint32) if n else np.zeros(0, np.uint32)
    if checksum(out) != check:
        raise ValueError("a block's checksum is wrong")
    return out
