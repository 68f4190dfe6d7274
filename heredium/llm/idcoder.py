"""Adaptive context-mixing range coder for token ids, many blocks in step.

A block is coded on its own: models and coder start anew, and a header holds the number of ids, the
size of the payload and a CRC-32 of the ids. Blocks are independent, so a batch of them is coded in
lockstep, one id of every block at a time, with numpy arrays over blocks. All arithmetic is on
integers; the decoder repeats the encoder's steps exactly.

For each id the models of order 2 (the two ids before), order 1 (the id before) and order 0 (the
block so far) each predict one id and know how often that worked. What is coded first is which of
them is right: order 2, order 1, order 0 or none. Its distribution is a mix of three adaptive ones,
seen from the confidence of each order, with weights that follow whichever said most. An id that no
order predicted is spelt out: two half-bytes with adaptive frequencies, then the low byte.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

U64 = np.uint64
BLOCK, MAGIC = 4096, b"CMR1"
_HEAD = struct.Struct("<4sIII")
_LOW32, _TOP, _SIXTEEN = U64((1 << 32) - 1), U64(1 << 48), U64(16)
_T2, _T1 = 12, 12          # bits of the prediction tables


class _Models:
    """State of every block; the last axis of every array runs over blocks, or over places of blocks."""

    def __init__(self, n: int):
        # A place holds an id and, in its two low bits, how often it was right: one look into memory for both.
        self.two, self.one = np.zeros(n << _T2, np.uint32), np.zeros(n << _T1, np.uint32)
        self.id0, self.hit0 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.seen = [np.full((4, n * 4), 8, np.int32) for _ in range(3)]
        self.weight = np.full((3, n), 256, np.int32)
        self.high, self.next = np.full((16, n), 4, np.int32), np.full((16, n * 16), 4, np.int32)
        self.before, self.before2 = np.zeros(n, np.int64), np.zeros(n, np.int64)
        self.rows = np.arange(n)
        self.base2, self.base1, self.base4 = self.rows << _T2, self.rows << _T1, self.rows << 2

    def predict(self, k: int):
        """For the first ``k`` blocks: places in the tables, predictions, and the mixed distribution over who is right."""
        b1, b2 = self.before[:k], self.before2[:k]
        p1 = self.base1[:k] + ((b1 * 40503 >> 4) & ((1 << _T1) - 1))
        p2 = self.base2[:k] + (((b1 * 2654435761 ^ b2 * 40503) >> 8) & ((1 << _T2) - 1))
        t2, t1 = self.two[p2].astype(np.int64), self.one[p1].astype(np.int64)
        says2, says1, says0 = t2 >> 2, t1 >> 2, self.id0[:k]
        at = self.base4[:k]
        contexts = (at + (t2 & 3), at + (t1 & 3), at + 2 * (says2 == says1) + (self.hit0[:k] > 4))
        shares = []
        for table, c in zip(self.seen, contexts, strict=True):
            v = table.take(c, axis=1)
            shares.append((v << 10) // (v[0] + v[1] + v[2] + v[3]) + 1)
        w = self.weight[:, :k]
        mixed = (shares[0] * w[0] + shares[1] * w[1] + shares[2] * w[2]) >> 6
        return self.rows[:k], (p2, p1), (says2, says1, says0), (t2 & 3, t1 & 3), contexts, shares, mixed + 1

    def update(self, ids: np.ndarray, who: np.ndarray, rows, places, says, hits, contexts, shares) -> None:
        k = len(rows)
        flat = who * k + rows
        told = [s.ravel()[flat] for s in shares]
        mean = (told[0] + told[1] + told[2]) // 3
        for i, x in enumerate(told):
            w = self.weight[i, :k]
            np.clip(w + ((x - mean) >> 3), 16, 1024, out=w)
        for table, c in zip(self.seen, contexts, strict=True):
            _count(table, c, who, 24, 768)
        for table, p, s, old in ((self.two, places[0], says[0], hits[0]), (self.one, places[1], says[1], hits[1])):
            right = s == ids
            table[p] = np.where(right | (old > 1), s, ids) << 2 | np.where(right, np.minimum(old + 1, 3), old >> 1)
        right = says[2] == ids                                  # a majority vote for the id of order 0
        votes = self.hit0[:k] + np.where(right, 4, -1)
        self.id0[:k] = np.where(votes < 0, ids, says[2])
        self.hit0[:k] = np.clip(np.where(votes < 0, 1, votes), 0, 255)
        self.before2[:k] = self.before[:k]
        self.before[:k] = ids

    def learn_half(self, table: np.ndarray, at: np.ndarray, half: np.ndarray) -> None:
        _count(table, at, half, 12, 1536)


def _count(table: np.ndarray, at: np.ndarray, symbol: np.ndarray, step: int, most: int) -> None:
    """Adds to the frequency of a symbol at each place; a place whose symbol passes ``most`` is halved."""
    cells, flat = symbol * table.shape[1] + at, table.ravel()
    n = flat[cells] + step
    flat[cells] = n
    full = at[n > most]
    if len(full):
        table[:, full] = (table[:, full] >> 1) + 1


def _upto(freq: np.ndarray) -> np.ndarray:
    """Running sums over symbols, a row at a time: several times faster than a cumulative sum along the first axis."""
    out = np.array(freq, np.int32)
    for i in range(1, len(out)):
        np.add(out[i - 1], out[i], out=out[i])
    return out


def _bounds(freq: np.ndarray, symbol: np.ndarray):
    """Start, frequency and total of each block's symbol; ``freq`` has a row for every symbol."""
    upto = _upto(freq)
    cells = symbol * freq.shape[1] + np.arange(len(symbol))
    f = freq.ravel()[cells]
    return upto.ravel()[cells] - f, f, upto[-1]


class _Writer:
    def __init__(self, n: int, longest: int):
        self.low, self.span = np.zeros(n, U64), np.full(n, (1 << 64) - 1, U64)
        self.out, self.size = np.zeros((n, 3 * longest + 16), np.uint16), np.zeros(n, np.int64)

    def put(self, who: np.ndarray, start: np.ndarray, freq: np.ndarray, total: np.ndarray) -> None:
        low, span = self.low[who], self.span[who]
        unit = span // total.astype(U64)
        low += start.astype(U64) * unit
        span = freq.astype(U64) * unit
        short = np.flatnonzero(span <= _LOW32)
        while len(short):
            lo, sp = low[short], span[short]
            sp = np.where((lo ^ (lo + sp)) < _TOP, sp, (~lo + U64(1)) & _LOW32)     # carry-less: cut the span at the border it crosses
            lane = who[short]
            self.out[lane, self.size[lane]] = (lo >> U64(48)).astype(np.uint16)
            self.size[lane] += 1
            low[short], span[short] = lo << _SIXTEEN, sp << _SIXTEEN
            short = short[span[short] <= _LOW32]
        self.low[who], self.span[who] = low, span

    def end(self, i: int) -> bytes:
        low = int(self.low[i])
        tail = np.array([low >> s & 0xFFFF for s in (48, 32, 16, 0)], np.uint16)
        return np.concatenate((self.out[i, : self.size[i]], tail)).astype("<u2").tobytes()


class _Reader:
    def __init__(self, payloads: list[bytes]):
        n, longest = len(payloads), max(map(len, payloads)) // 2
        self.words = np.zeros((n, longest + 8), np.uint16)
        for i, p in enumerate(payloads):
            self.words[i, : len(p) // 2] = np.frombuffer(p, "<u2")
        self.code, self.at = np.zeros(n, U64), np.full(n, 4)
        for k in range(4):
            self.code = self.code << _SIXTEEN | self.words[:, k].astype(U64)
        self.low, self.span = np.zeros(n, U64), np.full(n, (1 << 64) - 1, U64)

    def get(self, who: np.ndarray, freq: np.ndarray | None, total: np.ndarray | None = None) -> np.ndarray:
        """The next symbol of each block in ``who``; without ``freq`` a byte of equal odds."""
        low, span, code = self.low[who], self.span[who], self.code[who]
        if freq is None:
            unit = span >> U64(8)
            symbol = np.minimum((code - low) // unit, U64(255)).astype(np.int64)
            start, f = symbol, np.ones(len(who), np.int64)
        else:
            upto = _upto(freq)
            unit = span // upto[-1].astype(U64)
            target = np.minimum((code - low) // unit, (upto[-1] - 1).astype(U64)).astype(np.int32)
            symbol = (upto <= target).sum(axis=0)
            cells = symbol * freq.shape[1] + np.arange(len(who))
            f = freq.ravel()[cells]
            start = upto.ravel()[cells] - f
        low += start.astype(U64) * unit
        span = f.astype(U64) * unit
        short = np.flatnonzero(span <= _LOW32)
        while len(short):
            lo, sp = low[short], span[short]
            sp = np.where((lo ^ (lo + sp)) < _TOP, sp, (~lo + U64(1)) & _LOW32)
            lane = who[short]
            code[short] = code[short] << _SIXTEEN | self.words[lane, np.minimum(self.at[lane], self.words.shape[1] - 1)].astype(U64)
            self.at[lane] += 1
            low[short], span[short] = lo << _SIXTEEN, sp << _SIXTEEN
            short = short[span[short] <= _LOW32]
        self.low[who], self.span[who], self.code[who] = low, span, code
        return symbol


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Coded blocks, in the order given. Ids are below 65,536; a block has at most ``BLOCK`` of them."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    sizes = np.array([len(blocks[i]) for i in order])
    ids = np.zeros((max(1, int(sizes[0])), len(order)), np.int64)      # a row for every step
    for row, i in enumerate(order):
        ids[: len(blocks[i]), row] = blocks[i]
    if ids.max(initial=0) > 0xFFFF:
        raise ValueError("ids of 65,536 and above do not fit this format")
    m, w = _Models(len(order)), _Writer(len(order), max(1, int(sizes[0])))
    for t in range(int(sizes[0])):
        k = int(np.searchsorted(-sizes, -t, side="left"))       # blocks longer than t
        now = ids[t, :k]
        rows, places, says, hits, contexts, shares, mixed = m.predict(k)
        who = np.where(says[0] == now, 0, np.where(says[1] == now, 1, np.where(says[2] == now, 2, 3)))
        w.put(rows, *_bounds(mixed, who))
        spelt = np.flatnonzero(who == 3)
        if len(spelt):
            x = now[spelt]
            a, b, low = x >> 12, x >> 8 & 15, x & 255
            pair = spelt * 16 + a
            w.put(spelt, *_bounds(m.high.take(spelt, axis=1), a))
            w.put(spelt, *_bounds(m.next.take(pair, axis=1), b))
            w.put(spelt, low, np.ones(len(low), np.int64), np.full(len(low), 256))
            m.learn_half(m.high, spelt, a)
            m.learn_half(m.next, pair, b)
        m.update(now, who, rows, places, says, hits, contexts, shares)
    out = [b""] * len(order)
    for row, i in enumerate(order):
        payload = w.end(row)
        out[i] = _HEAD.pack(MAGIC, len(blocks[i]), len(payload), zlib.crc32(np.asarray(blocks[i], "<u4").tobytes())) + payload
    return out


def decode(blocks: list[bytes]) -> list[np.ndarray]:
    """The ids of each block; raises ValueError where header, size or checksum do not agree."""
    if not blocks:
        return []
    heads = [_HEAD.unpack_from(b) for b in blocks]
    for b, h in zip(blocks, heads, strict=True):
        if h[0] != MAGIC or len(b) != _HEAD.size + h[2]:
            raise ValueError("not a block of this format, or cut short")
    order = sorted(range(len(blocks)), key=lambda i: -heads[i][1])
    sizes = np.array([heads[i][1] for i in order])
    m, r = _Models(len(order)), _Reader([blocks[i][_HEAD.size:] for i in order])
    ids = np.zeros((max(1, int(sizes[0])), len(order)), np.uint32)
    for t in range(int(sizes[0])):
        k = int(np.searchsorted(-sizes, -t, side="left"))
        rows, places, says, hits, contexts, shares, mixed = m.predict(k)
        who = r.get(rows, mixed)
        now = np.where(who == 0, says[0], np.where(who == 1, says[1], says[2])).astype(np.int64)
        spelt = np.flatnonzero(who == 3)
        if len(spelt):
            a = r.get(spelt, m.high.take(spelt, axis=1))
            pair = spelt * 16 + a
            b = r.get(spelt, m.next.take(pair, axis=1))
            now[spelt] = a << 12 | b << 8 | r.get(spelt, None)
            m.learn_half(m.high, spelt, a)
            m.learn_half(m.next, pair, b)
        m.update(now, who, rows, places, says, hits, contexts, shares)
        ids[t, :k] = now
    out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(order)
    for row, i in enumerate(order):
        out[i] = ids[: sizes[row], row].copy()
        if zlib.crc32(out[i].astype("<u4").tobytes()) != heads[i][3]:
            raise ValueError("checksum of a block does not agree with its ids")
    return out
