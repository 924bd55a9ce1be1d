"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that know nothing of each other, each with a checksum. A block starts with the list of its
different ids; a symbol is a place in that list. Order 2 and order 1 predict the symbol that last followed the two
symbols, or the one symbol, before; order 0 is the distribution of the symbols that neither of them had right. How far
each order is trusted is learned in the block, apart for every pair of confidences that orders 2 and 1 have in their
predictions. A block holds two range codes: which order is right, under the mixed trust, and the symbols of order 0.

All blocks of a call advance together, one symbol a step, so that each NumPy operation works on every block. What was
seen is taken into trust and order 0 at set steps (see _trust_steps and LITERAL_STEPS), so that in between the encoder
handles many steps at once and the decoder only looks up. As order 0 doesn't depend on the other orders, its code is read
first.
"""

from __future__ import annotations

import zlib

import numpy as np

#: Ids in a block, and blocks that advance together in the decoder and the encoder, whose arrays are larger.
BLOCK, TOGETHER, ENCODED_TOGETHER = 4096, 2048, 768
#: The longest block: a table's entry is symbol * 4 + confidence in 16 bits, and a symbol of order 0 takes 16 at most.
MOST = 8192
#: Places in the order-2 table of a block, and what the symbol before the last is multiplied by to find one.
PLACES, SPREAD = 2048, 2477
#: What a symbol's count rises by in order 0, and numbers of symbols after which it takes them in.
STEP = 1
LITERAL_STEPS = (32, 64, 128, 256, 512, 768, 1024, 1536, 2048, 3072, 4096, 6144)
#: The total of an order's trusts, the least of each, and the count of choices where those are halved.
TOTAL, LEAST, TRUST_MOST = 4096, 64, 170
_TWO = np.full(TOGETHER, 2, dtype=np.int16)
_BITS16, _LOW, _ALL = 2.0**16, 2.0**32, 2.0**48


def _trust_steps(steps: int):
    """Runs of steps between which trust is learned: short ones at first, then 64."""
    at = [0, *(x for x in (8, 16, 32) if x < steps), *range(64, steps, 64), steps]
    return zip(at[:-1], at[1:], strict=True)


def _literal_steps(steps: int):
    at = [0, *(x for x in LITERAL_STEPS if x < steps), steps]
    return zip(at[:-1], at[1:], strict=True)


def _next(entries: np.ndarray, symbol4: np.ndarray) -> np.ndarray:
    """Entries of a table after a symbol, times 4: one more confidence, 3 at most, where they had it right, else 1."""
    x = entries ^ symbol4
    y = np.minimum(x, _TWO[: x.shape[-1]])
    y *= x < 4
    y += symbol4
    y += np.int16(1)
    return y


class _Orders:
    """The predictions of orders 1 and 2 in all blocks, and how far they are trusted."""

    def __init__(self, n: int, width: int):
        lane = np.arange(n)
        self.lane1, self.lane2, self.lane32 = lane * width, n * width + lane * PLACES, lane * 32
        self.table = np.zeros(n * (width + PLACES), dtype=np.int16)
        context = np.arange(32)
        known1, known2, same = context & 3 > 0, context >> 2 & 3 > 0, context >> 4 > 0
        self.may = np.tile(np.stack([known2, known1 & ~(same & known2), np.ones(32, dtype=bool)]).astype(np.float64), n)
        self.counts = self.may * [[1.0], [0.5], [1.0]]
        self._share()

    def _share(self) -> None:
        """Of TOTAL, order 2 has what is below `two`, order 1 what is then below `one`, order 0 the rest."""
        share = np.floor(self.counts[:2] * ((TOTAL - 3 * LEAST) / self.counts.sum(axis=0)))
        share += LEAST
        share *= self.may[:2]
        self.two, self.one = share[0], share[0] + share[1]

    def learn(self, context: np.ndarray, chosen: np.ndarray) -> None:
        """context: places in the counts, by steps and blocks; chosen: 0 where order 2 had it right, 1 order 1, else 2."""
        size = self.counts.shape[1]
        marks = chosen * np.int64(size)
        marks += context
        self.counts += np.bincount(marks.reshape(-1), minlength=3 * size).reshape(3, size)
        self.counts *= np.where(self.counts.sum(axis=0) > TRUST_MOST, 0.5, 1.0)
        self._share()


class _Order0:
    """Counts of the symbols of all blocks, one block's after another's."""

    def __init__(self, kinds: np.ndarray):
        self.kinds, self.first = kinds, np.cumsum(kinds) - kinds
        self.counts = np.ones(int(kinds.sum()), dtype=np.int64)
        self._sum()

    def _sum(self) -> None:
        ends = np.cumsum(self.counts)
        before = np.concatenate([[0], ends])[self.first]
        self.total = np.add.reduceat(self.counts, self.first)
        self.share = (1 - 2.0**-50) / self.total  # a product with a size is never rounded above the true share
        # In one number, whose whole part is where a symbol's part of the total begins, and the rest its size.
        self.parts = self.counts * (1 / _BITS16)
        self.parts += ends - self.counts - np.repeat(before, self.kinds)
        self.base = before

    def learn(self, places: np.ndarray) -> None:
        self.counts += STEP * np.bincount(places.reshape(-1), minlength=len(self.counts))
        self._sum()

    def slots(self) -> np.ndarray:
        """The symbol of every unit of the totals."""
        symbols = np.arange(len(self.counts), dtype=np.int32) - np.repeat(self.first, self.kinds)
        return np.repeat(symbols.astype(np.int16), self.counts)


class _Writer:
    """A range code for each block. Low ends and sizes are whole numbers that a double holds; 16 bits leave at once, and
    carries are settled at the end."""

    def __init__(self, n: int, most: int):
        self.low, self.size = np.zeros(n), np.full(n, _ALL)
        self.out = np.zeros((n, most))
        self.flat = self.out.reshape(-1)
        self.first = np.arange(n) * most
        self.at = self.first.copy()

    def put(self, start, size, unit) -> None:
        self.low += start * unit
        np.multiply(size, unit, out=self.size)

    def shift(self) -> None:
        small = self.size < _LOW
        top = np.floor(self.low * (1 / _LOW))
        self.flat[self.at] = top  # where nothing leaves, the next one overwrites it
        self.at += small
        top *= small
        top *= _LOW
        self.low -= top
        factor = np.where(small, _BITS16, 1.0)
        self.low *= factor
        self.size *= factor

    def end(self) -> list[bytes]:
        """The codes; a reader takes what follows for zeros."""
        self.flat[self.at] = np.ceil(self.low * (1 / _LOW))
        words = self.out.astype(np.uint32)
        while len(over := np.flatnonzero(words > 0xFFFF)):
            flat = words.reshape(-1)
            flat[over] &= np.uint32(0xFFFF)
            flat[over - 1] += np.uint32(1)
        words = words.astype("<u2")
        return [w[:k].tobytes() for w, k in zip(words, (self.at - self.first + 1).tolist(), strict=True)]


class _Reader:
    def __init__(self, codes: list[np.ndarray]):
        n, most = len(codes), max(map(len, codes), default=0) + 4
        words = np.zeros((n, most))
        for row, code in zip(words, codes, strict=True):
            row[: len(code)] = code
        self.words = words.reshape(-1)
        self.at = np.arange(n) * most + 3
        self.code = words[:, 0] * _LOW + words[:, 1] * _BITS16 + words[:, 2]
        self.size = np.full(n, _ALL)

    def shift(self) -> None:
        small = self.size < _LOW
        factor = np.where(small, _BITS16, 1.0)
        self.size *= factor
        self.code *= factor
        word = self.words.take(self.at, mode="clip")
        word *= small
        self.code += word
        self.at += small


def _pack_list(ids: np.ndarray) -> bytes:
    """Ascending ids: their number, gaps of a byte each, and the gaps that need more."""
    gaps = np.diff(ids.astype(np.int64), prepend=-1) - 1
    wide = gaps[gaps >= 255]
    return np.uint32(len(ids)).tobytes() + np.uint32(len(wide)).tobytes() + np.minimum(gaps, 255).astype(np.uint8).tobytes() + wide.astype("<u4").tobytes()


def _unpack_list(data: memoryview) -> tuple[np.ndarray, int]:
    n, wide = (int(x) for x in np.frombuffer(data[:8], dtype="<u4"))
    gaps = np.frombuffer(data[8 : 8 + n], dtype=np.uint8).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data[8 + n : 8 + n + 4 * wide], dtype="<u4")
    return np.cumsum(gaps + 1) - 1, 8 + n + 4 * wide


def checksum(ids: np.ndarray) -> int:
    """CRC-32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def encode_blocks(ids: np.ndarray, block: int = BLOCK) -> list[bytes]:
    """A coded block for every so many ids: number of ids, their checksum, list of different ids, number of symbols of
    order 0, number of 16-bit words of the first code, both codes."""
    if not 0 < block <= MOST:
        raise ValueError(f"a block has 1 to {MOST} ids")
    out: list[bytes] = []
    for first in range(0, len(ids), block * ENCODED_TOGETHER):
        out += _encode_together(ids[first : first + block * ENCODED_TOGETHER], block)
    return out


def _encode_together(ids: np.ndarray, block: int) -> list[bytes]:
    parts = [ids[i : i + block] for i in range(0, len(ids), block)]
    n, steps = len(parts), len(parts[0])
    heads, rows = [], np.zeros((n, steps), dtype=np.int16)
    kinds = np.zeros(n, dtype=np.int64)
    seen = np.zeros(int(ids.max()) + 2 if int(ids.max(initial=0)) < 1 << 22 else 1, dtype=bool)
    place = np.zeros(len(seen), dtype=np.int16)
    for i, part in enumerate(parts):
        if len(seen) > 1:
            seen[part] = True
            known = np.flatnonzero(seen)
            place[known] = np.arange(len(known))
            rows[i, : len(part)] = place[part]
            seen[known] = False
        else:
            known, rows[i, : len(part)] = np.unique(part, return_inverse=True)
        kinds[i] = len(known)
        heads.append(np.uint32(len(part)).tobytes() + np.uint32(checksum(part)).tobytes() + _pack_list(known))
    # Only the last block can end early; after that it goes on with symbol 0, which is coded in no bits.
    short = len(parts[-1])
    past = np.zeros((steps + 2, n), dtype=np.int16)
    past[2:] = rows.T
    chosen, choices = _encode_choices(past, int(kinds.max()), short)
    literal = np.ascontiguousarray(chosen.T) == 2
    literal[-1, short:] = False
    numbers = literal.sum(axis=1)
    literals = _encode_literals(rows[literal], numbers, kinds)
    return [
        head + np.array([k, len(a) // 2], dtype="<u4").tobytes() + a + b
        for head, k, a, b in zip(heads, numbers.tolist(), choices, literals, strict=True)
    ]


def _encode_choices(past: np.ndarray, width: int, short: int) -> tuple[np.ndarray, list[bytes]]:
    """past: two steps of zeros, then steps by blocks. Which order is right (as in learn) and its codes."""
    steps, n = len(past) - 2, past.shape[1]
    orders, writer = _Orders(n, width), _Writer(n, steps * 7 // 16 + 4)
    out = np.empty((steps, n), dtype=np.int8)
    for a, b in _trust_steps(steps):
        at = np.empty((b - a, 2, n), dtype=np.int64)
        one = past[a + 1 : b + 1].astype(np.int64)
        np.add(one, orders.lane1, out=at[:, 0])
        at[:, 1] = (past[a:b] * np.int64(SPREAD) + one & PLACES - 1) + orders.lane2
        symbol4 = past[a + 2 : b + 2] << np.int16(2)
        entries = np.empty((b - a, 2, n), dtype=np.int16)
        for i in range(b - a):
            orders.table.take(at[i], out=entries[i], mode="clip")
            orders.table[at[i]] = _next(entries[i], symbol4[i])
        context = _context(entries[:, 0], entries[:, 1]) + orders.lane32
        right = entries ^ symbol4[:, None]
        right = (right > 0) & (right < 4)
        chosen = np.where(right[:, 1], np.int8(0), np.where(right[:, 0], np.int8(1), np.int8(2)))
        out[a:b] = chosen
        two, one = orders.two[context], orders.one[context]
        start = np.where(chosen == 0, 0.0, np.where(chosen == 1, two, one))
        size = np.where(chosen == 0, two, np.where(chosen == 1, one, TOTAL)) - start
        if b > short:
            start[max(0, short - a) :, -1], size[max(0, short - a) :, -1] = 0, TOTAL
        for i in range(b - a):
            writer.put(start[i], size[i], np.floor(writer.size * (1 / TOTAL)))
            if (a + i) & 1:
                writer.shift()
        orders.learn(context, chosen)
    writer.shift()
    return out, writer.end()


def _context(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The confidences of orders 1 and 2, and whether they predict the same."""
    context = (two & np.int16(3)) << np.int16(2)
    context |= one & np.int16(3)
    context |= ((one ^ two) < 4).view(np.int8) << np.int8(4)
    return context


def _encode_literals(symbols: np.ndarray, numbers: np.ndarray, kinds: np.ndarray) -> list[bytes]:
    """symbols: those of order 0, one block's after another's."""
    n, steps = len(numbers), int(numbers.max())
    model, writer = _Order0(kinds), _Writer(n, steps + 4)
    ends = np.cumsum(numbers)
    rows = np.zeros((n, steps), dtype=np.int32)
    for row, end, number in zip(rows, ends.tolist(), numbers.tolist(), strict=True):
        row[:number] = symbols[end - number : end]
    rows += model.first.astype(np.int32)[:, None]
    places = np.ascontiguousarray(rows.T)
    least = int(numbers.min())
    for a, b in _literal_steps(steps):
        for t in range(a, b):
            part = model.parts.take(places[t])
            start = np.floor(part)
            part -= start
            part *= _BITS16
            if t >= least:
                over = numbers <= t
                start[over], part[over] = 0, model.total[over]
            writer.put(start, part, np.floor(writer.size * model.share))
            writer.shift()
        if b < steps:
            model.learn(places[a:b])
    return writer.end()


def decode_blocks(blocks: list, block: int = BLOCK) -> np.ndarray:
    """The ids of coded blocks, in order. Raises ValueError where a checksum doesn't hold."""
    out = [_decode_together(blocks[i : i + TOGETHER]) for i in range(0, len(blocks), TOGETHER)]
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint32)


def _decode_together(blocks: list) -> np.ndarray:
    sizes, sums, lists, numbers, choices, literals = [], [], [], [], [], []
    for data in map(memoryview, blocks):
        size, total = (int(x) for x in np.frombuffer(data[:8], dtype="<u4"))
        known, used = _unpack_list(data[8:])
        number, words = (int(x) for x in np.frombuffer(data[8 + used : 16 + used], dtype="<u4"))
        codes = np.frombuffer(data[16 + used :], dtype="<u2")
        if not 0 < len(known) <= number <= size <= MOST:
            raise ValueError("a block of token ids has impossible numbers")
        for kept, x in zip((sizes, sums, lists, numbers, choices, literals), (size, total, known, number, codes[:words], codes[words:]), strict=True):
            kept.append(x)
    kinds = np.array([len(x) for x in lists])
    with np.errstate(all="ignore"):  # broken codes may overflow before their checksum tells
        places = _decode_choices(choices, _decode_literals(literals, max(numbers), kinds), int(kinds.max()), max(sizes))
    out = []
    for known, row, size, total in zip(lists, places, sizes, sums, strict=True):
        row = row[:size]
        if int(row.max()) >= len(known) or checksum(ids := known[row].astype(np.uint32)) != total:
            raise ValueError("a block of token ids doesn't match its checksum")
        out.append(ids)
    return np.concatenate(out)


def _decode_literals(codes: list, steps: int, kinds: np.ndarray) -> np.ndarray:
    """Symbols of order 0, blocks by steps; a block that has ended goes on with any of its symbols."""
    model, reader = _Order0(kinds), _Reader(codes)
    out = np.empty((steps, len(codes)), dtype=np.int16)
    slot, place = np.empty((2, len(codes)), dtype=np.int64)
    for a, b in _literal_steps(steps):
        slots, most = model.slots(), model.total - 1.0
        for t in range(a, b):
            unit = np.floor(reader.size * model.share)
            value = np.floor(reader.code / unit)
            np.minimum(value, most, out=value)
            np.add(value, model.base, out=slot, casting="unsafe")
            np.add(model.first, slots.take(slot, out=out[t], mode="clip"), out=place)
            part = model.parts.take(place)
            start = np.floor(part)
            part -= start
            start *= unit
            reader.code -= start
            unit *= _BITS16
            np.multiply(part, unit, out=reader.size)
            reader.shift()
        if b < steps:
            model.learn(out[a:b] + model.first)
    return np.ascontiguousarray(out.T)


def _decode_choices(codes: list, literals: np.ndarray, width: int, steps: int) -> np.ndarray:
    """Symbols, blocks by steps."""
    n = len(codes)
    orders, reader = _Orders(n, width), _Reader(codes)
    next_literal = np.arange(n) * literals.shape[1]
    literals = literals.reshape(-1)
    out = np.empty((steps, n), dtype=np.int16)
    at, entries = np.empty((2, n), dtype=np.int64), np.empty((2, n), dtype=np.int16)
    at1, at2 = at
    # By chosen order: where its part of the range begins and, a row below, ends; what it predicts.
    ranges, guesses = np.zeros((4, n)), np.empty((3, n), dtype=np.int16)
    _, two, one, top = ranges
    guess2, guess1, literal = guesses
    lane, pick = np.arange(n), np.empty(n, dtype=np.int64)
    past, mixed = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    for a, b in _trust_steps(steps):
        contexts, chosen = np.empty((b - a, n), dtype=np.int64), np.empty((b - a, n), dtype=np.int8)
        for i in range(b - a):
            np.add(orders.lane1, past, out=at1)
            np.add(mixed, past, out=at2)
            at2 &= PLACES - 1
            at2 += orders.lane2
            orders.table.take(at, out=entries, mode="clip")
            context = np.add(_context(*entries), orders.lane32, out=contexts[i])
            unit = np.floor(reader.size * (1 / TOTAL))
            np.multiply(orders.two.take(context), unit, out=two)
            np.multiply(orders.one.take(context), unit, out=one)
            np.multiply(unit, TOTAL, out=top)
            not1 = reader.code >= one
            np.add((reader.code >= two).view(np.int8), not1.view(np.int8), out=chosen[i])
            np.multiply(chosen[i], np.int64(n), out=pick)
            pick += lane
            start = ranges.take(pick)
            reader.code -= start
            np.right_shift(entries[0], np.int16(2), out=guess1)
            np.right_shift(entries[1], np.int16(2), out=guess2)
            literals.take(next_literal, out=literal, mode="clip")
            next_literal += not1
            symbol = guesses.take(pick, out=out[a + i], mode="clip")
            pick += n
            np.subtract(ranges.take(pick), start, out=reader.size)
            if (a + i) & 1:
                reader.shift()
            orders.table[at] = _next(entries, symbol << np.int16(2))
            np.multiply(past, SPREAD, out=mixed)
            past[:] = symbol
        if b < steps:
            orders.learn(contexts, chosen)
    return np.ascontiguousarray(out.T)
