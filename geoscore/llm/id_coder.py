"""An adaptive range coder for blocks of token ids, run over many blocks at once.

For each id three predictions are mixed: the id that last followed the same two ids (order 2), the one that last followed
the same id (order 1), and the frequencies so far (order 0). How far each of the first two is trusted is learned for each
level of its confidence, the number of times in a row that its context was right. The mix gives a part of the coder's range
to either prediction and the rest to all ids by the frequency of their group, evenly within a group. Every block starts from
the same empty model and is decoded by itself.

Blocks go side by side, one id of each at a time; writer and reader step the same model. Contexts learn at every id, trust
and frequencies after rounds of ids. Frequencies are parts of ``PLACES`` and a table per block says whose part each place is,
so no group is searched for. The coder's numbers are whole and at most 2 ** 52, where doubles reckon exactly. Steps write into
arrays made once, since making them takes longer than what is reckoned.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np

WHOLE = 1 << 16  # of the range that predictions take parts of
MOST_HIT = 15 << 12  # most that both predictions together may take of it
SLOTS = 512  # of the tables of order 1 and 2, a power of two
LEVELS = 4
# Hits and tries, in sixteenths, that each level of confidence starts with.
START1, START2, START_TRIES = np.array([2, 18, 40, 61]), np.array([3, 42, 83, 120]), 128
SINGLES, WIDTH = 256, 256  # ids with a frequency of their own; least width of the groups above
PLACES = 1 << 12  # parts that the frequencies are given in
SPAN_BITS = PLACES.bit_length()
GAIN = 24  # what an id adds to its group's frequency
ROUND, LAST_ROUND = 64, 1024  # ids between two updates of trust and frequencies, at first and at last
WORD, TINY, TOP = float(1 << 24), float(1 << 28), float(1 << 52)  # what leaves the coder at once; least and most of its range
WORD_BITS, WORD_BYTES = 24, 3


def _width(vocabulary: int) -> int:
    """Ids in a group; many ids have wider groups, so that there are always far fewer groups than places."""
    width = WIDTH
    while SINGLES + vocabulary // width >= PLACES // 2:
        width *= 2
    return width


def _group(ids: np.ndarray, width: int) -> np.ndarray:
    return np.where(ids >= SINGLES, SINGLES + (ids - SINGLES) // width, ids)


def _rounds(steps: int) -> list[tuple[int, int]]:
    """Rounds of ids, which grow with what was seen before."""
    out, begin = [], 0
    while begin < steps:
        end = min(steps, begin + min(max(begin, ROUND), LAST_ROUND))
        out.append((begin, end))
        begin = end
    return out


class _Model:
    """What all three orders say of the next id of every lane."""

    def __init__(self, lanes: int, vocabulary: int, searched: bool):
        self.lanes, self.group_width, self.searched = lanes, _width(vocabulary), searched
        self.n_groups = int(_group(np.array(vocabulary - 1), self.group_width)) + 1
        if self.group_width > PLACES:
            raise ValueError(f"a vocabulary of {vocabulary} ids leaves some without a share of the range")
        rows, orders = np.arange(lanes), np.arange(2)[:, None]
        # Of order 1 and 2: LEVELS * id + level in every slot, and hits and tries by level.
        self.slots, self.cells = (orders * lanes + rows) * SLOTS, (orders * lanes + rows) * LEVELS
        self.held = np.empty(2 * lanes * SLOTS, np.int32)
        self.held.fill(0)
        self.hits, self.tries = np.zeros((2, lanes * LEVELS), np.int64), np.zeros((2, lanes * LEVELS), np.int64)
        self.starts = np.stack([np.tile(START1, lanes), np.tile(START2, lanes)])
        self.last, self.mixed = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32)  # the last id, and that before times a constant
        self.group_rows, self.place_rows, self.results = rows * self.n_groups, rows * PLACES, rows * (3 * LEVELS)
        self.counts = np.ones((lanes, self.n_groups))
        self.counts[:, SINGLES:] = 2
        numbers = np.arange(self.n_groups)
        self.first_id = np.where(numbers >= SINGLES, SINGLES + (numbers - SINGLES) * self.group_width, numbers).astype(float)
        self.width = np.where(numbers >= SINGLES, float(self.group_width), 1.0)
        self.seen, self.k = np.zeros((LAST_ROUND, 2, lanes), np.int32), 0
        self.at, self.cell = np.zeros((2, lanes), np.int64), np.zeros((2, lanes), np.int64)
        self.said, self.new = np.zeros((2, lanes), np.int32), np.zeros((2, lanes), np.int32)
        self.shares, self.left, self.plain = np.zeros((2, lanes)), np.zeros(lanes), np.zeros(lanes, np.int32)
        self.right, self.differ = np.zeros((2, lanes), bool), np.zeros(lanes, bool)
        self.both, self.second = self.shares
        self.said1, self.said2 = self.said
        self._renew()

    def _renew(self) -> None:
        # For order 2 the share itself, for order 1 that of what order 2 leaves.
        self.share = (16 * self.hits + self.starts) / (16 * self.tries + START_TRIES)
        self.share[1] = 1 + np.floor((MOST_HIT - 200) * self.share[1])
        # Every group has one place at least, the rest go by counts.
        ends = np.zeros((self.lanes, self.n_groups + 1), np.int32)
        sums = np.cumsum(self.counts, axis=1)
        ends[:, 1:] = sums * ((PLACES - self.n_groups) / sums[:, -1:])
        ends[:, -1] = PLACES - self.n_groups
        ends += np.arange(self.n_groups + 1, dtype=np.int32)
        sizes = ends[:, 1:] - ends[:, :-1]
        self.spans = (ends[:, :-1] * (2 * PLACES) + sizes).reshape(-1)  # where the group's places begin, and how many
        if self.searched:
            self.group_at = np.repeat(np.tile(np.arange(self.n_groups, dtype=np.uint16), self.lanes), sizes.reshape(-1))

    def predict(self) -> None:
        by_last, slot, first, second, left = self.plain, self.new, self.both, self.second, self.left
        np.multiply(self.last, np.int32(40503), out=by_last)
        np.right_shift(by_last, 4, out=slot[0])
        by_last += self.mixed
        np.right_shift(by_last, 3, out=slot[1])
        slot &= SLOTS - 1
        np.add(slot, self.slots, out=self.at)
        self.now = self.seen[self.k]
        self.held.take(self.at, out=self.now, mode="clip")
        np.right_shift(self.now, 2, out=self.said)
        np.bitwise_and(self.now, LEVELS - 1, out=self.new)
        np.add(self.new, self.cells, out=self.cell)
        self.share.take(self.cell, out=self.shares, mode="clip")
        # Order 1 has a share of what order 2 leaves, none if both say the same.
        np.subtract(WHOLE, second, out=left)
        first *= left
        np.floor(first, out=first)
        first += 1
        np.subtract(MOST_HIT, second, out=left)
        np.minimum(first, left, out=first)
        np.not_equal(self.said1, self.said2, out=self.differ)
        first *= self.differ
        first += second  # now that of both

    def parts(self, width: np.ndarray, end2: np.ndarray, end1: np.ndarray, unit: np.ndarray) -> None:
        """Of the coder's range: where the parts of order 2 and of both predictions end, and one place of what is left."""
        np.multiply(width, 1 / WHOLE, out=unit)
        np.floor(unit, out=unit)
        np.multiply(unit, self.second, out=end2)
        np.multiply(unit, self.both, out=end1)
        np.subtract(width, end1, out=unit)
        unit *= 1 / PLACES
        np.floor(unit, out=unit)

    def compare(self, ids: np.ndarray) -> None:
        np.equal(self.said, ids, out=self.right)

    def update(self, ids: np.ndarray) -> None:
        """After ``compare``. A slot that was right grows surer, another one begins anew."""
        np.left_shift(ids, 2, out=self.plain)
        np.copyto(self.new, self.plain)
        few = self.right.reshape(-1).nonzero()[0]
        now = self.now.reshape(-1)[few]
        self.new.reshape(-1)[few] = np.minimum(now + 1, now | (LEVELS - 1))
        self.held[self.at] = self.new
        np.multiply(self.last, np.int32(25253), out=self.mixed)
        self.last = ids
        self.k += 1

    def end_round(self, ids: np.ndarray, groups: np.ndarray) -> None:
        """``ids`` and their ``groups``: one row per step of the round, one column per lane."""
        for k in range(0, self.k, ROUND):
            now = slice(k, min(k + ROUND, self.k))
            seen = self.seen[now]
            said, level = seen >> 2, (seen & (LEVELS - 1)).astype(np.int8)
            hit = (said == ids[now, None]).view(np.int8)
            # What came of them: not asked, missed or hit; order 1 is asked where order 2 missed and said something else.
            came = 1 + hit
            came[:, 0] *= (said[:, 0] != said[:, 1]) & (hit[:, 1] == 0)
            came *= LEVELS
            came += level
            for order in range(2):
                x = np.bincount((came[:, order] + self.results).reshape(-1), minlength=3 * self.tries.shape[1])
                x = x.reshape(self.lanes, 3, LEVELS)
                self.tries[order] += (x[:, 1] + x[:, 2]).reshape(-1)
                self.hits[order] += x[:, 2].reshape(-1)
        # Lane by lane, so that a lane's counts stay at hand.
        at = np.ascontiguousarray(groups.T) + self.group_rows[:, None]
        self.counts += GAIN * np.bincount(at.reshape(-1), minlength=self.counts.size).reshape(self.counts.shape)
        self.k = 0
        self._renew()


def encode_blocks(blocks: list[np.ndarray], vocabulary: int) -> list[bytes]:
    """The payload of each block. A block shorter than the longest one is coded with zeros after its end."""
    lanes, steps = len(blocks), max(map(len, blocks))
    grid = np.zeros((lanes, steps), np.int32)
    for row, block in zip(grid, blocks):
        row[: len(block)] = block
    grid = np.ascontiguousarray(grid.T)
    model = _Model(lanes, vocabulary, searched=False)
    low, width = np.zeros(lanes), np.full(lanes, TOP)
    end2, end1, unit, part, offset, of_group = (np.zeros(lanes) for _ in range(6))
    span, field, at = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32), np.zeros(lanes, np.int64)
    room = 2 * steps + 8  # an id takes less than two words
    out, rows, n = np.zeros(lanes * room, np.int32), np.arange(lanes) * room, np.zeros(lanes, np.int64)
    for begin, end in _rounds(steps):
        groups = _group(grid[begin:end], model.group_width)
        for ids, group in zip(grid[begin:end], groups):
            model.predict()
            model.parts(width, end2, end1, unit)
            # The rest of the range for order 0: a group's places, and the id's even part of them.
            np.add(group, model.group_rows, out=at)
            model.spans.take(at, out=span, mode="clip")
            np.copyto(at, group)
            np.bitwise_and(span, 2 * PLACES - 1, out=field)
            np.multiply(unit, field, out=part)
            model.width.take(at, out=of_group, mode="clip")
            part /= of_group
            np.floor(part, out=part)
            np.right_shift(span, SPAN_BITS, out=field)
            unit *= field
            unit += end1
            model.first_id.take(at, out=of_group, mode="clip")
            np.subtract(ids, of_group, out=offset)
            offset *= part
            unit += offset
            end1 -= end2
            model.compare(ids)
            few = model.right[0].nonzero()[0]
            unit[few], part[few] = end2[few], end1[few]
            few = model.right[1].nonzero()[0]
            unit[few], part[few] = 0, end2[few]
            low += unit
            width, part = part, width
            model.update(ids)
            # Below TOP plus its range; what is above TOP is carried into the word before, at last.
            few = np.flatnonzero(width < TINY)
            while len(few):
                of = low[few]
                word = np.floor(of * (1 / TINY))
                out[rows[few] + n[few]] = word
                n[few] += 1
                low[few] = (of - word * TINY) * WORD
                width[few] *= WORD
                few = few[width[few] < TINY]
        model.end_round(grid[begin:end], groups)
    # One more word names a place inside the range that is left.
    out[rows + n] = np.ceil(low * (1 / TINY))
    out = out.reshape(lanes, room)[:, : n.max() + 1]
    carry = out >> WORD_BITS
    out &= int(WORD) - 1
    out[:, :-1] += carry[:, 1:]
    over = np.flatnonzero((out >> WORD_BITS).any(axis=1))
    while len(over):
        carry = out[over] >> WORD_BITS
        out[over] &= int(WORD) - 1
        out[over, :-1] += carry[:, 1:]
        over = over[(out[over] >> WORD_BITS).any(axis=1)]
    return [row[: k + 1].astype("<u4").view(np.uint8).reshape(-1, 4)[:, :WORD_BYTES].tobytes() for row, k in zip(out, n)]


def decode_blocks(payloads: list[bytes], sizes: list[int], vocabulary: int) -> list[np.ndarray]:
    lanes, steps = len(payloads), max(sizes)
    room = max(map(len, payloads)) // WORD_BYTES + 4
    words = np.zeros((lanes, room, 4), np.uint8)
    for row, payload in zip(words, payloads):
        n = len(payload) // WORD_BYTES
        row[:n, :WORD_BYTES] = np.frombuffer(payload, np.uint8, n * WORD_BYTES).reshape(n, WORD_BYTES)
    words = words.view("<u4").reshape(lanes, room)
    # The code is two words and four bits, so four bits are read ahead.
    code = words[:, 0] * TINY + words[:, 1] * 16.0 + (words[:, 2] >> 20)
    words[:, :-1] = (words[:, :-1] << 4 & 0xFFFFFF) | words[:, 1:] >> 20
    words = words.reshape(-1)
    width, at_word = np.full(lanes, TOP), np.arange(lanes) * room + 2
    model = _Model(lanes, vocabulary, searched=True)
    grid = np.zeros((steps, lanes), np.int32)
    end2, end1, unit, part, place, rest, wide, found = (np.zeros(lanes) for _ in range(8))
    span, field, at, group_at = np.zeros(lanes, np.int32), np.zeros(lanes, np.int32), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    group, flag = np.zeros(lanes, np.uint16), np.zeros(lanes, bool)
    for begin, end in _rounds(steps):
        for ids in grid[begin:end]:
            model.predict()
            model.parts(width, end2, end1, unit)
            np.subtract(code, end1, out=rest)
            np.divide(rest, unit, out=place)
            np.maximum(place, 0, out=place)
            np.minimum(place, PLACES - 1, out=place)
            np.copyto(at, place, casting="unsafe")
            at += model.place_rows
            model.group_at.take(at, out=group, mode="clip")
            np.copyto(group_at, group)
            np.add(group_at, model.group_rows, out=at)
            model.spans.take(at, out=span, mode="clip")
            np.bitwise_and(span, 2 * PLACES - 1, out=field)
            np.multiply(unit, field, out=part)
            model.width.take(group_at, out=wide, mode="clip")
            part /= wide
            np.floor(part, out=part)
            np.right_shift(span, SPAN_BITS, out=field)
            unit *= field
            rest -= unit
            np.divide(rest, part, out=place)
            np.floor(place, out=place)
            wide -= 1
            np.minimum(place, wide, out=place)
            model.first_id.take(group_at, out=found, mode="clip")
            found += place
            place *= part
            rest -= place
            # Only behind the parts of both predictions was the id one of order 0.
            np.copyto(ids, found, casting="unsafe")
            np.less(code, end1, out=flag)
            few = flag.nonzero()[0]
            of, end_of = code[few], end2[few]
            second = of < end_of
            ids[few] = np.where(second, model.said2[few], model.said1[few])
            part[few] = np.where(second, end_of, end1[few] - end_of)
            rest[few] = np.where(second, of, of - end_of)
            code, rest = rest, code
            width, part = part, width
            model.compare(ids)
            model.update(ids)
            few = np.flatnonzero(width < TINY)
            while len(few):
                at_few = at_word[few]
                code[few] = code[few] * WORD + words.take(at_few, mode="clip")
                at_word[few] = at_few + 1
                width[few] *= WORD
                few = few[width[few] < TINY]
        model.end_round(grid[begin:end], _group(grid[begin:end], model.group_width))
    return [row[:n] for row, n in zip(np.ascontiguousarray(grid.T), sizes)]


def checksum(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _times(matrix: list[int], vector: int) -> int:
    out = 0
    for row in matrix:
        if not vector:
            break
        if vector & 1:
            out ^= row
        vector >>= 1
    return out


@lru_cache(64)
def _zeros(power: int) -> list[int]:
    """The map that appends 2 ** ``power`` zero bits to what a register has read."""
    if power == 0:
        return [0xEDB88320] + [1 << k for k in range(31)]
    half = _zeros(power - 1)
    return [_times(half, row) for row in half]


def joined_crc(first: int, second: int, length: int) -> int:
    """The CRC-32 of two byte strings in a row, from the CRC-32 of each and the length of the second.

    Appending a zero bit is a linear map of the register; its powers, worked out once, append ``length`` zero bytes.
    """
    bits, power = length * 8, 0
    while bits:
        if bits & 1:
            first = _times(_zeros(power), first)
        bits, power = bits >> 1, power + 1
    return first ^ second
