"""Token ids as checksummed blocks of an adaptive context-mixing range coder.

Every id is first predicted by the ids that followed the last two ids and the last one before in the block. Whether
a prediction holds is a flag, whose chance is mixed from two counters by their errors so far. An id that neither predicts is coded
by the order-0 frequencies of the block's ids, or as new by a fixed prior. The flags and the id are one interval of a
range coder. Frequencies are renewed after short periods, so that all ids of a period are modelled at
once; all arithmetic is in integers. Every block starts from the same state and can be decoded alone. Blocks are filled
across documents and coded in step, one lane of NumPy arrays each.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as T

U = np.uint64
#: Ids of a block at most, and pieces of documents.
BLOCK = 4096
#: Ids coded, and blocks decoded, in step at most.
IDS, LANES = 1 << 21, 256
#: Steps of the coder that are laid out together.
STEPS = 64
#: Ids between two renewals of the frequencies, when a block is under way.
PERIOD = 64
#: Bits of a flag's chance and of the order-0 frequencies; an interval has those of two flags and one frequency.
FLAG, ORDER0 = 12, 14
TOTAL = 2 * FLAG + ORDER0
#: Ids that wait to be coded together, so that blocks of like length go in step.
POOL = 4_000_000
#: Bits of the prior of new ids.
NEW = 22
_SLOTS = 13, 12
_RUNS, _PAST = 16, 64


@lru_cache(1)
def _prior() -> np.ndarray:
    """Cumulative frequencies of ids by themselves: ids of a merge vocabulary are the rarer the larger they are."""
    weight = 2**30 // (np.arange(65536) + 200)
    total = np.concatenate(([0], np.cumsum(weight)))
    return total * ((1 << NEW) - 65536) // total[-1] + np.arange(65537)


def _periods(longest: int) -> list[tuple[int, int]]:
    edges = [e for e in (0, 8, 16, 32) if e < longest] + list(range(PERIOD, longest, PERIOD)) + [longest]
    return list(zip(edges, edges[1:]))


def _slots(p1, p2) -> tuple[np.ndarray, np.ndarray]:
    """Places of the order-2 and the order-1 context, given the last id and the one before (each plus 1)."""
    return ((p1 * 40503 + p2 * 30011) * 2654435761 >> 11) & ((1 << _SLOTS[0]) - 1), (p1 * 2654435761 >> 9) & ((1 << _SLOTS[1]) - 1)


class _Model:
    """What encoder and decoder know of the ids so far, for some blocks at a time."""

    def __init__(self, n: int, longest: int):
        self.counts = np.zeros((n, longest + 1), np.int32)
        self.distinct = np.zeros(n, np.int64)
        self.escapes = np.ones(n, np.int64)
        self.hits = [[np.ones((n, k), np.int32) for k in (_RUNS, _PAST)] for _ in range(2)]
        self.seen = [[np.full((n, k), 4, np.int32) for k in (_RUNS, _PAST)] for _ in range(2)]
        self.errors = np.full((2, 2, n), 4096, np.int64)

    def renew(self, n: int) -> None:
        """New frequencies and chances for the first ``n`` blocks."""
        width = int(self.distinct[:n].max(initial=0))
        self.cum = np.zeros((n, width + 1), np.int32)
        np.cumsum(self.counts[:n, :width], 1, out=self.cum[:, 1:])
        self.total = self.cum[:, -1:] + self.escapes[:n, None]
        self.scale = (1 << ORDER0) - self.distinct[:n, None] - 1
        self.chance = [[(h[:n] << FLAG) // s[:n] for h, s in zip(*both)] for both in zip(self.hits, self.seen)]
        e = self.errors[:, :, :n]
        self.weight = np.clip((e[:, 1] << 8) // (e[:, 0] + e[:, 1]), 16, 240)

    def chances(self, order: int, lane: np.ndarray, run: np.ndarray, past: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The mixed chance that a prediction holds, and the two that it is mixed from."""
        one, two = self.chance[order]
        p, q = one.ravel().take(lane * _RUNS + run), two.ravel().take(lane * _PAST + past)
        w = self.weight[order].take(lane)
        return np.clip((p * w + q * (256 - w)) >> 8, 32, (1 << FLAG) - 32), p, q

    def place(self, lane: np.ndarray, index: np.ndarray) -> np.ndarray:
        """Where the frequency of the id with this number in the block begins."""
        c = self.cum.ravel().take(lane * self.cum.shape[1] + index).astype(np.int64)
        return c * self.scale[:, 0].take(lane) // self.total[:, 0].take(lane) + index

    def learn(self, lane: np.ndarray, index: np.ndarray, coded: np.ndarray, escaped: np.ndarray, flags: list) -> None:
        """Takes in a period: the number in the block of each id, whether it was coded by its frequency, whether as new, and of either order (lane, run, past, chances, hit) of the flags."""
        np.add.at(self.counts.reshape(-1), (lane * self.counts.shape[1] + index), np.where(coded, np.int32(2), np.int32(1)))
        np.maximum.at(self.distinct, lane, index + 1)
        self.escapes += np.bincount(lane[escaped], minlength=len(self.escapes))
        for order, (at, run, past, p, q, hit) in enumerate(flags):
            for k, (c, size) in enumerate(((run, _RUNS), (past, _PAST))):
                np.add.at(self.seen[order][k].reshape(-1), at * size + c, np.int32(1))
                np.add.at(self.hits[order][k].reshape(-1), (at * size + c)[hit], np.int32(1))
            goal = hit.astype(np.int64) << FLAG
            for k, x in enumerate((p, q)):
                self.errors[order, k] += np.bincount(at, np.abs(goal - x), len(self.escapes)).astype(np.int64)


def _guesses(x: np.ndarray, group: np.ndarray, key: np.ndarray, begin: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place the id (plus 1, as in ``x``) that came last in the same group of the block (0 if none did), and how many guesses there were right in a row (7 at most)."""
    n = len(x)
    s = np.sort(key | group << np.uint32(bits))
    at = (s & np.uint32((1 << bits) - 1)) + begin[s >> np.uint32(16 + bits)]
    s >>= np.uint32(bits)
    x = x[at]
    last = np.zeros(n, np.int32)
    np.multiply(x[:-1], s[1:] == s[:-1], out=last[1:])
    place = np.arange(n, dtype=np.int32)
    wrong = np.maximum.accumulate(place * (last != x))
    run = np.zeros(n, np.int32)
    np.minimum(place[:-1] - wrong[:-1], 7, out=run[1:])
    guess, runs = np.empty(n, np.int32), np.empty(n, np.int32)
    guess[at], runs[at] = last, run
    return guess, runs


def _numbers(x: np.ndarray, key: np.ndarray, begin: np.ndarray, bits: int) -> np.ndarray:
    """For each id its number in the order in which ids first occur in the block."""
    s = np.sort(key | (x - 1).astype(np.uint32) << np.uint32(bits))
    block = s >> np.uint32(16 + bits)
    at = (s & np.uint32((1 << bits) - 1)) + begin[block]
    s >>= np.uint32(bits)
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    opens = np.zeros(len(s) + 1, np.int32)
    opens[at[first] + 1] = 1
    np.cumsum(opens, out=opens)
    # Ids that occurred first at an earlier place of the block.
    number = opens[at[first]] - opens[begin[block[first]]]
    out = np.empty(len(s), np.int32)
    out[at] = number[np.cumsum(first) - 1]
    return out


def _later(x: np.ndarray, at: np.ndarray, k: int) -> np.ndarray:
    """Of each place what is ``k`` places before it in the block, or 0."""
    out = np.zeros_like(x)
    np.multiply(x[:-k], at[k:] >= k, out=out[k:])
    return out


def _told(ids: np.ndarray, size: np.ndarray) -> np.ndarray:
    """What is known of each id before it is coded, as bits: its number in the block (12), the last three outcomes (6), for either order the run of right guesses (4 each),
    whether it is asked (1 each) and whether it is right (1 each). Blocks are taken as many at a time as have keys of 32 bits with their ids and places."""
    edge = np.concatenate(([0], np.cumsum(size)))
    out, lo = np.empty(len(ids), np.uint32), 0
    while lo < len(size):
        bits = (int(size[lo]) - 1).bit_length()
        hi = min(len(size), lo + (1 << (16 - bits)))
        n, begin = size[lo:hi], edge[lo:hi] - edge[lo]
        x = ids[edge[lo] : edge[hi]] + np.int32(1)
        lane = np.repeat(np.arange(hi - lo, dtype=np.uint32), n)
        at = np.arange(len(x), dtype=np.uint32) - begin.astype(np.uint32)[lane]
        key = lane << np.uint32(16 + bits) | at
        p1, p2 = (_later(x, at, k).astype(np.uint32) for k in (1, 2))
        # Only low bits of the products count, so 32 hold them.
        (g2, r2), (g1, r1) = (_guesses(x, slot, key, begin, bits) for slot in _slots(p1, p2))
        agree = g1 == g2
        right = g2 == x
        asked = g2 > 0, (g1 > 0) & ~agree & ~right
        hit = asked[0] & right, asked[1] & (g1 == x)
        outcome = hit[0].astype(np.uint32) * np.uint32(2) + hit[1]
        made = _numbers(x, key, begin, bits).astype(np.uint32)
        for shift, v in zip((12, 14, 16, 18, 22, 26, 27, 28, 29), (*(_later(outcome, at, k) for k in (1, 2, 3)), r2 * 2 + agree, r1 * 2 + asked[0], *asked, *hit)):
            made |= v.astype(np.uint32) << np.uint32(shift)
        out[edge[lo] : edge[hi]] = made
        lo = hi
    return out


def _intervals(ids: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and width of the interval of every id, and whether one of the prior follows. Blocks one after another, longest first, none empty."""
    begin = np.cumsum(size) - size
    spans = [(s, e, int(np.searchsorted(-size, -s, "left"))) for s, e in _periods(int(size[0]))]
    told, total = _told(ids, size), len(ids)
    low, wide, escaped = np.empty(total, U), np.empty(total, U), np.empty(total, bool)
    model = _Model(len(size), int(size[0]))
    for s, e, n in spans:
        model.renew(n)
        length = np.minimum(size[:n], e) - s
        lane, at = np.repeat(np.arange(n), length), T.ragged(begin[:n] + s, length)
        known_of = told[at].astype(np.int64)
        number, past = known_of & 4095, known_of >> 12 & 63
        base, width, flags = None, None, []
        missed = np.ones(len(lane), bool)
        for order in (0, 1):
            asked = np.flatnonzero(known_of >> 26 + order & 1)
            mine = known_of[asked]
            there, runs, before, h = lane[asked], mine >> 18 + 4 * order & 15, past[asked], (mine >> 28 + order & 1).astype(bool)
            p, a, b = model.chances(order, there, runs, before)
            flags.append((there, runs, before, a, b, h))
            c, f = np.zeros(len(lane), np.int64), np.full(len(lane), 1 << FLAG)
            c[asked], f[asked] = np.where(h, 0, p), np.where(h, p, (1 << FLAG) - p)
            base, width = (c, f) if base is None else ((base << FLAG) + width * c, width * f)
            missed[asked[h]] = False
        j = np.flatnonzero(missed)
        there, x0 = lane[j], number[j]
        d = model.distinct.take(there)
        known = x0 < d
        x0 = np.minimum(x0, d)
        c = model.place(there, x0)
        f = np.where(known, model.place(there, np.minimum(x0 + 1, d)), 1 << ORDER0) - c
        lo, hi = base << ORDER0, width << ORDER0
        lo[j] += width[j] * c
        hi[j] = width[j] * f
        low[at], wide[at] = lo, hi
        esc = np.zeros(len(lane), bool)
        esc[j[~known]] = True
        escaped[at] = esc
        model.learn(lane, number, missed, esc, flags)
    return low, wide, escaped


def encode(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """One payload for each block of up to BLOCK ids below 65536."""
    out: list[bytes] = [b""] * len(blocks)
    order = sorted((i for i in range(len(blocks)) if len(blocks[i])), key=lambda i: -len(blocks[i]))
    lo = 0
    while lo < len(order):
        some = order[lo : lo + max(1, IDS // len(blocks[order[lo]]))]
        lo += len(some)
        size = np.array([len(blocks[i]) for i in some])
        if size.max() > BLOCK:
            raise ValueError(f"a block has at most {BLOCK} ids")
        flat = np.concatenate([np.asarray(blocks[i]) for i in some])
        if flat.min() < 0 or flat.max() > 65535:
            raise ValueError("ids must be from 0 to 65535")
        for i, made in zip(some, _payloads(flat.astype(np.int32), size)):
            out[i] = made
    return out


def _payloads(ids: np.ndarray, size: np.ndarray) -> list[bytes]:
    low, wide, escaped = _intervals(ids, size)
    n, prior, new = len(size), _prior(), ids[escaped]
    # Steps of a lane: its ids, each new one followed by one more.
    after = np.cumsum(escaped)
    edge = np.concatenate(([0], np.cumsum(size)))
    edge += np.concatenate(([0], after))[edge]
    at = np.arange(len(ids)) + after - escaped
    where, width = np.empty(edge[-1], U), np.empty(edge[-1], U)
    where[at], width[at] = low, wide
    at = at[escaped] + 1
    where[at], width[at] = prior[new] << (TOTAL - NEW), (prior[new + 1] - prior[new]) << (TOTAL - NEW)
    del low, wide, escaped, after, at
    steps = np.diff(edge)
    rank = np.argsort(-steps, kind="stable")
    steps, longest = steps[rank], int(steps.max())
    # A step whose interval is everything, as lanes that ended have, changes nothing; two last ones show the eight bytes that end a lane.
    grid, moved, carry = np.zeros((n, longest + 2), U), np.zeros((n, longest + 2), np.uint8), np.zeros((n, longest + 2), bool)
    share = np.full((n, longest), 1 << TOTAL, U)
    for k, (i, m) in enumerate(zip(edge[rank].tolist(), steps.tolist())):
        grid[k, :m], share[k, :m] = where[i : i + m], width[i : i + m]
    del where, width
    value, span = np.zeros(n, U), np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    for s in range(0, longest, STEPS):
        e, m = min(s + STEPS, longest), int(np.searchsorted(-steps, -s, "left"))
        _code(shown := grid[:m, s:e].T.copy(), shift := share[:m, s:e].T.copy(), over := np.empty((e - s, m), bool), value[:m], span[:m])
        grid[:m, s:e], moved[:m, s:e], carry[:m, s:e] = shown.T, (shift >> U(3)).astype(np.uint8).T, over.T
    lane = np.arange(n)
    grid[lane, steps], grid[lane, steps + 1] = value, value << U(32)
    moved[lane, steps], moved[lane, steps + 1] = 4, 4
    moved, carry = moved.ravel(), np.flatnonzero(carry)
    ends = np.cumsum(moved, dtype=np.int64)
    at = np.flatnonzero(moved)
    count, shown = moved[at], (grid.ravel()[at] >> U(32)).astype(np.uint32)
    raw, at = np.empty(int(ends[-1]), np.uint8), ends[at] - count
    for k in range(4):
        raw[at + k] = shown >> np.uint32(24 - 8 * k)
        more = np.flatnonzero(count > k + 1)
        at, count, shown = at[more], count[more], shown[more]
    # A carry goes to the byte before. None comes twice to a byte at a time: an interval passes its top once until bytes leave.
    over = ends[carry] - moved[carry] - 1
    while len(over):
        raw[over] += np.uint8(1)
        over = over[raw[over] == 0] - 1
    data, edge = raw.tobytes(), [0, *ends[longest + 1 :: longest + 2].tolist()]
    out: list[bytes] = [b""] * n
    for i, a, b in zip(rank.tolist(), edge, edge[1:]):
        # Trailing zeros are what a decoder reads beyond the end.
        out[i] = data[a:b].rstrip(b"\0")
    return out


def _code(where: np.ndarray, width: np.ndarray, carry: np.ndarray, value: np.ndarray, span: np.ndarray) -> None:
    """Codes a step of all lanes by each row, given begins and widths, which are replaced by the registers before bytes leave and the number of bits that leave.

    Those follow from the exponent of the new span as a double, from which bits are left out first that could round it up.
    """
    unit, left, add = (np.empty(len(value), U) for _ in range(3))
    real = np.empty(len(value))
    exponent, whole = real.view(U), add.view(np.int64)
    digits, spare, fraction, base, bytes_ = (np.array(x, U) for x in (TOTAL, 11, 52, 63 + 1023 - 11, 56))
    for v, w, over in zip(where, width, carry):
        np.right_shift(span, digits, unit)
        np.multiply(unit, v, add)
        np.add(value, add, v)
        np.less(v, add, over)
        np.multiply(unit, w, left)
        np.right_shift(left, spare, add)
        np.copyto(real, whole)
        np.right_shift(exponent, fraction, add)
        np.subtract(base, add, add)
        np.bitwise_and(add, bytes_, w)
        np.left_shift(v, w, value)
        np.left_shift(left, w, span)


def decode(payloads: Sequence[bytes], sizes: Sequence[int]) -> list[np.ndarray]:
    """The ids of each block, given their number."""
    out: list[np.ndarray] = [np.zeros(0, np.int32)] * len(payloads)
    order = sorted((i for i in range(len(payloads)) if sizes[i]), key=lambda i: -sizes[i])
    for lo in range(0, len(order), LANES):
        some = order[lo : lo + LANES]
        for i, ids in zip(some, _ids([payloads[i] for i in some], np.array([sizes[i] for i in some], np.int64))):
            out[i] = ids
    return out


def _ids(payloads: list[bytes], size: np.ndarray) -> list[np.ndarray]:
    n, longest = len(size), int(size[0])
    room = max(map(len, payloads)) + 16
    buffer = np.zeros((n, room), np.uint8)
    for k, x in enumerate(payloads):
        buffer[k, : len(x)] = np.frombuffer(x, np.uint8)
    used = np.full(n, 8)
    code = np.zeros(n, U)
    for k in range(8):
        code = code << U(8) | buffer[:, k].astype(U)
    span = np.full(n, 0xFFFFFFFFFFFFFFFF, U)
    ids, number_of, id_of = np.zeros((n, longest), np.int32), np.full((n, 65536), -1, np.int16), np.zeros((n, longest + 1), np.int32)
    guess = [np.zeros((n, 1 << bits), np.int32) for bits in _SLOTS]
    runs = [np.zeros((n, 1 << bits), np.int32) for bits in _SLOTS]
    distinct, past, p1, p2 = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    model, prior = _Model(n, longest), _prior()

    def take(at: np.ndarray, begin: np.ndarray, width: np.ndarray) -> None:
        """Removes an interval from the code and renews the registers."""
        unit = span[at] >> U(TOTAL)
        c, r = code[at] - unit * begin.astype(U), unit * width.astype(U)
        while len(short := np.flatnonzero(r < U(1 << 56))):
            r[short] <<= U(8)
            c[short] = c[short] << U(8) | buffer[at[short], np.minimum(used[at[short]], room - 1)].astype(U)
            used[at[short]] += 1
        code[at], span[at] = c, r

    for s, e in _periods(longest):
        n = int(np.searchsorted(-size, -s, "left"))
        model.renew(n)
        told: list[tuple] = []
        asked: list[list[tuple]] = [[], []]
        for t in range(s, e):
            m = int(np.searchsorted(-size, -t, "left"))
            lane = np.arange(m)
            slot = _slots(p1[:m], p2[:m])
            g2, g1 = (g[lane, x] for g, x in zip(guess, slot))
            r2, r1 = (np.minimum(r[lane, x], 7) for r, x in zip(runs, slot))
            agree = g1 == g2
            unit = span[:m] >> U(TOTAL)
            target = np.minimum(code[:m] // unit, U((1 << TOTAL) - 1)).astype(np.int64)
            base, width, rest = np.zeros(m, np.int64), np.ones(m, np.int64), target
            found, missed, outcome = np.zeros(m, np.int64), np.ones(m, bool), np.zeros(m, np.int64)
            left = TOTAL
            for order, (g, r) in enumerate(((g2, r2 * 2 + agree), (g1, r1 * 2 + (g2 > 0)))):
                left -= FLAG
                j = np.flatnonzero((g > 0) & missed & ((order == 0) | ~agree))
                p, a, b = model.chances(order, j, r[j], past[j])
                edge = ((base[j] << FLAG) + width[j] * p) << left
                h = target[j] < edge
                asked[order].append((j, r[j], past[j], a, b, h))
                c, f = np.zeros(m, np.int64), np.full(m, 1 << FLAG)
                c[j], f[j] = np.where(h, 0, p), np.where(h, p, (1 << FLAG) - p)
                base, width = (base << FLAG) + width * c, width * f
                missed[j[h]] = False
                found[j[h]] = g[j[h]] - 1
                outcome[j[h]] = 2 - order
            j = np.flatnonzero(missed)
            goal = (target[j] - (base[j] << ORDER0)) // width[j]
            # The last id whose frequency begins at the goal or before, by bisection; the one after the known ids is new.
            a, b = np.zeros(len(j), np.int64), model.distinct[j].copy()
            while (a < b).any():
                middle = (a + b + 1) >> 1
                below = model.place(j, middle) <= goal
                a, b = np.where(below, middle, a), np.where(below, b, np.maximum(middle - 1, a))
            known = a < model.distinct[j]
            c = model.place(j, a)
            f = np.where(known, model.place(j, np.minimum(a + 1, model.distinct[j])), 1 << ORDER0) - c
            start, wide = base << ORDER0, width << ORDER0
            start[j], wide[j] = start[j] + width[j] * c, width[j] * f
            take(lane, start, wide)
            found[j[known]] = id_of[j[known], a[known]]
            new = j[~known]
            if len(new):
                point = (np.minimum(code[new] // (span[new] >> U(TOTAL)), U((1 << TOTAL) - 1)).astype(np.int64)) >> (TOTAL - NEW)
                x = np.searchsorted(prior, point, "right") - 1
                take(new, prior[x] << (TOTAL - NEW), (prior[x + 1] - prior[x]) << (TOTAL - NEW))
                found[new] = x
            fresh = np.flatnonzero(number_of[lane, found] < 0)
            number_of[fresh, found[fresh]] = distinct[fresh]
            id_of[fresh, distinct[fresh]] = found[fresh]
            distinct[fresh] += 1
            escaped = np.zeros(m, bool)
            escaped[new] = True
            told.append((lane, number_of[lane, found].astype(np.int64), missed, escaped))
            for g, r, x in zip(guess, runs, slot):
                r[lane, x] = np.where(g[lane, x] == found + 1, r[lane, x] + 1, 0)
                g[lane, x] = found + 1
            ids[:m, t] = found
            past[:m] = (past[:m] << 2 | outcome) & 63
            p2[:m], p1[:m] = p1[:m], found + 1
        flags = [tuple(np.concatenate(x) for x in zip(*a)) for a in asked]
        model.learn(*(np.concatenate(x) for x in zip(*told)), flags)
    return [ids[k, : size[k]].copy() for k in range(len(size))]


@lru_cache(2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if max(ranks.values(), default=0) > 65535:
        raise ValueError(f"{path} has ids above 65535")
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_PLAIN = np.zeros(256, bool)
_PLAIN[33:127] = True


#: Bits of the number of places in the table of known stretches.
_TABLE = 21


class Tokenizer:
    """Ids of texts by a byte-level BPE with the usual word pattern, each distinct stretch of text encoded once.

    That pattern always begins a piece at a space between two other non-space characters, at a mark after a letter or digit,
    and at what follows a single line break, so stretches that begin there are encoded independently. Only ASCII characters and those of two
    bytes in UTF-8 count here as such neighbours. Stretches without white space but a space in front are encoded many at a time, with line breaks between.
    """

    def __init__(self, path: str, pattern: str, most: int = 1_000_000):
        self.encoding, self.most = _encoding(path, pattern), most
        self.newline = self.encoding.encode_ordinary("\n")
        self.forget()

    def forget(self) -> None:
        self.entry: dict[bytes, int] = {}
        self.place, self.lead = np.full(1 << _TABLE, -1, np.int64), np.zeros(1 << _TABLE, np.int64)
        self.key = np.zeros((3, 1024), U)
        self.start = np.zeros(1024, np.int64)
        self.size = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint16)
        self.used = 0

    def _encode_all(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all, and how many each has."""
        joined = [k for k, s in enumerate(stretches) if len(s) > 1 and s[1:].split() == [s[1:]] and (s[0] == " " or not s[0].isspace())]
        if len(self.newline) != 1 or len(joined) < 2:
            joined = []
        size = np.zeros(len(stretches), np.int64)
        flat = np.array(self.encoding.encode_ordinary("\n".join([stretches[k] for k in joined])) if joined else [], np.int64)
        edge = np.flatnonzero(flat == self.newline[0]) if joined else np.zeros(0, np.int64)
        size[joined] = np.diff(np.concatenate(([-1], edge, [len(flat)]))) - 1 if joined else 0
        rest = sorted(set(range(len(stretches))) - set(joined))
        single = [self.encoding.encode_ordinary(stretches[k]) for k in rest]
        size[rest] = [len(x) for x in single]
        begin = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint16)
        out[T.ragged(begin[joined], size[joined])] = flat[flat != self.newline[0]] if joined else 0
        out[T.ragged(begin[rest], size[rest])] = np.array([x for y in single for x in y], np.uint16)
        return out, size

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each text's begin (and the end)."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint16), np.zeros(len(off), np.int64)
        plain, word = _PLAIN[data], _WORD[data]
        # No character of two bytes whose first is 0xC3 or more is white space.
        two = (data >= 0xC3) & (data < 0xE0)
        after, before = plain | two, plain.copy()
        before[1:] |= two[:-1]
        cut = np.zeros(n + 1, bool)
        cut[1 : n - 1] = (data[1:-1] == 32) & before[:-2] & after[2:]
        cut[1:n] |= word[:-1] & plain[1:] & ~word[1:]
        cut[2:n] |= before[:-2] & (data[1:-1] == 10) & after[2:]
        cut[off] = True
        edges = np.flatnonzero(cut)
        start, end = edges[:-1], edges[1:]
        slot = self._entries(data, start, end)
        counts = self.size[slot]
        ends = np.concatenate(([0], np.cumsum(counts)))
        return self.ids[T.ragged(self.start[slot], counts)], ends[np.searchsorted(edges, off)]

    def _entries(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each stretch's entry. Up to 16 bytes are compared as two words and a length, longer stretches as they are; no two stretches are told apart by a hash alone."""
        if len(self.entry) > self.most:
            self.forget()
        length = end - start
        key = np.stack((T.loaded(data, start, np.minimum(length, 8)), T.loaded(data, np.maximum(end - 8, start), np.where(length > 8, 8, 0)), length.astype(U)))
        place = (T.mix(key[0] + T.mix(key[1] + key[2] * U(T.BASE))) >> U(64 - _TABLE)).astype(np.int64)
        out = self.place[place]
        same = (out >= 0) & (length <= 16)
        for k in range(3):
            same &= self.key[k][np.maximum(out, 0)] == key[k]
        missing = np.flatnonzero(~same)
        if len(missing):
            # Of equal stretches one is looked up for all.
            self.lead[place[missing]] = missing
            lead = self.lead[place[missing]]
            twin = (length[missing] <= 16) & (lead != missing)
            for k in range(3):
                twin &= key[k][missing] == key[k][lead]
            twins, lead, missing = missing[twin], lead[twin], missing[~twin]
            raw = data.tobytes()
            words = [raw[i:j] for i, j in zip(start[missing].tolist(), end[missing].tolist())]
            new = [w for w in dict.fromkeys(words) if w not in self.entry]
            if new:
                made, size = self._encode_all([w.decode("utf-8", "replace") for w in new])
                first = len(self.entry)
                self.entry.update(zip(new, range(first, first + len(new))))
                self.start = _grown(self.start, first, self.used + np.cumsum(size) - size)
                self.size = _grown(self.size, first, size)
                self.ids = _grown(self.ids, self.used, made)
                self.used += len(made)
            out[missing] = [self.entry[w] for w in words]
            out[twins] = out[lead]
            short = missing[length[missing] <= 16]
            self.place[place[short]] = out[short]
            if len(self.entry) > self.key.shape[1]:
                self.key = np.concatenate((self.key, np.zeros((3, 2 * len(self.entry)), U)), 1)
            self.key[:, out[short]] = key[:, short]
        return out


def _grown(a: np.ndarray, used: int, more: np.ndarray) -> np.ndarray:
    """``a`` with ``more`` from ``used`` on, in twice the room where it is short."""
    if used + len(more) > len(a):
        a = np.concatenate((a, np.zeros(used + 2 * len(more), a.dtype)))
    a[used : used + len(more)] = more
    return a


@lru_cache(2)
def _shared(path: str, pattern: str) -> Tokenizer:
    """One for all tasks of a Python worker; what it knows only saves time."""
    return Tokenizer(path, pattern)


def encode_documents(docs: DataFrame, tokenizer: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, block, n_tokens, checksum, payload): the token ids of every text in blocks of ``block``.

    ``tokenizer`` is the path of a rank file for tiktoken with ids below 65536, ``pattern`` its word pattern. The checksum is the CRC-32 of
    the ids as little-endian 16-bit integers. Null texts have no block, empty ones a block without ids. Null ids and repeated
    rows come out row by row, as they came in. Other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, wait, waiting = _shared(tokenizer, pattern), [], 0
        for batch in batches:
            valid, names = np.asarray(batch.column(1).is_valid()), batch.column(0).to_pylist()
            for lo, hi, data, off in T.pieces(batch.column(1)):
                ids, begin = words.encode(data, off)
                for i in np.flatnonzero(valid[lo:hi]).tolist():
                    wait += [(names[lo + i], k, ids[begin[i] + k * block : min(begin[i] + (k + 1) * block, begin[i + 1])]) for k in range(max(1, -(-int(begin[i + 1] - begin[i]) // block)))]
                waiting += len(ids)
                if waiting >= POOL:
                    yield flush(wait)
                    wait, waiting = [], 0
        if wait:
            yield flush(wait)

    def flush(wait: list) -> pa.RecordBatch:
        made = encode([w[2] for w in wait])
        sums = [zlib.crc32(w[2].astype("<u2").tobytes()) for w in wait]
        return pa.RecordBatch.from_arrays([pa.array([w[0] for w in wait], pa.int64()), pa.array([w[1] for w in wait], pa.int32()), pa.array([len(w[2]) for w in wait], pa.int32()), pa.array(sums, pa.int64()), pa.array(made, pa.binary())], ["doc_id", "block", "n_tokens", "checksum", "payload"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("t")).mapInArrow(T.tidy(run), "doc_id bigint, block int, n_tokens int, checksum bigint, payload binary")


def decode_blocks(blocks: DataFrame) -> DataFrame:
    """(doc_id, block, ids) of the rows of ``encode_documents``; a block whose checksum fails raises ValueError."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, sums = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            ids = decode(batch.column(4).to_pylist(), sizes)
            for doc, k, s, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), sums, ids):
                if zlib.crc32(x.astype("<u2").tobytes()) != s:
                    raise ValueError(f"checksum of document {doc}, block {k}")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x.tolist() for x in ids], pa.list_(pa.int32()))], ["doc_id", "block", "ids"])

    return blocks.select("doc_id", "block", "n_tokens", "checksum", "payload").mapInArrow(T.tidy(run), "doc_id bigint, block int, ids array<int>")
