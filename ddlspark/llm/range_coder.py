"""An adaptive context-mixing range coder for token ids; many lanes of one unit in lockstep.

A unit of ids is dealt to lanes, each a run of consecutive ids; a step codes one id of every lane.  The lanes share the unit's models, so
these learn from all lanes at each step.  An id is predicted by the one that last followed the two ids before it (order 2)
and by the one that last followed the id before it (order 1), each with a confidence.  How often ids came true under both confidences
together gives the shares of code space: of the first prediction, the second, and of all other ids, which are coded by their adaptive
frequencies (order 0), made anew every few steps.  The shares drive a range coder per lane, with 64-bit state and 32-bit
output words; carries are added to words already written, so that the decoder needs only its distance from the range's low end.  A unit
starts from nothing, so each can be decoded alone.  Ids may be of any size up to 2^18.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

LANES, STEPS = 4096, 512  # of a unit, at most
UNIT = LANES * STEPS
PAIRS = 20  # bits of a slot of two ids
SURE = 3  # bits of a confidence
TOP = (1 << SURE) - 1
SAME = 1 << 2 * SURE  # states of two confidences; as many more for equal predictions
TOTAL = np.uint64(20)  # bits of the order-0 frequencies' sum
SHARE = np.uint64(16)  # bits of the shares' sum
RENEW, RESHARE = 64, 4  # steps between new order-0 frequencies and between new shares, at most
FULL = np.uint64(1 << 32)
HALF, LOW = np.uint64(32), np.uint64((1 << 32) - 1)
HEAD = "<IIIII"


class Models:
    """Predictions of a unit, learned by encoder and decoder alike.

    ``table`` holds the predictions of both orders, order 2 first: the id, then the bits of its confidence.
    ``edges`` and ``widths`` have four places a state: where the shares of the outcomes 0, 1 and 2 begin, and their sizes.
    """

    def __init__(self, lanes: int, alphabet: int):
        self.table = np.full((1 << PAIRS) + alphabet + 1, -1 << SURE, np.int32)
        self.one, self.two = np.full((2, lanes), alphabet, np.int64)
        self.outcomes = np.tile(np.array([2, 1, 4, 0]), (2 * SAME, 1))
        self.outcomes[SAME:, 1] = 0  # both predict the same id
        self.edges, self.widths = np.zeros((2 * SAME, 4), np.uint64), np.zeros((2 * SAME, 4), np.uint64)
        self.counts = np.zeros(alphabet, np.int64)
        self.waiting: list[np.ndarray] = []
        self.step, self.due = 0, 0

    def renew(self) -> None:
        """New shares and new order-0 frequencies, if they are due."""
        if self.step < RENEW or self.step % RESHARE == 0:
            seen = self.outcomes[:, :2]
            shares = (seen * (65_000 / self.outcomes.sum(axis=1))[:, None]).astype(np.uint64) + (seen > 0)
            self.widths[:, :2] = shares
            self.edges[:, 1] = shares[:, 0]
            self.edges[:, 2] = shares[:, 0] + shares[:, 1]
            self.widths[:, 2] = np.uint64(1 << 16) - self.edges[:, 2]
        if self.step >= self.due:
            if self.waiting:
                self.counts += np.bincount(np.concatenate(self.waiting), minlength=len(self.counts))
            self.waiting = []
            room = (1 << int(TOTAL)) - len(self.counts)
            self.width = 1 + (self.counts * (room / max(1, int(self.counts.sum())))).astype(np.int64)
            self.cum = np.cumsum(self.width) - self.width
            self.width[-1] = (1 << int(TOTAL)) - self.cum[-1]
            self.due = self.step + min(RENEW, max(1, self.step))
            self.found = None
        self.step += 1

    def predict(self, lanes: int) -> np.ndarray:
        """Of the first ``lanes`` lanes, the first place of their states in ``edges``."""
        one, two = self.one[:lanes], self.two[:lanes]
        self.slot = np.empty((2, lanes), np.int64)
        np.right_shift(one * 0x9E3779B1 + two * 0x85EBCA6B, 7, out=self.slot[0])
        self.slot[0] &= (1 << PAIRS) - 1
        np.add(one, 1 << PAIRS, out=self.slot[1])
        self.known = self.table.take(self.slot)
        self.id, self.conf = self.known >> SURE, self.known & TOP
        state = (self.conf[0] << SURE) + self.conf[1] + (self.id[0] == self.id[1]) * np.int32(SAME)
        return state.astype(np.int64) << 2

    def learn(self, ids: np.ndarray, cell: np.ndarray, escaped: np.ndarray) -> None:
        """``cell``: the places in ``edges`` of the outcomes: 0 or 1 for the prediction that came true, else 2."""
        self.outcomes += np.bincount(cell, minlength=self.outcomes.size).reshape(-1, 4)
        self.waiting.append(escaped)
        hit = self.id == ids
        lost = ~hit
        new = self.known + (hit & (self.conf < TOP)) - ((self.conf + 1) >> 1) * lost
        np.copyto(new, (ids << SURE) + np.int32(1), where=lost & (self.conf <= 1))
        self.table[self.slot] = new
        self.two[: len(ids)] = self.one[: len(ids)]
        self.one[: len(ids)] = ids

    def ids_at(self, value: np.ndarray) -> np.ndarray:
        """The ids in whose order-0 ranges the values lie."""
        if self.found is None:
            self.found = np.repeat(np.arange(len(self.counts), dtype=np.int32), self.width)
        return self.found.take(value)


def columns_of(n: int) -> tuple[int, int]:
    """(lanes, steps) of a unit of ``n`` ids; only the last lane may be shorter."""
    steps = max(1, -(-n // LANES)) if n >= LANES * STEPS else max(1, min(STEPS, n))
    return max(1, -(-n // steps)), steps


class Writer:
    """The ranges of all lanes, and their words, each with room for a carry."""

    def __init__(self, lanes: int, steps: int):
        self.low, self.size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
        self.words, self.at = np.zeros((2 * steps + 2, lanes), np.uint64), np.zeros(lanes, np.int64)  # by place: lanes write to near places

    def narrow(self, lanes: np.ndarray | slice, bits: np.uint64, begin: np.ndarray, width: np.ndarray) -> None:
        """Narrow the ranges of ``lanes`` to parts of 2^``bits``; those that get smaller than 32 bits write a word."""
        size = self.size[lanes] >> bits
        begin = size * begin
        low = self.low[lanes] + begin
        size *= width
        over, less = low < begin, size < FULL
        numbered = not isinstance(lanes, slice)
        if over.any():
            k = lanes[over] if numbered else np.flatnonzero(over)
            self.words[self.at[k] - 1, k] += np.uint64(1)
        some = np.flatnonzero(less)
        k = lanes[some] if numbered else some
        at, now = self.at.take(k), low.take(some)
        self.words[at, k] = now >> HALF
        self.at[k] = at + 1
        low[some] = now << HALF
        size[some] = size.take(some) << HALF
        self.low[lanes], self.size[lanes] = low, size

    def done(self) -> tuple[np.ndarray, np.ndarray]:
        """The words of all lanes, one lane after another, and how many each has."""
        self.words[self.at, np.arange(len(self.at))] = (self.low >> HALF) + ((self.low & LOW) > 0)  # a number of the range whose lower half is 0
        last = int(self.at.max())
        for k in range(last, 0, -1):
            self.words[k - 1] += self.words[k] >> HALF
        words = np.ascontiguousarray(self.words[: last + 1].astype("<u4").T)
        return words[np.arange(last + 1) <= self.at[:, None]], self.at + 1


def encode_unit(ids: np.ndarray) -> bytes:
    """``ids``: at most UNIT of them, from 0 on."""
    n = len(ids)
    lanes, steps = columns_of(n)
    alphabet = int(ids.max(initial=0)) + 1
    if not 0 <= int(ids.min(initial=0)) or alphabet > 1 << 18:
        raise ValueError("ids must be from 0 to 2^18 - 1")
    padded = np.zeros(lanes * steps, np.int32)
    padded[:n] = ids
    columns = np.ascontiguousarray(padded.reshape(lanes, steps).T)
    short = steps - (lanes * steps - n)  # ids of the last lane
    models, out = Models(lanes, alphabet), Writer(lanes, steps)
    for t in range(steps if n else 0):
        m = lanes if t < short else lanes - 1
        models.renew()
        cell, x = models.predict(m), columns[t, :m]
        one, two = (models.id == x).view(np.uint8)
        outcome = (2 - two) * (1 - one)
        cell += outcome
        out.narrow(slice(m), SHARE, models.edges.take(cell), models.widths.take(cell))
        rest = np.flatnonzero(outcome == 2)
        own = x[rest]
        if len(rest):
            out.narrow(rest, TOTAL, models.cum.take(own).astype(np.uint64), models.width.take(own).astype(np.uint64))
        models.learn(x, cell, own)
    words, sizes = out.done()
    packed = zlib.compress(sizes.astype("<u2").tobytes())
    return struct.pack(HEAD, n, lanes, steps, alphabet, len(packed)) + packed + words.tobytes()


def decode_unit(data: bytes) -> np.ndarray:
    """The ids that ``encode_unit`` was given.  ``data`` that is no unit raises ValueError or gives other ids; checksums tell."""
    n, lanes, steps, alphabet, packed = struct.unpack_from(HEAD, data)
    base = struct.calcsize(HEAD)
    try:
        sizes = np.frombuffer(zlib.decompress(data[base : base + packed]), "<u2").astype(np.int64)
        flat = np.frombuffer(data, "<u4", int(sizes.sum()), base + packed)
    except (zlib.error, ValueError) as e:
        raise ValueError("not a unit of ids") from e
    limit = int(sizes.max(initial=0)) + 2
    words = np.zeros((lanes, limit), np.uint64)
    words[np.arange(limit) < sizes[:, None]] = flat
    words = np.ascontiguousarray(words.T)
    models = Models(lanes, alphabet)
    short = steps - (lanes * steps - n)
    size = np.full(lanes, 2**64 - 1, np.uint64)
    code, at = (words[0] << HALF) | words[1], np.full(lanes, 2, np.int64)  # above the range's low end
    out = np.zeros((steps, lanes), np.int32)

    def take(lanes_: np.ndarray) -> None:
        place = at.take(lanes_)
        code[lanes_] = (code.take(lanes_) << HALF) | words[np.minimum(place, limit - 1), lanes_]
        size[lanes_] = size.take(lanes_) << HALF
        at[lanes_] = place + 1

    for t in range(steps if n else 0):
        m = lanes if t < short else lanes - 1
        models.renew()
        cell = models.predict(m)
        unit = size[:m] >> SHARE
        now = code[:m]
        outcome = (now >= unit * models.edges.take(cell + 1)).view(np.uint8) + (now >= unit * models.edges.take(cell + 2))
        cell += outcome
        now -= unit * models.edges.take(cell)
        np.multiply(unit, models.widths.take(cell), out=size[:m])
        take(np.flatnonzero(size[:m] < FULL))
        x = np.where(outcome == 0, models.id[0], models.id[1])
        rest = np.flatnonzero(outcome == 2)
        if len(rest):
            left = code[rest]
            unit = size[rest] >> TOTAL
            x[rest] = own = models.ids_at(np.minimum(left // unit, np.uint64((1 << 20) - 1)).astype(np.int64))
            code[rest] = left - unit * models.cum.take(own).astype(np.uint64)
            size[rest] = unit = unit * models.width.take(own).astype(np.uint64)
            take(rest[unit < FULL])
        out[t, :m] = x
        models.learn(x, cell, x[rest])
    return out.T.ravel()[:n].astype(np.int64) if n else np.zeros(0, np.int64)
